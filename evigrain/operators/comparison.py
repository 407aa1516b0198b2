"""Chunkers against each other: cut points, digests, spans; claims against passages by a plugged-in judge."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evigrain.operators import metrics


def cut_points(chunks: DataFrame) -> DataFrame:
    """record_id, cuts: the starts and ends of the located chunks of a record (a record's own chunks only)."""
    ok = chunks.where("span_start >= 0 AND span_end > span_start")
    return ok.groupBy("record_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("span_start", "span_end"))))).alias("cuts"))


def piece_digest(chunks: DataFrame) -> DataFrame:
    """record_id, digest: SHA-256 over the texts in order, parted by NUL."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return chunks.groupBy("record_id").agg(F.sha2(F.array_join(F.transform(listed, lambda s: s["text"]), "\0"), 256).alias("digest"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """record_id, boundary_jaccard, span_jaccard, same_pieces of two chunkings of the same records."""
    ca, cb = cut_points(a), cut_points(b).withColumnRenamed("cuts", "other")
    spans = metrics.span_agreement(a.withColumn("r", F.col("record_id")), b.withColumn("r", F.col("record_id")), ["record_id"], "r")
    same = piece_digest(a).join(piece_digest(b).withColumnRenamed("digest", "d2"), "record_id").select("record_id", (F.col("digest") == F.col("d2")).alias("same_pieces"))
    joined = ca.join(cb, "record_id", "full")
    empty = F.array().cast("array<int>")
    return joined.select("record_id", metrics.jaccard(F.coalesce("cuts", empty), F.coalesce("other", empty)).alias("boundary_jaccard")).join(spans.select("record_id", F.col("agreement").alias("span_jaccard")), "record_id", "left").join(same, "record_id", "left")


def judged(claims: DataFrame, passages: DataFrame, by: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]], threshold: float = 0.5, digits: int = 4) -> DataFrame:
    """Claims and whether some passage of the same key entails them, by a model: ``load`` is called once a worker and
    returns a function from premises and hypotheses to probabilities. ``claims``: by, claim_no, claim; ``passages``:
    by, text."""
    pairs = claims.select(by, "claim_no", "claim").join(passages.select(by, "text"), by)
    schema = f"{by} {dict(pairs.dtypes)[by]}, claim_no int, p double"

    def run(parts):
        score = load()
        for part in parts:
            p = score(part["text"].tolist(), part["claim"].tolist()) if len(part) else []
            yield pd.DataFrame({by: part[by], "claim_no": part["claim_no"], "p": [round(float(x), digits) for x in p]})

    best = pairs.mapInPandas(run, schema).groupBy(by, "claim_no").agg(F.max("p").alias("p"))
    return claims.join(best, [by, "claim_no"], "left").withColumn("grounded", F.coalesce(F.col("p") >= threshold, F.lit(False)))
