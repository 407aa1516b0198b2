"""What is kept and shown of runs: evidence sets and their verifications as tables, a fidelity and stability figure, a
study of one corpus, and the divergence of a synthesis between evidence sets."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from evigrain.functions import headings as H, text as T
from evigrain.operators import chunking, metrics, records as R
from evigrain.plans import experiment, retrieval

EVIDENCE = "review_id bigint, stage string, query string, query_hash string, corpus_hash string, corpus_size bigint, evidence_digest string, certificate string, evidence string, status string, error_message string, saved_at timestamp"
VERIFICATIONS = "review_id bigint, stage string, query_hash string, verified_by bigint, ok boolean, mismatches array<string>, detail string, verified_at timestamp"


def save_evidence(rows: DataFrame, path: str) -> None:
    """Append evidence sets (columns of EVIDENCE but query_hash, which is the SHA-256 of the query). A set of the same
    review, stage and query replaces the one before when read."""
    named = rows.withColumn("query_hash", F.sha2(T.text_of("query"), 256))
    fields = [f.strip().rsplit(" ", 1) for f in EVIDENCE.split(",")]
    there = [F.col(n).cast(kind).alias(n) if n in named.columns else F.lit(None).cast(kind).alias(n) for n, kind in fields]
    named.select(*there).write.mode("append").parquet(path)


def evidence_sets(spark: SparkSession, path: str) -> DataFrame:
    """The last saved evidence set of each review, stage and query."""
    newest = W.partitionBy("review_id", "stage", "query_hash").orderBy(F.desc("saved_at"), F.desc("evidence_digest"))
    return spark.read.schema(EVIDENCE).parquet(path).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def save_verifications(rows: DataFrame, path: str) -> None:
    """Append verification attempts; all of them are kept, as a review's history."""
    rows.select(*[f.strip().split(" ")[0] for f in VERIFICATIONS.split(", ")]).write.mode("append").parquet(path)


def scatter_svg(points: list[tuple[str, float, float]], size: int = 420, margin: int = 50) -> str:
    """An SVG figure of back ends by fidelity (across) and stability (up), both from 0 to 1; exact search is at (1, 1)."""
    side = size - 2 * margin
    at = lambda u, v: (round(margin + u * side, 1), round(size - margin - v * side, 1))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}" font-family="sans-serif" font-size="11">', f'<rect width="{size}" height="{size}" fill="#fff"/>']
    for tick in range(0, 101, 20):
        (x, y0), (_, y1), (x0, y), (x1, _) = at(tick / 100, 0), at(tick / 100, 1), at(0, tick / 100), at(1, tick / 100)
        out.append(f'<path d="M{x} {y0}V{y1}M{x0} {y}H{x1}" stroke="#ddd" fill="none"/><text x="{x}" y="{y0 + 16}" text-anchor="middle">{tick / 100:g}</text><text x="{x0 - 6}" y="{y + 4}" text-anchor="end">{tick / 100:g}</text>')
    out.append(f'<text x="{size / 2}" y="{size - 8}" text-anchor="middle">fidelity</text><text transform="translate(14 {size / 2}) rotate(-90)" text-anchor="middle">stability</text>')
    for name, u, v in [("exact", 1.0, 1.0), *points]:
        x, y = at(min(max(u, 0), 1), min(max(v, 0), 1))
        out.append(f'<circle cx="{x}" cy="{y}" r="5" fill="{"#0a6" if name == "exact" else "#b50"}"/><text x="{x - 8}" y="{y - 8}" text-anchor="end">{escape(name)}</text>')
    return "\n".join([*out, "</svg>"])


def divergence_between(claims: DataFrame, sets: dict[str, DataFrame], pairs: list[tuple[str, str]], threshold: float = 0.6) -> DataFrame:
    """left_set, right_set, n_lost, n_gained, n_kept, divergence: claims (claim_no, claim) that only one of two evidence
    sets (text; at most k passages each) grounds."""
    spark = claims.sparkSession
    words = claims.select("claim_no", T.content_words("claim").alias("cw"))
    held = None
    for name, passages in sets.items():
        one = passages.select(F.lit(name).alias("name"), T.content_words("text").alias("pw"))
        held = one if held is None else held.unionByName(one)
    listed = held.groupBy("name").agg(F.collect_list("pw").alias("ps"))  # k passages a set
    judged = words.join(F.broadcast(listed)).select("name", "claim_no", F.exists("ps", lambda p: metrics.grounded(F.col("cw"), p, threshold)).alias("g"))
    wanted = spark.createDataFrame(pairs, "left_set string, right_set string")
    a, b = judged.select(F.col("name").alias("left_set"), "claim_no", F.col("g").alias("in_exact")), judged.select(F.col("name").alias("right_set"), "claim_no", F.col("g").alias("in_approx"))
    both = F.broadcast(wanted).join(a, "left_set").join(b, ["right_set", "claim_no"]).withColumn("pair", F.struct("left_set", "right_set"))
    return metrics.divergence(both, "pair").select("pair.*", "n_lost", "n_gained", "n_kept", "divergence")


#: Chunks from which a measured latency may be carried on to a million.
PROJECTABLE = 10_000
#: Below so many chunks the instability of an index says little.
TELLING = 50_000


def study(corpus: DataFrame, query: str, k: int = 10, chunker: str = "sentence", section: str | None = None, seeds: int = 5, repeats: int = 3, backend: str = "lsh", params: dict | None = None) -> dict:
    """What a corpus gives for one query: coverage, a certificate and its verification by a rerun, what a section filter
    changes, latency against a budget of a second, fidelity and stability of an approximate index over seeds."""
    spark = corpus.sparkSession
    params = {"bits": 8, "tables": 4} if params is None else params
    spec, _ = chunking.build(chunker)
    chunks = chunking.chunk(corpus, chunker)
    asked = spark.createDataFrame([("q", query)], "query_id string, query_text string")

    def ids(**settings) -> list[str]:
        found = retrieval.retrieve(chunks, asked, retrieval.Settings(k=k, chunker=spec, **settings))
        return [r.chunk_id for r in found.orderBy("rank_no").collect()]  # at most k

    words = corpus.select(F.percentile(T.word_count(R.body_text()), 0.5)).collect()[0][0]
    labels = {r.label: r["count"] for r in H.section_rows(corpus).groupBy("label").count().orderBy(F.desc("count"), "label").collect()}
    coverage = R.corpus_statistics(corpus).collect()[0].asDict() | {"sections_present": labels, "median_body_words": words or 0}
    settings = retrieval.Settings(k=k, chunker=spec, mode="hybrid")
    corpus_hash, size = R.corpus_hash(corpus), corpus.count()
    first = ids(mode="hybrid")
    certificate = retrieval.issue(query, first, corpus_hash, settings, size)
    checked = retrieval.verify(certificate, query, ids(mode="hybrid"), corpus_hash, settings, size)
    n = chunks.count()
    took = experiment.timed(retrieval.retrieve(chunks, asked, retrieval.Settings(k=k, chunker=spec, mode="dense")), repeats)
    exact = ids(mode="dense")
    runs = [ids(mode="dense", index=backend, index_params=params | {"seed": s}) for s in range(seeds)]
    lists = spark.createDataFrame([("q", s, run, exact) for s, run in enumerate(runs)], "query_id string, run int, ids array<string>, exact_ids array<string>")
    fidelity = metrics.fidelity(lists.withColumnRenamed("ids", "approx_ids")).agg(F.avg("esf").alias("mean_esf"), F.min("esf").alias("min_esf")).collect()[0].asDict()
    stable = metrics.stability(lists, "query_id", "run").collect()
    return {
        "coverage": coverage, "certificate": certificate, "verification": checked,
        "section_filter": {"section": section, "kept": len(set(first) & set(ids(mode="hybrid", section_filter=(section,)))) if section else None},
        "latency": {"chunks": n, "median_ms": took, "within_budget": took <= 1000.0, "projected_million_ms": took * 1_000_000 / n if n >= PROJECTABLE else None},
        "stability": {"backend": backend, "params": params, **fidelity, **({"ess": stable[0].ess, "identical_fraction": stable[0].identical_fraction} if stable else {}), "telling": n >= TELLING},
    }
