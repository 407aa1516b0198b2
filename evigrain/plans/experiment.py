"""Experiment grids: back ends and seeds as rows of one plan, over chunks that are embedded once."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from evigrain.operators import chunking, metrics, search
from evigrain.plans import retrieval
from evigrain.session import cut


def subsample(records: DataFrame, size: int, key: str = "record_id") -> DataFrame:
    """The ``size`` records of the smallest ids: the grid's corpus sizes are prefixes of one another."""
    return records.orderBy(key).limit(size)


def run_grid(vectors: DataFrame, queries: DataFrame, k: int, cells: list[dict], key: str = "id", query: str = "query_id", dimension: int = 64) -> DataFrame:
    """backend, params, seed, query, esf, esf_at_10, rbo, kendall_tau, n_missing, n_spurious for each cell
    {'backend', 'params', 'seeds'}, against the exact result. The vectors are the ones given, once for all cells."""
    vectors, queries = cut(vectors), cut(queries)
    exact = cut(metrics.lists_of(search.exact(vectors, queries, k, key=key, query=query), [query], key).withColumnRenamed("ids", "exact_ids"))
    out = None
    for cell in cells:
        for seed in cell.get("seeds", [42]):
            extra = {"dimension": dimension} if cell["backend"] == "lsh" else {}
            hits = search.build_index(cell["backend"], seed=seed, **cell.get("params", {}))(vectors, queries, k, key=key, query=query, **extra)
            one = metrics.lists_of(hits, [query], key).select(query, F.col("ids").alias("approx_ids"), F.lit(cell["backend"]).alias("backend"), F.lit(",".join(f"{a}={b}" for a, b in sorted(cell.get("params", {}).items()))).alias("params"), F.lit(seed).alias("seed"))
            out = one if out is None else out.unionByName(one)
    empty = F.array().cast("array<string>")
    paired = out.join(exact, query, "right").withColumn("approx_ids", F.coalesce("approx_ids", empty))
    return metrics.fidelity(paired.where("backend IS NOT NULL"))


ROWS = "kind string, corpus_size bigint, chunker string, baseline string, backend string, params string, seed bigint, query_id string, n_chunks bigint, esf double, rbo double, kendall_tau double, span_jaccard double, min_span_jaccard double, n_runs bigint, chunk_ids array<string>"


def _rows(df: DataFrame, **fixed) -> DataFrame:
    fields = [f.strip().split(" ", 1) for f in ROWS.split(",")]
    pick = lambda n: F.lit(fixed[n]) if n in fixed else F.col(n) if n in df.columns else F.lit(None)
    return df.select(*[pick(n).cast(kind).alias(n) for n, kind in fields])


def _labelled(spec: dict | str) -> tuple[str, str, dict, list]:
    """(label, name, parameters, seeds) of a chunker given by its name or as {'name', 'params', 'seeds'}."""
    if isinstance(spec, str):
        return spec, spec, {}, [None]
    params = spec.get("params", {})
    inner = ",".join(f"{a}={b}" for a, b in sorted(params.items()))
    return f"{spec['name']}({inner})" if inner else spec["name"], spec["name"], dict(params), spec.get("seeds", [None])


def run_experiment(records: DataFrame, queries: DataFrame, sizes: list[int], chunkers: list, cells: list[dict], k: int = 20, mode: str = "dense", dimension: int = 256) -> DataFrame:
    """The grid of corpus sizes, chunkers (with seeds where they have any), back ends and build seeds, as rows by kind:
    'exact' and 'approx' a query and cell, 'chunker' (against the first one) and 'chunker_stability' a query. A size the
    corpus doesn't reach is left out. Each cell's evidence is written once and read by all comparisons."""
    out: list[DataFrame] = []
    total = records.count()
    for size in [n for n in sizes if n <= total]:
        sample = cut(subsample(records, size))
        first: tuple[str, DataFrame] | None = None
        for spec in chunkers:
            label, name, params, seeds = _labelled(spec)
            repeats = []
            for seed in seeds:
                own = params | ({} if seed is None else {"seed": seed})
                run = label if seed is None else f"{label}#seed{seed}"
                chunks = cut(chunking.chunk(sample, name, **own))
                n = chunks.count()
                places = chunks.select("chunk_id", "record_id", "span_start", "span_end")

                def evidence(places=places, chunks=chunks, **settings) -> DataFrame:
                    hits = retrieval.retrieve(chunks, queries, retrieval.Settings(k=k, mode=mode, dimension=dimension, **settings))
                    return cut(hits.join(places, "chunk_id"))

                lists = lambda e, n: metrics.lists_of(e, ["query_id"]).withColumnRenamed("ids", n)
                exact = evidence()
                repeats.append(exact)
                out.append(_rows(lists(exact, "chunk_ids"), kind="exact", corpus_size=size, chunker=run, n_chunks=n))
                for cell in cells:
                    for build in cell.get("seeds", [42]):
                        near = evidence(index=cell["backend"], index_params=cell.get("params", {}) | {"seed": build})
                        scored = metrics.fidelity(lists(exact, "exact_ids").join(lists(near, "approx_ids"), "query_id", "left").withColumn("approx_ids", F.coalesce("approx_ids", F.array().cast("array<string>"))))
                        spans = metrics.span_agreement(exact, near, ["query_id"]).select("query_id", F.col("agreement").alias("span_jaccard"))
                        inner = ",".join(f"{a}={b}" for a, b in sorted(cell.get("params", {}).items()))
                        out.append(_rows(scored.join(spans, "query_id", "left").withColumnRenamed("approx_ids", "chunk_ids"), kind="approx", corpus_size=size, chunker=run, backend=cell["backend"], params=inner, seed=build, n_chunks=n))
            if len(repeats) > 1:
                pairs = [metrics.span_agreement(a, b, ["query_id"]).select("query_id", "agreement") for i, a in enumerate(repeats) for b in repeats[i + 1 :]]
                every = pairs[0]
                for other in pairs[1:]:
                    every = every.unionByName(other)
                stable = every.groupBy("query_id").agg(F.avg("agreement").alias("span_jaccard"), F.min("agreement").alias("min_span_jaccard"))
                out.append(_rows(stable, kind="chunker_stability", corpus_size=size, chunker=label, n_runs=len(repeats)))
            if first is None:
                first = label, repeats[0]
            else:
                against = metrics.span_agreement(first[1], repeats[0], ["query_id"]).select("query_id", F.col("agreement").alias("span_jaccard"))
                out.append(_rows(against, kind="chunker", corpus_size=size, chunker=label, baseline=first[0]))
    if not out:
        return records.sparkSession.createDataFrame([], ROWS)
    rows = out[0]
    for other in out[1:]:
        rows = rows.unionByName(other)
    return rows


def save_rows(rows: DataFrame, path: str) -> None:
    """The rows of a grid as JSON lines, a folder for each kind."""
    rows.write.mode("overwrite").partitionBy("kind").json(path)


def variance_decomposition(rows: DataFrame) -> DataFrame:
    """axis, n, median, least: how far the evidence moves along each axis, on the scale of span agreement. Along the
    index it is the range over build seeds of one cell; along the chunkers and their seeds, the agreement itself."""
    cell = ["corpus_size", "chunker", "backend", "params", "query_id"]
    spread = rows.where("kind = 'approx' AND span_jaccard IS NOT NULL").groupBy(*cell).agg((F.max("span_jaccard") - F.min("span_jaccard")).alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.lit("index").alias("axis"), "v")
    others = rows.where("kind IN ('chunker', 'chunker_stability')").select(F.when(F.col("kind") == "chunker", "chunker choice").otherwise("chunker seed").alias("axis"), F.col("span_jaccard").alias("v"), F.coalesce("min_span_jaccard", "span_jaccard").alias("w"))
    both = spread.withColumn("w", F.col("v")).unionByName(others)
    return both.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.5).alias("median"), F.min("w").alias("least"))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Median, mean and least fidelity per cell, and the spread over seeds of the seeds' means."""
    per = rows.groupBy(*by, "seed").agg(F.avg("esf").alias("m"))
    spread = per.groupBy(*by).agg((F.max("m") - F.min("m")).alias("seed_spread"), F.count(F.lit(1)).alias("n_seeds"))
    base = rows.groupBy(*by).agg(F.median("esf").alias("median_esf"), F.avg("esf").alias("mean_esf"), F.min("esf").alias("min_esf"), F.count(F.lit(1)).alias("n"))
    return base.join(spread, by)


def power(n_queries: Column) -> Column:
    """What a paired design with so many queries can show at power 0.8: a medium effect from 34, a small one from 89."""
    return F.when(n_queries >= 89, "d=0.3").when(n_queries >= 34, "d=0.5").otherwise("PILOT")


def timed(df: DataFrame, repeats: int = 3) -> float:
    """Median milliseconds of running a frame to its end."""
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append((time.perf_counter() - began) * 1000)
    return sorted(took)[len(took) // 2]
