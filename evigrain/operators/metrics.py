"""Measures between ranked lists, spans and claims. Lists come as arrays of ids in rank order (one row a list)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evigrain.functions import text as T


def lists_of(hits: DataFrame, by: list[str], key: str = "chunk_id", rank: str = "rank_no") -> DataFrame:
    """One array of ids in rank order a list. Lists are short (k); a rank or id that is there twice counts once."""
    one = hits.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min(rank).alias("_r"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col(key).alias("k")))), lambda s: s["k"]).alias("ids"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def rank_biased_overlap(a: Column, b: Column, p: float = 0.9) -> Column:
    """Truncated at the longer list and normalised to 1 for equal lists; two empty lists agree."""
    depth = F.greatest(F.size(a), F.size(b))
    # a common id counts at every depth from its later place on
    tail = lambda m: F.aggregate(F.sequence(m, depth), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d - 1) / d)
    later = lambda x: F.greatest(F.array_position(a, x), F.array_position(b, x)).cast("int")
    terms = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, x: s + tail(later(x)))
    return F.when(depth == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), terms / ((1 - F.pow(F.lit(p), depth)) / (1 - p))))


def kendall_tau(a: Column, b: Column) -> Column:
    """Over the common ids; fewer than two common: 1 if there is one, else 0."""
    common = F.array_intersect(a, b)
    at = F.transform(common, lambda c: F.array_position(b, c))
    n = F.size(common)
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.size(F.filter(F.slice(at, i + 1, n), lambda x: x > F.element_at(at, i))))
    pairs = n * (n - 1) / 2
    return F.when(n == 0, F.lit(0.0)).when(n == 1, F.lit(1.0)).otherwise((2 * same - pairs) / pairs)


def fidelity(pairs: DataFrame, exact: str = "exact_ids", approx: str = "approx_ids", p: float = 0.9) -> DataFrame:
    """esf (share of the exact ids found), esf_at_10, rbo, kendall_tau, n_missing, n_spurious of each row."""
    e, a = F.col(exact), F.col(approx)
    e10, a10 = F.slice(e, 1, 10), F.slice(a, 1, 10)
    share = lambda x, y: F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    return pairs.withColumns({
        "esf": share(e, a), "esf_at_10": share(e10, a10), "rbo": rank_biased_overlap(e, a, p), "kendall_tau": kendall_tau(e, a),
        "n_missing": F.size(F.array_except(e, a)), "n_spurious": F.size(F.array_except(a, e)),
    })


def consecutive(lists: DataFrame, group: str, order: str) -> DataFrame:
    """Each list beside the one before it in its group (linear in the lists, however large a group is)."""
    w = W.partitionBy(group).orderBy(order)
    return lists.withColumns({"before_ids": F.lag("ids").over(w), "before": F.lag(order).over(w)}).where("before IS NOT NULL")


def stability_neighbours(lists: DataFrame, group: str, order: str, p: float = 0.9) -> DataFrame:
    """Per group: number of lists, mean and spread of the Jaccard of neighbouring lists, mean overlap, share of identical
    neighbours. Neighbours in ``order`` stand for the runs of one group, so the work is linear in the lists."""
    pairs = consecutive(lists, group, order)
    j = jaccard(F.col("ids"), F.col("before_ids"))
    return pairs.groupBy(group).agg(
        (F.count(F.lit(1)) + 1).alias("n_lists"), F.avg(j).alias("ess"), F.coalesce(F.stddev_samp(j), F.lit(0.0)).alias("ess_std"),
        F.avg(rank_biased_overlap(F.col("ids"), F.col("before_ids"), p)).alias("mean_rbo"), F.avg((F.col("ids") == F.col("before_ids")).cast("int")).alias("identical_fraction"),
    )


#: Runs of a group that one partition pairs with all others of it.
RUNS = 128


def run_pairs(lists: DataFrame, group: str, order: str) -> DataFrame:
    """group, n_lists, o1, i1, o2, i2: the pairs of lists of a group, as the measures over repeated runs are defined on all
    of them. A group of many runs is dealt over as many partitions as it has blocks of RUNS, so none holds it whole."""
    sizes = lists.groupBy(group).agg(F.count(F.lit(1)).alias("n_lists"), F.ceil(F.count(F.lit(1)) / RUNS).cast("int").alias("_s"))
    both = lists.select(group, F.col(order).alias("o"), F.col("ids").alias("i")).join(sizes, group)
    a = both.withColumn("_p", F.pmod(F.xxhash64("o"), F.col("_s")).cast("int")).select(group, "_p", F.col("o").alias("o1"), F.col("i").alias("i1"), "n_lists")
    b = both.select(group, F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("_p"), F.col("o").alias("o2"), F.col("i").alias("i2"))
    return a.join(b, [group, "_p"]).where("o1 < o2").drop("_p")


def stability(lists: DataFrame, group: str, order: str, p: float = 0.9) -> DataFrame:
    """Per group of two lists or more: number of lists, mean and spread of the Jaccard over all pairs of its lists, mean
    overlap, share of identical pairs."""
    j = jaccard(F.col("i1"), F.col("i2"))
    return run_pairs(lists, group, order).groupBy(group).agg(
        F.first("n_lists").alias("n_lists"), F.avg(j).alias("ess"), F.coalesce(F.stddev_samp(j), F.lit(0.0)).alias("ess_std"),
        F.avg(rank_biased_overlap(F.col("i1"), F.col("i2"), p)).alias("mean_rbo"), F.avg((F.col("i1") == F.col("i2")).cast("int")).alias("identical_fraction"),
    )


def core_and_volatile(hits: DataFrame, group: str, run: str, key: str = "chunk_id") -> DataFrame:
    """Per group: runs, ids in every run, ids in some but not all. Counts only, so no set is collected."""
    runs = hits.groupBy(group).agg(F.countDistinct(run).alias("n_runs"))
    seen = hits.groupBy(group, key).agg(F.countDistinct(run).alias("in_runs"))
    return seen.join(runs, group).groupBy(group).agg(F.first("n_runs").alias("n_runs"), F.count_if(F.col("in_runs") == F.col("n_runs")).alias("n_core"), F.count_if(F.col("in_runs") < F.col("n_runs")).alias("n_volatile"))


def merged_spans(spans: DataFrame, by: list[str], start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Overlapping or touching spans merged (gaps and islands). Unlocated spans (no start, or empty) are left out."""
    ok = spans.where((F.col(start) >= 0) & (F.col(end) > F.col(start)))
    w = W.partitionBy(*by).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = ok.withColumn("_new", F.when(far.isNull() | (F.col(start) > far), 1).otherwise(0))
    isle = marked.withColumn("_isle", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return isle.groupBy(*by, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isle")


def span_agreement(a: DataFrame, b: DataFrame, by: list[str], record: str = "record_id") -> DataFrame:
    """Per key of ``by``: characters both evidence sets cover, characters either covers, their ratio (1 if nothing is
    covered), the Jaccard of the records, and the share of each side's rows that are located (1 without rows). ``a`` and
    ``b``: (by..., record, span_start, span_end)."""
    keys = [*by, record]
    ma, mb = merged_spans(a, keys), merged_spans(b, keys)
    size = lambda d, n: d.groupBy(*by).agg(F.sum(F.col("span_end") - F.col("span_start")).alias(n))
    right = mb.select(*keys, F.col("span_start").alias("s2"), F.col("span_end").alias("e2"))
    cut = ma.join(right, keys).select(*by, (F.least("span_end", "e2") - F.greatest("span_start", "s2")).alias("n")).where("n > 0").groupBy(*by).agg(F.sum("n").alias("both_chars"))
    every = a.select(*by).union(b.select(*by)).distinct()
    found = F.avg(((F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start"))).cast("int"))
    share = lambda d, n: d.groupBy(*by).agg(F.coalesce(found, F.lit(0.0)).alias(n))
    sides = a.select(*by, record, F.lit(1).alias("ina"), F.lit(0).alias("inb")).union(b.select(*by, record, F.lit(0).alias("ina"), F.lit(1).alias("inb")))
    records = sides.groupBy(*by, record).agg(F.max("ina").alias("ina"), F.max("inb").alias("inb")).groupBy(*by).agg(F.avg(F.col("ina") * F.col("inb")).alias("record_jaccard"))
    every = every.join(records, by, "left").join(share(a, "located_a"), by, "left").join(share(b, "located_b"), by, "left").fillna(1.0, ["located_a", "located_b"])
    joined = every.join(size(ma, "na"), by, "left").join(size(mb, "nb"), by, "left").join(cut, by, "left")
    both = F.coalesce("both_chars", F.lit(0).cast("long"))
    union = F.coalesce("na", F.lit(0).cast("long")) + F.coalesce("nb", F.lit(0).cast("long")) - both
    return joined.select(*by, both.alias("both_chars"), union.alias("union_chars"), F.when(union == 0, F.lit(1.0)).otherwise(both / union).alias("agreement"), "record_jaccard", "located_a", "located_b")


def crossover(measured: DataFrame, budget_ms: float = 1000.0, least_esf: float = 0.99) -> DataFrame:
    """corpus_size, exact_latency_ms, approx_latency_ms, esf with the verdict and the speed-up."""
    verdict = F.when(F.col("exact_latency_ms") <= budget_ms, "exact sufficient").when(F.col("esf") >= least_esf, "approximate justified").otherwise("approximate needed but fidelity too low")
    faster = F.when(F.col("approx_latency_ms") == 0, F.lit(float("inf"))).otherwise(F.col("exact_latency_ms") / F.when(F.col("approx_latency_ms") == 0, F.lit(1.0)).otherwise(F.col("approx_latency_ms")))
    return measured.withColumns({"verdict": verdict, "speedup": faster})


def bootstrap_interval(values: Column, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> Column:
    """[low, high] of the mean of a group, by a seeded bootstrap; a grouped aggregate. No value gives NaN."""
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> list[float]:
        x = v.dropna().to_numpy(float)
        if not len(x):
            return [float("nan"), float("nan")]
        rng = np.random.default_rng(seed)
        means = np.concatenate([x[rng.integers(0, len(x), (min(500, resamples - i), len(x)))].mean(axis=1) for i in range(0, resamples, 500)])
        return [float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2))]

    return run(values)


def claims(texts: DataFrame, key: str, text: str = "text", least: int = 6, most: int = 60) -> DataFrame:
    """key, claim_no, claim, hedged: the assertive sentences of ``least`` to ``most`` words."""
    rows = texts.select(key, F.posexplode(T.sentences(text)).alias("claim_no", "claim"))
    return rows.where(T.word_count("claim").between(least, most) & ~F.col("claim").endswith("?")).withColumn("hedged", T.hedged(F.col("claim")))


def grounded(claim_words: Column, passage_words: Column, threshold: float = 0.6) -> Column:
    """Whether a passage covers enough of a claim's content words; a claim without any isn't grounded."""
    n = F.size(claim_words)
    return (n > 0) & (F.size(F.array_intersect(claim_words, passage_words)) >= threshold * n)


def attribute(claim_rows: DataFrame, passages: DataFrame, by: str, passage_key: str = "chunk_id", threshold: float = 0.6) -> DataFrame:
    """Claims with the number of passages of the same ``by`` key (an evidence set of k) that ground them."""
    c = claim_rows.select(by, "claim_no", "hedged", T.content_words("claim").alias("cw"))
    p = passages.select(by, F.col(passage_key), T.content_words("text").alias("pw"))
    met = c.join(p, by, "left").withColumn("g", F.coalesce(grounded(F.col("cw"), F.col("pw"), threshold), F.lit(False)))
    return met.groupBy(by, "claim_no", "hedged").agg(F.count_if("g").alias("n_supporting"), F.bool_or("g").alias("grounded"))


def divergence(flags: DataFrame, by: str, exact: str = "in_exact", approx: str = "in_approx") -> DataFrame:
    """Per key: claims lost, gained and kept between two evidence sets, and (lost + gained) / claims (0 without any)."""
    lost, gained, kept = F.count_if(F.col(exact) & ~F.col(approx)), F.count_if(~F.col(exact) & F.col(approx)), F.count_if(F.col(exact) & F.col(approx))
    n = F.count(F.lit(1))
    return flags.groupBy(by).agg(lost.alias("n_lost"), gained.alias("n_gained"), kept.alias("n_kept"), F.when(n == 0, F.lit(0.0)).otherwise((lost + gained) / n).alias("divergence"))
