"""Mixing sources to target weights.

The temperature family exponentiates the sources' own token shares, w ~ share^a, with the exponent bisected until the
weights' entropy is a target entropy, or to the flattest weights that repeat no source more often than allowed.
``tempered_mixture`` draws by these weights. One exponent can't give a prescribed share to each of several sources, so
where shares are prescribed (``plan_mixture``, as TESTDATA.md states the task) the quotas are those shares, capped at
max_repeats, and the tempered weights and the exponent that comes nearest in entropy are reported beside them.

Either way the weights are realised as budgeted block permutations: a block is one pass over a source in an order of its
own, seeded by the block's number; whole blocks come first, and the last one is cut where the rest of the budget ends.

Defined results: a null source is a source without target and draws nothing, but its tokens count in the total; a null
or empty text has no tokens; a target without documents is short (starved); equal documents are drawn separately; an
empty documents table makes every target's need 0 and nothing starved but sources without documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from evigrain.llm.tokens import VOCABULARY, token_count
from evigrain.operators.skew import running_total

#: mix_targets is read to the driver: one row per source. More rows than this are refused.
MOST_SOURCES = 10_000


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised; a share of 0 stays 0."""
    powers = [math.exp(exponent * math.log(s)) if s > 0 else 0.0 for s in shares]
    total = sum(powers) or 1.0
    return [p / total for p in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def solve_exponent(shares: list[float], target_entropy: float, most_repeats: list[float], rounds: int = 60) -> float:
    """The exponent in [0, 1] whose weights have the target entropy, or the smallest that keeps every source within
    its repeats (weight <= repeats x share). Both grow flatter towards 0, so each is found by bisection."""

    def bisect(fine) -> float:
        if fine(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (low, middle) if fine(middle) else (middle, high)
        return high

    by_entropy = bisect(lambda a: entropy(tempered(shares, a)) <= target_entropy)
    by_repeats = bisect(lambda a: all(w <= r * s + 1e-12 for w, r, s in zip(tempered(shares, a), most_repeats, shares)))
    return max(by_entropy, by_repeats)


def source_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """source, n_docs, tokens over all documents (partial sums before the shuffle)."""
    counted = documents.select("source", token_count(F.col("text"), path).alias("t"))
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("tokens"))


PLAN = "source string, n_docs long, tokens long, all_tokens long, target_share double, own_share double, tempered_weight double, exponent double, max_repeats long, need double, capacity long, quota long, starved boolean"


def _plan(sizes: DataFrame, targets: DataFrame, target_entropy: float | None, prescribed: bool) -> DataFrame:
    spark = sizes.sparkSession
    wanted = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats")).limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = [w.source for w in wanted]
    known = F.when(F.col("source").isin([n for n in names if n is not None]), F.col("source"))
    sums = sizes.groupBy(known.alias("source")).agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens")).collect()
    everything = sum(r.tokens or 0 for r in sums)
    have = {r.source: (r.n_docs, r.tokens or 0) for r in sums if r.source is not None}
    repeats = [max(w.max_repeats or 0, 0) for w in wanted]
    own = [have.get(n, (0, 0))[1] for n in names]
    drawable = sum(t for t, r in zip(own, repeats) if r) or 1
    shares = [t / drawable if r else 0.0 for t, r in zip(own, repeats)]
    goal = entropy([w.target_share or 0.0 for w in wanted]) if target_entropy is None else target_entropy
    # the budget is all tokens, those of sources without a target too, so a source's weight may be this many of its shares
    exponent = solve_exponent(shares, goal, [r * drawable / everything if everything else 0.0 for r in repeats])
    rows = []
    for w, tokens, r, weight in zip(wanted, own, repeats, tempered(shares, exponent)):
        docs = have.get(w.source, (0, 0))[0]
        target = float(w.target_share or 0.0) if prescribed else float(weight)
        need, capacity = target * everything, r * tokens
        rows.append((w.source, docs, tokens, everything, target, tokens / everything if everything else 0.0, float(weight), float(exponent), r, float(need), capacity, int(min(need, capacity)), bool(docs == 0 or capacity < need)))
    return spark.createDataFrame(rows, PLAN)


def plan_mixture(sizes: DataFrame, targets: DataFrame, target_entropy: float | None = None) -> DataFrame:
    """One row per target source: its tokens, need (target_share x all tokens), capacity, quota, starved flag, and the
    tempered weight and exponent for ``target_entropy`` (that of the targets by default). ``sizes``: one row per
    source, from source_tokens."""
    return _plan(sizes, targets, target_entropy, True)


def tempered_mixture(sizes: DataFrame, targets: DataFrame, target_entropy: float | None = None) -> DataFrame:
    """The same with the tempered weights as the shares to draw: the exponent that meets ``target_entropy`` (that of
    the target shares by default) or, where a source would be repeated too often, the smallest that doesn't."""
    return _plan(sizes, targets, target_entropy, False)


def draw(documents: DataFrame, plan: DataFrame, seed: int = 42, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, block_no, token_offset, tokens: one row each time a document is drawn. Block ``block_no`` of a
    source is a pass over its documents in the order of a hash seeded by the block; token_offset is the place in it. The
    last block ends where the running total passes the rest of the quota. Running totals are summed over hash ranges, so
    no source has to fit into one task."""
    plan = plan.where("tokens > 0 AND quota > 0").select("source", F.expr("quota DIV tokens").alias("passes"), F.expr("quota % tokens").alias("rest"))
    sized = documents.select("doc_id", "source", token_count(F.col("text"), path).alias("tokens")).join(F.broadcast(plan.limit(MOST_SOURCES)), "source")
    copies = sized.withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1))))
    copies = copies.withColumn("_block", F.concat_ws("#", F.col("block_no").cast("string"), "source"))
    summed = running_total(copies, "_block", F.xxhash64(F.lit(seed), "block_no", "doc_id"), "tokens", "upto")
    kept = summed.where((F.col("block_no") < F.col("passes")) | (F.col("upto") <= F.col("rest")))
    return kept.select("doc_id", "source", "block_no", (F.col("upto") - F.col("tokens")).alias("token_offset"), "tokens")


def reached(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """The shares really reached, beside the targets; drawn_docs counts a document each time it is drawn."""
    got = drawn.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), (F.max("block_no") + 1).alias("most_repeats"), F.count(F.lit(1)).alias("drawn_docs"))
    out = plan.join(got, "source", "left").withColumns({"drawn_tokens": F.coalesce("drawn_tokens", F.lit(0)), "drawn_docs": F.coalesce("drawn_docs", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    total = got.agg(F.sum("drawn_tokens").alias("drawn_all"))  # one row
    return out.crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.bround(F.col("drawn_tokens") / F.col("all_tokens"), 6).alias("share_of_all"), F.bround(F.col("drawn_tokens") / F.col("drawn_all"), 6).alias("share_of_drawn"),
        "drawn_tokens", "drawn_docs", "most_repeats", "max_repeats", "starved", F.bround("tempered_weight", 6).alias("tempered_weight"), F.bround("exponent", 6).alias("exponent"),
    )
