"""Joins and rankings that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A key with at least this many rows is hot. At most rows / HOT keys are, which bounds what is broadcast.
HOT = 100_000
SALTS = 64


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, hot: int = HOT, salts: int = SALTS, how: str = "inner", spread_by: Sequence[str] | None = None) -> DataFrame:
    """Join many ``left`` rows to the one ``right`` row (or few) of each key. ``weight`` is a column of ``right``: the
    number of left rows of the key. Hot keys are dealt over ``salts`` partitions, their right row repeated; the
    hot keys alone are broadcast (at most left rows / ``hot`` of them). ``weight`` is dropped. ``spread_by``: the left
    columns whose hash deals the rows, all of them by default; name a unique one where ``left`` is wide.

    Null keys match nothing; an empty side gives an empty result (``left`` rows with nulls for how='left')."""
    on = list(on)
    hot_keys = right.where(F.col(weight) >= hot).select(*on).distinct().withColumn("_hot", F.lit(True))
    # a hash of the row, not a random number: a task that runs again deals its rows as before
    row = F.xxhash64(*[F.col(c) for c in (spread_by or [c for c, kind in left.dtypes if "map<" not in kind])])
    marked = left.join(F.broadcast(hot_keys), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(row, F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    spread = right.withColumn(
        "_salt", F.explode(F.when(F.col(weight) >= hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop(weight)
    return marked.join(spread, [*on, "_salt"], how).drop("_salt")


def running_total(df: DataFrame, group: str, order: Column, value: str, out: str, buckets: int = 1024) -> DataFrame:
    """``value`` summed over the rows of ``group`` up to and including each row, in the order of ``order`` (a BIGINT
    hash), without bringing a group into one task: sums of hash ranges first, then a window inside each range. The
    ranges' sums are groups x ``buckets`` rows. Rows of equal hash are ordered by all their columns' hash."""
    from pyspark.sql import Window as W

    keyed = df.withColumn("_o", order).withColumn("_b", F.floor((F.col("_o").cast("double") / F.lit(2.0**63) + 1) / 2 * buckets).cast("int"))
    sums = keyed.groupBy(group, "_b").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    within = W.partitionBy(group, "_b").orderBy("_o", F.xxhash64(*[F.col(c) for c in df.columns])).rowsBetween(W.unboundedPreceding, 0)
    inner = keyed.withColumn("_in", F.sum(value).over(within))
    joined = inner.alias("i").join(before.alias("b"), F.col(f"i.{group}").eqNullSafe(F.col(f"b.{group}")) & (F.col("i._b") == F.col("b._b")))
    return joined.select(*[F.col(f"i.{c}") for c in df.columns], (F.col("_in") + F.col("_before")).alias(out))
