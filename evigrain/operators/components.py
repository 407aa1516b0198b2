"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evigrain.operators.skew import salted_join
from evigrain.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component: the smallest node of each connected component. Labels go to the smallest among the neighbours'
    and then to the label's own label, so a chain of n nodes takes about log n rounds. Every round is written to the
    shared checkpoint folder; only a count of changes reaches the driver.

    A null end is no edge; an edge to oneself gives a component of one; an empty table gives an empty result."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    # a node of very many neighbours (a star's centre) has its rows dealt over partitions
    degrees = cut(both.groupBy("y").agg(F.count(F.lit(1)).alias("_w")))
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")))
    for _ in range(rounds):
        named = labels.select(F.col("node").alias("y"), F.col("component").alias("c")).join(degrees, "y")
        near = salted_join(both, named, ["y"], "_w").groupBy("x").agg(F.min("c").alias("c"))
        lower = labels.join(near, labels.node == near.x, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("low"))
        own = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        new = cut(lower.join(own, "low", "left").select("node", "old", F.least("low", F.coalesce("up", "low")).alias("component")))
        labels = new.select("node", "component")
        if new.where("old <> component").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"no fixed point after {rounds} rounds")
