"""Connected components of a distributed list of edges by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import drop, saved


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of edges(a bigint, b bigint) but the roots: the least node of its component.

    Self-loops and repeated edges don't matter; no edges give no rows. Each round is written to the shared folder,
    so lineage stays short; the number of rounds grows with the logarithm of the longest path.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        around = Window.partitionBy("u")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.withColumn("m", F.least("u", F.min("v").over(around)))
            .where("v > u AND v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.withColumn("m", F.min("v").over(around))
        small = (
            least.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        new = saved(small, "edges")
        state = new.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum("v").alias("s")).head()
        drop(e)
        e = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
