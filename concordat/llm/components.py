"""Connected components of a large graph by alternating star contraction.

Each round makes every neighbour of a node point to the smallest neighbour, first for the
larger neighbours, then for the smaller ones.  Minima are aggregated before the shuffle and
the joins can be split, so the hub of a large component is never gathered in one task.
Rounds needed grow with the logarithm of the graph; each ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import drop, written
from concordat.operators.joins import keyed_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return (
        keyed_join(both.where("b > a"), least, ["a"], "inner")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = keyed_join(edges, least, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not the smallest of its component.

    Loops are ignored and either direction of an edge will do.  The result has one row per
    node; a smallest node has none.  No edges give no rows.
    """
    spark = edges.sparkSession
    known = None
    table = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    table, at = written(table.distinct(), folder, f"{name}-0"), 0
    while True:
        after = written(_small_star(_large_star(table)), folder, f"{name}-{at + 1}")
        drop(spark, folder, f"{name}-{at}")
        table, at = after, at + 1
        state = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            return table.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = state
