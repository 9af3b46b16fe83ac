"""Connected components by randomised contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import write_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component's id is its smallest node.

    Each round maps a node to its neighbour of least keyed-hash priority (or itself) and contracts the edges by that map, so the
    number of nodes falls by a constant factor whatever the shape: stars end in two rounds, chains in a logarithmic number.
    Neighbourhoods are only aggregated (map-side combined) and joined, never gathered. Each round's tables are written to the
    shared folder. Null ends and self loops are ignored; no edges give no rows.
    """
    left = write_table(edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    labels = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("label"))
    step = 0
    while not left.isEmpty():
        step += 1
        both = left.select("a", "b").union(left.select("b", "a"))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(step))  # noqa: E731, B023
        best = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("near"), F.min(rank("b")).alias("near_rank"))
        moved = write_table(best.where(F.col("near_rank") < rank("a")).select(F.col("a").alias("from"), F.col("near").alias("to")), "moves")
        to = moved.select(F.col("from").alias("a"), F.col("to").alias("to_a"))
        to_b = moved.select(F.col("from").alias("b"), F.col("to").alias("to_b"))
        ends = left.join(to, "a", "left").join(to_b, "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        left = write_table(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        labels = write_table(labels.join(moved.select(F.col("from").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
