"""Connected components by contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (id, component): every vertex with the smallest id that it reaches.

    Each round every vertex steps to the neighbour (or itself) with the least
    hashed id and the edges are contracted; hashing the order makes the number
    of rounds logarithmic even on a sorted chain. Loops and repeated edges do
    no harm; a null end drops the edge. No edges: no rows. Only the number of
    edges left reaches the driver.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    edges = staged(edges.distinct(), "edges")
    labels, left, live = None, True, edges
    while left:
        both = live.select(F.col("a").alias("v"), F.col("b").alias("w")).union(live.select("b", "a"))
        both = both.withColumn("to", F.struct(F.xxhash64("w").alias("h"), F.col("w").alias("w")))
        step = both.groupBy("v").agg(F.min("to").alias("to"))
        own = F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("w"))
        step = staged(step.select("v", F.least("to", own)["w"].alias("p")), "step")
        if labels is None:
            labels = step.select(F.col("v").alias("id"), F.col("p").alias("label"))
        else:
            labels = labels.join(step.select(F.col("v").alias("label"), "p"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
        moved = live.join(step.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(step.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        live = staged(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        left = not live.isEmpty()
    labels = staged(labels, "labels")
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
