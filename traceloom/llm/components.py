"""Connected components by joins: labels spread over edges and jump to their own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (its smallest id) of every end of the edges (``a``, ``b``)."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        spread = saved(spread, "cc-spread")
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = saved(spread.join(jump, "label", "left").select("id", "old", F.least("label", "further").alias("label")), "cc-labels")
        if moved.filter("label <> old").isEmpty():
            return moved.select("id", F.col("label").alias("component"))
        labels = moved.select("id", "label")
