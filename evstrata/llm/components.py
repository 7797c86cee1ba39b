"""Connected components over a table of links, in logarithmically many rounds and without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; a component is named by its smallest node.

    Each round hooks roots under the smallest label next to their trees and halves the trees' depth.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = cut(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("u", "v").withColumnRenamed("l", "lv"), "v").groupBy("u").agg(F.min("lv").alias("m"))
        seen = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        hooks = seen.select(F.col("l").alias("r"), "m").union(seen.select(F.col("u").alias("r"), "m")).groupBy("r").agg(F.min("m").alias("m"))
        one = seen.select("u", F.col("l").alias("was"), F.least("l", "m").alias("l")).join(hooks.select(F.col("r").alias("l"), F.col("m").alias("h")), "l", "left").select("u", "was", F.coalesce("h", "l").alias("l"))
        half = cut(one, "labels")
        forget(labels)
        up = half.select(F.col("u").alias("l"), F.col("l").alias("h"))
        labels = cut(half.join(up, "l", "left").select("u", "was", F.least("l", F.coalesce("h", "l")).alias("l")), "labels")
        forget(half)
        if labels.filter("l <> was").isEmpty():
            forget(edges)
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
