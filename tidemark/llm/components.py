"""Connected components of a link table by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of links (a, b); comp is the least node. Nothing goes to the driver but a count a round."""
    both = C.materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = C.materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("comp").alias("m"))
        low = label.join(near, label.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = label.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        jumped = low.join(up, low.comp == up.up, "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp"))
        new = C.materialise(jumped)
        label = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return label
