"""Connected components by hooking and pointer jumping; every round is stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of a link the smallest node reachable.

    Rounds are logarithmic in the longest path in practice. A round is made of joins on nodes, whose large partitions
    Spark splits, and of minima, which are combined before they are shuffled; nothing is gathered per component.
    """
    ends = links.select(F.col(a).alias("v"), F.col(b).alias("u")).filter("v <> u").distinct()
    edges = written(ends.unionByName(ends.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "edges")
    labels = written(edges.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("node"), F.least("v", "m").alias("root")),
                     "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "u").withColumnRenamed("root", "ru"), "u")
        lowest = written(seen.groupBy("v").agg(F.min("ru").alias("m")), "lowest")
        offered = lowest.join(labels.withColumnRenamed("node", "v"), "v").filter(F.col("m") < F.col("root"))
        hooks = offered.select(F.explode(F.array("v", "root")).alias("node"), "m").groupBy("node").agg(F.min("m").alias("m"))
        hooks = written(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        hooked = written(labels.join(hooks, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root")),
                         "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        labels = written(hooked.join(up, "root", "left").select("node", F.least("root", F.coalesce("_up", "root")).alias("root")),
                         "labels")
