"""Connected components by least label with pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over ``edges`` (a, b), for each node of an edge.

    Each step takes the least label of all neighbours and then the label of that
    label, so long chains close in logarithmically many steps.  Labels are written
    to the shared folder after each step; only a count reaches the driver.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = staged(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = staged(low.join(up, "comp").select("node", "old", F.least("comp", "next").alias("comp")), "labels")
        if not new.where("old <> comp").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
