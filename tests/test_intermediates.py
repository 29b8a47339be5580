"""Tables and shuffle files of finished steps do not stay on disk."""

import os

from pyspark.sql import functions as F

from kgloom import skew
from kgloom.operators import retrieval as g

TRIPLE = "subj string, pred string, obj string, obj_kind string, obj_lang string"


def test_walk_keeps_only_tables_that_are_read(spark):
    triples = [(f"m.{k}", "up", f"m.{k // 2}", "uri", "") for k in range(1, 40)]
    graph = g.build_graph(spark.createDataFrame(triples, TRIPLE), None)
    hops = F.array(*[F.struct(F.lit("up").alias("id"), F.lit(True).alias("fwd")) for _ in range(3)])
    starts = spark.createDataFrame([(f"p{k}", f"m.{k}", k % 3 + 1) for k in range(8, 40)], "path_id string, node string, n int")
    paths = starts.select("path_id", "node", F.slice(hops, F.lit(1), F.col("n")).alias("chain"))
    with skew.recorded_tables([]) as made:
        ends = g.walk(paths, graph, 3)
        assert {(r.path_id, r.node) for r in ends.collect()} == {(f"p{k}", f"m.{k >> k % 3 + 1}") for k in range(8, 40)}
    left = {os.path.basename(p).split("-")[0] for p in made if os.path.exists(p)}
    assert {"stand", "reached", "named"} <= {os.path.basename(p).split("-")[0] for p in made}
    assert not left & {"stand", "reached", "named"}


def test_staged_removes_its_shuffle_files_and_restores_the_setting(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = manager.getAllBlocks()
        return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}

    before = shuffles()
    rows = spark.range(20_000).groupBy((F.col("id") % 977).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table = skew.staged(rows.repartition(3, "n"), "counted")
    assert not shuffles() - before
    assert table.count() == 977
    assert spark.conf.get(skew.CLEANUP, "false") == "false"
    skew.dropped(table)
    assert not os.path.exists(table._staged_at)
