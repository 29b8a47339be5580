"""Group-wise helpers, reply parsing, readers and in-row pruning."""

import json

import pytest
from pyspark.sql import functions as F

from kgloom.functions import responses as p
from kgloom.operators import relations as r
from kgloom.reports.evaluate import normalize_answer
from kgloom.skew import attach_stats, block_rank, top_per_group
from kgloom.sources import io, prepare


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("key"), F.col("id").alias("v"))


def test_attach_stats_is_the_same_for_hot_and_cold_groups(skewed):
    stats = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    hot = attach_stats(skewed, stats, ["key"], "n", hot_rows=100)
    plain = skewed.join(stats, "key").select(*hot.columns)
    assert hot.count() == 3000 and hot.exceptAll(plain).count() == 0


def test_block_rank_is_the_global_position(skewed):
    ranked = block_rank(skewed, ["key"], F.floor(F.col("v") / 64), [F.col("v")])
    rows = sorted((x.key, x.v, x.pos) for x in ranked.collect())
    expected, last, n = [], None, 0
    for key, v, _ in rows:
        n = n + 1 if key == last else 1
        last = key
        expected.append((key, v, n))
    assert rows == expected


def test_top_per_group_above_the_engine_bound(skewed):
    got = top_per_group(skewed, ["key"], [F.col("v")], 1001)
    assert got.where("key = 0").count() == 1001
    assert got.where("key = 0").agg(F.max("v")).first()[0] < 3000


def test_prune_in_row_equals_table_form(spark):
    cand = [("q", True, "x"), ("q", True, "y"), ("q", False, "y"), ("q", False, "z")]
    ranking = [(0, "z", None, "2"), (1, "y", "2", "0.5"), (2, "no", "1", None), (3, "x", "0", "-1"), (4, "y", "1", "9")]
    table = r.relation_prune(
        spark.createDataFrame(cand, "qid string, fwd boolean, rel string").withColumns({
            "name": F.col("rel"), "last_rel": F.lit("z"), "last_fwd": F.lit(True)}),
        spark.createDataFrame([("q", *x) for x in ranking], "qid string, pos int, text string, rank string, score string"),
        ["qid"], 1000, 3)
    one = spark.createDataFrame([(["x", "y"], ["y", "z"], ranking)],
                                "heads array<string>, tails array<string>, ranking array<struct<pos:int,text:string,rank:string,score:string>>")
    last = F.struct(F.lit("z").alias("id"), F.lit(True).alias("fwd"))
    row = one.select(r.prune_reply(F.col("ranking"), F.col("heads"), F.col("tails"), 3, last).alias("k")).first().k
    assert [(x.rel, x.fwd, x.score, x.rank) for x in row] == [
        (x.rel, x.fwd, x.score, x.rank) for x in table.orderBy("rank").collect()] == [("y", True, 1.0, 1), ("x", True, 0.0, 2)]


@pytest.mark.parametrize("text,want", [
    ('{"a": 1} fits {oops}', "1"), ("```json\n{\"a\": 1}\n```", "1"), ("{'a': '1'}", "1"), ("[1]", None), ('{"a": 1', None)])
def test_first_object(spark, text, want):
    obj = spark.createDataFrame([(text,)], "t string").select(p.extract_json_object(F.col("t"))["a"]).first()[0]
    assert obj == want


def test_normalize_answer(spark):
    rows = spark.createDataFrame([("The  Théâtre, a  Cat!",), ("an",), ("Then-a",)], "t string")
    assert [x[0] for x in rows.select(normalize_answer(F.col("t"))).collect()] == ["théâtre cat", "", "thena"]


def test_step_files_keep_their_stem(spark, tmp_path):
    steps = [{"step_type": "llm", "input_tokens": 3, "output_tokens": -1}, {"step_type": "sparql", "status": "ok"}]
    (tmp_path / "s1.json").write_text(json.dumps({"id": "7", "step_history": steps}, indent=1))
    (tmp_path / "param.json").write_text("{}")
    (tmp_path / "predict.json").write_text("{}")
    row = io.read_step_logs(spark, str(tmp_path)).collect()
    assert [(x.file_stem, x.id, len(x.step_history), x.step_history[0].input_tokens) for x in row] == [("s1", "7", 2, "3")]


def test_n_triples(spark, tmp_path):
    text = '<a> <p> <b> .\n<a> <n> "x \\"y\\""@EN .\n<a> <d> "1"^^<t> .\n<a> <p> <b> .\n# comment\n'
    (tmp_path / "g.nt").write_text(text)
    rows = {tuple(x) for x in io.read_triples(spark, str(tmp_path / "g.nt")).collect()}
    assert rows == {("a", "p", "b", "uri", ""), ("a", "n", 'x "y"', "literal", "en"), ("a", "d", "1", "typed-literal", "")}


def test_question_without_any_trace_keeps_log_order(spark):
    a = spark.createDataFrame([("q", 0, None, "s0"), ("q", 1, None, "s1")], "id string, log_pos int, trace_id int, sparql string")
    b = spark.createDataFrame([("q", 0, None, "m0")], "id string, log_pos int, trace_id int, response string")
    rows = prepare.merge_step_history(a, b).orderBy("pos").collect()
    assert [x.sparql or x.response for x in rows] == ["s0", "s1", "m0"]
