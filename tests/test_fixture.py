"""Fixture relations that Spark derives by operations of its own, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kgloom.catalog import entities as ec
from kgloom.catalog import memory as mc
from kgloom.catalog.ctes import with_ctes
from kgloom.catalog.fixtures import TABLES, Fixture
from kgloom.operators import entities as e
from kgloom.operators import memory as p

SF = "/root/testdata/sf0.001"
SHIFTED = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Order keys of six digits, one line twice and two rows of one customer."""
    entry.queries()                      # all modules register their relations
    path, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t}_in as select * from '{SF}/{t}.parquet'")
        key = SHIFTED.get(t)
        rows = f"select * replace ({key} + 100000 as {key}) from {t}_in" if key else f"select * from {t}_in"
        if t == "lineitem":
            rows = f"{rows} union all ({rows} order by all limit 1)"
        if t == "customer":
            rows = f"{rows} union all (select * replace ('other' as c_mktsegment) from {t}_in order by c_custkey limit 1)"
        con.execute(f"copy ({rows}) to '{path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return path, con


def same(df, con, sql):
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({sql}) t").fetchall()
    text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    return text(df.select(*names).collect()) == text(want)


@pytest.mark.parametrize("name", ["triples", "best_name", "branches", "reply_items", "members", "groups"])
def test_derived_relation_equals_its_sql(spark, odd, name):
    path, con = odd
    assert same(Fixture.of(spark, path).rel(name), con, with_ctes(name, f"SELECT * FROM {name}"))


def test_triples_of_unique_tables_are_not_shuffled(spark):
    plan = Fixture.of(spark, "/root/testdata/sf0.01").triples.where("pred <> 'type.object.name'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_lists_with_a_gap_keep_their_positions(spark, odd):
    path, con = odd
    assert same(entry.queries()["E5_align_scores"](spark, path), con, entry.oracle_sql()["E5_align_scores"])


def test_elements_without_a_score_do_not_count(spark):
    cand = spark.createDataFrame([("q", 1, "a", "n"), ("q", 1, "b", "n")], "qid string, branch int, id string, name string")
    replies = spark.createDataFrame([("q", 1, [None, "n"], [None, 2.0])], "qid string, branch int, names array<string>, scores array<double>")
    rows = e.align_scores(cand, replies).orderBy("id").collect()
    assert [(x.place, x.n_scores, x.raw) for x in rows] == [(0, 1, None), (1, 1, 2.0)]


def test_pattern_gives_every_pair(spark):
    df = entry.queries()["G8_match_pattern"](spark, SF)
    assert sorted(df.columns) == ["node", "path_id"] and df.count() == df.distinct().count()


def test_graph_of_moves_holds_no_other_edges(spark):
    graph = Fixture.of(spark, SF).graph_of(("geo.nation.region", True))
    assert "edges" not in graph.__dict__            # derived when first read
    assert [tuple(r) for r in graph.edges.select("pred", "fwd").distinct().collect()] == [("geo.nation.region", True)]
    assert graph.hubs.count() == 0


def test_branch_stats_are_one_aggregate(spark):
    cand = spark.createDataFrame([("q", 1, "a", "x"), ("q", 1, "b", e.UNNAMED), ("q", 2, "c", e.UNNAMED)], "qid string, branch int, id string, name string")
    marked = e.marked_sample(cand, 20, "7")
    usage = cand.selectExpr("qid", "branch", "1 as input_tokens", "cast(null as int) as output_tokens")
    out = e.branch_stats(cand, marked, marked.where("listed"), usage)
    assert sorted(map(tuple, out.collect())) == [("q", 1, 2, 2, 1, 0, 0, "single entity"), ("q", 2, 1, 1, 1, 0, 0, "single entity")]
    plain = e.branch_stats(cand, cand, cand, usage)
    assert {r.input_tokens: r.output_tokens for r in plain.where("branch = 1").collect()} == {2: 0}
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_replies_and_scores_stay_in_the_buckets_of_their_branches(spark):
    fx = Fixture(spark, SF)
    shown, replies = ec.shown(fx), ec.replies(fx)
    scored = e.score_shown(shown, replies)
    assert scored.count() == shown.count() > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = e.score_shown(shown, replies)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_kept_provenance_is_selected_provenance(spark):
    fx = Fixture(spark, SF)
    order = F.when(F.col("rel") != "type.object.name", F.col("group_id") * 10 + F.length("id"))
    made, once = mc.selected(fx), p.kept_provenance(mc.groups(fx), order).select(mc.selected(fx).columns)
    assert made.exceptAll(once).isEmpty() and once.exceptAll(made).isEmpty() and not once.isEmpty()
