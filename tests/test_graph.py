"""Graph storage and walks: plans, crowds, shared sets, factorised patterns, N-Triples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kgloom.operators import retrieval as g
from kgloom.settings import FREEBASE
from kgloom.sources import ntriples
from kgloom.sources.ntriples import load_triples, parse_lines

TRIPLE = "subj string, pred string, obj string, obj_kind string, obj_lang string"
CHAIN = "path_id string, node string, chain array<struct<id:string,fwd:boolean>>"


def graph_of(spark, edges, **options):
    rows = [(s, p, o, "uri", "") for s, p, o in edges]
    return g.build_graph(spark.createDataFrame(rows, TRIPLE), spark.createDataFrame([], "rel string, label string, lang string"), **options)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    edges = sorted({(f"m.{rng.randrange(25)}", rng.choice("abc"), f"m.{rng.randrange(25)}") for _ in range(160)})
    return edges, graph_of(spark, edges), graph_of(spark, edges, hub_degree=2)


def step(edges, nodes, pred, fwd):
    return {o if fwd else s for s, p, o in edges if p == pred and (s if fwd else o) in nodes}


def ancestors(plan: str, mark: str):
    """Operators between the line that holds ``mark`` and the join above it."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if mark in line)
    depth, out = re.search(r"\w", lines[at]).start(), []
    for line in reversed(lines[:at]):
        if (d := re.search(r"\w", line)) and d.start() < depth:
            depth = d.start()
            out.append(line)
            if "Join" in line:
                return out
    return out


def test_a_hop_leaves_the_edges_where_they_are(spark, world):
    edges, graph, _ = world
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = spark.createDataFrame([("q", "m.1", "a", True)], "path_id string, node string, pred string, fwd boolean")
        for df, table in ((g.hop(paths, graph), "kgloom_edges"), (g.relations_at(paths.select("path_id", "node"), graph, ["path_id"]), "kgloom_summary"),
                          (g.direction_join(paths.select("path_id", "node"), graph), "kgloom_edges")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            above = ancestors(plan, table)
            assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hubs", [False, True])
def test_walks_equal_steps_over_plain_sets(spark, world, hubs):
    edges, graph, salted = world
    rng = random.Random(int(hubs))
    paths = [(f"p{k}", f"m.{rng.randrange(27)}", [(rng.choice("abc"), rng.random() < 0.5) for _ in range(rng.randrange(4))]) for k in range(80)]
    used = salted if hubs else graph
    assert (used.hubs.count() > 0) == hubs
    want, rels = set(), set()
    for pid, node, chain in paths:
        at = {node}
        for pred, fwd in chain:
            at = step(edges, at, pred, fwd)
        if chain:
            want |= {(pid, n) for n in at}
        rels |= {(pid, True, p) for s, p, o in edges if s in at} | {(pid, False, p) for s, p, o in edges if o in at}
    df = spark.createDataFrame(paths, CHAIN)
    assert {(r.path_id, r.node) for r in g.walk(df, used, 3).collect()} == want
    assert {(r.path_id, r.fwd, r.pred) for r in g.relations_after_chain(df, used, 3).collect()} == rels


def test_topics_that_reach_the_same_nodes_share_a_set(spark):
    # 300 topics, all in one of 3 groups of 40 members: a hop from the groups is made 3 times, not 300
    edges = [(f"m.t{k}", "in", f"m.g{k % 3}") for k in range(300)] + [(f"m.g{k % 3}", "has", f"m.x{k}") for k in range(120)]
    graph = graph_of(spark, edges)
    paths = spark.createDataFrame([(f"p{k}", f"m.t{k}", [("in", True), ("has", True)]) for k in range(300)], CHAIN)
    ends, nodes = g.walk_sets(paths, graph, 2)
    assert ends.select("set_id").distinct().count() == 3 and ends.count() == 300 and nodes.count() == 120
    named, sets = g.step_sets(ends.select("set_id", F.lit("has").alias("pred"), F.lit(False).alias("fwd")), nodes, graph)
    assert named.count() == 3 and sets.count() == 3


def test_a_crowd_at_one_node_is_dealt_over_tasks(spark):
    graph = graph_of(spark, [("m.hot", "a", f"m.{k}") for k in range(20)] + [("m.cold", "a", "m.1")])
    paths = spark.range(100_000).select(F.concat(F.lit("p"), "id").alias("path_id"), F.lit("m.hot").alias("node"), F.lit("a").alias("pred"), F.lit(True).alias("fwd"))
    paths = paths.unionByName(spark.createDataFrame([("c", "m.cold", "a", True)], paths.schema))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = g.hop(paths, graph, rows=1000, pairs=20_000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2_000_001 and max(sizes) < 160_000, sizes
        assert out.select("path_id", "nbr").distinct().count() == 2_000_001
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_patterns_are_linear_and_open_to_the_pairs(spark, world):
    edges, graph, _ = world
    steps, tail = [("a", True), ("a", False)], [("b", True), ("c", False)]
    topics = sorted({s for s, _, _ in edges})
    goal = {"m.3", "m.4", "m.7"}
    good = {n for n in topics if step(edges, step(edges, {n}, *tail[0]), *tail[1]) & goal}
    pairs = {(n, x) for n in topics for x in step(edges, step(edges, {n}, *steps[0]), *steps[1]) if x != n and x in good}
    paths = spark.createDataFrame([(n, n) for n in topics], "path_id string, node string")
    found = g.match_pattern(paths, graph, steps, tail, spark.createDataFrame([(x,) for x in goal], "node string"))
    assert {(r.path_id, r.node) for r in found.opened(paths).collect()} == pairs and pairs
    assert {r.path_id: r.n_links for r in found.path_links().collect()} == {n: k for n in topics if (k := sum(p == n for p, _ in pairs))}
    assert {r.node: r.n_links for r in found.node_links().collect()} == {x: k for x in topics if (k := sum(y == x for _, y in pairs))}


def test_relations_after_chain_gather_no_last_sets(spark, monkeypatch):
    """Paths that repeat an id are pooled at their roots; moves over 64 take a second block."""
    graph = graph_of(spark, [("m.1", f"r.{i:03}", "m.2") for i in range(150)] + [("m.2", "up", "m.3")])
    paths = spark.createDataFrame(
        [("a", "m.1", []), ("a", "m.2", []), ("b", "m.1", [("r.007", True)]), ("c", "m.1", [("r.007", True), ("up", True)]), ("d", "m.3", [("r.007", True)])],
        CHAIN)
    named = []
    monkeypatch.setattr(g, "named_sets", lambda reached, keys, old=g.named_sets: named.append(reached.count()) or old(reached, keys))
    got = sorted((r.path_id, r.fwd, r.pred) for r in g.relations_after_chain(paths, graph, 2).collect())
    ahead, back = [(True, f"r.{i:03}") for i in range(150)], [(False, f"r.{i:03}") for i in range(150)]
    want = [("a", *m) for m in [*ahead, *back, (True, "up")]] + [("b", *m) for m in [*back, (True, "up")]] + [("c", False, "up")]
    assert got == sorted(want) and named == [1]          # only the first hop of c, which goes on, names a set


LINES = {
    '<s> <p> <o> .': ("s", "p", "o", "uri", ""),
    '\t<s>\t<p>\t<o>\t.\t# "comment" .': ("s", "p", "o", "uri", ""),
    '<s><p>"x"@en-GB.': ("s", "p", "x", "literal", "en-gb"),
    '_:a1 <p> _:b.c .': ("_:a1", "p", "_:b.c", "bnode", ""),
    '_:a <p> _:b.': ("_:a", "p", "_:b", "bnode", ""),
    '<s> <p> "" .': ("s", "p", "", "literal", ""),
    r'<s> <p> "a\"b\\" .': ("s", "p", 'a"b\\', "literal", ""),
    r'<s> <p> "\\\"" . # "x"': ("s", "p", '\\"', "literal", ""),
    r'<s> <p> "\t\n\r\b\f\'é\U0001F600😀z" .': ("s", "p", "\t\n\r\b\f'é😀😀z", "literal", ""),
    r'<sé> <p> <o\U00000041> .': ("sé", "p", "oA", "uri", ""),
    '<s> <p> "5"^^<http://x/int> .': ("s", "p", "5", "typed-literal", ""),
    r'<s> <p> "\\u0041" .': ("s", "p", "\\u0041", "literal", ""),
    '<s> <p> "' + "long \\\" " * 30_000 + '" .': ("s", "p", 'long " ' * 30_000, "literal", ""),
    '# only': "idle", '  ': "idle", '': "idle",
    '<s> <p> <o>': "syntax", '<s> <p> "x .': "syntax", '<s> "p" <o> .': "syntax", '"s" <p> <o> .': "syntax", '<s> <p> <o o> .': "syntax",
    '<s> <p> <o> . <x>': "syntax", '<s> _:p <o> .': "syntax", '<s> <p> "x"@ .': "syntax", '<s> <p> "x"^^int .': "syntax", 'text': "syntax",
    r'<s> <p> "\x" .': "escape", r'<s> <p> "\u12" .': "escape", r'<s\t> <p> <o> .': "escape", r'<s> <p> "\\\q" .': "escape",
    r'<s> <p> "\uD83D" .': "code point", r'<s> <p> "\uDE00x" .': "code point", r'<s> <p> "\U00110000" .': "code point", r'<s> <p> "\U0000D800" .': "code point",
}


def test_ntriples_lines(spark):
    df = spark.createDataFrame([(t, "x") for t in LINES], "value string, subj2 string")
    for r in parse_lines(df).collect():
        got = r.reason or (r.subj, r.pred, r.obj, r.obj_kind, r.obj_lang)
        assert got == LINES[r.value], r.value[:80]


def test_ntriples_patterns_run_once_a_line(spark):
    df = spark.createDataFrame([(t,) for t in LINES], "value string")
    plan = parse_lines(df).where("reason = ''").select("subj")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(ntriples._FRONT[4:30]) == 1            # a filter on the outcome is not pushed to the scan


def test_ntriples_load_loses_no_line(spark, tmp_path):
    ns = FREEBASE.entity_uri_prefixes[0]
    text = [f"<{ns}m.1> <{ns}a.b> <{ns}m.2> .", f"<{ns}m.1> <{ns}a.b> <{ns}m.2> .", f"<{ns}m.1> <{ns}> <{ns}m.2> .", "bad", "# idle", f'<{ns}m.1> <{ns}a.c> "{ns}m.2" .']
    (tmp_path / "x.nt").write_text("\n".join(text) + "\n")
    load = load_triples(spark, str(tmp_path / "x.nt"), FREEBASE)
    assert sorted(map(tuple, load.triples.collect())) == [("m.1", "a.b", "m.2", "uri", ""), ("m.1", "a.c", f"{ns}m.2", "literal", "")]
    assert [(r.file, r.line, r.reason) for r in load.quarantine.collect()] == [("x.nt", "bad", "syntax")]
    assert {r.reason: r.n_lines for r in load.counts.collect()} == {"": 4, "syntax": 1, "idle": 1}
