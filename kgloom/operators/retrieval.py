"""Graph retrieval: relation discovery, hops, constraints and label lookup.

The graph is held as tables derived from ``triples`` when first read, laid out for
the joins that read them:

* ``edges``    every triple from both of its ends, bucketed and sorted by
  (node, pred, fwd, salt).  A hop joins on just these keys, so only the frontier
  moves to the buckets; edges stay where they are;
* ``summary``  distinct (node, fwd, pred) with its number of edges, bucketed by
  node; it answers all relation look-ups without touching edges;
* ``marks``    each node's relations as bits, for look-ups at many nodes in one join;
* ``hubs``     the (node, pred, fwd) groups above the hub bound, whose edges are
  spread over salts.

Walks keep their reached nodes as named sets: the name is the number of nodes and
two exclusive ors of their hashes, so walks that reach the same nodes, from
whatever topics, share one set, and a set is expanded once for each move.

A node is identified by its term: an id for URIs, a quoted text for literals.
``fwd`` is true when the node is the subject of the relation.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.functions import terms
from kgloom.settings import FREEBASE, UNNAMED, GraphKind
from kgloom.skew import CODEC, attach_stats, cleaned_shuffles, dropped, staged, top_per_group, workspace

HUB_DEGREE = 1_000_000      # edges of one (node, pred, fwd) that one task may hold
BUCKET_ROWS = 4_000_000     # edges of a bucket, about
CROWD_ROWS = 10_000         # frontier rows at one (node, pred, fwd) that are joined in one place
CROWD_PAIRS = 5_000_000     # joined rows of a crowd that one task makes
EDGE_KEYS = ["node", "pred", "fwd", "salt"]
NODE_SET = ["set_id", "node", "value", "kind", "lang"]


class Graph:
    """The graph's tables; each is derived and written when it is first read.

    ``near`` limits the edges to rows (node, pred, fwd) that satisfy it, for a job
    that asks for no others; ``walked`` limits only those that hops follow, where
    relations are looked up at every node.  Without ``relation_labels`` the names of relations are
    those that the graph's own property nodes carry.
    """

    def __init__(self, triples: DataFrame, relation_labels: DataFrame | None, hub_degree: int,
                 kind: GraphKind, near: Column | None, walked: Column | None = None):
        self._triples, self._hub_degree, self._kind = triples, hub_degree, kind
        self._adj = adjacency(triples) if near is None else adjacency(triples).where(near)
        self._hops = self._adj if walked is None else self._adj.where(walked)
        self._relation_labels = relation_labels

    @cached_property
    def _buckets(self) -> int:
        return bucket_count(self._triples.sparkSession, self._adj.count())

    @cached_property
    def hubs(self) -> DataFrame:
        """node, pred, fwd, n_salts"""
        return staged(hub_list(self._hops, self._hub_degree), "hubs")

    @cached_property
    def edges(self) -> DataFrame:
        """node, pred, fwd, salt, nbr, nbr_value, nbr_kind, nbr_lang"""
        salted = salt_edges(self._hops, self.hubs).select(*EDGE_KEYS, "nbr", "nbr_value", "nbr_kind", "nbr_lang")
        return bucketed(salted, "edges", EDGE_KEYS, self._buckets)

    @cached_property
    def summary(self) -> DataFrame:
        """node, fwd, pred, n_edges"""
        return bucketed(edge_counts(self._adj), "summary", ["node"], self._buckets)

    @cached_property
    def moves(self) -> DataFrame:
        """pred, fwd, block, bit: the vocabulary, numbered in blocks of 64"""
        code = F.row_number().over(Window.orderBy("pred", "fwd")) - 1
        found = self._adj.select("pred", "fwd").distinct().withColumn("_c", code)
        return staged(found.select("pred", "fwd", F.floor(F.col("_c") / 64).cast("int").alias("block"), (F.col("_c") % 64).alias("bit")), "moves")

    @cached_property
    def marks(self) -> DataFrame:
        """node, block, bits, n: which moves of a block each node has, and its edges; a row a node for up to 64 moves"""
        marked = self._adj.select("node", "pred", "fwd").join(self.moves, ["pred", "fwd"])
        return staged(marked.groupBy("node", "block").agg(F.bit_or(_flag(F.col("bit"))).alias("bits"), F.count(F.lit(1)).alias("n")), "marks")

    @cached_property
    def labels(self) -> DataFrame:
        """id, label, lang, alias"""
        return staged(name_labels(self._triples, self._kind), "labels")

    @cached_property
    def relation_labels(self) -> DataFrame:
        """rel, label, lang"""
        given = self._relation_labels
        return relation_labels_of(self.labels, self._kind) if given is None else given


def _flag(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def term_key(value: Column, kind: Column, lang: Column) -> Column:
    """Identity of a term: literals are equal only with equal kind and language."""
    return F.when(kind.isin("uri", "bnode"), value).otherwise(
        F.concat(F.lit('"'), value, F.lit('"@'), lang, F.when(kind == "typed-literal", "^").otherwise(""))
    )


def adjacency(triples: DataFrame) -> DataFrame:
    """Each triple seen from its subject and from its object."""
    obj = term_key(F.col("obj"), F.col("obj_kind"), F.col("obj_lang"))
    ahead = triples.select(
        F.col("subj").alias("node"), F.lit(True).alias("fwd"), "pred", obj.alias("nbr"),
        F.col("obj").alias("nbr_value"), F.col("obj_kind").alias("nbr_kind"),
        F.col("obj_lang").alias("nbr_lang"),
    )
    back = triples.select(
        obj.alias("node"), F.lit(False).alias("fwd"), "pred", F.col("subj").alias("nbr"),
        F.col("subj").alias("nbr_value"), F.lit("uri").alias("nbr_kind"), F.lit("").alias("nbr_lang"),
    )
    return ahead.unionByName(back)


def edge_counts(adj: DataFrame) -> DataFrame:
    return adj.groupBy("node", "fwd", "pred").agg(F.count(F.lit(1)).alias("n_edges"))


def hub_list(adj: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(node, pred, fwd) groups above ``hub_degree`` edges, with salt counts: all of them.

    Hashes of the groups are counted first; only groups of a hash above the bound
    are counted by their names.  Every listed group has that many edges, so the list
    is smaller than the graph by this factor; joins broadcast it only while Spark
    finds it small.
    """
    hashed = adj.withColumn("_h", F.xxhash64("node", "pred", "fwd"))
    heavy = hashed.groupBy("_h").count().where(F.col("count") > hub_degree).select("_h")
    groups = edge_counts(hashed.join(staged(heavy, "heavy"), "_h", "left_semi"))
    return groups.where(F.col("n_edges") > hub_degree).select(
        "node", "pred", "fwd", F.ceil(F.col("n_edges") / hub_degree).cast("int").alias("n_salts"))


def salt_edges(adj: DataFrame, hubs: DataFrame) -> DataFrame:
    """Spread each hub's edges over its salts; all other edges have salt 0."""
    salt = F.when(F.col("n_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("nbr"), F.col("n_salts")).cast("int"))
    return adj.join(hubs, ["node", "pred", "fwd"], "left").withColumn("salt", salt).drop("n_salts")


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, dealt: bool = False) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``keys``, its files in the shared folder.

    Rows are dealt by the same hash first, so a bucket is one sorted file; the setting
    lets joins rely on that order, so only the frontier is sorted.  Rows that come
    ``dealt`` by these keys over as many partitions, as by a window, are not dealt again.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    table = f"kgloom_{name}_{uuid.uuid4().hex}"
    path = os.path.join(workspace(spark), "kgloom", spark.sparkContext.applicationId, table)
    df = df if dealt else df.repartition(buckets, *keys)
    with cleaned_shuffles(spark):
        df.write.option("path", path).option("compression", CODEC).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def bucket_count(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def build_graph(triples: DataFrame, relation_labels: DataFrame | None, hub_degree: int = HUB_DEGREE,
                kind: GraphKind = FREEBASE, near: Column | None = None, walked: Column | None = None) -> Graph:
    """The graph of ``triples``, which are read once for each table that a job asks for."""
    return Graph(triples, relation_labels, hub_degree, kind, near, walked)


def name_labels(triples: DataFrame, kind: GraphKind = FREEBASE) -> DataFrame:
    """Names and aliases of every subject by the graph kind's predicates, with their kind of source."""
    return triples.where(F.col("pred").isin(*kind.name_predicates, *kind.alias_predicates)).select(
        F.col("subj").alias("id"), F.trim("obj").alias("label"), F.col("obj_lang").alias("lang"),
        F.col("pred").isin(*kind.alias_predicates).alias("alias"),
    ).where(F.col("label") != "")


def relation_labels_of(labels: DataFrame, kind: GraphKind) -> DataFrame:
    """(rel, label, lang): names of the graph's own property nodes; none where relations are no nodes."""
    named = labels.select(F.col("id").alias("rel"), "label", "lang")
    return named.where(F.lit(False)) if kind.property_pattern is None else named.where(F.col("rel").rlike(kind.property_pattern))


# -- hops ---------------------------------------------------------------------

def _salted(paths: DataFrame, graph: Graph) -> DataFrame:
    """Frontier rows with a salt; those at hubs once for each salt."""
    every = F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1)
    return paths.join(graph.hubs, ["node", "pred", "fwd"], "left").withColumn("salt", F.explode(every)).drop("n_salts")


def crowds(paths: DataFrame, graph: Graph, rows: int = CROWD_ROWS, pairs: int = CROWD_PAIRS) -> DataFrame | None:
    """(node, pred, fwd, parts) where more than ``rows`` of ``paths`` meet; None where no crowd meets.

    ``parts`` divides the joined rows (frontier rows times edges) into tasks of about ``pairs``.
    The heavy groups are written first, so that what is joined with the summary has a known size.
    """
    heavy = staged(paths.groupBy("node", "pred", "fwd").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows), "crowds")
    if heavy.isEmpty():
        return None
    parts = F.ceil(F.col("_n") * F.col("n_edges") / pairs).cast("int")
    return staged(heavy.join(graph.summary, ["node", "pred", "fwd"]).select("node", "pred", "fwd", parts.alias("parts")), "crowds")


def hop(paths: DataFrame, graph: Graph, rows: int = CROWD_ROWS, pairs: int = CROWD_PAIRS) -> DataFrame:
    """One step along ``(pred, fwd)`` of each path row, with the neighbour's columns.

    Rows at one (node, pred, fwd) meet its edges in the edges' bucket.  Where a
    crowd of rows meets there, the rows are dealt over parts and that group's few
    edges are repeated for each part, so no task joins a whole crowd.
    """
    keys = ["node", "pred", "fwd"]
    crowd = crowds(paths, graph, rows, pairs)
    if crowd is None:
        return _salted(paths, graph).join(graph.edges, EDGE_KEYS)
    quiet = _salted(paths.join(crowd, keys, "left_anti"), graph).join(graph.edges, EDGE_KEYS)
    part = F.pmod(F.xxhash64(*paths.columns), F.col("parts")).cast("int")
    dealt = _salted(paths.join(crowd, keys), graph).withColumn("_part", part).drop("parts")
    repeated = graph.edges.join(crowd, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    loud = dealt.join(repeated, [*EDGE_KEYS, "_part"]).drop("_part")
    return quiet.unionByName(loud)


def direction_join(frontier: DataFrame, graph: Graph) -> DataFrame:
    """All (relation, direction, neighbour) of each frontier node: its moves by the summary, then a hop."""
    return hop(frontier.join(graph.summary.drop("n_edges"), "node"), graph).drop("salt")


def relations_at(paths: DataFrame, graph: Graph, keys: list[str]) -> DataFrame:
    """Distinct relations, both directions, at the nodes each path has reached."""
    return paths.join(graph.summary, "node").select(*keys, "fwd", "pred").distinct()


def pooled_relations(reached: DataFrame, graph: Graph, keys: list[str]) -> DataFrame:
    """(keys, block, bits): the relations of all nodes of each group, pooled before they are listed by ``listed_relations``."""
    nodes = reached.withColumn("block", F.explode(F.array([F.lit(b) for b in _blocks(graph)])))
    found = attach_stats(nodes, graph.marks, ["node", "block"], "n").where("bits is not null")
    return found.groupBy(*keys, "block").agg(F.bit_or("bits").alias("bits"))


def _blocks(graph: Graph) -> list[int]:
    """One for each 64 moves of the vocabulary; at least one."""
    return sorted(r.block for r in graph.moves.select("block").distinct().collect()) or [0]


def listed_relations(pooled: DataFrame, graph: Graph, keys: list[str]) -> DataFrame:
    """(keys, fwd, pred) of pooled bits."""
    return pooled.join(graph.moves, "block").where(F.col("bits").bitwiseAND(_flag(F.col("bit"))) != 0).select(*keys, "fwd", "pred")


def head_relations(frontier: DataFrame, graph: Graph) -> DataFrame:
    """Distinct relations leaving each frontier node."""
    return frontier.join(graph.summary.where("fwd"), "node").select(*frontier.columns, "pred").distinct()


def tail_relations(frontier: DataFrame, graph: Graph) -> DataFrame:
    """Distinct relations arriving at each frontier node."""
    return frontier.join(graph.summary.where("NOT fwd"), "node").select(*frontier.columns, "pred").distinct()


def set_name(n: Column, first: Column, second: Column) -> Column:
    return F.concat_ws("-", F.hex(n), F.hex(first), F.hex(second))


def single_sets(nodes: DataFrame) -> DataFrame:
    """(node, set_id): each distinct node's set of one, named as ``named_sets`` names it."""
    node = F.col("node")
    return nodes.select("node").distinct().select(
        "node", set_name(F.lit(1).cast("long"), F.xxhash64(node), F.xxhash64(node, F.lit(1))).alias("set_id"))


def named_sets(reached: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, set_id): the name of each group's set of nodes; ``reached`` holds each node of a group once."""
    node = F.col("node")
    return reached.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(node)).alias("_x"), F.bit_xor(F.xxhash64(node, F.lit(1))).alias("_y")
    ).select(*keys, set_name(F.col("_n"), F.col("_x"), F.col("_y")).alias("set_id"))


def step_sets(moves: DataFrame, sets: DataFrame, graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Expand each (set_id, pred, fwd) of ``moves`` once.

    Returns the written tables (from_set, pred, fwd, set_id) of moves that reach
    something and ``NODE_SET`` of the distinct sets they reach.
    """
    keys = ["from_set", "pred", "fwd"]
    stand = moves.select("set_id", "pred", "fwd").distinct().join(sets.select("set_id", "node"), "set_id")
    stand = staged(stand.withColumnRenamed("set_id", "from_set"), "stand")        # read twice: counted, then joined
    reached = staged(hop(stand, graph).select(
        *keys, F.col("nbr").alias("node"), F.col("nbr_value").alias("value"), F.col("nbr_kind").alias("kind"),
        F.col("nbr_lang").alias("lang")).distinct(), "reached")
    named = staged(named_sets(reached, keys), "named")
    one = named.groupBy("set_id").agg(F.min(F.struct(*keys)).alias("m")).select("set_id", "m.*")
    found = staged(reached.join(one, keys).select(*NODE_SET), "sets")
    dropped(stand, reached)
    return named, found


def walk_sets(paths: DataFrame, graph: Graph, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """(path_id, step, set_id) of each chain's end and the ends' nodes (step, ``NODE_SET``).

    ``chain`` is array<struct<id,fwd>>; a path that reaches nothing has no row.
    Work at a hop grows with the distinct sets, not with the paths that reach them.
    """
    first = single_sets(paths)
    live = staged(paths.select("path_id", "node", "chain").join(first, "node").drop("node"), "walks")
    sets = first
    ends, nodes = [], []
    for step in range(max_hops):
        here = F.get("chain", F.lit(step))
        todo = live.where(F.size("chain") > step).select(
            "path_id", "chain", "set_id", here["id"].alias("pred"), here["fwd"].alias("fwd"))
        named, sets = step_sets(todo, sets, graph)
        moved = todo.withColumnRenamed("set_id", "from_set").join(named, ["from_set", "pred", "fwd"]).select("path_id", "chain", "set_id")
        moved = staged(moved, "walks")
        if not step:
            dropped(live)                                   # later ones hold the ends of shorter chains
        dropped(named)
        live = moved
        done = live.where(F.size("chain") == step + 1).select("path_id", F.lit(step).alias("step"), "set_id")
        ends.append(done)
        nodes.append(sets.join(done.select("set_id").distinct(), "set_id", "left_semi").select(F.lit(step).alias("step"), *NODE_SET))
    return reduce(DataFrame.unionByName, ends), reduce(DataFrame.unionByName, nodes)


def walk(paths: DataFrame, graph: Graph, max_hops: int) -> DataFrame:
    """End nodes of ``chain`` for each path: ``(path_id, node, value, kind, lang)``."""
    ends, nodes = walk_sets(paths, graph, max_hops)
    return ends.join(nodes, ["step", "set_id"]).select("path_id", "node", "value", "kind", "lang")


def relations_after_chain(paths: DataFrame, graph: Graph, max_hops: int) -> DataFrame:
    """Relations at all end nodes of a chain, pooled; an empty chain is the root.

    The nodes of a last hop are not gathered to sets: each distinct last move
    pools its nodes' relations, and paths take those of their move.
    """
    size, move = F.size("chain"), ["step", "set_id", "pred", "fwd"]
    roots = pooled_relations(paths.where(size == 0).select("path_id", "node"), graph, ["path_id"])
    ends, reached = [], []
    live = paths.where(size > 0).select("path_id", "chain", F.col("node").alias("set_id"))     # a topic names its set of one
    sets = live.select("set_id", F.col("set_id").alias("node")).distinct()
    for step in range(max_hops):
        here = F.get("chain", F.lit(step))
        todo = live.select("path_id", "chain", "set_id", here["id"].alias("pred"), here["fwd"].alias("fwd"))
        last = todo.where(size == step + 1).withColumn("step", F.lit(step))
        ends.append(last.select("path_id", *move))
        ahead = last.select(*move).distinct()
        if step:
            ahead = hop(staged(ahead.join(sets.select("set_id", "node"), "set_id"), "stand"), graph)
        else:                                                       # each node once: no crowd can meet
            ahead = _salted(ahead.withColumn("node", F.col("set_id")), graph).join(graph.edges, EDGE_KEYS)
        reached.append(ahead.select(*move, F.col("nbr").alias("node")))
        if step + 1 < max_hops:
            todo = todo.where(size > step + 1)
            named, sets = step_sets(todo, sets, graph)
            live = staged(todo.withColumnRenamed("set_id", "from_set").join(named, ["from_set", "pred", "fwd"]).select("path_id", "chain", "set_id"), "walks")
    pooled = pooled_relations(reduce(DataFrame.unionByName, reached), graph, move)
    found = reduce(DataFrame.unionByName, ends).join(pooled, move).select("path_id", "block", "bits")
    return listed_relations(roots.unionByName(found), graph, ["path_id"])


def entities_after_chain(paths: DataFrame, graph: Graph, max_hops: int) -> DataFrame:
    """Distinct end terms of a chain; an empty chain yields one error row."""
    ends = walk(paths, graph, max_hops).select(
        "path_id", "kind", "value", "lang", F.lit("ok").alias("status")
    )
    empty = paths.where(F.size("chain") == 0).select(
        "path_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("lang"), F.lit("error").alias("status"),
    )
    return ends.unionByName(empty)


def entities_one_hop(frontier: DataFrame, graph: Graph) -> DataFrame:
    """Distinct neighbours along ``(pred, fwd)`` of each frontier row."""
    return hop(frontier, graph).select(
        *frontier.columns, F.col("nbr_kind").alias("kind"), F.col("nbr_value").alias("value"),
        F.col("nbr_lang").alias("lang"),
    ).distinct()


def constraint_pairs(targets: DataFrame, graph: Graph, pred: str, fwd: bool) -> DataFrame:
    """Distinct (target, constraint target) along one more relation."""
    step = targets.select("target").distinct().select(
        F.col("target").alias("node"), F.lit(pred).alias("pred"), F.lit(fwd).alias("fwd")
    )
    return hop(step, graph).select(
        F.col("node").alias("target"), F.col("nbr_value").alias("constraint_target")
    ).distinct()


def constraint_targets(targets: DataFrame, graph: Graph, pred: str, fwd: bool) -> DataFrame:
    return constraint_pairs(targets, graph, pred, fwd).select("constraint_target").distinct()


def keep_constrained(targets: DataFrame, graph: Graph, pred: str, fwd: bool, allowed: DataFrame) -> DataFrame:
    """Targets with at least one constraint target in ``allowed`` (semi-join)."""
    good = constraint_pairs(targets, graph, pred, fwd).join(allowed, "constraint_target", "left_semi")
    return targets.join(good.select("target"), "target", "left_semi")


def reaches(constant: DataFrame, graph: Graph, tail: list[tuple[str, bool]]) -> DataFrame:
    """Distinct nodes from which ``tail`` leads to a node of ``constant``: walked from its end, set at a time."""
    here = constant.select("node").distinct()
    for pred, fwd in reversed(tail):
        step = here.select("node", F.lit(pred).alias("pred"), F.lit(not fwd).alias("fwd"))
        here = hop(step, graph).select(F.col("nbr").alias("node")).distinct()
    return here


@dataclass(frozen=True)
class Matches:
    """Matches of a pattern, factorised: linear in the edges, not in the pairs."""

    paths: DataFrame      # path_id, topic, set_id
    sets: DataFrame       # set_id, node: the nodes that every path of the set matches, but its own topic

    def path_links(self) -> DataFrame:
        """(path_id, n_links): how many nodes each path matches; paths without any have no row."""
        sizes = self.sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
        own = self.paths.join(self.sets.withColumnRenamed("node", "topic").withColumn("own", F.lit(1)), ["set_id", "topic"], "left")
        left = F.col("n") - F.coalesce("own", F.lit(0))
        return own.join(sizes, "set_id").select("path_id", left.alias("n_links")).where("n_links > 0")

    def node_links(self) -> DataFrame:
        """(node, n_links): how many paths match each node; nodes without any have no row."""
        users = self.paths.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
        own = self.paths.groupBy("set_id", F.col("topic").alias("node")).agg(F.count(F.lit(1)).alias("own"))
        each = self.sets.join(users, "set_id").join(own, ["set_id", "node"], "left")
        return each.groupBy("node").agg(F.sum(F.col("n") - F.coalesce("own", F.lit(0))).alias("n_links")).where("n_links > 0")

    def opened(self, paths: DataFrame) -> DataFrame:
        """(path_id, node) of the asked ``paths`` (path_id) only."""
        asked = self.paths.join(paths.select("path_id").distinct(), "path_id", "left_semi")
        return asked.join(self.sets, "set_id").where("node <> topic").select("path_id", "node")


def match_pattern(paths: DataFrame, graph: Graph, steps: list[tuple[str, bool]],
                  tail: list[tuple[str, bool]], constant: DataFrame,
                  languages: tuple[str, ...] = ("", "en")) -> Matches:
    """Conjunctive pattern: a walk, an existential tail ending in a constant,
    ``x != topic`` and a language rule for literals.

    Semijoins from both ends: the walk keeps what topics reach, ``reaches`` what
    leads to the constant; they meet in the walk's last sets.
    """
    chain = F.array(*[F.struct(F.lit(p).alias("id"), F.lit(d).alias("fwd")) for p, d in steps])
    ends, nodes = walk_sets(paths.withColumn("chain", chain), graph, len(steps))
    kept = nodes.where((F.col("kind") == "uri") | F.col("lang").isin(*languages)).join(
        staged(reaches(constant, graph, tail), "reaching"), "node", "left_semi").select("set_id", "node")
    topics = paths.select("path_id", F.col("node").alias("topic"))
    return Matches(staged(ends.join(topics, "path_id").select("path_id", "topic", "set_id"), "matching"), staged(kept, "matched"))


def cap_results(df: DataFrame, keys: list[str], order: list[str], n: int = 1000) -> DataFrame:
    """First ``n`` rows by id of each query (the store's page size)."""
    return top_per_group(df, keys, [F.col(c) for c in order], n, "_rn").drop("_rn")


# -- labels -------------------------------------------------------------------

def language_rank(lang: Column, kind: GraphKind) -> Column:
    """Preference of a label's language; unlisted languages come last."""
    listed = F.array(*[F.lit(x) for x in kind.languages])
    at = F.array_position(listed, F.lower(F.trim(lang)) if kind.name == "freebase" else F.trim(lang))
    return F.when(at > 0, at.cast("int")).otherwise(F.lit(1_000_000))


def best_labels(labels: DataFrame, key: str, kind: GraphKind) -> DataFrame:
    """One label per key: best language, ties by text."""
    return labels.where(F.trim("label") != "").groupBy(key).agg(
        F.min_by(F.trim("label"), F.struct(language_rank(F.col("lang"), kind), F.col("label"))).alias("name")
    )


def name_or_alias(ids: DataFrame, labels: DataFrame, kind: GraphKind) -> DataFrame:
    """Best of all names and aliases per id; the unnamed mark when there is none."""
    best = best_labels(labels.join(ids.select("id").distinct(), "id", "left_semi"), "id", kind)
    return ids.join(best, "id", "left").withColumn("name", F.coalesce("name", F.lit(UNNAMED)))


def batch_labels(ids: DataFrame, labels: DataFrame, kind: GraphKind) -> DataFrame:
    """Names for a set of ids: listed languages first, then any name or alias.

    One aggregate decides both: a real name in a listed language sorts before
    every other label of the id.
    """
    rank = language_rank(F.col("lang"), kind)
    second = F.col("alias") | (rank == 1_000_000)
    wanted = labels.join(ids.select("id").distinct(), "id", "left_semi")
    best = wanted.groupBy("id").agg(
        F.min_by("label", F.struct(second, rank, F.col("label"))).alias("name")
    )
    return ids.join(best, "id", "left").withColumn("name", F.coalesce("name", F.lit(UNNAMED)))


def relation_display_names(rels: DataFrame, relation_labels: DataFrame, kind: GraphKind) -> DataFrame:
    """Display name per relation: best label, else the last part of its id."""
    if kind.property_pattern is None:
        return rels.withColumn("name", F.col("rel"))
    best = best_labels(relation_labels, "rel", kind)
    return rels.join(best, "rel", "left").withColumn(
        "name",
        F.when(F.col("rel").rlike(kind.property_pattern),
               F.coalesce("name", terms.fallback_relation_name(F.col("rel"))))
        .otherwise(terms.fallback_relation_name(F.col("rel"))),
    )


def inline_labels(rows: DataFrame, labels: DataFrame, kind: GraphKind) -> DataFrame:
    """Name of each entity: the first label its own rows carry, else the lookup."""
    carried = rows.where(F.trim("inline_label") != "").groupBy("id").agg(
        F.min_by(F.trim("inline_label"), "pos").alias("carried")
    )
    ids = rows.select("id").distinct()
    looked_up = batch_labels(ids, labels, kind)
    return looked_up.join(carried, "id", "left").select(
        "id", F.coalesce("carried", "name").alias("name")
    )


def id_name_list(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids in given order with their English name, or the id itself."""
    english = labels.where((F.col("lang") == "en") & ~F.col("alias")).groupBy("id").agg(F.min("label").alias("name"))
    return ids.join(english, "id", "left").withColumn("name", F.coalesce("name", "id"))


# -- candidate lists ------------------------------------------------------------

def name_candidates(ends: DataFrame, graph: Graph, kind: GraphKind, keys: list[str],
                    row_limit: int | None, prefix: str | None = terms.AUTO,
                    drop_unnamed: bool = True) -> DataFrame:
    """Candidates ``(keys, is_literal, id, name)`` of retrieved terms.

    The page limit acts on retrieved rows, before any filter, as at the store.
    """
    found = ends.select(*keys, "kind", "value", "lang")
    if row_limit is not None:
        found = cap_results(found, keys, ["value", "kind", "lang"], row_limit)
    split = terms.split_terms(found, "value", "kind")
    entities = terms.keep_entity_prefix(split.where("NOT is_literal"), "value", kind, prefix)
    named = batch_labels(entities.withColumnRenamed("value", "id"), graph.labels, kind)
    if drop_unnamed:
        named = terms.drop_unnamed(named, "name")
    literals = split.where("is_literal").select(*keys, "is_literal", F.lit("").alias("id"), F.col("value").alias("name"))
    return named.select(*keys, "is_literal", "id", "name").unionByName(literals).distinct()


def retrieval_stats(queries: DataFrame, raw: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Raw and kept counts per query, and whether filtering emptied it."""
    r = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_count"))
    k = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept_count"))
    out = queries.join(r, keys, "left").join(k, keys, "left").na.fill(0, ["raw_count", "kept_count"])
    emptied = (F.col("raw_count") > 0) & (F.col("kept_count") == 0)
    return out.withColumns({
        "filter_caused_empty": emptied,
        # The messages, as step logs carry them.
        "message": F.when(F.col("kept_count") > 0, "")
        .when(emptied, "No entities remained after filtering.")
        .otherwise("No entities found from current relation chain."),
    })
