"""Operator 3: MinHash near-dedup with tensored banding.

Two collections of ``tables`` half keys are drawn for each distinct shingle set,
each half key from ``rows`` minhashes.  A table key is a pair (A_i, B_j): with
2 * tables * rows minhashes there are tables**2 keys of 2 * rows minhashes, about
the square root of the work of drawing them apart.  At a similarity of 0.75 the
defaults (20 and 3) miss a pair with probability 2 * (1 - 0.75**3)**20 < 4e-5.

Only sets that share a half key of either collection with another are tensored.
Within a table key no pairs are listed at first: each set is verified against one
leader, links are merged into components, and this is repeated while it finds
links.  The first leaders are the sets that meet most others, which in a group of
near copies are the ones in its middle; later ones are drawn at random.  At last all pairs of a key that lie in different components are verified, so a
link of two components is never lost and a large group of copies costs about one
pair for each member.  Verification intersects full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.llm.common import keyed, staged, table
from kgloom.llm.components import components
from kgloom.llm.rarity import levels, possible, prefix_size, rare_first
from kgloom.llm.textscan import U, Words, longs, mix, pieces

SHINGLE, PERCENT = 5, 75
TABLES, ROWS = 20, 3
LEADER_ROUNDS = 3        # at most; the last step is exact after any number
SHARED = 2
BLOCK, STEP = 256, 4096


def _sets(column: pa.Array, size: int):
    """(row, sorted distinct shingle names) of each text of a batch."""
    for lo, hi, data, off in pieces(column):
        w = Words(data, off, lower=True)
        for i in range(lo, hi):
            a, b = w.row[i - lo], w.row[i - lo + 1]
            start = np.arange(a, max(b - size + 1, min(a + 1, b)))
            yield i, np.unique(w.span(start, np.minimum(start + size, b)))


def _signed(size: int, tables: int, rows: int):
    def run(batches):
        factor = mix(np.arange(2 * tables * rows, dtype=U), 31) | U(1)
        index = np.arange(2 * tables, dtype=U)
        for batch in batches:
            n = batch.num_rows
            count, f1, f2 = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, U)
            half = np.zeros((n, 2 * tables), U)
            for i, s in _sets(batch.column("text"), size):
                count[i] = len(s)
                if len(s):
                    f1[i], f2[i] = mix(s, 32).sum(), mix(s, 33).sum()
                    least = np.min([(s[k:k + 2048, None] * factor).min(axis=0) for k in range(0, len(s), 2048)], axis=0)
                    key = index + U(1)
                    for r in range(rows):
                        key = mix(key ^ least.reshape(2 * tables, rows)[:, r], 34)
                    half[i] = (key & ~U(1)) | (index >= tables).astype(U)     # the last bit tells the collection
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2 * tables), longs(half.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), pa.array(count), longs(f1), longs(f2), keys],
                names=["id", "rid", "n_shingles", "f1", "f2", "half"])
    return run


def _shingled(size: int):
    def run(batches):
        for batch in batches:
            got = [s for _, s in _sets(batch.column("text"), size)]
            off = np.concatenate([[0], np.cumsum([len(s) for s in got])]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(off), longs(np.concatenate([*got, np.zeros(0, U)])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "shingles"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose full sets reach the similarity."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("s"))
        .where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b").distinct()
    )


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """A similarity bound is also a bound on the ratio of sizes."""
    return pairs.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))


def _inside(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one crowd, in different components, that seem to reach the similarity.

    Crowds are dealt into blocks of about BLOCK sets; each pair of blocks is one
    small group of at most two blocks.  Names are cut to 31 bits, which can only add pairs.
    """
    blocks = rows.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")).select("crowd", "k")
    names = F.transform("shingles", lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int"))
    put = rows.join(blocks, "crowd").select(
        "crowd", "node", "comp", names.alias("names"), F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("own"), "k")
    put = put.select("crowd", "node", "comp", "names", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    put = put.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return put.groupBy("crowd", "lo", "hi").applyInArrow(_compared(percent), "a long, b long")


def _compared(percent: int):
    def run(group: pa.Table) -> pa.Table:
        node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
        own, lo, hi = (group.column(c).to_numpy() for c in ("own", "lo", "hi"))
        names = group.column("names").combine_chunks()
        size = np.diff(names.offsets.to_numpy())
        row = np.repeat(np.arange(len(node)), size)
        word, at, df = np.unique(names.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = df[at] > 1
        col = np.cumsum(df > 1) - 1
        both = np.zeros((len(node), len(node)), np.float32)
        at, row = col[at[shared]], row[shared]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        cuts = np.searchsorted(at, np.arange(0, (at[-1] if len(at) else 0) + STEP + 1, STEP))
        for x, y in zip(cuts[:-1], cuts[1:]):             # a slice of the words at a time
            part = np.zeros((len(node), STEP), np.float32)
            part[row[x:y], at[x:y] % STEP] = 1
            both += part @ part.T
        total = size[:, None] + size[None, :] - both
        ok = (100 * both >= percent * total - 1e-3) & (comp[:, None] != comp[None, :]) & (node[:, None] < node[None, :])
        if lo[0] != hi[0]:
            ok &= own[:, None] != own[None, :]
        a, b = np.nonzero(ok)
        return pa.table({"a": node[a], "b": node[b]})
    return run


def links(reps: DataFrame, docs: DataFrame, size: int, percent: int, tables: int) -> DataFrame:
    """(node, comp) for the representatives ``reps`` (node, rid, n, half) that have a link."""
    key = reps.select("node", "n", F.explode("half").alias("key"))
    shared = key.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    side = F.col("key").bitwiseAND(1)
    open_ = key.join(shared, "key").groupBy("node", "n").agg(      # at most 2 * tables of a node
        F.collect_set(F.when(side == 0, F.col("key"))).alias("p"), F.collect_set(F.when(side == 1, F.col("key"))).alias("q"))
    pair_key = open_.select("node", "n", F.explode("p").alias("p"), "q").select("node", "n", "p", F.explode("q").alias("q"))
    pair_key = pair_key.select("node", "n", F.xxhash64("p", "q").alias("key"))
    shared = pair_key.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    member = pair_key.join(shared, "key")
    met = member.groupBy("node").agg(F.sum("c").alias("met"))
    member = staged(member.drop("c").join(met, "node"), "table_keys")
    nodes = member.select("node").distinct().join(reps.select("node", "rid"), "node")
    sets = staged(
        docs.join(nodes, (docs["id"] == nodes["node"]) & (docs["rid"] == nodes["rid"])).select("node", "text")
        .mapInArrow(_shingled(size), "node long, shingles array<long>"), "shingle_sets")

    comp = member.select("node").distinct().withColumn("comp", F.col("node"))
    done = edges = None
    for turn in range(LEADER_ROUNDS):
        m = member.join(comp, "node") if turn else member.withColumn("comp", F.col("node"))
        first = -F.col("met") if turn < 2 else F.xxhash64("node", "key", F.lit(turn))
        lead = m.groupBy("key").agg(
            F.min(F.struct(first.alias("h"), "node", "comp", "n")).alias("l"),
            F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "l")
        met = m.join(lead, "key").where("comp <> l.comp").select("node", "n", F.col("l.node").alias("leader"), F.col("l.n").alias("m"))
        met = _sized(met, percent).groupBy("node", "leader").agg(F.count("*").alias("c"))
        best = Window.partitionBy("node").orderBy(F.desc("c"), "leader")      # at most tables**2 leaders of a node
        best = met.withColumn("r", F.row_number().over(best)).where("r = 1")
        if not turn:
            best = staged(best, "first_leaders")
            crowd = best.select("node", F.col("leader").alias("crowd"))
        pairs = best.select(
            F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        pairs = staged(pairs if done is None else pairs.join(done, ["a", "b"], "leftanti"), "leader_pairs")
        found = _verified(pairs, sets, percent)
        found = staged(found, "links")
        done = pairs if done is None else done.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        comp = _joined(member, edges)
        if turn > 1 and not found.limit(1).count():
            break
    # The rest: pairs of sets in different components that meet in a table key.  A crowd is the
    # sets with the same first leader.  Inside a crowd many pairs lie just below the similarity,
    # so they are compared block by block without listing them.  Across crowds, those pairs are
    # verified that share SHARED of their rarest shingles, as every pair of the similarity does.
    m = member.drop("met").join(comp, "node")
    mixed = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = m.join(mixed, "key").select("node", "comp", "n").distinct()
    open_ = staged(open_.join(crowd, "node", "left").withColumn("crowd", F.coalesce("crowd", "node")), "open_sets")
    rare = sets.join(open_, "node")
    inside = staged(_inside(rare, percent), "crowd_pairs")
    rare = rare_first(rare, "shingles", levels(rare.select(F.explode("shingles").alias("name"))))
    entry = rare.select("node", "comp", "n", "crowd", F.posexplode(
        F.slice("shingles", F.lit(1), prefix_size(F.col("n").cast("int"), percent, SHARED))).alias("at", "token"))
    entry = staged(entry, "prefixes")
    group = entry.select("token", "crowd").distinct()
    several = group.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    group = staged(group.join(several, "token"), "groups")
    g = group.select("token", F.col("crowd").alias("c1"))
    h = group.select("token", F.col("crowd").alias("c2"))
    x = entry.toDF("a", "xa", "na", "c1", "ka", "token")
    y = entry.toDF("b", "xb", "nb", "c2", "kb", "token")
    rest = g.join(h, "token").where("c1 < c2").join(x, ["token", "c1"]).join(y, ["token", "c2"])
    rest = rest.where((F.col("xa") != F.col("xb")) & possible(F.col("na"), F.col("ka"), F.col("nb"), F.col("kb"), percent))
    rest = rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("c"))
    rest = rest.where(F.col("c") >= SHARED).select("a", "b").unionByName(inside)
    rest = staged(rest.join(done, ["a", "b"], "leftanti"), "last_pairs")
    return components(staged(edges.unionByName(_verified(rest, sets, percent)), "links"))


def _joined(member: DataFrame, edges: DataFrame) -> DataFrame:
    known = components(edges)
    return member.select("node").distinct().join(known, "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tables: int = TABLES,
                    rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: id, rid, n_shingles, component_id, kept.

    A text without words (null included) has an empty set and no links.  Equal
    sets are one class, named by its smallest id.  A null id is never linked and
    stays.  Rows that repeat an id count as one document.  Other columns are ignored.
    """
    base = keyed(docs)
    signed = staged(base.mapInArrow(
        _signed(size, tables, rows), "id long, rid long, n_shingles long, f1 long, f2 long, half array<long>"), "signatures")
    full = signed.where("n_shingles > 0 and id is not null")
    reps = full.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("id", "rid", "half")).alias("r"))
    reps = staged(reps.select("f1", "f2", F.col("n_shingles").alias("n"), F.col("r.id").alias("node"), "r.rid", "r.half"), "classes")
    comp = links(reps, base, size, percent, tables)
    named = reps.select("f1", "f2", F.col("n").alias("n_shingles"), "node").join(comp, "node", "left").select(
        "f1", "f2", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
    linked = full.drop("half").join(named, ["f1", "f2", "n_shingles"])
    alone = signed.where("n_shingles = 0 or id is null").withColumn("component_id", F.col("id"))
    return linked.select("id", "rid", "n_shingles", "component_id").unionByName(
        alone.select("id", "rid", "n_shingles", "component_id")
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: the row with the smallest id of each component stays.

    Of rows that repeat both id and text, all stay or go together.
    """
    gone = near_duplicates(docs, **options).where("not kept").select(
        F.col("id").alias("_n_id"), F.col("rid").alias("_n_rid")).distinct()
    return docs.join(
        gone, (F.col("doc_id").cast("long") == F.col("_n_id"))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_n_rid")), "leftanti")


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUERIES = {"op3_minhash_dedup": op3_minhash_dedup}
SQL = {"op3_minhash_dedup": f"""
with recursive w as materialized (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as materialized (
  select distinct doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) as i from w where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
e as materialized (
  select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y using (g) where x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= {PERCENT} * (na.n + nb.n - i)),
r as (select doc_id as node, doc_id as root from n union select e.b, r.root from r join e on e.a = r.node where r.root < e.b),
c as (select node, min(root) as root from r group by node)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(root, w.doc_id) as component_id,
  coalesce(root, w.doc_id) = w.doc_id as kept
from w left join n on n.doc_id = w.doc_id left join c on c.node = w.doc_id"""}
