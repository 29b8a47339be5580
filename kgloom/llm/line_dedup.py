"""Operator 10: near-duplicate lines by an exact set-similarity join (DataFrame functions only).

A line is a \\n-separated part of a text, its tokens the distinct words in it.  A
line goes if an earlier line (smaller document id, or the same document and a
smaller line number) reaches a Jaccard similarity of ``percent`` on tokens.
Every line that has a word is compared, whatever its size.

1. Word counts of the whole corpus, gathered in 2**20 classes of word hashes,
   give one order of tokens from rare to frequent (ties: by hash).
2. Lines with equal token sets form a class, stood for by its earliest line; all
   others go.
3. Representatives are joined on their prefix: the first token that two sets of
   that similarity share is one of their first n - ceil(percent * n / 100) + 1, the
   second one of one more.  A token of at most ``COMMON`` prefixes is a key by
   itself; any other is a key with each later token of the longer prefix, so that
   keys stay narrow as the input grows.  Length and positional bounds are part of
   the join condition, and so is a bound on the overlap from 64 parity bits of each
   set (a differing bit needs a token that only one set has).  Before the join on
   two tokens each line meets only the earliest line of each common token, and
   lines that go there need no other partner.
4. Jaccard is computed on full token sets.

Tokens are 64-bit names of words.  The class counts have a fixed size (1 MB), so
they travel to the tasks as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import keyed, native_words, small, staged, table
from kgloom.llm.rarity import levels, possible, prefix_size, rare_first

PERCENT = 85
COMMON = 256                  # prefixes that hold a token before it is a key only with a second token
BROADCAST_ROWS = 200_000      # common tokens, or documents with candidate lines (an id and some line numbers each)
_KEY = ["id", "line", "rid"]


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("id", "rid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "part"))


def _tokens(part):
    return F.array_distinct(F.transform(native_words(part), lambda w: F.xxhash64(w)))


def _earlier(a: str, b: str):
    return F.struct(*[F.col(f"{a}{c}") for c in _KEY]) < F.struct(*[F.col(f"{b}{c}") for c in _KEY])


def _parity(tokens):
    """64 bits: for each class of tokens, whether the set holds an odd number of them."""
    one = F.lit(1).cast("long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(
        F.call_function("shiftleft", one, t.bitwiseAND(63).cast("int"))))


def _apart():
    return F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")))


def _possible(percent: int, first: bool = False):
    """x is the earlier line, and no bound rules the pair (x, y) out; ``first``: if the token is the first they share."""
    nx, ny = F.col("x.n"), F.col("y.n")
    overlap = 2 * percent * (nx + ny) <= (100 + percent) * (nx + ny - _apart())       # integers, the cheapest test first
    earlier = (F.col("x.id") < F.col("y.id")) | ((F.col("x.id") == F.col("y.id")) & (F.col("x.line") < F.col("y.line")))
    if first:
        left = F.least(nx - F.col("x.at"), ny - F.col("y.at"))      # all that they share stands here or behind
        overlap = overlap & (percent * (nx + ny) <= (100 + percent) * left)
    return overlap & earlier & possible(nx, F.col("x.at"), ny, F.col("y.at"), percent)


def _opened(common: DataFrame, percent: int) -> DataFrame:
    """Entries of common tokens with the key of each later token, and the tokens ``before`` that are not in the key.

    A set that one shared token suffices for has its token alone, too.
    """
    token = F.col("token").cast("long")
    keys = F.transform("later", lambda t, i: F.struct(
        F.shiftleft(token, 31).bitwiseOR(t.cast("long")).alias("key"),
        F.concat(F.slice("prefix", F.lit(1), F.col("at")), F.slice("later", F.lit(1), i)).alias("before")))
    alone = F.array(F.struct((-1 - token).alias("key"), F.slice("prefix", F.lit(1), F.col("at")).alias("before")))
    keys = F.when(percent * F.col("n") <= 100, F.concat(keys, alone)).otherwise(keys)
    return common.select("id", "line", "n", "bits", "at", F.explode(keys).alias("k")).select("id", "line", "n", "bits", "at", "k.*")


def _on_two_tokens(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Pairs of entries of common tokens that share a key and no token before it, so a pair meets once."""
    once = ~F.arrays_overlap("x.before", "y.before")
    return _opened(x, percent).alias("x").join(_opened(y, percent).alias("y"), "key").where(
        _possible(percent, first=True) & once).select(*_pair())


def _pair():
    return [F.col("x.id").alias("xd"), F.col("x.line").alias("xl"), F.col("y.id").alias("yd"), F.col("y.line").alias("yl")]


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Later lines (id, rid, line) of ``pairs`` (xd, xl, yd, yl: document and line) that reach the similarity."""
    asked = pairs.select(F.explode(F.array(
        F.struct(F.col("xd").alias("id"), F.col("xl").alias("line")), F.struct(F.col("yd").alias("id"), F.col("yl").alias("line")))).alias("l"))
    asked = staged(asked.select("l.*").groupBy("id").agg(F.collect_set("line").alias("lines")), "asked")   # of one document
    text = rows.join(small(asked, BROADCAST_ROWS), "id")
    sets = text.select("id", "rid", "lines", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    sets = sets.where(F.array_contains("lines", F.col("line"))).select(*_KEY, _tokens(F.col("part")).alias("t"))
    sets = staged(sets, "line_sets")
    x = sets.select(F.col("id").alias("xd"), F.col("line").alias("xl"), F.col("rid").alias("xr"), F.col("t").alias("tx"))
    y = sets.select(F.col("id").alias("yd"), F.col("line").alias("yl"), F.col("rid").alias("yr"), F.col("t").alias("ty"))
    later = F.struct("xd", "xl", "xr") < F.struct("yd", "yl", "yr")
    return (
        pairs.join(x, ["xd", "xl"]).join(y, ["yd", "yl"]).where(later)
        .withColumn("i", F.size(F.array_intersect("tx", "ty")))
        .where(100 * F.col("i") >= percent * (F.size("tx") + F.size("ty") - F.col("i")))
        .select(F.col("yd").alias("id"), F.col("yr").alias("rid"), F.col("yl").alias("line")).distinct()
    )


def _removed(docs: DataFrame, percent: int) -> DataFrame:
    """(id, rid, line) of every line that goes; rows may repeat."""
    rows = keyed(docs).where("id is not null and text is not null")
    words = rows.select(F.explode(native_words(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("name"))
    # The test for a word is not made on the tokens: Spark would move it below them and make them twice.
    lines = _lines(rows).where(F.ltrim("part", F.lit(" \t\n\x0b\f\r")) != "").select(*_KEY, _tokens(F.col("part")).alias("t"))
    lines = rare_first(lines, "t", levels(words)).withColumn("n", F.size("t"))
    # Joins of prefixes use a token's rank and 24 bits of its name: a clash can only add a candidate, and the order stays.
    prefix = F.slice("t", F.lit(1), prefix_size(F.col("n"), percent, 2))
    short = F.transform(prefix, lambda t: F.shiftright(t, 32).cast("int"))
    # A class of equal sets is named by a hash, the parity bits and the size.
    lines = staged(lines.select(*_KEY, "n", F.xxhash64("t").alias("f"), _parity(F.col("t")).alias("bits"), short.alias("prefix")), "lines")
    same = ["f", "bits", "n"]
    first = lines.groupBy(*same).agg(F.min(F.struct(*_KEY, "prefix")).alias("r"), F.count("*").alias("c"))
    first = staged(first.select(*same, "c", "r.*"), "line_classes")
    many = first.where("c > 1").select(*same, *[F.col(c).alias(f"r_{c}") for c in _KEY])
    copies = lines.select(*_KEY, *same).join(many, same).where(_earlier("r_", "")).select(*_KEY)

    # One token more or less is already too far for a small set: only its class counts.
    first = first.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    # A document and a line number address a line; rows that repeat an id are told apart in _verified.
    firsts = F.slice("prefix", F.lit(1), prefix_size(F.col("n"), percent, 1))
    entry = first.select("id", "line", "n", "bits", "prefix", F.posexplode(firsts).alias("at", "token"))
    often = first.select(F.explode(firsts).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    often = small(staged(often.where(F.col("c") > COMMON).select("token"), "common_tokens"), BROADCAST_ROWS)
    few = entry.drop("prefix").join(often, "token", "leftanti")
    later = F.slice("prefix", F.col("at") + 2, F.size("prefix")).alias("later")
    common = staged(entry.join(often, "token", "leftsemi").select("*", later), "common_entries")
    lead = common.groupBy("token").agg(F.min(F.struct("id", "line", "n", "bits", "at")).alias("x"))
    lead = lead.select("token", "x.*")
    pairs = (
        lead.alias("x").join(common.alias("y"), "token").where(_possible(percent))
        .groupBy("y.id", "y.line").agg(F.min(F.struct(_apart().alias("d"), *_pair())).alias("p"))
    )
    pairs = staged(pairs.select("p.xd", "p.xl", "p.yd", "p.yl"), "leader_pairs")
    gone = staged(_verified(pairs, rows, percent), "gone_lines")
    left = common.join(gone.select("id", "line").distinct(), ["id", "line"], "leftanti")
    rest = few.alias("x").join(few.alias("y"), "token").where(_possible(percent, first=True)).select(*_pair())
    rest = rest.unionByName(_on_two_tokens(common, left, percent)).distinct().join(pairs, ["xd", "xl", "yd", "yl"], "leftanti")
    more = _verified(staged(rest, "last_pairs"), rows, percent)
    return copies.unionByName(gone).unionByName(more)


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, rid, line) of every line that goes."""
    return _removed(docs, percent).distinct()


def _with_gone(docs: DataFrame, percent: int) -> DataFrame:
    """``docs`` with the array ``_l_gone`` of line numbers that go (null: none)."""
    gone = _removed(docs, percent).groupBy(F.col("id").alias("_l_id"), F.col("rid").alias("_l_rid")).agg(
        F.sort_array(F.collect_set("line")).alias("_l_gone"))            # of one document
    return docs.join(
        gone, (F.col("doc_id").cast("long") == F.col("_l_id"))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_l_rid")), "left").drop("_l_id", "_l_rid")


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the later of similar lines cut from ``text``; columns and rows are kept.

    Lines of any size are compared; only lines without a word stay as they are.
    Null texts and rows with a null id stay as they are.  Rows that repeat an id
    are ordered by line number, then by a hash of their text; equal rows do not
    remove each other's lines, and lines of one id and number only count as
    similar if their token sets are equal.  A text may become empty.  ``n_chars``, where there is one, follows.
    """
    rows = _with_gone(docs, percent)
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_l_gone", i))
    rows = rows.withColumn("text", F.when(F.col("_l_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_l_gone").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed line numbers (comma-joined, from 0)."""
    docs = table(spark, sf_dir, "documents")
    gone = _removed(docs, PERCENT).groupBy("id", "rid").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    text = F.coalesce("text", F.lit(""))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    sizes = keyed(docs).select("id", "rid", (breaks + 1).alias("n"))
    return sizes.join(gone, ["id", "rid"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("gone", lambda i: i.cast("string")), ","), F.lit("")).alias("removed"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
# Pairs are found by a shared word among the rarest ones of each line, which no pair of that similarity can lack.
SQL = {"op10_line_dedup": f"""
with l as materialized (
  select doc_id, i - 1 as line, list_distinct(list_filter(
    regexp_split_to_array(ls[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as ws, len(ls) as n_lines
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), lateral (select unnest(range(1, len(ls) + 1)) as i)),
t as materialized (select doc_id, line, len(ws) as n, unnest(ws) as w from l where len(ws) > 0),
f as (select w, count(*) as c from t group by w),
r as materialized (
  select doc_id, line, n, w, row_number() over (partition by doc_id, line order by c, w) as p from t join f using (w)),
pre as materialized (select * from r where p <= n - ceil({PERCENT} * n / 100.0) + 1),
pairs as materialized (
  select distinct x.doc_id as xd, x.line as xl, x.n as xn, y.doc_id as yd, y.line as yl, y.n as yn
  from pre x join pre y using (w) where (x.doc_id, x.line) < (y.doc_id, y.line)
    and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)),
j as (
  select xd, xl, xn, yd, yl, yn, count(*) as o from pairs
  join t a on a.doc_id = xd and a.line = xl join t b on b.doc_id = yd and b.line = yl and a.w = b.w group by all),
g as (select distinct yd as doc_id, yl as line from j where 100 * o >= {PERCENT} * (xn + yn - o)),
s as (select doc_id, count(*) as c, string_agg(line::varchar, ',' order by line) as r from g group by doc_id)
select d.doc_id, max(n_lines)::bigint as n_lines, coalesce(max(c), 0)::bigint as n_removed, coalesce(max(r), '') as removed
from l d left join s on s.doc_id = d.doc_id group by d.doc_id"""}
