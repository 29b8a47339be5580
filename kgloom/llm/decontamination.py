"""Operator 8: benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Windows of an item are its runs of ``size`` consecutive words, or the whole item
if shorter.  A window can only occur where all of its words occur, so its single
rarest word in the corpus is the necessary prefix: only positions holding such a
word are joined.  The word's place in the window fixes where the window would
have to start, and the length and positional bounds drop starts outside the
document.  What is left is compared word by word.

Documents are exploded to (id, position, 64-bit word name) only; texts meet the
candidates once, on (id, rid).  Benchmark-sized tables are broadcast when a count
shows them to be below ``broadcast_rows`` (rows of a few longs each), and joined
by shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import ascii_lower, keyed, small, staged, table

WINDOW = 10
BROADCAST_ROWS = 200_000
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def alnum_words(text):
    """Words [^x00-x2F x3A-x60 x7B-x7F]+ after lower-casing A-Z."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS)
    return F.filter(parts, lambda w: w != "")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, start, words): each distinct window of each item."""
    words = items.select(F.col("item_id"), alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return words.select(
        "item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("s"),
    ).select("item_id", F.slice("w", F.col("s") + 1, F.lit(size)).alias("words")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: id, rid, n_words, n_hit, item_ids (sorted as strings).

    Null texts have no words; rows with a null id are looked at like others.
    Repeated items and repeated rows change nothing.  Other columns are ignored.
    """
    rows = keyed(docs)
    windows = staged(
        item_windows(items, size).groupBy("words").agg(F.collect_set("item_id").alias("items")), "item_windows")
    vocabulary = windows.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("name")).distinct()
    names = rows.select("id", "rid", F.transform(alnum_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    counts = names.select(F.explode("h").alias("name")).join(small(vocabulary, broadcast_rows), "name", "leftsemi")
    counts = staged(counts.groupBy("name").agg(F.count("*").alias("c")), "word_counts")
    spread = windows.select("words", F.posexplode("words").alias("at", "word")).withColumn("name", F.xxhash64("word"))
    rarest = spread.join(counts, "name", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "name", "at")).alias("p"))
    prefix = rarest.where("p.c > 0").select(   # a word that no document has ends the window here
        F.col("p.name").alias("name"), F.col("p.at").alias("at"), F.size("words").alias("len"), "words")
    prefix = staged(prefix, "prefix")
    at = names.select("id", "rid", F.size("h").alias("n"), F.posexplode("h").alias("pos", "name"))
    found = (
        at.join(small(prefix.select("name", "at", "len", "words"), broadcast_rows), "name")
        .where("pos >= at and pos - at + len <= n")
        .select("id", "rid", (F.col("pos") - F.col("at")).alias("start"), "words")
    )
    found = _with_items(found, windows, broadcast_rows).groupBy("id", "rid").agg(
        F.collect_set(F.struct("start", "words", "items")).alias("found"))        # of one document
    joined = rows.join(
        found.withColumnsRenamed({"id": "_i", "rid": "_r"}), F.col("rid").eqNullSafe(F.col("_r")) & F.col("id").eqNullSafe(F.col("_i")), "left")
    words = joined.select("id", "rid", alnum_words(F.col("text")).alias("w"), "found")
    hits = F.filter("found", lambda c: F.slice("w", c["start"] + 1, F.size(c["words"])) == c["words"])
    hit = words.select("id", "rid", F.size("w").cast("long").alias("n_words"), F.coalesce(
        hits, F.array().cast(dict(words.dtypes)["found"])).alias("hits"))
    places = F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1)))
    ids = F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"])))
    return hit.select(
        "id", "rid", "n_words", F.size(F.array_distinct(places)).cast("long").alias("n_hit"),
        F.sort_array(F.transform(ids, lambda i: i.cast("string"))).alias("item_ids"))


def _with_items(found: DataFrame, windows: DataFrame, broadcast_rows: int) -> DataFrame:
    return found.join(small(windows, broadcast_rows), "words")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with their columns."""
    # Written with the number of words: a filter pushed below the words, or words that only the
    # comparison uses, would be split out of the text again for each candidate.
    found = staged(contamination(docs, items, **options).select("id", "rid", "n_words", "n_hit"), "contamination")
    bad = found.where("n_hit > 0").select(F.col("id").alias("_d_id"), F.col("rid").alias("_d_rid")).distinct()
    return docs.join(
        bad, F.xxhash64(F.coalesce("text", F.lit(""))).eqNullSafe(F.col("_d_rid"))
        & F.col("doc_id").cast("long").eqNullSafe(F.col("_d_id")), "leftanti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql_words(t: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")


QUERIES = {"op8_decontamination": op8_decontamination}
SQL = {"op8_decontamination": f"""
with i as (select item_id, {_sql_words('text')} as ws from benchmark),
iw as (
  select distinct item_id, array_to_string(ws[s:s + {WINDOW - 1}], ' ') as v, least(len(ws), {WINDOW}) as n
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) as s from i where len(ws) > 0)),
sizes as (select distinct n from iw),
d as (select doc_id, {_sql_words('text')} as ws from documents),
dw as (
  select doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') as v
  from (select doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 1, 0) + 1)) as s from d, sizes)),
m as (select doc_id, s, dw.n, item_id from dw join iw on dw.v = iw.v and dw.n = iw.n),
hit as (select doc_id, count(distinct s + o) as h from m, range({WINDOW}) r(o) where o < n group by doc_id),
its as (
  select doc_id, count(*) as c, string_agg(x, ',' order by x) as l
  from (select distinct doc_id, item_id::varchar as x from m) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(h, 0)::bigint as n_hit, coalesce(c, 0)::bigint as n_items,
  sha256(coalesce(l, '')) as items_sha256, coalesce(h, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join its on d.doc_id = its.doc_id"""}
