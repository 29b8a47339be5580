"""Operator 1: substring dedup by recompression.

Words become 64-bit symbols.  A round first names maximal runs of one symbol,
then splits the alphabet in two by a bit of the symbol's hash and names each
left-right pair.  A name is a hash of what it stands for, so every task gives
equal substrings equal names and a round needs no exchange to agree on them.
With each symbol goes the interval of words its naming looked at.  Equal windows
therefore hold equal symbols wherever that interval lies inside the window.

Each window of ``window`` words is represented by the longest such symbol of the
highest round (ties: smallest name, then leftmost); consecutive windows with the
same representative form a *segment*.  Spark then works on segments:

1. segments are grouped by (symbol, content): a segment whose content occurs in
   a smaller document is removed with all its windows;
2. only symbols that stand for several contents in several documents need their
   windows compared one by one, and only one segment for each content.

Windows of different symbols are different, so nothing is missed.  Contents are
compared by 128 bits (64 of the symbol, 64 of the words).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import keyed, staged, table
from kgloom.llm.textscan import U, Words, longs, mix, pieces

WINDOW = 50
ROUNDS = 4


def _round(sym, ln, lo, hi, row, seed):
    """One round of run naming and pair naming. All arrays are per symbol; row: row of the piece."""
    # Runs: a symbol looks at both neighbours; a row's border counts as outside any window.
    n = len(sym)
    eq = np.zeros(n + 1, bool)
    same_row = np.zeros(n + 1, bool)
    same_row[1:n] = row[1:] == row[:-1]
    eq[1:n] = (sym[1:] == sym[:-1]) & same_row[1:n]
    head = np.flatnonzero(~eq[:n])
    tail = np.append(head[1:], n)
    count = tail - head
    lo2 = np.where(same_row[head], lo[head - 1], lo[head] - 1)
    hi2 = np.where(same_row[tail], hi[np.minimum(tail, n - 1)], hi[tail - 1] + 1)
    s = sym[head]
    sym = np.where(count > 1, mix(s ^ mix(count.astype(U), seed), seed), s)
    ln = ln[head] * count
    row, lo, hi = row[head], lo2, hi2
    # Pairs: left symbols look right, right symbols look left.
    n = len(sym)
    left = (mix(sym, seed + 1) & U(1)) == 0
    same_row = np.zeros(n + 1, bool)
    same_row[1:n] = row[1:] == row[:-1]
    pair = np.zeros(n + 1, bool)                # pair[i]: symbols i-1 and i become one
    pair[1:n] = left[:-1] & ~left[1:] & same_row[1:n]
    head = np.flatnonzero(~pair[:n])
    two = pair[head + 1]
    last = head + two
    nxt, prv = np.minimum(head + 1, n - 1), np.maximum(head - 1, 0)
    lone_l, lone_r = ~two & left[head], ~two & ~left[head]
    lo2 = np.where(lone_r, np.where(same_row[head], lo[prv], lo[head] - 1), lo[head])
    hi2 = np.where(lone_l, np.where(same_row[head + 1], hi[nxt], hi[head] + 1), hi[last])
    sym2 = np.where(two, mix(mix(sym[head], seed + 2) * U(3) + sym[last], seed + 3), sym[head])
    ln2 = np.where(two, ln[head] + ln[last], ln[head])
    return sym2, ln2, np.minimum.accumulate(lo2[::-1])[::-1], np.maximum.accumulate(hi2), row[head]


def _least(key, a, b):
    """Positions of the leftmost least key in [a, b), for all ranges at once (sparse table)."""
    depth = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    at = np.arange(len(key))
    for k in range(int(depth.max()) + 1):
        if k:
            half, m = 1 << (k - 1), len(key) - (1 << k) + 1
            x, y = at[:m], at[half:half + m]
            at = np.where(key[x] <= key[y], x, y)
        now = np.flatnonzero(depth == k)
        x, y = at[a[now]], at[b[now] - (1 << k)]
        out[now] = np.where(key[x] <= key[y], x, y)
    return out


def _representatives(w: Words, window: int, rounds: int):
    """(window starts, their symbols, an id of the symbol's occurrence)."""
    size = np.diff(w.row)
    starts = np.arange(w.n)
    row_of = np.repeat(np.arange(len(size)), size)
    j = starts[starts + window <= w.row[1:][row_of]] if w.n else starts
    if not len(j):
        return j, np.zeros(0, U), j
    level = (w.name, np.ones(w.n, np.int64), starts, starts + 1, row_of)
    levels = [level]
    for r in range(rounds):
        level = _round(*level, seed=10 + 4 * r)
        levels.append(level)
    sym, occ = np.zeros(len(j), U), np.zeros(len(j), np.int64)
    todo = np.arange(len(j))
    for depth in range(rounds, -1, -1):
        s, ln, lo, hi, _ = levels[depth]
        a = np.searchsorted(lo, j[todo])
        b = np.searchsorted(hi, j[todo] + window, "right")
        ok = np.flatnonzero(a < b)
        if len(ok):
            key = ((U(255) - np.minimum(ln, 255).astype(U)) << U(56)) | (mix(s, 7) >> U(8))
            best = _least(key, a[ok], b[ok])
            sym[todo[ok]] = mix(s[best], 20 + depth)
            occ[todo[ok]] = best * (rounds + 1) + depth
        todo = todo[a >= b]
        if not len(todo):
            break
    return j, sym, occ


def _segments(window: int, rounds: int):
    def run(batches):
        for batch in batches:
            ids, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "rid"))
            for lo, _, data, off in pieces(batch.column("text")):
                w = Words(data, off)
                j, sym, occ = _representatives(w, window, rounds)
                if not len(j):
                    continue
                row = np.searchsorted(w.row, j, "right") - 1
                new = np.ones(len(j), bool)
                new[1:] = (occ[1:] != occ[:-1]) | (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(j)))
                start, row = j[first], row[first]
                content = w.span(start, start + n + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [longs(sym[first]), longs(content), pa.array(ids[lo + row]), pa.array(rids[lo + row]),
                     longs(start - w.row[row]), longs(n)],
                    names=["sym", "content", "id", "rid", "start", "n"])
    return run


def _windows(window: int):
    def run(batches):
        for batch in batches:
            asked = batch.column("asked").to_pylist()
            ids, rids = batch.column("id").to_pylist(), batch.column("rid").to_pylist()
            for lo, hi, data, off in pieces(batch.column("text")):
                w = Words(data, off)
                for i in range(lo, hi):
                    start = np.array([a["start"] for a in asked[i]], np.int64)
                    n = np.array([a["n"] for a in asked[i]], np.int64)
                    sym = np.repeat(np.array([a["sym"] for a in asked[i]], np.int64), n)
                    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                    here = at + w.row[i - lo]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sym), longs(w.span(here, here + window)), pa.array(np.full(len(at), ids[i])),
                         pa.array(np.full(len(at), rids[i])), pa.array(at)],
                        names=["sym", "content", "id", "rid", "start"])
    return run


def _kept(window: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, cut in zip(batch.column("text"), batch.column("cut")):
                words = (text.as_py() or "").encode().split()
                removed = 0
                if cut.is_valid:
                    start, n = cut.values.field("start").to_numpy(), cut.values.field("n").to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                else:
                    kept = b" ".join(words)
                for c, v in zip(out, (len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def removed_spans(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(id, rid, start, n): windows start .. start+n-1 of that text occur in a smaller document."""
    rows = keyed(docs).where(F.col("id").isNotNull())
    seg = staged(rows.mapInArrow(
        _segments(window, rounds), "sym long, content long, id long, rid long, start long, n long"), "segments")
    least = seg.groupBy("sym", "content").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    least = staged(least, "contents")
    many = (
        least.groupBy("sym").agg(F.count("*").alias("c"), F.min("least").alias("a"), F.max("most").alias("b"))
        .where("c > 1 and a < b").select("sym", F.lit(True).alias("many"))
    )
    known = least.join(many, "sym", "left").where("least < most or many").drop("most")
    marked = staged(seg.join(known, ["sym", "content"]), "marked")
    whole = marked.where("least < id").select("id", "rid", "start", "n")
    ask = (
        marked.where("least = id and many").groupBy("id", "rid")
        .agg(F.collect_set(F.struct("start", "n", "sym")).alias("asked"))   # of one document
    )
    win = staged(
        rows.join(ask, ["id", "rid"])
        .mapInArrow(_windows(window), "sym long, content long, id long, rid long, start long"), "windows")
    low = (
        win.groupBy("sym", "content").agg(F.min("id").alias("least"), F.max("id").alias("most"))
        .where("least < most").drop("most")
    )
    single = win.join(low, ["sym", "content"]).where("least < id").select("id", "rid", "start", F.lit(1).cast("long").alias("n"))
    return whole.unionByName(single)


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    Output: doc_id, n_words, n_removed, kept_sha256, kept_text, one row for each
    input row.  Null text has no words; a null id is neither smaller nor larger
    than another, so such rows stay whole.  Rows that repeat an id do not remove
    each other's words.  Further input columns are ignored.
    """
    cuts = (
        removed_spans(docs, window, rounds).groupBy("id", "rid")
        .agg(F.collect_set(F.struct("start", "n")).alias("cut"))            # of one document
    )
    return keyed(docs).join(cuts, ["id", "rid"], "left").select("id", "text", "cut").mapInArrow(
        _kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL = {"op1_substring_dedup": f"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents),
win as (
  select doc_id, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') as t
  from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as s from w)),
low as (select t, min(doc_id) as least from win group by t),
hit as (select distinct doc_id, s + o as p from win join low using (t), range({WINDOW}) r(o) where least < doc_id),
word as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as p from w),
kept as (
  select word.doc_id, string_agg(x, ' ' order by word.p) as k, count(*) as n
  from word left join hit on word.doc_id = hit.doc_id and word.p = hit.p where hit.p is null group by word.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(k, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id"""}
