"""Operator 11: documents packed into sequences of fixed size by best fit.

Best-fit decreasing takes pieces from long to short and puts each into the open
sequence with the least room that still holds it.  Lengths are whole numbers up to
the sequence size, so the outcome depends on the number of pieces of each length
alone: open sequences with equal room are alike.  A segment tree over the rooms
(``OpenBins``) finds the tightest one in logarithmic time, and equal pieces that
fill equal sequences are placed by one move.  The plan is thus made from a
histogram of at most ``size`` rows, whatever the corpus, and equals the plan of
taking documents one by one.  Spark does the rest: tasks encode and cut texts and
number equal lengths within the task, a window over (length, task) counts adds the
numbers before, and a join with the moves gives each piece its place.

Defined results: null or empty text is the end id alone; null ids and repeated ids
or rows are packed each; a text of any length is cut; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.batch_bpe import batch_encoder
from kgloom.llm.common import staged, table

SIZE = 2048
END_ID = 0
BROADCAST_MOVES = 500_000       # 24 MB; more moves are joined by shuffle
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
MOVES = "length int, first long, items long, each long, sequence long, at int"


class OpenBins:
    """Open sequences by room: ranges of their numbers, and a segment tree over the rooms in use."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._used = [False] * (2 * self._leaves)
        self._ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int) -> None:
        k = self._leaves + room
        self._used[k] = bool(self._ranges[room])
        while k > 1:
            k //= 2
            self._used[k] = self._used[2 * k] or self._used[2 * k + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self._ranges[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        got = self._ranges[room].pop()
        self._mark(room)
        return got

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length``: up to the first subtree on the right in use, then down."""
        k = self._leaves + length
        if not self._used[k]:
            while k > 1 and not (k % 2 == 0 and self._used[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self._leaves:
                k = 2 * k if self._used[2 * k] else 2 * k + 1
        return k - self._leaves


def best_fit_moves(counts: Mapping[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (pieces of each length), as moves.

    A move (length, first, items, each, sequence, at) puts the pieces numbered
    first .. first+items-1 of a length into sequences from ``sequence`` on,
    ``each`` of them side by side from token ``at`` in every one.
    """
    bins, moves, opened = OpenBins(size), [], 0
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            each = (size if room is None else room) // length
            if room is None:
                room, start, held = size, opened, max(1, left // each)
                opened += held
            else:
                start, held = bins.take(room)
            used = min(held, left // each)
            if not used:                       # the last pieces of this length: one sequence, not full of them
                used, each = 1, left
            moves.append((length, done, used * each, each, start, size - room))
            bins.put(room - each * length, start, used)
            bins.put(room, start + used, held - used)
            done, left = done + used * each, left - used * each
    return moves


def _cut(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, start, length) of each piece; of a text that is cut only the first piece may be shorter than ``size``."""
    n = np.maximum(1, -(-lens // size))
    text = np.repeat(np.arange(len(lens)), n)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    head = (lens - (n - 1) * size)[text]
    return text, piece, np.where(piece > 0, head + (piece - 1) * size, 0), np.where(piece > 0, size, head)


def _pieces(tokenizer: str, end_id: int, size: int, keep_ids: bool):
    def run(batches):
        encoder, part, seen = batch_encoder(tokenizer, end_id), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            ids, lens = encoder.encode(batch.column("text"))
            text, piece, start, length = _cut(lens, size)
            base = (np.cumsum(lens) - lens)[text] + start
            order = np.argsort(length, kind="stable")
            runs = np.searchsorted(length[order], np.arange(size + 2))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - runs[length[order]] + seen[length[order]]
            seen += np.diff(runs)
            raw = memoryview(ids).cast("B")
            bodies = [raw[4 * a:4 * b] for a, b in zip(base.tolist(), (base + length).tolist())]
            cols = [batch.column("doc_id").take(pa.array(text)), piece.astype(np.int32), start, length.astype(np.int32),
                    pa.array([zlib.crc32(b) for b in bodies], pa.int64()), np.full(len(text), part, np.int32), nth]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if keep_ids:
                cols, names = [*cols, pa.array([b.tobytes() for b in bodies], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)
    return run


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Written table of the pieces of ``docs`` (doc_id, text): ``PIECES``, with ``keep_ids`` their ids as 32-bit binary.

    ``part`` is the writing task and ``nth`` counts equal lengths within it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(_pieces(tokenizer, end_id, size, keep_ids), PIECES + (", ids binary" if keep_ids else "")), "pieces")


def pack(pieces: DataFrame, size: int = SIZE, broadcast_moves: int = BROADCAST_MOVES) -> DataFrame:
    """``pieces`` (with length, part, nth) with sequence_id and offset instead of part and nth."""
    spark = pieces.sparkSession
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    histogram = parts.groupBy("length").agg(F.sum("n").alias("n")).collect()           # at most ``size`` rows
    moves = best_fit_moves({r.length: r.n for r in histogram}, size)
    places = spark.createDataFrame(moves, MOVES).withColumnRenamed("length", "_length")
    places = F.broadcast(places) if len(moves) <= broadcast_moves else places
    numbered = pieces.join(parts.drop("n").hint("merge"), ["length", "part"]).withColumn("_nth", F.col("nth") + F.col("before"))
    nth = F.col("_nth") - F.col("first")
    here = (F.col("length") == F.col("_length")) & (nth >= 0) & (nth < F.col("items"))
    rest = [c for c in pieces.columns if c not in ("length", "part", "nth")]
    return numbered.join(places, here).select(
        *rest, F.col("length").cast("long").alias("length"),
        (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from packed pieces that keep their ids: a group is one sequence, never more than its size."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Encode, cut and pack ``docs`` (doc_id, text); columns as ``op11_best_fit_packing`` gives, with ids where kept."""
    return pack(token_pieces(docs, tokenizer, size, end_id, keep_ids), size)


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
SQL: dict[str, str] = {}
