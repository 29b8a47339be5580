"""Operator 13: hard negatives by an exact search of an inverted multi-index.

Two codebooks, one for each half of the dimensions, are fitted on a sample of at
most ``SAMPLE`` rows; every row goes to the cell of its two nearest codewords.  A
codeword's radius is its largest distance over all rows, so q.c + |q| r bounds the
half score of whatever lies there, and the sum of two such bounds bounds a cell.
For each anchor cells are visited by falling bound (multi-sequence).  A search has two rounds: the first visits cells
until they hold ``PROBE_ROWS`` rows; the k-th best score found in a window of
scores is then its threshold (its lower end where fewer are found), and the second
round goes on to the first cell whose bound is below every window's threshold.
All rows that could still count have then been scored: results are exact.

Neighbouring cells share a shelf of about ``BLOCK_ROWS`` rows (up to ``SHELF_ROWS``
on large tables); a larger cell is dealt over shelves of its own by a hash.  Anchors
are dealt into groups of about ``GROUP_ANCHORS``, and a shelf is scored against a
group in one task, cell by cell, so neither a crowded cell nor many anchors meet in
one place.  An anchor goes to a shelf once, with the list of its cells there; lists
are made and scores are taken in pieces of bounded size.  The directory (codewords,
radii, rows of each cell) is the only thing that every task gets; it holds at most
MOST_CODES squared numbers.

Defined results: rows with a null id, label, vector or component, or one that is not
finite, take no part; components beyond +-65,536 count as that, and components that
a shorter vector lacks as 0.  Rows that repeat an id are rows of their own but
never partners of an anchor of that id; equal anchor rows are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import staged, table
from kgloom.skew import top_per_group

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90              # per cent of the positive's score
SAMPLE = 8192
CELL_ROWS = 512                 # rows of a cell on average, while codebooks are below their bound
MOST_CODES = 128
BLOCK_ROWS, GROUP_ANCHORS = 1024, 65_536
SHELF_ROWS, SHELVES = 65_536, 256
PIECE_VISITS, PIECE_PAIRS = 8192, 1 << 21      # visits of a batch, scores of a matrix
PROBE_ROWS = 4096
_MOST = 65_536 * SCALE
_FAR = 1 << 62
VECTORS = "part int, nth long, vec_id long, label long, anchor boolean, v binary"
CELLS = VECTORS + ", a int, b int, da double, db double"
VISITS = "vec_id long, same_as long, label long, v binary, windows array<struct<w:int,lo:long,hi:long>>, grp long, shelf long, cells array<int>"
_VISIT = [c.split()[0] for c in VISITS.split(", ")]
FOUND = "vec_id long, same_as long, w int, other long, score long"


def _quantised(scale: int):
    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = np.array(vectors.value_lengths().fill_null(0))
            x = np.array(vectors.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False), float)
            good, row = np.ones(len(batch), bool), np.repeat(np.arange(len(batch)), sizes)
            good[row[~np.isfinite(x)]] = False
            with np.errstate(invalid="ignore", over="ignore"):
                held = np.clip(np.floor(scale * x), -_MOST, _MOST)
            raw, ends = np.where(np.isfinite(held), held, 0).astype("<i4").tobytes(), 4 * np.cumsum(sizes)
            bodies = [raw[b - 4 * n:b] for b, n in zip(ends.tolist(), sizes.tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(done, done + len(batch))),
                 batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array(bodies, pa.binary())],
                names=["part", "nth", "vec_id", "label", "anchor", "v"])
            done += len(batch)
            yield out.filter(pa.array(good))
    return run


def vectors(rows: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """Rows that take part, with whole-number components as 32-bit binary; ``anchor`` marks the anchors."""
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"))
    return named.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(_quantised(scale), VECTORS)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a column of 32-bit binaries as doubles, which hold them exactly; short rows are filled with 0."""
    bodies = column.to_pylist()
    if all(len(b) == 4 * dim for b in bodies):
        return np.frombuffer(b"".join(bodies), "<i4").reshape(len(bodies), dim).astype(float)
    return np.frombuffer(b"".join(b.ljust(4 * dim, b"\0") for b in bodies), "<i4").reshape(len(bodies), dim).astype(float)


def codebook(x: np.ndarray, codes: int, steps: int = 8) -> np.ndarray:
    """Lloyd's steps from evenly spaced rows; at least one codeword, also without rows."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = np.unique(x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)], axis=0)
    for _ in range(steps):
        near = nearest(x, c)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = x[near == k].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


@dataclass
class Directory:
    """Codewords and radii of both halves, and the number of rows of each cell."""

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    block_rows: int
    probe_rows: int

    @property
    def half(self) -> int:
        return self.codes[0].shape[1]

    @property
    def dim(self) -> int:
        return self.half + self.codes[1].shape[1]

    @cached_property
    def shelves(self) -> tuple[np.ndarray, np.ndarray]:
        """For each cell (a * codes + b): its first shelf, and the number of shelves its rows are dealt over."""
        sizes = self.rows.ravel().tolist()
        first, blocks, at, held = [], [], 0, 0
        for n in sizes:
            own = max(1, -(-n // self.block_rows))
            if held and held + n > self.block_rows:
                at, held = at + 1, 0
            first.append(at)
            blocks.append(own)
            at, held = (at + own, 0) if own > 1 else (at, held + n)
        return np.array(first, np.int64), np.array(blocks, np.int64)

    def ranked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper bounds, lower bounds and numbers of all cells with rows, by falling upper bound."""
        up, low = [], []
        for part, c, r in zip((q[:self.half], q[self.half:]), self.codes, self.radii):
            at, reach = c @ part, np.linalg.norm(part) * r
            slack = 1e-9 * (np.abs(at) + reach) + 1e-6         # rounding must not cut a cell
            up.append(at + reach + slack)
            low.append(at - reach - slack)
        upper, lower = (np.add.outer(*x).ravel() for x in (up, low))
        cells = np.flatnonzero(self.rows.ravel())
        cells = cells[np.argsort(-upper[cells], kind="stable")]
        return upper[cells], lower[cells], cells

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, a, b) of all cells with rows, by falling upper bound."""
        upper, lower, cells = self.ranked(q)
        yield from zip(upper.tolist(), lower.tolist(), *(x.tolist() for x in np.unravel_index(cells, self.rows.shape)))

    def visited(self, q: np.ndarray, windows: list[tuple[int, int]], probe: bool) -> np.ndarray:
        """Cells of the first round, or those of the second: until every window is certified."""
        need, high = min((lo for lo, _ in windows), default=_FAR), max((hi for _, hi in windows), default=-_FAR)
        upper, lower, cells = self.ranked(q)
        held = self.rows.ravel()[cells]
        first = np.cumsum(held) - held < self.probe_rows
        return cells[(upper >= need) & (first == probe) & (lower <= high)]

    def visits(self, q: np.ndarray, windows: list[tuple[int, int]], probe: bool) -> Iterator[tuple[int, int]]:
        for cell in self.visited(q, windows, probe).tolist():
            yield divmod(cell, self.rows.shape[1])


def build_index(rows: DataFrame) -> tuple[DataFrame, Directory]:
    """Written table ``CELLS`` of all ``rows`` (of ``vectors``), and the directory."""
    n, size = rows.agg(F.count("*"), F.max(F.length("v"))).first()
    dim = (size or 0) // 4
    mixed = F.xxhash64("vec_id", "v")
    sample = [bytes(r.v) for r in rows.orderBy(mixed, "vec_id").select("v").limit(SAMPLE).collect()]
    x, half = matrix(pa.array(sample, pa.binary()), dim), dim // 2
    k = max(1, min(MOST_CODES, math.ceil(math.sqrt(n / CELL_ROWS))))
    codes = codebook(x[:, :half], k), codebook(x[:, half:], k)

    def assign(batches):
        for batch in batches:
            m = matrix(batch.column("v"), dim)
            cols = []
            for part, c in zip((m[:, :half], m[:, half:]), codes):
                near = nearest(part, c)
                cols += [pa.array(near.astype(np.int32)), pa.array(np.linalg.norm(part - c[near], axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, cols[0], cols[2], cols[1], cols[3]], names=[c.split()[0] for c in CELLS.split(", ")])

    cells = staged(rows.mapInArrow(assign, CELLS), "cells")
    counts, radii = np.zeros((len(codes[0]), len(codes[1])), np.int64), (np.zeros(len(codes[0])), np.zeros(len(codes[1])))
    for r in cells.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("da").alias("da"), F.max("db").alias("db")).collect():
        counts[r.a, r.b] = r.n
        radii[0][r.a], radii[1][r.b] = max(radii[0][r.a], r.da), max(radii[1][r.b], r.db)
    block_rows = max(BLOCK_ROWS, min(SHELF_ROWS, -(-n // SHELVES)))
    return cells, Directory(codes, radii, counts, block_rows, PROBE_ROWS)


def _visits(directory: Directory, probe: bool):
    first, blocks = directory.shelves

    def made(batch, take, shelf, sizes, cells):
        own = batch.take(pa.array(take, pa.int64()))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [*(own.column(c) for c in _VISIT[:6]), pa.array(np.concatenate(shelf), pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells).astype(np.int32)))], names=_VISIT)

    def run(batches):
        for batch in batches:
            q, take, shelf, sizes, cells = matrix(batch.column("v"), directory.dim), [], [], [], []
            for k, windows in enumerate(batch.column("windows").to_pylist()):
                seen = np.sort(directory.visited(q[k], [(w["lo"], w["hi"]) for w in windows], probe))
                many = np.repeat(seen, blocks[seen])
                if not len(many):
                    continue
                nth = np.arange(len(many)) - np.repeat(np.cumsum(blocks[seen]) - blocks[seen], blocks[seen])
                found, n = np.unique(first[many] + nth, return_counts=True)      # rising already: cells of a shelf stay together
                take += [k] * len(found)
                for listed, values in zip((shelf, sizes, cells), (found, n, many)):
                    listed.append(values)
                if len(take) >= PIECE_VISITS:
                    yield made(batch, take, shelf, sizes, cells)
                    take, shelf, sizes, cells = [], [], [], []
            if take:
                yield made(batch, take, shelf, sizes, cells)
    return run


def _windows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, lower and upper ends of each row's windows, side by side; no score lies in a missing one."""
    listed = column.combine_chunks()
    n = np.array(listed.value_lengths())
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out = []
    for values, none in zip(listed.flatten().flatten(), (0, _FAR, -_FAR)):
        filled = np.full((len(n), max(1, n.max(initial=0))), none, np.int64)
        filled[row, at] = np.array(values)
        out.append(filled)
    return tuple(out)


def _firsts(k: int, anchor: np.ndarray, nth: np.ndarray, other: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first ``k`` rows of each anchor's window, by score, then id."""
    order = np.lexsort((other, -score, nth, anchor))
    anchor, nth, other, score = anchor[order], nth[order], other[order], score[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (nth[1:] != nth[:-1])
    begins = np.flatnonzero(new)
    kept = np.arange(len(anchor)) - np.repeat(begins, np.diff(np.append(begins, len(anchor)))) < k
    return anchor[kept], nth[kept], other[kept], score[kept]


def _scored(dim: int, same: bool, k: int):
    names = [c.split()[0] for c in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        left = left.sort_by("cell")
        ids, labels, x = np.array(left["vec_id"]), np.array(left["label"]), matrix(left["v"], dim)
        own, key, label, q = np.array(right["vec_id"]), np.array(right["same_as"]), np.array(right["label"]), matrix(right["v"], dim)
        w, lo, hi = _windows(right["windows"])
        least, most = lo.min(axis=1), hi.max(axis=1)
        exact = dim * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) < 2 ** 53
        if not exact:
            x, q = x.astype(np.int64), q.astype(np.int64)
        asked = right["cells"].combine_chunks()
        asker, asked = np.repeat(np.arange(len(right)), np.array(asked.value_lengths())), np.array(asked.flatten())
        order = np.argsort(asked, kind="stable")
        asker, asked = asker[order], asked[order]
        cells, begins, sizes = np.unique(np.array(left["cell"]), return_index=True, return_counts=True)
        best = tuple(np.zeros(0, np.int64) for _ in range(4))
        pending, held = [], 0
        for cell, begin, size in zip(cells, begins, sizes):
            anchors = asker[np.searchsorted(asked, cell):np.searchsorted(asked, cell, "right")]
            rows, step = slice(begin, begin + size), max(1, PIECE_PAIRS // size)
            for at in range(0, len(anchors), step):
                a = anchors[at:at + step]
                s = (q[a] @ x[rows].T).astype(np.int64, copy=False)
                able = (s >= least[a, None]) & (s <= most[a, None])
                able &= (label[a, None] == labels[None, rows]) == same
                able &= own[a, None] != ids[None, rows]
                i, j = np.nonzero(able)
                anchor, other, score = a[i], ids[rows][j], s[i, j]
                for nth in range(w.shape[1]):
                    inside = (score >= lo[anchor, nth]) & (score <= hi[anchor, nth])
                    found = _firsts(k, anchor[inside], np.full(int(inside.sum()), nth), other[inside], score[inside])
                    pending.append(found)
                    held += len(found[0])
                if held > PIECE_PAIRS:
                    best = _firsts(k, *(np.concatenate(c) for c in zip(best, *pending)))
                    pending, held = [], 0
        anchor, nth, other, score = _firsts(k, *(np.concatenate(c) for c in zip(best, *pending)))
        columns = own[anchor], key[anchor], w[anchor, nth], other, score
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return run


def search(cells: DataFrame, directory: Directory, requests: DataFrame, same: bool, k: int) -> DataFrame:
    """Written table ``FOUND`` plus pos: the first ``k`` rows of each window of scores, exactly.

    ``requests``: anchors (vec_id, same_as, label, v) with their ``windows`` (w, lo, hi).
    ``same`` asks for rows of the anchor's label, else for all others.
    """
    spark = cells.sparkSession
    groups = max(1, -(-requests.count() // GROUP_ANCHORS))
    width = directory.rows.shape[1]
    firsts, dealt = directory.shelves
    sizes = [(a, b, a * width + b, int(firsts[a * width + b]), int(dealt[a * width + b])) for a, b in np.argwhere(directory.rows).tolist()]
    shelves = F.broadcast(spark.createDataFrame(sizes, "a int, b int, cell int, first long, blocks long"))        # a row for each cell
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp")
    rows = cells.join(shelves, ["a", "b"]).select(
        "cell", (F.col("first") + F.pmod(F.xxhash64("part", "nth"), "blocks")).alias("shelf"), spread, "vec_id", "label", "v")
    keys = ["shelf", "grp"]
    asked = requests.withColumn("grp", F.pmod(F.xxhash64("vec_id", "same_as"), F.lit(groups).cast("long")))

    def found(asks: DataFrame, probe: bool) -> DataFrame:
        visits = asks.select(*_VISIT[:6]).mapInArrow(_visits(directory, probe), VISITS)
        out = rows.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_scored(directory.dim, same, k), FOUND)
        return staged(top_per_group(out, ["vec_id", "same_as", "w"], [F.desc("score"), F.asc("other")], k), "found")

    first = found(asked, True)
    best = first.groupBy("vec_id", "same_as", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    best = best.where(F.col("n") >= k).groupBy("vec_id", "same_as").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
    raised = F.transform("windows", lambda w: F.struct(
        w["w"].alias("w"), F.greatest(w["lo"], F.coalesce(F.try_element_at("kth", w["w"]), w["lo"])).alias("lo"), w["hi"].alias("hi")))
    again = asked.join(best, ["vec_id", "same_as"], "left").withColumn("windows", raised).drop("kth")
    both = first.drop("pos").unionByName(found(again, False).drop("pos"))
    return staged(top_per_group(both, ["vec_id", "same_as", "w"], [F.desc("score"), F.asc("other")], k), "found")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, embedding, label).

    For each anchor and each of its first ``positives`` rows of the same label: the
    first ``negatives`` rows of other labels whose score lies within ``low`` and
    ``high`` per cent of the positive's.  A positive below 0 leaves no such score.
    """
    cells, directory = build_index(vectors(rows, anchor, scale))
    anchors = cells.where("anchor").select("vec_id", F.xxhash64("label", "v").alias("same_as"), "label", "v").distinct()
    window = lambda w, lo, hi: F.struct(w.cast("int").alias("w"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    anchors = staged(anchors, "anchors")
    whole = F.array(window(F.lit(0), F.lit(-_FAR), F.lit(_FAR)))
    near = search(cells, directory, anchors.withColumn("windows", whole), True, positives)
    near = near.where("score >= 0").select("vec_id", "same_as", F.col("pos").alias("w"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    lo, hi = F.expr(f"(positive_score * {low} + 99) div 100"), F.expr(f"(positive_score * {high}) div 100")
    asks = near.groupBy("vec_id", "same_as").agg(F.sort_array(F.collect_list(window(F.col("w"), lo, hi))).alias("windows"))
    far = search(cells, directory, anchors.join(asks, ["vec_id", "same_as"]), False, negatives)
    return far.join(near, ["vec_id", "same_as", "w"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("pos").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {"op13_hard_negatives": """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from vectors a join vectors b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, other as positive_id, score as positive_score
  from scored where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
), negatives as (
  select p.anchor_id, p.positive_id, s.other as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as rank
  from positives p join scored s on p.anchor_id = s.anchor_id and not s.same
  where 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negatives where rank <= 10
"""}
