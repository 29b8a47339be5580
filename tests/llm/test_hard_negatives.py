"""Hard negatives against SQL and brute force, and the certified stop."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=10):
    """Every pair scored; rows as (vec_id, vector, label)."""
    good = [(i, [max(-hn._MOST, min(hn._MOST, math.floor(256 * float(np.float32(x))))) for x in v], l) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v, l in good:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in good if j != i)
        same = [(-s, j) for s, j, m in scored if m == l][:positives]
        for p, j in same:
            far = [(-s, k) for s, k, m in scored if m != l and 30 * p <= -100 * s <= 90 * p][:negatives]
            out |= {(i, j, r + 1, k, p, n) for r, (n, k) in enumerate(far)}
    return out


def as_rows(df):
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    """Several cells, blocks, anchor groups and both rounds, on few rows."""
    for name, value in {"CELL_ROWS": 20, "BLOCK_ROWS": 16, "GROUP_ANCHORS": 3, "PROBE_ROWS": 40}.items():
        monkeypatch.setattr(hn, name, value)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    df = hn.op13_hard_negatives(spark, f"/root/testdata/{sf}")
    assert dict(df.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                               "positive_score": "bigint", "negative_score": "bigint"}
    cur = con.execute(hn.SQL["op13_hard_negatives"])
    names = [d[0] for d in cur.description]
    want = {tuple(dict(zip(names, r))[c] for c in df.columns) for r in cur.fetchall()}
    assert {tuple(r) for r in df.collect()} == want and want


@pytest.mark.parametrize("dim", [1, 2, 5, 16])
def test_brute_force(spark, small_blocks, dim):
    rng = random.Random(dim)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for k in range(700):
        c = rng.choice(centres)
        rows.append((k, [round(x + rng.gauss(0, 0.3), 1) for x in c], rng.randrange(3)))
    rows += [(2000 + k, rows[0][1], 1) for k in range(120)]           # a crowd of equal vectors
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert as_rows(hn.hard_negatives(df, F.col("vec_id") % 100 == 0)) == plain(rows)


def test_odd_rows_and_empty_tables(spark, small_blocks):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], k % 3) for k in range(250)]
    rows += [(300, None, 1), (400, [1.0, None, 0.0, 0.0], 1), (500, [1.0, math.nan, 0.0, 0.0], 1), (600, [math.inf, 0.0, 0.0, 0.0], 2),
             (700, [0.5, 0.5, 0.5, 0.5], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (800, [], 1), (900, [1.0, 2.0], 1), (1000, [0.0] * 4, 2),
             (1001, [3e30, -3e30, 1.0, 0.0], 1), (1100, [-1.0, 0.0, 0.0, 0.0], 7), (1101, [1.0, 0.0, 0.0, 0.0], 7), (-100, [1.0, 1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("v", "a", "b", "part", "nth", "windows", "score", "pos", "anchor", "grp"):
        df = df.selectExpr("*", f"'x' as {c}")
    assert as_rows(hn.hard_negatives(df, F.col("vec_id") % 100 == 0)) == plain(rows)
    twice = df.unionAll(df.where("vec_id in (0, 7, 100)"))            # equal rows: one search, more partners
    assert {r[0] for r in as_rows(hn.hard_negatives(twice, F.col("vec_id") % 100 == 0))} == {r[0] for r in plain(rows)}
    assert hn.hard_negatives(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert hn.hard_negatives(df, F.lit(False)).count() == 0


def test_second_round_stops_where_no_cell_can_count():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (8, 12))
    x = np.floor(centres[rng.integers(0, 8, 20_000)] + rng.normal(0, 3, (20_000, 12)))
    codes = hn.codebook(x[:4000, :6], 8), hn.codebook(x[:4000, 6:], 8)
    near = [hn.nearest(p, c) for p, c in zip((x[:, :6], x[:, 6:]), codes)]
    rows, radii = np.zeros((8, 8), int), []
    np.add.at(rows, tuple(near), 1)
    for p, c, n in zip((x[:, :6], x[:, 6:]), codes, near):
        dist = np.linalg.norm(p - c[n], axis=1)
        radii.append(np.array([dist[n == k].max(initial=0) for k in range(8)]))
    directory = hn.Directory(codes, tuple(radii), rows, hn.BLOCK_ROWS, 200)
    q = x[0]
    scores = x @ q
    bounds = [u for u, *_ in directory.walk(q)]
    assert bounds == sorted(bounds, reverse=True) and len(bounds) == np.count_nonzero(rows)
    for upper, lower, a, b in directory.walk(q):
        inside = scores[(near[0] == a) & (near[1] == b)]
        assert lower <= inside.min() and inside.max() <= upper
    first = list(directory.visits(q, [(-hn._FAR, hn._FAR)], True))
    seen = np.zeros(len(x), bool)
    for a, b in first:
        seen |= (near[0] == a) & (near[1] == b)
    need = int(np.sort(scores[seen])[-5])
    later = list(directory.visits(q, [(need, hn._FAR)], False))
    assert not set(first) & set(later) and len(first) + len(later) < np.count_nonzero(rows) - 5
    for a, b in later:
        seen |= (near[0] == a) & (near[1] == b)
    assert scores[~seen].max() < np.sort(scores)[-5]


def test_visits_come_in_pieces_and_once_a_shelf():
    """Many anchors times many cells are never one batch, and a vector is sent once to the cells of a shelf."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 100, (600, 8)))
    codes = hn.codebook(x[:, :4], 32), hn.codebook(x[:, 4:], 32)
    held = np.full((len(codes[0]), len(codes[1])), 100)
    held[3, 3], held[0, 1] = 2500, 0
    directory = hn.Directory(codes, (np.full(len(codes[0]), 1e4), np.full(len(codes[1]), 1e4)), held, 1000, 0)
    whole = pa.array([[{"w": 0, "lo": -hn._FAR, "hi": hn._FAR}]] * len(x), pa.list_(pa.struct([("w", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])))
    n = pa.array(range(len(x)), pa.int64())
    batch = pa.RecordBatch.from_arrays(
        [n, n, n, pa.array([v.astype("<i4").tobytes() for v in x], pa.binary()), whole, n], names=["vec_id", "same_as", "label", "v", "windows", "grp"])
    pieces = list(hn._visits(directory, False)([batch]))
    rows = [r for p in pieces for r in zip(p.column("vec_id").to_pylist(), p.column("shelf").to_pylist(), p.column("cells").to_pylist())]
    assert max(p.num_rows for p in pieces) < 2 * hn.PIECE_VISITS and len(pieces) > 1
    assert len(rows) == len({r[:2] for r in rows}) < len(x) * np.count_nonzero(held) / 8
    crowd = 3 * held.shape[1] + 3
    sent = [(i, c) for i, _, cells in rows for c in cells]
    assert sorted(set(sent)) == [(i, c) for i in range(len(x)) for c in np.flatnonzero(held.ravel()).tolist()]
    assert len(sent) == len(set(sent)) + 2 * len(x) and sum(c == crowd for _, c in sent) == 3 * len(x)
