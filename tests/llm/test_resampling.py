"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from kgloom.llm import importance_resampling as resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[k:k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain(docs, items):
    """(doc_id, n_features, weight, score, rank) of each document, the direct way."""
    own = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, g in own for b in g), Counter(b for _, x in items for b in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, n, g in own:
        weight = sum(gain(b) for b in g)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def as_rows(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_by_brute_force(spark, sf):
    df = resampling.op12_importance_resampling(spark, sf)
    assert [t for _, t in df.dtypes] == ["bigint"] * 5
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    want = plain(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert as_rows(df) == want and any(r[4] for r in want)


def test_odd_rows_ties_and_empty_tables(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice(["Aa", "b", "É", "漢字", "9", "x_y", "z"]) + rng.choice([" ", ", ", "\n", "\x00"]) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    docs += [(500, None), (501, ""), (502, " .,- "), (None, "b " * 30), (503, "b " * 30_000), (504, "same " * 25), (504, "same " * 25)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for c in ("id", "rid", "n_words", "score", "rank", "part", "nth", "buckets"):
        df = df.selectExpr("*", f"'x' as {c}")
    items = spark.createDataFrame([(1, "b É b É 9"), (2, None), (3, "")], "item_id long, text string")
    out = resampling.resampling_scores(df, items).selectExpr("id as doc_id", "n_features", "weight", "score", "rank")
    assert as_rows(out) == plain(docs, [(1, "b É b É 9")])
    kept = resampling.resample(df, items)
    assert kept.columns == df.columns and kept.count() >= out.where("rank is not null").count() > 10
    assert as_rows(resampling.resampling_scores(df, items.where("false")).selectExpr(
        "id as doc_id", "n_features", "weight", "score", "rank")) == plain(docs, [])
    assert resampling.resampling_scores(df.where("false"), items).count() == 0


def test_draw_of_equal_scores(spark):
    rows = [(k, k, 30, 1, 0, 7 if k % 3 else 9) for k in range(1000, 0, -1)]
    drawn = resampling.draw(spark.createDataFrame(rows, resampling.SCORES).repartition(7))
    got = {r["rank"]: r.id for r in drawn.where("rank is not null").collect()}
    assert got == {k + 1: 3 * (k + 1) for k in range(50)} and drawn.count() == 1000
    wide = resampling.draw(spark.createDataFrame(rows, resampling.SCORES), percent=100)
    assert {r["rank"] for r in wide.collect()} == set(range(1, 1001))


def test_spans():
    for n in (1, 2, 3, 4):
        words, crcs = resampling.span_crcs("The  cat-sat,\non 2 mats", resampling.ngram_pattern(n))
        w = "the cat sat on 2 mats".split()
        assert words == 6 and sorted(crcs) == sorted(zlib.crc32(" ".join(w[k:k + m]).encode()) for m in range(1, n + 1) for k in range(7 - m))
