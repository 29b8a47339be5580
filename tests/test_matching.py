"""Answer links against every pair."""

import random
from collections import Counter

import pytest

from kgloom.reports.matching import answer_links

SIDE = "id string, key string, name string"


def plain(text):
    kept = "".join(c for c in text.lower() if c not in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return " ".join(w for w in kept.split() if w not in ("a", "an", "the"))


@pytest.mark.parametrize("part_rows", [3, 10_000])
def test_links_equal_all_pairs(spark, part_rows):
    rng, signs = random.Random(4), ["Ab", "b", "the", "ab.", " ", "é", "x y", "!", ""]
    make = lambda n: [(rng.choice("pqr"), f"k{rng.randrange(40)}", "".join(rng.choice(signs) for _ in range(rng.randint(0, n)))) for _ in range(60)]
    said, gold = make(9) + [("only", "k", "x"), ("p", "null", None)], make(3) + [("other", "k", "x"), ("q", "null", None)]
    want = Counter({(i, g, k): 0 for g, rows in ((False, said), (True, gold)) for i, k, _ in rows})
    for i, k, text in said:
        for j, m, name in gold:
            if i == j and text is not None and name is not None and plain(name) in plain(text):
                want[(i, False, k)] += 1
                want[(i, True, m)] += 1
    got = answer_links(spark.createDataFrame(said, SIDE), spark.createDataFrame(gold, SIDE), part_rows)
    assert {(r.id, r.is_gold, r.key): r.n_links for r in got.collect()} == dict(want)
    assert answer_links(spark.createDataFrame([], SIDE), spark.createDataFrame(gold, SIDE)).where("n_links > 0").count() == 0


def test_short_lists_share_a_call(spark, monkeypatch):
    """Many questions are one group; all of them, and a long list among them, keep their links."""
    from kgloom.reports import matching

    sizes = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)
    linked = matching._linked

    def counted(left, right):
        calls.add(1)
        sizes.add(len(left))
        return linked(left, right)

    monkeypatch.setattr(matching, "_linked", counted)
    ids = [(f"q{k}", "k", f"name {k}") for k in range(3000)]
    long = [("long", f"k{k}", f"item {k:03d}") for k in range(90)]
    got = answer_links(spark.createDataFrame(ids + long, SIDE), spark.createDataFrame(ids + long, SIDE), 2000)
    rows = got.collect()
    assert len(rows) == 2 * 3090 and {r.n_links for r in rows} == {1}
    assert sizes.value == 3090 and calls.value <= 8
