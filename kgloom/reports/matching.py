"""Which gold answers occur in which predictions, without a row for each pair.

All gold names of a question form one automaton, and each prediction runs through
it once, so work grows with the texts and the matches.  Long lists are dealt over
parts of bounded size: a group holds one part of a question's gold names and one
part of its predictions.  Questions are dealt to buckets of about as many rows, and
a bucket's first parts are one group, so short lists do not cost a call each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.reports.evaluate import normalize_answer

PART_ROWS = 20_000      # gold names, or predictions, of a question in one group; rows of a bucket, about
FEW_PAIRS = 1000        # pairs of a question that are compared one by one
LINKS = "id string, is_gold boolean, key string, n_links long"


def _by_id(ids: list[str]) -> dict[str, list[int]]:
    rows: dict[str, list[int]] = {}
    for at, name in enumerate(ids):
        rows.setdefault(name, []).append(at)
    return rows


def _count(said: list[str], gold: list[str], texts: list[int], names: list[int], hits: list[int], of_gold: list[int]) -> None:
    """Adds the links of one question's rows, ``texts`` of said and ``names`` of gold."""
    import ahocorasick

    if len(texts) * len(names) <= FEW_PAIRS:
        for at in texts:
            text = said[at]
            for k in names:
                if gold[k] in text:
                    hits[at] += 1
                    of_gold[k] += 1
        return
    places: dict[str, list[int]] = {}
    for k in names:
        places.setdefault(gold[k], []).append(k)
    machine = ahocorasick.Automaton()
    for name in places:
        if name:
            machine.add_word(name, name)
    if len(machine):
        machine.make_automaton()
    found_in: dict[str, int] = {}
    for at in texts:
        found = {name for _, name in machine.iter(said[at])} if len(machine) else set()
        if "" in places:                                # an empty name is part of any text
            found.add("")
        for name in found:
            hits[at] += len(places[name])
            found_in[name] = found_in.get(name, 0) + 1
    for name, n in found_in.items():
        for k in places[name]:
            of_gold[k] += n


def _linked(left: pa.Table, right: pa.Table) -> pa.Table:
    said, gold = left["said"].to_pylist(), right["said"].to_pylist()
    hits, of_gold = [0] * len(said), [0] * len(gold)
    texts = _by_id(left["id"].to_pylist())
    for name, rows in _by_id(right["id"].to_pylist()).items():
        if name in texts:
            _count(said, gold, texts[name], rows, hits, of_gold)
    return pa.Table.from_arrays(
        [pa.chunked_array([*left["id"].chunks, *right["id"].chunks], pa.string()), pa.array([False] * len(said) + [True] * len(gold)),
         pa.chunked_array([*left["key"].chunks, *right["key"].chunks], pa.string()), pa.array(hits + of_gold, pa.int64())],
        names=["id", "is_gold", "key", "n_links"])


def answer_links(predictions: DataFrame, gold: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``LINKS`` of both sides, each (id, key, name): how many gold names a prediction holds, and the reverse.

    Names are compared normalized.  A side without a partner of its id has 0 links;
    null names hold nothing and occur nowhere.  Rows with equal id and key are added up.
    """
    def side(df: DataFrame) -> DataFrame:
        return df.select("id", "key", normalize_answer(F.col("name")).alias("said"))

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias(name))

    mine, theirs = side(predictions), side(gold)
    parts = sizes(mine, "p").join(sizes(theirs, "g"), "id")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = mine.where("said is not null").join(parts, "id").withColumn("a", F.pmod(F.xxhash64("key", "said"), "p").cast("int")).withColumn("b", numbers("g"))
    right = theirs.where("said is not null").join(parts, "id").withColumn("b", F.pmod(F.xxhash64("key", "said"), "g").cast("int")).withColumn("a", numbers("p"))
    buckets = max(1, (mine.count() + theirs.count()) // part_rows)
    keys = ["bucket", "a", "b"]
    dealt = lambda df: df.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "a", "b", "id", "key", "said").groupBy(*keys)
    found = dealt(left).cogroup(dealt(right)).applyInArrow(_linked, LINKS)
    none = mine.select("id", F.lit(False).alias("is_gold"), "key").unionByName(theirs.select("id", F.lit(True).alias("is_gold"), "key"))
    return found.unionByName(none.withColumn("n_links", F.lit(0).cast("long"))).groupBy("id", "is_gold", "key").agg(F.sum("n_links").alias("n_links"))
