"""Operator 12: documents drawn so that their n-grams look like those of a target set.

Separators collapse to single blanks; one overlapped regex scan then stands at
each word (a lookbehind keeps it at word starts) and its lookahead captures the
word and those after it, so every match emits the spans of all n-grams that begin
there.  A span's CRC goes on from the shorter one's.  A task turns a text into
bucket numbers once; they are written beside the document and serve the counts
over all documents and then the weights.  What reaches every task is the table of
gains, one number a bucket.  The draw adds Gumbel noise seeded by the document's
id and takes the highest scores: an approximate quantile, checked by an exact
count, leaves little more than the drawn rows to be sorted by range and numbered.

Defined results: null or empty text has no words, weight 0 and no rank; a null id
takes the noise of the empty id and stands last among ties; rows that repeat an
id share its noise and are drawn each by their own score; an empty table gives no
rows, an empty target set counts nothing.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import keyed, staged, table

NGRAMS = 3
BUCKETS = 10_000
SEED = 42
PERCENT = 5
MIN_WORDS = 20
MARGIN = 0.01            # share of the rows kept beyond the draw before it is counted exactly
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))
FEATURES = "id long, rid long, n_words long, n_features long, buckets binary"
SCORES = "id long, rid long, n_words long, n_features long, weight long, score long"


def ngram_pattern(n: int) -> regex.Pattern:
    """Stands at each word of blank-separated bytes; its groups are the word and up to n-1 more, each with its blank."""
    return regex.compile(rb"(?<![^ ])(?=([^ ]++)" + rb"( [^ ]++)?+" * (n - 1) + rb"(?![^ ]))")


def span_crcs(text: str, pattern: regex.Pattern) -> tuple[int, array]:
    """(number of words, CRCs of all n-grams)."""
    folded = b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())
    n, out, crc32 = 0, array("I"), zlib.crc32
    for m in pattern.finditer(folded, overlapped=True):
        n, crc = n + 1, 0
        for part in m.groups():
            if part is None:
                break
            crc = crc32(part, crc)
            out.append(crc)
    return n, out


def _features(ngrams: int, buckets: int):
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        pattern = ngram_pattern(ngrams)
        for batch in batches:
            words, sizes, held = [], [], []
            for text in batch.column("text"):
                n, crcs = span_crcs(text.as_py() or "", pattern)
                words.append(n)
                sizes.append(len(crcs))
                held.append((np.frombuffer(crcs, "u4") % buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())],
                names=["id", "rid", "n_words", "n_features", "buckets"])
    return run


def features(docs: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, id_col: str = "doc_id") -> DataFrame:
    """Written table of each row's bucket numbers, as little-endian integers in text order."""
    return staged(keyed(docs, id_col).mapInArrow(_features(ngrams, buckets), FEATURES), "features")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(feats: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Occurrences of each bucket over all rows: summed in the tasks, then by bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_py(), _kind(buckets)), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])
    parts = feats.select("buckets").mapInArrow(run, "bucket long, n long")
    return {r.bucket: r.n for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}     # ``buckets`` rows


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of target share over source share, both with one added to each bucket."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(k, 0) + 1.0) * s_all / ((source.get(k, 0) + 1.0) * t_all)))
                     for k in range(buckets)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, the same wherever and whenever it is drawn."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(feats: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """Written table of weight and score of each row of ``feats``."""
    def run(batches):
        for batch in batches:
            weights = [int(gain[np.frombuffer(b.as_py(), _kind(len(gain)))].sum()) for b in batch.column("buckets")]
            drawn = [w + noise(i, seed) for w, i in zip(weights, batch.column("id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "rid", "n_words", "n_features")),
                                              pa.array(weights, pa.int64()), pa.array(drawn, pa.int64())],
                                             names=[c.split()[0] for c in SCORES.split(", ")])
    return staged(feats.mapInArrow(run, SCORES), "scores")


def _numbered(batches):
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(range(done + 1, done + len(batch) + 1), pa.int64())],
            names=[*batch.schema.names, "part", "nth"])
        done += len(batch)


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with rank: 1, 2, 3 ... of the drawn rows by falling score (ties: smaller id), null for the others."""
    able = scored.where(F.col("n_words") >= min_words)
    share = max(0.0, 1 - percent / 100 - MARGIN)
    n, cut = able.agg(F.count("*"), F.percentile_approx("score", share, 1000)).first()
    wanted = percent * n // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    if able.where(F.col("score") >= cut).count() < wanted:
        cut = able.agg(F.min("score")).first()[0]
    high = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")]
    top = scored.where(high).repartitionByRange(*order).sortWithinPartitions(*order)
    top = staged(top.mapInArrow(_numbered, SCORES + ", part int, nth long"), "drawn")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)           # a row for each range
    parts = top.groupBy("part").agg(F.max("nth").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    rank = F.col("nth") + F.col("ahead")
    ranked = top.join(parts.drop("m"), "part").select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return scored.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resampling_scores(docs: DataFrame, target: DataFrame, target_id: str = "item_id", ngrams: int = NGRAMS,
                      buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """id, rid, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text)."""
    feats = features(docs, ngrams, buckets)
    gain = gains(bucket_counts(feats, buckets), bucket_counts(features(target, ngrams, buckets, target_id), buckets), buckets)
    return draw(scores(feats, gain, seed), percent, min_words)


def resample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows equal in id and text are drawn together."""
    drawn = resampling_scores(docs, target, **parameters).where("rank is not null").select("id", "rid").distinct()
    named = drawn.select(F.col("id").alias("_q_id"), F.col("rid").alias("_q_rid"))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("_q_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_q_rid"))
    return docs.join(named, mine, "left_semi")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resampling_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
SQL: dict[str, str] = {}
