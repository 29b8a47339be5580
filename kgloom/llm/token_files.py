"""Operator 2: token ids in seekable Zstandard files.

Documents are range-partitioned by id, so files hold consecutive id ranges and
the ids of all files in order are the corpus.  Each task encodes its documents
and writes one file: frames of about ``FRAME_TOKENS`` ids (unsigned 32-bit,
little-endian; a longer document spans frames of at most ``MOST_TOKENS``), a document index (ids and lengths) and the
seek table.  What a job returns is the table of committed files, written through
Spark, so files of lost attempts are never read.

Encoding is that of ``batch_bpe``: a batch's distinct words are encoded once.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.llm.batch_bpe import batch_encoder
from kgloom.llm.common import staged, table, workspace
from kgloom.llm.seekable import Reader, Writer, attempt_name

END_ID = 2
FRAME_TOKENS = 65_536
MOST_TOKENS = 1 << 20


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        encoder = batch_encoder(tokenizer, end_id)
        writer, ids, valid, counts, held = None, [], [], [], bytearray()
        for batch in batches:
            if writer is None and len(batch):
                part = TaskContext.get().partitionId()
                writer = Writer(folder, attempt_name(part, ".tok.zst"), level=1)
            doc_ids = batch.column("doc_id").to_pylist()
            ids += [doc or 0 for doc in doc_ids]
            valid += [doc is not None for doc in doc_ids]
            tokens, lens = encoder.encode(batch.column("text"))
            counts += lens.tolist()
            body, ends = memoryview(tokens).cast("B"), 4 * np.cumsum(lens)
            at = 0
            while at < len(body):
                # whole documents up to FRAME_TOKENS, or MOST_TOKENS of a longer one
                k = int(np.searchsorted(ends, at + 4 * FRAME_TOKENS - len(held)))
                end = int(ends[k]) if k < len(ends) else len(body)
                end = min(end, at + 4 * MOST_TOKENS - len(held))
                held += body[at:end]
                at = end
                if len(held) >= 4 * FRAME_TOKENS:
                    writer.frame(bytes(held))
                    held = bytearray()
        if writer is not None:
            if held:
                writer.frame(bytes(held))
            writer.close(np.array([ids, valid, counts], "<i8").tobytes())
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [writer.path], "n_docs": [len(ids)], "n_tokens": [sum(counts)]})
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder``; returns the table of files in corpus order.

    Columns: part, path, n_docs, n_tokens, start (ids in earlier files).  Null
    text is empty and gives the end id alone; null ids come first.  Repeated ids
    are written each, in the order of their texts' hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rid"))
    rows = rows.repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    files = staged(rows.mapInArrow(
        _write(folder, tokenizer, end_id), "part long, path string, n_docs long, n_tokens long"), "token_files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def documents_of(reader: Reader):
    """(doc_id or None, first token in the file, number of tokens) of each document."""
    ids, valid, counts = np.frombuffer(reader.index, "<i8").reshape(3, -1)
    first = np.cumsum(counts) - counts
    return [(int(i) if v else None, int(f), int(c)) for i, v, f, c in zip(ids, valid, first, counts)]


def tokens_at(reader: Reader, first: int, count: int) -> np.ndarray:
    """Ids [first, first+count) of the file; opens only the frames that hold them."""
    ends = np.cumsum([plain for _, plain, _ in reader.table]) // 4
    lo, hi = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, first + count - 1, "right"))
    body = b"".join(reader.frame(k) for k in range(lo, hi + 1))
    skip = first - (int(ends[lo - 1]) if lo else 0)
    return np.frombuffer(body, "<u4")[skip:skip + count]


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            with Reader(path) as reader:
                frames = (memoryview(reader.frame(k)) for k in range(len(reader.table)))
                have, out = memoryview(b""), []
                for doc, first, count in documents_of(reader):
                    need, crc = 4 * count, 0
                    while need:
                        if not len(have):
                            have = next(frames)
                        part, have = have[:need], have[need:]
                        crc, need = zlib.crc32(part, crc), need - len(part)
                    out.append((doc, start + first, count, crc))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``files``, all frames checked."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # tasks, of a file or some files each
    return files.select("path", "start").repartition(parts, "path").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{workspace(spark)}/tokens-{attempt_name(0, '')}"
    return read_tokens(write_tokens(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op2_token_files": op2_token_files}
SQL: dict[str, str] = {}
