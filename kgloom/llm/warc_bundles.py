"""Operator 9: WARC records in seekable Zstandard bundles.

Payloads are compared by SHA-256 and length.  In each group of equal payloads
the record with the largest id is the response; all others are revisits that
refer to it and carry no payload.  Only (id, digest) meets by digest, so a large
group of copies moves no payloads; payloads meet their decision once, by id.

A task writes one bundle: records in frames of about ``FRAME_BYTES``, closed by a
seek table.  The returned index maps each record id to (path, frame, offset in
the frame); it is written through Spark, so bundles of lost attempts are not read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import staged, table, workspace
from kgloom.llm.seekable import Reader, Writer, attempt_name

MIN_REVISIT_BYTES = 0
FRAME_BYTES = 1 << 18
DATE = "1970-01-01T00:00:00Z"      # the tables have no capture time
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"   # fixed by the WARC standard
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _name(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    text = name[len("<urn:page:"):-1]
    return None if text == "none" else int(text)


def record(page_id, url, payload: bytes, response: bool, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if response:
        head.append("Content-Type: application/http; msgtype=response")
        block = _HTTP % len(payload) + payload
    else:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
        block = b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(frame: bytes, at: int = 0):
    """(offset, headers, payload) of the records of a frame from offset ``at`` on."""
    while at < len(frame):
        body = frame.index(b"\r\n\r\n", at) + 4
        lines = frame[at:body - 4].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = body + int(headers["Content-Length"])
        start = frame.index(b"\r\n\r\n", body) + 4 if headers["WARC-Type"] == "response" else end
        yield at, headers, frame[start:end]
        at = end + 4


def _write(folder: str):
    def run(batches):
        writer, held, rows = None, bytearray(), []
        for batch in batches:
            payloads = batch.column("html").cast(pa.binary())
            for i in range(batch.num_rows):
                page, refers = batch.column("page_id")[i].as_py(), batch.column("refers_to")[i].as_py()
                response = batch.column("response")[i].as_py()
                if writer is None:
                    writer = Writer(folder, attempt_name(TaskContext.get().partitionId(), ".warc.zst"))
                    frame = 0
                rows.append((page, frame, len(held)))
                held += record(page, batch.column("url")[i].as_py(), payloads[i].as_py() or b"", response, refers)
                if len(held) >= FRAME_BYTES:
                    writer.frame(bytes(held))
                    held, frame = bytearray(), frame + 1
        if writer is not None:
            if held:
                writer.frame(bytes(held))
            writer.close()
            page, frame, offset = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(page, pa.int64()), pa.array([writer.path] * len(rows)), pa.array(frame, pa.int64()),
                 pa.array(offset, pa.int64())], names=["page_id", "path", "frame", "offset"])
    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to bundles in ``folder``; returns the record index.

    Null html is an empty payload, a null url gives no target.  Rows that repeat
    an id and a payload are written each and of the same type.  A null id is
    smaller than any other.  Payloads below ``min_bytes`` are never revisited.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    keys = rows.select("page_id", "digest", "size").distinct()
    top = keys.groupBy("digest", "size").agg(F.max("page_id").alias("top"))
    decided = keys.join(top, ["digest", "size"]).select(
        "page_id", "digest",
        (F.col("page_id").eqNullSafe(F.col("top")) | (F.col("size") < min_bytes)).alias("response"), "top")
    d = decided.withColumnsRenamed({"page_id": "_p", "digest": "_d"})
    rows = rows.join(d, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d"))).select(
        "page_id", "url", "html", "response", F.when(~F.col("response"), F.col("top")).alias("refers_to"))
    return staged(rows.mapInArrow(_write(folder), "page_id long, path string, frame long, offset long"), "warc_index")


def fetch(path: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """Headers and payload of one record; opens a single frame."""
    with Reader(path) as reader:
        _, headers, payload = next(records(reader.frame(frame), offset))
    return headers, payload


def _read(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with Reader(path) as reader:
                for k in range(len(reader.table)):
                    out = []
                    for _, h, payload in records(reader.frame(k)):
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and (
                                base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
                                or len(payload) != int(h["X-Payload-Length"])):
                            raise ValueError(f"{path}: damaged payload of {h['WARC-Record-ID']}")
                        refers = h.get("WARC-Refers-To")
                        out.append((_id(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), digest, h["WARC-Type"],
                                    refers and _id(refers)))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_warc(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, digests checked."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # tasks, of a file or some files each
    return index.select("path").distinct().repartition(parts, "path").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc_bundles(spark, sf_dir: str) -> DataFrame:
    folder = f"{workspace(spark)}/warc-{attempt_name(0, '')}"
    return read_warc(write_warc(table(spark, sf_dir, "pages"), folder))


QUERIES = {"op9_warc_bundles": op9_warc_bundles}
SQL = {"op9_warc_bundles": """
with p as (select page_id, coalesce(html, '') as h from pages),
t as (select *, max(page_id) over (partition by h) as top, sha1(h) as x from p),
b as (
  select *, list_transform(string_split_regex(x, ''), lambda c: [
    '0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'
    ][strpos('0123456789abcdef', c)]) as bits from t)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + list_sum(list_transform(range(5), lambda j: (substr(array_to_string(bits, ''), 5 * k + j + 1, 1) = '1')::int
      * (16 >> j::int))))::bigint, 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from b"""}
