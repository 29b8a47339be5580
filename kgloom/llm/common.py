"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.skew import staged, workspace  # noqa: F401  (re-exported: tables in the shared folder)

SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, text) of a table with any further columns.

    ``rid`` is a hash of the text: rows that repeat an id with another text stay
    apart in later joins on (id, rid), and equal rows share one result.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rid"),
        F.col(text_col).alias("text"),
    )


def native_words(text):
    """Array of the words [^x20 x09-x0D]+ of a text column; empty for null.

    Texts with no white space but blanks and line ends take a faster split.
    """
    whole = F.coalesce(text, F.lit(""))
    plain = F.replace(whole, F.lit("\n"), F.lit(" "))
    other = [F.contains(whole, F.lit(c)) for c in "\t\x0b\f\r"]
    parts = F.when(other[0] | other[1] | other[2] | other[3], F.split(whole, SPACES)).otherwise(F.split(plain, " "))
    return F.array_remove(parts, "")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text):
    """A-Z to lower case, all else unchanged.

    ``lower`` also changes other alphabets; where that shows in the part outside
    ASCII, the slower character map is used.
    """
    outside = lambda c: F.regexp_replace(c, r"[\x00-\x7F]+", "")
    return F.when(outside(F.lower(text)) == outside(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
