"""Group-wise building blocks that stay balanced when one key is very hot.

* ``top_per_group``   row_number with a literal bound: Spark keeps at most k rows
  per group and task before the shuffle (WindowGroupLimit).
* ``first_per_group`` / plain aggregates: combined before the shuffle.
* ``attach_stats``    gives each row a figure of its group.  Hot groups take it
  from a broadcast of bounded size, all others from a shuffle join, so no task
  receives a whole hot group.
* ``block_rank``      exact 1..n positions in groups of any size, ranked block
  by block with block offsets added.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000   # a group above this many rows is treated as hot
MAX_HOT = 10_000       # most hot groups that are broadcast; others shuffle
SALTS = 1024
CODEC = "zstd"         # of written intermediate tables
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GROUP_LIMIT = 1000     # spark.sql.optimizer.windowGroupLimitThreshold


def workspace(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = os.path.join(workspace(spark), "kgloom", app, f"{name}-{uuid.uuid4().hex}")
    for made in _records:
        made.append(path)
    with cleaned_shuffles(spark):
        df.write.option("compression", CODEC).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


@contextlib.contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Shuffle files of a write in the block go when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` wrote, once nothing that reads them is left to run."""
    for table in tables:
        remove_tables(table.sparkSession, [table._staged_at])


_records: list[list[str]] = []


@contextlib.contextmanager
def recorded_tables(made: list[str]):
    """The folders of tables that ``staged`` writes inside the block are added to ``made``."""
    _records.append(made)
    try:
        yield made
    finally:
        _records.remove(made)


def remove_tables(spark: SparkSession, made: list[str]) -> None:
    """Delete recorded tables, wherever they lie, once nothing that reads them is left to run."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  k: int, pos: str = "pos") -> DataFrame:
    """First ``k`` rows of each group, with their 1-based position."""
    ranked = df.withColumn(pos, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if k <= GROUP_LIMIT:
        return ranked.where(F.col(pos) <= k)
    # Above the engine's own bound: cut each salted part first, then the whole.
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    part = (
        df.withColumn("_salt", salt)
        .withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
        .where(F.col("_p") <= k).drop("_salt", "_p")
    )
    return part.withColumn(
        pos, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).where(F.col(pos) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group; combined map-side, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], size: str,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of per-group ``stats`` (one row per key) that tolerates hot keys.

    ``size`` is the stats column holding the group's row count.  At most
    ``MAX_HOT`` groups above ``hot_rows`` rows are broadcast; rows of those
    groups are spread over salts for the remaining join, where they find no
    partner and need none.
    """
    keys = list(keys)
    values = [c for c in stats.columns if c not in keys]
    hot = (
        stats.where(F.col(size) > hot_rows).orderBy(F.desc(size), *keys).limit(MAX_HOT)
        .select(*keys, F.struct(*values).alias("_hot"))
    )
    cold = stats.select(*keys, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    salted = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNull(), F.lit(0).cast("long"))
        .otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)) + 1),
    )
    out = salted.join(cold, keys + ["_salt"], "left")
    merged = [
        F.when(F.col("_hot").isNotNull(), F.col(f"_hot.{v}")).otherwise(F.col(f"_cold.{v}")).alias(v)
        for v in values
    ]
    return out.select(*df.columns, *merged)


def block_rank(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column],
               pos: str = "pos") -> DataFrame:
    """Exact position in the group's order, without one task per group.

    ``block`` must be an order-consistent prefix of ``order``: equal blocks are
    contiguous and blocks compare like their rows.
    """
    keys = list(keys)
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = rows.withColumn("_l", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    return (
        local.join(offsets, keys + ["_block"])
        .withColumn(pos, (F.col("_l") + F.col("_off")).cast("int"))
        .drop("_l", "_off", "_block")
    )
