"""One order of 64-bit names from rare to frequent, for prefix-filtered joins.

Names fall into 2**CLASS_BITS classes by their hash; a class's count over the
whole input ranks its names (ties: by the name).  The ranks are one byte for each
class, 1 MB in all whatever the input, and reach the tasks as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import staged

CLASS_BITS = 20


def _class(name: Column) -> Column:
    return F.pmod(name, F.lit(1 << CLASS_BITS)).cast("int")


def levels(names: DataFrame) -> Column:
    """Scalar column: the rank of each class, from the column ``name`` of ``names``."""
    spark = names.sparkSession
    counts = names.groupBy(_class(F.col("name")).alias("k")).agg(F.count("*").alias("c"))
    level = F.least(F.lit(100), F.floor(4 * F.log2(F.col("c") + 1))).cast("tinyint")
    counts = staged(counts.select("k", level.alias("level")), "name_classes")
    every = spark.range(1 << CLASS_BITS).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("tinyint").alias("level"))
    full = every.unionByName(counts).groupBy("k").agg(F.max("level").alias("level"))
    packed = F.sort_array(F.collect_list(F.struct("k", "level")))          # of fixed size
    return full.agg(F.transform(packed, lambda x: x["level"]).alias("levels")).scalar()


def rare_first(df: DataFrame, names: str, ranks: Column) -> DataFrame:
    """``df`` with the array ``names`` turned into tokens in rising order, rare ones first.

    A token keeps 56 bits of its name below the rank.
    """
    rest = [c for c in df.columns if c != names]
    ranked = df.withColumn("_levels", ranks)       # one step for Spark: rows do not hold the ranks
    token = F.transform(F.array("_levels"), lambda f: F.sort_array(F.transform(names, lambda h: (
        F.shiftleft(F.get(f, _class(h)).cast("long"), 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1))))))
    return ranked.select(*rest, F.get(token, F.lit(0)).alias(names)).select(*df.columns)


def prefix_size(n: Column, percent: int, shared: int) -> Column:
    """Sets of similarity ``percent`` share ``shared`` of their first so many tokens (if they overlap in that many)."""
    return F.least(n, n - F.ceil(percent * n / F.lit(100.0) - 1e-9).cast("int") + shared)


def possible(nx: Column, ax: Column, ny: Column, ay: Column, percent: int) -> Column:
    """Length and positional bounds for sets of nx and ny tokens that share those at ax and ay."""
    need = F.ceil(percent * (nx + ny) / F.lit(100.0 + percent) - 1e-9)
    most = F.least(nx - ax, ny - ay) + F.least(ax, ay)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (most >= need)
