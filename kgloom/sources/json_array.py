"""One large JSON array read by many tasks.

The file is cut at every closing brace, which Spark's text reader does by byte
ranges.  A piece changes two things: whether what follows stands inside a string,
and how deep it is nested; both are worked out for either way it may begin.  Sums
over a range's pieces, then over the ranges of a file, give every piece its true
beginning, and with it the places where an item of the array ends.  Pieces of an
item, which may lie in two ranges, are put together and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.skew import staged


def _net(parts: Column, inside: int) -> Column:
    """Brackets opened less those closed in the parts that stand outside strings."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == inside), "")
    return F.length(F.regexp_replace(text, r"[^{\[]", "")) - F.length(F.regexp_replace(text, r"[^}\]]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, nth, value, turns, net_0, net_1): a piece, and its effect when it begins outside or inside a string."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("nth"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    turns = (F.size("_parts") - 1) % 2
    closes = lambda begins: F.when((turns + begins) % 2 == 0, 1).otherwise(0)  # noqa: E731  the brace after the piece
    return staged(rows.withColumn("_parts", parts).select(
        "file", "start", "nth", "value", turns.alias("turns"), (_net(F.col("_parts"), 0) - closes(0)).alias("net_0"),
        (_net(F.col("_parts"), 1) - closes(1)).alias("net_1")), "json_pieces")


def _begun(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sums before each row in both cases: parity ``odd``, depths ``up_0`` and ``up_1`` by how the first row begins."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = df.withColumn("odd", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    own = {f"_n{b}": F.when((F.col("odd") + b) % 2 == 0, F.col("net_0")).otherwise(F.col("net_1")) for b in (0, 1)}
    return turned.withColumns(own).withColumns({f"up_{b}": F.coalesce(F.sum(f"_n{b}").over(before), F.lit(0)) for b in (0, 1)})


def json_array_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, item, text) of each object of the arrays in ``path``; a file of one object is one item.

    A range holds as many pieces as its bytes do, and a file as many ranges, so both
    windows are bounded; values of an array that are no objects are left out.
    """
    pieces = _begun(_pieces(spark, path), ["file", "start"], "nth")
    ranges = pieces.groupBy("file", "start").agg(
        (F.sum("turns") % 2).alias("turns"), F.sum("_n0").alias("net_0"), F.sum("_n1").alias("net_1"))
    ranges = _begun(ranges, ["file"], "start").select("file", "start", F.col("odd").alias("begins"), F.col("up_0").alias("depth"))
    first = pieces.groupBy("file").agg(F.min_by("value", F.struct("start", "nth")).alias("head"))
    first = first.select("file", F.when(F.regexp_replace("head", r"^[\s\uFEFF]+", "").startswith("["), 1).otherwise(0).alias("base"))
    inside = F.col("begins") == 1
    placed = pieces.join(ranges, ["file", "start"]).join(first, "file").withColumns({
        "after": F.col("depth") + F.when(inside, F.col("up_1") + F.col("_n1")).otherwise(F.col("up_0") + F.col("_n0")),
        "quoted": (F.col("begins") + F.col("odd") + F.col("turns")) % 2 == 1,
    }).withColumn("ends", ((F.col("after") <= F.col("base")) & ~F.col("quoted")).cast("int"))
    placed = staged(placed.select("file", "start", "nth", "value", "ends"), "json_places")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = placed.groupBy("file", "start").agg(F.sum("ends").alias("e")).withColumn("earlier", F.coalesce(F.sum("e").over(before), F.lit(0)))
    local = Window.partitionBy("file", "start").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_l", F.coalesce(F.sum("ends").over(local), F.lit(0))).join(earlier.drop("e"), ["file", "start"]).select(
        "file", (F.col("_l") + F.col("earlier")).alias("item"), "start", "nth", "value")
    joined = numbered.groupBy("file", "item").agg(F.sort_array(F.collect_list(F.struct("start", "nth", "value"))).alias("p"))     # of one item
    text = F.concat(F.array_join(F.transform("p", lambda s: s["value"]), "}"), F.lit("}"))
    return joined.select("file", "item", F.regexp_replace(text, r"^[\s\uFEFF,\[]+", "").alias("text")).where(F.col("text").startswith("{"))
