"""Question checks, resuming, result shapes and step histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.sources.io import ITEMS, number_steps

UNTRACED = 10**9


def validate_questions(df: DataFrame) -> DataFrame:
    """Add ``valid`` and the ``reason`` of the first failed check."""
    def missing(name):
        return F.when(F.col(name).isNull(), F.lit(f"Missing field: {name}"))

    # The reasons, as error files carry them.
    topics = F.col("topic_entity")
    reason = F.coalesce(
        missing("id"), missing("question"), missing("topic_entity"),
        F.when(F.size(topics) == 0, F.lit("topic_entity must be non-empty list")),
        F.when(F.exists(topics, lambda t: t["id"].isNull() | t["name"].isNull()), F.lit("topic_entity item missing id/name")))
    return df.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("valid", F.col("reason") == "")


def normalize_topics(df: DataFrame) -> DataFrame:
    """Keep topic entities with non-empty id and name."""
    usable = F.filter("topic_entity", lambda t: (F.coalesce(t["id"], F.lit("")) != "") & (F.coalesce(t["name"], F.lit("")) != ""))
    return df.withColumn("topic_entity", usable)


def select_question(df: DataFrame, wanted: str) -> DataFrame:
    return df.where(F.col("id").cast("string") == F.lit(str(wanted)))


def take_questions(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """First ``n`` questions in input order; ``n <= 0`` means all."""
    return df if n <= 0 else df.orderBy(pos).limit(n)


def resume(df: DataFrame, done: DataFrame) -> DataFrame:
    """Questions without a finished row, matched by id rather than row count."""
    return df.join(done.select("id").distinct(), "id", "left_anti")


def normalize_results(raw: Column) -> Column:
    """Result JSON of any accepted shape to a list of id/name items."""
    text = F.trim(raw)
    listed = F.from_json(text, "array<string>")
    first = F.get(listed, F.lit(0))
    items = F.from_json(text, ITEMS)
    texts = F.transform(F.filter(listed, lambda x: x != ""), lambda x: F.struct(F.lit("").alias("id"), x.alias("name")))
    one = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))
    single = F.when(one != "", F.array(F.struct(F.lit("").alias("id"), one.alias("name"))))
    none = F.array().cast(ITEMS)
    return F.coalesce(
        F.when(text.startswith("["), F.when(first.startswith("{"), items).otherwise(texts)),
        F.when(text.startswith('"'), single), none)


def merge_step_history(retrievals: DataFrame, model_calls: DataFrame) -> DataFrame:
    """Both logs of each question in one order.

    By trace id, untraced steps last, else in log order (retrievals before
    model calls); a question without any trace id keeps log order.
    """
    both = retrievals.withColumns({"step_type": F.lit("sparql"), "_log": F.lit(0)}).unionByName(
        model_calls.withColumns({"step_type": F.lit("llm"), "_log": F.lit(1)}), allowMissingColumns=True)
    traced = both.withColumns({
        "trace_order": F.coalesce("trace_id", F.lit(UNTRACED)).cast("long"),
        "seq": F.col("_log").cast("long") * UNTRACED + F.col("log_pos"),
    })
    return number_steps(traced).drop("trace_order", "seq", "_log", "log_pos")


def expand_legacy_steps(df: DataFrame) -> DataFrame:
    """Old rows keyed by operation: every other key becomes one step."""
    opened = df.select("id", "log_pos", F.explode(F.map_entries("entry")).alias("e"), "entry")
    kept = opened.where(~F.col("e.key").isin("result_count", "trace_id"))
    return kept.select(
        "id", "log_pos", F.col("e.key").alias("search_type"), F.col("e.value").alias("sparql"),
        F.coalesce(F.try_element_at("entry", F.lit("result_count")).try_cast("int"), F.lit(-1)).alias("result_count"),
        F.try_element_at("entry", F.lit("trace_id")).try_cast("int").alias("trace_id"))
