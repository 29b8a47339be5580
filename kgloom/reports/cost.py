"""Model cost and retrieval reports over the flat step log.

Step rows: ``dataset, method, file_stem, id, step_type, input_tokens,
output_tokens`` (token values as text) plus retrieval columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.skew import first_per_group

RUN = ["dataset", "method"]


def cost_per_question(steps: DataFrame, strict: bool = False) -> DataFrame:
    """Model calls and tokens per step file.

    A token text that is no number counts 0, or with ``strict`` removes its
    file from the report; -1 counts as it stands.
    """
    model = F.col("step_type") == "llm"
    def number(name):
        return F.col(name).try_cast("bigint")
    def total(name):
        return F.coalesce(F.sum(F.when(model, number(name))), F.lit(0)).alias(name)

    bad = model & (
        (F.col("input_tokens").isNotNull() & number("input_tokens").isNull())
        | (F.col("output_tokens").isNotNull() & number("output_tokens").isNull())
    )
    out = steps.groupBy(*RUN, "file_stem", "id").agg(
        F.count_if(model).alias("calls"), total("input_tokens"), total("output_tokens"),
        F.max(F.coalesce(bad, F.lit(False))).alias("_bad"),
    )
    return (out.where("NOT _bad") if strict else out).drop("_bad")


def cost_totals(cost: DataFrame) -> DataFrame:
    """One row of averages and totals; averages are NULL without any file."""
    both = F.col("input_tokens") + F.col("output_tokens")
    return cost.agg(
        F.avg("calls").alias("avg_calls"), F.avg("input_tokens").alias("avg_input_tokens"),
        F.avg("output_tokens").alias("avg_output_tokens"), F.avg(both).alias("avg_total_tokens"),
        F.count(F.lit(1)).alias("total_queries"), F.sum("calls").alias("total_calls"),
        F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
    )


def restrict_to_samples(cost: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose file stem or inner id is listed; two equi-joins, no OR join."""
    listed = ids.select(F.trim(F.col("id").cast("string")).alias("_s")).where("_s <> ''").distinct()
    by_stem = cost.join(listed.select("_s", F.lit(True).alias("_a")), F.col("file_stem") == F.col("_s"), "left").drop("_s")
    both = by_stem.join(listed.select("_s", F.lit(True).alias("_b")), F.trim("id") == F.col("_s"), "left").drop("_s")
    return both.where("_a OR _b").drop("_a", "_b")


def tokens_per_call(totals: DataFrame) -> DataFrame:
    calls = F.col("total_calls")
    both = F.col("total_input_tokens") + F.col("total_output_tokens")
    return totals.select(
        F.try_divide("total_input_tokens", calls).alias("input_per_call"),
        F.try_divide("total_output_tokens", calls).alias("output_per_call"),
        F.try_divide(both, calls).alias("total_per_call"),
    )


def cost_index(cost: DataFrame) -> DataFrame:
    """Cost by file stem and by inner id; the stem wins when both claim a key."""
    keys = F.array_distinct(F.filter(F.array("file_stem", F.trim("id")), lambda x: x != ""))
    rows = cost.select(*RUN, F.posexplode(keys).alias("_p", "key"), "file_stem", "calls",
                       (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return first_per_group(rows, [*RUN, "key"], [F.col("_p"), F.col("file_stem")]).drop("_p", "file_stem")


def join_cost_to_predictions(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """Predictions with their cost; a missing one costs 0 and is flagged."""
    keyed = index.withColumnRenamed("key", "id")
    return predictions.withColumn("id", F.trim("id")).join(keyed, [*RUN, "id"], "left").withColumns({
        "missing": F.col("tokens").isNull(),
        "calls": F.coalesce("calls", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0)),
    })


def run_summary(scored_cost: DataFrame) -> DataFrame:
    """Per dataset and method: samples, hit %, f1 %, average tokens and calls."""
    return scored_cost.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("samples"),
        (F.avg(F.coalesce("hit", F.lit(0))) * 100).alias("hit1_percent"),
        (F.avg(F.coalesce("f1", F.lit(0.0))) * 100).alias("f1_percent"),
        F.avg("tokens").alias("avg_total_tokens"), F.avg("calls").alias("avg_calls"),
        F.count_if("missing").alias("missing_cost_rows"),
    )


def call_histogram(scored_cost: DataFrame) -> DataFrame:
    """Rows and share per call count; shares use one row per call count."""
    counts = scored_cost.groupBy(*RUN, "calls").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy(*RUN)))


def dense_call_series(histogram: DataFrame, lo: int = 0, hi: int = 40) -> DataFrame:
    """A share for every call count of the range, zero where nothing fell."""
    runs = histogram.select(*RUN).distinct().withColumn("calls", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    at = histogram.select(*RUN, F.col("calls").cast("int").alias("calls"), "proportion")
    return runs.join(at, [*RUN, "calls"], "left").na.fill(0.0, ["proportion"])


def method_means(scored_cost: DataFrame, methods: list[str]) -> DataFrame:
    """Mean calls of each method side by side; 0 where a method has no run."""
    return scored_cost.groupBy("dataset").pivot("method", methods).avg("calls").na.fill(0.0)


def retrieval_log_report(steps: DataFrame) -> DataFrame:
    """Outcome counts of graph retrievals per search type and status."""
    return steps.where("step_type = 'sparql'").groupBy("search_type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("timed_out").alias("n_timed_out"),
        F.count_if("filter_caused_empty").alias("n_filter_empty"), F.sum("result_count").alias("results"),
    )
