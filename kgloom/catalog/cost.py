"""Queries for cost and efficiency reports."""

from pyspark.sql import functions as F

from kgloom.catalog import query
from kgloom.catalog.ctes import define, with_ctes
from kgloom.catalog.evaluate import SCORE_CTES, SCORED, scored
from kgloom.reports import cost as c

# Step log of every date question: one step per line of its order; questions of the
# other families have no log.  One in 97 lines has a broken token text.
define("steps", ("pred_rows",), """
SELECT r.dataset, r.method, CASE WHEN l.l_orderkey % 2 = 0 THEN r.id ELSE concat('file-', l.l_orderkey) END AS file_stem, r.id,
  CASE WHEN l.l_linenumber % 2 = 1 THEN 'llm' ELSE 'sparql' END AS step_type,
  CASE WHEN l.l_partkey % 97 = 0 THEN 'x' WHEN l.l_partkey % 7 = 0 THEN '-1' ELSE CAST(CAST(l.l_quantity AS BIGINT) AS STRING) END AS input_tokens,
  CASE WHEN l.l_suppkey % 11 <> 0 THEN CAST(l.l_linenumber AS STRING) END AS output_tokens,
  CASE l.l_returnflag WHEN 'A' THEN 'entity_search' WHEN 'N' THEN 'relation_search_head' ELSE 'relation_search_tail' END AS search_type,
  CASE WHEN l.l_partkey % 13 = 0 THEN 'timeout' ELSE 'ok' END AS status, l.l_partkey % 13 = 0 AS timed_out,
  l.l_suppkey % 5 = 0 AS filter_caused_empty, CAST(l.l_quantity AS BIGINT) AS result_count
FROM lineitem l JOIN pred_rows r ON r.id = concat('qe-o', l.l_orderkey)""")
define("cost", ("steps",), """
SELECT dataset, method, file_stem, id, CAST(sum(CASE WHEN step_type = 'llm' THEN 1 ELSE 0 END) AS BIGINT) AS calls,
  CAST(coalesce(sum(CASE WHEN step_type = 'llm' THEN try_cast(input_tokens AS BIGINT) END), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(CASE WHEN step_type = 'llm' THEN try_cast(output_tokens AS BIGINT) END), 0) AS BIGINT) AS output_tokens,
  max(CASE WHEN step_type = 'llm' AND input_tokens = 'x' THEN 1 ELSE 0 END) AS bad FROM steps GROUP BY dataset, method, file_stem, id""")
define("costed", ("cost", "pred_rows"), """
SELECT r.dataset, r.method, r.id, coalesce(c.calls, 0) AS calls, coalesce(c.input_tokens + c.output_tokens, 0) AS tokens, c.calls IS NULL AS missing FROM pred_rows r LEFT JOIN cost c ON c.id = r.id""")


def cost(fx, strict=False):
    return c.cost_per_question(fx.written("steps"), strict)


def costed(fx):
    return c.join_cost_to_predictions(fx.rel("pred_rows").select("dataset", "method", "id"), c.cost_index(cost(fx)))


@query("F1_llm_cost_per_question", with_ctes("cost", """
SELECT file_stem, id, calls, input_tokens, output_tokens, FALSE AS strict FROM cost UNION ALL SELECT file_stem, id, calls, input_tokens, output_tokens, TRUE FROM cost WHERE bad = 0"""))
def cost_per_question(fx):
    return cost(fx).withColumn("strict", F.lit(False)).unionByName(cost(fx, True).withColumn("strict", F.lit(True))).drop("dataset", "method")


_TOTALS = """SELECT round(avg(calls), 6) AS avg_calls, round(avg(input_tokens), 6) AS avg_input_tokens, round(avg(output_tokens), 6) AS avg_output_tokens,
  round(avg(input_tokens + output_tokens), 6) AS avg_total_tokens, count(*) AS total_queries, CAST(sum(calls) AS BIGINT) AS total_calls,
  CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens FROM """


def rounded_totals(df):
    out = c.cost_totals(df)
    return out.select(*[F.round(n, 6).alias(n) if n.startswith("avg") else F.col(n) for n in out.columns])


@query("F2_llm_cost_totals", with_ctes("cost", _TOTALS + "cost WHERE bad = 0"))
def cost_totals(fx):
    return rounded_totals(cost(fx, True))


define("sample_ids", ("steps",), "SELECT DISTINCT concat(' ', CASE WHEN length(file_stem) % 2 = 0 THEN file_stem ELSE id END) AS id FROM steps WHERE status = 'timeout'")


@query("F3_restrict_to_samples", with_ctes("cost sample_ids", """
SELECT file_stem, id, calls FROM cost WHERE file_stem IN (SELECT trim(id) FROM sample_ids) OR id IN (SELECT trim(id) FROM sample_ids)"""))
def restrict_to_samples(fx):
    return c.restrict_to_samples(cost(fx), fx.rel("sample_ids")).select("file_stem", "id", "calls")


@query("F4_tokens_per_call", with_ctes("cost", """
SELECT round(sum(input_tokens) / sum(calls), 6) AS input_per_call, round(sum(output_tokens) / sum(calls), 6) AS output_per_call, round(sum(input_tokens + output_tokens) / sum(calls), 6) AS total_per_call FROM cost"""))
def tokens_per_call(fx):
    out = c.tokens_per_call(c.cost_totals(cost(fx)))
    return out.select(*[F.round(n, 6).alias(n) for n in out.columns])


@query("F5_cost_index", with_ctes("cost", """
SELECT file_stem AS key, calls, input_tokens + output_tokens AS tokens FROM cost UNION SELECT id, calls, input_tokens + output_tokens FROM cost"""))
def cost_index(fx):
    return c.cost_index(cost(fx)).select("key", "calls", "tokens")


@query("F6_join_cost_to_predictions", with_ctes("costed", "SELECT id, calls, tokens, missing FROM costed"))
def join_cost(fx):
    return costed(fx).select("id", "calls", "tokens", "missing")


def scored_cost(fx):
    return c.join_cost_to_predictions(scored(fx, False).select("dataset", "method", "id", "hit", "f1"), c.cost_index(cost(fx)))


# Scores here come from the variant that drops blank names.
_NO_BLANKS = SCORED.replace("FROM pred_ruled GROUP BY id", "FROM pred_ruled WHERE name <> '' GROUP BY id")


@query("F7_run_summary", with_ctes(SCORE_CTES + " costed", _NO_BLANKS + """
SELECT dataset, method, count(*) AS samples, round(avg(coalesce(hit, 0)) * 100, 4) AS hit1_percent, round(avg(CASE WHEN precision IS NULL THEN 0 ELSE f1 END) * 100, 4) AS f1_percent,
  round(avg(tokens), 2) AS avg_total_tokens, round(avg(calls), 2) AS avg_calls, CAST(sum(CASE WHEN missing THEN 1 ELSE 0 END) AS BIGINT) AS missing_cost_rows
FROM scored JOIN costed USING (dataset, method, id) GROUP BY dataset, method"""))
def run_summary(fx):
    out = c.run_summary(scored_cost(fx))
    digits = {"hit1_percent": 4, "f1_percent": 4, "avg_total_tokens": 2, "avg_calls": 2}
    return out.select(*[F.round(n, digits[n]).alias(n) if n in digits else F.col(n) for n in out.columns])


define("hist", ("costed",), """
SELECT dataset, method, calls, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY dataset, method) AS proportion FROM costed GROUP BY dataset, method, calls""")


@query("F8_call_histogram", with_ctes("hist", "SELECT dataset, method, calls, count, round(proportion, 8) AS proportion FROM hist"))
def call_histogram(fx):
    return c.call_histogram(costed(fx)).withColumn("proportion", F.round("proportion", 8))


@query("F9_dense_call_series", with_ctes("hist", """
SELECT d.dataset, d.method, CAST(x.calls AS INT) AS calls, round(coalesce(h.proportion, 0), 8) AS proportion
FROM (SELECT DISTINCT dataset, method FROM hist) d JOIN range(0, 41) x(calls) ON TRUE LEFT JOIN hist h ON h.dataset = d.dataset AND h.method = d.method AND h.calls = x.calls"""))
def dense_call_series(fx):
    return c.dense_call_series(c.call_histogram(costed(fx))).withColumn("proportion", F.round("proportion", 8))


@query("F10_method_means", with_ctes("costed", "SELECT dataset, " + ", ".join(
    f"round(coalesce(avg(CASE WHEN method = '{m}' THEN calls END), 0), 6) AS {m}" for m in ("beam", "memory", "chain")) + " FROM costed GROUP BY dataset"))
def method_means(fx):
    methods = ["beam", "memory", "chain"]
    return c.method_means(costed(fx), methods).select("dataset", *[F.round(m, 6).alias(m) for m in methods])


@query("F11_retrieval_log_report", with_ctes("steps", """
SELECT search_type, status, count(*) AS n, CAST(sum(CASE WHEN timed_out THEN 1 ELSE 0 END) AS BIGINT) AS n_timed_out,
  CAST(sum(CASE WHEN filter_caused_empty THEN 1 ELSE 0 END) AS BIGINT) AS n_filter_empty, CAST(sum(result_count) AS BIGINT) AS results
FROM steps WHERE step_type = 'sparql' GROUP BY search_type, status"""))
def retrieval_log_report(fx):
    return c.retrieval_log_report(fx.written("steps"))
