"""Queries for readers and writers: whole fixture sets written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kgloom.catalog import query
from kgloom.catalog.ctes import define, with_ctes
from kgloom.catalog.evaluate import predictions
from kgloom.reports import cost as cost_report
from kgloom.settings import FREEBASE
from kgloom.skew import workspace
from kgloom.sources import io, prepare
from kgloom.sources.ntriples import load_triples


def scratch(fx, name):
    return f"{workspace(fx.spark)}/kgloom/{fx.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def question_items(fx):
    """Question records: some without topic, with a blank name, or lacking fields."""
    topic = F.struct(F.col("topic_id").alias("id"), F.col("topic_name").alias("name"))
    blank = F.struct(F.col("topic_id").alias("id"), F.lit("").alias("name"))
    nameless = F.struct(F.col("topic_id").alias("id"), F.lit(None).cast("string").alias("name"))
    v = F.col("k") % 7
    return fx.questions.select(
        F.when(v != 1, F.col("qid")).alias("id"), F.when(v != 2, F.col("question")).alias("question"),
        F.when(v == 3, F.array().cast(io.ITEMS)).when(v == 4, F.array(blank, topic)).when(v == 5, F.array(nameless))
        .when(v != 6, F.array(topic)).alias("topic_entity"), "k", "qid")


define("question_cases", ("questions",), """
SELECT qid, question, topic_id, topic_name, k % 7 AS v, CASE k % 7 WHEN 1 THEN 'Missing field: id' WHEN 2 THEN 'Missing field: question' WHEN 6 THEN 'Missing field: topic_entity'
  WHEN 3 THEN 'topic_entity must be non-empty list' WHEN 5 THEN 'topic_entity item missing id/name' ELSE '' END AS reason FROM questions""")


@query("A1_read_questions", with_ctes("question_cases", """
SELECT CASE WHEN v <> 1 THEN qid END AS id, CASE WHEN v <> 2 THEN question END AS question, CASE v WHEN 6 THEN -1 WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS n_topics FROM question_cases"""))
def read_questions(fx):
    path = scratch(fx, "questions") + ".jsonl"
    question_items(fx).drop("k", "qid").write.json(path)
    return io.read_questions(fx.spark, path).select("id", "question", F.coalesce(F.size("topic_entity"), F.lit(-1)).alias("n_topics"))


NAME_SPACE = "http://rdf.freebase.com/ns/"


def nt_lines(fx):
    """The graph as N-Triples: full URIs, escapes of all kinds, comments, blank nodes, idle and broken lines."""
    uri = lambda c: F.concat(F.lit(f"<{NAME_SPACE}"), F.col(c), F.lit(">"))
    body = F.replace(F.replace(F.replace("obj", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("#"), F.lit("\\u0023"))
    body = F.when(F.col("obj_lang") == "fr", F.replace(F.replace(body, F.lit("a"), F.lit("\\U00000061")), F.lit("e"), F.lit("\\u0065"))).otherwise(body)
    tag = F.when(F.col("obj_lang") != "", F.concat(F.lit("@"), F.upper("obj_lang"))).when(
        F.col("obj_kind") == "typed-literal", F.lit("^^<http://www.w3.org/2001/XMLSchema#date>")).otherwise("")
    obj = F.when(F.col("obj_kind") == "uri", uri("obj")).otherwise(F.concat(F.lit('"'), body, F.lit('"'), tag))
    end = F.when(F.col("pred") == "geo.nation.region", '\t. # a comment with "quotes" .').otherwise(" .")
    lines = fx.triples.select(F.concat(uri("subj"), F.lit(" "), uri("pred"), F.lit("\t"), obj, end).alias("value"))
    nation = fx["nation"].select(F.col("n_nationkey").alias("k"), "n_name")
    more = {
        "blank": F.concat(F.lit("_:n"), "k", F.lit(f" <{NAME_SPACE}geo.note> _:r.1.")),
        "signs": F.concat(F.lit(f"<m.sign> <{NAME_SPACE}geo.sign> \"\\t\\uD83D\\uDE00\\\\n"), "k", F.lit('\\U0001F600" .')),
        "idle": F.lit("  # only a comment"), "empty": F.lit(""),
        "syntax": F.concat(F.lit(f"<m.n> <{NAME_SPACE}geo.note> "), "n_name", F.lit(" .")),
        "escape": F.concat(F.lit(f"<m.n> <{NAME_SPACE}geo.note> \"\\x"), "k", F.lit('" .')),
        "code point": F.concat(F.lit(f"<m.n> <{NAME_SPACE}geo.note> \"\\uD83D"), "k", F.lit('" .')),
    }
    for text in more.values():
        lines = lines.unionByName(nation.select(text.alias("value")))
    return lines


def nt_load(fx):
    path = scratch(fx, "triples") + ".nt"
    nt_lines(fx).write.text(path)
    return load_triples(fx.spark, path, FREEBASE)


@query("A2_read_triples", with_ctes("triples", """
SELECT subj, pred, obj, obj_kind, obj_lang FROM triples
UNION ALL SELECT concat('_:n', n_nationkey), 'geo.note', '_:r.1', 'bnode', '' FROM nation
UNION ALL SELECT 'm.sign', 'geo.sign', concat(chr(9), chr(128512), chr(92), 'n', n_nationkey, chr(128512)), 'literal', '' FROM nation"""))
def read_triples(fx):
    """Written as N-Triples text, read back by the grammar, ids normalized, duplicates gone."""
    return nt_load(fx).triples


@query("A2_read_triples_counts", with_ctes("triples", """
SELECT '' AS reason, (SELECT count(*) FROM triples) + 2 * count(*) AS n_lines FROM nation
UNION ALL SELECT r, count(*) * CASE r WHEN 'idle' THEN 2 ELSE 1 END FROM nation, (VALUES ('idle'), ('syntax'), ('escape'), ('code point')) AS v(r) GROUP BY r"""))
def read_triples_counts(fx):
    """Lines by outcome; every line is a triple, idle, or in quarantine."""
    load = nt_load(fx)
    kept = load.quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))
    fine = load.counts.where("reason in ('', 'idle')").groupBy("reason").agg(F.sum("n_lines").alias("n_lines"))
    return kept.unionByName(fine)


@query("A3_read_predictions", with_ctes("pred_rows pred_results", """
SELECT r.id, r.action, coalesce(n, -1) AS n_results, FALSE AS corrupt FROM pred_rows r LEFT JOIN (SELECT id, count(*) AS n FROM pred_results GROUP BY id) p ON p.id = r.id
UNION ALL SELECT NULL, NULL, -1, TRUE FROM pred_rows WHERE variant = 3"""))
def read_predictions(fx):
    """Prediction lines mixed with blank and broken lines."""
    path = scratch(fx, "predictions")
    rows = predictions(fx)
    good = rows.select(F.to_json(F.struct("action", "id", "question", "gold_answer", "results")).alias("value"))
    bad = rows.where("variant = 3").select(F.concat(F.lit('{"id": "'), "id").alias("value"))
    blank = rows.where("variant = 4").select(F.lit("").alias("value"))
    good.unionByName(bad).unionByName(blank).write.text(path)
    return io.read_predictions(fx.spark, path).select("id", "action", F.coalesce(F.size("results"), F.lit(-1)).alias("n_results"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


define("conv_steps", (), """
SELECT concat('c', conv_id) AS id, CAST(turn AS INT) AS log_pos, role, text, CASE WHEN conv_id % 10 <> 0 AND turn % 5 <> 4 THEN CAST(10 - turn AS INT) END AS trace_id FROM conversations""")


def logs(fx):
    steps = fx.rel("conv_steps")
    found = steps.where("role = 'user'").select("id", "log_pos", "trace_id", F.lit("entity_search").alias("search_type"), F.col("text").alias("sparql"))
    called = steps.where("role = 'assistant'").select("id", "log_pos", "trace_id", F.lit("reasoning").alias("operation_type"), F.col("text").alias("response"))
    return found, called


MERGED = """, s AS (SELECT *, CASE role WHEN 'user' THEN 0 ELSE 1 END AS log FROM conv_steps WHERE role <> 'system'),
m AS (SELECT id, trace_id, log, text, row_number() OVER (PARTITION BY id ORDER BY coalesce(trace_id, 1000000000), log, log_pos) AS pos FROM s) """


@query("A4_read_step_logs", with_ctes("conv_steps", MERGED + """
SELECT id, count(*) AS n_steps, CAST(sum(log) AS BIGINT) AS n_model, min(CASE WHEN pos = 1 THEN md5(text) END) AS first_digest FROM m GROUP BY id"""))
def read_step_logs(fx):
    """One JSON file per conversation, written as a result folder."""
    steps = prepare.merge_step_history(*logs(fx))
    heads = steps.select("id").distinct()
    path = scratch(fx, "logs")
    io.nested_details(heads, steps.drop("trace_id")).write.option("maxRecordsPerFile", 1).json(path)
    first = F.get("step_history", F.lit(0))
    read = io.read_step_logs(fx.spark, path)
    return read.select("id", F.size("step_history").cast("long").alias("n_steps"),
                       F.size(F.filter("step_history", lambda s: s["step_type"] == "llm")).cast("long").alias("n_model"),
                       F.md5(F.coalesce(first["sparql"], first["response"])).alias("first_digest"))


@query("A5_write_predictions", with_ctes("pred_rows", "SELECT id, dataset, method, 2 AS copies FROM pred_rows"))
def write_predictions(fx):
    """Two appends to the same folder."""
    path = scratch(fx, "appended")
    rows = fx.rel("pred_rows").select("id", "dataset", "method")
    io.write_predictions(rows, path)
    io.write_predictions(rows, path)
    return fx.spark.read.schema("id string, dataset string, method string").json(path).groupBy("id", "dataset", "method").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("A6_write_details", with_ctes("steps pred_rows", """
SELECT r.dataset, r.method, r.id, coalesce(n, 0) AS n_steps FROM pred_rows r LEFT JOIN (SELECT id, count(*) AS n FROM steps GROUP BY id) s ON s.id = r.id"""))
def write_details(fx):
    heads = fx.rel("pred_rows").select("id", "dataset", "method")
    flat = fx.written("steps").select("id", "step_type", "search_type", "input_tokens", "output_tokens").withColumns({
        "trace_order": F.lit(prepare.UNTRACED).cast("long"), "seq": F.monotonically_increasing_id()})
    path = scratch(fx, "details")
    io.write_details(io.nested_details(heads, io.number_steps(flat).drop("trace_order", "seq"), 3), path)
    read = io.read_step_logs(fx.spark, path).groupBy("id").agg(
        F.sum(F.greatest(F.lit(0), F.coalesce(F.size("step_history"), F.lit(0)))).alias("n_steps"))
    return heads.join(read, "id", "left").select("dataset", "method", "id", "n_steps")


@query("A7_write_report_csv", with_ctes("hist", """
SELECT dataset, method, CAST(calls AS STRING) AS calls, CAST(count AS STRING) AS count, printf('%.8f', proportion) AS proportion FROM hist"""))
def write_report_csv(fx):
    from kgloom.catalog.cost import costed

    path = scratch(fx, "report")
    io.write_report_csv(cost_report.call_histogram(costed(fx)), path, {"proportion": 8})
    return fx.spark.read.option("header", True).schema("dataset string, method string, calls string, count string, proportion string").csv(path)


@query("Q1_validate_questions", with_ctes("question_cases", "SELECT qid, reason = '' AS valid, reason FROM question_cases"))
def validate_questions(fx):
    return prepare.validate_questions(question_items(fx)).select("qid", "valid", "reason")


@query("Q2_normalize_topics", with_ctes("question_cases", """
SELECT qid, CASE WHEN v IN (3, 5, 6) THEN 0 ELSE 1 END AS n_topics, CASE WHEN v NOT IN (3, 5, 6) THEN topic_name END AS first_name FROM question_cases"""))
def normalize_topics(fx):
    out = prepare.normalize_topics(question_items(fx))
    return out.select("qid", F.greatest(F.lit(0), F.coalesce(F.size("topic_entity"), F.lit(0))).alias("n_topics"), F.get("topic_entity", F.lit(0))["name"].alias("first_name"))


@query("Q3_select_question", with_ctes("questions", "SELECT qid AS id, question FROM questions WHERE qid = 'qd-p7'"))
def select_question(fx):
    return prepare.select_question(fx.questions.select(F.col("qid").alias("id"), "question"), "qd-p7")


@query("Q4_take_questions", with_ctes("questions", "SELECT qid, question FROM questions ORDER BY qid LIMIT 100"))
def take_questions(fx):
    return prepare.take_questions(fx.questions.select("qid", "question"), 100, "qid")


@query("Q5_resume", with_ctes("questions pred_rows", "SELECT qid AS id FROM questions WHERE qid NOT IN (SELECT id FROM pred_rows WHERE variant < 6)"))
def resume(fx):
    return prepare.resume(fx.questions.select(F.col("qid").alias("id")), fx.rel("pred_rows").where("variant < 6"))


define("raw_results", ("questions",), """
SELECT qid, topic_id, topic_name, k % 6 AS v, CASE k % 6 WHEN 0 THEN concat('[{"id": "', topic_id, '", "name": "', topic_name, '"}]') WHEN 1 THEN concat('["", "', topic_name, '", "x"]')
  WHEN 2 THEN concat('"', topic_name, '"') WHEN 3 THEN '[]' WHEN 4 THEN '""' ELSE '17' END AS raw FROM questions""")


@query("Q6_normalize_results", with_ctes("raw_results", """
SELECT qid, CASE v WHEN 0 THEN topic_id ELSE '' END AS id, topic_name AS name FROM raw_results WHERE v <= 2 UNION ALL SELECT qid, '', 'x' FROM raw_results WHERE v = 1"""))
def normalize_results(fx):
    return fx.rel("raw_results").select("qid", F.explode(prepare.normalize_results(F.col("raw"))).alias("r")).select("qid", "r.id", "r.name")


@query("Q7_merge_step_history", with_ctes("conv_steps", MERGED + "SELECT id, pos, CASE log WHEN 0 THEN 'sparql' ELSE 'llm' END AS step_type, md5(text) AS digest FROM m"))
def merge_step_history(fx):
    return prepare.merge_step_history(*logs(fx)).select("id", "pos", "step_type", F.md5(F.coalesce("sparql", "response")).alias("digest"))


@query("Q8_expand_legacy_steps", with_ctes("conv_steps", """
SELECT id, log_pos, 'relation_search' AS search_type, md5(text) AS digest, log_pos * 2 AS result_count, trace_id FROM conv_steps
UNION ALL SELECT id, log_pos, role, md5(concat(text, '!')), log_pos * 2, trace_id FROM conv_steps"""))
def expand_legacy_steps(fx):
    entry = F.create_map(F.lit("relation_search"), F.col("text"), F.col("role"), F.concat("text", F.lit("!")),
                         F.lit("result_count"), (F.col("log_pos") * 2).cast("string"), F.lit("trace_id"), F.col("trace_id").cast("string"))
    out = prepare.expand_legacy_steps(fx.rel("conv_steps").select("id", "log_pos", entry.alias("entry")))
    return out.select("id", "log_pos", "search_type", F.md5("sparql").alias("digest"), "result_count", "trace_id")
