"""Queries for reading model replies: texts built from whole tables."""

from pyspark.sql import functions as F

from kgloom.catalog import query
from kgloom.catalog.ctes import define, with_ctes
from kgloom.functions import responses as p

# a, b: two texts per question; v: which spelling its reply has.
define("reply_base", ("questions",), "SELECT qid, family, topic_name AS a, sig AS b, k, k % 6 AS v FROM questions")
define("attempts", ("reply_base",), """
SELECT qid AS prompt_key, n AS attempt, CASE WHEN (k + n) % 4 = 0 THEN concat(a, ' ', n) WHEN (k + n) % 4 = 1 THEN '' END AS text, k + n AS input_tokens, n AS output_tokens
FROM reply_base, (VALUES (1), (2), (3), (4)) AS t(n)""")


@query("L1_first_nonempty_attempt", with_ctes("attempts", """
, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_key ORDER BY attempt) AS rn FROM attempts WHERE text <> '' AND attempt <= 3) t WHERE rn = 1)
SELECT p.prompt_key, f.text, f.input_tokens, f.output_tokens FROM (SELECT DISTINCT prompt_key FROM attempts) p LEFT JOIN f ON f.prompt_key = p.prompt_key"""))
def first_nonempty_attempt(fx):
    return p.first_nonempty_attempt(fx.rel("attempts"))


define("object_replies", ("reply_base",), """
SELECT qid, a, b, v, CASE v WHEN 0 THEN concat('{"x": "', a, '", "y": ["', b, '", ""]}')
  WHEN 1 THEN concat('Sure.\n```json\n{"x": "', a, '", "y": ["', b, '"]}\n```\nDone')
  WHEN 2 THEN concat('I think {"x": "', a, '", "y": ["', b, '"]} fits {not json}')
  WHEN 3 THEN concat('{"x": "', a, '", "y": ') WHEN 4 THEN concat('["', a, '"]') ELSE '' END AS text FROM reply_base""")


@query("L2_extract_json_object", with_ctes("object_replies", """
SELECT qid, CASE WHEN v <= 2 THEN a END AS x, v <= 2 AS readable FROM object_replies"""))
def extract_json_object(fx):
    obj = p.extract_json_object(F.col("text"))
    return fx.rel("object_replies").select("qid", obj["x"].alias("x"), obj.isNotNull().alias("readable"))


define("list_replies", ("reply_base",), """
SELECT qid, a, b, v, CASE v WHEN 0 THEN concat('["', a, '", " ", "', b, '"]') WHEN 1 THEN concat('[''', a, ''', ''', b, ''']')
  WHEN 2 THEN concat('```\n["', a, '", "', b, '"]\n```') WHEN 3 THEN concat('Names: ["', a, '", "', b, '"].') WHEN 4 THEN concat(a, ', ', b) ELSE concat('["', a) END AS text FROM reply_base""")


@query("L3_extract_json_list", with_ctes("list_replies", "SELECT qid, CASE WHEN v <= 3 THEN concat(a, '|', b) END AS items FROM list_replies"))
def extract_json_list(fx):
    return fx.rel("list_replies").select("qid", F.array_join(p.extract_json_list(F.col("text")), "|").alias("items"))


define("ranking_replies", ("reply_base",), """
SELECT qid, a, b, k % 8 AS v, CASE k % 8
  WHEN 0 THEN concat('{"rational": "r", "relation_by_relevance": ["', a, '", "', b, '"], "relevance_score": [0.9, 1.4]}')
  WHEN 1 THEN concat('{"relation_by_relevance": [["', a, '", "why"], {"relation_id": "', b, '"}]}')
  WHEN 2 THEN concat('{"relation_by_relevance": "', a, '", "relevance_score": [0.5]}')
  WHEN 3 THEN concat('Ranking {"', a, '": 1, "', b, '": 2} end')
  WHEN 4 THEN concat('[{"relation_id": "', a, '", "rank": 2, "score": 0.3}, {"relation": "', b, '", "rank": 1, "relevance_score": 0.7}]')
  WHEN 5 THEN concat('List: [{"', a, '": "why"}]') WHEN 6 THEN concat('[{"', a, '": "x", "rank": 4}, 7, {"p": 1, "q": 2}]')
  ELSE 'no idea' END AS text FROM reply_base""")


@query("L4_parse_relation_ranking", with_ctes("ranking_replies", """
SELECT qid, 0 AS pos, a AS text, CASE v WHEN 4 THEN '2' WHEN 6 THEN '4' END AS rank, CASE v WHEN 0 THEN '0.9' WHEN 2 THEN '0.5' WHEN 4 THEN '0.3' END AS score FROM ranking_replies WHERE v <= 6
UNION ALL SELECT qid, 1, b, CASE v WHEN 4 THEN '1' END, CASE v WHEN 0 THEN '1.4' WHEN 4 THEN '0.7' END FROM ranking_replies WHERE v IN (0, 1, 3, 4)"""))
def parse_relation_ranking(fx):
    return fx.rel("ranking_replies").select("qid", F.explode(p.parse_relation_ranking(F.col("text"))).alias("e")).select("qid", "e.*")


define("decision_replies", ("reply_base",), """
SELECT qid, a, b, v, k % 4 AS w, concat(CASE v WHEN 1 THEN 'Well: ' ELSE '' END, '{"decision": "', CASE k % 4 WHEN 0 THEN ' Stop' WHEN 1 THEN 'YES' WHEN 2 THEN 'no ' ELSE 'maybe' END,
  '", "answer": ', CASE v WHEN 2 THEN '"text"' ELSE concat('["', a, ' ", ""]') END, CASE v WHEN 3 THEN '' ELSE '}' END) AS text FROM reply_base""")
DECIDED = "CASE WHEN v = 3 THEN NULL ELSE CASE w WHEN 0 THEN 'stop' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' END END"
ANSWERS = "CASE WHEN v IN (2, 3) THEN '' ELSE a END"


@query("L5_parse_reasoning_decision", with_ctes("decision_replies", f"SELECT qid, {DECIDED} AS decision, {ANSWERS} AS answers FROM decision_replies"))
def parse_reasoning_decision(fx):
    out = fx.rel("decision_replies").select("qid", p.parse_reasoning_decision(F.col("text")).alias("d"))
    return out.select("qid", "d.decision", F.array_join("d.answers", "|").alias("answers"))


@query("L6_parse_yes_no", with_ctes("decision_replies", f"""
SELECT qid, nullif({DECIDED}, 'stop') AS decision, {ANSWERS} AS answers, CASE WHEN v = 3 THEN 'unreadable' WHEN w IN (0, 3) THEN 'no decision' ELSE '' END AS warning FROM decision_replies"""))
def parse_yes_no(fx):
    out = fx.rel("decision_replies").select("qid", p.parse_yes_no(F.col("text")).alias("d"))
    return out.select("qid", "d.decision", F.array_join("d.answers", "|").alias("answers"), "d.warning")


define("answer_replies", ("reply_base",), """
SELECT qid, a, b, v, CASE v WHEN 0 THEN concat('{"rationale": "r", "answer": ["', a, '", " ", "', b, '"]}') WHEN 1 THEN concat('Therefore, the answer is { ', a, ', ', b, '} so {z}')
  WHEN 2 THEN '{"rationale": "r"}' WHEN 3 THEN concat('} nothing {', a) WHEN 4 THEN '{"answer": []}' ELSE a END AS text FROM reply_base""")


@query("L7_parse_answer_list", with_ctes("answer_replies", "SELECT qid, CASE WHEN v <= 1 THEN concat(a, ', ', b) ELSE '' END AS answer FROM answer_replies"))
def parse_answer_list(fx):
    return fx.rel("answer_replies").select("qid", p.parse_answer_list(F.col("text")).alias("answer"))


define("sufficiency_replies", ("reply_base",), """
SELECT qid, a, b, k, k % 8 AS v, CASE k % 8
  WHEN 0 THEN concat('{"A": {"Sufficient": "Yes", "Answer": ["', a, '", "', b, '"]}, "R": "because it is there"}')
  WHEN 1 THEN concat('{"A": {"Sufficient": "Yes", "Answer": "null"}, "R": "short"}')
  WHEN 2 THEN concat('{"Sufficient": "No", "Answer": "', a, '", "R": "Entity X"}')
  WHEN 3 THEN concat('A: answer\nAnswer: ', a, '\nR: a reason with four words')
  WHEN 4 THEN concat('sufficient: yes\nanswer: m.c7\nreason: r')
  WHEN 5 THEN concat('```json\n{"Sufficient": true, "Answer": "', a, '", "Reason": "why", "R": "go there now please"}\n```')
  WHEN 6 THEN concat('{"A": "retrieve", "R": "', 'Land', '"}') ELSE 'nothing' END AS text FROM reply_base""")


@query("L8_parse_sufficiency", with_ctes("sufficiency_replies", """
SELECT qid, v IN (0, 3, 5) AS sufficient, CASE v WHEN 0 THEN concat(a, ', ', b) WHEN 1 THEN 'null' WHEN 4 THEN 'm.c7' WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE a END AS answer,
  CASE v WHEN 2 THEN 'Entity X' WHEN 5 THEN 'go there now please' WHEN 6 THEN 'Land' END AS retrieve_entity,
  CASE v WHEN 0 THEN 'because it is there' WHEN 1 THEN 'short' WHEN 3 THEN 'a reason with four words' WHEN 4 THEN 'r' WHEN 5 THEN 'why' ELSE '' END AS reason FROM sufficiency_replies"""))
def parse_sufficiency(fx):
    return fx.rel("sufficiency_replies").select("qid", p.parse_sufficiency(F.col("text")).alias("s")).select("qid", "s.*")


define("reverse_replies", ("reply_base",), """
SELECT qid, a, b, v, CASE v WHEN 0 THEN concat('{"need_reverse": true, "reverse_entity_names": ["', a, '", "', b, '"], "reason": "r"}')
  WHEN 1 THEN concat('{"need_reverse": "yes", "reverse_entity_names": "', a, '; ', b, '"}') WHEN 2 THEN concat('need_reverse: 1\nreverse_entity_names: ', a, ', ', b, '\nreason: r')
  WHEN 3 THEN '{"need_reverse": "perhaps"}' WHEN 4 THEN '{"need_reverse": "0", "reason": "r"}' ELSE '' END AS text FROM reply_base""")


@query("L9_parse_reverse_decision", with_ctes("reverse_replies", """
SELECT qid, v <= 2 AS need_reverse, CASE WHEN v <= 2 THEN concat(a, '|', b) ELSE '' END AS names, CASE WHEN v IN (0, 2, 4) THEN 'r' ELSE '' END AS reason FROM reverse_replies"""))
def parse_reverse_decision(fx):
    out = fx.rel("reverse_replies").select("qid", p.parse_reverse_decision(F.col("text")).alias("d"))
    return out.select("qid", "d.need_reverse", F.array_join("d.names", "|").alias("names"), "d.reason")


define("sub_replies", ("reply_base",), """
SELECT qid, a, b, v, CASE v WHEN 0 THEN concat('["', a, '", "', b, '"]') WHEN 1 THEN concat('{"subquestions": ["', a, '", "', b, '"]}') WHEN 2 THEN concat('- ', a, '\n\n\t• ', b, ' -')
  WHEN 3 THEN concat('[''', a, ''', ''', b, ''']') WHEN 4 THEN concat(a, '\n', b) ELSE '' END AS text FROM reply_base""")


@query("L10_parse_subquestions", with_ctes("sub_replies", """
SELECT qid, CASE WHEN v = 5 THEN '' ELSE concat(a, '|', CASE WHEN v IN (2, 4) THEN regexp_replace(b, '^-+', '') ELSE b END) END AS items FROM sub_replies"""))
def parse_subquestions(fx):
    return fx.rel("sub_replies").select("qid", F.array_join(p.parse_subquestions(F.col("text")), "|").alias("items"))


@query("L11_parse_memory", with_ctes("object_replies", """
SELECT qid, CASE WHEN v IN (0, 1) THEN a END AS x FROM object_replies"""))
def parse_memory(fx):
    memory = p.parse_memory(F.col("text"))
    return fx.rel("object_replies").select("qid", F.get_json_object(memory, "$.x").alias("x"))


define("answer_texts", ("reply_base",), """
SELECT qid, a, b, v, CASE v WHEN 0 THEN concat('["', a, '", "', b, '"]') WHEN 1 THEN concat('[''', a, ''', ''', b, ''']') WHEN 2 THEN concat('[', a, ' , "', b, '", ]') WHEN 3 THEN concat(' ', a, ', ', b) WHEN 4 THEN '[ ]' ELSE ' ' END AS text FROM reply_base""")


@query("L12_split_answer_text", with_ctes("answer_texts", """
SELECT qid, CASE WHEN v <= 2 THEN concat(a, '|', b) WHEN v = 3 THEN concat(a, ', ', b) ELSE '' END AS items FROM answer_texts"""))
def split_answer_text(fx):
    return fx.rel("answer_texts").select("qid", F.array_join(p.split_answer_text(F.col("text")), "|").alias("items"))


@query("L13_parse_quality_report", with_ctes("object_replies ranking_replies", """
SELECT 'object' AS step, CASE WHEN v <= 2 THEN 'ok' WHEN text = '' THEN 'empty' ELSE 'unreadable' END AS parse_status, count(*) AS n FROM object_replies GROUP BY 1, 2
UNION ALL SELECT 'ranking', CASE WHEN v <= 6 THEN 'ok' ELSE 'unreadable' END, count(*) FROM ranking_replies GROUP BY 1, 2"""))
def parse_quality_report(fx):
    def status(good):
        return F.when(good, "ok").when(F.col("text") == "", "empty").otherwise("unreadable").alias("parse_status")
    a = fx.rel("object_replies").select(F.lit("object").alias("step"), status(p.extract_json_object(F.col("text")).isNotNull()))
    b = fx.rel("ranking_replies").select(F.lit("ranking").alias("step"), status(F.coalesce(F.size(p.parse_relation_ranking(F.col("text"))) > 0, F.lit(False))))
    return p.parse_quality_report(a.unionByName(b))
