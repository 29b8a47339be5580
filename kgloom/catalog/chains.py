"""Queries for depth-first chain search."""

from pyspark.sql import functions as F

from kgloom.catalog import query
from kgloom.catalog.ctes import define, with_ctes
from kgloom.catalog.sources import question_items
from kgloom.functions import responses as parse
from kgloom.operators import chains as c


@query("C1_init_paths", with_ctes("question_cases", """
SELECT qid, topic_id AS topic, topic_name, '<root>' AS sig, 0 AS depth FROM question_cases WHERE v NOT IN (3, 5, 6)"""))
def init_paths(fx):
    roots = c.init_paths(question_items(fx))
    return roots.select("qid", "topic", "topic_name", c.chain_signature(F.col("chain")).alias("sig"), "depth")


# A tree of paths per order: one node per line, keyed by line number and part.
define("tree", ("questions",), """
SELECT DISTINCT concat('qe-o', l_orderkey) AS qid, l_linenumber AS k1, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE CAST(l_partkey % 5 AS INT) + 1 END AS k2,
  CASE CAST(l_orderkey AS INT) % 3 WHEN 0 THEN 'Forward' ELSE CASE l_linenumber % 5 WHEN 0 THEN 'Stop' WHEN 1 THEN 'Backtrack' WHEN 2 THEN 'Forward' WHEN 3 THEN 'Constraint' ELSE 'UnknownAction' END END AS action FROM lineitem""")
define("tree_keys", ("tree",), "SELECT *, concat(lpad(CAST(k1 AS STRING), 3, '0'), CASE WHEN k2 > 0 THEN concat('.', lpad(CAST(k2 AS STRING), 3, '0')) ELSE '' END) AS code FROM tree")


def tree(fx):
    key = F.when(F.col("k2") > 0, F.array("k1", "k2")).otherwise(F.array("k1"))
    return fx.rel("tree_keys").select("qid", "action", "code", key.alias("dfs_key"), F.size(key).alias("depth"))


@query("C2_expand_paths", with_ctes("kept_rel", """
SELECT qid, concat(CASE WHEN fwd THEN '->' ELSE '<-' END, rel) AS sig, CAST(rank AS STRING) AS key, 1 AS depth FROM kept_rel WHERE path_id LIKE '%|0'"""))
def expand_paths(fx):
    from kgloom.catalog import relations as rc
    from kgloom.operators import relations as r

    kept = r.relation_prune(rc.named_candidates(fx), fx.written("rankings"), rc.KEYS, 1000, 3)
    roots = fx.questions.select("qid", F.concat("qid", F.lit("|0")).alias("path_id"), F.col("topic_id").alias("topic"), "topic_name",
                                F.array().cast(c.CHAIN).alias("chain"), F.array().cast("array<int>").alias("dfs_key"), F.lit(0).alias("depth"))
    out = c.expand_paths(roots, kept, rc.KEYS, 3)
    return out.select("qid", c.chain_signature(F.col("chain")).alias("sig"), F.array_join(F.col("dfs_key").cast("array<string>"), ".").alias("key"), "depth")


@query("C3_dfs_key", with_ctes("tree_keys", """
SELECT a.qid, a.code, max(b.code) AS before FROM tree_keys a LEFT JOIN tree_keys b ON b.qid = a.qid AND b.code < a.code GROUP BY a.qid, a.code"""))
def dfs_key(fx):
    """The path visited just before each path: trees are width-bounded."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy("dfs_key")
    return tree(fx).select("qid", "code", "dfs_key").distinct().select("qid", "code", F.lag("code").over(order).alias("before"))


@query("C4_empty_candidate_action", with_ctes("tree_keys", """
SELECT qid, code, CASE WHEN k2 > 0 THEN 'Backtrack' ELSE 'Forward' END AS empty_action FROM tree_keys"""))
def empty_candidate_action(fx):
    return tree(fx).select("qid", "code", c.empty_candidate_action(F.col("depth"), 2).alias("empty_action"))


define("decisions", ("decision_replies",), "SELECT qid, CASE v WHEN 0 THEN ' STOP' WHEN 1 THEN 'no' WHEN 2 THEN 'Filter ' WHEN 3 THEN 'constraint' WHEN 4 THEN 'backtrack' ELSE 'later' END AS decision, v FROM decision_replies")


@query("C5_decision_to_action", with_ctes("decisions", """
SELECT qid, CASE v WHEN 0 THEN 'Stop' WHEN 1 THEN 'Forward' WHEN 2 THEN 'Constraint' WHEN 3 THEN 'Constraint' WHEN 4 THEN 'Backtrack' ELSE 'UnknownAction' END AS action FROM decisions"""))
def decision_to_action(fx):
    return fx.rel("decisions").select("qid", parse.decision_to_action(F.col("decision")).alias("action"))


@query("C6_first_terminal", with_ctes("tree_keys", """
, w AS (SELECT qid, min(code) AS code FROM tree_keys WHERE action IN ('Stop', 'Constraint', 'ERROR') GROUP BY qid)
SELECT t.qid, t.code, t.action, t.code = w.code AS winner FROM tree_keys t LEFT JOIN w ON w.qid = t.qid WHERE w.code IS NULL OR t.code <= w.code"""))
def first_terminal(fx):
    paths = tree(fx)
    winners = c.first_terminal(paths)
    seen = c.visited_paths(paths, winners)
    best = winners.select("qid", F.col("code").alias("best"))
    return seen.join(best, "qid", "left").select("qid", "code", "action", (F.col("code") == F.col("best")).alias("winner"))


define("gold_lo", ("gold", "questions"), "SELECT q.qid, q.family, q.k, min(gname) AS lo FROM questions q JOIN gold g ON g.qid = q.qid GROUP BY q.qid, q.family, q.k")


def candidates(fx):
    return fx.rel("gold").select("qid", (F.col("gid") == "").alias("is_literal"), F.col("gid").alias("id"), F.col("gname").alias("name"))


@query("C7_stop_results", with_ctes("gold gold_lo", """
, ids AS (SELECT qid, gname, min(gid) AS id FROM gold WHERE gid <> '' GROUP BY qid, gname)
SELECT g.qid, g.gid AS id, g.gname AS name FROM gold g JOIN gold_lo l ON l.qid = g.qid AND k % 2 = 0
UNION ALL SELECT l.qid, coalesce(i.id, ''), l.lo FROM gold_lo l LEFT JOIN ids i ON i.qid = l.qid AND i.gname = l.lo WHERE k % 2 = 1
UNION ALL SELECT qid, '', 'nobody' FROM gold_lo WHERE k % 2 = 1"""))
def stop_results(fx):
    answers = F.when(F.col("k") % 2 == 1, F.array("lo", F.lit(" nobody"), "lo")).otherwise(F.array().cast("array<string>"))
    return c.stop_results(fx.rel("gold_lo").select("qid", answers.alias("answers")), candidates(fx)).select("qid", "id", "name")


@query("C8_constraint_results", with_ctes("gold gold_lo", """
, ids AS (SELECT qid, gname, min(gid) AS id FROM gold WHERE gid <> '' GROUP BY qid, gname)
SELECT l.qid, coalesce(i.id, '') AS id, l.lo AS name FROM gold_lo l LEFT JOIN ids i ON i.qid = l.qid AND i.gname = l.lo WHERE k % 3 <> 0
UNION ALL SELECT qid, '', 'nobody' FROM gold_lo WHERE k % 3 = 1"""))
def constraint_results(fx):
    text = F.when(F.col("k") % 3 == 1, F.concat("lo", F.lit("; nobody,, "), "lo")).when(F.col("k") % 3 == 2, F.col("lo")).otherwise(" ,;")
    return c.constraint_results(fx.rel("gold_lo").select("qid", text.alias("filter_text")), candidates(fx)).select("qid", "id", "name")


@query("C9_direct_answer_fallback", with_ctes("questions", """
SELECT qid, CASE WHEN k % 4 <> 0 THEN topic_name END AS answer FROM questions WHERE k % 3 <> 0"""))
def direct_answer_fallback(fx):
    q = fx.questions
    return c.direct_answer_fallback(q, q.where("k % 3 = 0"), q.where("k % 4 <> 0").select("qid", F.col("topic_name").alias("answer")))


@query("C10_forward_children", with_ctes("tree_keys", "SELECT qid, code FROM tree_keys WHERE action = 'Forward' AND k2 = 0"))
def forward_children(fx):
    return c.forward_children(tree(fx), 2).select("qid", "code")


@query("C11_render_chain", with_ctes("gold_lo questions", r"""
SELECT q.qid, CASE q.family WHEN 'qc' THEN concat('TopicEntity(', topic_name, ') org.customer.nation e1 .', chr(10), 'e1 geo.nation.region e2 .', chr(10), 'e2 candidate.target TargetEntity(', lo, ') .')
  WHEN 'qd' THEN concat('e1 sales.line.part TopicEntity(', topic_name, ') .', chr(10), 'e1 sales.line.supplier e2 .', chr(10), 'e2 org.supplier.nation e3 .', CASE WHEN lo IS NULL THEN '' ELSE concat(chr(10), 'e3 candidate.target TargetEntity(', lo, ') .') END)
  WHEN 'qb' THEN concat('e1 org.customer.nation TopicEntity(', topic_name, ') .', CASE WHEN lo IS NULL THEN '' ELSE concat(chr(10), 'e1 candidate.target TargetEntity(', lo, ') .') END)
  WHEN 'qg' THEN concat('e1 org.supplier.nation TopicEntity(', topic_name, ') .', chr(10), 'e1 candidate.target TargetEntity(', lo, ') .')
  ELSE concat('TopicEntity(', topic_name, ') ', substr(sig, 3), ' e1 .', chr(10), 'e1 candidate.target TargetEntity(', lo, ') .') END AS path
FROM questions q LEFT JOIN gold_lo l ON l.qid = q.qid"""))
def render_chain(fx):
    paths = fx.chain_paths().withColumnRenamed("path_id", "qid").join(fx.questions.select("qid", "topic_name"), "qid")
    return paths.join(fx.rel("gold_lo").select("qid", "lo"), "qid", "left").select(
        "qid", c.render_chain(F.col("topic_name"), F.col("chain"), F.col("lo")).alias("path"))


@query("C12_chain_signature", with_ctes("questions", "SELECT qid, sig FROM questions UNION ALL SELECT concat('root-', qid), '<root>' FROM questions"))
def chain_signature(fx):
    paths = fx.chain_paths()
    roots = paths.select(F.concat(F.lit("root-"), "path_id").alias("path_id"), F.slice("chain", 1, 0).alias("chain"))
    return paths.select("path_id", "chain").unionByName(roots).select(F.col("path_id").alias("qid"), c.chain_signature(F.col("chain")).alias("sig"))


define("answer_lists", ("questions",), "SELECT qid, topic_name, sig, concat(' ', topic_name, ' ;,', sig, ',; ') AS text FROM questions")


@query("C13_split_answers", with_ctes("answer_lists", "SELECT qid, 0 AS pos, topic_name AS answer FROM answer_lists UNION ALL SELECT qid, 1, sig FROM answer_lists"))
def split_answers(fx):
    return fx.rel("answer_lists").select("qid", F.posexplode(c.split_answers(F.col("text"))).alias("pos", "answer"))


@query("C14_search_error_rows", with_ctes("question_cases", """
SELECT qid, 'ERROR' AS action, CASE WHEN v = 5 THEN 'Invalid topic_entities format' ELSE 'No topic_entities provided' END AS reason FROM question_cases WHERE v IN (3, 5, 6)"""))
def search_error_rows(fx):
    return c.search_error_rows(question_items(fx))
