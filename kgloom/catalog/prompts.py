"""Queries for prompt tables."""

from pyspark.sql import functions as F

from kgloom.catalog import query
from kgloom.catalog.ctes import define, with_ctes
from kgloom.catalog.relations import candidates
from kgloom.functions import prompts as t


@query("T1_render_template", with_ctes("questions", r"""
SELECT qid, concat('Question: ', question, chr(10), 'Facts: ', topic_name, chr(10), 'Reply with the list of fitting names.') AS text FROM questions"""))
def render_template(fx):
    template = F.broadcast(t.template_table(fx.spark))    # one row per step
    return fx.questions.withColumn("step", F.lit("prune_group")).join(template, "step").select("qid", t.render_template(
        F.col("template"), {"question": F.col("question"), "facts": F.col("topic_name")}).alias("text"))


def lists(fx):
    """Head and tail relation lists per path; sizes follow the vocabulary."""
    found = candidates(fx).groupBy("path_id", "qid").agg(
        F.sort_array(F.collect_list(F.when(F.col("fwd"), F.col("rel")))).alias("heads"),
        F.sort_array(F.collect_list(F.when(~F.col("fwd"), F.col("rel")))).alias("tails"))
    chains = fx.chain_paths().withColumnRenamed("path_id", "qid").join(fx.questions.select("qid", "topic_name"), "qid")
    depth = F.when(F.col("path_id").endswith("|1"), 1).otherwise(0)
    return found.join(chains, "qid").withColumn("chain", F.slice("chain", F.lit(1), depth))


define("rel_lists", ("raw_cand", "questions"), """
SELECT c.path_id, q.topic_name, split_part(q.sig, ' ', 1) AS hop, c.path_id LIKE '%|1' AS walked,
  string_agg(rel, '; ' ORDER BY rel) FILTER (WHERE fwd) AS heads, string_agg(rel, '; ' ORDER BY rel) FILTER (WHERE NOT fwd) AS tails
FROM raw_cand c JOIN questions q ON q.qid = c.qid GROUP BY ALL""")


@query("T2_relation_block_directional", with_ctes("rel_lists", r"""
, s AS (SELECT *, concat('TopicEntity(', topic_name, ')') AS topic FROM rel_lists),
p AS (SELECT *, CASE WHEN NOT walked THEN '' WHEN hop LIKE '->%' THEN concat(topic, ' ', substr(hop, 3), ' e1 . ') ELSE concat('e1 ', substr(hop, 3), ' ', topic, ' . ') END AS prefix,
  CASE WHEN walked THEN 'e1' ELSE topic END AS last FROM s)
SELECT path_id, concat(CASE WHEN heads IS NULL THEN '' ELSE concat('# ', prefix, last, ' ?relation ?x', chr(10), heads, ';', chr(10)) END,
  CASE WHEN tails IS NULL THEN '' ELSE concat('# ', prefix, '?x ?relation ', last, chr(10), tails, ';', chr(10)) END) AS block FROM p"""))
def relation_block_directional(fx):
    return lists(fx).select("path_id", t.relation_block_directional(F.col("topic_name"), F.col("chain"), F.col("heads"), F.col("tails")).alias("block"))


@query("T3_relation_block_unified", with_ctes("raw_cand", """
, o AS (SELECT path_id, rel, max(fwd) AS fwd FROM raw_cand GROUP BY path_id, rel)
SELECT path_id, concat('Relations: ', string_agg(rel, '; ' ORDER BY fwd DESC, rel), ';') AS block FROM o GROUP BY path_id"""))
def relation_block_unified(fx):
    return lists(fx).select("path_id", t.relation_block_unified(F.col("heads"), F.col("tails")).alias("block"))


@query("T4_candidate_text", with_ctes("gold", """
, r AS (SELECT qid, gname, row_number() OVER (PARTITION BY qid ORDER BY gname) AS rn, count(*) OVER (PARTITION BY qid) AS n FROM gold)
SELECT qid, concat(string_agg(gname, ', ' ORDER BY gname) FILTER (WHERE rn <= 5), CASE WHEN max(n) > 5 THEN ', ...' ELSE '' END) AS text,
  CAST(max(n) AS INT) AS size_before, CAST(least(5, max(n)) AS INT) AS size_after FROM r GROUP BY qid"""))
def candidate_text(fx):
    """Name lists here are one question's answers, as a prompt would hold them."""
    names = fx.rel("gold").groupBy("qid").agg(F.sort_array(F.collect_list("gname")).alias("names"))
    return names.select("qid", t.candidate_text(F.col("names"), 5).alias("c")).select("qid", "c.*")


@query("T5_evidence_text", with_ctes("beam", """
SELECT qid, string_agg(concat(source_name, ', ', rel, ', ', name), chr(10) ORDER BY beam_pos) AS evidence FROM beam GROUP BY qid"""))
def evidence_text(fx):
    from kgloom.catalog import entities as ec
    from kgloom.operators import entities as e

    chain = e.beam_chain(e.entity_prune(fx.rel("branches"), ec.replies(fx), 3, ec.N, ec.SEED))
    triples = F.collect_list(F.struct(F.lit(1).alias("depth"), F.col("beam_pos").alias("pos"), "head", "rel", "tail"))
    return chain.groupBy("qid").agg(t.evidence_text(triples).alias("evidence"))
