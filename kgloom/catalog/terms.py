"""Queries for term normalisation and predicates."""

from pyspark.sql import functions as F

from kgloom.catalog import query
from kgloom.catalog.ctes import define, with_ctes
from kgloom.functions import terms
from kgloom.operators import retrieval
from kgloom.settings import FREEBASE, WIKIDATA

# Term texts in every accepted spelling, for all triples.
define("term_texts", ("triples",), """
SELECT subj, pred, obj, obj_kind,
  CASE length(subj) % 4 WHEN 0 THEN concat('http://rdf.freebase.com/ns/', subj)
    WHEN 1 THEN concat('  http://rdf.freebase.com/ns/', subj, ' ') WHEN 2 THEN subj ELSE concat(' ', subj) END AS fb_uri,
  CASE length(subj) % 4 WHEN 0 THEN concat('http://www.wikidata.org/entity/Q', length(obj))
    WHEN 1 THEN concat('wd:Q', length(obj)) WHEN 2 THEN concat(' Q', length(obj)) ELSE concat('http://www.wikidata.org/prop/direct/P', length(obj)) END AS wd_uri
FROM triples""")
define("pred_texts", ("relation_labels",), """
SELECT DISTINCT pred, rel FROM relation_labels""")
define("rel_uris", ("triples", "pred_texts"), """
SELECT t.subj, p.rel, concat('http://rdf.freebase.com/ns/', t.pred) AS fb_uri,
  CASE length(t.subj) % 5 WHEN 0 THEN concat('http://www.wikidata.org/prop/direct/', p.rel)
    WHEN 1 THEN concat('http://www.wikidata.org/prop/statement/', p.rel) WHEN 2 THEN concat('wdt:', p.rel)
    WHEN 3 THEN concat(' ', p.rel, ' ') ELSE '  ' END AS wd_uri
FROM triples t JOIN pred_texts p ON t.pred = p.pred""")


@query("N1_strip_entity_uri", with_ctes("term_texts", """
SELECT subj AS fb_id, CASE WHEN length(subj) % 4 = 3 THEN concat('P', length(obj)) ELSE concat('Q', length(obj)) END AS wd_id, count(*) AS n
FROM term_texts GROUP BY 1, 2"""))
def strip_entity_uri(fx):
    return fx.rel("term_texts").select(
        terms.strip_entity_uri(F.col("fb_uri"), FREEBASE).alias("fb_id"),
        terms.strip_entity_uri(F.col("wd_uri"), WIKIDATA).alias("wd_id"),
    ).groupBy("fb_id", "wd_id").agg(F.count(F.lit(1)).alias("n"))


@query("N2_strip_relation_uri", with_ctes("rel_uris", """
SELECT replace(fb_uri, 'http://rdf.freebase.com/ns/', '') AS fb_rel, rel AS wd_rel, count(*) AS n
FROM rel_uris WHERE length(subj) % 5 <> 4 GROUP BY 1, 2"""))
def strip_relation_uri(fx):
    return fx.rel("rel_uris").select(
        terms.strip_relation_uri(F.col("fb_uri"), FREEBASE).alias("fb_rel"),
        terms.strip_relation_uri(F.col("wd_uri"), WIKIDATA).alias("wd_rel"),
    ).where("wd_rel IS NOT NULL").groupBy("fb_rel", "wd_rel").agg(F.count(F.lit(1)).alias("n"))


define("odd_terms", ("triples",), """
SELECT subj, pred, CASE WHEN length(subj) % 7 = 0 THEN '  ' ELSE concat(' ', obj) END AS value,
  CASE WHEN length(subj) % 5 = 0 THEN 'bnode' ELSE obj_kind END AS kind FROM triples""")


@query("N3_split_terms", with_ctes("odd_terms", """
SELECT subj, pred, trim(value) AS value, kind IN ('literal', 'typed-literal') AS is_literal FROM odd_terms
WHERE trim(value) <> '' AND kind <> 'bnode'"""))
def split_terms(fx):
    return terms.split_terms(fx.rel("odd_terms"), "value", "kind").drop("kind")


define("id_texts", ("triples", "relation_labels"), """
SELECT obj AS id FROM triples UNION SELECT subj FROM triples
UNION SELECT concat('Q', length(obj), substr(obj, 1, length(obj) % 2)) FROM triples UNION SELECT rel FROM relation_labels""")


@query("N4_is_entity_id", with_ctes("id_texts", """
SELECT id, id LIKE 'm.%' OR id LIKE 'g.%' AS freebase_id,
  substr(id, 1, 1) = 'Q' AND length(id) > 1 AND try_cast(substr(id, 2) AS BIGINT) IS NOT NULL AS wikidata_id FROM id_texts"""))
def is_entity_id(fx):
    return fx.rel("id_texts").select(
        "id", terms.is_entity_id(F.col("id"), FREEBASE).alias("freebase_id"),
        terms.is_entity_id(F.col("id"), WIKIDATA).alias("wikidata_id"))


@query("N5_keep_property_ids", with_ctes("id_texts", """
SELECT id FROM id_texts WHERE regexp_full_match(trim(id), 'P[0-9]+')"""))
def keep_property_ids(fx):
    return terms.keep_property_ids(fx.rel("id_texts"), "id")


define("uri_names", ("triples",), """
SELECT subj, pred, obj_kind, CASE obj_kind WHEN 'uri' THEN concat('http://example.org/a#b#', subj)
  WHEN 'literal' THEN concat('https://example.org/x/', subj, '//') ELSE concat(' ', subj) END AS uri FROM triples""")


@query("N6_fallback_relation_name", with_ctes("uri_names", """
SELECT uri, subj AS name, count(*) AS n FROM uri_names GROUP BY 1, 2"""))
def fallback_relation_name(fx):
    return fx.rel("uri_names").groupBy(
        "uri", terms.fallback_relation_name(F.col("uri")).alias("name")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("N7_drop_schema_relations_freebase", with_ctes("triples", """
SELECT subj, pred, obj FROM triples WHERE pred NOT IN ('type.object.type', 'type.object.name')
  AND pred NOT LIKE 'common.%' AND pred NOT LIKE 'freebase.%' AND pred NOT LIKE '%sameAs%'"""))
def drop_schema_freebase(fx):
    return terms.drop_schema_relations(fx.rel("triples"), "pred", FREEBASE).select("subj", "pred", "obj")


@query("N8_drop_schema_relations_wikidata", with_ctes("triples pred_texts", """
SELECT subj, rel, obj FROM triples JOIN pred_texts USING (pred) WHERE rel NOT IN ('P373', 'P910')"""))
def drop_schema_wikidata(fx):
    named = fx.rel("triples").join(fx.rel("pred_texts"), "pred")
    return terms.drop_schema_relations(named, "rel", WIKIDATA).select("subj", "rel", "obj")


define("rel_best", ("relation_labels",), """
SELECT pred, rel, max(CASE WHEN lang = 'en' THEN label END) AS label FROM relation_labels GROUP BY pred, rel""")


@query("N9_drop_noisy_labels", with_ctes("adj rel_best", """
, cand AS (SELECT DISTINCT node, fwd, rel, label FROM adj JOIN rel_best USING (pred)),
flag AS (SELECT *, coalesce(label, rel) IN ('customer identifier', 'logo image') AS noisy FROM cand),
grp AS (SELECT node, fwd, bool_and(noisy) AS all_noisy FROM flag GROUP BY node, fwd)
SELECT node, fwd, rel FROM flag JOIN grp USING (node, fwd) WHERE NOT noisy OR all_noisy"""))
def drop_noisy_labels(fx):
    cand = fx.graph.summary.join(F.broadcast(fx.rel("rel_best")), "pred").select("node", "fwd", "rel", "label")
    return terms.drop_noisy_labels(cand, ["node", "fwd"], "rel", "label").select("node", "fwd", "rel")


@query("N10_keep_entity_prefix", with_ctes("triples", """
SELECT obj, 'auto' AS rule FROM triples WHERE obj_kind = 'uri' AND obj LIKE 'm.%'
UNION ALL SELECT obj, 'g.' FROM triples WHERE obj_kind = 'uri' AND obj LIKE 'g.%'
UNION ALL SELECT obj, 'all' FROM triples WHERE obj_kind = 'uri'"""))
def keep_entity_prefix(fx):
    ids = fx.rel("triples").where("obj_kind = 'uri'").select("obj")
    auto = terms.keep_entity_prefix(ids, "obj", FREEBASE).withColumn("rule", F.lit("auto"))
    g = terms.keep_entity_prefix(ids, "obj", FREEBASE, "g.").withColumn("rule", F.lit("g."))
    return auto.unionByName(g).unionByName(
        terms.keep_entity_prefix(ids, "obj", FREEBASE, None).withColumn("rule", F.lit("all")))


@query("N11_drop_unnamed", with_ctes("triples kg_labels", """
SELECT DISTINCT obj AS id FROM triples WHERE obj_kind = 'uri' AND obj IN (SELECT id FROM kg_labels)"""))
def drop_unnamed(fx):
    ids = fx.rel("triples").where("obj_kind = 'uri'").select(F.col("obj").alias("id")).distinct()
    named = retrieval.batch_labels(ids, fx.graph.labels, FREEBASE)
    return terms.drop_unnamed(named, "name").select("id")


@query("N12_distinct_first_order", """
SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY l_suppkey, l_partkey""")
def distinct_first_order(fx):
    rows = fx["lineitem"].select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return terms.distinct_first_order(rows, ["l_suppkey", "l_partkey"], "pos")
