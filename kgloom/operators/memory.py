"""Candidate groups, provenance, memory and re-visits of plan-with-memory search.

Candidate rows: ``qid, depth, visit, rel_rank, topic, topic_name, rel, fwd, id,
name``; a group is one (visited entity, kept relation) of a question's round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.terms import is_entity_id
from kgloom.operators.entities import sample_key
from kgloom.settings import FREEBASE, GraphKind
from kgloom.skew import attach_stats, first_per_group, top_per_group

GROUP = ["qid", "depth", "group_id"]
ROUND = ["qid", "depth"]

# Relations whose groups are always kept whole.
VALUE_RELATIONS = ("time", "number", "date")


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def build_candidate_groups(cand: DataFrame) -> DataFrame:
    """Number the groups of each round from 1 in visit order."""
    heads = cand.groupBy(*ROUND, "visit", "rel_rank").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*ROUND).orderBy("visit", "rel_rank")   # frontier x width groups
    numbered = heads.withColumn("group_id", F.row_number().over(order))
    return attach_stats(cand, numbered, [*ROUND, "visit", "rel_rank"], "_n").drop("_n")


def first_provenance(groups: DataFrame) -> DataFrame:
    """The first (topic, relation, direction) that produced each entity."""
    rows = groups.select(*ROUND, "id", "name", "topic", "topic_name", "rel", "fwd", "group_id")
    return first_per_group(rows, [*ROUND, "id", "name"], [F.col("group_id")])


def group_stats(groups: DataFrame) -> DataFrame:
    keep = (
        (F.col("size") <= 1) | F.col("_digits")
        | F.lower(F.trim("_rel")).isin(*VALUE_RELATIONS)
    )
    return groups.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("size"), F.min(F.col("id").rlike(r"^\d+$")).alias("_digits"),
        F.min(is_entity_id(F.lower("id"), FREEBASE)).alias("all_entities"), F.first("rel").alias("_rel"),
    ).select(*GROUP, "size", "all_entities", keep.alias("keep_all"))


def no_prune_rule(groups: DataFrame) -> DataFrame:
    """Mark groups kept whole: one member, all-digit ids, or a value relation."""
    return attach_stats(groups, group_stats(groups), GROUP, "size")


def sample_mid_group(groups: DataFrame, n: int, seed: str) -> DataFrame:
    """Groups of more than ``n`` entity ids keep ``n`` at random; others stay."""
    big = (F.col("size") > n) & F.col("all_entities") & ~F.col("keep_all")
    drawn = top_per_group(groups.where(big), GROUP, [sample_key(seed, F.col("id")), F.col("id")], n, "_rn")
    return groups.where(~big).unionByName(drawn.drop("_rn"))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors, element by element in double."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def semantic_top_n(cand: DataFrame, keys: list[str], n: int, question_vec: str, name_vec: str) -> DataFrame:
    """Groups above ``n`` keep the ``n`` names closest to the question."""
    sizes = cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    sized = attach_stats(cand, sizes, keys, "_size")
    near = sized.where(F.col("_size") > n).withColumn("similarity", dot(F.col(question_vec), F.col(name_vec)))
    top = top_per_group(near, keys, [F.desc("similarity"), F.col("id")], n, "_rn").drop("_rn")
    rest = sized.where(F.col("_size") <= n).withColumn("similarity", F.lit(None).cast("double"))
    return rest.unionByName(top).drop("_size")


def select_by_name(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen names to group members, ignoring case; unknown names are ignored.

    ``chosen(qid, depth, group_id, names)`` comes from one reply per group.
    """
    wanted = chosen.select(*GROUP, F.posexplode(F.sort_array("names")).alias("pick", "picked"))
    wanted = wanted.select(*GROUP, "pick", name_key(F.col("picked")).alias("_key")).where("_key <> ''")
    members = first_per_group(
        groups.withColumn("_key", name_key(F.coalesce(F.nullif("name", F.lit("")), "id"))),
        [*GROUP, "_key"], [F.col("name"), F.col("id")],
    )
    return wanted.join(members, [*GROUP, "_key"]).drop("_key").withColumn("score", F.lit(1.0))


def group_order(groups: DataFrame) -> DataFrame:
    """Processing order of a round's groups: by number as text, "10" before "2"."""
    heads = groups.select(*GROUP).distinct()
    order = Window.partitionBy(*ROUND).orderBy(F.col("group_id").cast("string"))
    return heads.withColumn("turn", F.row_number().over(order))


def dedupe_entities(kept: DataFrame, order: list[str]) -> DataFrame:
    return first_per_group(kept, ["qid", "id", "name"], [F.col(c) for c in order])


def selected_provenance(kept: DataFrame, provenance: DataFrame) -> DataFrame:
    """Kept entities with the topic, relation and direction they came from."""
    origin = provenance.select(*ROUND, "id", "name", "topic", "topic_name", "rel", "fwd")
    return kept.select(*ROUND, "id", "name", "ord").join(origin, [*ROUND, "id", "name"])


def kept_provenance(groups: DataFrame, order: Column) -> DataFrame:
    """``selected_provenance`` where the kept rows are rows of the groups (those with an ``order``): one aggregate for both."""
    origin = F.struct("topic", "topic_name", "rel", "fwd")
    found = groups.groupBy(*ROUND, "id", "name").agg(F.min(order).alias("ord"), F.min_by(origin, F.struct("group_id")).alias("_o"))
    return found.where("ord is not null").select(*ROUND, "id", "name", "ord", "_o.*")


def quoted_list(names: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def knowledge_triplets(selected: DataFrame) -> DataFrame:
    """One line per (topic, direction, relation) with its kept names."""
    once = first_per_group(
        selected.select(*ROUND, "topic", "topic_name", "fwd", "rel", "id", "name", "ord"),
        [*ROUND, "topic", "fwd", "rel", "id"], [F.col("ord")],
    )
    names = F.transform(F.sort_array(F.collect_list(F.struct("ord", "id", "name"))), lambda s: s["name"])
    return once.groupBy(*ROUND, "topic", "topic_name", "fwd", "rel").agg(names.alias("_names")).select(
        *ROUND, "topic", "fwd", "rel",
        F.concat_ws(", ", "topic_name", "rel", quoted_list(F.col("_names"))).alias("line"),
    )


def knowledge_text(lines: DataFrame) -> DataFrame:
    """All lines of a round, sorted by topic, side ("head" first) and relation."""
    listed = F.sort_array(F.collect_list(F.struct("topic", (~F.col("fwd")).alias("_back"), "rel", "line")))
    return lines.groupBy(*ROUND).agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("triplets"))


def carry_memory(updates: DataFrame) -> DataFrame:
    """Latest parsed memory at each depth (at most one row per depth)."""
    so_far = Window.partitionBy("qid").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return updates.withColumn("memory", F.coalesce(F.last("parsed", ignorenulls=True).over(so_far), F.lit("{}")))


def subquestion_at_depth(subquestions: Column, depth: Column, question: Column) -> Column:
    at = F.least(depth, F.size(subquestions))
    return F.coalesce(F.get(subquestions, at - 1), question)


def stop_veto(sufficient: Column, answer: Column, kind: GraphKind = FREEBASE) -> Column:
    """Stop only on a sufficient, non-empty answer that is no id and no null word."""
    text = F.coalesce(F.trim(answer), F.lit(""))
    return (
        F.coalesce(sufficient, F.lit(False)) & (text != "")
        & ~F.lower(text).isin("null", "none") & ~is_entity_id(text, kind)
    )


def history_minus_current(seen: DataFrame, current: DataFrame) -> DataFrame:
    """Names seen so far without those kept now, ignoring case."""
    now = current.select("qid", name_key(F.col("name")).alias("_key")).distinct()
    past = seen.select("qid", "name").distinct().withColumn("_key", name_key(F.col("name")))
    return past.join(now, ["qid", "_key"], "left_anti").select("qid", "name")


def round_context(groups: DataFrame) -> DataFrame:
    """Sorted head names, tail names and relations of a round."""
    heads = groups.select(*ROUND, F.lit("head").alias("role"), F.col("topic_name").alias("value"))
    tails = groups.select(*ROUND, F.lit("tail").alias("role"), F.col("name").alias("value"))
    rels = groups.select(*ROUND, F.lit("relation").alias("role"), F.col("rel").alias("value"))
    return heads.unionByName(tails).unionByName(rels).distinct()


def first_reach(history: DataFrame) -> DataFrame:
    """Where each entity first appeared: depth, topic, side ("head" first), relation."""
    best = F.min(F.struct("depth", "topic", (~F.col("fwd")).alias("back"), "rel"))
    return history.groupBy("qid", "id").agg(best.alias("b")).select(
        "qid", "id", "b.depth", "b.topic", (~F.col("b.back")).alias("fwd"), "b.rel"
    )


def reverse_frontier(kept: DataFrame, revisits: DataFrame, requested: DataFrame,
                     known: DataFrame, reach: DataFrame, rounds: int = 5) -> DataFrame:
    """Next frontier: kept, then named re-visits, then the requested entity.

    ``kept(qid, ord, id, name, pre_rel, pre_fwd)``, ``revisits(qid, pos, name,
    round)``, ``requested(qid, name)``, ``known(qid, id, name)`` one entity per
    name key, ``reach`` from ``first_reach``.  Rows carry their own direction.
    """
    by_name = known.withColumn("_key", name_key(F.col("name")))
    again = (
        revisits.where(F.col("round") <= rounds)
        .select("qid", "pos", name_key(F.col("name")).alias("_key")).join(by_name, ["qid", "_key"])
        .join(reach.select("qid", "id", F.col("rel").alias("pre_rel"), F.col("fwd").alias("pre_fwd")), ["qid", "id"], "left")
        .select("qid", F.lit(1).alias("src"), F.col("pos").alias("ord"), "id", "name",
                F.coalesce("pre_rel", F.lit("")).alias("pre_rel"), "pre_fwd")
    )
    asked = (
        requested.select("qid", name_key(F.col("name")).alias("_key")).join(by_name, ["qid", "_key"])
        .select("qid", F.lit(2).alias("src"), F.lit(0).alias("ord"), "id", "name",
                F.lit("").alias("pre_rel"), F.lit(None).cast("boolean").alias("pre_fwd"))
    )
    now = kept.select("qid", F.lit(0).alias("src"), "ord", "id", "name", "pre_rel", "pre_fwd")
    pooled = now.unionByName(again).unionByName(asked)
    return first_per_group(pooled, ["qid", "id", "name"], [F.col("src"), F.col("ord")])


def answers_to_results(answers: DataFrame, known: DataFrame, kind: GraphKind = FREEBASE) -> DataFrame:
    """Answer texts ``(qid, pos, answer)`` to result items; ids only if known."""
    by_name = known.select("qid", name_key(F.col("name")).alias("_key"), F.col("id").alias("_id"), F.col("name").alias("_name"))
    hit = answers.withColumn("_key", name_key(F.col("answer"))).join(by_name, ["qid", "_key"], "left")
    entity = F.coalesce(is_entity_id(F.col("_id"), kind), F.lit(False))
    return hit.select(
        "qid", "pos", F.when(entity, F.col("_id")).otherwise("").alias("id"),
        F.when(entity, F.col("_name")).otherwise(F.col("answer")).alias("name"),
    )


def first_by_name(groups: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate per case-free name, in group then list order."""
    named = groups.withColumn("_key", name_key(F.col("name"))).where("_key <> ''")
    return first_per_group(named, [*keys, "_key"], [F.col("group_id"), F.col("name"), F.col("id")])


def score_by_relevance_list(groups: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Names with scores to known entities, renormalised to sum to 1.

    ``replies(keys, names, scores)``: missing score 1, negative 0, first per id.
    """
    items = replies.select(*keys, F.posexplode("names").alias("pos", "_n"), "scores").select(
        *keys, "pos", name_key(F.col("_n")).alias("_key"),
        F.greatest(F.lit(0.0), F.coalesce(F.get("scores", F.col("pos")), F.lit(1.0))).alias("weight"),
    )
    known = first_by_name(groups, keys).select(*keys, "_key", "id", "name")
    hits = first_per_group(items.join(known, [*keys, "_key"]).drop("_key"), [*keys, "id"], [F.col("pos")])
    reply = Window.partitionBy(*keys)                        # reply-sized groups
    total, n = F.sum("weight").over(reply), F.count(F.lit(1)).over(reply)
    return hits.withColumn("score", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(1.0) / n)).drop("weight")


def mentioned_or_first3(groups: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Entities named in a text, else the first three, with uniform score."""
    known = first_by_name(groups, keys).join(texts, keys)
    said = known.where(F.lower("text").contains(F.col("_key")))
    silent = known.join(said.select(*keys).distinct(), keys, "left_anti")
    first3 = top_per_group(silent, keys, [F.col("group_id"), F.col("name"), F.col("id")], 3, "_rn").drop("_rn")
    picked = said.unionByName(first3)
    sizes = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return attach_stats(picked, sizes, keys, "n").select(*keys, "id", "name", (F.lit(1.0) / F.col("n")).alias("score"))
