"""Depth-first chain search, set at a time.

A path is one relation chain of a question.  ``dfs_key`` holds the sibling rank
of each hop, so comparing keys as arrays gives the visit order of the
sequential search (a parent before its children, best sibling first).
Path tables have at most a few hundred rows per question (width and depth).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.prompts import chain_nodes, last_node
from kgloom.skew import first_per_group

CHAIN = "array<struct<id:string,fwd:boolean>>"


def init_paths(questions: DataFrame) -> DataFrame:
    """One root path per question, at its first usable topic entity."""
    first = F.get(F.filter("topic_entity", lambda t: (F.coalesce(t["id"], F.lit("")) != "") & (F.coalesce(t["name"], F.lit("")) != "")), F.lit(0))
    rows = questions.withColumn("_t", first).where(F.col("_t").isNotNull())
    return rows.select(
        "qid", F.col("_t.id").alias("topic"), F.col("_t.name").alias("topic_name"),
        F.array().cast(CHAIN).alias("chain"), F.array().cast("array<int>").alias("dfs_key"), F.lit(0).alias("depth"),
    )


def expand_paths(paths: DataFrame, kept: DataFrame, keys: list[str], max_depth: int) -> DataFrame:
    """Append each kept relation ``(keys, rel, fwd, rank)``; none at the bottom."""
    hop = F.struct(F.col("rel").alias("id"), F.col("fwd"))
    return paths.where(F.col("depth") < max_depth).join(kept.select(*keys, "rel", "fwd", "rank"), keys).select(
        "qid", "topic", "topic_name", F.array_append("chain", hop).alias("chain"),
        F.array_append("dfs_key", F.col("rank").cast("int")).alias("dfs_key"), (F.col("depth") + 1).alias("depth"),
    )


def empty_candidate_action(depth: Column, max_depth: int) -> Column:
    return F.when(depth >= max_depth, "Backtrack").otherwise("Forward")


def is_terminal(action: Column) -> Column:
    return action.isin("Stop", "Constraint", "ERROR")


def first_terminal(paths: DataFrame) -> DataFrame:
    """Per question the first stopping path in visit order."""
    return first_per_group(paths.where(is_terminal(F.col("action"))), ["qid"], [F.col("dfs_key")])


def visited_paths(paths: DataFrame, winners: DataFrame) -> DataFrame:
    """Paths a sequential search would have seen: none after the winner."""
    last = winners.select("qid", F.col("dfs_key").alias("_last"))
    return paths.join(last, "qid", "left").where(F.col("_last").isNull() | (F.col("dfs_key") <= F.col("_last"))).drop("_last")


def answers_to_ids(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answer texts ``(qid, pos, answer)`` to items; first id per exact name."""
    ids = candidates.where("NOT is_literal").groupBy("qid", F.trim("name").alias("_n")).agg(F.min("id").alias("_id"))
    named = answers.withColumn("_n", F.trim("answer")).where("_n <> ''").join(ids, ["qid", "_n"], "left")
    items = named.select("qid", "pos", F.coalesce("_id", F.lit("")).alias("id"), F.col("_n").alias("name"))
    return first_per_group(items, ["qid", "id", "name"], [F.col("pos")])


def mentions_to_ids(answers: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Answer texts ``(keys, pos, answer)`` of a list that shows a name once for each candidate.

    The second mention of a name is its second id, and so on; a mention beyond the
    last id is the last one's.
    """
    same = Window.partitionBy(*keys, "_n")
    said = answers.withColumn("_n", F.trim("answer")).where("_n <> ''").withColumn("_at", F.row_number().over(same.orderBy("pos")))
    ids = candidates.where("NOT is_literal").select(*keys, F.trim("name").alias("_n"), F.col("id").alias("_id")).distinct()
    ids = ids.withColumns({"_at": F.row_number().over(same.orderBy("_id")), "_of": F.count(F.lit(1)).over(same)})
    known = ids.where("_at = 1").select(*keys, "_n", "_of")
    named = said.join(known, [*keys, "_n"], "left").withColumn("_at", F.least("_at", "_of")).join(
        ids.drop("_of"), [*keys, "_n", "_at"], "left")
    items = named.select("qid", "pos", F.coalesce("_id", F.lit("")).alias("id"), F.col("_n").alias("name"))
    return first_per_group(items, ["qid", "id", "name"], [F.col("pos")])


def stop_results(winners: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items of stopped questions: given answers, else all their candidates.

    ``winners(qid, answers)``; ``candidates(qid, is_literal, id, name)`` belong
    to the winning path.
    """
    given = winners.where(F.size("answers") > 0).select("qid", F.posexplode("answers").alias("pos", "answer"))
    open_ = winners.where(F.size("answers") == 0).select("qid")
    every = candidates.join(open_, "qid", "left_semi").where(F.trim("name") != "").select(
        "qid", F.col("is_literal").cast("int").alias("pos"), "id", F.trim("name").alias("name"))
    return answers_to_ids(given, candidates).unionByName(every.dropDuplicates(["qid", "id", "name"]))


def constraint_results(winners: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items of filtered questions; an empty filter reply leaves none."""
    given = winners.select("qid", F.posexplode(split_answers(F.col("filter_text"))).alias("pos", "answer"))
    return answers_to_ids(given, candidates)


def paged_results(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items of questions that were filtered page by page.

    ``replies(qid, page, start, filter_text)``, where ``start`` counts the answers of
    the pages before; ``candidates(qid, page, is_literal, id, name)``.
    """
    given = replies.select("qid", "page", "start", F.posexplode(split_answers(F.col("filter_text"))).alias("pos", "answer"))
    return mentions_to_ids(given.withColumn("pos", F.col("pos") + F.col("start")).drop("start"), candidates, ["qid", "page"])


def split_answers(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def direct_answer_fallback(questions: DataFrame, settled: DataFrame, replies: DataFrame) -> DataFrame:
    """Direct answers ``(qid, answer)`` for questions no path settled."""
    open_ = questions.select("qid").join(settled.select("qid"), "qid", "left_anti")
    return open_.join(replies.select("qid", "answer"), "qid", "left")


def forward_children(paths: DataFrame, max_depth: int) -> DataFrame:
    """Paths that are walked on from: Forward and above the bottom."""
    return paths.where((F.col("action") == "Forward") & (F.col("depth") < max_depth))


def chain_signature(chain: Column) -> Column:
    parts = F.transform(chain, lambda h: F.concat(F.when(h["fwd"], "->").otherwise("<-"), h["id"]))
    return F.when(F.size(chain) == 0, "<root>").otherwise(F.array_join(parts, " "))


def render_chain(topic_name: Column, chain: Column, targets: Column | None = None, names: Column | None = None) -> Column:
    """Chain as lines, with a last line naming the targets if there are any; ``names`` shows relations by name."""
    lines = chain_nodes(topic_name, chain, names)
    if targets is not None:
        end = F.concat(last_node(topic_name, chain), F.lit(" candidate.target TargetEntity("), targets, F.lit(") ."))
        lines = F.when(F.coalesce(targets, F.lit("")) != "", F.array_append(lines, end)).otherwise(lines)
    return F.array_join(lines, "\n")


def search_error_rows(questions: DataFrame) -> DataFrame:
    """Questions that cannot start: no topic entity, or none usable."""
    none = F.coalesce(F.size("topic_entity"), F.lit(0)) <= 0
    # Action and reasons, as result files carry them.
    bad = ~F.exists(F.coalesce("topic_entity", F.array()), lambda t: (F.coalesce(t["id"], F.lit("")) != "") & (F.coalesce(t["name"], F.lit("")) != ""))
    return questions.where(none | bad).select(
        "qid", F.lit("ERROR").alias("action"),
        F.when(none, "No topic_entities provided").otherwise("Invalid topic_entities format").alias("reason"))
