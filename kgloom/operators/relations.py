"""Relation candidates and rankings: prune, cap, resolve, rank, keep top k.

Candidates are rows ``(keys, fwd, rel[, name])``; a ranking is rows
``(keys, pos, text, rank, score)`` as read from one reply.  ``keys`` names one
retrieval, usually ``qid, path_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.responses import let
from kgloom.skew import first_per_group, top_per_group


def prune_inverse_of_last_hop(cand: DataFrame) -> DataFrame:
    """Never walk straight back over the relation just taken."""
    back = (F.col("rel") == F.col("last_rel")) & (F.col("fwd") != F.col("last_fwd"))
    return cand.where(~F.coalesce(back, F.lit(False)))


def prune_previous_relations(cand: DataFrame, previous: DataFrame) -> DataFrame:
    """Beam form: an entity reached forward loses every previous relation of its
    question on the tail side, and the mirror; unknown direction loses none."""
    before = previous.select(F.col("qid").alias("_q"), F.col("rel").alias("_r")).distinct()
    return cand.join(
        before,
        (F.col("qid") == F.col("_q")) & (F.col("rel") == F.col("_r")) & (F.col("fwd") != F.col("pre_fwd")),
        "left_anti",
    )


def unique_sorted_relations(cand: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct relations per direction, ascending (bounded by the vocabulary)."""
    return cand.groupBy(*keys, "fwd").agg(F.sort_array(F.collect_set("rel")).alias("relations"))


def cap_relations(cand: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """First ``limit`` of the head list followed by the tail list."""
    return top_per_group(cand, keys, [F.desc("fwd"), F.col("rel")], max(1, int(limit)), "_rn").drop("_rn")


def relation_lists(cand: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted head and tail lists per retrieval.

    ``cand`` rows are distinct relations, so a list is bounded by the relation
    vocabulary of the graph, whatever the number of edges.
    """
    return cand.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(F.col("fwd"), F.col("rel")))).alias("heads"),
        F.sort_array(F.collect_set(F.when(~F.col("fwd"), F.col("rel")))).alias("tails"))


def cap_lists(df: DataFrame, limit: int) -> DataFrame:
    """Cap head list plus tail list at ``limit`` and add the size before."""
    limit = max(1, int(limit))
    room = F.greatest(F.lit(0), limit - F.size("heads"))
    return df.withColumns({
        "size_before": F.size("heads") + F.size("tails"),
        "heads": F.slice("heads", 1, limit), "tails": F.slice("tails", F.lit(1), room),
    }).where("size_before > 0")


def without_way_back(heads: Column, tails: Column, last: Column) -> tuple[Column, Column]:
    """Both lists without the inverse of the last hop."""
    up, down = F.coalesce(last["fwd"], F.lit(False)), F.coalesce(~last["fwd"], F.lit(False))
    return (F.when(down, F.array_remove(heads, last["id"])).otherwise(heads),
            F.when(up, F.array_remove(tails, last["id"])).otherwise(tails))


def resolve_relation_names(ranking: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked text to relation id: an id stays, a unique display name maps."""
    ids = cand.select(*keys, F.col("rel").alias("text"), F.lit(True).alias("_is_id")).distinct()
    names = (
        cand.where(F.trim("name") != "").groupBy(*keys, F.trim("name").alias("text"))
        .agg(F.min("rel").alias("_lo"), F.max("rel").alias("_hi"))
        .where("_lo = _hi").select(*keys, "text", "_lo")
    )
    return (
        ranking.join(ids, keys + ["text"], "left").join(names, keys + ["text"], "left")
        .withColumn("rel", F.when(F.col("_is_id"), F.col("text")).otherwise(F.coalesce("_lo", "text")))
        .select(*ranking.columns, "rel")
    )


def valid_rank(rank: Column) -> Column:
    number = rank.try_cast("int")
    return F.when(number >= 1, number)


def rank_relations(ranking: DataFrame, keys: list[str]) -> DataFrame:
    """Order of a reply: explicit rank first, then position (reply-sized groups)."""
    w = Window.partitionBy(*keys).orderBy(valid_rank(F.col("rank")).asc_nulls_last(), "pos")
    return ranking.withColumn("ord", F.row_number().over(w))


def dedupe_ranked(ranking: DataFrame, keys: list[str]) -> DataFrame:
    return first_per_group(ranking, keys + ["rel"], [F.col("ord")])


def assign_direction(ranking: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """Head side wins; a relation that is no candidate is dropped."""
    sides = cand.groupBy(*keys, "rel").agg(F.max("fwd").alias("fwd"))
    return ranking.join(sides, keys + ["rel"])


def clamp_score(score: Column) -> Column:
    number = score.try_cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), F.lit(0.0))


def top_k_relations(ranked: DataFrame, keys: list[str], k: int) -> DataFrame:
    return top_per_group(ranked, keys, [F.col("ord")], max(1, int(k)), "rank")


def expand_bidirectional(kept: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """A kept relation on both sides gives both directions, ranked one first."""
    sides = cand.groupBy(*keys, "rel").agg((F.min("fwd") != F.max("fwd")).alias("_both"))
    ways = F.when(F.col("_both"), F.array(F.col("fwd"), ~F.col("fwd"))).otherwise(F.array("fwd"))
    opened = (
        kept.join(sides, keys + ["rel"], "left").select(*kept.columns, F.posexplode(ways).alias("_way", "_dir"))
        .drop("fwd").withColumnRenamed("_dir", "fwd")
    )
    first = first_per_group(opened, keys + ["rel", "fwd"], [F.col("rank"), F.col("_way")])
    order = Window.partitionBy(*keys).orderBy("rank", "_way")   # at most 2 x width rows
    return first.withColumn("rank", F.row_number().over(order)).drop("_way").select(*kept.columns)


def relation_prune(cand: DataFrame, ranking: DataFrame, keys: list[str], limit: int, k: int) -> DataFrame:
    """Cap, read the ranking, give directions and keep ``k`` per retrieval.

    ``cand`` carries ``last_rel, last_fwd``; the result has the kept relations
    with ``size_before`` and ``size_after``.
    """
    shown = cap_relations(cand, keys, limit)
    named = resolve_relation_names(ranking, shown, keys)
    ranked = dedupe_ranked(rank_relations(named, keys), keys)
    last = shown.groupBy(*keys).agg(F.first("last_rel").alias("last_rel"), F.first("last_fwd").alias("last_fwd"))
    placed = prune_inverse_of_last_hop(assign_direction(ranked, shown, keys).join(last, keys))
    top = top_k_relations(placed, keys, k).select(
        *keys, "rel", "fwd", clamp_score(F.col("score")).alias("score"), "rank"
    )
    before = cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("size_before"))
    after = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("size_after"))
    return top.join(before, keys).join(after, keys)


def prune_reply(ranking: Column, heads: Column, tails: Column, k: int, last: Column | None = None,
                unique_names: Column | None = None, both_ways: bool = False) -> Column:
    """The same pruning inside one row: a retrieval's lists and its reply.

    ``ranking`` is array<struct<pos,text,rank,score>>, ``heads`` and ``tails``
    the listed relation ids, ``last`` struct<id,fwd>.  Needs no shuffle, so the
    searches use it; the list sizes are bounded by the relation cap.  Returns
    array<struct<rank,rel,fwd,score>>.
    """
    order = F.sort_array(F.transform(ranking, lambda e: F.struct(
        F.coalesce(valid_rank(e["rank"]), F.lit(2**31 - 1)).alias("o"), e["pos"].alias("pos"),
        e["text"].alias("text"), clamp_score(e["score"]).alias("score"))))

    def listed(text):
        return F.array_contains(heads, text) | F.array_contains(tails, text)

    def resolve(e):
        other = e["text"] if unique_names is None else F.coalesce(F.try_element_at(unique_names, e["text"]), e["text"])
        return F.struct(F.when(listed(e["text"]), e["text"]).otherwise(other).alias("rel"), e["score"].alias("score"))

    def first_of_each(rows):
        return let(F.transform(rows, lambda e: e["rel"]), lambda seen: F.filter(
            rows, lambda e, i: F.array_position(seen, e["rel"]) == i + 1))

    known = F.filter(F.transform(order, resolve), lambda e: listed(e["rel"]))
    placed = F.transform(let(known, first_of_each), lambda e: F.struct(
        e["rel"].alias("rel"), F.array_contains(heads, e["rel"]).alias("fwd"), e["score"].alias("score")))
    if last is not None:
        placed = F.filter(placed, lambda e: ~F.coalesce((e["rel"] == last["id"]) & (e["fwd"] != last["fwd"]), F.lit(False)))
    kept = F.slice(placed, 1, max(1, int(k)))
    if both_ways:
        def sides(e):
            both = F.array_contains(heads, e["rel"]) & F.array_contains(tails, e["rel"])
            mirror = F.struct(e["rel"].alias("rel"), (~e["fwd"]).alias("fwd"), e["score"].alias("score"))
            return F.when(both, F.array(e, mirror)).otherwise(F.array(e))

        kept = F.flatten(F.transform(kept, sides))
    return F.transform(kept, lambda e, i: F.struct(
        (i + 1).alias("rank"), e["rel"].alias("rel"), e["fwd"].alias("fwd"), e["score"].alias("score")))
