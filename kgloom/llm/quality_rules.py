"""Operator 7: quality rules with host-level verdicts (DataFrame functions only).

Document rules are array expressions inside one row, so they need no exchange.
Each host (``source``) then gets its share of failing documents, shrunk towards
the mean of all hosts with a beta prior fitted to the hosts by moments, so that
hosts with few documents are not judged by chance.  A document that breaks only
a soft rule is rejected if its host's shrunk rate is above ``host_limit``; one
that breaks no rule always stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import native_words, staged, table

SHORT_WORDS = 10        # base: fewer words fail
REPEAT_PERCENT = 20     # base: a larger share of words in repeated 5-word windows fails
SYMBOL_PERCENT = 10     # soft: symbols against word characters
DUP_LINE_PERCENT = 30   # soft: repeated lines against lines with a word
HOST_LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
_OWN = ["_q_n_words", "_q_word_chars", "_q_n_symbols", "_q_n_dup_lines", "_q_n_repeat_words", "_q_base_failed", "_q_soft_failed"]


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the figures and flags of the document rules in columns _q_*."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_q_w")
    grams = F.transform(
        F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("_q_h", i + k) for k in range(5)]))
    near = lambda i: F.get("_q_s", i)["h"]
    again = F.filter("_q_s", lambda x, i: F.coalesce(near(i - 1) == x["h"], F.lit(False))
                     | F.coalesce(near(i + 1) == x["h"], F.lit(False)))
    gap = F.zip_with("_q_p", F.slice("_q_p", F.lit(2), F.greatest(F.size("_q_p"), F.lit(1))),
                     lambda a, b: F.least(F.lit(5), b - a))
    joined = F.array_join("_q_w", "")
    out = (
        docs.withColumn("_q_w", native_words(F.col(text)))
        .withColumn("_q_l", lines)
        .withColumns({
            "_q_h": F.transform("_q_w", lambda w: F.xxhash64(w)),
            "_q_j": joined,
            "_q_n_lines": F.size("_q_l").cast("long"),
            "_q_n_dup_lines": (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"),
        })
        .withColumn("_q_g", F.when(n >= 5, grams).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_q_g", F.when(F.size(F.array_distinct("_q_g")) < F.size("_q_g"), F.col("_q_g")))
        .withColumn("_q_s", F.sort_array(F.transform("_q_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .withColumn("_q_p", F.sort_array(F.transform(again, lambda x: x["i"])))
        .withColumns({
            "_q_n_words": n.cast("long"),
            "_q_word_chars": F.length("_q_j").cast("long"),
            "_q_n_symbols": (F.length("_q_j") - F.length(F.translate("_q_j", SYMBOLS, ""))).cast("long"),
            "_q_n_repeat_words": F.coalesce(F.aggregate(gap, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        })
    )
    base = (F.col("_q_n_words") < SHORT_WORDS) | (100 * F.col("_q_n_repeat_words") > REPEAT_PERCENT * F.col("_q_n_words"))
    soft = (100 * F.col("_q_n_symbols") > SYMBOL_PERCENT * F.col("_q_word_chars")) | (
        100 * F.col("_q_n_dup_lines") > DUP_LINE_PERCENT * F.col("_q_n_lines"))
    return out.withColumns({"_q_base_failed": base, "_q_soft_failed": soft}).select(*docs.columns, *_OWN)


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(host, shrunk): each host's failure rate under the fitted beta prior."""
    hosts = measured.groupBy(host).agg(
        F.count("*").alias("n"), F.count_if(F.col("_q_base_failed") | F.col("_q_soft_failed")).alias("f"))
    hosts = hosts.withColumn("r", F.col("f") / F.col("n"))
    m, v = F.avg("r"), F.var_pop("r")
    size = F.least(F.greatest(m * (1 - m) / F.nullif(v, F.lit(0.0)) - 1, F.lit(1.0)), F.lit(1e6))
    prior = hosts.agg(F.struct(m.alias("m"), F.coalesce(size, F.lit(1e6)).alias("k")).alias("prior")).scalar()
    shrunk = (F.col("f") + prior["m"] * prior["k"]) / (F.col("n") + prior["k"])
    return hosts.select(F.col(host).alias("_q_host"), F.round(shrunk, 9).alias("_q_rate"))


def quality_verdicts(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None,
                     host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` (columns ``carry``, default all) with the figures _q_* and ``_q_kept``.

    Null text has no words and fails; rows without a host share one host.  Rows
    are never merged, so repeated rows and repeated ids each get a verdict.  The
    figures are written once; only soft failures are joined with their host.
    """
    carry = docs.columns if carry is None else carry
    measured = _measured(docs.select(*dict.fromkeys([*carry, host, text])), text).select(
        *dict.fromkeys([*carry, host]), *_OWN)
    measured = staged(measured, "quality")
    open_ = F.col("_q_soft_failed") & ~F.col("_q_base_failed")
    local = measured.where(~open_).withColumn("_q_kept", ~F.col("_q_base_failed"))
    bad = host_rates(measured, host).where(F.col("_q_rate") > host_limit)
    judged = (
        measured.where(open_).join(bad, F.col(host).eqNullSafe(F.col("_q_host")), "left")
        .withColumn("_q_kept", F.col("_q_rate").isNull()).drop("_q_host", "_q_rate")
    )
    return local.unionByName(judged).select(*carry, *_OWN, "_q_kept")


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    return quality_verdicts(docs, **options).where("_q_kept").select(*docs.columns)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.drop("_q_soft_failed").toDF(*[c.removeprefix("_q_") for c in out.columns if c != "_q_soft_failed"])


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL = {"op7_quality_rules": f"""
with t as (select row_number() over () as k, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
g as (
  select k, s, array_to_string(ws[s:s + 4], ' ') as v from (select k, ws, unnest(range(1, len(ws) - 3)) as s from w)),
hit as (
  select k, count(distinct s + o) as c
  from (select *, count(*) over (partition by k, v) as c from g), range(5) r(o) where c > 1 group by k),
m as (
  select doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines,
    coalesce(c, 0)::bigint as n_repeat_words
  from w left join hit using (k)),
f as (
  select *, n_words < {SHORT_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed,
    100 * n_symbols > {SYMBOL_PERCENT} * word_chars or 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines as soft_failed
  from m),
h as (
  select source, count(*) as n, count(*) filter (base_failed or soft_failed) as f,
    count(*) filter (base_failed or soft_failed) / count(*) as r from f group by source),
p as (
  select avg(r) as a, coalesce(least(greatest(avg(r) * (1 - avg(r)) / nullif(var_pop(r), 0) - 1, 1), 1e6), 1e6) as k from h),
bad as (select source from h, p where round((f + a * k) / (n + k), 9) > {HOST_LIMIT})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (soft_failed and exists (select 1 from bad where bad.source is not distinct from f.source)) as kept
from f"""}
