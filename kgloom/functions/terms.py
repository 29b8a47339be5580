"""Column expressions and row filters on graph terms (ids, URIs, labels)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.settings import (
    FREEBASE_NS, NOISE_TERMS, UNNAMED, WIKIDATA_DIRECT, WIKIDATA_PROP, GraphKind,
)
from kgloom.skew import attach_stats, first_per_group

AUTO = "__AUTO__"
NOISE_PATTERN = r"(?iU)(^|\b)(" + "|".join(NOISE_TERMS) + r")(\b|$)"


def strip_entity_uri(term: Column, kind: GraphKind) -> Column:
    """Drop the graph's URI prefix; any other text passes through trimmed."""
    alternatives = "|".join(re.escape(p) for p in kind.entity_uri_prefixes)
    return F.regexp_replace(F.trim(term), f"^(?:{alternatives})", "")


def strip_relation_uri(term: Column, kind: GraphKind) -> Column:
    """Relation id of a predicate URI; blank input gives NULL."""
    text = F.trim(term)
    if kind.name == "wikidata":
        short = (
            F.when(text.startswith(WIKIDATA_DIRECT), F.replace(text, F.lit(WIKIDATA_DIRECT), F.lit("")))
            .when(text.startswith(WIKIDATA_PROP), F.substring_index(text, "/", -1))
            .when(text.startswith("wdt:"), F.replace(text, F.lit("wdt:"), F.lit("")))
            .otherwise(text)
        )
    else:
        short = F.replace(text, F.lit(FREEBASE_NS), F.lit(""))
    return F.nullif(short, F.lit(""))


def split_terms(df: DataFrame, value: str, kind_col: str) -> DataFrame:
    """Keep URIs and literals with text, adding ``is_literal``; others go."""
    text = F.trim(F.col(value))
    literal = F.col(kind_col).isin("literal", "typed-literal")
    return df.where((text != "") & (literal | (F.col(kind_col) == "uri"))).withColumns(
        {value: text, "is_literal": literal}
    )


def is_entity_id(term: Column, kind: GraphKind) -> Column:
    return F.trim(term).rlike(kind.entity_id_pattern)


def keep_property_ids(df: DataFrame, rel: str) -> DataFrame:
    return df.where(F.trim(F.col(rel)).rlike(r"^P\d+$"))


def fallback_relation_name(term: Column) -> Column:
    """Last part of a URI (after # or the last path segment); else the text."""
    text = F.trim(term)
    is_uri = text.startswith("http://") | text.startswith("https://")
    return (
        F.when(is_uri & text.contains("#"), F.substring_index(text, "#", -1))
        .when(is_uri, F.substring_index(F.regexp_replace(text, "/+$", ""), "/", -1))
        .otherwise(text)
    )


def is_schema_relation(rel: Column, kind: GraphKind) -> Column:
    """True for bookkeeping relations the graph kind never walks."""
    hit = rel.isin(*kind.dropped_relations)
    for prefix in kind.dropped_prefixes:
        hit = hit | rel.startswith(prefix)
    for part in kind.dropped_fragments:
        hit = hit | rel.contains(part)
    return hit


def drop_schema_relations(df: DataFrame, rel: str, kind: GraphKind) -> DataFrame:
    return df.where(~is_schema_relation(F.col(rel), kind))


def is_noisy_label(label: Column) -> Column:
    return F.coalesce(F.trim(label).rlike(NOISE_PATTERN), F.lit(False))


def drop_noisy_labels(df: DataFrame, keys: list[str], rel: str, label: str) -> DataFrame:
    """Drop id/url/media relations, unless that would empty the whole group."""
    noisy = is_noisy_label(F.coalesce(F.col(label), F.col(rel)))
    marked = df.withColumn("_clean", ~noisy)
    groups = marked.groupBy(*keys).agg(
        F.max("_clean").alias("_any_clean"), F.count(F.lit(1)).alias("_n")
    )
    return (
        attach_stats(marked, groups, keys, "_n")
        .where(F.col("_clean") | ~F.col("_any_clean"))
        .select(*df.columns)
    )


def keep_entity_prefix(df: DataFrame, entity: str, kind: GraphKind, prefix: str | None = AUTO) -> DataFrame:
    if prefix is None:
        return df
    return df.where(F.col(entity).startswith(kind.default_prefix if prefix == AUTO else prefix))


def drop_unnamed(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name) != UNNAMED)


def distinct_first_order(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """De-duplicate on ``keys`` keeping the earliest position."""
    return first_per_group(df, keys, [F.col(pos)])
