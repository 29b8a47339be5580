"""A training corpus from raw documents: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of ``documents``; the last returns sampled
piece ids of each text that is left.  A stage's result is written before the next
one is called: each stage first deletes the tables that the one before it used.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kgloom.llm.common import table, workspace
from kgloom.llm.decontamination import decontaminate
from kgloom.llm.line_dedup import dedup_lines
from kgloom.llm.minhash_dedup import keep_one
from kgloom.llm.piece_sampling import sample_pieces
from kgloom.llm.quality_rules import quality_filter
from kgloom.skew import recorded_tables, remove_tables

_used: list[str] = []       # tables of the stage that was called last


def stage_of(work):
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_tables(spark, _used)
        with recorded_tables(_used):
            return work(spark, docs, sf_dir)
    return run_stage


@stage_of
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or their host's verdict reject go."""
    return quality_filter(docs)


@stage_of
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of similar lines are cut from the texts."""
    return dedup_lines(docs)


@stage_of
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_one(docs)


@stage_of
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage_of
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each text, with their ids."""
    return sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), join_lead=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicate documents", near_copies),
          ("benchmark decontamination", benchmark), ("piece sampling", pieces)]
ORACLE_SQL = None       # SQL has no way to draw segmentations; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    home = f"{workspace(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{home}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
