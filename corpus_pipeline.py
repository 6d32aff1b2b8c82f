"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``.  Stages keep whatever they have no reason to drop: extra columns, rows
with null sources or languages, and empty tables pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.llm.common import stored
from wavemill.llm.decontam import find_contamination
from wavemill.llm.dedup import near_duplicates
from wavemill.llm.langid import identify_languages, learned, train_all, training_sample
from wavemill.llm.mixing import mix_sources, repeated
from wavemill.llm.sharding import assign_shards, shard_names

SHARDS = 64
#: The columns that stages read; all others only pass through.
USED = ("doc_id", "text", "lang", "source")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def same_columns(stage: Stage) -> Stage:
    """``stage`` with the columns of its ``docs`` as result.  Columns that it has no use for
    have other names meanwhile, so that none is taken for one that an operator adds."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        renamed = docs.toDF(*[c if c in USED else f"__own{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, renamed, sf_dir).toDF(*docs.columns)

    return run_stage


@same_columns
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, no letter) go."""
    found = identify_languages(docs, train_all(training_sample(learned(docs))))
    return found.where(F.col("lang_pred") != "und").select(*docs.columns)


def row_order(docs: DataFrame) -> list[Column]:
    """What orders rows by their content: a hash of each column, of its JSON where a type
    (a map, say) has no hash."""
    plain = [not re.search("map<|variant", docs.schema[c].dataType.simpleString()) for c in docs.columns]
    return [F.xxhash64(c) if p else F.xxhash64(F.to_json(F.struct(c))) for c, p in zip(docs.columns, plain)]


@same_columns
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest doc_id; of
    repeated rows of that document, the first by a hash of their columns.  Rows with a
    null doc_id can't be told apart and all stay."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(*row_order(docs)))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("__n", first).where("__n = 1").drop("__n")
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


@same_columns
def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("spans") == 0).select(*docs.columns)


@same_columns
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix has it; the most plentiful source once, no
    source more than twice."""
    return repeated(mix_sources(docs)).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return assign_shards(docs, shard_names(SHARDS))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontam_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Suffix automata and a bisected exponent are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if i < len(STAGES) - 1 else docs
    return docs
