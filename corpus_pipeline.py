"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Language ID, SimHash near-duplicates, benchmark decontamination, mixing
sources to target weights, sharding. Every stage works on all rows that its
predecessor kept and returns the columns of `documents`; the last adds shard
and slot. SQL can't express the fingerprints and the packing, so the pipeline
is tested against brute force instead.

Defined results, stage by stage: a text without a letter (null, empty or blank
included) is in no language and goes, and so does one that fits none; a row without
lang or source has that evidence less and a source of its own; of rows that are
linked as near copies, repeated ones included, the one of least id stays, nulls
last; rows without words hold no benchmark passage; a document without words costs
nothing and stays in the mix once; a document of any length is read whole; ties go
to the least id or key; an empty table, or a stage that keeps nothing, gives an empty
result; other columns of `documents` go along, but for those named shard or slot,
which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lawframe.llm import decontamination, langid, mixing, sharding, simhash
from lawframe.llm.common import table
from lawframe.session import scratch_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(docs, shards=40)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, through Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
