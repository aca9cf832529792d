"""A training corpus in five stages: quality, near copies, benchmark leaks, source mix, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages rows are written as
Parquet to the shared folder and read again; what a stage has read is deleted. All stages but the last return the columns of
documents. Rows of empty tables, null texts and repeated rows fare as each operator defines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vaultmill.llm import leaks, mix, quality, shard, simhash
from vaultmill.llm.common import forget, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or an edited copy of one, go."""
    return leaks.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mix.mixed_rows(docs.select(*COLUMNS))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard."""
    return shard.shard(docs.select(*COLUMNS))[0]


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("mix", mix_sources),
    ("shards", deal_shards),
]

# the classifier, the fingerprints and the alignment have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    last = ""
    for k, (name, stage) in enumerate(STAGES):
        at = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:
            forget(spark, last)
        last = at
    return docs
