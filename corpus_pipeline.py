"""A corpus from documents: toxic ones out, one of each near-duplicate group, personal data replaced, sources mixed to
their weights, and the result packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of documents,
but for the last, which returns the packed pieces. A document that the mix takes several times is as many rows.

Defined cases are those of the operators: documents without text or words are kept up to the mix, which never takes them;
rows without an id are judged like any other; of rows that repeat id and text one stays; null sources are a source; ties
between copies go to the smallest id; very long texts are read whole and packed in several pieces; further columns are
carried along to the mix, whatever their names; empty tables give no rows; without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keytide.llm import common, mixing, packing, pii, simhash, toxicity
from keytide.sources import storage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes, learned weights and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.new_shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        storage.remove_at_exit(spark, path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
