"""A corpus pipeline of five training-data operators, from raw documents to token ids.

Each stage takes the session, the documents that the stage before it kept, and the folder of the
input tables; what it returns is written as Parquet and read again as the next one's documents. Stages with Python
workers take rows by batches of some MB, so that executors hold little beside the heap.

Null and empty texts are documents like any other: they are not toxic, are near duplicates of one
another, hold no secret, and have no tokens. Documents without an id are kept, one of each group of
near duplicates. Rows that repeat are near duplicates. Texts are taken whole, however long. An empty
table gives an empty one. All stages but the last keep the columns that there are, whatever their
names; the last has an id, the source, and what it makes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import bpe, mixing, secrets, simhash, toxicity
from rasterloom.llm.common import shared_dir, small_batches, table
from rasterloom.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    small_batches(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, or any if none has one."""
    small_batches(spark)
    return simhash.representatives(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    small_batches(spark)
    return secrets.redact(docs, vocabulary("byte_bpe_50k.tiktoken"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once at least, those of small sources more often, to flatten the sources' weights."""
    return mixing.repeated(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids_sha256, decoded_sha256`` of each row that the mix holds."""
    small_batches(spark)
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"), keep=["source"], forget=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("simhash", without_copies),
    ("secrets", without_secrets),
    ("mixing", to_target_weights),
    ("bpe", to_tokens),
]
#: Learning, fingerprints and merges aren't SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``; what a stage has read is removed once its own rows are written."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


PIPELINE = {"pipeline": run}
PIPELINE_SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
