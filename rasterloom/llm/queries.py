"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import bpe, html, lm, mixing, quality, secrets, simhash, spotsigs, toxicity, warc
from rasterloom.llm.common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.resolved(warc.read(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.realised(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.report(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_bpe, op2_quality, op3_warc, op4_simhash, op5_mixing, op6_lm, op7_toxicity, op8_secrets, op9_spotsigs, op10_html)}
SQL: dict[str, str] = {
    "op2_quality": quality.sql(),
    "op5_mixing": mixing.sql(),
    "op3_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        d AS (SELECT *, sha1(html) AS digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keep FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, url,
               CASE WHEN n >= 1000 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND keep <> page_id THEN keep END AS refers_to
        FROM w""",
}
