"""One query for each operator, over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, golay, htmltext, mixing, packing, permutation, pii, quality, ring, warc
from .shared import table


def op1_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.salvaged_pages(table(spark, sf_dir, "pages"))


def op3_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = balltree.top_k(table(spark, sf_dir, "embeddings"), every=balltree.EVERY)
    return got.withColumn("score", F.round("score", 6))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, clusters=golay.groups(docs))


def op9_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.neighbors(table(spark, sf_dir, "embeddings"), every=permutation.EVERY)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"), few=htmltext.FEW)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ring": op1_ring,
    "op2_warc": op2_warc,
    "op3_balltree": op3_balltree,
    "op4_simhash_golay": op4_simhash_golay,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_permutation": op9_permutation,
    "op10_html": op10_html,
}

SQL: dict[str, str] = {"op3_balltree": balltree.sql(), "op7_mixing": mixing.sql()}
