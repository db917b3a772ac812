"""A corpus pipeline of five stages over the documents table; each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import langid, mixing, pieces, secrets, simhash
from evidentia.llm.common import save, table

#: Target weights of the mix. The budget keeps clean documents at rate 1 and thins the others.
WEIGHTS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and documents in no learned language.

    Null and empty texts have no letter, so they go; repeated rows stay repeated here; an empty table, and one without labelled rows, gives no rows.
    """
    return langid.in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Of repeated rows one stays; different texts under one id are different documents; rows without an id stay; texts without words are copies of each other.
    """
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; no row goes. Null texts stay null, repeated rows repeat, an empty table stays empty."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its rate says; clean documents have rate 1.

    Null texts have no tokens and a rate like others; repeated rows are taken each; an empty table stays empty.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), WEIGHTS, budget="keep:clean", max_rate=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every document, checked by decoding them. A null text counts as empty, repeated rows repeat, an empty table gives no rows."""
    return pieces.encode_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("encode", encode)]

#: SimHash groups, the fitted mix and the piece coding can't be said in SQL; a test holds run() against a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
