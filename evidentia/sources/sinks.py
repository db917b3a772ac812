"""Durable sinks: a stream upserted into a table of partitions, each batch once; only the partitions that a batch touches are written anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators.iterate import save
from evidentia.sources.tables import overwrite_partitions

#: Column that holds the last batch that wrote a row.
BATCH = "_batch"


def latest_of_keys(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; of several the one of the greatest row. Rows are dealt by key first, or each task would sort its part of the input as well."""
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.repartition(key).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def stored(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def upsert_partitions(rows: DataFrame, path: str, key: str, partition: str, order: str, batch: int) -> None:
    """Rows win over stored rows of their key if they are not older by ``order``; a row keeps the partition of its key.

    Idempotent: the result of a batch depends on rows and order only, so a batch that is delivered again, whole or after a crash half way, leaves the same rows.
    The stored partitions that ``rows`` fall into are read, merged, written to the shared folder and swapped in; others keep their files.
    """
    spark = rows.sparkSession
    fresh = latest_of_keys(rows, key, order).withColumn(BATCH, F.lit(batch).cast("long"))
    old = stored(spark, path)
    if old is None:
        overwrite_partitions(fresh, path, partition)
        return
    fresh = save(fresh, "upsert-fresh")
    touched = [r[0] for r in fresh.select(partition).distinct().limit(10_001).collect()]
    old = old.select(*fresh.columns)
    near = old.where(F.col(partition).isin(touched)) if len(touched) <= 10_000 else old.join(fresh.select(partition).distinct(), partition, "left_semi")
    # of one row stored and delivered again, the stored one stays
    ranked = near.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    same = F.to_json(F.struct(*[c for c in fresh.columns if c != BATCH]))
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc(same), "_new")
    merged = save(ranked.repartition(key).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_new"), "upsert-merged")
    overwrite_partitions(merged, path, partition)


def upsert_sink(path: str, key: str, partition: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: every micro-batch is upserted into the table at ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        upsert_partitions(batch, path, key, partition, order, number)

    return write


def append_once(rows: DataFrame, path: str, batch: int) -> None:
    """Appends a batch as a partition of its own number, so that a batch delivered again replaces itself."""
    overwrite_partitions(rows.withColumn(BATCH, F.lit(batch).cast("long")), path, BATCH)
