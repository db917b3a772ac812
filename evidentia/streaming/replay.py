"""A table replayed as a stream: its rows arrive out of order, in several micro-batches, and the result is read back from a file sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.iterate import shared_folder
from evidentia.streaming.ordered import STORE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def arrivals(rows: DataFrame, late_seconds: int, batches: int) -> tuple[str, DataFrame]:
    """Writes ``rows`` (``at`` a timestamp) as files in the order in which they arrive: each up to ``late_seconds`` after its time, by a hash of the row.

    Cuts of arrival are quantiles, so the files are of about one size. A last row without a key, far in the future, lets the watermark pass all others.
    """
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/arrivals-{uuid.uuid4().hex}"
    seconds = F.col("at").cast("double")
    arrived = rows.withColumn("arrival", seconds + F.pmod(F.xxhash64(*rows.columns), F.lit(late_seconds)))
    cuts = arrived.approxQuantile("arrival", [k / batches for k in range(1, batches)], 0.01)
    number = sum((F.when(F.col("arrival") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    arrived = arrived.withColumn("batch", number)
    for k in range(batches):
        arrived.where(F.col("batch") == k).select(*rows.columns).coalesce(1).write.mode("append").parquet(folder)
    last = rows.agg(F.max("at").alias("at")).select((F.col("at") + F.make_interval(years=F.lit(1))).alias("at"))
    last.select(*[F.col("at") if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def replayed(rows: DataFrame, run: Callable[[DataFrame], DataFrame], late_seconds: int = 86400, batches: int = 4) -> DataFrame:
    """What the streaming plan ``run`` has returned once all of ``rows`` have arrived."""
    spark = rows.sparkSession
    _, stream = arrivals(rows, late_seconds, batches)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:
        out = run(stream)
        folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
