"""Written intermediate tables for iterations, and connected components on them."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Edges up to which one task settles the components that are left.
FEW = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/evidentia-shared"
    return found.rstrip("/")


def gone_at_end(spark: SparkSession, path: str) -> None:
    """The driver deletes the folder when it ends, on whatever file system it is; a driver that is killed leaves it."""
    if jvm := getattr(spark, "_jvm", None):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def save(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage, safe from lost executors, of known size for later joins. ``by`` partitions the table."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    gone_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``save`` and aggregates over the rows, taken as they are written, so that a loop's condition costs no job of its own."""
    watch = Observation()
    out = save(df.observe(watch, *[m.alias(n) for n, m in metrics.items()]), name)
    return out, watch.get


def freed(spark: SparkSession) -> None:
    """Shuffles of jobs that have ended leave the disk now; else they stay until the driver happens to collect its garbage, those of all rounds of a loop together."""
    gc.collect()
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex that it reaches) for all vertices of the pairs."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        before, low = top.copy(), np.minimum(top[x], top[y])
        np.minimum.at(top, top[x], low)
        np.minimum.at(top, top[y], low)
        top = top[top]
        if (top == before).all():
            return names, names[top]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(v, p): the components of at most ``FEW`` edges, in one task; p is the smallest vertex of each other one."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            a, b = (np.concatenate([np.asarray(r[c].to_pylist(), object if kind == "string" else np.int64) for r in rows]) for c in "ab")
            v, root = least_reached(a, b)
            moved = v != root
            yield pa.RecordBatch.from_arrays([pa.array(x[moved].tolist(), rows[0].schema.field("a").type) for x in (v, root)], ["v", "p"])

    return edges.repartition(1).mapInArrow(run, f"v {kind}, p {kind}")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b); root is the smallest vertex reached.

    Every vertex hooks on to its smallest smaller neighbour, pointers are doubled to their ends, edges move there; rounds repeat
    until at most ``few`` edges are left, which one task settles. No vertex's neighbours are ever gathered: minima have partial sums, lookups are joins.
    """
    n = F.count(F.lit(1))
    edges, left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", n=n)
    plain = edges.schema["a"].dataType.simpleString() in ("bigint", "string")
    labels: DataFrame | None = None

    def followed(hooks: DataFrame) -> DataFrame:
        if labels is None:
            return hooks
        ends = hooks.select(F.col("v").alias("p"), F.col("p").alias("q"))
        return save(labels.join(ends, "p", "left").select("v", F.coalesce("q", "p").alias("p")).unionByName(hooks), "labels")

    while left.get("n"):
        if plain and left["n"] <= few:
            labels = followed(save(_in_one_task(edges), "hooks"))
            break
        hooks = save(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "hooks")
        moved = 1
        while moved:
            ends = hooks.select(F.col("v").alias("p"), F.col("p").alias("q"))
            further, told = saved(hooks.join(ends, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hooks", n=F.count_if("moved"))
            hooks, moved = further.select("v", "p"), told.get("n")
        to = lambda c: hooks.select(F.col("v").alias(c), F.col("p").alias(f"{c}_to"))
        ends = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        edges, left = saved(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges", n=n)
        labels = followed(hooks)
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = labels.select(F.col("p").alias("v")).distinct().select("v", F.col("v").alias("p"))
    return labels.unionByName(roots).select("v", F.col("p").alias("root"))
