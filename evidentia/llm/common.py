"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidentia.operators.iterate import save  # noqa: F401  (the operators' written tables)

#: Rows that a mapped function sees at once.
CHUNK_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_chunks(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Narrow map over chunks of rows; ``make()`` runs once a task and returns a function from a dict of lists to a dict of lists."""
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, arrow = make(), to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = step(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_pydict({f.name: got[f.name] for f in arrow}, schema=arrow)

    return df.mapInArrow(run, out)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType, rows: int = CHUNK_ROWS) -> DataFrame:
    """Narrow map over slices of Arrow batches, for steps that pass all columns on; ``make()`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; columns that hold maps, which have no hash, count as JSON."""

    def holds_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(holds_map(f.dataType) for f in kind)
        return holds_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))

    return F.xxhash64(*[F.to_json(F.struct(df[f.name])) if holds_map(f.dataType) else df[f.name] for f in df.schema])
