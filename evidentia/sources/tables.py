"""Readers, writers, upserts and replacement of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.jsonio import canonical


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, numbered within each file. A line's place comes from its file's row index, not from a global order."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    order = Window.partitionBy("file").orderBy("at")
    return rows.select("file", F.row_number().over(order).cast("long").alias("line_no"), "value")


def write_lines(df: DataFrame, line: str, path: str, files: int | None = None) -> None:
    """One JSON line a row; ``files`` bounds their number."""
    out = df.select(F.col(line).alias("value"))
    (out.coalesce(files) if files else out).write.mode("overwrite").text(path)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows of one key; the predicate reaches the Parquet scan."""
    return df.where(F.col(key) == F.lit(value))


def multi_get(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the given keys; unknown keys are dropped."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def newest(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n latest rows: a top-n plan, not a sort of all."""
    return df.orderBy(F.desc(by), tie).limit(n)


def upsert(table: DataFrame, rows: DataFrame, key: str, on_create: dict[str, object] | None = None) -> DataFrame:
    """MERGE by key: given columns win where not null, others stay; new keys get ``on_create`` values where a column is still null."""
    new = rows.select(key, *[F.col(c).alias(f"__{c}") for c in rows.columns if c != key], F.lit(True).alias("__given"))
    old = table.withColumn("__old", F.lit(True))
    met = old.join(new, key, "full")
    out = {}
    for c in table.columns:
        if c == key:
            continue
        value = F.coalesce(f"__{c}", c) if c in rows.columns else F.col(c)
        if on_create and c in on_create:
            value = F.when(F.col("__old").isNull(), F.coalesce(value, F.lit(on_create[c]))).otherwise(value)
        out[c] = value
    return met.select(key, *[v.alias(c) for c, v in out.items()]).select(*table.columns)


def seeded(table: DataFrame, catalog: DataFrame, key: str, only_if_empty: bool = False) -> DataFrame:
    """``table`` with the rows of a catalog whose key it lacks; rows that are there are never overwritten, so seeding again changes nothing.

    Keys are trimmed and compared in lower case; blank ones are no keys, and of a repeated one the smallest row counts. With ``only_if_empty`` a table that has rows
    takes nothing. Columns that the catalog lacks are null.
    """
    name = lambda: F.lower(F.trim(key))
    new = catalog.where(F.coalesce(name() != "", F.lit(False))).withColumn(key, F.trim(key)).withColumn("_k", name())
    if only_if_empty:
        new = new.join(table.select(F.lit(True).alias("_some")).limit(1), how="left").where("_some IS NULL").drop("_some")
    new = new.join(table.select(name().alias("_k")).distinct(), "_k", "left_anti")
    row = F.min(F.struct(*catalog.columns)).alias("row")
    return table.unionByName(new.groupBy("_k").agg(row).select("row.*"), allowMissingColumns=True)


def replace_for_key(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that ``fresh`` has are replaced by it."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def overwrite_partitions(fresh: DataFrame, path: str, partition: str = "subject_id") -> None:
    """Replaces on disk only the partitions that ``fresh`` has."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete_for_key(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def documents_of_size(spark: SparkSession, path: str, most_bytes: int, suffixes: tuple[str, ...]) -> DataFrame:
    """Binary files of allowed kinds and size with path, length and modification time; contents are read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.substring_index("path", ".", -1))
    return files.where((F.col("length") <= most_bytes) & kind.isin(*suffixes))


def box_probe(files: DataFrame) -> DataFrame:
    """(path, sample_rate, channels) of the first sound track of MP4 files; null where there is none.

    Walks moov/trak/mdia/minf/stbl/stsd of each file's bytes; a file is read by the task that holds it.
    """
    import pandas as pd

    inner = (b"moov", b"trak", b"mdia", b"minf", b"stbl")

    def probe(raw: bytes) -> tuple[int, int] | None:
        spans = [(0, len(raw))]
        while spans:
            at, end = spans.pop()
            while at + 8 <= end:
                size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
                head = 8
                if size == 1:
                    size, head = int.from_bytes(raw[at + 8 : at + 16], "big"), 16
                elif size == 0:
                    size = end - at
                if size < head or at + size > end:
                    break
                if kind in inner:
                    spans.append((at + head, at + size))
                elif kind == b"stsd" and raw[at + head + 12 : at + head + 16] in (b"mp4a", b"alac", b"Opus", b"sowt"):
                    entry = at + head + 8
                    return int.from_bytes(raw[entry + 32 : entry + 34], "big"), int.from_bytes(raw[entry + 24 : entry + 26], "big")
                at += size
        return None

    def run(batches):
        for rows in batches:
            found = [probe(x) for x in rows["content"]]
            yield pd.DataFrame({"path": rows["path"], "sample_rate": pd.array([f[0] if f else None for f in found], "Int64"), "channels": pd.array([f[1] if f else None for f in found], "Int64")})

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate long, channels long")


_WORD = "struct<word:string,speaker:string,start:string,end:string>"


def seconds(offset: Column) -> Column:
    """A duration like ``12.5s``, or a bare number, in seconds; null if it is neither."""
    return F.rtrim(offset, F.lit("s")).try_cast("double")


def transcript_segments(results: DataFrame) -> DataFrame:
    """(asset_id, place, speaker, start, end, text): the segments of transcripts, in order.

    results: asset_id, results array<struct<end, alternatives array<struct<transcript, words array<struct<word, speaker, start, end>>>>>>. The words of a result
    with speakers are cut where the speaker changes, a word without one goes on; a result without speakers is one segment.
    """
    top = F.get(F.col("r.alternatives"), F.lit(0))
    rows = results.select("asset_id", F.posexplode("results").alias("n", "r")).select("asset_id", "n", F.col("r.end").alias("until"), top["transcript"].alias("said"), F.filter(F.coalesce(top["words"], F.array().cast(f"array<{_WORD}>")), lambda w: w["word"].isNotNull()).alias("words"))
    rows = rows.withColumn("told", F.exists("words", lambda w: w["speaker"].isNotNull()))
    plain = rows.where(~F.col("told") & (F.trim("said") != "")).select("asset_id", "n", F.lit(0).alias("run"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("start"), seconds(F.col("until")).alias("end"), F.trim("said").alias("text"))
    w = Window.partitionBy("asset_id", "n").orderBy("i")
    words = rows.where("told").select("asset_id", "n", F.posexplode("words").alias("i", "w")).select("asset_id", "n", "i", "w.*")
    words = words.withColumn("who", F.last("speaker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = F.when((F.row_number().over(w) > 1) & F.col("speaker").isNotNull() & ~F.col("who").eqNullSafe(F.lag("who").over(w)), 1).otherwise(0)
    runs = words.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w))
    label = F.when(F.lower("who").startswith("speaker"), F.col("who")).otherwise(F.concat(F.lit("Speaker "), F.col("who")))
    spoken = runs.groupBy("asset_id", "n", "run").agg(
        F.max(label).alias("speaker"), F.min_by(seconds(F.col("start")), F.when(seconds(F.col("start")).isNotNull(), F.col("i"))).alias("start"), F.max_by(seconds(F.col("end")), F.when(seconds(F.col("end")).isNotNull(), F.col("i"))).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("text"),
    )
    order = Window.partitionBy("asset_id").orderBy("n", "run")
    return plain.unionByName(spoken.withColumn("run", F.col("run").cast("int"))).select("asset_id", F.row_number().over(order).cast("long").alias("place"), "speaker", "start", "end", "text")


def messages(rows: DataFrame, key: str, fields: dict[str, Column], strings: tuple[str, ...]) -> DataFrame:
    """(key, value) as bytes, the value in compact canonical JSON: what a Kafka sink takes."""
    return rows.select(F.col(key).cast("string").cast("binary").alias("key"), F.encode(canonical(fields, strings), "UTF-8").alias("value"))
