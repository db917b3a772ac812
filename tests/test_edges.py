"""Streams in event order, sinks, media, seams, and the entry without the training-data package."""

import io
import shutil
import subprocess
import sys
from dataclasses import replace
from pathlib import Path
from types import SimpleNamespace

import numpy as np
from evidentia.functions.vectors import trigram_vectors
from evidentia.operators import seams
from evidentia.plans.queries import P
from evidentia.sources import sinks, tables
from evidentia.sources.media import described
from evidentia.streaming import limits, ordered
from evidentia.streaming.replay import replayed
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T_

ROOT = Path(__file__).resolve().parents[1]
#: A time after 1970: to a stream, times before its first watermark are late.
T = 1_000_000


def test_stream_out_of_order_equals_batch(spark):
    e = spark.range(240).select((F.col("id") % 5).cast("string").alias("session_id"), F.col("id").alias("message_id"), F.timestamp_seconds(1_000_000 + F.pmod(F.col("id") * 7919, F.lit(100_000))).alias("at"), (F.col("id") % 7 > 0).alias("live"))
    e = e.withColumn("ts", F.col("at").cast("double"))
    p = replace(P, chat_interval_seconds=3000, messages_per_session=20)
    want = {tuple(r) for r in limits.chat_gated(e, p).collect()}
    got = replayed(e, lambda s: ordered.in_event_order(s, "session_id", ("ts", "message_id"), "1 hour", ordered.chat_rule(p)), 3600, 3)
    assert {tuple(r) for r in got.collect()} == want and {o for *_, o in want} == {"OK", "TOO_FAST", "FULL", "NOT_AVAILABLE"}


def test_sessions_end_by_event_time(spark):
    rows = [("a", k, float(T + t)) for k, t in enumerate((0, 30, 3599, 3600, 9000, 9001))] + [("b", 9, T + 50.0)]
    e = spark.createDataFrame(rows, "owner string, event_id long, ts double").withColumn("at", F.timestamp_seconds("ts"))
    p = replace(P, session_ttl_minutes=60)
    want = {("a", T + 0.0, T + 3600.0, 3), ("a", T + 3600.0, T + 7200.0, 1), ("a", T + 9000.0, T + 12600.0, 2), ("b", T + 50.0, T + 3650.0, 1)}
    assert {tuple(r) for r in ordered.fixed_sessions(e, p).collect()} == want
    got = replayed(e, lambda s: ordered.in_event_order(s, "owner", ("ts", "event_id"), "1 hour", ordered.session_rule(p)), 3600, 2)
    assert {tuple(r) for r in got.collect()} == want


def test_waiting_rows_have_one_timer_a_batch():
    class Held:
        def __init__(self):
            self.values, self.timers = [], []

        def exists(self):
            return bool(self.values)

        def get(self):
            return iter(list(self.values)) if self.listed else self.values[0]

        def put(self, values):
            self.values = list(values)

        def appendValue(self, value):
            self.values.append(value)

        def appendList(self, values):
            self.values += values

        def update(self, value):
            self.values = [value]

        def clear(self):
            self.values = []

        def _state(self, listed):
            made = Held()
            made.listed = listed
            return made

        getListState = lambda self, *_: self._state(True)
        getValueState = lambda self, *_: self._state(False)

        def registerTimer(self, ms):
            self.timers.append(ms)

    kept, handle = T_.StructType.fromDDL("event_id long, ts double, kind string"), Held()
    keyed = ordered.EventOrder(ordered.outstanding_rule(1), kept, ("ts", "event_id"))
    keyed.init(handle)
    row, got = Row("event_id", "ts", "kind"), []
    for first in (0, 1):
        assert not list(keyed.handleInputRows(("u",), iter([row(k, float(T + k), "ISSUE" if k % 3 else "REDEEM") for k in range(first, 1000, 2)]), None))
    assert handle.timers == [T * 1000 + 1, T * 1000 + 1001]
    for now in (T * 1000 + 500_000, T * 1000 + 2_000_000):
        passed = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
        got += [tuple(r) for r in keyed.handleExpiredTimer(("u",), passed, None)]
    assert handle.timers[2:] == [T * 1000 + 500_001]
    assert got == [("u", k, k % 3 < 2) for k in range(1000)]


def test_upsert_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "t")
    batch = lambda rows: spark.createDataFrame(rows, "k long, v string, part long, version long")
    first, second = batch([(1, "a", 0, 1), (2, "b", 1, 1), (3, "c", 1, 1)]), batch([(2, "B", 1, 2), (3, "old", 1, 0), (4, "d", 2, 1), (2, "b2", 1, 1)])
    sinks.upsert_partitions(first, table, "k", "part", "version", 0)
    files = lambda: {r["f"] for r in spark.read.parquet(table).where("part = 0").select(F.col("_metadata.file_name").alias("f")).collect()}
    before = files()
    for _ in range(2):
        sinks.upsert_partitions(second, table, "k", "part", "version", 1)
        assert {tuple(r) for r in spark.read.parquet(table).select("k", "v", "part").collect()} == {(1, "a", 0), (2, "B", 1), (3, "c", 1), (4, "d", 2)}
    assert files() == before
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_once(first, log, 0)
    assert spark.read.parquet(log).count() == 3


def test_seeds_fill_gaps_only(spark):
    t = spark.createDataFrame([("A", 1), (None, 2)], "k string, v int")
    c = spark.createDataFrame([(" a ", 9), ("b", 7), ("B", 8), ("", 5), (None, 6)], "k string, v int")
    once = tables.seeded(t, c, "k")
    assert sorted(map(tuple, once.collect()), key=str) == sorted([("A", 1), (None, 2), ("B", 8)], key=str)
    assert sorted(map(tuple, tables.seeded(once, c, "k").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert tables.seeded(t, c, "k", only_if_empty=True).count() == 2 and tables.seeded(t.limit(0), c, "k", only_if_empty=True).count() == 2


def test_media_boxes_are_read_by_range():
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    entry = box(b"mp4a", bytes(16) + (2).to_bytes(2, "big") + bytes(6) + (44100).to_bytes(2, "big") + bytes(2))
    deep = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(8) + entry)))))
    video = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(8) + box(b"avc1", bytes(40)))))))
    long = (1).to_bytes(4, "big") + b"mdat" + (16 + 90_000).to_bytes(8, "big") + bytes(90_000)
    for raw in (long + box(b"moov", video + deep), box(b"moov", deep + video) + long):
        rate, channels, read = described(io.BytesIO(raw), len(raw))
        assert (rate, channels) == (44100, 2) and read < 500
    for raw in (b"", b"no box", box(b"moov", video), box(b"moov", b"") + b"\0\0\0\1", (99).to_bytes(4, "big") + b"moov"):
        assert described(io.BytesIO(raw), len(raw))[:2] == (None, None)


def test_pseudo_embedding_equals_a_loop():
    def plain(text, dims):
        units = np.frombuffer(f"^{' '.join(text.lower().split())}$".encode("utf-16-le"), np.uint16).tolist()
        out = [0.0] * dims
        for i in range(len(units) - 2):
            h = 2166136261
            for c in units[i : i + 3]:
                h = (h ^ c) * 16777619 % 2**32
            n = h - 2**32 if h >> 31 else h
            out[abs(n) % dims] += -1.0 if h >> 31 else 1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm if norm else x for x in out]

    texts = ["", "a", "Acme  Corp\n Ltd", "é 中文 😀 x", "aaa" * 500]
    assert np.allclose(trigram_vectors(texts, 16), [plain(t, 16) for t in texts])


def test_cache_is_filled_once(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k % 7}") for k in range(40)] + [(99, None)], "id long, text string")
    client = lambda: lambda batch: [{"answer": r["text"].upper()} for r in batch]
    path = str(tmp_path / "cache")
    for calls, most in ((spark.sparkContext.accumulator(0), 7), (spark.sparkContext.accumulator(0), 0)):
        got = {r["id"]: r["answer"] for r in seams.cached(rows, ["text"], path, "answer string", client, calls=calls).collect()}
        assert got == {k: f"T{k % 7}" for k in range(40)} | {99: None}
        assert bool(calls.value) == bool(most) and calls.value <= most and spark.read.parquet(path).count() == 7


def test_mentions_by_table_function(spark):
    claims = spark.createDataFrame([("s", f"c{k:03d}", "Acme in Rome" if k % 3 == 0 else None if k % 3 == 1 else "none") for k in range(90)], "subject_id string, claim_id string, text string")
    got = seams.found_mentions(claims, [("acme", "ORG"), ("ACME", "ORG"), ("rome", "PLACE")], parts=2)
    assert {tuple(r) for r in got.collect()} == {x for k in range(0, 90, 3) for x in ((f"c{k:03d}", 1, "acme", "acme", "ORG"), (f"c{k:03d}", 2, "rome", "rome", "PLACE"))}


def test_entry_without_the_training_data_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for gone in ("evidentia/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    said = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        assert subprocess.run([sys.executable, "-c", said], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, timeout=100, check=False).returncode == 0
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_media_of_suppliers_whose_rate_is_over_16_bits(spark, tmp_path):
    from evidentia.plans import edges

    keys = [57_535, 57_536, 57_537, 60_001, 60_009]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    known = [k for k in keys if k % 11 and (k % 5 or k % 7 == 0)]
    assert {(r[0], r[1]) for r in edges.guarded_documents(spark, str(tmp_path)).collect()} == {(k, 6 if k % 7 == 0 else 65544 + 92) for k in known}
    assert {tuple(r) for r in edges.ranged_sound_probe(spark, str(tmp_path)).collect()} == {(k, *((8000 + k, k % 2 + 1) if k % 7 else (None, None)), True) for k in known}


def test_trigrams_of_many_texts_are_hashed_some_at_a_time(monkeypatch):
    import tracemalloc

    import pandas as pd
    from evidentia.functions import vectors

    texts = [f"text {k} " * 4000 for k in range(200)]  # 7 million characters or so
    held = []
    monkeypatch.setattr(vectors.F, "pandas_udf", lambda _: lambda f: held.append(f) or (lambda c: c))
    monkeypatch.setattr(vectors, "col", lambda c: c)
    vectors.pseudo_embedding("t", 16)
    tracemalloc.start()
    got = held[0](pd.Series([None, *texts]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] is None and np.array_equal(np.stack(got[1:]), trigram_vectors(texts, 16))
    assert peak < 60e6


def test_a_cache_fetches_texts_of_asked_rows_only(spark, tmp_path):
    texts = spark.createDataFrame([(k, f"t{k % 3}") for k in range(9)], "k long, text string")
    rows, asked = texts.select("k", F.sha2("text", 256).alias("key")), []

    def fetched(missing):
        asked.append(missing.count())
        return missing.join(texts, "k")

    client = lambda: lambda found: [{"n": int(r["text"][1])} for r in found]
    for n in (6, 9, 9):
        got = seams.cached(rows.where(F.col("k") < n), ["key"], str(tmp_path / "cache"), "n int", client, fetched=fetched)
        assert sorted(got.columns) == ["k", "key", "n"] and {(r["k"], r["n"]) for r in got.collect()} == {(k, k % 3) for k in range(n)}
    assert asked == [3]


def test_last_rows_of_keys_are_sorted_behind_the_exchange(spark):
    rows = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    plan = sinks.latest_of_keys(rows, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.split("Exchange")[1] and plan.count("Exchange") == 1
    assert {tuple(r) for r in sinks.latest_of_keys(rows, "k", "v").collect()} == {(k, 49 - (49 - k) % 7) for k in range(7)}
