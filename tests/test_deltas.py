"""Greedy choice, components, redirects, merges and beliefs after a delta; exact neighbours; overlaps; against plain versions."""

import random
import re

import numpy as np
from evidentia.operators import entities, greedy, incremental, scoring
from evidentia.operators.blocks import similar
from evidentia.operators.iterate import components, save
from evidentia.plans.deltas import _edges
from evidentia.plans.queries import P
from evidentia.streaming.intervals import all_overlaps
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain_roots(edges):
    top = {}

    def root(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    return {v: root(v) for v in top}


def test_components_by_rounds_and_in_one_task(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 450)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = plain_roots([e for e in edges if e[0] != e[1]])
    for few in (1 << 17, 20):
        assert dict(map(tuple, components(df, few).collect())) == want
    named = df.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    assert dict(map(tuple, components(named).collect())) == plain_roots([(str(a), str(b)) for a, b in edges if a != b])
    assert components(df.limit(0)).count() == 0


def test_components_after_new_edges(spark):
    r = random.Random(6)
    old, new = ([(r.randrange(200), r.randrange(200)) for _ in range(n)] for n in (90, 40))
    frame = lambda e: spark.createDataFrame([x for x in e if x[0] != x[1]], "a long, b long")
    got = incremental.merged_components(components(frame(old)), frame(new))
    assert dict(map(tuple, got.collect())) == plain_roots([e for e in old + new if e[0] != e[1]])


def test_greedy_choice(spark):
    r = random.Random(7)
    pairs = {tuple(sorted(r.sample(range(400), 2))) for _ in range(500)}
    blocked = set(r.sample(range(400), 30))
    kept = {}
    for n in range(400):
        kept[n] = n not in blocked and not any(kept[a] for a, b in pairs if b == n)
    nodes = spark.createDataFrame([(n, n in blocked) for n in range(400)], "n long, blocked boolean")
    for most in (1 << 18, 20):
        got = greedy.first_independent(nodes, spark.createDataFrame(list(pairs), "earlier long, later long"), most)
        assert dict(map(tuple, got.collect())) == kept


def test_chain_takes_no_rounds(spark):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"chain-{n}", "")
        nodes = spark.range(n).select(F.col("id").alias("n"), F.lit(False).alias("blocked"))
        pairs = spark.range(n - 1).select(F.col("id").alias("earlier"), (F.col("id") + 1).alias("later"))
        assert greedy.first_independent(nodes, pairs).where("kept = (n % 2 = 0)").count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}"))

    assert jobs(10_000) == jobs(100)


def test_redirects_with_chains_and_cycles(spark):
    rows = [(k, k - 1 if k % 50 else None) for k in range(1000)] + [(2000, 2001), (2001, 2000), (2002, 2001), (2010, 2011), (2011, 2012), (2012, 2010), (2020, 2020), (2030, 9999)]
    got = dict(map(tuple, incremental.compacted(spark.createDataFrame(rows, "entity_id long, merged_into long")).collect()))
    assert all(got[k] == k - k % 50 for k in range(1000))
    assert {k: v for k, v in got.items() if k >= 2000} == {2000: 2000, 2001: 2000, 2002: 2000, 2010: 2010, 2011: 2010, 2012: 2010, 2020: 2020, 2030: 9999}


def test_merges_in_one_batch(spark):
    canon = [("a", "ORG", "ka", ["x"], None), ("b", "ORG", "kb", [], None), ("c", "ORG", "kc", ["y", "ka"], None), ("d", "PLACE", "kd", [], None), ("e", "ORG", "ke", [], "a"), ("f", "ORG", "kf", [], None), ("g", "ORG", "kg", [], None)]
    canon = spark.createDataFrame(canon, "entity_id string, entity_type string, canonical_key string, alias_keys array<string>, merged_into string")
    asked = [("a", "b"), ("b", "c"), ("a", "a"), ("d", "a"), ("e", "a"), ("b", "e"), ("zz", "a"), ("f", "g"), ("g", "f"), ("a", "c")]
    mentions = spark.createDataFrame([("m1", "a"), ("m2", "b"), ("m2", "c"), ("m3", "e"), ("m4", "g")], "claim_id string, entity_id string")
    moved, out, judged = incremental.merge_entities(mentions, canon, spark.createDataFrame(asked, "entity_id string, target_id string"))
    said = {(r["entity_id"], r["target_id"]): r["refusal"] for r in judged.collect()}
    assert said == {("a", "b"): None, ("b", "c"): None, ("a", "a"): "SELF", ("d", "a"): "OTHER_TYPE", ("e", "a"): "MERGED", ("b", "e"): "TARGET_MERGED", ("zz", "a"): "NOT_FOUND", ("f", "g"): "CYCLE", ("g", "f"): None, ("a", "c"): "REPEATED"}
    rows = {r["entity_id"]: (r["merged_into"], r["alias_keys"]) for r in out.collect()}
    assert rows["a"][0] == rows["b"][0] == rows["e"][0] == "c" and rows["c"] == (None, ["ka", "kb", "x", "y"]) and rows["g"][0] == "f" and rows["f"] == (None, ["kg"])
    assert out.count() == 7 and {tuple(r) for r in moved.collect()} == {("m1", "c"), ("m2", "c"), ("m3", "e"), ("m4", "f")}


def test_split_and_alias_growth(spark):
    canon = [("e1", "ORG", "acme", ["acme inc", "zeta", "far"], None, [1.0, 0.0]), ("e2", "ORG", "old", ["zeta"], None, [0.0, 1.0]), ("e3", "ORG", "gone", [], "e2", [0.6, 0.8])]
    canon = spark.createDataFrame(canon, "entity_id string, entity_type string, canonical_key string, alias_keys array<string>, merged_into string, embedding array<double>")
    rows = [("c1", "acme", [1.0, 0.0]), ("c2", "zeta", [0.0, 1.0]), ("c3", "gone", [0.9, 0.1]), ("c4", "near old", [0.1, 0.99]), ("c5", "between", [0.62, 0.78]), ("c6", "far", [-1.0, 0.0]), ("c7", "", [0.0, 0.0])]
    m = spark.createDataFrame([(c, "ORG", s, "e1", v) for c, s, v in rows], "claim_id string, entity_type string, surface_key string, entity_id string, embedding array<double>")
    told, kept = entities.split_entities(m, canon, spark.createDataFrame([("e1",), ("e3",)], "entity_id string"), P)
    got = {r["surface_key"]: (r["entity_id"], r["how"]) for r in told.collect()}
    assert got["acme"] == got[""] == ("e1", "KEPT") and got["zeta"] == ("e2", "ALIAS") and got["gone"] == ("e2", "EXACT") and got["near old"] == ("e2", "MERGED") and got["between"] == ("e2", "REVIEW")
    assert got["far"][1] == "MINTED" and [r["alias_keys"] for r in kept.collect()] == [[]]
    first = entities.resolve(m.drop("entity_id").where("surface_key <> 'gone'"), canon.where("entity_id = 'e2'").withColumn("canonical_name", F.lit("")), P)
    grown = {r["entity_id"]: r["alias_keys"] for r in entities.grown(canon.where("entity_id = 'e2'"), first, m).collect()}
    assert "near old" in grown["e2"] and len(grown) > 1


def test_rescored_reads_and_writes_touched_subjects_only(spark, tmp_path):
    c, (members, f), edges, _ = _edges(spark, SF)
    at = members.select("claim_id", F.concat(F.lit("fact:"), F.col("root")).alias("fact_id"))
    att = c.select("attestor_key").distinct().withColumns({"trust_prior": F.lit(0.6), "trust": F.lit(0.6)})
    claims = save(c.join(at, "claim_id").withColumn("declared", F.lit(False)), "claims", by="subject_id")
    f, edges = save(f, "facts", by="subject_id"), save(edges, "edges", by="subject_id")
    folder = str(tmp_path / "scores")
    incremental.store_scores(scoring.score(claims, f, att, edges, P), folder)
    files = lambda: {(r["subject_id"], r["file"]) for r in spark.read.parquet(f"{folder}/facts").select("subject_id", F.col("_metadata.file_name").alias("file")).distinct().collect()}
    before = files()
    touched = edges.select("subject_id").distinct().orderBy("subject_id").limit(1)
    name = touched.collect()[0][0]
    less = save(edges.where(F.col("subject_id") != name).select(*edges.columns), "edges", by="subject_id")
    incremental.rescored(claims, f, att, less, touched, folder, P)
    want = {tuple(r) for r in scoring.score(claims, f, att, less, P)["facts"].select("subject_id", "fact_id", F.round("belief", 9)).collect()}
    got = {tuple(r) for r in incremental.stored_scores(spark, folder)["facts"].select("subject_id", "fact_id", F.round("belief", 9)).collect()}
    assert got == want
    assert {s for s, _ in before ^ files()} == {name}
    plan = claims.where(incremental.of_subjects(touched))._jdf.queryExecution().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*subject_id[^\]]*{name}", plan)


def test_exact_neighbours_with_pruning(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(6, 8))
    x = centers[r.integers(0, 6, 900)] + r.normal(size=(900, 8)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    group = np.array(["a" if i % 4 else "b" for i in range(900)])
    df = spark.createDataFrame([(g, f"k{i:04d}", v) for i, (g, v) in enumerate(zip(group.tolist(), x.tolist(), strict=True))], "subject_id string, claim_id string, embedding array<double>")
    sim = np.round(x @ x.T, 10)
    sim[group[:, None] != group] = -9
    np.fill_diagonal(sim, -9)
    told: dict = {}
    got = similar(df, df, 0.9, block_rows=64, told=told)
    assert {(t["x"], t["y"]) for t in got.collect()} == {(f"k{i:04d}", f"k{j:04d}") for i, j in zip(*np.nonzero(sim >= 0.9), strict=True)}
    assert told["met"] < 0.7 * told["pairs"]
    best: dict = {}
    for t in similar(df, df, -2.0, 3, block_rows=64).collect():
        best.setdefault(t["x"], []).append((-t["sim"], t["y"]))
    want = {f"k{i:04d}": sorted((-sim[i, j], f"k{j:04d}") for j in range(900) if group[i] == group[j] and i != j)[:3] for i in range(900)}
    assert {k: [y for _, y in sorted(v)[:3]] for k, v in best.items()} == {k: [y for _, y in v] for k, v in want.items()}


def test_overlaps_of_all_lengths(spark):
    r = random.Random(8)
    rows = [(k % 3, k, s := r.randrange(1_000_000), s + int(10 ** r.uniform(0, 6))) for k in range(300)] + [(0, 900, 5, 5), (None, 901, 1, 9), (1, 902, None, 7)]
    df = spark.createDataFrame(rows, "place long, occupant long, s long, e long").select("place", "occupant", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    good = [x for x in rows if None not in x and x[2] < x[3]]
    want = {(a[0], *[x[1] for x in sorted((a, b), key=lambda x: (x[2], x[1]))]) for a in good for b in good if a[1] < b[1] and a[0] == b[0] and a[2] < b[3] and b[2] < a[3]}
    got = all_overlaps(df).select("place", "first", "second").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_blocks_of_a_batch_are_read_one_by_one():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from evidentia.operators import blocks

    class Given:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    x = np.random.default_rng(1).normal(size=(128, 64))
    kind = pa.list_(pa.struct([("id", pa.string()), ("v", pa.list_(pa.float64()))]))
    rows = [{"id": f"{k:03d}", "v": v.tolist()} for k, v in enumerate(x)]
    n = 40
    batch = pa.RecordBatch.from_arrays([pa.array(["g"] * n), pa.array(range(n), pa.int64()), pa.array([rows] * n, kind), pa.array([rows[::-1]] * n, kind)], ["group", "xb", "xs", "ys"])
    run = blocks._met(Given(), "group", "string", -1e9, 1, True)
    tracemalloc.start()
    found = [(b["xb"][0].as_py(), len(b), b["x"].to_pylist() + b["y"].to_pylist() if k == 0 else None) for k, b in enumerate(run([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    assert [f[:2] for f in found] == [(k, 128) for k in range(n)] and found[0][2] == [r["id"] for r in rows] + [rows[k]["id"] for k in sim.argmax(1)]
    assert peak < 4e6  # of 10 MB of numbers in the batch


def test_the_best_alone_leave_a_shelf(spark, monkeypatch):
    from evidentia.operators import blocks

    monkeypatch.setattr(blocks, "SHELF", 2, raising=False)
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 6)).astype(np.float32)
    x[1:40] = x[0]
    df = spark.createDataFrame([("s" if i % 5 else "t", f"k{i:03d}", v) for i, v in enumerate(x.tolist())], "subject_id string, claim_id string, embedding array<float>")
    sim = np.round(x.astype(np.float64) @ x.T.astype(np.float64), 10)
    want = {(f"k{i:03d}", f"k{j:03d}") for i in range(400) for _, j in sorted((-sim[i, j], j) for j in range(400) if i != j and (i % 5 > 0) == (j % 5 > 0) and sim[i, j] >= 0.1)[:3]}
    got = [(t["x"], t["y"]) for t in similar(df, df, 0.1, 3, block_rows=32).collect()]
    assert len(got) == len(want) and set(got) == want
    other = {(t["x"], t["y"]) for t in similar(df, df, 0.1, block_rows=32, same=False).collect()}
    assert other == {(f"k{i:03d}", f"k{j:03d}") for i in range(400) for j in range(400) if (i % 5 > 0) == (j % 5 > 0) and sim[i, j] >= 0.1}
