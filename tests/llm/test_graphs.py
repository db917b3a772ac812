"""Hard negatives, the prefix trie and the flat graph against brute force."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from evidentia.llm import entries, flatgraph, negatives, trie
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [(9000, None, 1), (9001, [], 1), (9002, [1.0, None, 1.0, 1.0], 1), (9003, [float("nan")] * 4, 1), (9004, [float("inf")] * 4, 1), (9100, [0.5, 0.5], 1), (9200, [0.0] * 4, 2), (9005, [1.0] * 4, None), (None, [1.0] * 4, 1)]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


# --- hard negatives


def brute_negatives(rows, chosen, low=30, high=90):
    ints = [(i, [math.floor(256 * Fraction(x)) for x in v], k) for i, v, k in rows if i is not None and k is not None and good(v)]
    out = []
    for a, v, label in {(i, tuple(v), k) for i, v, k in ints if i % 100 == 0 and i in chosen}:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, k) for i, w, k in ints if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            hits = [(t, n) for t, n, k in scored if k != label and 100 * -t >= low * -s and 100 * -t <= high * -s][:10]
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(hits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))


def test_negatives_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, entries.op11_hard_negatives(spark, SF).collect()))
    assert got == brute_negatives(rows, {r[0] for r in rows}) and len(got) > 200


@pytest.mark.parametrize("block,box", [(16, 2), (8192, 1024)])
def test_negatives_with_ties_copies_and_odd_rows(spark, block, box):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.integers(-2, 5, 4) / 4], int(i % 3)) for i in range(0, 600, 2)]
    rows += rows[:40] + [(100, [0.5, 0.5, 0.25, 1.0], 1), (300, [3.0e5, -2.0e5, 1.0, 0.0], 2), (302, [1.0e12, 3.0, -1.0e12, 2.0**40], 2), (304, [2.0e5, 1.0, 0.0, 0.0], 0), *ODD]
    df = frame(spark, rows)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block_rows=block, box_rows=box)
    cut = lambda x: max(min(x, 2**63 - 1), 1 - 2**63)
    want = [(*x[:4], cut(x[4]), cut(x[5])) for x in brute_negatives(rows, {x[0] for x in rows})]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0 and negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_intervals_drop_pairs_and_keep_all_that_qualify():
    r = np.random.default_rng(3)
    x, q = (np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64) for v in (r.normal(size=(4000, 64)), r.normal(size=(8, 64))))
    exact = q @ x.T
    low, high = np.full((8, 1), 5000.0), np.full((8, 1), 15000.0)
    a, b, s = negatives.survivors(q, x, np.ones(exact.shape, bool), low, high, np.full((8, 1), -np.inf), 10)
    assert (exact[a, b] == s).all() and len(a) < 0.05 * exact.size
    for i in range(8):
        want = sorted(v for v in exact[i] if 5000 <= v <= 15000)[-10:]
        assert sorted(v for v in s[a == i] if 5000 <= v <= 15000)[-10:] == want


# --- prefix trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    convs = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = sum(not any(len(k) == len(x) + 1 and k[: len(x)] == x for k in members) for x in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(c for c in own if built[c] == key))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, entries.op12_prefix_trie(spark, SF).collect())) == brute_trie(rows)


@pytest.mark.parametrize("block", [3, 1024])
def test_trie_with_gaps_copies_long_and_hot_conversations(spark, block):
    r = np.random.default_rng(4)
    rows = [(c, t, ("user", "assistant")[t % 2], f"t{min(int(r.integers(0, 3)), t)}") for c in range(60) for t in range(int(r.integers(1, 7)))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)] + [(200, t, "user", f"long {t // 2}") for t in range(40)] + [(203, t, "user", f"long {t // 2}") for t in range(33)]
    rows += [(70, None, None, None), (70, None, "user", "é"), (70, 1, "user", None), (71, 0, "user", "a"), (71, 0, "user", "a"), (71, 0, "assistant", "a"), (-3, 0, "user", "x"), (-5, 0, "user", "y"), (None, 0, "user", "lost"), (10**12 + 1, 5, "user", "z" * 70_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    assert sorted(map(tuple, trie.prefix_trie(df, block=block).collect())) == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_ids_of_an_end_are_hashed_in_chunks(spark):
    ends = spark.range(5000).select(F.lit(7).cast("long").alias("conv_id"), F.lit(2).cast("long").alias("depth"), F.col("id").alias("member"))
    want = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert [r["ends_sha256"] for r in trie.digests(ends, chunk_bytes=100).collect()] == [want]


# --- flat graph


def brute_links(rows, least=0.95):
    n, top = [0] * len(rows), list(range(len(rows)))
    scaled = lambda v: np.array(v, float) / max(map(abs, v))
    unit = [scaled(v) / np.linalg.norm(scaled(v)) if i is not None and good(v) and any(v) else None for i, v, _ in rows]

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                n[a] += 1
                x, y = sorted((root(a), root(b)), key=lambda k: rows[k][0])
                top[y] = x
    least_of = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least_of[root(k)] = min(i, least_of.get(root(k), i))
    return sorted(((i, n[k], None if i is None else least_of[root(k)], i is not None and least_of[root(k)] == i) for k, (i, *_) in enumerate(rows)), key=str)


@pytest.mark.parametrize("shard,block", [(40, 16), (4096, 2048)])
def test_near_copies_equal_brute_force(spark, shard, block):
    r = np.random.default_rng(6)
    centers = r.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centers[i % 30 if i < 240 else 0] + r.normal(size=16) * (0.05 if i % 4 else 0.4)], 0) for i in range(360)]
    rows += rows[:7] + [(1000 + k, [2.0 * x for x in rows[k][1]], 0) for k in range(5)] + [(2000 + k, [float(x) for x in r.normal(size=16)], 0) for k in range(60)]
    rows += [(i, v, k) for i, v, k in ODD] + [(9300, [1e300, 1e300, 0.0, 0.0], 0), (9301, [1e-300, 1e-300, 0.0, 0.0], 0)]
    got = flatgraph.near_duplicates(frame(spark, rows), shard_rows=shard, block_rows=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)


def test_graph_search_finds_what_is_in_range():
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 24))
    x[500:1300] = x[:1] + r.normal(size=(800, 24)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = flatgraph.graph(x)
    assert lists.shape == (1500, flatgraph.DEGREE)
    who, node = flatgraph.in_range(x, lists, x, np.full(len(x), -1), 0.95, flatgraph.BEAM)
    found, want = set(zip(who.tolist(), node.tolist(), strict=True)), set(zip(*map(list, np.nonzero(x @ x.T >= 0.95)), strict=True))
    assert found <= want and len(found) > 0.97 * len(want) > 10_000


def test_a_search_that_misses_is_told_and_widened(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 4, [1.0, i * 1e-3, 0.0, 0.0], 1) for i in range(50)], "id long, dim int, x array<double>, copies long")
    links = lambda n: spark.createDataFrame([(i, n) for i in range(50)], "id long, links long")
    assert flatgraph.audited(rows, links(49), 0.95) == 1.0 and abs(flatgraph.audited(rows, links(10), 0.95) - 10 / 49) < 1e-9
    seen = []
    whole = flatgraph.searched
    monkeypatch.setattr(flatgraph, "searched", lambda *a: seen.append(a[-2:]) or (whole(*a).limit(0) if len(seen) == 1 else whole(*a)))
    r = np.random.default_rng(9)
    df = frame(spark, [(i, [float(v) for v in np.eye(4)[i % 4] + r.normal(size=4) * 0.01], 0) for i in range(40)])
    assert flatgraph.near_duplicates(df).where("n_links <> 9").count() == 0 and len(seen) == 2 and seen[1][1] > seen[0][1]


def test_flat_graph_query(spark):
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, entries.op13_embedding_near_dedup(spark, SF).collect()), key=str) == brute_links(rows)
    assert flatgraph.near_duplicates(frame(spark, ODD).limit(0)).count() == 0
