"""Exact search against brute force, mixing against its targets, the pipeline against its stages."""

import math
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from evidentia.llm import entries, mips, mixing
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.001"


def brute_top(vectors, queries, k=5):
    ints = lambda v: [math.floor(256 * Fraction(float(x))) for x in v]
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    rows = [(i, ints(v)) for i, v in vectors if good(v)]
    out = set()
    for q, v in [(i, ints(v)) for i, v in queries if good(v)]:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def test_search_query_equals_brute_force(spark):
    v = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert set(map(tuple, entries.op3_exact_top_k(spark, SF).collect())) == brute_top(v, [x for x in v if x[0] % 50 == 0])


@pytest.mark.parametrize("shard,block", [(40, 3), (10_000, 1000)])
def test_search_with_ties_gaps_and_odd_vectors(spark, shard, block):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4) / 4]) for i in range(300)] + [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (950, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = mips.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=shard, block_queries=block)
    assert set(map(tuple, got.collect())) == brute_top(rows, [x for x in rows if x[0] % 50 == 0])


def test_search_with_components_of_any_size(spark):
    r = np.random.default_rng(4)
    rows = [(1, [70000.0, 1.0]), (50, [1.0, 2.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(map(tuple, mips.top_k(df, df.where("vec_id = 50")).collect())) == brute_top(rows, rows[1:2])
    near = 2.0**16 - 2.0**-8
    rows = [(i, [float(x) for x in near - r.integers(0, 3, 64) * 2.0**-8]) for i in range(60)]
    rows += [(100 + i, [float(x) for x in r.normal(size=64) * 10.0 ** r.integers(-3, 9)]) for i in range(60)] + [(200 + i, [float(x) for x in r.normal(size=64)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(q, k, v, min(max(s, -(2**63) + 1), 2**63 - 1)) for q, k, v, s in brute_top(rows, [x for x in rows if x[0] % 25 == 0])}
    for shard in (40, 16384):
        assert set(map(tuple, mips.top_k(df, df.where("vec_id % 25 = 0"), shard_rows=shard, block_queries=4).collect())) == want


def test_distant_shards_are_skipped(spark, monkeypatch):
    r = np.random.default_rng(5)
    centers = r.normal(size=(8, 16)) * 20
    rows = [(i, [float(x) for x in centers[i % 8] + r.normal(size=16) * 0.1]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mips.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=200, block_queries=10)
    assert set(map(tuple, got.collect())) == brute_top(rows, [x for x in rows if x[0] % 50 == 0])
    top = mips.cells(np.array([x for _, x in rows]), 8)
    assert top[1] == 8 and len({tuple(sorted(set(mips.cell_of(top[0], np.array([x for i, x in rows if i % 8 == k]))))) for k in range(8)}) == 8


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mips.top_k(df, df).count() == 0


def test_tree_bounds_hold():
    r = np.random.default_rng(2)
    rows = r.integers(-50, 50, (2000, 8)) / 256
    tree = mips.build_tree(np.arange(2000), rows)
    for (a, b), c, radius in zip(tree["spans"], tree["centers"], tree["radii"], strict=True):
        q = r.normal(size=8)
        assert (mips.integers(tree["x"][a:b]) @ q).max() <= q @ c + np.linalg.norm(q) * radius + 1e-6


def test_totals_meet_targets(spark):
    d = "/root/testdata/sf0.01"
    got = entries.op8_source_mixing(spark, d).cache()
    n = got.agg(F.sum("n_tokens")).first()[0]
    for k, share in mixing.WEIGHTS.items():
        assert got.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{k}"))).first()[0] / n == pytest.approx(share, abs=0.01)
    assert got.where("rate < 0").count() == 0
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", mixing.domain_of().alias("domain"))
    best = F.array_max(F.array(*[F.struct(F.col(f"p_{k}").alias("p"), F.lit(k).alias("k")) for k in mixing.DOMAINS]))["k"]
    assert got.join(labels, "doc_id").agg(F.avg((best == F.col("domain")).cast("int"))).first()[0] > 0.9


def test_the_classifier_on_labels_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", mixing.domain_of().alias("domain"))
    seen = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(4)) > 0
    scored = mixing.score(docs, mixing.fit_classifier(docs, labels.where(seen)))
    best = F.array_position("p", F.array_max("p")) - 1
    hit = scored.join(labels.where(~seen), "doc_id").agg(F.avg((F.element_at(F.array(*map(F.lit, mixing.DOMAINS)), (best + 1).cast("int")) == F.col("domain")).cast("int"))).first()[0]
    assert hit > 0.9


def test_totals_are_reported(spark):
    rows = {r["domain"]: r for r in entries.source_mix_totals(spark, "/root/testdata/sf0.01").collect()}
    assert rows.keys() == set(mixing.DOMAINS) and all(abs(r["gap"]) < 0.01 and r["converged"] for r in rows.values())


def test_rates_against_a_plain_solver():
    r = np.random.default_rng(6)
    p, n = r.dirichlet([1, 1, 1], 40), r.integers(1, 50, 40).astype(float)
    target = np.array([0.5, 0.3, 0.2]) * n.sum()
    moments = (p * n[:, None]).T @ p / n.sum() + 1e-6 * np.eye(3)
    inverse, history = np.linalg.inv(moments), []
    for _ in range(60):
        at = mixing.rates_after(p, history, 1e-3, 1.5)[1] if history else np.ones(40)
        history.append(inverse @ (((at * n) @ p - target) / n.sum()))
    rate = mixing.rates_after(p, history, 1e-3, 1.5)[0]
    cost = lambda x: float((((x * n) @ p - target) / n.sum()) @ inverse @ (((x * n) @ p - target) / n.sum()) + 1e-3 * (n * (x - 1) ** 2).sum() / n.sum())
    for _ in range(300):
        assert cost(rate) <= cost(np.clip(rate + r.normal(size=40) * 10.0 ** -r.integers(1, 5), 0, 1.5)) + 1e-7


def test_history_gives_the_projected_rates():
    r = np.random.default_rng(3)
    p = r.dirichlet([1, 1, 1], 50)
    history = [r.normal(size=3) for _ in range(5)]
    rate, _ = mixing.rates_after(p, history, 0.01, 1.5)
    assert rate.min() >= 0 and rate.max() <= 1.5
    first, _ = mixing.rates_after(p, history[:1], 0.01, 1.5)
    assert first == pytest.approx(np.clip(1 - (p @ history[0]) / 1.01, 0, 1.5))


def test_awkward_mixing(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.mix(awkward, none)
    assert got.count() == 8 and got.where("abs(p_clean - 1/3) > 1e-9").count() == 0
    assert mixing.mix(nothing, none).count() == 0
    assert mixing.mixed(awkward, none, mixing.WEIGHTS, 1.0, 2.0).columns == awkward.columns
    clash = awkward.withColumn("draw", F.lit(5.0))
    assert {r["draw"] for r in mixing.mixed(clash, none, mixing.WEIGHTS, 1.0, 2.0).collect()} <= {5.0}


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids, sizes = {r["doc_id"] for r in docs.collect()}, []
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= ids
        assert docs.columns == columns or name == pipeline.STAGES[-1][0]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * len(ids)
    clean = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    kept = clean.join(docs, "doc_id", "left_semi").count()
    assert kept > 0.75 * clean.count() and docs.where("NOT exact").count() == 0


def plain_first_of_near(rows):
    """Ids that stay: the smallest of each group linked by an exact Jaccard similarity of 0.8 of five-word shingles."""

    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, top = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            both = len(sets[a] & sets[b])
            if both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i for i in order if root(i) == i}


def test_pipeline_run_against_a_plain_version(spark):
    from evidentia.llm import langid, pieces, secrets

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = langid.fit(docs)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {i: t for i, t in rows.items() if langid.has_letter(t) and trees.score(langid.to_bytes(t)).min() <= langid.MOST_BITS * (len(langid.to_bytes(t)) - langid.ORDER)}
    first = plain_first_of_near(known.items())
    frame = docs.where(F.col("doc_id").isin(list(first)))
    text, least = secrets.fit(frame)
    clean = {i: secrets.redact(known[i], text, least) for i in first}
    as_rows = [(*[r[c] for c in docs.columns if c not in ("text", "n_chars")], clean[r["doc_id"]], len(clean[r["doc_id"]])) for r in frame.collect()]
    names = [c for c in docs.columns if c not in ("text", "n_chars")] + ["text", "n_chars"]
    redone = spark.createDataFrame(as_rows, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)).select(*docs.columns)
    mixed = mixing.mixed(redone, spark.read.parquet(f"{SF}/labels.parquet"), pipeline.WEIGHTS, budget="keep:clean", max_rate=1.0)
    want = {i for (i,) in mixed.select("doc_id").collect()}
    enc = pieces.encoder(pieces.MODEL)
    got = pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want) and len(want) > 100
    for r in got:
        assert r["exact"] and r["n_pieces"] == len(enc.encode_many([clean[r["doc_id"]]])[0])


def test_documents_with_a_map_are_deduplicated(spark):
    from evidentia.llm import simhash

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, {"a": "x"}), (2, text + " more", {"a": "y"}), (3, "other " * 9, None), (3, "other " * 9, None), (4, "alone in this table with its own words", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,string>").withColumn("deep", F.array(F.struct("meta")))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == [1, 3, 4] and simhash.one_of_each(df).columns == df.columns
