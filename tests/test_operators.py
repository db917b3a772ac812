"""Small cases of matching, judging, assembly, planning, validation, limits and sources."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from evidentia.config import Params
from evidentia.functions import dates, jsonio, text
from evidentia.functions.vectors import pseudo_embedding
from evidentia.operators import assembly, blocks, entities, iterate, judging, lifecycle, matching, publish, serialization, training
from evidentia.sources import tables
from evidentia.streaming import limits

P = Params()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("a,b", [("R. Mehta", "r mehta"), ("B.E.", "BE"), ("O'Brien", "obrien"), ("full-stack", "full stack"), ("Café", "cafe")])
def test_surfaces_that_are_one(spark, a, b):
    assert one(spark, text.normalize_surface(F.lit(a))) == one(spark, text.normalize_surface(F.lit(b)))


@pytest.mark.parametrize("a,want", [("C++", "c++"), ("C#", "c#"), ("CI/CD", "ci/cd")])
def test_surfaces_keep_their_symbols(spark, a, want):
    assert one(spark, text.normalize_surface(F.lit(a))) == want


def test_shingles_and_jaccard(spark):
    assert one(spark, text.word_shingles(F.lit("The quick, brown fox"))) == ["the quick brown", "quick brown fox"]
    assert one(spark, text.word_shingles(F.lit("Hi there"))) == ["hi", "there"] and one(spark, text.word_shingles(F.lit(""))) == []
    empty = F.array().cast("array<string>")
    assert one(spark, text.jaccard(empty, empty)) == 1.0


def test_sentences_drop_by_token(spark):
    got = one(spark, text.without_sentences(F.lit("- Keep this. Mail {{email}} now. And this!\nWhole {{email}} line"), "{{email}}"))
    assert got == "- Keep this. And this!"


def test_json_helpers(spark):
    assert [one(spark, jsonio.kind(F.lit(x))) for x in ('{"a":1}', "[1]", "3", " ", "{")] == ["OBJECT", "ARRAY", "SCALAR", None, None]
    cut = '```json\n[{"a": 1}, {"a": 2}, {"a": \n```'
    assert [r["a"] for r in one(spark, jsonio.parsed_rows(F.lit(cut), "struct<a:int>"))] == [1, 2]
    assert one(spark, jsonio.outermost_object(F.lit('so {"a": {"b": 1}} there'))) == '{"a": {"b": 1}}'


def test_pseudo_embedding_is_unit_and_similar_for_similar_texts(spark):
    v = [one(spark, pseudo_embedding(F.lit(t))) for t in ("payments migration", "the payments migration", "juggling")]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert dot(v[0], v[0]) == pytest.approx(1) and dot(v[0], v[1]) > 0.6 > dot(v[0], v[2])


@pytest.mark.parametrize("a,b,events,want", [(("2019", "2019"), ("2019-06-01", "2019-06-02"), False, True), (("2018", "2018"), ("2019", "2020"), False, False), (("2019-01-01", "2019-01-02"), ("2019-05-01", "2019-05-02"), True, True), ((None, None), ("2019", "2019"), False, None)])
def test_interval_overlap(spark, a, b, events, want):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, dates.intervals_overlap(lit(a[0]), lit(a[1]), lit(b[0]), lit(b[1]), F.lit(events))) is want


# --- matching

CLAIMS = "subject_id string, claim_id string, claim_type string, text string, claimed_date string, asset_id string, explained boolean, exemplar_claim_id string"


def graded(spark, claims, pairs, p=P, shares=None):
    c = spark.createDataFrame([("s", *r) for r in claims], CLAIMS)
    rows = spark.createDataFrame([("s", a, b, sorted(src), sim) for a, b, src, sim in pairs], "subject_id string, a string, b string, sources array<string>, sim double")
    sh = spark.createDataFrame([("s", *x) for x in shares], "subject_id string, a string, b string, min_share double") if shares else None
    out = matching.rungs(rows.drop("sim"), c, rows.select("subject_id", "a", "b", "sim").where("sim IS NOT NULL"), p, sh)
    return c, out


def claim(i, kind="EPISODE", words="x", date=None, asset=None, explained=False, exemplar=None):
    return (i, kind, words, date, asset, explained, exemplar)


def test_every_rung(spark):
    claims = [claim("a"), claim("b"), claim("c", asset="k", words="Same text."), claim("d", asset="k", words="same  text"), claim("e", "IDENTITY"), claim("f", "VALUE"), claim("g", date="2010"), claim("h", date="2020"), claim("i", exemplar="z"), claim("j", exemplar="z")]
    pairs = [("a", "b", ["KNN"], 0.5), ("c", "d", ["KNN"], 0.7), ("a", "c", ["KNN"], 0.95), ("e", "f", ["CO_MENTION"], 0.1), ("g", "h", ["KNN"], 0.7), ("i", "j", ["KNN"], 0.7), ("a", "d", ["HUMAN"], None), ("b", "c", ["CO_MENTION"], 0.1), ("b", "d", ["KNN"], 0.7)]
    _, out = graded(spark, claims, pairs, shares=[("b", "c", 0.5), ("e", "f", 0.1)])
    got = {(r["a"], r["b"]): r["outcome"] for r in out.collect()}
    assert got == {("a", "b"): "DISCARDED", ("c", "d"): "REPEATS_2", ("a", "c"): "REPEATS_3", ("e", "f"): "DISCARDED", ("g", "h"): "DISCARDED", ("i", "j"): "SAME_FACT", ("a", "d"): "QUEUED", ("b", "c"): "IDF_GATED", ("b", "d"): "QUEUED"}
    _, wide = graded(spark, claims, pairs, replace(P, matching_mode="EXHAUSTIVE"))
    assert {(r["a"], r["b"]) for r in wide.where("outcome = 'DISCARDED'").collect()} == set()


def test_queue_merges_exemplars_ranks_people_first_and_caps(spark):
    claims = [claim(x) for x in "abcdez"] + [claim("m", exemplar="z", explained=True), claim("n", exemplar="z")]
    pairs = [("a", "m", ["KNN"], 0.7), ("a", "n", ["STRUCTURAL"], 0.8), ("a", "b", ["KNN"], 0.65), ("b", "c", ["KNN"], 0.75), ("c", "d", ["KNN"], 0.7), ("d", "e", ["HUMAN"], 0.1)]
    c, out = graded(spark, claims, pairs)
    queue, capped = matching.judge_queue(out, c, replace(P, candidates_per_claim=1))
    got = [(r["a"], r["b"], r["human_asserted"], r["block_score"]) for r in queue.orderBy("rank").collect()]
    assert got == [("d", "e", True, 0.1), ("a", "z", False, 0.8), ("b", "c", False, 0.75), ("c", "d", False, 0.7), ("a", "b", False, 0.65)]
    assert capped.count() == 0
    _, capped = matching.judge_queue(out.where("NOT (a = 'a' AND b IN ('m', 'n'))"), c, replace(P, candidates_per_claim=1))
    assert {(r["a"], r["b"]) for r in capped.collect()} == set()
    more = matching.judge_queue(out, c, replace(P, candidates_per_claim=0))[0]
    assert more.count() == 5


def test_structural_window(spark):
    c = spark.createDataFrame([("s", "a", "EPISODE", "2019"), ("s", "b", "EPISODE", "2021-05"), ("s", "c", "EPISODE", "2010"), ("s", "d", "SKILL", "2019"), ("t", "e", "EPISODE", "2019"), ("s", "f", "EPISODE", "2014")], "subject_id string, claim_id string, claim_type string, claimed_date string")
    assert {(r["a"], r["b"]) for r in matching.structural_pairs(c, P).collect()} == {("a", "b"), ("c", "f"), ("a", "f")}


# --- judging


def votes(spark, rows):
    return judging.aggregate_votes(spark.createDataFrame([("a", "b", False, i, r, c, f"r{i}", None, x) for i, (r, c, x) in enumerate(rows)], "a string, b string, with_context boolean, sample_index int, relation string, confidence double, rationale string, temporal_note string, explanation_relevant boolean"), P).collect()[0]


def test_majority_confidence_and_floor(spark):
    r = votes(spark, [("CONTRADICTS", 0.9, True)] * 4 + [("NEUTRAL", 0.5, False)])
    assert r["relation"] == "CONTRADICTS" and r["confidence"] == pytest.approx(0.72) and r["explanation_relevant"] and not r["tie"] and r["rationale"] == "r0"
    r = votes(spark, [("CONTRADICTS", 0.6, None)] * 3 + [("NEUTRAL", 0.5, None), ("REPEATS", 0.5, None)])
    assert r["relation"] == "NEUTRAL" and r["floored"] and r["confidence"] == pytest.approx(0.36) and not r["explanation_relevant"]


def test_ties_never_escalate(spark):
    r = votes(spark, [("NEUTRAL", 0.5, None)] * 2 + [("CONTRADICTS", 0.9, None)] * 2 + [("CORROBORATES", 0.9, None)])
    assert r["relation"] == "NEUTRAL" and r["tie"]


# --- assembly


def test_components_and_facts(spark):
    schema = "subject_id string, claim_id string, claim_type string, text string, claimed_date string, source_class string, mention_types array<string>"
    c = spark.createDataFrame([("s", "c1", "EPISODE", "short", "2019", "SELF", []), ("s", "c2", "EPISODE", "a longer text", "2020-05", "ENDORSEMENT", ["ORG"]), ("s", "c3", "EPISODE", "longest text of all", None, "DOCUMENTARY", []), ("s", "c4", "VALUE", "alone", " ", "SELF", None)], schema)
    m = assembly.clusters(c, spark.createDataFrame([("c2", "c1"), ("c3", "c2"), ("c3", "nowhere")], "a string, b string"))
    f = {r["fact_id"]: r for r in assembly.facts(c, m).collect()}
    assert set(f) == {"fact:c1", "fact:c4"}
    x = f["fact:c1"]
    assert (x["exemplar_claim_id"], x["fact_kind"], x["slot"], x["valid_from"], x["valid_to"], x["date_precision"], x["anchored"], x["member_count"]) == ("c3", "STATE", "EMPLOYER", "2019", "2020-05", "YEAR", True, 3)
    assert (f["fact:c4"]["fact_kind"], f["fact:c4"]["date_precision"]) == ("TIMELESS", "NONE")


def test_replies_in_batches_give_the_verdicts_of_samples(spark):
    """Verdicts told from a judge's batches are those of sample rows: ties, floors, equal confidences, answers not said."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    n, k, p = 600, 5, Params(confidence_floor=0.4)
    relation, confidence, said = r.integers(0, 4, (n, k)), r.integers(50, 60, (n, k)) / 60, r.integers(-1, 2, (n, k))
    texts = [[f"r{i}" for i in range(k)] for _ in range(n)]
    notes = [[None if x % 2 else f"n{i}" for i, x in enumerate(row)] for row in relation + said]

    def judge(batch):
        at = np.array([int(x) for x in batch["a"].to_pylist()], int)
        flat = lambda rows: pa.array([x for i in at for x in rows[i]], pa.string())
        return judging.Replies(relation[at], confidence[at], flat(texts), flat(notes), said[at])

    pairs = spark.createDataFrame([(str(i), "y", i * 2) for i in range(n)], "a string, b string, more long")
    sample = "array<struct<sample_index: int, relation: string, confidence: double, rationale: string, temporal_note: string, explanation_relevant: boolean>>"
    rows = [(str(i), "y", i * 2, [(j, judging.PRECEDENCE[relation[i][j]], float(confidence[i][j]), texts[i][j], notes[i][j], None if said[i][j] < 0 else bool(said[i][j])) for j in range(k)]) for i in range(n)]
    plain = {x["a"]: x for x in judging.verdicts(spark.createDataFrame(rows, f"a string, b string, more long, samples {sample}"), p).collect()}
    got = judging.judged(pairs, judge, p).collect()
    assert len(got) == n and all(x.asDict() == plain[x["a"]].asDict() for x in got)
    few = judging.judged(pairs, judge, p, ("confidence",), only=("CORROBORATES", "CONTRADICTS"))
    assert few.columns == ["a", "b", "more", "confidence"]
    assert {x["a"]: x["confidence"] for x in few.collect()} == {a: x["confidence"] for a, x in plain.items() if x["relation"] in ("CORROBORATES", "CONTRADICTS")}


def test_contradictions_need_a_shared_time(spark):
    fact = "subject_id string, fact_id string, valid_from string, valid_to string, date_precision string, fact_kind string"
    f = spark.createDataFrame([("s", "fact:a", "2019", "2019", "YEAR", "EVENT"), ("s", "fact:b", "2019-05-01", "2019-05-01", "DAY", "EVENT"), ("s", "fact:c", "2022", "2022", "YEAR", "EVENT"), ("s", "fact:d", None, None, "NONE", "TIMELESS"), ("s", "fact:e", None, None, "NONE", "TIMELESS")], fact)
    m = spark.createDataFrame([("s", x, x) for x in "abcde"], "subject_id string, claim_id string, root string")
    pair = lambda a, b, note=None: ("s", a, b, "CONTRADICTS", 0.8, "r", note, False, None, None, None, ["x"])
    j = spark.createDataFrame([pair("a", "b"), pair("a", "c"), pair("a", "d", "same"), pair("d", "e", "The SAME span"), pair("a", "a")], "subject_id string, a string, b string, relation string, confidence double, rationale string, temporal_note string, ctx_judged boolean, ctx_relation string, ctx_confidence double, ctx_explanation_relevant boolean, shared_entities array<string>")
    kept, counts = assembly.lift_edges(j, m, f)
    assert {(r["from_fact"], r["to_fact"], r["temporal_overlap"]) for r in kept.collect()} == {("fact:a", "fact:b", True), ("fact:d", "fact:e", False)}
    r = counts.collect()[0]
    assert (r["same_fact"], r["gated"]) == (1, 2)


def test_facts_of_one_claim_count_pairs_within_them(spark):
    """A pair of a claim with itself lies within its fact, whether or not the facts say how many members they have."""
    fact = "subject_id string, fact_id string, valid_from string, valid_to string, date_precision string, fact_kind string, member_count long"
    f = spark.createDataFrame([("s", "fact:a", "2019", "2019", "YEAR", "EVENT", 1)], fact)
    m = spark.createDataFrame([("s", "a", "a")], "subject_id string, claim_id string, root string")
    j = spark.createDataFrame([("s", "a", "a", "CORROBORATES", 0.8, "r", None, False, None, None, None, ["x"])], "subject_id string, a string, b string, relation string, confidence double, rationale string, temporal_note string, ctx_judged boolean, ctx_relation string, ctx_confidence double, ctx_explanation_relevant boolean, shared_entities array<string>")
    for facts_ in (f, f.drop("member_count")):
        kept, counts = assembly.lift_edges(j, m, facts_)
        assert kept.count() == 0 and [(r["same_fact"], r["gated"]) for r in counts.collect()] == [(1, 0)]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i + 1, i) for i in range(60)] + [(500, i) for i in range(400, 440)]
    got = dict(map(tuple, iterate.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 400 for i in [*range(400, 440), 500]}
    assert iterate.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- training sets


def test_pairs_of_equal_sets_are_dealt_to_many_tasks(spark):
    """One set of many copies: every pair of them, once, and not all in one task."""
    of = spark.range(300).select(F.lit("g").alias("subject_id"), F.col("id").alias("place"), F.when(F.col("id") < 280, 0).otherwise(F.col("id")).alias("rep"))
    got = training._equal_pairs(of, "subject_id", "place", part_rows=32).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["i"], r["j"]) for r in got) == [(i, j) for i in range(280) for j in range(i + 1, 280)]
    assert len({r["task"] for r in got}) == 4


def test_sets_that_stream_past_shelves_are_those_joined(spark):
    """Shelves of any size, of several groups, give the pairs of all sets against all, and so does the join on rare items."""
    import numpy as np

    r = np.random.default_rng(2)
    sets = [(g, i, [f"w{x}" for x in r.choice(30, r.integers(1, 9), replace=False)]) for g in "xy" for i in range(60)] + [("z", 0, ["w1"]), ("z", 1, [])]
    want = {(g, i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for g, i, a in sets for h, j, b in sets if g == h and i < j and len(set(a) & set(b)) >= 0.4 * len(set(a) | set(b)) > 0}
    df = spark.createDataFrame(sets, "subject_id string, place long, s array<string>")
    told = lambda rows: {(x["subject_id"], x["i"], x["j"]): x["similarity"] for x in rows.collect()}
    assert told(training.similar_sets(df, 0.4, shelved=True)) == pytest.approx(want) and told(training.similar_sets(df, 0.4)) == pytest.approx(want)
    few = training._on_shelves(df.where("size(s) > 0"), 0.4, "subject_id", "place", "s", shelf_rows=7)
    assert few.count() == len(want) and told(few) == pytest.approx(want)


def test_near_questions_keep_the_first(spark):
    long = "what did you learn while leading the payments migration at the bank last year"
    rows = [("s", 1, long), ("s", 2, long + " exactly"), ("s", 3, "something else entirely here"), ("s", 4, long), ("t", 5, long), ("s", 6, ""), ("s", 7, "")]
    got = training.keep_first_of_near(spark.createDataFrame(rows, "subject_id string, place long, question string"), P)
    assert {r["place"] for r in got.collect()} == {1, 3, 5, 6}


def test_greedy_removal_is_not_transitive(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [("s", 1, " ".join(w)), ("s", 2, " ".join(w[3:] + ["x"])), ("s", 3, " ".join(w[6:] + ["x", "y", "z"]))]
    got = training.keep_first_of_near(spark.createDataFrame(rows, "subject_id string, place long, question string"), P)
    assert {r["place"] for r in got.collect()} == {1, 3}


def test_fan_out_cap_and_subsets(spark):
    plans = [("s", i, ["a", f"b{i}"]) for i in range(5)] + [("s", 9, ["z"])]
    got = training.cap_fan_out(spark.createDataFrame(plans, "subject_id string, place long, claim_ids array<string>"), 3)
    assert {r["place"] for r in got.collect()} == {0, 1, 2, 9}
    c = spark.createDataFrame([("s", f"c{i:02}") for i in range(28)], "subject_id string, claim_id string")
    s = training.claim_subsets(c, P).collect()
    assert sorted(len(r["claim_ids"]) for r in s if r["lap"] == 0) == [12, 16] and {x for r in s if r["lap"] == 1 for x in r["claim_ids"]} == {f"c{i:02}" for i in range(28)}
    assert next(r for r in s if r["lap"] == 1 and r["chunk"] == 0)["claim_ids"][0] == "c07"


@pytest.mark.parametrize(
    "chain,want",
    [
        ([(0.9, True, False, False), (0.8, True, False, False)], (True, "very likely", [], [])), ([(0.9, True, False, False), (0.5, True, False, False)], (True, "it's reasonable to expect", [], [])),
        ([(0.9, False, True, False)], (True, "very likely", [], [])), ([(0.9, True, False, False)], (False, None, [], [])), ([(0.9, True, False, False), (0.3, True, True, False)], (False, None, [], [])),
        ([(0.9, True, True, False), (0.8, True, False, True)], (True, "very likely", ["f1"], [])), ([(0.9, True, False, False), (0.8, True, False, True)], (True, "it's reasonable to expect", [], ["f1"])), ([(0.8, False, False, True)], (False, None, [], [])),
    ],
)
def test_situational_conclusions(spark, chain, want):
    rows = [("s", "c", f"f{i}", *r) for i, r in enumerate(chain)]
    r = training.situational_hedge(spark.createDataFrame(rows, "subject_id string, chain_id string, fact_id string, belief double, independent boolean, anchored boolean, conflicted boolean"), P).collect()[0]
    assert (r["floors_met"], r["phrase"], r["dropped"], r["named_tension"]) == want


def test_similar_sets_equal_all_pairs(spark):
    import random

    r = random.Random(3)
    rows = [("s" if i % 3 else "t", i, [f"w{x}" for x in r.sample(range(12), r.randrange(0, 9))]) for i in range(60)]
    df = spark.createDataFrame(rows, "subject_id string, place long, s array<string>")
    for least in (0.3, 0.5, 0.85, 1.0):
        got = {(x["i"], x["j"]) for x in training.similar_sets(df, least).collect()}
        want = {(i, j) for g, i, a in rows for h, j, b in rows if g == h and i < j and a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= least}
        assert got == want


def test_blocks_find_what_all_pairs_find(spark):
    import random

    r = random.Random(4)
    rows = [("s" if i % 4 else "t", f"c{i:03}", [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(80)]
    df = spark.createDataFrame(rows, "subject_id string, claim_id string, embedding array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for block in (7, 1024):
        got = {(x["x"], x["y"]) for x in blocks.similar(df, df, 1.0, block_rows=block).collect()}
        assert got == {(a, b) for g, a, v in rows for h, b, w in rows if g == h and a != b and dot(v, w) >= 1.0}
    p = replace(P, sim_floor=0.5, knn_k=2)
    best = {a: sorted((-dot(v, w), b) for h, b, w in rows if g == h and a != b and dot(v, w) >= 0.5)[:2] for g, a, v in rows}
    assert {(x["a"], x["b"]) for x in matching.knn_pairs(df, p).collect()} == {(min(a, b), max(a, b)) for a, near in best.items() for _, b in near}


def test_a_common_entity_is_dealt_into_parts(spark):
    rows = [("s", f"c{i:02}", "hub") for i in range(30)] + [("s", f"c{i:02}", f"e{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "subject_id string, claim_id string, entity_id string")
    few, many = (sorted(map(tuple, matching.co_mention_pairs(df, P, part_rows=n).collect())) for n in (4, 2048))
    assert few == many and len(few) > 400


def test_training_phases_and_blockers(spark):
    at = "2026-01-01"
    m = spark.createDataFrame([("a", at, at, at, True), ("b", None, at, at, True), ("c", None, None, None, False), ("d", None, None, at, True), ("e", None, None, None, True), ("f", None, None, at, True)], "subject_id string, review_submitted_at string, review_locked_at string, started_at string, sealed boolean")
    jobs = spark.createDataFrame([("d", "COMPLETED"), ("d", "FAILED"), ("f", "COMPLETED"), ("f", "EXTRACTING")], "subject_id string, status string")
    got = dict(map(tuple, publish.training_phase(m, jobs).collect()))
    assert got == {"a": "SUBMITTED", "b": "REVIEW_IN_PROGRESS", "c": "UPLOAD", "d": "REVIEW_READY", "e": "PROCESSING", "f": "PROCESSING"}


def test_scrubbing_keeps_ordinary_brackets(spark):
    said = "Led it [c1] (D9) , [sic] in (2019) [S4-D1] “ so ” [F12] ."
    assert one(spark, publish.scrubbed(F.lit(said), F.array(F.lit("c1")))) == "Led it, [sic] in (2019) “so”."


def test_canonical_json(spark):
    said = 'a"' + chr(92) + chr(10) + chr(1) + "é"
    fields = {"schemaVersion": F.lit(1), "text": F.lit(said)}
    assert one(spark, jsonio.canonical(fields, ("text",))) == '{"schemaVersion":1,"text":' + json.dumps(said, ensure_ascii=False) + "}"
    assert one(spark, jsonio.canonical({"a": F.lit("x"), "b": F.lit(2)}, ("a",), pretty=True)) == json.dumps({"a": "x", "b": 2}, indent=2) + chr(10)


# --- serialization


def test_validators(spark):
    turn = lambda role, kind, text=None, name=None, args=None, result=None: (role, kind, text, name, args, result)
    rows = [
        ("ok", [turn("USER", "TEXT", "q"), turn("MODEL", "TOOL_CALL", None, "t", "{}"), turn("USER", "TOOL_RESPONSE", None, "t", None, "[1]"), turn("MODEL", "TEXT", "a")]),
        ("none", []),
        ("bad", [turn("MODEL", "TEXT", " "), turn("USER", "TOOL_CALL", None, "", "[1]"), turn("USER", "TOOL_RESPONSE", None, "t", None, "{")]),
        ("alone", [turn("USER", "TEXT", "q"), turn("USER", "TOOL_RESPONSE", None, "t", None, "1"), turn("MODEL", "TEXT", "a")]),
    ]
    got = {r["id"]: set(r["e"]) for r in spark.createDataFrame(rows, f"id string, turns array<{serialization.TURN}>").select("id", serialization.sft_errors().alias("e")).collect()}
    assert got["ok"] == set() and got["none"] == {"no_turns"} and got["alone"] == {"response_alone:2"}
    assert got["bad"] == {"first_not_user", "last_not_model", "empty_text:1", "call_not_model:2", "call_unnamed:2", "call_args:2", "response_json:3"}


def test_message_lines_and_their_errors(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "user", "q")], "conv_id long, turn long, role string, text string")
    rows = serialization.conversations_of(t).select(F.col("conv_id").alias("line_no"), serialization.messages_line().alias("value"))
    lines = {r["line_no"]: r["value"] for r in rows.collect()}
    assert lines[1] == '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'
    more = rows.unionByName(spark.createDataFrame([(3, "nonsense"), (4, "{}")], "line_no long, value string"))
    got = {r["line_no"]: r["errors"] for r in serialization.line_errors(more, 100).collect()}
    assert got == {1: [], 2: ["last_not_assistant", "no_alternation"], 3: ["not_object"], 4: ["no_messages"]}


# --- entities, lifecycle, sources, limits


def test_entities_resolve(spark):
    canon = spark.createDataFrame([("e1", "ORG", "acme", "Acme", ["acme inc"], None, [1.0, 0.0]), ("e2", "ORG", "old", "Old", [], "e1", [0.0, 1.0])], "entity_id string, entity_type string, canonical_key string, canonical_name string, alias_keys array<string>, merged_into string, embedding array<double>")
    m = spark.createDataFrame([("c1", "acme", "ORG", [1.0, 0.0]), ("c2", "acme inc", "ORG", [1.0, 0.0]), ("c3", "akme", "ORG", [0.9, 0.436]), ("c4", "zeta", "ORG", [0.0, 1.0]), ("c5", "zeta ltd", "ORG", [0.1, 0.995])], "claim_id string, surface_key string, entity_type string, embedding array<double>")
    got = {r["surface_key"]: (r["entity_id"], r["how"]) for r in entities.resolve(m, canon, P).collect()}
    assert got["acme"] == ("e1", "EXACT") and got["acme inc"] == ("e1", "ALIAS") and got["akme"] == ("e1", "MERGED")
    assert got["zeta"][1] == "MINTED" and got["zeta ltd"] == (got["zeta"][0], "MERGED")
    more = spark.createDataFrame([("c6", "old", "ORG", [0.0, 1.0]), ("c7", "ackme", "ORG", [0.8, 0.6]), ("c8", "far", "ORG", [-1.0, 0.0]), ("c9", "farther", "ORG", [-0.8, -0.6])], m.schema)
    got = {r["surface_key"]: (r["entity_id"], r["how"]) for r in entities.resolve(more, canon, P).collect()}
    assert got["old"] == ("e1", "EXACT") and got["ackme"] == ("e1", "REVIEW") and got["far"][1] == "MINTED" and got["farther"] == (got["far"][0], "REVIEW")


def test_upsert_and_replace(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    rows = spark.createDataFrame([(2, "B"), (3, None)], "k int, v string")
    assert sorted(map(tuple, tables.upsert(t, rows, "k", {"v": "new", "w": "w0"}).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "new", "w0")]
    assert sorted(map(tuple, tables.replace_for_key(t, spark.createDataFrame([(2, "n", "n")], t.schema), "k").collect())) == [(1, "a", "x"), (2, "n", "n")]


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("{}",), ('{"a":1}',)], "line string")
    tables.write_lines(df, "line", str(tmp_path / "x"), 1)
    assert [(r["line_no"], r["value"]) for r in tables.read_lines(spark, str(tmp_path / "x")).orderBy("line_no").collect()] == [(1, "{}"), (2, '{"a":1}')]


def test_rate_limit_locks_and_restarts(spark):
    times = [0, 1, 2, 3, 4, 5, 6, 904, 905.5]
    rows = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate(times)], "bucket_key string, attempt_id long, ts double")
    got = [r["allowed"] for r in limits.rate_limited(rows, P).orderBy("attempt_id").collect()]
    assert got == [True] * 5 + [False] * 3 + [True]


def test_rate_limit_stream_agrees_with_batch(spark, tmp_path):
    schema = "bucket_key string, attempt_id long, ts double"
    for part in range(2):
        spark.createDataFrame([("k", i, float(i)) for i in range(part * 4, part * 4 + 4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # A processing-time timeout runs empty micro-batches for ever, for which processAllAvailable would wait.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = limits.rate_limited_stream(stream, P).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["attempt_id"]: r["allowed"] for r in spark.table("limited").collect()}
    assert sum(got.values()) == 5 and len(got) == 8


def test_chat_gates(spark):
    rows = [("s", i, float(t), True) for i, t in enumerate([0, 1, 4, 8])] + [("s", 9, 9.0, False)]
    got = {r["message_id"]: r["outcome"] for r in limits.chat_gated(spark.createDataFrame(rows, "session_id string, message_id long, ts double, live boolean"), replace(P, messages_per_session=4)).collect()}
    assert got == {0: "OK", 1: "TOO_FAST", 2: "OK", 3: "FULL", 9: "NOT_AVAILABLE"}


def test_status_transitions(spark):
    df = spark.createDataFrame([("DRAFT", "SUBMIT"), ("DRAFT", "APPROVE")], "s string, a string")
    assert [r[0] for r in df.select(lifecycle.next_status("s", "a")).collect()] == ["SUBMITTED", None]


# --- pairs at size


def test_the_mean_of_votes_does_not_depend_on_where_they_lay(spark):
    rows = [("a", "b", False, i, "CORROBORATES", c, f"r{i}", None, None) for i, c in enumerate((0.5, 0.51, 0.62, 0.73, 0.87))]
    kind = "a string, b string, with_context boolean, sample_index int, relation string, confidence double, rationale string, temporal_note string, explanation_relevant boolean"
    for way in (rows, rows[::-1], rows[2:] + rows[:2]):
        assert judging.aggregate_votes(spark.createDataFrame(way, kind).coalesce(1), P).first()["confidence"] == (0.5 + 0.51 + 0.62 + 0.73 + 0.87) / 5


def test_pairs_travel_without_texts_and_only_known_pairs_with_vectors(spark):
    c, out = graded(spark, [("a", "SKILL", "Same text", None, "x", False, None), ("b", "SKILL", "same  text", None, "x", False, None), ("d", "SKILL", "same text", None, None, False, None)], [("a", "b", ["HUMAN"], 0.0), ("a", "d", ["HUMAN"], 0.0)])
    assert {r["b"]: r["outcome"] for r in out.collect()} == {"b": "REPEATS_2", "d": "QUEUED"}
    assert "text_a" not in out._jdf.queryExecution().optimizedPlan().toString()
    v = spark.createDataFrame([("s", "a", [1.0, 0.0]), ("s", "b", [0.6, 0.8]), ("s", "d", None)], "subject_id string, claim_id string, embedding array<double>")
    assert [(r["b"], r["sim"]) for r in matching.pair_similarities(out, v).collect()] == [("b", 0.6)]


def test_structural_pairs_are_made_where_they_are_used(spark):
    rows = [(f"s{k % 2}", f"c{k:03}", "EPISODE" if k % 3 else "VALUE", str(2000 + k * 7 % 20) if k % 5 else None, f"t{k % 4}", f"x{k % 2}", None) for k in range(60)]
    c = spark.createDataFrame(rows, "subject_id string, claim_id string, claim_type string, claimed_date string, text string, asset_id string, exemplar_claim_id string")
    v = spark.createDataFrame([(r[0], r[1], [float(i % 3), 1.0, float(i % 5)]) for i, r in enumerate(rows) if i % 4], "subject_id string, claim_id string, embedding array<float>")
    human = spark.createDataFrame([(r[0], r[1], s[1]) for i, r in enumerate(rows) for s in (rows[i - 6], rows[i - 10]) if i > 10], "subject_id string, a string, b string")
    p = replace(P, sim_floor=9.0, sim_auto_repeat=11.0)
    whole = matching.blocking_union(c, {"HUMAN": human, "STRUCTURAL": matching.structural_pairs(c, p)})
    found = matching.marked_structural(matching.blocking_union(c, {"HUMAN": human}), c, p)
    met = found.where("structural")
    rest = matching.structural_pairs(c, p, met, part_rows=4)
    want = {(r["a"], r["b"]): tuple(r["sources"]) for r in whole.collect()}
    got = {(r["a"], r["b"]): tuple(r["sources"]) for r in found.collect()} | {(r["a"], r["b"]): ("STRUCTURAL",) for r in rest.collect()}
    assert got == want and len(want) == found.count() + rest.count() and {("HUMAN",), ("STRUCTURAL",), ("HUMAN", "STRUCTURAL")} == set(want.values())
    columns = ["a", "b", "sim", "outcome", "eff_a", "eff_b"]
    graded = matching.rungs(whole, c, matching.pair_similarities(whole, v), p).where("sources = array('STRUCTURAL')").select(columns)
    alone = matching.structural_rungs(c, v, p, met).select(columns)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, graded.collect())) and len({r["outcome"] for r in alone.collect()}) > 2
    # nothing is shuffled once the pairs are made
    plan = matching.structural_rungs(c, v, p, met)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_equal_sets_are_joined_as_one(spark, monkeypatch):
    words = (["a", "b", "c"], ["c", "b", "a"], ["a", "b", "d"], ["x"], [])
    df = spark.createDataFrame([(g, k, words[k % 5]) for g in ("s", "t") for k in range(40)], "subject_id string, place long, s array<string>")
    want = {(g, i, j) for g in ("s", "t") for i in range(40) for j in range(i + 1, 40) if (x := set(words[i % 5])) and (y := set(words[j % 5])) and len(x & y) >= 0.5 * len(x | y)}
    kept = []
    monkeypatch.setattr(training, "save", lambda rows, name: kept.append(iterate.save(rows, name)) or kept[-1])
    got = [(r["subject_id"], r["i"], r["j"]) for r in training.similar_sets(df, 0.5).collect()]
    assert set(got) == want and len(got) == len(want)
    assert kept[0].select("subject_id", "rep").distinct().count() == 6 and kept[0].count() == 64


def test_pairs_of_a_common_entity_are_made_once_and_not_shuffled(spark):
    rows = [("s", f"c{i:02d}", e) for i in range(12) for e in ("x", "y", "z", "w") if (i * 7 + ord(e)) % 3]
    pairs = matching.co_mention_pairs(spark.createDataFrame(rows, "subject_id string, claim_id string, entity_id string"), P, part_rows=3)
    above = pairs._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    share = {e: sum(x == e for *_, x in rows) / 12 for e in "xyzw"}
    own = {c: {e for _, d, e in rows if d == c and share[e] <= 1 - P.idf_floor} for _, c, _ in rows}
    want = {("s", a, b, min(share[e] for e in own[a] & own[b])) for a in own for b in own if a < b and own[a] & own[b]}
    got = [tuple(r) for r in pairs.collect()]
    assert want == set(got) and len(got) == len(want)


def test_declared_claims_are_sorted_behind_the_exchange(spark):
    none = F.array().cast("array<string>")
    shared = F.array().cast("array<struct<kind:string,value:string,shareable:boolean>>").alias("contact")
    p = spark.range(3).select(F.col("id").alias("subject_id"), F.array(F.lit("lead"), F.lit("lead ")).alias("target_roles"), F.lit("senior").alias("target_seniority"), *[none.alias(n) for n in ("aspirations", "stated_preferences", "do_not_discuss")], F.lit(True).alias("open_to_relocation"), shared)
    out = lifecycle.declared_claims(p)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan.split("Exchange")[1]
    assert out.count() == out.select("claim_id").distinct().count() == 3 * (3 if out.where("declared_type = 'TARGET_ROLE'").count() == 3 else 4)


def test_edges_of_lone_claims_are_not_grouped(spark):
    names = [f"{n}_{end}" for n in assembly.FACT_ENDS for end in "ab"]
    kinds = ", ".join(f"{n} {'long' if n.startswith('member') else 'string'}" for n in names)
    row = lambda a, b, fa, fb, na, nb, confidence: ("s", a, b, "CONTRADICTS", confidence, "r", "same span", True, "NEUTRAL", 0.4, True, None, fa, fb, *["2020"] * 4, "YEAR", "YEAR", "EVENT", "EVENT", na, nb)
    rows = [row("a", "b", "fact:a", "fact:b", 1, 1, 0.9), row("a", "c", "fact:a", "fact:c", 1, 2, 0.7), row("a", "d", "fact:a", "fact:c", 1, 2, 0.8)]
    judged = spark.createDataFrame(rows, f"subject_id string, a string, b string, relation string, confidence double, rationale string, temporal_note string, ctx_judged boolean, ctx_relation string, ctx_confidence double, ctx_explanation_relevant boolean, shared_entities array<string>, {kinds}")
    single, rest = assembly.lone(judged)
    told = {tuple(map(str, r)) for r in assembly.lifted_edges(judged)[0].collect()}
    assert told == {tuple(map(str, r)) for r in assembly.lifted_edges(rest, single)[0].collect()} and len(told) == 2
    assert {(r["to_fact"], r["confidence"], *r["contributing_pairs"]) for r in assembly.lifted_edges(judged)[0].collect()} == {("fact:b", 0.9, "a↔b"), ("fact:c", 0.8, "a↔c", "a↔d")}
