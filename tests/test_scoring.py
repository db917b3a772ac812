"""Hand-worked scores, and the invariants of the fixed point on random graphs."""

import random

import pytest

from evidentia.config import Params
from evidentia.operators import scoring

CLAIM = "subject_id string, claim_id string, fact_id string, tier_seed string, source_class string, attestor_key string, asset_id string, claim_type string, claimed_date string, favorability double, basis string, declared boolean"
EDGE = "subject_id string, from_fact string, to_fact string, relation string, confidence double, with_context boolean, ctx_relation string, ctx_confidence double, explained boolean"
P = Params(epsilon=0.001)
CLAIMS = [
    ("s", "c1", "F1", "HIGH", "DOCUMENTARY", "issuer:univ-x", "a-degree", "EPISODE", "2016"), ("s", "c2", "F1", "LOW", "SELF", "subject:asha", "a-self", "EPISODE", None), ("s", "c3", "F2", "MEDIUM", "ENDORSEMENT", "endorser:r-mehta", "a-mgr", "SKILL", None),
    ("s", "c4", "F2", "LOW", "SELF", "subject:asha", "a-self", "SKILL", None), ("s", "c5", "F3", "LOW", "SELF", "subject:asha", "a-self", "EPISODE", "2019"), ("s", "c6", "F4", "MEDIUM", "ENDORSEMENT", "endorser:s-rao", "a-peer", "EPISODE", "2019"),
]
FACTS = [("s", "F1", "c1", True), ("s", "F2", "c3", False), ("s", "F3", "c5", False), ("s", "F4", "c6", False)]
TRUST = [("subject:asha", 0.5, 0.5), ("issuer:univ-x", 0.8, 0.8), ("endorser:r-mehta", 0.6, 0.6), ("endorser:s-rao", 0.6, 0.6)]
EDGES = [("s", "F4", "F3", "CONTRADICTS", 0.72, True, "NEUTRAL", 0.36, True)]


def run(spark, claims=CLAIMS, facts=FACTS, trust=TRUST, edges=EDGES, p=P):
    c = spark.createDataFrame([(*r, 0.8, "STATED", False) for r in claims], CLAIM)
    f = spark.createDataFrame(facts, "subject_id string, fact_id string, exemplar_claim_id string, anchored boolean")
    a = spark.createDataFrame(trust, "attestor_key string, trust_prior double, trust double")
    out = scoring.score(c, f, a, spark.createDataFrame(edges, EDGE), p)
    return {k: v.collect() for k, v in out.items()}


def test_worked_example(spark):
    got = run(spark)
    f = {r["fact_id"]: r for r in got["facts"]}
    near = lambda x: pytest.approx(x, abs=0.005)
    assert f["F1"]["belief"] == near(0.9025) and f["F1"]["belief_bare"] == near(0.9025)
    assert f["F2"]["belief"] == near(0.74) and f["F4"]["belief"] == near(0.60)
    assert f["F3"]["belief"] == near(0.35) and f["F3"]["belief_bare"] == near(0.31)
    assert f["F3"]["conflict"] == near(0.17) and f["F3"]["support"] == 0
    assert f["F2"]["independence"] == near(1.0) and f["F2"]["evidence_mass"] == near(2.0)
    assert {r["claim_id"]: r["tier"] for r in got["claims"]} == {"c1": "HIGH", "c2": "HIGH", "c3": "MEDIUM", "c4": "MEDIUM", "c5": "LOW", "c6": "MEDIUM"}
    trust = {r["attestor_key"]: r for r in got["trust"]}
    assert trust["subject:asha"]["trust"] == near(0.56) and trust["subject:asha"]["fact_count"] == 3
    assert got["status"][0]["converged"]


def test_shared_asset_damps_the_weaker_group(spark):
    claims = [("s", "c1", "F1", "MEDIUM", "ENDORSEMENT", "e1", "call", "EPISODE", None), ("s", "c2", "F1", "MEDIUM", "ENDORSEMENT", "e2", "call", "EPISODE", None)]
    got = run(spark, claims, [("s", "F1", "c1", False)], [("e1", 0.6, 0.6), ("e2", 0.6, 0.6)], [])
    assert got["facts"][0]["belief"] == pytest.approx(0.696, abs=0.005)


def test_skill_evidence_decays(spark):
    claims = [("s", "c1", "F1", "MEDIUM", "ENDORSEMENT", "e1", "a", "SKILL", "2016")]
    got = run(spark, claims, [("s", "F1", "c1", False)], [("e1", 0.6, 0.6)], [])
    assert got["facts"][0]["recency"] == pytest.approx(0.25)


def test_self_praise_has_a_ceiling_and_declarations_a_floor(spark):
    claims = [("s", "c1", "F1", "HIGH", "SELF", "subject:s", "a", "IDENTITY", None)]
    assert run(spark, claims, [("s", "F1", "c1", False)], [("subject:s", 0.5, 0.5)], [])["facts"][0]["belief"] == 0.65


def _random_graph(seed):
    r = random.Random(seed)
    facts = [("s", f"F{i}", f"c{i}", r.random() < 0.2) for i in range(12)]
    claims = [("s", f"c{i}", f"F{i % 12}", r.choice(["HIGH", "MEDIUM", "LOW"]), r.choice(["SELF", "ENDORSEMENT"]), f"e{r.randrange(4)}", f"a{r.randrange(5)}", r.choice(["SKILL", "EPISODE"]), r.choice([None, "2015", "2024-05"])) for i in range(30)]
    edges = [("s", f"F{i}", f"F{j}", r.choice(["CORROBORATES", "CONTRADICTS"]), r.random(), r.random() < 0.5, r.choice(["CONTRADICTS", "NEUTRAL", None]), r.random(), r.random() < 0.5) for i in range(12) for j in range(i + 1, 12) if r.random() < 0.2]
    return claims, facts, [(f"e{i}", 0.6, 0.3 + 0.2 * i) for i in range(4)], edges


def _plain(claims, facts, trust, edges, p, explained):
    """The same fixed point, one fact after the other."""
    import math

    prior = {c[1]: 1 / (1 + math.exp(-math.log((b := {"HIGH": 0.85, "MEDIUM": 0.6}.get(c[3], 0.35)) / (1 - b)))) for c in claims}
    scale = {k: min(max(t / q, 0.5), 1.5) for k, q, t in trust}
    b0, groups, mass = {}, {}, {}
    for _, f, _, _ in facts:
        own = {}
        for c in claims:
            if c[2] == f:
                k = "self" if c[4] == "SELF" else c[5]
                s, a = own.get(k, (0, set()))
                own[k] = max(s, prior[c[1]] * scale.get(c[5], 1.0)), a | {c[6]}
        ranked, seen, rest, total = sorted(own.items(), key=lambda x: (-x[1][0], x[0])), set(), 1.0, 0.0
        for _, (s, a) in ranked:
            dep = p.dependence_damping if a <= seen else 1.0
            seen |= a
            rest *= 1 - min(s, 1) * dep
            total += dep
        b0[f], groups[f], mass[f] = 1 - rest, ranked[0][0], total
    up, down = {f: [] for f in b0}, {f: [] for f in b0}
    for _, a, b, rel, conf, wc, cr, cc, ex in edges:
        mit = 1.0
        if rel == "CONTRADICTS" and explained and wc:
            if cr != "CONTRADICTS":
                continue
            conf, mit = min(conf, cc), 1 - p.explanation_mitigation * ex
        for x, y in ((a, b), (b, a)):
            (up if rel == "CORROBORATES" else down)[x].append((y, conf, mit))
    rel_ = lambda x: min(max(2 * x - 1, 0), 1)
    logit = lambda x: math.log((x := min(max(x, 1e-9), 1 - 1e-9)) / (1 - x))
    kind = {c[1]: c[7] for c in claims}
    newest = {f: max([c[8] for c in claims if c[2] == f and c[8]], default=None) for f in b0}
    s, b = {f: logit(x) for f, x in b0.items()}, dict(b0)
    for _ in range(p.max_iterations):
        ns, nb = {}, {}
        for _, f, ex, anchored in facts:
            half = p.volatile_half_life_years.get(kind[ex])
            age = lambda d, half=half: 0.5 ** (max(int(p.as_of[:4]) - int(d[:4]), 0) / half) if half and d else 1.0
            terms = sorted(((p.corroboration_weight * c * rel_(b[y]) * age(newest[y]), y) for y, c, _ in up[f]), key=lambda t: (-t[0], t[1]))
            used, plus = {}, 0.0
            for t, y in terms:
                k = used.get(groups[y], 0)
                used[groups[y]] = k + 1
                plus += t * p.dependence_damping**k
            minus = sum(p.contradiction_weight * c * rel_(b[y]) * m for y, c, m in down[f])
            new = logit(b0[f]) + plus - minus
            new = s[f] + p.anchor_plasticity * (new - s[f]) if anchored else new
            ns[f] = (1 - p.damping) * s[f] + p.damping * new
            nb[f] = 1 / (1 + math.exp(-ns[f]))
        delta = max(abs(nb[f] - b[f]) for f in b)
        s, b = ns, nb
        if delta < p.epsilon:
            break
    out = {}
    for f in b:
        lone = all(c[4] == "SELF" for c in claims if c[2] == f) and not up[f]
        out[f] = min(max(min(b[f], p.self_praise_ceiling) if lone else b[f], 0.02), 0.98)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_agree_with_a_plain_loop_in_any_order(spark, seed):
    claims, facts, trust, edges = _random_graph(seed)
    want = _plain(claims, facts, trust, edges, P, True), _plain(claims, facts, trust, edges, P, False)
    random.Random(9).shuffle(claims)
    random.Random(8).shuffle(edges)
    got = run(spark, claims, facts, trust, edges)["facts"]
    for r in got:
        assert r["belief"] == pytest.approx(want[0][r["fact_id"]], abs=1e-9) and r["belief_bare"] == pytest.approx(want[1][r["fact_id"]], abs=1e-9)


def test_a_subject_in_one_task_takes_the_turns_of_jobs(spark):
    """Several subjects, settled whole, in turns, and some of each: the same beliefs, rounds and masses; unknown ends and facts without edges too."""
    graphs = [_random_graph(seed) for seed in (3, 4, 5)]
    name = lambda rows, k: [(f"s{k}", *r[1:]) for r in rows]
    claims, facts, edges = ([r for k, g in enumerate(graphs) for r in name(g[i], k)] for i in (0, 1, 3))
    edges = [*edges, ("s0", "F1", "unknown", "CORROBORATES", 0.9, False, None, None, False), ("s1", "F1", "F2", "CONTRADICTS", None, True, "CONTRADICTS", 0.7, True), ("s1", "F1", "F3", "CORROBORATES", None, False, None, None, False)]
    facts = [*facts, ("s9", "F0", "c0", False)]
    c = spark.createDataFrame([(*r, 0.8, "STATED", False) for r in claims], CLAIM)
    f = spark.createDataFrame(facts, "subject_id string, fact_id string, exemplar_claim_id string, anchored boolean")
    primed = scoring.with_priors(c, spark.createDataFrame(graphs[0][2], "attestor_key string, trust_prior double, trust double"), P)
    e = spark.createDataFrame(edges, EDGE)
    few = min(sum(r[0] == f"s{k}" for r in edges) for k in range(3))
    told = [{(r["subject_id"], r["fact_id"], r["explained"]): r.asDict() for r in scoring.fixed_point(primed, f, e, P, whole=whole).collect()} for whole in (10**6, 0, few)]
    assert len(told[0]) == 2 * len(facts) and all(t.keys() == told[0].keys() for t in told)
    for t in told[1:]:
        for k, row in t.items():
            assert {c for c, x in row.items() if x != pytest.approx(told[0][k][c], abs=1e-12)} == set()


def test_a_subject_settles_in_few_jobs(spark):
    """Turns of subjects that a task can hold are no jobs."""
    claims, facts, trust, edges = _random_graph(1)
    c = spark.createDataFrame([(*r, 0.8, "STATED", False) for r in claims], CLAIM)
    f = spark.createDataFrame(facts, "subject_id string, fact_id string, exemplar_claim_id string, anchored boolean")
    primed = scoring.with_priors(c, spark.createDataFrame(trust, "attestor_key string, trust_prior double, trust double"), P)
    spark.sparkContext.setJobGroup("settles", "")
    out = scoring.fixed_point(primed, f, spark.createDataFrame(edges, EDGE), P)
    assert max(r["iterations"] for r in out.collect()) > 4
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("settles")) < 40


def test_subject_index_worked_example(spark):
    facts = [("s", f"d{i}", 0.90, 0.85, 4.0, False, True) for i in range(8)] + [("s", f"e{i}", 0.90, 0.85, 4.0, False, False) for i in range(16)] + [("s", f"o{i}", 0.62, None, None, True, False) for i in range(8)]
    f = spark.createDataFrame(facts, "subject_id string, fact_id string, belief double, independence double, evidence_mass double, self_only boolean, documentary boolean")
    a = spark.createDataFrame([("s", f"i{k}", "ISSUER") for k in range(2)] + [("s", f"n{k}", "ENDORSER") for k in range(3)] + [("s", "me", "SUBJECT")], "subject_id string, attestor_key string, kind string")
    e = spark.createDataFrame([("s", f"p{k}", "CORROBORATES", 0.8, False) for k in range(8)] + [("s", "x", "CONTRADICTS", 0.75, True), ("s", "y", "CONTRADICTS", 0.65, True)], "subject_id string, pair_key string, relation string, confidence double, explained boolean")
    r = scoring.subject_index(f, a, e, Params()).collect()[0]
    near = lambda x: pytest.approx(x, abs=0.0015)
    assert (r["weighted_belief"], r["evidence_depth"], r["independent_coverage"], r["source_diversity"], r["contradiction_drag"]) == (near(0.854), near(0.583), near(0.75), near(1.0), near(0.219))
    assert (r["depth_factor"], r["coverage_factor"], r["diversity_factor"], r["contradiction_factor"]) == (near(0.875), near(0.925), near(1.0), near(0.945))
    assert r["score"] == near(0.653) and (r["display"], r["band"], r["corroborations"], r["contradictions"]) == (65, "GOOD", 8, 2)


def test_ledger_mean_ignores_rows_without_mass(spark):
    rows = [("s", 0.88, 3.1), ("s", 0.97, 2.2), ("s", 0.93, 1.8), ("s", 0.41, 0.6), ("s", 0.72, 1.1), ("s", 0.1, 0.0), ("s", 0.1, None), ("t", 0.5, None)]
    got = {r["subject_id"]: r for r in scoring.ledger_mean(spark.createDataFrame(rows, "subject_id string, score double, evidence_mass double")).collect()}
    assert got["s"]["mean"] == pytest.approx(7.574 / 8.8) and got["s"]["display"] == 86 and got["t"]["mean"] is None


def test_an_edge_is_one_narrow_row_a_direction(spark):
    c = spark.createDataFrame([(*r, 0.8, "STATED", False) for r in CLAIMS], CLAIM)
    f = spark.createDataFrame(FACTS, "subject_id string, fact_id string, exemplar_claim_id string, anchored boolean")
    a = spark.createDataFrame(TRUST, "attestor_key string, trust_prior double, trust double")
    edges = [*EDGES, ("s", "F1", "F2", "CORROBORATES", 0.8, False, None, None, False), ("s", "F2", "F3", "NEUTRAL", 0.9, False, None, None, False), ("s", "F1", "F9", "CORROBORATES", 0.9, False, None, None, False)]
    active = scoring.prepared(scoring.with_priors(c, a, P), f, spark.createDataFrame(edges, EDGE), P)[1]
    assert active.count() == 4
    assert [n for n, kind in active.dtypes if kind == "string"] == ["subject_id"]
