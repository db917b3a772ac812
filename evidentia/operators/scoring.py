"""Trust propagation to a fixed point, and the scores that follow from it.

Subjects don't meet, so most are settled in one task each. The edges of larger ones are dealt by ranges of facts once; both passes of a turn run
in the same job over them, and ranks are told where the edges of a fact lie. Both passes are told of every fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import Params
from evidentia.functions.dates import age_factor
from evidentia.functions.maths import band, claim_prior, clip, display, saturation, tier
from evidentia.operators.iterate import save, saved
from evidentia.operators.settling import settled_in_turns, settled_whole

FACT = ("subject_id", "fact_id")


def with_priors(claims: DataFrame, attestors: DataFrame, p: Params) -> DataFrame:
    """Claims with prior, strength (prior scaled by the attestor's trust) and dependence group."""
    trust = attestors.select("attestor_key", "trust_prior", "trust")
    scale = F.when(F.col("trust_prior") > 0, clip(F.col("trust") / F.col("trust_prior"), 0.5, 1.5)).otherwise(1.0)
    group = F.when(F.col("source_class") == "SELF", "self").otherwise(F.coalesce("attestor_key", F.lit("unattested")))
    return claims.join(trust, "attestor_key", "left").withColumn("prior", claim_prior(p)).withColumns({"strength": F.col("prior") * scale, "group_key": group})


def dependence_groups(primed: DataFrame, p: Params) -> DataFrame:
    """(subject, fact, group) with strength, rank and dependence: damped if every asset of the group came with a stronger group."""
    order = Window.partitionBy(*FACT).orderBy(F.desc("strength"), "group_key")
    groups = primed.groupBy(*FACT, "group_key").agg(F.max("strength").alias("strength")).withColumn("rank", F.row_number().over(order))
    assets = primed.where("asset_id IS NOT NULL").select(*FACT, "group_key", "asset_id").distinct().join(groups.select(*FACT, "group_key", "rank"), [*FACT, "group_key"])
    first = F.min("rank").over(Window.partitionBy(*FACT, "asset_id"))
    seen = assets.withColumn("first", first).groupBy(*FACT, "group_key").agg(F.bool_and(F.col("first") < F.col("rank")).alias("seen"))
    return groups.join(seen, [*FACT, "group_key"], "left").withColumn("dep", F.when(F.col("seen"), p.dependence_damping).otherwise(1.0)).drop("seen")


def base_beliefs(groups: DataFrame) -> DataFrame:
    """Noisy-or of the groups, the sum of dependences, and the strongest group."""
    return groups.groupBy(*FACT).agg(
        (1 - F.product(1 - clip(F.col("strength"), 0.0, 1.0) * F.col("dep"))).alias("b0"), F.sum("dep").alias("dep_sum"), F.count("*").alias("n_groups"), F.min_by("group_key", "rank").alias("strongest")
    )


def _half_life(kind: str, p: Params) -> Column:
    out = F.lit(None).cast("double")
    for name, years in p.volatile_half_life_years.items():
        out = F.when(F.col(kind) == name, years).otherwise(out)
    return out


def _members(primed: DataFrame, facts: DataFrame, p: Params) -> DataFrame:
    """Facts with what their members say: counts, dates, policy flags, decay."""
    kinds = primed.select("subject_id", F.col("claim_id").alias("exemplar_claim_id"), F.col("claim_type").alias("exemplar_type"))
    f = facts.select(*FACT, "exemplar_claim_id", "anchored").join(kinds, ["subject_id", "exemplar_claim_id"], "left").withColumn("half_life", _half_life("exemplar_type", p))
    rows = f.select(*FACT, "half_life").join(primed, list(FACT), "left")
    told = rows.groupBy(*FACT).agg(
        F.count("claim_id").alias("n_members"), F.coalesce(F.bool_and(F.when(F.col("claim_id").isNotNull(), F.col("source_class").eqNullSafe("SELF"))), F.lit(False)).alias("all_self"),
        F.bool_or(F.coalesce(F.col("favorability") < p.favorability_threshold, F.lit(False))).alias("against"), F.max("claimed_date").alias("newest"),
        F.avg(F.when(F.col("half_life").isNotNull(), age_factor("claimed_date", F.col("half_life"), p.as_of)).otherwise(1.0)).alias("recency"),
    )
    return f.join(told, list(FACT))


def _said(edges: DataFrame) -> DataFrame:
    """What scores take of edges: subject_id, from_fact, to_fact, up, conf_bare, conf_full, mitigated. An edge that is not active in a pass has no confidence there."""
    e = edges.where(F.col("relation").isin("CORROBORATES", "CONTRADICTS"))
    up, off = F.col("relation") == "CORROBORATES", F.lit(False)
    ctx = ~up & F.coalesce("with_context", off)
    full = F.when(ctx, F.when(F.col("ctx_relation") == "CONTRADICTS", F.least("confidence", F.coalesce("ctx_confidence", "confidence")))).otherwise(F.col("confidence"))
    return e.select("subject_id", "from_fact", "to_fact", up.alias("up"), F.col("confidence").alias("conf_bare"), full.alias("conf_full"), (ctx & F.coalesce("explained", off)).alias("mitigated"))


def _active_edges(edges: DataFrame, ends: DataFrame, p: Params) -> DataFrame:
    """Both directions of every edge between known facts: (subject_id, node, other, voice of the other, up) with confidence and factor, see ``settling``, of each pass, bare or full.

    Facts are known by numbers, an edge has both passes in one row, and each end is looked up once: the edges grow with the square of a subject's claims. An edge that is
    not active in a pass has no confidence there. ends: FACT, node, voice, newest, half_life.
    """
    e = _said(edges).withColumn("mitigation", F.when(F.col("mitigated"), 1 - p.explanation_mitigation).otherwise(1.0)).drop("mitigated")
    told = ("node", "voice", "newest", "half_life")
    for end in ("from", "to"):
        e = e.join(ends.select("subject_id", F.col("fact_id").alias(f"{end}_fact"), *[F.col(c).alias(f"{end}_{c}") for c in told]), ["subject_id", f"{end}_fact"]).drop(f"{end}_fact")

    def way(to: str, by: str):
        recency = F.when(F.col(f"{to}_half_life").isNotNull(), age_factor(f"{by}_newest", F.col(f"{to}_half_life"), p.as_of)).otherwise(1.0)
        factors = [F.when(F.col("up"), recency).otherwise(x).alias(n) for x, n in ((F.lit(1.0), "factor_bare"), (F.col("mitigation"), "factor_full"))]
        return F.struct(F.col(f"{to}_node").alias("node"), F.col(f"{by}_node").alias("other"), F.col(f"{by}_voice").alias("voice"), *factors)

    e = e.withColumn("way", F.explode(F.array(way("from", "to"), way("to", "from"))))
    return e.select("subject_id", "way.node", "way.other", "way.voice", "up", "conf_bare", "conf_full", "way.factor_bare", "way.factor_full")


def prepared(primed: DataFrame, facts: DataFrame, edges: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Facts with what their members say and their base beliefs, and the active edges with what they need of the other end; both are written."""
    members = _numbered(primed, facts, p)
    return members, _numbered_edges(members, edges, p)


def _numbered(primed: DataFrame, facts: DataFrame, p: Params) -> DataFrame:
    """``node`` numbers the facts in order of their ids, since ties of a rank go by id."""
    base = base_beliefs(dependence_groups(primed, p))
    members = _members(primed, facts, p).join(base, list(FACT), "left").withColumns({"b0": F.coalesce("b0", F.lit(0.5)), "dep_sum": F.coalesce("dep_sum", F.lit(0.0)), "n_groups": F.coalesce("n_groups", F.lit(0)), "strongest": F.coalesce("strongest", "fact_id")})
    return save(members.orderBy(*FACT).withColumn("node", F.monotonically_increasing_id()), "score-facts")


def _numbered_edges(members: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    voices = save(members.select("strongest").distinct().withColumn("voice", F.monotonically_increasing_id()), "score-voices")
    ends = save(members.join(voices, "strongest").select(*FACT, "node", "voice", "newest", "half_life"), "score-ends")
    return save(_active_edges(edges, ends, p), "score-edges")


#: Edges up to which a subject is settled whole in one task: a worker that held as many took 569 MB in all.
WHOLE = 1 << 22


def fixed_point(primed: DataFrame, facts: DataFrame, edges: DataFrame, p: Params, whole: int = WHOLE) -> DataFrame:
    """(subject, fact, explained pass) with belief, support, conflict, independence, recency, evidence mass, iterations and converged.

    Subjects don't meet: one of up to ``whole`` edges is settled in one task, larger ones in turns that are jobs, see ``settling``. Both take the same turns.
    """
    members = _numbered(primed, facts, p)
    sizes = edges.where("subject_id IS NOT NULL").groupBy("subject_id").agg(F.count("*").alias("n"))
    large, found = saved(sizes.where(F.col("n") > whole).select("subject_id"), "score-large", n=F.count(F.lit(1)))
    if not found.get("n"):
        state = settled_whole(members, _said(edges), p)
    else:
        of = lambda rows, how: rows.join(large, "subject_id", how)
        state = settled_whole(of(members, "left_anti"), _said(of(edges, "left_anti")), p)
        big = of(members, "left_semi")
        state = state.unionByName(settled_in_turns(big, _numbered_edges(big, of(edges, "left_semi"), p), p))
    out = state.join(members.drop("anchored", "b0", "subject_id"), "node")
    praise = F.col("all_self") & ~F.col("against") & ~F.col("supported")
    belief = clip(F.when(praise, F.least("b", F.lit(p.self_praise_ceiling))).otherwise(F.col("b")), 0.02, 0.98)
    independence = F.when(F.col("n_members") == 0, 0.0).otherwise(F.col("n_groups") / F.col("n_members"))
    return out.select(*FACT, "explained", belief.alias("belief"), "support", "conflict", independence.alias("independence"), F.coalesce("recency", F.lit(1.0)).alias("recency"), (F.col("dep_sum") + F.col("mass")).alias("evidence_mass"), "iterations", F.col("done").alias("converged"))


def score(claims: DataFrame, facts: DataFrame, attestors: DataFrame, edges: DataFrame, p: Params) -> dict[str, DataFrame]:
    """facts, claims and trust: scores after both passes.

    claims: subject_id, claim_id, fact_id, claim_type, tier_seed, source_class, basis, favorability, claimed_date, attestor_key, asset_id, declared.
    facts: subject_id, fact_id, exemplar_claim_id, anchored. attestors: attestor_key, trust_prior, trust; trust is read once, and
    updated by subject. edges: subject_id, from_fact, to_fact, relation, confidence, with_context, ctx_relation, ctx_confidence, explained.
    """
    primed = save(with_priors(claims, attestors, p), "score-claims")
    both = save(fixed_point(primed, facts, edges, p), "score-passes")
    bare = both.where("NOT explained").drop("explained").withColumnRenamed("belief", "belief_bare").drop("iterations", "converged")
    told = both.where("explained").select(*FACT, "belief")
    fact_scores = told.join(bare, list(FACT))
    floor = F.when(F.coalesce("declared", F.lit(False)), p.declared_belief_floor).otherwise(0.0)
    rows = primed.join(fact_scores.select(*FACT, "belief", "belief_bare"), list(FACT))
    rows = rows.withColumns({"score": F.greatest("belief", "belief_bare", floor), "score_bare": F.greatest("belief_bare", floor), "lifted": F.col("belief") < F.col("belief_bare")})
    claim_scores = rows.select("subject_id", "claim_id", "fact_id", "prior", "score", "score_bare", "lifted", F.when(F.coalesce("declared", F.lit(False)), "LOW").otherwise(tier(F.col("score"), p)).alias("tier"))
    voiced = primed.where("attestor_key IS NOT NULL").select("subject_id", "attestor_key", "fact_id", "trust_prior").where("trust_prior IS NOT NULL").distinct().join(told, list(FACT))
    m = p.trust_shrinkage
    trust = voiced.groupBy("subject_id", "attestor_key").agg(F.count("*").alias("fact_count"), F.avg("belief").alias("mean"), F.max("trust_prior").alias("prior"))
    trust = trust.select("subject_id", "attestor_key", ((F.col("fact_count") * F.col("mean") + m * F.col("prior")) / (F.col("fact_count") + m)).alias("trust"), "fact_count")
    status = both.groupBy("subject_id").agg(F.max("iterations").alias("iterations"), F.bool_and("converged").alias("converged"))
    return {"facts": fact_scores, "claims": claim_scores, "trust": trust, "status": status}


def subject_index(facts: DataFrame, attestors: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    """One index a subject with its components.

    facts: subject_id, fact_id, belief, independence, evidence_mass, self_only, documentary. attestors: subject_id, attestor_key, kind. edges:
    subject_id, pair_key, relation, confidence, explained: one row for each unordered pair and relation.
    """
    mass, ind = F.coalesce("evidence_mass", F.lit(1.0)), F.coalesce("independence", F.lit(1.0))
    w = F.greatest(ind, F.lit(0.05)) * saturation(mass, p.mass_midpoint)
    f = facts.groupBy("subject_id").agg(
        F.count("*").alias("n_facts"), F.coalesce(F.try_divide(F.sum(w * F.col("belief")), F.sum(w)), F.avg("belief")).alias("weighted_belief"), F.avg(saturation(mass, p.mass_midpoint)).alias("evidence_depth"),
        (1 - F.avg(F.col("self_only").cast("double"))).alias("independent_coverage"), F.avg(F.col("documentary").cast("double")).alias("documentary_fraction"), F.avg(mass).alias("mean_mass"), F.median(mass).alias("median_mass"),
    )
    a = attestors.where("attestor_key IS NOT NULL").select("subject_id", "attestor_key", F.coalesce("kind", F.lit("?")).alias("kind")).distinct()
    a = a.groupBy("subject_id").agg(F.count_if(F.col("kind") != "SUBJECT").alias("independent_attestors"), F.countDistinct("kind").alias("kinds"))
    against = F.col("relation") == "CONTRADICTS"
    e = edges.groupBy("subject_id").agg(
        F.sum(F.when(against, F.col("confidence") * F.when(F.col("explained"), 1 - p.explanation_mitigation).otherwise(1.0)).otherwise(0.0)).alias("residual"),
        F.count_if(against).alias("contradictions"), F.count_if(F.col("relation") == "CORROBORATES").alias("corroborations"),
    )
    rows = f.join(a, "subject_id", "left").join(e, "subject_id", "left").na.fill(0, ["independent_attestors", "kinds", "contradictions", "corroborations"]).na.fill(0.0, ["residual"])
    x, y, z = p.diversity_shares
    one = F.lit(1.0)
    diversity = clip(x * F.least(one, F.col("independent_attestors") / p.attestor_target) + y * clip((F.col("kinds") - 1).cast("double"), 0.0, 2.0) / 2 + z * F.least(one, F.col("documentary_fraction") / p.doc_coverage_target), 0.0, 1.0)
    rows = rows.withColumns({"source_diversity": diversity, "contradiction_drag": F.col("residual") / (F.col("residual") + p.contradiction_midpoint)})
    rows = rows.withColumns(
        {
            "depth_factor": 1 - p.depth_weight * (1 - F.col("evidence_depth")),
            "coverage_factor": 1 - p.self_only_penalty * (1 - F.col("independent_coverage")),
            "diversity_factor": 1 - p.diversity_weight * (1 - F.col("source_diversity")),
            "contradiction_factor": 1 - p.contradiction_drag_weight * F.col("contradiction_drag"),
        }
    )
    rows = rows.withColumn("score", clip(F.col("weighted_belief") * F.col("depth_factor") * F.col("coverage_factor") * F.col("diversity_factor") * F.col("contradiction_factor"), 0.0, 1.0))
    return rows.withColumns({"display": display(F.col("score")), "band": band(F.col("score"), p)})


def ledger_mean(rows: DataFrame, score_: str = "score", mass: str = "evidence_mass") -> DataFrame:
    """Mass-weighted mean of the scores of positive mass by subject; null where there is none."""
    ok = F.col(mass) > 0
    mean = F.try_divide(F.sum(F.when(ok, F.col(score_) * F.col(mass))), F.sum(F.when(ok, F.col(mass))))
    return rows.groupBy("subject_id").agg(mean.alias("mean"), F.count_if(ok).alias("contributing")).withColumn("display", display(F.col("mean")))


def histogram(rows: DataFrame, score_: str = "score", bins: int = 20) -> DataFrame:
    """Counts in every fixed-width bin, empty ones too."""
    b = F.greatest(F.least(F.floor(F.col(score_) * bins), F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin")
    got = rows.groupBy(b).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").na.fill(0, ["n"])


def contradiction_queue(edges: DataFrame, p: Params) -> DataFrame:
    """Proposed, unexplained contradictions of enough confidence, most confident first in each subject."""
    order = Window.partitionBy("subject_id").orderBy(F.desc("confidence"), "from_fact", "to_fact")
    rows = edges.where((F.col("relation") == "CONTRADICTS") & (F.col("review_status") == "PROPOSED") & ~F.col("explained") & (F.col("confidence") >= p.confidence_floor))
    return rows.select("subject_id", F.row_number().over(order).cast("long").alias("place"), "from_fact", "to_fact", "confidence")


def score_sanity(rows: DataFrame) -> DataFrame:
    """Mean scores of anchored, endorsed and self-only claims, and whether they stand in the expected order."""
    out = rows.groupBy("subject_id").agg(*[F.avg(F.when(F.col("source_class") == c, F.col("score"))).alias(n) for c, n in (("DOCUMENTARY", "anchored_mean"), ("ENDORSEMENT", "endorsed_mean"), ("SELF", "self_mean"))])
    return out.withColumn("ordered", F.coalesce((F.col("anchored_mean") >= F.col("endorsed_mean")) & (F.col("endorsed_mean") >= F.col("self_mean")), F.lit(False)))
