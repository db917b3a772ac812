"""Registered queries of what follows a delta: merges, splits, redirects, components, and beliefs after actions on contradictions."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from evidentia.operators import entities, incremental, lifecycle, scoring
from evidentia.operators.iterate import components, save, shared_folder
from evidentia.plans import fixtures as fx
from evidentia.plans import oracle as o
from evidentia.plans.more import ACTION, NEAR, VEC, _entities, when
from evidentia.plans.queries import FACT_CTE, P, _edges, query, r6

MERGES = """RECURSE AS (SELECT 1), ent AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'PLACE' ELSE 'ORG' END AS t, CASE WHEN c_custkey % 11 = 10 AND c_custkey > 1 THEN c_custkey - 1 END AS m FROM customer),
ask AS (SELECT k, CASE k % 6 WHEN 1 THEN k - 1 WHEN 2 THEN k - 1 WHEN 3 THEN k WHEN 4 THEN k + 1 WHEN 5 THEN k - 1 END AS g FROM ent WHERE k % 6 > 0),
jud AS (SELECT a.k, a.g, CASE WHEN a.k = a.g THEN 'SELF' WHEN x.k IS NULL THEN 'NOT_FOUND' WHEN e.m IS NOT NULL THEN 'MERGED' WHEN x.m IS NOT NULL THEN 'TARGET_MERGED' WHEN e.t <> x.t THEN 'OTHER_TYPE' END AS r FROM ask a JOIN ent e ON e.k = a.k LEFT JOIN ent x ON x.k = a.g),
ok AS (SELECT k, g FROM jud WHERE r IS NULL), walk(k, x) AS (SELECT k, g FROM ok UNION SELECT walk.k, ok.g FROM walk JOIN ok ON ok.k = walk.x),
ends AS (SELECT * FROM (SELECT k, coalesce(max(x) FILTER (x NOT IN (SELECT k FROM ok)), least(min(x), k)) AS l FROM walk GROUP BY k) WHERE l <> k)"""
NAME = "'e' || lpad(({})::varchar, 7, '0')"


def _merged(spark, sf_dir):
    k = F.col("c_custkey")
    name = lambda c, x: F.concat(F.lit(c), F.lpad(x.cast("string"), 7, "0"))
    c = fx.table(spark, sf_dir, "customer")
    canon = c.select(name("e", k).alias("entity_id"), F.when(k % 7 == 0, "PLACE").otherwise("ORG").alias("entity_type"), name("k", k).alias("canonical_key"), F.array(name("z", k)).alias("alias_keys"), F.when((k % 11 == 10) & (k > 1), name("e", k - 1)).alias("merged_into"))
    to = when(k % 6, None, -1, -1, 0, 1, -1, type_="long")
    merges = c.where("c_custkey % 6 > 0").select(name("e", k).alias("entity_id"), name("e", k + to).alias("target_id"))
    return incremental.merge_entities(c.select(k.alias("claim_id"), name("e", k).alias("entity_id")), canon, merges)


@query(o.q(MERGES, f"""SELECT {NAME.format('ent.k')} AS entity_id, {NAME.format('coalesce(e.l, f.l, ent.m)')} AS merged_into, array_to_string(list_sort(list_concat([concat('z', lpad(ent.k::varchar, 7, '0'))], coalesce(g.a, []))), ',') AS aliases
  FROM ent LEFT JOIN ends e ON e.k = ent.k LEFT JOIN ends f ON f.k = ent.m LEFT JOIN (SELECT l, flatten(list([concat('k', lpad(k::varchar, 7, '0')), concat('z', lpad(k::varchar, 7, '0'))])) AS a FROM ends GROUP BY l) g ON g.l = ent.k"""))
def merged_entities(spark, sf_dir):
    return _merged(spark, sf_dir)[1].select("entity_id", "merged_into", F.array_join("alias_keys", ",").alias("aliases"))


@query(o.q(MERGES, f"SELECT {NAME.format('jud.k')} AS entity_id, {NAME.format('g')} AS target_id, coalesce(r, CASE WHEN e.k IS NULL THEN 'CYCLE' END) AS refusal FROM jud LEFT JOIN ends e ON e.k = jud.k"))
def merge_refusals(spark, sf_dir):
    return _merged(spark, sf_dir)[2]


@query(o.q(MERGES, f"SELECT ent.k AS claim_id, {NAME.format('coalesce(l, ent.k)')} AS entity_id FROM ent LEFT JOIN ends e ON e.k = ent.k"))
def merged_mentions(spark, sf_dir):
    return _merged(spark, sf_dir)[0]


@query("SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 400 = 0 THEN c_custkey ELSE greatest(c_custkey - c_custkey % 400, 1) END AS live_id FROM customer")
def compacted_redirects(spark, sf_dir):
    k = F.col("c_custkey")
    return incremental.compacted(fx.table(spark, sf_dir, "customer").select(k.alias("entity_id"), F.when((k % 400 > 0) & (k > 1), k - 1).alias("merged_into")))


@query(o.q("""RECURSE AS (SELECT 1), le AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 5 < 3 UNION ALL SELECT c_custkey, c_custkey + 7 FROM customer WHERE c_custkey % 31 = 0),
bw AS (SELECT a, b FROM le UNION SELECT b, a FROM le), rc(v, r) AS (SELECT a, a FROM bw UNION SELECT bw.b, rc.r FROM rc JOIN bw ON bw.a = rc.v)""", "SELECT v, min(r) AS root FROM rc GROUP BY v"))
def incremental_components(spark, sf_dir):
    k = F.col("c_custkey")
    c = fx.table(spark, sf_dir, "customer")
    labels = components(c.where("c_custkey % 5 < 3").select(k.alias("a"), (k + 1).alias("b")))
    return incremental.merged_components(labels, c.where("c_custkey % 31 = 0").select(k.alias("a"), (k + 7).alias("b")))


@query(o.q(VEC + """,
own AS (SELECT k AS claim_id, t, s, v, concat('e', lpad((k - 1)::varchar, 7, '0')) AS own_id, (k - 1) % 6 = 0 AS canonical FROM mn WHERE (k - 1) % 24 <> 0 AND k % 3 <> 0),
cn AS (SELECT own.claim_id, lv.id, round(list_dot_product(own.v, lv.v), 10) AS sim FROM own JOIN lv ON lv.t = own.t AND lv.id <> own.own_id),
bs AS (SELECT claim_id, arg_min(id, (-sim, id)) AS id, max(sim) AS sim FROM cn WHERE sim >= 0.2 GROUP BY 1)""", """SELECT own.claim_id, s AS surface_key, own_id AS from_id, CASE WHEN canonical THEN own_id ELSE coalesce(bs.id, concat('ent-', substr(sha256(concat_ws('|', 'split', own_id, t, s)), 1, 16))) END AS entity_id,
  CASE WHEN canonical THEN 'KEPT' WHEN bs.sim >= 0.3 THEN 'MERGED' WHEN bs.sim IS NOT NULL THEN 'REVIEW' ELSE 'MINTED' END AS how FROM own LEFT JOIN bs USING (claim_id)"""))
def entity_splits(spark, sf_dir):
    mentions, canon = _entities(spark, sf_dir)
    own = F.concat(F.lit("e"), F.lpad((F.col("claim_id") - 1).cast("string"), 7, "0"))
    linked = mentions.withColumn("entity_id", own).where("claim_id % 3 <> 0")
    return entities.split_entities(linked, canon, canon, NEAR)[0].drop("entity_type")


@query(o.q(VEC, "SELECT count(*) AS n_mentions, count(*) AS n_exact FROM mn"))
def grown_canon(spark, sf_dir):
    """After a resolution that merges all, every mention is found by key or alias."""
    mentions, canon = _entities(spark, sf_dir)
    first = save(entities.resolve(mentions, canon, replace(NEAR, entity_merge=NEAR.entity_review)), "resolved")
    again = entities.resolve_exact(mentions.drop("embedding"), entities.grown(canon, first, mentions))
    return again.agg(F.count("*").alias("n_mentions"), F.count_if(F.col("how").isNotNull()).alias("n_exact"))


#: Actions on the contradictions of half of the subjects.
HALF = "('0x' || substr(sha256(subject_id), 1, 2))::int % 2 = 0"
ACTED = f"""edges AS (SELECT * REPLACE (CASE WHEN act = 2 THEN true ELSE explained END AS explained, CASE WHEN act = 2 THEN true ELSE with_context END AS with_context, CASE WHEN act = 2 THEN 'NEUTRAL' ELSE ctx_relation END AS ctx_relation, CASE WHEN act = 2 THEN 0.4 ELSE ctx_confidence END AS ctx_confidence)
  FROM (SELECT *, CASE WHEN relation = 'CONTRADICTS' AND {HALF} THEN {ACTION} ELSE -1 END AS act FROM edges0) WHERE act <> 1)"""
RESCORED = "RECURSE AS (SELECT 1),\n" + ",\n".join((FACT_CTE, o.SAMPLES, o.VERDICTS, o.EDGES.replace("edges AS (SELECT *, relation", "edges0 AS (SELECT *, relation"), ACTED, o.PRIORS, o.SCORES))


@query(o.q(RESCORED, "SELECT subject_id, fact_id, round(belief, 6) AS belief, round(belief_bare, 6) AS belief_bare, round(conflict, 6) AS conflict FROM scored"))
def rescored_beliefs(spark, sf_dir):
    """Beliefs of all subjects from a store in which only the subjects of the acted contradictions were scored anew."""
    c, (members, f), edges, _ = _edges(spark, sf_dir)
    at = members.select("claim_id", F.concat(F.lit("fact:"), F.col("root")).alias("fact_id"))
    trust = F.when(F.col("source_class") == "DOCUMENTARY", 0.85).when(F.col("source_class") == "SELF", 0.5).otherwise(0.6)
    att = save(c.groupBy("attestor_key").agg(F.max(trust).alias("trust_prior")).withColumn("trust", F.col("trust_prior")), "attestors")
    claims = save(c.join(at, "claim_id").withColumn("declared", F.lit(False)), "claims", by="subject_id")
    f, edges = save(f, "facts", by="subject_id"), save(edges, "fact-edges", by="subject_id")
    folder = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    incremental.store_scores(scoring.score(claims, f, att, edges, P), folder)
    against = edges.where("relation = 'CONTRADICTS'").where(F.conv(F.substring(F.sha2("subject_id", 256), 1, 2), 16, 10).cast("int") % 2 == 0)
    n = F.conv(F.substring(F.sha2(F.concat("from_fact", "to_fact"), 256), 1, 2), 16, 10).cast("int")
    actions = save(against.select("subject_id", "from_fact", "to_fact", when(n, "CONFIRM", "DISMISS", "REJUDGE").alias("action")), "actions")
    pair = F.split("p", "↔")
    again = against.select(F.explode("contributing_pairs").alias("p")).select(pair[0].alias("a"), pair[1].alias("b"), F.lit(0.9).alias("confidence"), F.lit("NEUTRAL").alias("ctx_relation"), F.lit(0.4).alias("ctx_confidence"), F.lit(True).alias("explanation_relevant")).distinct()
    kept = save(lifecycle.settled_contradictions(edges, actions, again)[0], "fact-edges", by="subject_id")
    incremental.rescored(claims, f, att, kept, actions, folder, P)
    return incremental.stored_scores(spark, folder)["facts"].select("subject_id", "fact_id", *[r6(x, x) for x in ("belief", "belief_bare", "conflict")])
