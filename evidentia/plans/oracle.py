"""DuckDB SQL for the registered queries; common table expressions give the ledger's fixtures."""

from __future__ import annotations

CLAIMS = """d0 AS (SELECT doc_id, text, source, lang, CAST(floor(doc_id / 20.0) AS bigint) AS q FROM documents),
c0 AS (SELECT d0.*, l.quality, l.toxic, CASE CAST(floor(q / 2.0) AS bigint) % 5 WHEN 0 THEN 'SELF' WHEN 1 THEN 'ENDORSEMENT' WHEN 2 THEN 'DOCUMENTARY' WHEN 3 THEN 'PUBLIC_PROFILE' ELSE 'EVENT_CAPTURE' END AS source_class
       FROM d0 LEFT JOIN labels l ON l.doc_id = d0.doc_id),
claims AS (SELECT doc_id, q, concat('c', lpad(CAST(doc_id AS varchar), 7, '0')) AS claim_id, source AS subject_id, concat(source, '-', q % 7) AS asset_id,
  CASE q % 5 WHEN 0 THEN 'IDENTITY' WHEN 1 THEN 'EPISODE' WHEN 2 THEN 'VALUE' WHEN 3 THEN 'WEAKNESS' ELSE 'SKILL' END AS claim_type, source_class,
  CASE WHEN q % 4 = 0 THEN 'INFERRED' ELSE 'STATED' END AS basis,
  CASE WHEN quality = 0 THEN 0.3::double WHEN toxic = 1 THEN 0.45::double WHEN quality = 1 THEN 0.8::double END AS favorability,
  CASE q % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(2010 + q % 15 AS varchar) WHEN 2 THEN concat(2010 + q % 15, '-0', 1 + q % 9) ELSE concat(2010 + q % 15, '-0', 1 + q % 9, '-1', q % 9) END AS claimed_date,
  q % 11 = 0 AS sensitive, text, lang, CASE q % 7 WHEN 0 THEN 'SUBJECT' WHEN 1 THEN 'ENDORSER' WHEN 2 THEN 'INTERVIEWER' END AS speaker_role,
  CASE q % 4 WHEN 1 THEN 'MANAGER' WHEN 2 THEN 'EXPERT' END AS speaker_relationship, CASE q % 2 WHEN 0 THEN 's1' END AS speaker, CASE q % 5 WHEN 0 THEN ' Ana  Maria ' END AS speaker_name,
  CASE source_class WHEN 'DOCUMENTARY' THEN 'HIGH' WHEN 'SELF' THEN 'LOW' ELSE 'MEDIUM' END AS tier_seed,
  CASE source_class WHEN 'SELF' THEN 'SELF' WHEN 'ENDORSEMENT' THEN 'PEER' WHEN 'DOCUMENTARY' THEN 'INSTITUTION' ELSE 'UNKNOWN' END AS relationship,
  CASE source_class WHEN 'SELF' THEN concat('subject:', source) WHEN 'DOCUMENTARY' THEN concat('issuer:asset:', source, '-', q % 7) ELSE concat('endorser:', lang) END AS attestor_key,
  q % 5 = 2 AS explained, CASE q % 3 WHEN 0 THEN ['ORG'] WHEN 1 THEN ['PLACE', 'SKILL'] ELSE []::varchar[] END AS mention_types FROM c0),
reviews AS (SELECT claim_id, CASE q % 9 WHEN 0 THEN 'CONTESTED' WHEN 1 THEN 'SIDECARED' WHEN 2 THEN 'APPROVED' END AS decision, CASE q % 2 WHEN 0 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS pii_choice FROM claims WHERE q % 9 < 3)"""

VECTORS = "vectors AS (SELECT subject_id, claim_id, embedding::double[] AS v FROM claims JOIN embeddings ON vec_id = doc_id)"
YEAR = "TRY_CAST(substr(claimed_date, 1, 4) AS int)"

#: kNN pairs at the fixture's thresholds: floor 0.2, k 3.
KNN = """near AS (SELECT a.subject_id, a.claim_id AS x, b.claim_id AS y, list_dot_product(a.v, b.v) AS sim FROM vectors a JOIN vectors b ON a.subject_id = b.subject_id AND a.claim_id <> b.claim_id),
knn AS (SELECT subject_id, least(x, y) AS a, greatest(x, y) AS b, max(sim) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, x ORDER BY sim DESC, y) AS r FROM near WHERE sim >= 0.2) WHERE r <= 3 GROUP BY 1, 2, 3)"""
STRUCTURAL = f"""ep AS (SELECT subject_id, claim_id, {YEAR} AS y FROM claims WHERE claim_type = 'EPISODE' AND {YEAR} IS NOT NULL),
structural AS (SELECT a.subject_id, a.claim_id AS a, b.claim_id AS b FROM ep a JOIN ep b ON a.subject_id = b.subject_id AND a.claim_id < b.claim_id AND abs(a.y - b.y) <= 5)"""
HUMAN = """human AS (SELECT DISTINCT e.subject_id, least(e.claim_id, c.claim_id) AS a, greatest(e.claim_id, c.claim_id) AS b FROM claims e JOIN claims c ON e.subject_id = c.subject_id AND c.q = e.q + 1 WHERE e.q % 10 = 3 AND c.q % 10 = 4)"""
UNION = """cand AS (SELECT subject_id, a, b, list_sort(list(DISTINCT s)) AS sources FROM (SELECT subject_id, a, b, 'KNN' AS s FROM knn UNION ALL SELECT subject_id, a, b, 'STRUCTURAL' FROM structural UNION ALL SELECT subject_id, a, b, 'HUMAN' FROM human) GROUP BY 1, 2, 3)"""
#: The cascade at the fixture's thresholds: floor 0.2, repeat 0.3; the fixture has no shared entities and no exemplars.
GRADED = """sims AS (SELECT c.subject_id, c.a, c.b, c.sources, coalesce(list_dot_product(x.v, y.v), 0) AS sim FROM cand c LEFT JOIN vectors x ON x.claim_id = c.a LEFT JOIN vectors y ON y.claim_id = c.b),
ends AS (SELECT s.*, list_contains(sources, 'HUMAN') AS human, x.claim_type AS ta, y.claim_type AS tb, x.text AS xa, y.text AS xb, x.asset_id AS sa, y.asset_id AS sb, TRY_CAST(substr(x.claimed_date, 1, 4) AS int) AS ya, TRY_CAST(substr(y.claimed_date, 1, 4) AS int) AS yb,
  x.explained AS ea, y.explained AS eb FROM sims s JOIN claims x ON x.claim_id = s.a JOIN claims y ON y.claim_id = s.b),
graded AS (SELECT *, CASE WHEN NOT human AND sim < 0.2 THEN 'DISCARDED' WHEN sa = sb AND xa = xb THEN 'REPEATS_2' WHEN sim >= 0.3 AND ta = tb AND coalesce(ya = yb, true) THEN 'REPEATS_3'
  WHEN NOT human AND ((least(ta, tb) = 'IDENTITY' AND greatest(ta, tb) = 'VALUE' AND sim < 0.2) OR (ta = 'EPISODE' AND tb = 'EPISODE' AND coalesce(abs(ya - yb), 0) > 5)) THEN 'DISCARDED' ELSE 'QUEUED' END AS outcome FROM ends)"""
#: The cap of the fixture: two candidates a claim.
QUEUE = """q0 AS (SELECT subject_id, a, b, greatest(sim, 0) AS block_score, sources, human AS human_asserted, ea OR eb AS with_context FROM graded WHERE outcome = 'QUEUED'),
free AS (SELECT * FROM q0 WHERE NOT human_asserted AND NOT list_contains(sources, 'STRUCTURAL')),
kept AS (SELECT DISTINCT subject_id, a, b FROM (SELECT subject_id, a, b, row_number() OVER (PARTITION BY subject_id, e ORDER BY block_score DESC, a, b) AS r FROM (SELECT *, a AS e FROM free UNION ALL SELECT *, b AS e FROM free)) WHERE r <= 2),
capped AS (SELECT f.subject_id, f.a, f.b FROM free f ANTI JOIN kept k ON f.a = k.a AND f.b = k.b),
queue AS (SELECT q0.*, row_number() OVER (PARTITION BY subject_id ORDER BY human_asserted DESC, block_score DESC, a, b) - 1 AS rank FROM q0 ANTI JOIN capped c ON q0.a = c.a AND q0.b = c.b)"""
MATCH = ",\n".join((CLAIMS, VECTORS, KNN, STRUCTURAL, HUMAN, UNION, GRADED))
SAMPLES = """sp AS (SELECT a, b, i, ('0x' || substr(sha256(concat_ws('#', a, b, i)), 1, 4))::int AS h, ('0x' || substr(sha256(concat_ws('#', a, b)), 1, 2))::int % 6 = 0 AND i < 4 AS against FROM (SELECT DISTINCT a, b FROM cand), (SELECT unnest(range(5)) AS i)),
samples AS (SELECT a, b, i, CASE WHEN against THEN 'CONTRADICTS' WHEN h % 10 < 2 THEN 'REPEATS' WHEN h % 10 < 5 THEN 'CORROBORATES' WHEN h % 10 = 5 THEN 'CONTRADICTS' ELSE 'NEUTRAL' END AS relation, CASE WHEN against THEN 0.8 + (h % 20) / 100.0::double ELSE 0.5 + (h % 50) / 100.0::double END AS confidence,
  concat('r', i) AS rationale, CASE WHEN h % 4 = 0 THEN 'same span' END AS temporal_note, CASE WHEN h % 3 > 0 THEN h % 3 = 1 END AS relevant FROM sp)"""
PLACE = "CASE relation WHEN 'NEUTRAL' THEN 0 WHEN 'REPEATS' THEN 1 WHEN 'CORROBORATES' THEN 2 ELSE 3 END"
VERDICTS = f"""by_rel AS (SELECT a, b, relation, count(*) AS votes, avg(confidence) AS mean, arg_min(rationale, (-confidence, i)) AS rationale, arg_min_null(temporal_note, (-confidence, i)) AS temporal_note FROM samples GROUP BY 1, 2, 3),
per AS (SELECT a, b, count(relevant) AS answers, count(*) FILTER (relevant) AS yes FROM samples GROUP BY 1, 2),
lead AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY votes DESC, {PLACE}) AS r, max(votes) OVER (PARTITION BY a, b) AS top FROM by_rel),
ties AS (SELECT a, b, count(*) FILTER (votes = top) > 1 AS tie FROM lead GROUP BY 1, 2),
verdicts AS (SELECT l.a, l.b, CASE WHEN relation <> 'NEUTRAL' AND votes / 5.0 * mean < 0.55 THEN 'NEUTRAL' ELSE relation END AS relation, votes / 5.0 * mean AS confidence, rationale, temporal_note, answers > 0 AND yes > answers // 2 AS explanation_relevant, tie,
  relation <> 'NEUTRAL' AND votes / 5.0 * mean < 0.55 AS floored, top FROM lead l JOIN per USING (a, b) JOIN ties USING (a, b) WHERE r = 1)"""
REPEATS = """rep AS (SELECT subject_id, a, b FROM graded WHERE outcome LIKE 'REPEATS%'), both_ways AS (SELECT a, b FROM rep UNION SELECT b, a FROM rep),
reach(v, r) AS (SELECT claim_id, claim_id FROM claims UNION SELECT w.b, r FROM reach JOIN both_ways w ON w.a = reach.v),
members AS (SELECT c.subject_id, c.claim_id, m.root FROM claims c JOIN (SELECT v, min(r) AS root FROM reach GROUP BY v) m ON m.v = c.claim_id)"""
FACTS = """fm AS (SELECT m.subject_id, m.root, c.claim_id, c.claim_type, c.text, c.claimed_date, c.source_class, c.mention_types,
  row_number() OVER (PARTITION BY m.subject_id, m.root ORDER BY CASE c.source_class WHEN 'DOCUMENTARY' THEN 0 WHEN 'ENDORSEMENT' THEN 1 WHEN 'EVENT_CAPTURE' THEN 2 WHEN 'PUBLIC_PROFILE' THEN 3 WHEN 'SELF' THEN 4 ELSE 5 END, -coalesce(length(c.text), 0), c.claim_id) AS r
  FROM members m JOIN claims c USING (claim_id)),
fa AS (SELECT subject_id, root, max(claim_id) FILTER (r = 1) AS exemplar_claim_id, max(claim_type) FILTER (r = 1) AS kind, count(*) AS member_count, min(claimed_date) AS valid_from, max(claimed_date) AS valid_to, min(length(claimed_date)) AS shortest,
  bool_or(source_class = 'DOCUMENTARY') AS anchored, list_distinct(flatten(list(mention_types))) AS types FROM fm GROUP BY 1, 2),
fs AS (SELECT *, CASE WHEN list_contains(types, 'ORG') AND (kind = 'IDENTITY' OR (kind = 'EPISODE' AND NOT list_has_any(types, ['PROJECT', 'SKILL', 'CREDENTIAL']))) THEN 'EMPLOYER' WHEN kind = 'IDENTITY' AND list_contains(types, 'INSTITUTION') THEN 'EDUCATION_ENROLLMENT'
  WHEN kind = 'IDENTITY' AND list_contains(types, 'PLACE') THEN 'RESIDENCE' END AS slot FROM fa),
facts AS (SELECT subject_id, concat('fact:', root) AS fact_id, exemplar_claim_id, CASE WHEN slot IS NOT NULL THEN 'STATE' WHEN kind = 'EPISODE' AND valid_from IS NOT NULL THEN 'EVENT' ELSE 'TIMELESS' END AS fact_kind, slot, valid_from, valid_to,
  CASE WHEN shortest IS NULL THEN 'NONE' WHEN shortest <= 4 THEN 'YEAR' WHEN shortest <= 7 THEN 'MONTH' ELSE 'DAY' END AS date_precision, anchored, member_count FROM fs)"""
#: Edges between facts behind the temporal gate; half of the verdicts have one with context.
EDGES = """ju AS (SELECT x.subject_id, v.a, v.b, relation, confidence, rationale, temporal_note, explanation_relevant, ctx % 2 = 0 AS ctx_judged, CASE WHEN ctx % 2 = 0 THEN CASE WHEN ctx % 3 = 0 THEN 'NEUTRAL' ELSE 'CONTRADICTS' END END AS ctx_relation,
  CASE WHEN ctx % 2 = 0 THEN confidence * 0.8 END AS ctx_confidence, concat('fact:', x.root) AS fa, concat('fact:', y.root) AS fb
  FROM (SELECT *, ('0x' || substr(sha256(concat_ws('#', b, a)), 1, 2))::int AS ctx FROM verdicts WHERE relation IN ('CORROBORATES', 'CONTRADICTS')) v JOIN members x ON x.claim_id = v.a JOIN members y ON y.claim_id = v.b WHERE x.root <> y.root),
lifted AS (SELECT subject_id, least(fa, fb) AS from_fact, greatest(fa, fb) AS to_fact, relation, max(confidence) AS confidence, arg_max_null(rationale, (confidence, a, b)) AS rationale, arg_max_null(temporal_note, (confidence, a, b)) AS temporal_note, bool_or(ctx_judged) AS with_context,
  arg_max_null(ctx_relation, (confidence, a, b)) FILTER (ctx_judged) AS ctx_relation, arg_max_null(ctx_confidence, (confidence, a, b)) FILTER (ctx_judged) AS ctx_confidence, bool_or(explanation_relevant) AS relevant, bool_or(contains(lower(coalesce(temporal_note, '')), 'same')) AS same_span,
  list_sort(list(concat(a, '↔', b))) AS pairs FROM ju GROUP BY 1, 2, 3, 4),
timed AS (SELECT l.*, x.valid_from AS xf, coalesce(x.valid_to, x.valid_from) AS xt, y.valid_from AS yf, coalesce(y.valid_to, y.valid_from) AS yt, x.date_precision = 'NONE' AND y.date_precision = 'NONE' AS undated,
  CASE WHEN x.fact_kind = 'EVENT' AND y.fact_kind = 'EVENT' THEN 4 ELSE least(length(x.valid_from), length(coalesce(x.valid_to, x.valid_from)), length(y.valid_from), length(coalesce(y.valid_to, y.valid_from))) END AS cut
  FROM lifted l JOIN facts x ON x.fact_id = l.from_fact JOIN facts y ON y.fact_id = l.to_fact),
edges AS (SELECT *, relation = 'CONTRADICTS' AND relevant AS explained FROM (SELECT *, coalesce(NOT (substr(xt, 1, cut) < substr(yf, 1, cut) OR substr(yt, 1, cut) < substr(xf, 1, cut)), false) AS overlap FROM timed) WHERE relation <> 'CONTRADICTS' OR overlap OR (undated AND same_span))"""
#: Dependence groups and base beliefs of claims with fact_id, gkey and prior.
BASE = """g0 AS (SELECT subject_id, fact_id, gkey, max(prior) AS strength FROM gk GROUP BY 1, 2, 3), g1 AS (SELECT *, row_number() OVER (PARTITION BY subject_id, fact_id ORDER BY strength DESC, gkey) AS rk FROM g0),
ga AS (SELECT DISTINCT subject_id, fact_id, gkey, asset_id FROM gk), gf AS (SELECT ga.*, rk, min(rk) OVER (PARTITION BY ga.subject_id, ga.fact_id, asset_id) AS first FROM ga JOIN g1 USING (subject_id, fact_id, gkey)),
gs AS (SELECT subject_id, fact_id, gkey, bool_and(first < rk) AS seen FROM gf GROUP BY 1, 2, 3), g2 AS (SELECT g1.*, CASE WHEN seen THEN 0.4 ELSE 1 END AS dep FROM g1 JOIN gs USING (subject_id, fact_id, gkey)),
b0 AS (SELECT subject_id, fact_id, 1 - product(1 - strength * dep) AS belief, sum(dep) AS evidence_mass, count(*) AS n_groups, arg_min(gkey, rk) AS strongest FROM g2 GROUP BY 1, 2)"""
#: The fixed point over the facts: both passes, at most 20 rounds, a subject's pass stops when its beliefs have settled.
SCORES = """gk AS (SELECT p.*, concat('fact:', m.root) AS fact_id, CASE WHEN source_class = 'SELF' THEN 'self' ELSE attestor_key END AS gkey FROM pri p JOIN members m USING (claim_id, subject_id)),
{BASE},
fk AS (SELECT f.subject_id, f.fact_id, f.anchored, CASE WHEN x.claim_type = 'SKILL' THEN 5.0::double END AS half FROM facts f JOIN claims x ON x.claim_id = f.exemplar_claim_id),
fm2 AS (SELECT fk.subject_id, fk.fact_id, any_value(fk.anchored) AS anchored, any_value(half) AS half, count(*) AS n_members, bool_and(source_class = 'SELF') AS all_self, bool_or(coalesce(favorability < 0.5, false)) AS against, max(claimed_date) AS newest,
  avg(CASE WHEN half IS NULL OR claimed_date IS NULL THEN 1 ELSE pow(0.5, greatest(2026 - substr(claimed_date, 1, 4)::int, 0) / half) END) AS recency FROM fk JOIN gk USING (subject_id, fact_id) GROUP BY 1, 2),
fb AS (SELECT fm2.*, belief AS b0, evidence_mass, n_groups, strongest, ln(greatest(least(belief, 1 - 1e-9), 1e-9) / (1 - greatest(least(belief, 1 - 1e-9), 1e-9))) AS s0 FROM fm2 JOIN b0 USING (subject_id, fact_id)),
ways AS (SELECT subject_id, from_fact AS fact_id, to_fact AS other, relation, confidence, with_context, ctx_relation, ctx_confidence, explained AS told FROM edges UNION ALL SELECT subject_id, to_fact, from_fact, relation, confidence, with_context, ctx_relation, ctx_confidence, explained FROM edges),
act AS (SELECT w.subject_id, w.fact_id, w.other, relation, ex, CASE WHEN ctx THEN least(confidence, coalesce(ctx_confidence, confidence)) ELSE confidence END AS conf, CASE WHEN ctx AND told THEN 0.4 ELSE 1 END AS mit, o.strongest AS og,
  CASE WHEN f.half IS NULL OR o.newest IS NULL THEN 1 ELSE pow(0.5, greatest(2026 - substr(o.newest, 1, 4)::int, 0) / f.half) END AS rec
  FROM (SELECT ways.*, ex, relation = 'CONTRADICTS' AND ex AND coalesce(with_context, false) AS ctx FROM ways, (SELECT unnest([false, true]) AS ex)) w JOIN fb f ON f.fact_id = w.fact_id JOIN fb o ON o.fact_id = w.other WHERE NOT ctx OR ctx_relation IS NOT DISTINCT FROM 'CONTRADICTS'),
st AS (SELECT 0 AS it, subject_id, fact_id, ex, anchored, s0, s0 AS s, b0 AS b, 0::double AS sup, 0::double AS con, 0::double AS mass, false AS done FROM fb, (SELECT unnest([false, true]) AS ex)
  UNION ALL SELECT it + 1, subject_id, fact_id, ex, anchored, s0, CASE WHEN done THEN s ELSE sn END, CASE WHEN done THEN b ELSE bn END, CASE WHEN done THEN sup ELSE up END, CASE WHEN done THEN con ELSE down END, CASE WHEN done THEN mass ELSE ms END, done OR max(abs(bn - b)) OVER (PARTITION BY subject_id, ex) < 0.005
  FROM (SELECT *, 1 / (1 + exp(-sn)) AS bn FROM (SELECT x.*, coalesce(u.up, 0) AS up, coalesce(u.down, 0) AS down, coalesce(u.ms, 0) AS ms, 0.5 * x.s + 0.5 * CASE WHEN x.anchored THEN x.s + 0.2 * (x.s0 + coalesce(u.up, 0) - coalesce(u.down, 0) - x.s) ELSE x.s0 + coalesce(u.up, 0) - coalesce(u.down, 0) END AS sn
    FROM st x LEFT JOIN (SELECT subject_id, fact_id, ex, sum(CASE WHEN relation = 'CORROBORATES' THEN term * pow(0.4, rk - 1) ELSE 0 END) AS up, sum(CASE WHEN relation = 'CORROBORATES' THEN 0.8 * conf * pow(0.4, rk - 1) ELSE 0 END) AS ms, sum(CASE WHEN relation = 'CONTRADICTS' THEN 1.2 * conf * voice * mit ELSE 0 END) AS down
      FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, fact_id, ex, relation, og ORDER BY term DESC, other) AS rk FROM (SELECT a.*, greatest(least(2 * v.b - 1, 1), 0) AS voice, 0.8 * conf * greatest(least(2 * v.b - 1, 1), 0) * rec AS term FROM act a JOIN st v ON v.fact_id = a.other AND v.ex = a.ex)) GROUP BY 1, 2, 3) u USING (subject_id, fact_id, ex)
    WHERE x.it < 20))),
fin AS (SELECT st.subject_id, st.fact_id, st.ex, sup, con, mass, greatest(least(CASE WHEN all_self AND NOT against AND NOT EXISTS (SELECT 1 FROM act a WHERE a.fact_id = st.fact_id AND a.ex = st.ex AND a.relation = 'CORROBORATES') THEN least(b, 0.65) ELSE b END, 0.98), 0.02) AS belief, n_groups / n_members AS independence, recency, evidence_mass + mass AS evidence_mass
  FROM st JOIN fb USING (subject_id, fact_id) WHERE it = 20),
scored AS (SELECT t.subject_id, t.fact_id, t.belief, u.belief AS belief_bare, u.sup AS support, u.con AS conflict, u.independence, u.recency, u.evidence_mass FROM fin t JOIN fin u ON u.fact_id = t.fact_id AND NOT u.ex WHERE t.ex)""".replace("{BASE}", BASE)
#: A prior-only belief: what the score queries that SQL can say are built on.
PRIORS = """pri AS (SELECT *, 1 / (1 + exp(-(ln(base / (1 - base)) + CASE WHEN source_class = 'SELF' AND favorability < 0.5 THEN 0.4 ELSE 0 END + CASE WHEN basis = 'INFERRED' THEN -0.5 ELSE 0 END))) AS prior FROM
  (SELECT *, CASE tier_seed WHEN 'HIGH' THEN 0.85::double WHEN 'MEDIUM' THEN 0.60::double ELSE 0.35::double END AS base FROM claims))"""


def q(ctes: str, select: str) -> str:
    return f"WITH {'RECURSIVE ' if 'reach(' in ctes or 'RECURSE' in ctes else ''}{ctes}\n{select}"
