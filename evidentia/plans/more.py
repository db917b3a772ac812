"""Further registered queries: reads and writes, review and publishing steps, bookkeeping, planning, evaluation and entities."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from evidentia.functions import jsonio, maths
from evidentia.functions.hashing import keyed_hash, map_hash, turns_hash
from evidentia.functions.text import ellipsis, rendered, without_sentences
from evidentia.operators import assembly, entities, evaluation, extraction, judging, ledger, lifecycle, planning, publish, serialization, training, views
from evidentia.operators.iterate import save, shared_folder
from evidentia.plans import fixtures as fx
from evidentia.plans import oracle as o
from evidentia.plans.queries import COUNTED, EDGE_CTE, FACT_CTE, JUDGED_CTE, SCORE_CTE, SCORED, TURNS, P, _conversations, _edges, _graded, _judged, _members, _scores, _verdicts, query, r6
from evidentia.sources import tables
from evidentia.streaming import limits


def today():
    return F.lit("2026-01-10 12:00:00").cast("timestamp")


def rows(spark, sf_dir, name):
    return fx.table(spark, sf_dir, name)


def when(n, *values, type_="string"):
    """The value at place n modulo their number."""
    out = F.lit(None).cast(type_)
    for k, v in enumerate(values):
        out = F.when(F.pmod(n, F.lit(len(values))) == k, F.lit(v).cast(type_)).otherwise(out)
    return out


def sql_when(n: str, *values) -> str:
    said = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE ({n}) % {len(values)} " + " ".join(f"WHEN {k} THEN {said(v)}" for k, v in enumerate(values)) + " END"


# --- reads and writes


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return tables.point(rows(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def multi_get(spark, sf_dir):
    keys = rows(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.multi_get(rows(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), keys, "o_orderkey")


@query(o.q(TURNS, """SELECT to_json({'messages': list_concat(CASE WHEN trim(coalesce(any_value(system), '')) <> '' THEN [{'role': 'system', 'content': any_value(system)}] ELSE [] END, list({'role': CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, 'content': text} ORDER BY i))})::varchar AS value FROM tu LEFT JOIN sy USING (conv_id) GROUP BY conv_id"""))
def lines_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    tables.write_lines(_conversations(spark, sf_dir).select(serialization.messages_line().alias("line")), "line", path)
    return tables.read_lines(spark, path).select("value")


@query("SELECT p_partkey::varchar AS path, 8000 + p_size AS sample_rate, p_size % 2 + 1 AS channels FROM part UNION ALL SELECT 'none', NULL, NULL")
def sound_probe(spark, sf_dir):
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    box = lambda size, name: f"{size:08x}" + name.encode().hex()
    head = box(92, "moov") + box(84, "trak") + box(76, "mdia") + box(68, "minf") + box(60, "stbl") + box(52, "stsd") + "0" * 16 + box(36, "mp4a") + "0" * 32
    p = rows(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("s"))
    files = p.select(F.col("p_partkey").cast("string").alias("path"), F.unhex(F.concat(F.lit(head), hexed(F.col("s") % 2 + 1, 4), F.lit("0" * 12), hexed(F.col("s") + 8000, 4), F.lit("0000"))).alias("content"))
    return tables.box_probe(files.unionByName(spark.createDataFrame([("none", bytearray(b"no box"))], "path string, content binary")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'NEW' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey % 5 <> 0 OR o_orderkey % 2 = 0")
def replace_orders(spark, sf_dir):
    t = rows(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    twice = t.where("o_custkey % 5 = 0")
    fresh = twice.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("NEW"))
    lone = twice.select("o_custkey").distinct().join(fresh.select("o_custkey").distinct(), "o_custkey", "left_anti")
    return tables.delete_for_key(tables.replace_for_key(t, fresh, "o_custkey"), lone, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_orders(spark, sf_dir):
    gone = rows(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.delete_for_key(rows(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), gone, "o_custkey").select("o_orderkey")


@query("""SELECT c_custkey::varchar AS k, concat('{"schemaVersion":1,"name":', to_json(concat(c_name, chr(10), '"\\', chr(9), 'é')), ',"balance":', floor(c_acctbal)::bigint, '}') AS v FROM customer""")
def canonical_messages(spark, sf_dir):
    c = rows(spark, sf_dir, "customer")
    fields = {"schemaVersion": F.lit(1), "name": F.concat("c_name", F.lit('\n"\\\té')), "balance": F.floor("c_acctbal")}
    return tables.messages(c, "c_custkey", fields, ("name",)).select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query("""SELECT conv_id, place, speaker, text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) AS place, speaker, text FROM (SELECT conv_id, g, concat('Speaker ', any_value(role)) AS speaker, string_agg(w, ' ' ORDER BY turn) AS text FROM
  (SELECT conv_id, turn, role, text AS w, sum(CASE WHEN role <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, lag(role, 1, role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)) GROUP BY 1, 2))""")
def transcript_segments(spark, sf_dir):
    t = rows(spark, sf_dir, "conversations")
    word = F.struct("turn", F.col("text").alias("word"), F.col("role").alias("speaker"), F.lit("1.5s").alias("start"), F.lit("2s").alias("end"))
    words = F.transform(F.array_sort(F.collect_list(word)), lambda w: F.struct(w["word"].alias("word"), w["speaker"].alias("speaker"), w["start"].alias("start"), w["end"].alias("end")))
    results = t.groupBy(F.col("conv_id").alias("asset_id")).agg(F.array(F.struct(F.lit("3s").alias("end"), F.array(F.struct(F.lit(None).cast("string").alias("transcript"), words.alias("words"))).alias("alternatives"))).alias("results"))
    return tables.transcript_segments(results).select(F.col("asset_id").alias("conv_id"), "place", "speaker", "text")


# --- review and publishing


@query(f"SELECT p_partkey FROM part WHERE {sql_when('p_size', 'AUDIO', 'VIDEO', 'LINK', 'DOCUMENT', 'TEXT')} <> 'LINK' AND p_size % 3 <> 0 AND p_size % 4 <> 1")
def eligible_assets(spark, sf_dir):
    s = F.col("p_size")
    a = rows(spark, sf_dir, "part").select("p_partkey", when(s, "AUDIO", "VIDEO", "LINK", "DOCUMENT", "TEXT").alias("modality"), when(s, "PENDING", "GRANTED", "GRANTED").alias("consent"), when(s, "STORED", "FAILED", "STORED", "STORED").alias("status"), F.lit("x").alias("uri"))
    return ledger.eligible_assets(a).select("p_partkey")


@query(o.q(o.CLAIMS, "SELECT claim_id FROM claims WHERE claim_type = 'SKILL' AND tier_seed = 'MEDIUM' AND lang = 'en'"))
def export_selection(spark, sf_dir):
    c = fx.claims(spark, sf_dir).select("claim_id", F.struct("claim_type", F.col("tier_seed").alias("tier"), F.array(F.upper("lang"), F.lit("x")).alias("labels")).alias("tags"))
    return c.where(publish.export_filter("SKILL", "MEDIUM", "en")).select("claim_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1 AND o_orderkey % 2 = 0")
def current_examples(spark, sf_dir):
    e = rows(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("DRAFT").alias("status"), F.struct(F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("score_run_id"), F.when(F.col("o_orderkey") % 2 == 0, "p").alias("persona_hash")).alias("stamp"))
    return publish.of_stamp(e, "r1", "p").select("o_orderkey")


@query(o.q(o.CLAIMS, "SELECT subject_id, 'CLAIM' AS kind, count(*) AS n FROM claims WHERE q % 4 <> 1 GROUP BY 1 UNION ALL SELECT subject_id, 'FACT', count(*) FROM (SELECT DISTINCT subject_id, q FROM claims) WHERE q % 5 <> 1 GROUP BY 1"))
def publish_consistency(spark, sf_dir):
    c = fx.claims(spark, sf_dir)
    run = lambda n: F.when(F.col("q") % n == 0, None).otherwise(F.concat(F.lit("run"), (F.col("q") % n).cast("string")))
    published = c.select("subject_id", F.lit("run1").alias("score_run_id")).distinct()
    return publish.inconsistent(c.select("subject_id", run(4).alias("score_run_id")), c.select("subject_id", "q").distinct().select("subject_id", run(5).alias("score_run_id")), published)


@query("SELECT p_partkey::varchar AS name, CASE WHEN p_partkey % 3 = 0 AND p_partkey < 100 THEN 'own' ELSE p_brand END AS value FROM part")
def merged_settings(spark, sf_dir):
    p = rows(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("value"))
    return publish.merged_settings(p, p.where("name % 3 = 0").withColumn("value", F.lit("own")), tuple(str(k) for k in range(100)))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'given' WHEN o_orderkey % 4 = 1 THEN 'profile' ELSE '' END AS as_of FROM orders")
def knowledge_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    return rows(spark, sf_dir, "orders").select("o_orderkey", publish.knowledge_as_of(F.when(k % 4 == 0, "given"), F.when(k % 4 == 1, "profile"), F.col("o_orderdate").cast("timestamp")).alias("as_of"))


@query(o.q(EDGE_CTE, """SELECT c.claim_id, coalesce(k.n1, 0) AS corroborates, coalesce(k.n2, 0) AS contradicts, coalesce(k.n3, 0) AS contradicts_explained, coalesce(k.n4, 0) AS contradicts_confirmed FROM members c LEFT JOIN (SELECT f, count(*) FILTER (relation = 'CONTRADICTS' AND confirmed) AS n4, count(*) FILTER (relation = 'CORROBORATES') AS n1, count(*) FILTER (relation = 'CONTRADICTS') AS n2, count(*) FILTER (relation = 'CONTRADICTS' AND explained) AS n3
  FROM (SELECT unnest([from_fact, to_fact]) AS f, relation, explained, ('0x' || substr(sha256(concat(from_fact, to_fact)), 1, 2))::int % 3 = 0 AS confirmed FROM edges) GROUP BY 1) k ON k.f = concat('fact:', c.root)"""))
def claim_edge_counts(spark, sf_dir):
    _, (members, _), edges, _ = _edges(spark, sf_dir, only=COUNTED, once=True)
    n = F.conv(F.substring(F.sha2(F.concat("from_fact", "to_fact"), 256), 1, 2), 16, 10).cast("int")
    edges = edges.withColumn("review_status", F.when((F.col("relation") == "CONTRADICTS") & (n % 3 == 0), "CONFIRMED").otherwise(F.col("review_status")))
    return publish.edge_counts(members.select("subject_id", "claim_id", F.concat(F.lit("fact:"), "root").alias("fact_id")), edges).drop("subject_id", "fact_id")


@query(o.q(EDGE_CTE, """SELECT c.claim_id, concat('fact:', m.root) AS fact_id, f.fact_kind, c.source_class AS attestor_kind, array_to_string(list_sort(list_distinct([c.lang, c.claim_type])), ',') AS entities, coalesce(e.n, 0) AS n_edges FROM claims c JOIN members m USING (claim_id) JOIN facts f ON f.fact_id = concat('fact:', m.root)
  LEFT JOIN (SELECT f, count(*) AS n FROM (SELECT from_fact AS f FROM edges UNION ALL SELECT to_fact FROM edges) GROUP BY 1) e ON e.f = f.fact_id"""))
def read_back(spark, sf_dir):
    c, (members, f), edges, _ = _edges(spark, sf_dir)
    claims = c.select("subject_id", "claim_id", "source_class", "lang", "claim_type").join(members.select("claim_id", F.concat(F.lit("fact:"), "root").alias("fact_id")), "claim_id").withColumn("attestor_key", F.col("source_class"))
    attestors = c.select(F.col("source_class").alias("attestor_key")).distinct().withColumn("attestor_kind", F.col("attestor_key"))
    mentions = c.select("claim_id", F.explode(F.array("lang", "claim_type", "lang")).alias("name"))
    out = publish.read_back(claims, f, attestors, mentions, edges)
    return out.select("claim_id", "fact_id", "fact_kind", "attestor_kind", F.array_join("entities", ",").alias("entities"), F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("n_edges"))


@query(o.q(SCORE_CTE, """SELECT k.claim_id, round(greatest(s.belief, s.belief_bare), 6) AS score, f.fact_id, f.fact_kind, f.member_count, coalesce(e.n1, 0) AS corroborates, coalesce(e.n2, 0) AS contradicts, k.attestor_key FROM gk k JOIN scored s USING (subject_id, fact_id) JOIN facts f ON f.fact_id = k.fact_id
  LEFT JOIN (SELECT f, count(*) FILTER (relation = 'CORROBORATES') AS n1, count(*) FILTER (relation = 'CONTRADICTS') AS n2 FROM (SELECT from_fact AS f, relation FROM edges UNION ALL SELECT to_fact, relation FROM edges) GROUP BY 1) e ON e.f = f.fact_id"""))
def claim_blocks(spark, sf_dir):
    from evidentia.operators import scoring

    c, (members, f), edges, _ = _edges(spark, sf_dir, only=(*SCORED, "review_status"))
    at = c.join(members.select("claim_id", F.concat(F.lit("fact:"), F.col("root")).alias("fact_id")), "claim_id").withColumn("declared", F.lit(False))
    trust = F.when(F.col("source_class") == "DOCUMENTARY", 0.85).when(F.col("source_class") == "SELF", 0.5).otherwise(0.6)
    att = c.groupBy("attestor_key").agg(F.max(trust).alias("trust_prior")).withColumn("trust", F.col("trust_prior"))
    scores = scoring.score(at, f, att, edges, P)["claims"]
    own = at.select("subject_id", "claim_id", "fact_id", "attestor_key")
    out = publish.claim_blocks(own, f, scores, publish.edge_counts(own, edges))
    return out.select("claim_id", r6("score", "score"), "fact_stamp.fact_id", "fact_stamp.fact_kind", "fact_stamp.member_count", "edge_counts.corroborates", "edge_counts.contradicts", "attestor_key")


@query("SELECT o_custkey AS job_id, arg_min(concat('p', o_orderkey), (o_orderstatus <> 'F', o_orderkey % 3 <> 0, -(o_orderkey % 7), -epoch_us(o_orderdate::timestamp), concat('p', o_orderkey))) AS path FROM orders GROUP BY 1")
def best_checkpoints(spark, sf_dir):
    k = F.col("o_orderkey")
    c = rows(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.concat(F.lit("p"), k.cast("string")).alias("path"), (F.col("o_orderstatus") == "F").alias("is_final"), (k % 3).alias("node"), (k % 7).alias("depth"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return publish.best_checkpoint(c)


@query(o.q(JUDGED_CTE, "SELECT a, b, concat(max(votes), '/', sum(votes)) AS summary FROM by_rel GROUP BY 1, 2"))
def vote_summaries(spark, sf_dir):
    return _verdicts(spark, sf_dir, "votes").select("a", "b", publish.vote_summary(F.to_json("votes")).alias("summary"))


@query(f"""SELECT s AS subject_id, concat('[', array_to_string(list_concat(list_concat(CASE WHEN len(pend) > 0 THEN ['pending_consent:' || array_to_string(pend, ',')] ELSE [] END, CASE WHEN len(miss) > 0 THEN ['not_stored:' || array_to_string(miss, ',')] ELSE [] END), coalesce(same, [])), ', '), ']') AS blockers FROM
  (SELECT p_size AS s, list_sort(coalesce(list(a) FILTER (k % 3 = 0), [])) AS pend, list_sort(coalesce(list(a) FILTER (k % 4 = 1 AND k % 5 <> 2 AND k % 3 <> 2), [])) AS miss FROM (SELECT p_size, p_partkey AS k, lpad(p_partkey::varchar, 7, '0') AS a FROM part) GROUP BY 1)
  LEFT JOIN (SELECT s, list_sort(list('same_bytes:' || ids)) AS same FROM (SELECT p_size AS s, p_brand, string_agg(lpad(p_partkey::varchar, 7, '0'), ',' ORDER BY lpad(p_partkey::varchar, 7, '0')) AS ids FROM part WHERE p_partkey % 4 <> 1 GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) USING (s)""")
def seal_blockers(spark, sf_dir):
    k = F.col("p_partkey")
    a = rows(spark, sf_dir, "part").select(F.col("p_size").alias("subject_id"), F.lpad(k.cast("string"), 7, "0").alias("asset_id"), when(k, "AUDIO", "TEXT", "LINK", "VIDEO", "TEXT").alias("modality"), when(k, "PENDING", "GRANTED", "REVOKED").alias("consent"), when(k, "STORED", "FAILED", "STORED", "STORED").alias("status"), F.col("p_brand").alias("checksum"))
    return publish.seal_blockers(a).select("subject_id", F.concat(F.lit("["), F.array_join("blockers", ", "), F.lit("]")).alias("blockers"))


@query(f"""SELECT c_custkey AS subject_id, array_to_string(list_filter([CASE WHEN c_custkey % 6 = 1 THEN 'country' END, CASE WHEN c_custkey % 5 = 1 THEN 'currency' END, CASE WHEN c_custkey % 4 = 1 THEN 'time_zone' END, CASE WHEN c_custkey % 7 = 1 THEN 'language' END, CASE WHEN c_custkey % 3 = 1 THEN 'market_region' END,
  CASE WHEN c_custkey % 8 = 1 THEN 'knowledge_as_of' END, CASE WHEN c_custkey % 9 = 1 THEN 'target_roles' END, CASE WHEN c_custkey % 10 IN (1, 2) THEN 'contact' END], lambda x: x IS NOT NULL), ',') AS errors FROM customer""")
def profile_errors(spark, sf_dir):
    k = F.col("c_custkey")
    known = spark.createDataFrame([("country", "IN"), ("country", "DE"), ("currency", "EUR"), ("time_zone", "Europe/Berlin")], "kind string, code string")
    bad = lambda n, good, wrong: F.when(k % n == 1, wrong).when(k % n == 2, " ").otherwise(good)
    c = rows(spark, sf_dir, "customer").select(
        k.alias("subject_id"), bad(6, "de", "XX").alias("country"), bad(5, "eur", "EURO").alias("currency"), bad(4, "Europe/Berlin", "europe/berlin").alias("time_zone"), bad(7, "pt-BR", "x y").alias("language"), bad(3, "Asia-Pacific (APAC)", "{{locale}}").alias("market_region"), bad(8, "2025-03-01", "2025-02-31").alias("knowledge_as_of"),
        F.array(bad(9, "Engineer", "two\nlines")).alias("target_roles"), F.array(F.lit("Fine.")).alias("aspirations"), F.array(F.struct(bad(10, "email", "fax").alias("kind"), F.lit("a@b.example").alias("value"))).alias("contact"),
    )
    return publish.profile_errors(known, c).select("subject_id", F.array_join("errors", ",").alias("errors"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text || ' [c1] x (D9) , [sic] [F12]  .' || chr(10) || chr(8220) || ' said ' || chr(8221), '[c1]', ''), '[ab]', ''), '[\[(](S4-)?[CDEF]\d{1,2}[\])]', '', 'g'), ' {2,}', ' ', 'g'), ' +([.,;:!?])', '\1', 'g'),
  '([' || chr(8220) || chr(8216) || ']) +', '\1', 'g'), ' +([' || chr(8221) || chr(8217) || '])', '\1', 'g')) AS t FROM documents""")
def scrubbed_texts(spark, sf_dir):
    said = F.concat("text", F.lit(" [c1] x (D9) , [sic] [F12]  .\n“ said ”"))
    return rows(spark, sf_dir, "documents").select("doc_id", publish.scrubbed(said, F.array(F.lit("c1"), F.lit("ab"), F.lit(" "))).alias("t"))


# --- bookkeeping


@query("SELECT o_orderkey AS example_id, o_custkey % 4 AS turns_hash, CASE WHEN o_custkey % 4 < 3 THEN arg_max(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) END AS verdict FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, o_custkey")
def latest_judgments(spark, sf_dir):
    e = rows(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), (F.col("o_custkey") % 4).alias("turns_hash"))
    j = rows(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example_id"), F.col("l_returnflag").alias("verdict"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("judgment_id")).join(e.where("turns_hash < 3"), "example_id")
    return lifecycle.latest_judgments(e, j).select("example_id", "turns_hash", "verdict")


@query("SELECT count(*) FILTER (o_orderkey % 4 = 0) AS approved, count(*) FILTER (o_orderkey % 4 = 1) AS not_pass, count(*) FILTER (o_orderkey % 4 = 3) AS unjudged, count(*) FILTER (o_orderkey % 4 = 2) AS sent_back FROM orders")
def bulk_outcomes(spark, sf_dir):
    return lifecycle.bulk_outcomes(rows(spark, sf_dir, "orders").select(when(F.col("o_orderkey"), "PASS", "BORDERLINE", "FAIL", None).alias("verdict")))


@query(f"SELECT o_orderkey, CASE WHEN a = 'SUBMIT' AND s IN ('DRAFT', 'NEEDS_CHANGES') THEN 'SUBMITTED' WHEN a = 'APPROVE' AND s = 'SUBMITTED' THEN 'APPROVED' WHEN a = 'REQUEST_CHANGES' AND s = 'SUBMITTED' THEN 'NEEDS_CHANGES' WHEN a = 'ARCHIVE' AND s <> 'ARCHIVED' THEN 'ARCHIVED' END AS next FROM (SELECT o_orderkey, {sql_when('o_orderkey', 'DRAFT', 'SUBMITTED', 'APPROVED', 'NEEDS_CHANGES', 'ARCHIVED')} AS s, {sql_when('o_custkey', 'SUBMIT', 'APPROVE', 'REQUEST_CHANGES', 'ARCHIVE')} AS a FROM orders)")
def status_transitions(spark, sf_dir):
    t = rows(spark, sf_dir, "orders").select("o_orderkey", when(F.col("o_orderkey"), "DRAFT", "SUBMITTED", "APPROVED", "NEEDS_CHANGES", "ARCHIVED").alias("s"), when(F.col("o_custkey"), "SUBMIT", "APPROVE", "REQUEST_CHANGES", "ARCHIVE").alias("a"))
    return t.select("o_orderkey", lifecycle.next_status("s", "a").alias("next"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'STORED' WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'FAILED' WHEN o_orderkey % 3 = 0 THEN 'STORED' WHEN o_orderdate < DATE '1995-01-01' THEN 'FAILED' ELSE 'PENDING' END AS status FROM orders")
def upload_outcomes(spark, sf_dir):
    k = F.col("o_orderkey")
    t = rows(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, "STORED").otherwise("PENDING").alias("status"), F.when(k % 3 == 0, F.when(F.col("o_custkey") % 2 == 0, 2000).otherwise(10)).alias("found_bytes"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return t.select("o_orderkey", lifecycle.upload_outcome(1000, 24, F.lit("1995-01-02").cast("timestamp")).alias("status"))


@query("SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 5 = 0 THEN 'SPEAKER_HELP' WHEN c_custkey % 3 = 0 THEN 'CLAIMS_READY' ELSE 'QUESTIONS' END AS digest FROM customer WHERE (c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_custkey % 2 = 0) AND c_custkey % 7 <> 0")
def daily_digests(spark, sf_dir):
    k = F.col("c_custkey")
    s = rows(spark, sf_dir, "customer").select(k.alias("subject_id"), F.lit("d1").alias("day"), (k % 5 == 0).cast("int").alias("parked"), (k % 3 == 0).cast("int").alias("ready"), (k % 2 == 0).cast("int").alias("open_questions"))
    return lifecycle.digests(s, s.where("subject_id % 7 = 0")).select("subject_id", "digest")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def pending_plans(spark, sf_dir):
    plans = rows(spark, sf_dir, "orders").select("o_orderkey", F.lit("h").alias("hash"))
    live = rows(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("h").alias("hash"))
    return lifecycle.pending(plans, live, ("o_orderkey", "hash")).select("o_orderkey")


VERSIONS = "vs AS (SELECT p_brand AS family, CASE WHEN p_partkey % 10 = 0 THEN 'latest' ELSE concat('v', p_size % 3, '.', p_size) END AS version, p_size % 3 AS a, p_size AS b, p_partkey % 10 <> 0 AS ok FROM part)"


def _versions(spark, sf_dir):
    s = F.col("p_size")
    return rows(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.when(F.col("p_partkey") % 10 == 0, "latest").otherwise(F.concat(F.lit("v"), (s % 3).cast("string"), F.lit("."), s.cast("string"))).alias("version"))


@query(o.q(VERSIONS, "SELECT family, a AS major, max(b) + 1 AS minor, concat('v', a, '.', max(b) + 1) AS next_version FROM vs WHERE ok GROUP BY 1, 2"))
def next_versions(spark, sf_dir):
    return lifecycle.next_versions(_versions(spark, sf_dir))


@query(o.q(VERSIONS, "SELECT family, row_number() OVER (PARTITION BY family ORDER BY a NULLS FIRST, b NULLS FIRST, version) AS place, version FROM (SELECT DISTINCT family, version, CASE WHEN ok THEN a END AS a, CASE WHEN ok THEN b END AS b FROM vs)"))
def version_lineages(spark, sf_dir):
    return views.lineages(_versions(spark, sf_dir).distinct())


RUN = ("PENDING", "SYNCING", "MATCHING", "AWAITING_REVIEW", "PUBLISHED", "FAILED", "SCORING")


@query(f"""SELECT k::varchar AS run_id, CASE WHEN lost THEN 'FAILED' WHEN s = 'PENDING' THEN 'SYNCING' WHEN NOT parked AND k % 2 = 0 THEN CASE s WHEN 'SYNCING' THEN 'RESOLVING_ENTITIES' WHEN 'MATCHING' THEN 'JUDGING' WHEN 'SCORING' THEN 'AWAITING_REVIEW' END ELSE s END AS status, CASE WHEN lost THEN s END AS failed_phase FROM
  (SELECT *, NOT parked AND ((s <> 'PENDING' AND k % 5 = 0) OR k % 11 = 0) AS lost FROM (SELECT o_orderkey AS k, {sql_when('o_orderkey', *RUN)} AS s, {sql_when('o_orderkey', *RUN)} IN ('AWAITING_REVIEW', 'PUBLISHED', 'FAILED') AS parked FROM orders))""")
def polled_runs(spark, sf_dir):
    k = F.col("o_orderkey")
    r = rows(spark, sf_dir, "orders").select(k.cast("string").alias("run_id"), when(k, *RUN).alias("status"), F.when(k % 5 == 0, today() - F.make_interval(hours=F.lit(1))).otherwise(today()).alias("phase_since"), F.lit(None).cast("string").alias("failed_phase"), (k % 2 == 0).alias("phase_done"), (k % 11 == 0).alias("phase_failed"))
    return lifecycle.polled(r, today()).select("run_id", "status", "failed_phase")


@query(f"""WITH r AS (SELECT c_custkey AS k, {sql_when('c_custkey', *RUN)} AS s, {sql_when('c_custkey', 'RETRY', 'PUBLISH', 'RERUN', None)} AS a FROM customer), t AS (SELECT *, CASE a WHEN 'RETRY' THEN s = 'FAILED' WHEN 'PUBLISH' THEN s = 'AWAITING_REVIEW' WHEN 'RERUN' THEN s IN ('PUBLISHED', 'AWAITING_REVIEW') END AS ok FROM r)
  SELECT k::varchar AS run_id, CASE WHEN ok THEN CASE WHEN a = 'RETRY' THEN 'JUDGING' WHEN a = 'PUBLISH' THEN 'PUBLISHING' WHEN s = 'AWAITING_REVIEW' THEN 'SUPERSEDED' ELSE s END ELSE s END AS status, ok AS accepted FROM t UNION ALL SELECT concat(k, '+'), 'PENDING', NULL FROM t WHERE ok AND a = 'RERUN'""")
def acted_runs(spark, sf_dir):
    k = F.col("c_custkey")
    r = rows(spark, sf_dir, "customer").select(k.cast("string").alias("run_id"), k.alias("subject_id"), when(k, *RUN).alias("status"), F.lit("JUDGING").alias("failed_phase"), when(k, "RETRY", "PUBLISH", "RERUN", None).alias("action"))
    return lifecycle.acted(r.drop("action"), r.where("action IS NOT NULL").select("run_id", "action"), today()).select("run_id", "status", "accepted")


ACTION = "('0x' || substr(sha256(concat(from_fact, to_fact)), 1, 2))::int % 3"


@query(o.q(EDGE_CTE, f"""SELECT subject_id, from_fact, to_fact, relation, CASE WHEN relation <> 'CONTRADICTS' THEN NULL WHEN {ACTION} = 0 THEN 'CONFIRMED' ELSE 'PROPOSED' END AS review_status, CASE WHEN relation = 'CONTRADICTS' AND {ACTION} = 2 THEN true ELSE explained END AS explained,
  CASE WHEN relation = 'CONTRADICTS' AND {ACTION} = 2 THEN 'NEUTRAL' ELSE ctx_relation END AS ctx_relation FROM edges WHERE relation <> 'CONTRADICTS' OR {ACTION} <> 1"""))
def contradiction_actions(spark, sf_dir):
    edges = _edges(spark, sf_dir, only=(*COUNTED, "ctx_relation", "ctx_confidence", "contributing_pairs"))[2]
    edges, rest = edges.where("relation = 'CONTRADICTS'"), edges.where("relation <> 'CONTRADICTS'")
    against = edges
    n = F.conv(F.substring(F.sha2(F.concat("from_fact", "to_fact"), 256), 1, 2), 16, 10).cast("int")
    actions = against.select("subject_id", "from_fact", "to_fact", when(n, "CONFIRM", "DISMISS", "REJUDGE").alias("action"))
    pair = F.split("p", "↔")
    again = against.select(F.explode("contributing_pairs").alias("p")).select(pair[0].alias("a"), pair[1].alias("b"), F.lit(0.9).alias("confidence"), F.lit("NEUTRAL").alias("ctx_relation"), F.lit(0.4).alias("ctx_confidence"), F.lit(True).alias("explanation_relevant")).distinct()
    kept, _ = lifecycle.settled_contradictions(edges, actions, again)
    # actions are on contradictions only, the other edges pass by
    return kept.unionByName(rest).select("subject_id", "from_fact", "to_fact", "relation", "review_status", "explained", "ctx_relation")


LOOK = "('0x' || substr(sha256(concat(a, b)), 1, 2))::int"


@query(o.q(JUDGED_CTE, f"SELECT a, b, CASE WHEN {LOOK} % 3 = 0 OR {LOOK} % 3 = 1 AND {LOOK} % 2 = 0 THEN 'ESCALATED' ELSE 'JUDGED' END AS status, CASE WHEN {LOOK} % 3 = 2 OR {LOOK} % 3 = 1 AND {LOOK} % 2 = 1 THEN relation END AS relation FROM verdicts"))
def verdict_lookup(spark, sf_dir):
    v = save(_verdicts(spark, sf_dir, "relation", "confidence"), "verdicts")
    n = F.conv(F.substring(F.sha2(F.concat("a", "b"), 256), 1, 2), 16, 10).cast("int")
    rows_ = v.withColumn("n", n)
    queue = rows_.select("a", "b", (F.col("n") % 2 == 0).alias("with_context"))
    known = rows_.where("n % 3 > 0").select("a", "b", F.when(F.col("n") % 3 == 1, False).otherwise(F.col("n") % 2 == 0).alias("with_context"), "relation", "confidence")
    return lifecycle.looked_up(queue, known).select("a", "b", "status", "relation")


@query("""SELECT 'REPAIR' AS action, c_custkey AS subject_id, concat('d', c_custkey) AS deployment_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0 UNION ALL SELECT 'TEAR_DOWN', NULL, concat('d', c_custkey) FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 = 1 AND c_custkey % 5 <> 0""")
def deployment_sweep(spark, sf_dir):
    k = F.col("c_custkey")
    c = rows(spark, sf_dir, "customer").select(k.alias("subject_id"), when(k, "LIVE", "IDLE", "STARTING").alias("state"), F.concat(F.lit("d"), k.cast("string")).alias("deployment_id"), (k % 3 != 1).alias("occupying"))
    return lifecycle.swept(c, c.where("subject_id % 5 = 0").select("deployment_id"), c.where("subject_id % 4 = 0").select("deployment_id"))


DECL = """pf AS (SELECT c_custkey AS s, c_mktsegment AS seg FROM customer), dc AS (SELECT s, 'IDENTITY' AS claim_type, 'TARGET_ROLE' AS declared_type, concat('Target role: ', seg, '.') AS text, false AS sensitive FROM pf UNION ALL SELECT s, 'IDENTITY', 'TARGET_SENIORITY', 'Targeting senior-level roles.', false FROM pf WHERE s % 3 = 0
  UNION ALL SELECT s, 'VALUE', 'STATED_ASPIRATION', concat('I want to lead ', seg), false FROM pf UNION ALL SELECT s, 'WEAKNESS', 'BOUNDARY', 'Prefers not to discuss health.', false FROM pf WHERE s % 2 = 0
  UNION ALL SELECT s, 'IDENTITY', 'RELOCATION_STANCE', CASE WHEN s % 4 = 0 THEN 'Open to relocating for the right role.' ELSE 'Not looking to relocate.' END, false FROM pf WHERE s % 4 < 2 UNION ALL SELECT s, 'IDENTITY', 'CONTACT_EMAIL', 'Email: a@b.example', true FROM pf WHERE s % 5 = 0),
di AS (SELECT *, concat('decl-', substr(sha256(concat_ws('|', s, declared_type, trim(text))), 1, 24)) AS claim_id FROM dc)"""


def _profiles(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    return rows(spark, sf_dir, "customer").select(
        k.alias("subject_id"), F.array("c_mktsegment", F.lit(" ")).alias("target_roles"), F.when(k % 3 == 0, "senior").alias("target_seniority"), F.array(F.concat(F.lit("I want to lead "), "c_mktsegment")).alias("aspirations"), none.alias("stated_preferences"),
        F.when(k % 2 == 0, F.array(F.lit("Health."))).otherwise(none).alias("do_not_discuss"), F.when(k % 4 < 2, k % 4 == 0).alias("open_to_relocation"), F.array(F.struct(F.lit("email").alias("kind"), F.lit("a@b.example").alias("value"), (k % 5 == 0).alias("shareable"))).alias("contact"),
    )


@query(o.q(DECL, "SELECT s AS subject_id, claim_id, claim_type, declared_type, text, sensitive FROM di"))
def declared_claims(spark, sf_dir):
    return lifecycle.declared_claims(_profiles(spark, sf_dir))


@query(o.q(DECL, "SELECT claim_id, CASE WHEN s % 7 = 0 THEN 'CREATE' ELSE 'KEEP' END AS action FROM di UNION ALL SELECT concat('decl-old', s), 'DELETE' FROM pf WHERE s % 6 = 0"))
def materialised_claims(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    had = lifecycle.declared_claims(p.where("subject_id % 7 <> 0")).select("claim_id")
    old = p.where("subject_id % 6 = 0").select(F.concat(F.lit("decl-old"), F.col("subject_id").cast("string")).alias("claim_id"))
    return lifecycle.materialised(p, had.unionByName(old), had.where("claim_id < 'decl-8'"))[0]


@query(o.q(DECL, "SELECT claim_id, s AS subject_id, 'INCLUDE' AS pii_choice FROM di WHERE sensitive AND NOT (s % 7 <> 0 AND claim_id < 'decl-8')"))
def declared_opt_ins(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    had = lifecycle.declared_claims(p.where("subject_id % 7 <> 0")).select("claim_id")
    return lifecycle.materialised(p, had, had.where("claim_id < 'decl-8'"))[1]


QN = f"qn AS (SELECT doc_id AS k, claim_id, {sql_when('doc_id', 'OPEN', 'ANSWERED', 'SKIPPED')} AS s, {sql_when('q', 'ANSWER', 'SKIP', 'REOPEN', None)} AS a, q % 8 = 0 AS wordless FROM claims), qm AS (SELECT *, CASE WHEN a IS NOT NULL THEN (s = 'OPEN' AND (a = 'SKIP' OR (a = 'ANSWER' AND NOT wordless))) OR (s = 'SKIPPED' AND a = 'REOPEN') END AS ok FROM qn)"


def _moved(spark, sf_dir):
    c = fx.claims(spark, sf_dir).withColumn("action", when(F.col("q"), "ANSWER", "SKIP", "REOPEN", None))
    questions = c.select(F.col("doc_id").alias("question_id"), "subject_id", when(F.col("doc_id"), "OPEN", "ANSWERED", "SKIPPED").alias("status"), F.lit(None).cast("string").alias("answer"), F.array("claim_id").alias("claim_ids"))
    actions = c.where("action IS NOT NULL").select(F.col("doc_id").alias("question_id"), "action", F.when(F.col("q") % 8 == 0, " ").otherwise(F.concat(F.lit(" said "), F.col("doc_id").cast("string"), F.lit(" "))).alias("answer_text"))
    return c, lifecycle.moved_questions(questions, actions)


@query(o.q(o.CLAIMS + ",\n" + QN, "SELECT k AS question_id, CASE WHEN ok THEN CASE a WHEN 'ANSWER' THEN 'ANSWERED' WHEN 'SKIP' THEN 'SKIPPED' ELSE 'OPEN' END ELSE s END AS status, CASE WHEN ok AND a = 'ANSWER' THEN concat('said ', k) END AS answer, ok AS accepted FROM qm"))
def moved_questions(spark, sf_dir):
    return _moved(spark, sf_dir)[1].select("question_id", "status", "answer", "accepted")


@query(o.q(o.CLAIMS + ",\n" + QN, "SELECT claim_id, CASE WHEN ok AND a = 'ANSWER' THEN 'SIDECARED' ELSE decision END AS decision, pii_choice, CASE WHEN ok AND a = 'ANSWER' THEN concat('said ', k) END AS justification FROM qm FULL JOIN reviews USING (claim_id) WHERE decision IS NOT NULL OR (ok AND a = 'ANSWER')"))
def answered_reviews(spark, sf_dir):
    c, moved = _moved(spark, sf_dir)
    return lifecycle.answered_reviews(moved, fx.reviews(c))


# --- limits


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'NEW' WHEN ts > TIMESTAMP '2024-01-10' THEN 'ACTIVE' ELSE 'EXPIRED' END AS chip FROM events")
def session_chips(spark, sf_dir):
    e = rows(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp") - F.make_interval(mins=F.lit(60))).alias("redeemed"))
    return e.select("event_id", limits.session_chip("ts", "redeemed", F.lit("2024-01-10").cast("timestamp"), P).alias("chip"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'REVOKED' WHEN event_id % 5 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'ACTIVE' ELSE 'USED' END WHEN event_id % 3 = 0 THEN 'EMAIL_FAILED' ELSE 'UNREDEEMED' END AS chip FROM events")
def token_chips(spark, sf_dir):
    k = F.col("event_id")
    e = rows(spark, sf_dir, "events").select("event_id", when(k, "REVOKED", "REDEEMED", "UNREDEEMED", "UNREDEEMED", "UNREDEEMED").alias("status"), F.when(k % 2 == 0, today() + F.make_interval(hours=F.lit(1))).when(k % 4 == 1, today()).alias("ends"), F.when(k % 3 == 0, "FAILED").alias("mail"))
    return e.select("event_id", limits.token_chip("status", "ends", "mail", today()).alias("chip"))


@query(o.q("""RECURSE AS (SELECT 1), ev AS (SELECT user_id::varchar AS owner, event_id, event_id % 3 = 0 AS redeem, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
oc AS (SELECT owner, 0::bigint AS n, NULL::bigint AS event_id, 0::bigint AS held, true AS ok FROM (SELECT DISTINCT owner FROM ev) UNION ALL SELECT oc.owner, ev.n, ev.event_id, CASE WHEN redeem THEN greatest(0, held - 1) WHEN held < 2 THEN held + 1 ELSE held END, redeem OR held < 2 FROM oc JOIN ev ON ev.owner = oc.owner AND ev.n = oc.n + 1)""", "SELECT owner, event_id, ok AS allowed FROM oc WHERE n > 0"))
def outstanding_codes(spark, sf_dir):
    e = rows(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("owner"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("ts"), F.when(F.col("event_id") % 3 == 0, "REDEEM").otherwise("ISSUE").alias("kind"))
    return limits.outstanding_capped(e, 2)


@query("""SELECT place, occupant, holds FROM (SELECT l_suppkey AS place, l_orderkey * 10 + l_linenumber AS occupant, l_shipdate AS s, max((l_receiptdate, l_orderkey * 10 + l_linenumber)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, m[1] AS until, m[2] AS holds FROM (SELECT *, l_shipdate + INTERVAL 7 DAY AS l_receiptdate FROM lineitem)) WHERE until > s""")
def double_occupancy(spark, sf_dir):
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occupant")
    start = F.col("l_shipdate").cast("timestamp")
    return limits.overlapping(rows(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("place"), k, start.alias("start"), (start + F.make_interval(days=F.lit(7))).alias("end"))).select("place", "occupant", "holds")


# --- functions


@query("SELECT doc_id, sha256(from_hex('{opad}') || from_hex(sha256(from_hex('{ipad}') || encode(source)))) AS h FROM documents".replace("{opad}", bytes(b ^ 0x5C for b in b"key".ljust(64, b"\0")).hex()).replace("{ipad}", bytes(b ^ 0x36 for b in b"key".ljust(64, b"\0")).hex()))
def keyed_hashes(spark, sf_dir):
    return rows(spark, sf_dir, "documents").select("doc_id", keyed_hash("source", "key").alias("h"))


@query("SELECT c_custkey, sha256(concat('a=', c_name, chr(10), 'b=', chr(10), 'c=', c_mktsegment)) AS h FROM customer")
def persona_hashes(spark, sf_dir):
    return rows(spark, sf_dir, "customer").select("c_custkey", map_hash(F.create_map(F.lit("c"), F.col("c_mktsegment"), F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.col("c_name"))).alias("h"))


@query(o.q(TURNS, "SELECT conv_id, substr(sha256(string_agg(concat_ws('|', CASE WHEN role = 'user' THEN 'USER' ELSE 'MODEL' END, 'TEXT', text), chr(10) ORDER BY i)), 1, 12) AS h FROM tu GROUP BY 1"))
def turn_hashes(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", turns_hash("turns").alias("h"))


@query("SELECT doc_id, CASE WHEN length(text) > 30 THEN concat(substr(text, 1, 30), '…') ELSE text END AS t FROM documents")
def ellipses(spark, sf_dir):
    return rows(spark, sf_dir, "documents").select("doc_id", ellipsis("text", 30).alias("t"))


@query("SELECT c_custkey, concat('Hi ', c_name, ', ', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, '. {{no}}') AS t FROM customer")
def rendered_templates(spark, sf_dir):
    return rows(spark, sf_dir, "customer").select("c_custkey", rendered(F.lit("Hi {{name}}, {{what}}. {{no}}"), {"name": F.col("c_name"), "what": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))}).alias("t"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('- Keep ', c_mktsegment, '. And this!') ELSE concat('- Keep ', c_mktsegment, '. Mail me now. And this!') END AS t FROM customer")
def dropped_sentences(spark, sf_dir):
    said = F.concat(F.lit("- Keep "), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit(". Mail {{email}} now. And this!\nWhole {{email}} line")).otherwise(F.lit(". Mail me now. And this!")))
    return rows(spark, sf_dir, "customer").select("c_custkey", without_sentences(said, "{{email}}").alias("t"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity END AS s FROM lineitem")
def durations(spark, sf_dir):
    q = F.col("l_quantity").cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit("s"))).when(F.col("l_linenumber") % 3 == 1, q).otherwise("soon")
    return rows(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tables.seconds(said).alias("s"))


@query(f"SELECT o_orderkey, {sql_when('o_orderkey', 'OBJECT', 'ARRAY', 'SCALAR', None, 'OBJECT')} AS kind, o_orderkey % 5 <> 3 AS valid, CASE WHEN o_orderkey % 5 IN (0, 4) THEN concat('{{\"a\":', o_custkey, '}}') END AS inner_object, CASE WHEN o_orderkey % 5 = 1 THEN 2 END AS n_rows FROM orders")
def json_checks(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    obj = F.concat(F.lit('{"a":'), c, F.lit("}"))
    said = F.when(k % 5 == 0, obj).when(k % 5 == 1, F.concat(F.lit('[{"a": 1},{"a":'), c, F.lit("}]"))).when(k % 5 == 2, c).when(k % 5 == 3, F.lit("{")).otherwise(F.concat(F.lit(" "), obj, F.lit(" ")))
    t = rows(spark, sf_dir, "orders").select("o_orderkey", said.alias("t"))
    fenced = jsonio.parsed_rows(F.concat(F.lit("```json\n"), F.regexp_replace("t", r"\]$", ',{"a":'), F.lit("\n```")), "struct<a:long>")
    return t.select("o_orderkey", jsonio.kind("t").alias("kind"), jsonio.is_valid("t").alias("valid"), F.when(k % 5 != 1, jsonio.outermost_object("t")).alias("inner_object"), F.when(k % 5 == 1, F.size(fenced)).alias("n_rows"))


@query(o.q(o.CLAIMS + ",\n" + o.PRIORS, "SELECT claim_id, floor(prior * 100 + 0.5)::int AS shown FROM pri"))
def displayed_scores(spark, sf_dir):
    return fx.claims(spark, sf_dir).select("claim_id", maths.display(maths.claim_prior(P)).alias("shown"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + INTERVAL 1 DAY WHEN 1 THEN o_orderdate + INTERVAL 3 DAY WHEN 2 THEN o_orderdate + INTERVAL 7 DAY END AS ends FROM orders")
def window_ends(spark, sf_dir):
    return rows(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"), when(F.col("o_orderkey"), "D1", "D3", "W1", "Y1").alias("preset")).select("o_orderkey", views.window_end("at", "preset").cast("timestamp_ntz").alias("ends"))


@query(o.q(o.CLAIMS + ",\n" + o.PRIORS, """SELECT claim_id, concat('[', claim_id, '] "', lang, '" — score ', printf('%.2f', round(prior, 6)), ' (', tier_seed, ')', CASE WHEN q % 5 = 2 THEN '; explanation on record: "told"' ELSE '' END, CASE WHEN claimed_date IS NOT NULL THEN concat('; dated ', claimed_date, ' (', CASE WHEN length(claimed_date) <= 4 THEN 'YEAR' WHEN length(claimed_date) <= 7 THEN 'MONTH' ELSE 'DAY' END, ' precision — never voice finer)') ELSE '' END) AS line FROM pri"""))
def evidence_lines(spark, sf_dir):
    from evidentia.functions.dates import precision

    c = fx.claims(spark, sf_dir)
    return c.select("claim_id", planning.evidence_line(F.col("claim_id"), F.col("lang"), F.round(maths.claim_prior(P), 6), F.col("tier_seed"), F.when(F.col("explained"), "told"), F.col("claimed_date"), F.col("claimed_date"), precision(F.length("claimed_date"))).alias("line"))


# --- views


SHOWN = "ex AS (SELECT o_orderkey AS example_id, CASE o_orderkey % 5 WHEN 0 THEN 'ARCHIVED' WHEN 1 THEN 'APPROVED' ELSE 'DRAFT' END AS status, CASE o_custkey % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'BORDERLINE' WHEN 2 THEN 'PASS' END AS verdict, o_custkey AS s, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS old FROM orders)"


@query(o.q(SHOWN, "SELECT 'all' AS facet, example_id, coalesce(list_position(['FAIL', 'BORDERLINE', 'PASS'], verdict), 4) - 1 AS need FROM ex WHERE status <> 'ARCHIVED' AND NOT old UNION ALL SELECT 'ARCHIVED', example_id, coalesce(list_position(['FAIL', 'BORDERLINE', 'PASS'], verdict), 4) - 1 FROM ex WHERE status = 'ARCHIVED' UNION ALL SELECT 'stale', example_id, coalesce(list_position(['FAIL', 'BORDERLINE', 'PASS'], verdict), 4) - 1 FROM ex WHERE old UNION ALL SELECT 'DRAFT', example_id, coalesce(list_position(['FAIL', 'BORDERLINE', 'PASS'], verdict), 4) - 1 FROM ex WHERE status = 'DRAFT' AND NOT old"))
def list_facets(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ex = rows(spark, sf_dir, "orders").select(k.alias("example_id"), F.when(k % 5 == 0, "ARCHIVED").when(k % 5 == 1, "APPROVED").otherwise("DRAFT").alias("status"), when(c, "FAIL", "BORDERLINE", "PASS", None).alias("verdict"), F.col("o_orderdate").alias("updated_at"), c.alias("subject_id"), F.when(k % 3 == 0, "r0").otherwise("r1").alias("score_run_id"), F.lit("p").alias("persona_hash"))
    now = rows(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject_id"), F.lit("r1").alias("score_run_id"), F.lit("p").alias("persona_hash"))
    facet = lambda name, **of: views.visible_examples(ex, now, **of).select(F.lit(name).alias("facet"), "example_id", "need")
    return facet("all").unionByName(facet("ARCHIVED", status="ARCHIVED")).unionByName(facet("stale", stale=True)).unionByName(facet("DRAFT", status="DRAFT"))


AGG = """ra AS (SELECT subject_id, concat('f', q // 3) AS fact_id, claim_id, CASE WHEN q % 4 > 0 THEN prior END AS score, CASE WHEN q % 3 = 0 THEN concat('S', q % 2) END AS slot, CASE WHEN q % 5 > 1 THEN prior * 0.9 END AS belief, CASE WHEN q % 3 = 1 THEN 0.5 END AS independence, source_class, q % 7 = 0 AS anchored, q % 9 = 0 AS corroborated FROM pri)"""


@query(o.q(",\n".join((o.CLAIMS, o.PRIORS, AGG)), """SELECT subject_id, fact_id, count(*) AS claim_count, arg_min(slot, (-coalesce(score, -1), claim_id)) FILTER (slot IS NOT NULL) AS slot, round(coalesce(arg_min(belief, (-coalesce(score, -1), claim_id)) FILTER (belief IS NOT NULL), max(score)), 6) AS belief,
  coalesce(arg_min(independence, (-coalesce(score, -1), claim_id)) FILTER (independence IS NOT NULL), 1) AS independence, bool_and(source_class = 'SELF') AND NOT bool_or(corroborated) AS self_only, bool_or(anchored OR source_class = 'DOCUMENTARY') AS documentary FROM ra GROUP BY 1, 2"""))
def fact_aggregates(spark, sf_dir):
    q = F.col("q")
    prior = maths.claim_prior(P)
    c = fx.claims(spark, sf_dir).select(
        "subject_id", F.concat(F.lit("f"), F.floor(q / 3).cast("string")).alias("fact_id"), "claim_id", F.when(q % 4 > 0, prior).alias("score"), F.when(q % 3 == 0, F.concat(F.lit("S"), (q % 2).cast("string"))).alias("slot"), F.when(q % 5 > 1, prior * 0.9).alias("belief"), F.lit(None).cast("double").alias("belief_bare"),
        F.when(q % 3 == 1, 0.5).alias("independence"), F.lit(None).cast("double").alias("evidence_mass"), "source_class", (q % 7 == 0).alias("anchored"), (q % 9 == 0).alias("corroborated"),
    )
    out = views.fact_aggregates(c)
    return out.select("subject_id", "fact_id", "claim_count", "slot", r6("belief", "belief"), "independence", "self_only", "documentary")


SIDES = "sd AS (SELECT subject_id, from_fact AS f, to_fact AS t, relation, confidence, explained FROM edges UNION ALL SELECT subject_id, to_fact, from_fact, relation, confidence / 2, NOT explained FROM edges)"


def _sides(spark, sf_dir):
    e = _edges(spark, sf_dir)[2]
    way = lambda a, b, c, x: e.select("subject_id", F.col(a).alias("fact_id"), F.lit(0).alias("place"), F.col(b).alias("other"), "relation", c.alias("confidence"), x.alias("explained"))
    return views.edge_aggregates(way("from_fact", "to_fact", F.col("confidence"), F.col("explained")).unionByName(way("to_fact", "from_fact", F.col("confidence") / 2, ~F.col("explained"))))


@query(o.q(EDGE_CTE, "SELECT subject_id, concat(from_fact, '↔', to_fact) AS pair_key, relation, from_fact, to_fact, round(confidence, 6) AS confidence, explained FROM edges"))
def edge_aggregates(spark, sf_dir):
    return _sides(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(o.q(EDGE_CTE, "SELECT subject_id, place, concat(from_fact, '↔', to_fact) AS pair_key, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, concat(from_fact, '↔', to_fact)) AS place FROM edges WHERE relation = 'CONTRADICTS') WHERE place <= 5"))
def top_contradictions(spark, sf_dir):
    return views.top_contradictions(_sides(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(o.q(FACT_CTE + ",\n" + ",\n".join((o.SAMPLES, o.VERDICTS, o.EDGES)), """SELECT f.subject_id, count(*) AS facts, count(*) FILTER (fact_kind = 'STATE') AS facts_state, count(*) FILTER (fact_kind = 'EVENT') AS facts_event, count(*) FILTER (fact_kind = 'TIMELESS') AS facts_timeless, coalesce(any_value(n1), 0) AS corroborates, coalesce(any_value(n2), 0) AS contradicts FROM facts f
  LEFT JOIN (SELECT subject_id, count(*) FILTER (relation = 'CORROBORATES') AS n1, count(*) FILTER (relation = 'CONTRADICTS') AS n2 FROM edges GROUP BY 1) e ON e.subject_id = f.subject_id GROUP BY 1"""))
def assemble_counters(spark, sf_dir):
    _, (_, f), edges, _ = _edges(spark, sf_dir)
    return assembly.assemble_counters(f, edges)


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN sum(o_orderkey)::bigint // count(*) FILTER (o_orderstatus = 'F') // 60 END AS minutes FROM orders GROUP BY 1")
def mean_minutes(spark, sf_dir):
    t = rows(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_orderkey").cast("long").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return t.select("o_custkey", views.mean_minutes("total", "n").alias("minutes"))


@query("SELECT l_suppkey AS entity_id, l_partkey AS subject_id, count(*) AS mention_count, count(*) FILTER (l_returnflag = 'R') AS provisional_count, array_to_string(list_sort(list(DISTINCT l_shipmode)), ',') AS surfaces FROM lineitem GROUP BY 1, 2".replace("l_shipmode", "l_linestatus"))
def mention_groups(spark, sf_dir):
    m = rows(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("subject_id"), (F.col("l_returnflag") == "R").alias("provisional"), F.col("l_linestatus").alias("surface"))
    return views.mention_groups(m).withColumn("surfaces", F.array_join("surfaces", ","))


@query("SELECT p_partkey AS template_id, CASE WHEN p_size % 5 = 0 THEN 2147483647 ELSE p_size END AS ordinal FROM part")
def taxonomy_order(spark, sf_dir):
    p = rows(spark, sf_dir, "part").select(F.col("p_partkey").alias("template_id"), F.col("p_size").alias("category"), F.col("p_name").alias("title"))
    return views.in_taxonomy_order(p, p.where("category % 5 <> 0").select("category", F.col("category").alias("ordinal")).distinct()).select("template_id", "ordinal")


@query(o.q(o.CLAIMS, "SELECT claim_id, attention, row_number() OVER (PARTITION BY subject_id ORDER BY attention DESC, coalesce(favorability, 0), claim_id) AS place FROM (SELECT *, basis = 'INFERRED' OR favorability IS NULL OR favorability < 0.5 AS attention FROM claims)"))
def attention_first(spark, sf_dir):
    return views.attention_first(fx.claims(spark, sf_dir), P).select("claim_id", "attention", "place")


@query("SELECT count(*) FILTER (c_custkey % 5 = 0) AS missing, count(*) FILTER (c_custkey % 7 = 0 AND c_custkey % 5 <> 0) AS unexpected, false AS equal FROM customer")
def set_equality(spark, sf_dir):
    c = rows(spark, sf_dir, "customer").select("c_custkey")
    return views.same_sets(c.where("NOT (c_custkey % 7 = 0 AND c_custkey % 5 <> 0)"), c.where("c_custkey % 5 <> 0"), "c_custkey")


@query(o.q(JUDGED_CTE, """SELECT round(x, 6) AS x, round(y, 6) AS y, radius, pairs FROM (SELECT avg(agreement) AS x, avg((human = predicted)::int) AS y, 3.0::double + least(count(*), 6) AS radius, count(*) AS pairs FROM judged GROUP BY least(floor(agreement * 5), 4))"""))
def plot_points(spark, sf_dir):
    return evaluation.plot_points(judging.calibration(_judged(spark, sf_dir, votes=True), P)).select(r6("x", "x"), r6("y", "y"), "radius", "pairs")


# --- planning and evaluation


@query(f"SELECT o_orderkey, {sql_when('o_orderkey', 11, 12, 12, 13, 13, 14, 14)} AS row_id, {sql_when('o_orderkey', 'MEASURED', 'GAP', 'GAP', 'GAP', 'GAP', 'MEASURED', 'MEASURED')} AS hedge, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'Acknowledge and redirect' ELSE 'Reframe with evidence' END ELSE {sql_when('o_orderkey', '', 'Honest gap + nearest fact', 'This-record-only comparison', 'Polite refusal', 'Polite refusal, identity restated', 'Register shift', 'Plain disclosure')} END AS voice FROM orders")
def question_rows(spark, sf_dir):
    t = rows(spark, sf_dir, "orders").select("o_orderkey", when(F.col("o_orderkey"), *planning.QUESTION_ROWS).alias("kind"), F.when(F.col("o_custkey") % 2 == 0, "ACKNOWLEDGE_AND_REDIRECT").otherwise("REFRAME_WITH_EVIDENCE").alias("criticism_response"))
    return t.select("o_orderkey", planning.question_row().alias("r")).select("o_orderkey", "r.row_id", "r.hedge", "r.voice")


@query(f"SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 14 = 13 THEN 'DISCLOSE' WHEN o_orderkey % 14 = 10 THEN 'REFRAME' ELSE {sql_when('o_orderkey', 'ASSERT', 'ASSERT', 'HEDGE', 'HEDGE', 'REFUSE')} END AS behaviour FROM orders")
def expected_behaviours(spark, sf_dir):
    k = F.col("o_orderkey")
    t = rows(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, "META").otherwise("QA").alias("category"), (k % 14 + 1).cast("int").alias("row_id"), when(k, "ASSERTIVE", "MEASURED", "HEDGED", "RESERVED", "GAP").alias("hedge"))
    return t.select("o_orderkey", planning.expected_behaviour().alias("behaviour"))


@query("""SELECT k AS o_orderkey, concat_ws(',', 'no_denial', 'stated_precision', CASE r WHEN 2 THEN CASE WHEN told THEN 'with_explanation' ELSE 'with_context' END WHEN 3 THEN 'attribute_to_self' WHEN 4 THEN 'attribute:role_only' WHEN 5 THEN 'never_voice' WHEN 6 THEN 'context_mandatory'
  WHEN 7 THEN concat('candid_when_asked,', CASE WHEN NOT told THEN 'never_volunteer' WHEN c % 3 = 0 THEN 'volunteer' WHEN c % 3 = 1 THEN 'volunteer_in_context' ELSE 'only_when_asked' END, ',frame:matter_of_fact') WHEN 8 THEN 'verbatim' END,
  CASE WHEN r > 8 THEN CASE c % 3 WHEN 0 THEN 'criticism:reframe_with_evidence' WHEN 1 THEN 'gap:plain_decline' ELSE 'class:identity' END END) AS codes FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 10 + 1 AS r, o_custkey % 2 = 0 AS told FROM orders)""")
def plan_constraints(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = rows(spark, sf_dir, "orders").select("o_orderkey", (k % 10 + 1).alias("row_id"), F.when(k % 10 >= 8, when(c, "CRITICISM", "OUT_OF_CORPUS", "IDENTITY")).alias("kind"), F.when(c % 2 == 0, "why").alias("sidecar"), F.lit("ROLE_ONLY").alias("endorser_attribution"), when(c, "PROACTIVE", "RELEVANT_CONTEXT", "ONLY_WHEN_ASKED").alias("weakness_eagerness"), F.lit("MATTER_OF_FACT").alias("weakness_framing"), F.lit("REFRAME_WITH_EVIDENCE").alias("criticism_response"), F.lit("PLAIN_DECLINE").alias("out_of_corpus"))
    return t.select("o_orderkey", F.array_join(planning.constraints(), ",").alias("codes"))


TEMPLATES = [{"template_id": "any", "claim_types": [], "declared_types": [], "target": 3}, {"template_id": "skill", "claim_types": ["SKILL", "VALUE"], "declared_types": [], "target": 2}, {"template_id": "stance", "claim_types": ["WEAKNESS"], "declared_types": ["STANCE", "BOUNDARY"], "target": 2}, {"template_id": "none", "claim_types": ["NOTHING"], "declared_types": [], "target": 2}]
GATES = """me AS (SELECT subject_id, concat('f', q // 5) AS fact_id, claim_id, claim_type, q % 3 = 0 AS declared, CASE WHEN q % 2 = 0 THEN 'BOUNDARY' ELSE 'STANCE' END AS dt, q FROM claims),
te(template_id, k, target) AS (VALUES ('any', 0, 3), ('skill', 1, 2), ('stance', 2, 2)),
dr AS (SELECT te.*, me.* FROM te, me WHERE NOT (declared AND dt = 'BOUNDARY') OR template_id = 'stance'),
fa2 AS (SELECT template_id, k, target, subject_id, fact_id, string_agg(claim_id, ',' ORDER BY claim_id) AS ids FROM dr GROUP BY 1, 2, 3, 4, 5 HAVING CASE template_id WHEN 'any' THEN true WHEN 'skill' THEN bool_or(claim_type = 'SKILL') AND bool_or(claim_type = 'VALUE') ELSE bool_or(claim_type = 'WEAKNESS') AND bool_or(declared) END),
el AS (SELECT *, row_number() OVER (PARTITION BY subject_id, template_id ORDER BY fact_id) - 1 AS i, count(*) OVER (PARTITION BY subject_id, template_id) AS n FROM fa2)"""


@query(o.q(o.CLAIMS + ",\n" + GATES, "SELECT subject_id, template_id, slot, fact_id, ids AS claim_ids FROM el, (SELECT unnest(range(3)) AS slot) WHERE slot < target AND (slot + k) % n = i"))
def template_units(spark, sf_dir):
    q = F.col("q")
    member = F.struct("claim_id", "claim_type", (q % 3 == 0).alias("declared"), F.when(q % 2 == 0, "BOUNDARY").otherwise("STANCE").alias("declared_type"))
    facts = fx.claims(spark, sf_dir).groupBy("subject_id", F.concat(F.lit("f"), F.floor(q / 5).cast("string")).alias("fact_id")).agg(F.lit(0.5).alias("belief"), F.array_sort(F.collect_list(member)).alias("members"))
    return planning.template_units(facts, TEMPLATES).withColumn("claim_ids", F.array_join("claim_ids", ","))


@query("""SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Advocate' END AS advocate_name, 'warm' AS preset_id, CASE WHEN c_custkey % 6 = 0 THEN 'PROACTIVE' ELSE 'ONLY_WHEN_ASKED' END AS weakness_eagerness, 'GROWTH_NARRATIVE' AS weakness_framing, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS custom_text FROM customer""")
def resolved_personas(spark, sf_dir):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    c = rows(spark, sf_dir, "customer").select(k.alias("subject_id"), F.col("c_name").alias("advocate_name"))
    stored = c.where("subject_id % 3 <> 2").select("subject_id", F.when(F.col("subject_id") % 3 == 0, F.concat(F.lit(" "), "advocate_name")).otherwise(" ").alias("advocate_name"), none.alias("preset_id"), F.when(F.col("subject_id") % 6 == 0, "PROACTIVE").alias("weakness_eagerness"), *[none.alias(f) for f in planning.PERSONA if f != "weakness_eagerness"], F.when(F.col("subject_id") % 3 == 0, " x ").alias("custom_text"))
    return planning.resolved_persona(stored, c, "Advocate", "warm").select("subject_id", "advocate_name", "preset_id", "weakness_eagerness", "weakness_framing", "custom_text")


@query("SELECT c_custkey AS run_id, m.category, CASE WHEN m.category = 'QA' AND c_custkey % 2 = 0 THEN 0.5 ELSE m.w END AS weight FROM customer, (VALUES ('QA', 0.25), ('SITUATIONAL', 0.35), ('MULTI_CLAIM', 0.25)) m(category, w)")
def overridden_mixes(spark, sf_dir):
    k = F.col("c_custkey")
    return planning.overridden_mix(rows(spark, sf_dir, "customer").select(k.alias("run_id"), F.lit("QA").alias("category"), F.when(k % 2 == 0, 0.5).alias("weight")), P.mix)


@query("""SELECT c_custkey, trim(concat('Speaks for ', c_name, '.', CASE WHEN c_custkey % 2 = 0 THEN concat(' Mail ', c_phone, '.') ELSE '' END, chr(10), CASE WHEN c_custkey % 3 = 0 THEN concat(chr(10), 'RULES', chr(10), 'Be brief.', chr(10)) ELSE '' END, chr(10), 'FACTS', chr(10), CASE WHEN c_custkey % 5 = 0 THEN '- none on record' ELSE concat('- ', c_mktsegment, chr(10), '- two') END, chr(10), 'Standing.')) AS prompt FROM customer""".replace("c_phone", "c_mktsegment"))
def system_prompts(spark, sf_dir):
    k = F.col("c_custkey")
    c = rows(spark, sf_dir, "customer").withColumn("h", F.lit("Speaks for {{name}}. Mail {{email}}."))
    header = planning.resolved_header("h", {"name": F.col("c_name"), "email": F.when(k % 2 == 0, F.col("c_mktsegment"))})
    facts = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment", F.lit("two")))
    return c.select("c_custkey", planning.system_prompt(header, F.when(k % 3 == 0, " Be brief. "), facts, F.lit("Standing.")).alias("prompt"))


PROBES = "pb AS (SELECT o_custkey % 10 AS run_id, o_orderkey AS probe_id, CASE WHEN o_orderkey % 2 = 0 THEN 'CORE' ELSE 'HOLDOUT' END AS kind, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS row_id, CASE WHEN o_orderkey % 9 = 0 THEN concat('S', o_orderkey % 2) END AS safety_class, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 > 0 END AS matched FROM orders)"


def _probes(spark, sf_dir):
    k = F.col("o_orderkey")
    return rows(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("run_id"), k.alias("probe_id"), F.when(k % 2 == 0, "CORE").otherwise("HOLDOUT").alias("kind"), F.when(k % 7 > 0, k % 7).alias("row_id"), F.when(k % 9 == 0, F.concat(F.lit("S"), (k % 2).cast("string"))).alias("safety_class"), F.when(k % 5 > 0, k % 4 > 0).alias("matched"))


@query(o.q(PROBES, """SELECT pb.run_id, count(*) AS probes, count(matched) AS graded, count(*) FILTER (kind = 'CORE') AS core, count(*) FILTER (kind = 'HOLDOUT') AS holdout, round(count(*) FILTER (matched) / count(matched), 6) AS match_rate, count(*) FILTER (safety_class IS NOT NULL AND NOT coalesce(matched, false)) = 0 AS safety_pass,
  count(*) FILTER (safety_class IS NOT NULL AND matched IS NOT NULL AND NOT matched) AS safety_failed, coalesce(string_agg(concat(safety_class, ':', probe_id), ',' ORDER BY concat(safety_class, ':', probe_id)) FILTER (safety_class IS NOT NULL AND NOT coalesce(matched, false)), '') AS failed_safety, count(*) FILTER (matched) / count(matched) >= 0.75 AS bar_met, coalesce(any_value(f), '') AS failing_rows
  FROM pb LEFT JOIN (SELECT run_id, string_agg(concat(row_id, '×', n), ', ' ORDER BY row_id) AS f FROM (SELECT run_id, row_id, count(*) AS n FROM pb WHERE NOT matched AND row_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) r USING (run_id) GROUP BY 1"""))
def eval_reports(spark, sf_dir):
    return evaluation.eval_report(_probes(spark, sf_dir), 0.75).withColumns({"match_rate": F.round("match_rate", 6), "failed_safety": F.array_join("failed_safety", ",")})


@query(o.q(PROBES, "SELECT run_id, row_id, count(*) AS total, count(*) FILTER (matched) AS hits FROM pb WHERE matched IS NOT NULL AND row_id IS NOT NULL GROUP BY 1, 2"))
def eval_rows(spark, sf_dir):
    return evaluation.row_rates(_probes(spark, sf_dir))


SAMPLE = """kn AS (SELECT subject_id, a, b, outcome = 'QUEUED' AS queued FROM graded WHERE outcome = 'QUEUED' OR outcome LIKE 'REPEATS%'), la AS (SELECT subject_id, a, b FROM kn WHERE ('0x' || substr(sha256(concat(a, b)), 1, 2))::int % 5 = 0),
oc AS (SELECT subject_id, claim_id, row_number() OVER (PARTITION BY subject_id ORDER BY substr(sha256(claim_id), 1, 12), claim_id) AS i FROM claims),
pr AS (SELECT DISTINCT x.subject_id, least(x.claim_id, y.claim_id) AS a, greatest(x.claim_id, y.claim_id) AS b FROM oc x JOIN oc y ON x.subject_id = y.subject_id AND y.i BETWEEN x.i + 1 AND x.i + 16 WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.a = least(x.claim_id, y.claim_id) AND kn.b = greatest(x.claim_id, y.claim_id))),
al AS (SELECT subject_id, a, b, CASE WHEN queued THEN 'JUDGE_QUEUE' ELSE 'SURVIVOR' END AS bucket, 4 AS most FROM kn UNION ALL SELECT subject_id, a, b, 'PROBE', 2 FROM pr),
sa AS (SELECT *, row_number() OVER (PARTITION BY subject_id, bucket ORDER BY substr(sha256(concat_ws('|', a, b)), 1, 12), a, b) AS r FROM al WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.a = al.a AND la.b = al.b))"""


@query(o.q(o.MATCH + ",\n" + SAMPLE, "SELECT subject_id, a, b, bucket FROM sa WHERE r <= most"))
def pairs_to_label(spark, sf_dir):
    c, graded, _ = _graded(spark, sf_dir)
    queued, rest = graded.where("outcome = 'QUEUED'"), graded.where("outcome LIKE 'REPEATS%'")
    known = queued.unionByName(rest)
    labelled = known.where(F.conv(F.substring(F.sha2(F.concat("a", "b"), 256), 1, 2), 16, 10).cast("int") % 5 == 0)
    return evaluation.sampled_pairs(queued, rest, c, labelled, 10)


@query("SELECT p_brand AS subject_id, slot, arg_min(p_partkey, i) FILTER (slot % n = i) AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part), (SELECT unnest(range(5)) AS slot) GROUP BY 1, 2")
def rotation(spark, sf_dir):
    return training.rotating(rows(spark, sf_dir, "part").select(F.col("p_brand").alias("subject_id"), F.col("p_partkey").alias("item_id")), 5)


# --- replies


@query(f"""SELECT o_orderkey AS subject_id, 'a1' AS asset_id, {sql_when('o_orderkey', 'SKILL', 'EPISODE')} AS claim_type, concat('did ', o_custkey) AS text, CASE WHEN o_orderkey % 3 = 0 THEN '2024-02-29' END AS claimed_date, CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0.25 END AS favorability, CASE WHEN o_orderkey % 5 = 0 THEN 'INFERRED' ELSE 'STATED' END AS basis,
  o_orderkey % 2 = 0 AS sensitive, CASE WHEN o_custkey % 3 = 0 THEN 'SELF' WHEN o_custkey % 3 = 1 THEN 'ENDORSEMENT' ELSE 'EVENT_CAPTURE' END AS prov_source_class, CASE WHEN o_custkey % 3 = 0 THEN 'LOW' WHEN o_custkey % 3 = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS prov_tier FROM orders WHERE o_custkey % 4 > 0""")
def extracted_claims(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fields = F.struct(F.concat(F.lit(" did "), c.cast("string")).alias("text"), when(k, "skill", " Episode ").alias("claimType"), when(c, "s0", "s1", None).alias("speaker"), F.when(k % 3 == 0, "2024-02-29").otherwise("2024-02-30").alias("claimedDate"), F.when(k % 4 == 0, 7.5).otherwise(0.25).alias("favorability"), F.when(k % 5 == 0, "inferred").otherwise("guess").alias("basis"), (k % 2 == 0).alias("sensitive"))
    said = F.concat(F.lit("```json\n[{\"claimType\":\"SKILL\",\"text\":\" \"},"), F.when(c % 4 > 0, F.to_json(fields)).otherwise('{"claimType":"ODD","text":"x"}'), F.lit(',{"claimType":"SK'))
    r = rows(spark, sf_dir, "orders").select(F.lit("a1").alias("asset_id"), k.alias("subject_id"), said.alias("reply"), F.lit("EVENT_CAPTURE").alias("source_class"), F.lit("UNKNOWN").alias("relationship"), F.lit("HIGH").alias("tier_seed"))
    speakers = spark.createDataFrame([("a1", "s0", "SUBJECT", None), ("a1", "s1", "ENDORSER", "MANAGER")], "asset_id string, speaker string, speaker_role string, speaker_relationship string")
    return extraction.claims_of(r, speakers).select("subject_id", "asset_id", "claim_type", "text", "claimed_date", "favorability", "basis", "sensitive", "prov_source_class", "prov_tier")


@query("SELECT c_custkey AS batch_id, c_custkey % 7 AS i, c_name AS surface, 'ORG' AS entity_type FROM customer UNION ALL SELECT c_custkey, c_custkey % 7, c_mktsegment, 'PLACE' FROM customer WHERE c_custkey % 2 = 0")
def extracted_mentions(spark, sf_dir):
    k = F.col("c_custkey")
    m = lambda s, t: F.struct(s.alias("surface"), F.lit(t).alias("entityType"))
    found = F.array(m(F.concat(F.lit(" "), "c_name"), "org"), m(F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.repeat(F.lit("x"), 81)), "PLACE"), m(F.col("c_name"), "planet"), m(F.lit(" "), "ORG"))
    said = F.to_json(F.array(F.struct((k % 7).alias("i"), found.alias("mentions"))))
    return extraction.mentions_of(rows(spark, sf_dir, "customer").select(k.alias("batch_id"), said.alias("reply")))


@query(o.q(o.CLAIMS, "SELECT claim_id, concat('why ', doc_id, '?') AS question FROM claims WHERE q % 3 > 0"))
def extracted_questions(spark, sf_dir):
    c = fx.claims(spark, sf_dir)
    one = lambda i, t: F.struct(i.alias("claimId"), t.alias("question"))
    said = F.to_json(F.array(one(F.col("claim_id"), F.lit("first?")), one(F.col("claim_id"), F.concat(F.lit(" why "), F.col("doc_id").cast("string"), F.lit("? "))), one(F.lit("unknown"), F.lit("x?"))))
    blank = F.to_json(F.array(one(F.col("claim_id"), F.lit(" "))))
    return extraction.questions_of(c.select(F.col("doc_id").alias("batch_id"), F.when(F.col("q") % 3 > 0, said).otherwise(blank).alias("reply")), c)


@query(o.q(TURNS, "SELECT conv_id, array_to_string(list_filter([CASE WHEN any_value(n) < 2 OR any_value(n) > 4 THEN 'turns' END, CASE WHEN arg_min(role, i) <> 'user' THEN 'first_not_user' END, CASE WHEN arg_max(role, i) <> 'assistant' THEN 'last_not_model' END, CASE WHEN bool_or(trim(text) = '') THEN 'blank' END], lambda x: x IS NOT NULL), ',') AS errors FROM tu GROUP BY 1"))
def draft_errors(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", F.array_join(extraction.draft_errors("turns", 4), ",").alias("errors"))


@query(o.q(TURNS, """SELECT conv_id, to_json({'contents': list({'role': CASE WHEN role = 'user' THEN 'user' ELSE 'model' END, 'parts': [{'text': text}]} ORDER BY i) FILTER (i < n), 'chosen': {'role': 'model', 'parts': [{'text': arg_max(text, i)}]}, 'rejected': {'role': 'model', 'parts': [{'text': coalesce(arg_min(text, i) FILTER (role = 'assistant'), '')}]}})::varchar AS line FROM tu WHERE n >= 2 GROUP BY 1"""))
def dpo_jsonl(spark, sf_dir):
    pairs = serialization.dpo_pairs(_conversations(spark, sf_dir)).withColumn("rejected", F.coalesce("rejected", F.lit("")))
    return pairs.select("conv_id", serialization.dpo_line().alias("line"))


@query(o.q(TURNS, """SELECT conv_id AS line_no, array_to_string(list_filter(CASE WHEN conv_id % 9 = 0 THEN ['blank'] WHEN conv_id % 9 = 1 THEN ['not_json'] WHEN conv_id % 9 = 2 THEN ['not_object'] WHEN conv_id % 9 = 3 THEN ['no_contents'] ELSE [CASE WHEN arg_min(role, i) <> 'user' OR trim(arg_min(text, i)) = '' THEN 'first_not_user' END, CASE WHEN arg_max(role, i) <> 'assistant' OR trim(arg_max(text, i)) = '' THEN 'last_not_model' END] END, lambda x: x IS NOT NULL), ',') AS errors FROM tu GROUP BY 1"""))
def contents_validate(spark, sf_dir):
    k = F.col("conv_id")
    value = F.when(k % 9 == 0, " ").when(k % 9 == 1, "{").when(k % 9 == 2, "[1]").when(k % 9 == 3, "{}").otherwise(serialization.contents_line())
    lines = _conversations(spark, sf_dir).select(k.alias("line_no"), value.alias("value"))
    return serialization.contents_errors(lines, "SFT", 10**9).withColumn("errors", F.array_join("errors", ","))


@query("SELECT 'f' || (c_custkey % 5) AS file, c_custkey // 5 + 1 AS line_no, CASE c_custkey % 3 WHEN 0 THEN 'not_object' WHEN 1 THEN 'chosen_text,no_rejected' ELSE '' END AS errors FROM customer WHERE c_custkey % 5 < 4 UNION ALL SELECT 'f4', 0, 'empty_file'")
def file_validate(spark, sf_dir):
    k = F.col("c_custkey")
    good = '{"contents":[{"role":"user","parts":[{"text":"q"}]}],"chosen":{"role":"model","parts":[{"text":"a"}]},"rejected":{"role":"model","parts":[{"text":"b"}]}}'
    half = '{"contents":[{"role":"user","parts":[{"text":"q"}]}],"chosen":{"role":"model","parts":[]}}'
    lines = rows(spark, sf_dir, "customer").select(F.concat(F.lit("f"), (k % 5).cast("string")).alias("file"), (F.floor(k / 5) + 1).cast("long").alias("line_no"), F.when(k % 5 == 4, " ").otherwise(when(k, "3", half, good)).alias("value"))
    return serialization.file_errors(lines, "DPO", "CONTENTS", 10**6).withColumn("errors", F.array_join("errors", ","))


@query("SELECT c_custkey, concat('<tool_call>', chr(10), '{\"name\":\"find\",\"arguments\":', CASE WHEN c_custkey % 2 = 0 THEN concat('{\"k\":', c_custkey, '}') ELSE '{}' END, '}', chr(10), '</tool_call>') AS call, concat('```tool_output', chr(10), CASE WHEN c_custkey % 3 = 0 THEN '[1,2]' ELSE '{}' END, chr(10), '```') AS reply FROM customer")
def tool_framings(spark, sf_dir):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    turn = lambda kind, args, result: F.struct(F.lit(kind).alias("kind"), F.lit("find").alias("tool_name"), args.alias("args_json"), result.alias("result_json"), none.alias("text"))
    call = turn("TOOL_CALL", F.when(k % 2 == 0, F.concat(F.lit('{ "k": '), k.cast("string"), F.lit(" }"))).otherwise("{oops"), none)
    reply = turn("TOOL_RESPONSE", none, F.when(k % 3 == 0, "[1, 2]"))
    t = rows(spark, sf_dir, "customer").select("c_custkey", call.alias("c"), reply.alias("r"))
    return t.select("c_custkey", serialization.encoded_tool(F.col("c"), "QWEN_HERMES").alias("call"), serialization.encoded_tool(F.col("r"), "GEMMA_FENCED").alias("reply"))


# --- entities: vectors as entities and mentions

NEAR = replace(P, entity_merge=0.3, entity_review=0.2)
TYPE = "CASE WHEN vec_id % 4 < 2 THEN 'ORG' ELSE 'PLACE' END"
VEC = f"""ve AS (SELECT vec_id AS k, {TYPE} AS t, embedding::double[] AS v FROM embeddings),
ca AS (SELECT k, t, v, concat('e', lpad(k::varchar, 7, '0')) AS id FROM ve WHERE k % 2 = 0), mn AS (SELECT k, t, v, concat('k', lpad(k::varchar, 7, '0')) AS s FROM ve WHERE k % 2 = 1),
lv AS (SELECT * FROM ca WHERE k % 24 <> 0)"""


def _entities(spark, sf_dir):
    k = F.col("vec_id")
    v = rows(spark, sf_dir, "embeddings").select("vec_id", F.when(k % 4 < 2, "ORG").otherwise("PLACE").alias("entity_type"), "embedding")
    name = lambda c, x: F.concat(F.lit(c), F.lpad(x.cast("string"), 7, "0"))
    alias = F.when(k % 10 == 0, F.array(name("k", k + 1))).otherwise(F.array().cast("array<string>"))
    canon = v.where("vec_id % 2 = 0").select(name("e", k).alias("entity_id"), "entity_type", F.when(k % 6 == 0, name("k", k + 1)).otherwise(name("c", k)).alias("canonical_key"), alias.alias("alias_keys"), F.when(k % 24 == 0, name("e", k + 4)).alias("merged_into"), "embedding")
    mentions = v.where("vec_id % 2 = 1").select(k.alias("claim_id"), name("k", k).alias("surface_key"), "entity_type", "embedding")
    return mentions, canon


NEAREST = "nr AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, id) AS r FROM (SELECT mn.s, mn.t, lv.id, round(list_dot_product(mn.v, lv.v), 10) AS sim FROM mn JOIN lv ON lv.t = mn.t))"


@query(o.q(VEC + ",\n" + NEAREST, "SELECT t AS entity_type, s AS surface_key, id AS entity_id, round(sim, 5) AS sim, r FROM nr WHERE r <= 2"))
def nearest_entities(spark, sf_dir):
    mentions, canon = _entities(spark, sf_dir)
    return entities.nearest_entities(mentions, canon, 2).withColumn("sim", F.round("sim", 5))


RESOLVE = """RECURSE AS (SELECT 1), known AS (SELECT s, t, CASE WHEN (k - 1) % 24 = 0 AND ((k - 1) % 6 = 0 OR (k - 1) % 10 = 0) THEN concat('e', lpad((k + 3)::varchar, 7, '0')) ELSE concat('e', lpad((k - 1)::varchar, 7, '0')) END AS id, CASE WHEN (k - 1) % 6 = 0 THEN 'EXACT' WHEN (k - 1) % 10 = 0 THEN 'ALIAS' END AS how FROM mn),
op AS (SELECT mn.*, row_number() OVER (ORDER BY mn.s) AS n, nr.id AS near_id, nr.sim FROM mn JOIN known USING (s) LEFT JOIN nr ON nr.s = mn.s AND nr.r = 1 AND nr.sim >= 0.2 WHERE known.how IS NULL),
kp AS (SELECT x.n AS i, y.n AS j, x.s AS si, round(list_dot_product(x.v, y.v), 10) AS sim FROM op x JOIN op y ON x.t = y.t AND x.n < y.n WHERE round(list_dot_product(x.v, y.v), 10) >= 0.2),
go AS (SELECT 0 AS n, []::bigint[] AS minted UNION ALL SELECT go.n + 1, CASE WHEN (SELECT near_id FROM op WHERE op.n = go.n + 1) IS NULL AND NOT EXISTS (SELECT 1 FROM kp WHERE j = go.n + 1 AND list_contains(minted, i)) THEN list_append(minted, go.n + 1) ELSE minted END FROM go WHERE go.n < (SELECT max(n) FROM op)),
mi AS (SELECT unnest(minted) AS n FROM go WHERE n = (SELECT max(n) FROM op)),
bm AS (SELECT j, arg_min(i, (-sim, si)) AS i, max(sim) AS sim FROM kp WHERE i IN (SELECT n FROM mi) GROUP BY 1),
fi AS (SELECT op.s, op.t, op.n IN (SELECT n FROM mi) AS own, near_id, op.sim, bm.i, bm.sim AS bsim, near_id IS NULL OR bm.sim > op.sim AS to_mint FROM op LEFT JOIN bm ON bm.j = op.n)"""
MINT = "concat('ent-', substr(sha256(concat_ws('|', {t}, {s})), 1, 16))"


@query(o.q(",\n".join((VEC, NEAREST, RESOLVE)), f"""SELECT t AS entity_type, s AS surface_key, id AS entity_id, how FROM known WHERE how IS NOT NULL UNION ALL SELECT fi.t, fi.s, CASE WHEN own THEN {MINT.format(t='fi.t', s='fi.s')} WHEN to_mint THEN {MINT.format(t='m.t', s='m.s')} ELSE near_id END,
  CASE WHEN own THEN 'MINTED' WHEN CASE WHEN to_mint THEN bsim ELSE sim END >= 0.3 THEN 'MERGED' ELSE 'REVIEW' END FROM fi LEFT JOIN (SELECT n, t, s FROM op) m ON m.n = fi.i"""))
def entity_resolution(spark, sf_dir):
    return entities.resolve(*_entities(spark, sf_dir), NEAR).drop("confidence")


@query(o.q(o.CLAIMS, "SELECT claim_id, CASE WHEN source_class = 'DOCUMENTARY' AND q % 3 = 0 THEN 'issuer:e1' ELSE attestor_key END AS attestor_key FROM claims"))
def issuer_upgrades(spark, sf_dir):
    c = fx.claims(spark, sf_dir)
    mentions = c.select("claim_id", F.explode("mention_types").alias("entity_type")).withColumn("entity_id", F.explode(F.array(F.lit("e2"), F.lit("e1"))))
    return entities.issuer_upgrade(c.select("claim_id", "source_class", "attestor_key"), mentions).select("claim_id", "attestor_key")


@query(o.q(o.MATCH, "SELECT cand.a, cand.b, array_to_string(list_sort(list_intersect(list_distinct([x.lang, x.claim_type]), list_distinct([y.lang, y.claim_type]))), ',') AS shared FROM cand JOIN claims x ON x.claim_id = cand.a JOIN claims y ON y.claim_id = cand.b"))
def shared_entities(spark, sf_dir):
    c, graded, discarded = _graded(spark, sf_dir)
    out = entities.shared_entities(graded.unionByName(discarded).select("a", "b"), c.select("claim_id", F.explode(F.array("lang", "claim_type")).alias("name")))
    return out.select("a", "b", F.array_join("shared_entities", ",").alias("shared"))


@query(o.q(SCORE_CTE, "SELECT subject_id, round(avg(evidence_mass), 6) AS mean_mass, round(median(evidence_mass), 6) AS median_mass, count(*) AS n FROM scored GROUP BY 1"))
def mass_statistics(spark, sf_dir):
    f = _scores(spark, sf_dir)["facts"]
    return f.groupBy("subject_id").agg(r6(F.avg("evidence_mass"), "mean_mass"), r6(F.median("evidence_mass"), "median_mass"), F.count("*").alias("n"))


@query(o.q(FACT_CTE, "SELECT subject_id, fact_id, member_count FROM facts WHERE member_count > 1"))
def repeated_facts(spark, sf_dir):
    c, _, members = _members(spark, sf_dir)
    return assembly.facts(c, members).where("member_count > 1").select("subject_id", "fact_id", "member_count")
