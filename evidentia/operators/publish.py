"""Read-back, publishing, export filters and chains over facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: subject_id, fact_id, other, relation, confidence, explained."""
    way = lambda a, b: edges.select("subject_id", F.col(a).alias("fact_id"), F.col(b).alias("other"), "relation", "confidence", "explained")
    return way("from_fact", "to_fact").unionByName(way("to_fact", "from_fact"))


def edge_counts(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Four counts for each claim, those of its fact. edges also has review_status."""
    ends = edges.select("subject_id", F.explode(F.array("from_fact", "to_fact")).alias("fact_id"), "relation", "explained", "review_status")
    against, told = F.col("relation") == "CONTRADICTS", F.coalesce("explained", F.lit(False))
    per = ends.groupBy("subject_id", "fact_id").agg(
        F.count_if(F.col("relation") == "CORROBORATES").alias("corroborates"), F.count_if(against).alias("contradicts"), F.count_if(against & told).alias("contradicts_explained"), F.count_if(against & (F.col("review_status") == "CONFIRMED")).alias("contradicts_confirmed")
    )
    names = ["corroborates", "contradicts", "contradicts_explained", "contradicts_confirmed"]
    return claims.join(per, ["subject_id", "fact_id"], "left").na.fill(0, names)


def read_back(claims: DataFrame, facts: DataFrame, attestors: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims with fact, attestor, sorted entity names and the edges of the fact; each side is grouped before the joins, so no join multiplies rows."""
    names = mentions.groupBy("claim_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    around = neighbours(edges).groupBy("subject_id", "fact_id").agg(F.array_sort(F.collect_list(F.struct("other", "relation", "confidence", "explained"))).alias("edges"))
    rows = claims.join(facts, ["subject_id", "fact_id"]).join(attestors, "attestor_key", "left").join(names, "claim_id", "left").join(around, ["subject_id", "fact_id"], "left")
    return rows.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def fact_records(facts: DataFrame, succeeds: DataFrame, corroborating: DataFrame) -> DataFrame:
    """Facts with the ones before and after them in their lane, and how many facts corroborate them."""
    after = succeeds.groupBy(F.col("from_fact").alias("fact_id")).agg(F.min("to_fact").alias("next_fact"))
    before = succeeds.groupBy(F.col("to_fact").alias("fact_id")).agg(F.max("from_fact").alias("prev_fact"))
    n = neighbours(corroborating).where("relation = 'CORROBORATES'").groupBy("fact_id").agg(F.countDistinct("other").alias("n_corroborating"))
    return facts.join(before, "fact_id", "left").join(after, "fact_id", "left").join(n, "fact_id", "left").na.fill(0, ["n_corroborating"])


def chains(succeeds: DataFrame, starts: DataFrame, hops: int = 5) -> DataFrame:
    """(fact_id, path): from each start along the smallest next id, at most ``hops`` facts more, never twice the same. Each hop is a join."""
    nxt = succeeds.groupBy(F.col("from_fact").alias("at")).agg(F.min("to_fact").alias("to"))
    rows = starts.select("fact_id", F.array("fact_id").alias("path"), F.col("fact_id").alias("at"))
    for _ in range(hops):
        rows = rows.join(nxt, "at", "left")
        ok = F.col("to").isNotNull() & ~F.array_contains("path", F.col("to"))
        rows = rows.select("fact_id", F.when(ok, F.array_append("path", F.col("to"))).otherwise(F.col("path")).alias("path"), F.when(ok, F.col("to")).alias("at"))
    return rows.select("fact_id", "path")


def situational_chains(facts: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """Anchored facts with at most ``most`` corroborating facts by id, and the subject's next anchored fact, round the end."""
    anchored = facts.where("anchored").select("subject_id", "fact_id")
    order = Window.partitionBy("subject_id").orderBy("fact_id")
    first = F.first("fact_id").over(order)
    rows = anchored.withColumn("adjacent", F.coalesce(F.lead("fact_id").over(order), first))
    near = neighbours(edges).where("relation = 'CORROBORATES'").select("subject_id", "fact_id", "other").distinct()
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("subject_id", "fact_id").orderBy("other"))).where(F.col("r") <= most)
    near = near.groupBy("subject_id", "fact_id").agg(F.array_sort(F.collect_list("other")).alias("support"))
    return rows.join(near, ["subject_id", "fact_id"], "left").select("subject_id", "fact_id", F.coalesce("support", F.array().cast("array<string>")).alias("support"), F.when(F.col("adjacent") != F.col("fact_id"), F.col("adjacent")).alias("adjacent"))


def situational_units(anchors: DataFrame, edges: DataFrame, families: dict[str, tuple[str, ...]], most: int = 2, mark: str = "{adjacent}") -> DataFrame:
    """(subject_id, fact_id, family, template, adjacent, chain): a unit for each anchor and family.

    A subject's anchors stand in a ring, strongest belief first, ties by id. A family's templates take turns along the ring, each family a step further; one
    that names the adjacent anchor gives way to the family's first that does not where there is no other anchor. The chain holds the anchor, its first ``most``
    corroborating facts by id, and the adjacent anchor if the template holds ``mark``. anchors: subject_id, fact_id, belief. edges: as for
    ``neighbours``. families: the templates of each.
    """
    ring = Window.partitionBy("subject_id").orderBy(F.desc(F.coalesce("belief", F.lit(0.0))), "fact_id")
    rows = anchors.withColumns({"place": F.row_number().over(ring) - 1, "next": F.lead("fact_id").over(ring), "first": F.first("fact_id").over(ring)})
    rows = rows.withColumn("adjacent", F.coalesce("next", F.when(F.col("first") != F.col("fact_id"), F.col("first"))))
    near = neighbours(edges).where("relation = 'CORROBORATES'").select("subject_id", "fact_id", "other").distinct()
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("subject_id", "fact_id").orderBy("other"))).where(F.col("r") <= most)
    near = near.groupBy("subject_id", "fact_id").agg(F.array_sort(F.collect_list("other")).alias("support"))
    none = F.array().cast("array<string>")
    said = lambda t: F.struct(F.lit(t).alias("text"), F.lit(mark in t).alias("uses_adjacent"))
    known = F.array(*[F.struct(F.lit(name).alias("family"), F.lit(k).alias("ordinal"), F.array(*map(said, texts)).alias("templates")) for k, (name, texts) in enumerate(families.items())])
    units = rows.join(near, ["subject_id", "fact_id"], "left").select("*", F.inline(known))
    turn = F.get("templates", F.pmod(F.col("place") + F.col("ordinal"), F.size("templates")))
    plain = F.get(F.filter("templates", lambda t: ~t["uses_adjacent"]), F.lit(0))
    units = units.withColumn("t", F.when(F.col("adjacent").isNull() & turn["uses_adjacent"], plain).otherwise(turn))
    chain = F.array_distinct(F.concat(F.array("fact_id"), F.coalesce("support", none), F.when(F.col("t.uses_adjacent"), F.array("adjacent")).otherwise(none)))
    return units.select("subject_id", "fact_id", "family", F.col("t.text").alias("template"), "adjacent", chain.alias("chain"))


def export_filter(claim_type: str | None = None, tier: str | None = None, label: str | None = None) -> Column:
    """Equality or no wish on type and tier, a label in any case. Needs tags struct<claim_type, tier, labels>."""
    out = F.lit(True)
    if claim_type:
        out = out & (F.col("tags.claim_type") == claim_type)
    if tier:
        out = out & (F.col("tags.tier") == tier)
    if label:
        out = out & F.exists("tags.labels", lambda x: F.lower(x) == label.lower())
    return F.coalesce(out, F.lit(False))


def of_stamp(examples: DataFrame, score_run: str, persona_hash: str | None) -> DataFrame:
    """Approved examples of the current run and persona."""
    return examples.where((F.col("status") == "APPROVED") & F.col("stamp.score_run_id").eqNullSafe(score_run) & F.col("stamp.persona_hash").eqNullSafe(persona_hash))


def eligible(claims: DataFrame, published_run: str, least_version: int = 2) -> DataFrame:
    """Scored claims of the published run under a new enough contract; a missing version is the first."""
    return claims.where(F.col("score").isNotNull() & (F.col("score_run_id") == published_run) & (F.coalesce("contract_version", F.lit(1)) >= least_version))


def inconsistent(claims: DataFrame, facts: DataFrame, published: DataFrame) -> DataFrame:
    """Published claims and facts whose run isn't their subject's published run: counts by subject and kind, empty if all is well."""
    run = published.select("subject_id", F.col("score_run_id").alias("run"))
    stale = lambda df, kind: df.join(run, "subject_id").where(~F.col("score_run_id").eqNullSafe(F.col("run"))).groupBy("subject_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return stale(claims, "CLAIM").unionByName(stale(facts, "FACT"))


def stale_embeddings(claims: DataFrame, stamp: str, n: int) -> DataFrame:
    """The first n claims by id without an embedding of the current stamp."""
    return claims.where(F.col("embedding").isNull() | ~F.col("embedding_stamp").eqNullSafe(stamp)).orderBy("claim_id").limit(n)


def merged_settings(defaults: DataFrame, overrides: DataFrame, editable: tuple[str, ...]) -> DataFrame:
    """(name, value): stored overrides of editable settings over the defaults."""
    own = overrides.where(F.col("name").isin(*editable)).select("name", F.col("value").alias("own"))
    return defaults.join(own, "name", "left").select("name", F.coalesce("own", "value").alias("value"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("message_id"))
    return messages.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def packed_chunks(segments: DataFrame, most: int = 60_000) -> DataFrame:
    """(asset_id, seq, chunk): greedy packing of an asset's segments in order, never splitting one, at most ``most`` characters a chunk.

    The rule is sequential; only lengths enter the Python step, in order and streamed, so an asset of any size needs constant memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asset, chunk, size = None, 0, 0
        for rows in batches:
            out = []
            for a, n in zip(rows["asset_id"], rows["n"], strict=True):
                if a != asset:
                    asset, chunk, size = a, 0, 0
                elif size and size + n > most:
                    chunk, size = chunk + 1, 0
                size += n
                out.append(chunk)
            yield rows[["asset_id", "seq"]].assign(chunk=out)

    rows = segments.select("asset_id", "seq", (F.length("text") + 1).cast("long").alias("n")).repartition("asset_id").sortWithinPartitions("asset_id", "seq")
    kind = segments.schema["asset_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"asset_id {kind}, seq long, chunk long")


def vote_summary(votes: Column | str) -> Column:
    """``top/all`` of a JSON object of votes."""
    n = F.map_values(F.from_json(votes, "map<string,long>"))
    return F.concat_ws("/", F.array_max(n).cast("string"), F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x).cast("string"))


def gate_rollup(gates: DataFrame) -> DataFrame:
    """One row a run: the first failed gate's error, and the sums of its counters."""
    bad = F.when(F.col("status") == "FAILED", F.struct("ordinal", "gate"))
    return gates.groupBy("run_id").agg(F.min_by("error_code", bad).alias("error_code"), F.min_by("gate", bad).alias("failed_gate"), F.sum(F.coalesce("passed", F.lit(0))).alias("passed"), F.sum(F.coalesce("escalated", F.lit(0))).alias("escalated"))


def best_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Of each job: final before others, node 0, deepest, newest, then by path."""
    order = F.struct(~F.col("is_final"), F.col("node") != 0, -F.col("depth"), -F.unix_micros(F.col("updated_at").cast("timestamp")), F.col("path"))
    return checkpoints.groupBy("job_id").agg(F.min_by("path", order).alias("path"))


def training_phase(manifests: DataFrame, jobs: DataFrame) -> DataFrame:
    """(subject_id, phase): how far a subject is, from its manifest's stamps first, then from its jobs.

    manifests: subject_id, review_submitted_at, review_locked_at, started_at, sealed. jobs: subject_id, status. Without jobs a started subject is processing.
    """
    done = jobs.groupBy("subject_id").agg(F.bool_and(F.col("status").isin("COMPLETED", "FAILED")).alias("all_done"))
    phase = F.when(F.col("review_submitted_at").isNotNull(), "SUBMITTED").when(F.col("review_locked_at").isNotNull(), "REVIEW_IN_PROGRESS").when(F.col("started_at").isNull() & ~F.coalesce("sealed", F.lit(False)), "UPLOAD")
    return manifests.join(done, "subject_id", "left").select("subject_id", phase.when(F.col("all_done"), "REVIEW_READY").otherwise("PROCESSING").alias("phase"))


#: What a subject is told of a job: state by status.
FRIENDLY = {"PENDING": "WORKING", "TRANSCRIBING": "WORKING", "AWAITING_SPEAKER_SELECTION": "NEEDS_YOU", "EXTRACTING": "UNDERSTANDING", "COMPLETED": "DONE", "FAILED": "ATTENTION"}


def friendly_jobs(jobs: DataFrame) -> DataFrame:
    """(job_id, subject_id, state, listening): the state a subject sees, and whether a recording is still being listened to."""
    state = F.try_element_at(F.create_map(*[F.lit(x) for kv in FRIENDLY.items() for x in kv]), F.col("status"))
    return jobs.select("job_id", "subject_id", state.alias("state"), ((F.col("status") == "TRANSCRIBING") & F.col("modality").isin("AUDIO", "VIDEO")).alias("listening"))


def duration_label(seconds: Column | str) -> Column:
    """``Xm Ys``, or ``Ys`` under a minute."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def claim_blocks(claims: DataFrame, facts: DataFrame, scores: DataFrame, counts: DataFrame) -> DataFrame:
    """What is published with each claim: its score, its fact with dates and number of members, and the edges of that fact.

    claims: subject_id, claim_id, fact_id, attestor_key. scores: claim_id, score, tier. counts: from ``edge_counts``.
    """
    names = ["corroborates", "contradicts", "contradicts_explained", "contradicts_confirmed"]
    stamp = F.struct("fact_id", "fact_kind", "slot", "valid_from", "valid_to", "date_precision", "anchored", "member_count").alias("fact_stamp")
    rows = claims.join(facts, ["subject_id", "fact_id"]).join(scores.select("claim_id", "score", "tier"), "claim_id").join(counts.select("claim_id", *names), "claim_id", "left")
    return rows.select("subject_id", "claim_id", "score", "tier", stamp, F.struct(*[F.coalesce(n, F.lit(0)).alias(n) for n in names]).alias("edge_counts"), "attestor_key")


def knowledge_as_of(override: Column, profile: Column, published: Column) -> Column:
    """The override, else the profile's date, else the day of publishing; blank where neither of the first two is given."""
    given = F.coalesce(override, profile)
    return F.when(given.isNull(), "").otherwise(F.coalesce(override, profile, F.date_format(published, "yyyy-MM-dd")))


def scrubbed(text: Column | str, ids: Column) -> Column:
    """Without the given ids in brackets and without rule tags (C, D, E or F and a number) in either bracket; other brackets stay, gaps are tidied."""
    t = F.reduce(F.filter(ids, lambda i: F.trim(i) != ""), F.col(text) if isinstance(text, str) else text, lambda acc, i: F.replace(acc, F.concat(F.lit("["), i, F.lit("]")), F.lit("")))
    for pattern, to in ((r"[\[(](?:S4-)?[CDEF]\d{1,2}[\])]", ""), (" {2,}", " "), (r" +([.,;:!?])", "$1"), (r"([\u201C\u2018]) +", "$1"), (r" +([\u201D\u2019])", "$1")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


#: One short line of letters, digits and light punctuation: free text that prompts may hold.
LINE = r"^[\p{L}\p{N} .,'&/()+:;!?\-]{1,%d}$"
CONTACT = r"^[\p{L}\p{N} .,'&/()+:;!?@_~=#%\-]{1,200}$"
CONTACT_KINDS = ("EMAIL", "PHONE", "WEBSITE", "LINKEDIN", "GITHUB", "OTHER")


def profile_errors(known: DataFrame, profiles: DataFrame, most_entries: int = 20) -> DataFrame:
    """(subject_id, errors): codes of the fields whose value is not legal; blank ones always are.

    profiles: subject_id, country, currency, time_zone, language, market_region, knowledge_as_of, target_roles, aspirations (arrays), contact (array of kind,
    value). known: (kind, code) of the codes that exist: country, currency and time_zone; countries and currencies in any case.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rows = profiles
    for kind in ("country", "currency", "time_zone"):
        fold = (lambda c: c) if kind == "time_zone" else F.upper
        codes = known.where(F.col("kind") == kind).select(fold(F.col("code")).alias(f"code_{kind}"), F.lit(True).alias(f"has_{kind}")).distinct()
        rows = rows.join(codes, fold(F.trim(kind)) == F.col(f"code_{kind}"), "left")
    line = lambda c, n: ~F.rlike(F.trim(c), F.lit(LINE % n))
    none = F.array().cast("array<string>")
    several = lambda c: F.when((F.size(F.coalesce(F.col(c), none)) > most_entries) | F.exists(F.coalesce(F.col(c), none), lambda x: ~blank(x) & line(x, 200)), c)
    contact = lambda x: ~blank(x["value"]) & (~F.coalesce(F.upper(F.trim(x["kind"])).isin(*CONTACT_KINDS), F.lit(False)) | ~F.rlike(F.trim(x["value"]), F.lit(CONTACT)))
    codes = [F.when(~blank(F.col(k)) & F.col(f"has_{k}").isNull(), k) for k in ("country", "currency", "time_zone")]
    codes.append(F.when(~blank(F.col("language")) & ~F.rlike(F.trim("language"), F.lit("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")), "language"))
    codes.append(F.when(~blank(F.col("market_region")) & line(F.col("market_region"), 40), "market_region"))
    codes.append(F.when(~blank(F.col("knowledge_as_of")) & F.try_to_date(F.trim("knowledge_as_of"), "yyyy-MM-dd").isNull(), "knowledge_as_of"))
    codes += [several("target_roles"), several("aspirations"), F.when(F.coalesce(F.exists("contact", contact), F.lit(False)), "contact")]
    return rows.select("subject_id", F.array_compact(F.array(*codes)).alias("errors"))


def seal_blockers(assets: DataFrame) -> DataFrame:
    """What keeps an intake from being sealed, by subject: assets that wait for consent, assets that are not stored, and the same bytes twice.

    assets: subject_id, asset_id, modality, consent, status, checksum. Links and revoked assets need not be stored. Codes have the assets' ids.
    """
    unstored = F.col("status").isin("AWAITING_UPLOAD", "FAILED") & (F.col("modality") != "LINK") & (F.col("consent") != "REVOKED")
    ids = lambda c: F.array_sort(F.collect_list(F.when(F.coalesce(c, F.lit(False)), F.col("asset_id"))))
    per = assets.groupBy("subject_id").agg(ids(F.col("consent") == "PENDING").alias("pending"), ids(unstored).alias("unstored"))
    same = assets.where((F.col("status") == "STORED") & (F.trim("checksum") != "")).groupBy("subject_id", "checksum").agg(F.array_sort(F.collect_list("asset_id")).alias("ids")).where(F.size("ids") > 1)
    same = same.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("same_bytes:"), F.array_join("ids", ",")))).alias("same"))
    told = lambda c, name: F.when(F.size(c) > 0, F.array(F.concat(F.lit(f"{name}:"), F.array_join(c, ",")))).otherwise(F.array().cast("array<string>"))
    return per.join(same, "subject_id", "left").select("subject_id", F.concat(told("pending", "pending_consent"), told("unstored", "not_stored"), F.coalesce("same", F.array().cast("array<string>"))).alias("blockers"))
