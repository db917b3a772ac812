"""State transitions and incremental bookkeeping as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (status, action) to the next status.
TRANSITIONS = {
    ("DRAFT", "SUBMIT"): "SUBMITTED", ("NEEDS_CHANGES", "SUBMIT"): "SUBMITTED", ("SUBMITTED", "APPROVE"): "APPROVED", ("SUBMITTED", "REQUEST_CHANGES"): "NEEDS_CHANGES",
    ("DRAFT", "ARCHIVE"): "ARCHIVED", ("SUBMITTED", "ARCHIVE"): "ARCHIVED", ("APPROVED", "ARCHIVE"): "ARCHIVED", ("NEEDS_CHANGES", "ARCHIVE"): "ARCHIVED",
}


def next_status(status: str, action: str) -> Column:
    """The status after an action; null where the action isn't allowed."""
    key = F.concat_ws(">", status, action)
    return F.try_element_at(F.create_map(*[F.lit(x) for (s, a), n in TRANSITIONS.items() for x in (f"{s}>{a}", n)]), key)


#: The phases of a run in order; from the one before publishing only an action moves it on.
PHASES = ("PENDING", "SYNCING", "RESOLVING_ENTITIES", "EMBEDDING", "MATCHING", "JUDGING", "ASSEMBLING", "SCORING", "AWAITING_REVIEW", "PUBLISHING", "PUBLISHED")
ENDED = ("PUBLISHED", "FAILED", "SUPERSEDED")


def polled(runs: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Runs after one poll: stuck ones fail, ones whose phase is done or that wait to start go on, ended and parked ones stay.

    runs: run_id, status, phase_since, failed_phase, phase_done, phase_failed (boolean).
    """
    s, parked = F.col("status"), F.col("status").isin(*ENDED, "AWAITING_REVIEW")
    late = ~parked & (s != "PENDING") & (F.col("phase_since") + F.make_interval(mins=F.lit(minutes)) <= as_of)
    lost = ~parked & (F.coalesce(late, F.lit(False)) | F.coalesce("phase_failed", F.lit(False)))
    onward = ~parked & ~lost & ((s == "PENDING") | F.coalesce("phase_done", F.lit(False)))
    nxt = F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(PHASES, PHASES[1:], strict=False) for x in pair]), s)
    return runs.select("run_id", F.when(lost, "FAILED").when(onward, nxt).otherwise(s).alias("status"), F.when(lost | onward, as_of).otherwise(F.col("phase_since")).alias("phase_since"), F.when(lost, s).otherwise(F.col("failed_phase")).alias("failed_phase"))


def acted(runs: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Runs after RETRY (failed ones resume where they failed), PUBLISH (parked ones) and RERUN (published or parked: a parked one is superseded).

    runs: run_id, subject_id, status, failed_phase. actions: run_id, action. A column ``accepted`` says whether the action applies, null without one; a
    rerun also gives a new pending run, ``<run_id>+``, unless the subject has another run at work.
    """
    at_work = runs.where(~F.col("status").isin(*ENDED)).groupBy("subject_id").agg(F.collect_set("run_id").alias("busy"))
    rows = runs.join(actions, "run_id", "left").join(at_work, "subject_id", "left")
    s, a = F.col("status"), F.col("action")
    others = F.size(F.array_except(F.coalesce("busy", F.array().cast("array<string>")), F.array("run_id"))) > 0
    ok = ((a == "RETRY") & (s == "FAILED")) | ((a == "PUBLISH") & (s == "AWAITING_REVIEW")) | ((a == "RERUN") & s.isin("PUBLISHED", "AWAITING_REVIEW") & ~others)
    rows = rows.withColumn("accepted", F.when(a.isNotNull(), F.coalesce(ok, F.lit(False))))
    to = F.when(a == "RETRY", F.coalesce("failed_phase", F.lit("PENDING"))).when(a == "PUBLISH", "PUBLISHING").when(s == "AWAITING_REVIEW", "SUPERSEDED").otherwise(s)
    done = rows.select("run_id", "subject_id", F.when(F.col("accepted"), to).otherwise(s).alias("status"), F.when(F.col("accepted") & (a == "RETRY"), F.lit(None)).otherwise(F.col("failed_phase")).alias("failed_phase"), "accepted")
    fresh = rows.where(F.col("accepted") & (a == "RERUN")).select(F.concat("run_id", F.lit("+")).alias("run_id"), "subject_id", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("failed_phase"), F.lit(None).cast("boolean").alias("accepted"))
    return done.unionByName(fresh)


def settled_contradictions(edges: DataFrame, actions: DataFrame, rejudged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after actions on contradictions, and the pairs whose cached verdicts are overridden.

    CONFIRM keeps a proposed edge as confirmed; DISMISS deletes it and overrides its pairs; REJUDGE gives it the context verdict of its most confident
    pair, and explains it if any pair's explanation was found relevant. Then scores are computed anew from these edges.
    edges: subject_id, from_fact, to_fact, relation, review_status, explained, ctx_relation, ctx_confidence, contributing_pairs ("a↔b"). actions: subject_id,
    from_fact, to_fact, action. rejudged: a, b, confidence, ctx_relation, ctx_confidence, explanation_relevant.
    """
    key = ["subject_id", "from_fact", "to_fact"]
    rows = edges.join(actions.withColumn("relation", F.lit("CONTRADICTS")), [*key, "relation"], "left")
    gone = F.col("action") == "DISMISS"
    pairs = rows.where("action IN ('DISMISS', 'REJUDGE')").select(*key, "action", F.explode("contributing_pairs").alias("p")).select(*key, "action", F.split("p", "↔")[0].alias("a"), F.split("p", "↔")[1].alias("b"))
    best = F.max_by(F.struct("ctx_relation", "ctx_confidence"), F.struct("confidence", "a", "b"))
    told = pairs.where("action = 'REJUDGE'").join(rejudged, ["a", "b"]).groupBy(*key).agg(best.alias("best"), F.bool_or(F.coalesce("explanation_relevant", F.lit(False))).alias("relevant"))
    kept = rows.where(~F.coalesce(gone, F.lit(False))).join(told.withColumn("relation", F.lit("CONTRADICTS")), [*key, "relation"], "left")
    confirm = (F.col("action") == "CONFIRM") & (F.col("review_status") == "PROPOSED")
    new = F.col("best").isNotNull()
    out = kept.select(
        *[c for c in edges.columns if c not in ("review_status", "explained", "ctx_relation", "ctx_confidence", "with_context")], F.when(confirm, "CONFIRMED").otherwise(F.col("review_status")).alias("review_status"),
        F.when(new, F.col("relevant")).otherwise(F.col("explained")).alias("explained"), F.when(new, F.col("best.ctx_relation")).otherwise(F.col("ctx_relation")).alias("ctx_relation"), F.when(new, F.col("best.ctx_confidence")).otherwise(F.col("ctx_confidence")).alias("ctx_confidence"),
        *([F.when(new, True).otherwise(F.col("with_context")).alias("with_context")] if "with_context" in edges.columns else []),
    )
    return out.select(*edges.columns), pairs.where("action = 'DISMISS'").select("a", "b").distinct()


def looked_up(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queued pairs with the verdict of their own variant; a pair without one, or with one that has no relation, is ESCALATED, never neutral."""
    rows = queue.join(verdicts.select("a", "b", "with_context", "relation", "confidence"), ["a", "b", "with_context"], "left")
    return rows.select("a", "b", "with_context", F.when(F.col("relation").isNull(), "ESCALATED").otherwise("JUDGED").alias("status"), "relation", F.when(F.col("relation").isNotNull(), F.col("confidence")).alias("confidence"))


def swept(advocates: DataFrame, serves: DataFrame, deployments: DataFrame) -> DataFrame:
    """What a sweep does, both ways: REPAIR advocates that are live without their deployment, TEAR_DOWN deployments that nobody claims.

    advocates: subject_id, state, deployment_id, occupying. serves: deployment_id of operators' own. deployments: deployment_id.
    """
    lost = advocates.where("state = 'LIVE' AND deployment_id IS NOT NULL").join(deployments.select("deployment_id"), "deployment_id", "left_anti")
    claimed = advocates.where("occupying").select("deployment_id").unionByName(serves.select("deployment_id")).distinct()
    orphans = deployments.select("deployment_id").join(claimed, "deployment_id", "left_anti")
    return lost.select(F.lit("REPAIR").alias("action"), "subject_id", "deployment_id").unionByName(orphans.select(F.lit("TEAR_DOWN").alias("action"), F.lit(None).cast(advocates.schema["subject_id"].dataType).alias("subject_id"), "deployment_id"))


# What profile fields declare: field to claim type, declared type and sentence.
DECLARED = {
    "target_roles": ("IDENTITY", "TARGET_ROLE", "Target role: {}."), "target_seniority": ("IDENTITY", "TARGET_SENIORITY", "Targeting {}-level roles."), "aspirations": ("VALUE", "STATED_ASPIRATION", "{}"),
    "stated_preferences": ("VALUE", "STATED_TRACK_PREFERENCE", "{}"), "do_not_discuss": ("WEAKNESS", "BOUNDARY", "Prefers not to discuss {}."),
}
RELOCATION = ("Open to relocating for the right role.", "Not looking to relocate.")


def declared_claims(profiles: DataFrame) -> DataFrame:
    """(subject_id, claim_id, claim_type, declared_type, text, sensitive) of what profiles declare; ids come from the content, so a reworded one is another.

    profiles: subject_id, the fields of DECLARED (arrays, target_seniority a string), open_to_relocation, contact (array of kind, value, shareable): only
    shareable contacts become claims, sensitive ones.
    """
    entry = lambda kind, declared, text, sensitive: F.struct(F.lit(kind).alias("claim_type"), F.lit(declared).alias("declared_type") if isinstance(declared, str) else declared.alias("declared_type"), text.alias("text"), F.lit(sensitive).alias("sensitive"))

    def said(name: str) -> Column:
        kind, declared, sentence = DECLARED[name]
        before, after = sentence.split("{}")
        items = F.array_compact(F.array(name)) if name == "target_seniority" else F.coalesce(F.col(name), F.array().cast("array<string>"))
        items = F.filter(items, lambda x: F.trim(x) != "")
        tidy = (lambda x: F.lower(F.rtrim(x, F.lit(".")))) if declared == "BOUNDARY" else (lambda x: x)
        return F.transform(items, lambda x: entry(kind, declared, F.concat(F.lit(before), tidy(x), F.lit(after)), False))

    moving = F.when(F.col("open_to_relocation").isNotNull(), F.array(entry("IDENTITY", "RELOCATION_STANCE", F.when(F.col("open_to_relocation"), RELOCATION[0]).otherwise(RELOCATION[1]), False)))
    shared = F.transform(F.filter("contact", lambda c: c["shareable"]), lambda c: entry("IDENTITY", F.concat(F.lit("CONTACT_"), F.upper(c["kind"])), F.concat(F.initcap(c["kind"]), F.lit(": "), c["value"]), True))
    none = F.array().cast("array<struct<claim_type:string,declared_type:string,text:string,sensitive:boolean>>")
    parts = [F.coalesce(x, none) for x in (*map(said, DECLARED), moving, shared)]
    rows = profiles.select("subject_id", F.explode(F.concat(*parts)).alias("e")).select("subject_id", "e.*")
    key = F.concat_ws("|", "subject_id", "declared_type", F.trim("text"))
    rows = rows.withColumn("claim_id", F.concat(F.lit("decl-"), F.substring(F.sha2(key, 256), 1, 24)))
    # dealt by id first, or each task would sort all that its part of the profiles declares to drop duplicates there
    return rows.repartition("claim_id").dropDuplicates(["claim_id"]).select("subject_id", "claim_id", "claim_type", "declared_type", "text", "sensitive")


def materialised(profiles: DataFrame, existing: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What sealing does to declared claims (claim_id, action CREATE, KEEP or DELETE), and the sensitive ones that get an opt-in since they have no review."""
    wanted = declared_claims(profiles)
    return reconcile(wanted, existing, "claim_id"), wanted.where("sensitive").join(reviews.select("claim_id"), "claim_id", "left_anti").select("claim_id", "subject_id", F.lit("INCLUDE").alias("pii_choice"))


def pending(plans: DataFrame, live: DataFrame, keys: tuple[str, ...] = ("plan_id", "prompt_hash")) -> DataFrame:
    """Plans without a live example of the same hashes."""
    return plans.join(live.select(*keys), list(keys), "left_anti")


def cached_generations(plans: DataFrame, archive: DataFrame, keys: tuple[str, ...] = ("plan_id", "prompt_hash")) -> DataFrame:
    """The newest archived example of each plan with the same hashes."""
    newest = archive.groupBy(*keys).agg(F.max_by("example_id", F.struct("updated_at", "example_id")).alias("example_id"))
    return plans.join(newest, list(keys))


def latest_judgments(examples: DataFrame, judgments: DataFrame) -> DataFrame:
    """Each example with its latest judgment of the same turns, of several with one time and id the greatest verdict; null without one."""
    newest = judgments.groupBy("example_id", "turns_hash").agg(F.max_by("verdict", F.struct("created_at", "judgment_id", "verdict")).alias("verdict"))
    return examples.join(newest, ["example_id", "turns_hash"], "left")


def bulk_outcomes(judged: DataFrame) -> DataFrame:
    """approved, not_pass, unjudged and sent_back of a bulk approval."""
    v = F.col("verdict")
    return judged.agg(F.count_if(v == "PASS").alias("approved"), F.count_if(v == "BORDERLINE").alias("not_pass"), F.count_if(v.isNull()).alias("unjudged"), F.count_if(v == "FAIL").alias("sent_back"))


def reconcile(desired: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """CREATE, KEEP or DELETE for every key of either side."""
    d, e = desired.select(key).distinct().withColumn("want", F.lit(True)), existing.select(key).distinct().withColumn("have", F.lit(True))
    return d.join(e, key, "full").select(key, F.when(F.col("have").isNull(), "CREATE").when(F.col("want").isNull(), "DELETE").otherwise("KEEP").alias("action"))


def upload_outcome(max_bytes: int, stale_hours: int, as_of: Column) -> Column:
    """STORED, FAILED or the status as it is, of a pending upload. Needs status, found_bytes, created_at."""
    late = F.col("created_at") < as_of - F.make_interval(hours=F.lit(stale_hours))
    waiting = F.col("status") == "PENDING"
    return F.when(waiting & (F.col("found_bytes") > max_bytes), "FAILED").when(waiting & F.col("found_bytes").isNotNull(), "STORED").when(waiting & late, "FAILED").otherwise(F.col("status"))


def stuck(runs: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    return runs.where(~F.col("phase").isin("DONE", "FAILED") & (F.col("phase_since") + F.make_interval(mins=F.lit(minutes)) < as_of))


def first_claimers(claims: DataFrame, key: str, at: str, who: str) -> DataFrame:
    """The first row of each key: a handle goes to whoever asked first, the smaller id of equals."""
    order = Window.partitionBy(key).orderBy(at, who)
    return claims.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def question_draw(claims: DataFrame, asked: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Unfavorable claims that no question covers yet; unknown favorability isn't unfavorable."""
    done = asked.select(F.explode("claim_ids").alias("claim_id"))
    return claims.where(F.col("favorability") < threshold).join(done, "claim_id", "left_anti")


#: What may be done with a question in which status, and what it becomes.
QUESTION_MOVES = {("OPEN", "ANSWER"): "ANSWERED", ("OPEN", "SKIP"): "SKIPPED", ("SKIPPED", "REOPEN"): "OPEN"}


def moved_questions(questions: DataFrame, actions: DataFrame) -> DataFrame:
    """Questions after an action each: status, answer, and ``accepted``, null without an action. An answer needs words.

    questions: question_id, subject_id, status, answer, claim_ids. actions: question_id, action, answer_text.
    """
    rows = questions.join(actions, "question_id", "left")
    key = F.concat_ws(">", "status", "action")
    to = F.try_element_at(F.create_map(*[F.lit(x) for (s, a), n in QUESTION_MOVES.items() for x in (f"{s}>{a}", n)]), key)
    ok = to.isNotNull() & ((F.col("action") != "ANSWER") | (F.coalesce(F.trim("answer_text"), F.lit("")) != ""))
    rows = rows.withColumn("accepted", F.when(F.col("action").isNotNull(), F.coalesce(ok, F.lit(False))))
    done = F.coalesce("accepted", F.lit(False))
    return rows.select("question_id", "subject_id", F.when(done, to).otherwise(F.col("status")).alias("status"), F.when(done & (F.col("action") == "ANSWER"), F.trim("answer_text")).otherwise(F.col("answer")).alias("answer"), "claim_ids", "accepted", "action")


def answered_reviews(moved: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews after the accepted answers among ``moved_questions``: every linked claim is sidecared with the answer; an opt-in of before stays."""
    said = moved.where("accepted AND action = 'ANSWER'").select(F.explode("claim_ids").alias("claim_id"), F.col("answer").alias("said")).groupBy("claim_id").agg(F.max("said").alias("said"))
    rows = reviews.select("claim_id", "decision", "pii_choice", "justification").join(said, "claim_id", "full")
    told = F.col("said").isNotNull()
    return rows.select("claim_id", F.when(told, "SIDECARED").otherwise(F.col("decision")).alias("decision"), "pii_choice", F.coalesce("said", "justification").alias("justification"))


def digests(subjects: DataFrame, sent: DataFrame) -> DataFrame:
    """What to tell each subject today, the most urgent first: help for a speaker, claims ready, questions open; nothing twice a day."""
    what = F.when(F.col("parked") > 0, "SPEAKER_HELP").when(F.col("ready") > 0, "CLAIMS_READY").when(F.col("open_questions") > 0, "QUESTIONS")
    return subjects.withColumn("digest", what).where("digest IS NOT NULL").join(sent.select("subject_id", "day"), ["subject_id", "day"], "left_anti")


def speaker_segments(words: DataFrame, key: str = "conv_id", order: str = "seq", label: str = "speaker", text: str = "word") -> DataFrame:
    """Runs of one speaker; a word without a label continues the last one."""
    w = Window.partitionBy(key).orderBy(order)
    rows = words.withColumn("who", F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("run", F.sum(F.when(F.lag("who").over(w).eqNullSafe(F.col("who")) & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w))
    out = rows.groupBy(key, "run").agg(F.first("who").alias("speaker"), F.min(order).alias("start"), F.max(order).alias("end"), F.array_sort(F.collect_list(F.struct(order, text))).alias("t"))
    return out.select(key, F.col("run").cast("long").alias("run"), "speaker", "start", "end", F.array_join(F.transform("t", lambda x: x[text]), " ").alias("text"))


def next_versions(versions: DataFrame) -> DataFrame:
    """family, version (v<major>.<minor>) to the next minor of each major."""
    rows = versions.select("family", F.regexp_extract("version", r"^v(\d+)\.(\d+)$", 1).try_cast("int").alias("major"), F.regexp_extract("version", r"^v(\d+)\.(\d+)$", 2).try_cast("int").alias("minor"))
    return rows.where("major IS NOT NULL").groupBy("family", "major").agg((F.max("minor") + 1).alias("minor")).withColumn("next_version", F.format_string("v%d.%d", "major", "minor"))
