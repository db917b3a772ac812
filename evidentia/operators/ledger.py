"""Provenance, review gates and the evidence projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import Params
from evidentia.functions.text import normalize_name


def endorsement_prior(relationship: Column) -> Column:
    return F.when(relationship == "EXPERT", "HIGH").when(relationship.isin("MANAGER", "MENTOR", "PEER", "CLIENT"), "MEDIUM").otherwise("LOW")


def endorser_trust_prior(relationship: Column) -> Column:
    r = relationship
    return F.when(r == "EXPERT", 0.80).when(r.isin("MANAGER", "MENTOR"), 0.65).when(r.isin("PEER", "CLIENT"), 0.60).when(r.isin("INSTITUTION", "PRESS"), 0.70).otherwise(0.50)


def default_prior(content_type: str, base_prior: str, source_class: str, relationship: str) -> Column:
    del content_type
    return F.when(F.col(source_class) == "ENDORSEMENT", endorsement_prior(F.col(relationship))).otherwise(F.col(base_prior))


def claim_provenance(rows: DataFrame) -> DataFrame:
    """Adds prov_source_class, prov_relationship and prov_tier from ``speaker_role`` and the asset's columns; drops interviewers and others."""
    role = F.col("speaker_role")
    relationship = F.coalesce("speaker_relationship", "relationship")
    return rows.where(role.isNull() | role.isin("SUBJECT", "ENDORSER")).withColumns(
        {
            "prov_source_class": F.when(role == "SUBJECT", "SELF").when(role == "ENDORSER", "ENDORSEMENT").otherwise(F.col("source_class")),
            "prov_relationship": F.when(role == "SUBJECT", "SELF").when(role == "ENDORSER", relationship).otherwise(F.col("relationship")),
            "prov_tier": F.when(role == "SUBJECT", "LOW").when(role == "ENDORSER", endorsement_prior(relationship)).otherwise(F.col("tier_seed")),
        }
    )


def needs_decision(p: Params) -> Column:
    """Inferred, or of unknown or low favorability."""
    return F.coalesce(F.col("basis") == "INFERRED", F.lit(False)) | F.coalesce(F.col("favorability") < p.favorability_threshold, F.lit(True))


def review_flags(claims: DataFrame, p: Params) -> DataFrame:
    """The three overlapping parts of a review as flags."""
    need = needs_decision(p)
    return claims.withColumns({"needs_decision": need, "auto_approved": ~need})


def with_reviews(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    return claims.join(reviews.select("claim_id", "decision", "pii_choice", "justification"), "claim_id", "left")


def approved(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Not contested, and sensitive only if opted in."""
    return with_reviews(claims, reviews).where(~F.col("decision").eqNullSafe("CONTESTED") & (~F.col("sensitive") | F.col("pii_choice").eqNullSafe("INCLUDE")))


def review_summary(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    d, held = F.col("decision"), F.col("sensitive") & ~F.col("pii_choice").eqNullSafe("INCLUDE")
    return with_reviews(claims, reviews).groupBy("subject_id").agg(
        F.count("*").alias("total"),
        F.count_if(~d.eqNullSafe("CONTESTED") & ~d.eqNullSafe("SIDECARED")).alias("approved"),
        F.count_if(d == "SIDECARED").alias("sidecared"),
        F.count_if(d == "CONTESTED").alias("rejected"),
        F.count_if(F.col("sensitive") & F.col("pii_choice").eqNullSafe("INCLUDE")).alias("sensitive_included"),
        F.count_if(held).alias("sensitive_held"),
    )


def attestors(claims: DataFrame) -> DataFrame:
    """Adds attestor_key, attestor_kind and trust_prior. Needs speaker_role, speaker, speaker_name and relationship."""
    own = F.col("speaker_role").eqNullSafe("SUBJECT") | F.col("source_class").eqNullSafe("SELF") | F.col("relationship").eqNullSafe("SELF")
    document = F.col("source_class").eqNullSafe("DOCUMENTARY")
    name = F.when(F.trim("speaker_name") != "", normalize_name("speaker_name"))
    asset = F.concat(F.lit("endorser:asset:"), F.col("asset_id"))
    key = F.when(document, F.concat(F.lit("issuer:asset:"), F.col("asset_id"))).when(own, F.concat(F.lit("subject:"), F.col("subject_id")))
    key = key.when(name.isNotNull(), F.concat(F.lit("endorser:name:"), name)).when(F.col("speaker").isNotNull(), F.concat(asset, F.lit(":"), F.col("speaker"))).otherwise(asset)
    return claims.withColumns(
        {
            "attestor_key": key,
            "attestor_kind": F.when(document, "ISSUER").when(own, "SUBJECT").otherwise("ENDORSER"),
            "trust_prior": F.when(document, 0.85).when(own, 0.50).otherwise(endorser_trust_prior(F.coalesce("speaker_relationship", "relationship"))),
        }
    )


def cited_only_approved(citations: DataFrame, approved_claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of approved claims, and how many others each explanation lost."""
    kept = citations.join(approved_claims.select("claim_id"), "claim_id", "left_semi")
    lost = citations.join(approved_claims.select("claim_id"), "claim_id", "left_anti").groupBy("explanation_id").agg(F.count("*").alias("n_dropped"))
    return kept, lost


def evidence_projection(approved_claims: DataFrame, assets: DataFrame) -> dict[str, DataFrame]:
    """What goes on to the evidence graph: claims with their attestor, sources, attestors, explanations, and the citations dropped by subject.

    Attestors and sources are those of the approved claims; of an attestor the claim of the smallest id counts; a source whose asset is unknown stays, with nulls. A claim
    with a justification explains itself and cites its corroborating claims as far as they are approved in the same subject, in their order.
    approved_claims: the columns of ``attestors``, claim_id, justification, corroborating_claim_ids. assets: asset_id, content_type, source_class, relationship, checksum.
    """
    rows = attestors(approved_claims)
    sources = rows.select("subject_id", "asset_id").distinct().join(assets.select("asset_id", "content_type", "source_class", "relationship", "checksum"), "asset_id", "left")
    who = F.struct("attestor_kind", "trust_prior")
    voices = rows.groupBy("subject_id", "attestor_key").agg(F.min_by(who, "claim_id").alias("a")).select("subject_id", "attestor_key", "a.*")
    told = rows.where(F.trim("justification") != "").select("subject_id", "claim_id", F.trim("justification").alias("text"), F.coalesce("corroborating_claim_ids", F.array().cast("array<string>")).alias("wanted"))
    cited = told.select("subject_id", "claim_id", F.posexplode("wanted").alias("place", "cited")).join(rows.select("subject_id", F.col("claim_id").alias("cited")), ["subject_id", "cited"], "left_semi")
    cites = cited.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cited"))), lambda c: c["cited"]).alias("cites"))
    explained = told.join(cites, "claim_id", "left").withColumn("cites", F.coalesce("cites", F.array().cast("array<string>")))
    explained = explained.withColumn("n_dropped", (F.size("wanted") - F.size("cites")).cast("long")).select("subject_id", "claim_id", "text", "cites", "n_dropped")
    return {"claims": rows, "sources": sources, "attestors": voices, "explanations": explained, "dropped": explained.groupBy("subject_id").agg(F.sum("n_dropped").alias("citations_dropped"))}


def eligible_assets(assets: DataFrame) -> DataFrame:
    """Assets that claims may be extracted from: audible or readable, consented, stored."""
    return assets.where(F.col("modality").isin("AUDIO", "VIDEO", "DOCUMENT", "TEXT") & ~F.col("consent").isin("PENDING", "REVOKED") & (F.col("status") == "STORED") & (F.trim("uri") != ""))


def valid_link(url: str) -> Column:
    """http or https, with a host."""
    return F.coalesce(F.try_parse_url(F.col(url), F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url(F.col(url), F.lit("HOST"))) > 0), F.lit(False))


def allowed_extension(filename: str, extensions: tuple[str, ...]) -> Column:
    return F.lower(F.substring_index(F.col(filename), ".", -1)).isin(*extensions) & F.contains(F.col(filename), F.lit("."))


def duplicate_checksums(assets: DataFrame) -> DataFrame:
    """Checksums that stored assets of one subject share."""
    return assets.where((F.col("status") == "STORED") & (F.trim("checksum") != "")).groupBy("subject_id", "checksum").agg(F.count("*").alias("n")).where("n > 1")


def layer_guards(claims: DataFrame, facts: DataFrame, edges: DataFrame, global_nodes: DataFrame) -> DataFrame:
    """Violations of the layer rules: claims without a subject, edges across subjects, text on global nodes."""
    no_subject = claims.where("subject_id IS NULL").agg(F.count("*").alias("n")).select(F.lit("no_subject").alias("guard"), "n")
    a = facts.select(F.col("fact_id").alias("from_fact"), F.col("subject_id").alias("from_subject"))
    b = facts.select(F.col("fact_id").alias("to_fact"), F.col("subject_id").alias("to_subject"))
    across = edges.join(a, "from_fact").join(b, "to_fact").where("from_subject <> to_subject").agg(F.count("*").alias("n")).select(F.lit("cross_subject").alias("guard"), "n")
    text = global_nodes.where("text IS NOT NULL").agg(F.count("*").alias("n")).select(F.lit("text_on_global").alias("guard"), "n")
    return no_subject.unionByName(across).unionByName(text)


def drift_reason(stamp: str, current: dict[str, Column]) -> Column:
    """Which axes of a stamp are superseded, comma-joined; null if none."""
    parts = F.concat_ws(", ", *[F.when(~F.col(f"{stamp}.{axis}").eqNullSafe(now), F.lit(axis)) for axis, now in current.items()])
    return F.when(parts != "", F.concat(F.lit("superseded by "), parts))
