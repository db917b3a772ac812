"""Rows from what a model replied: claims, mentions, questions and turns. Replies are lenient JSON; what is unknown or malformed is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.jsonio import parsed_rows, unfenced
from evidentia.functions.maths import clip
from evidentia.functions.text import enum
from evidentia.operators.ledger import claim_provenance

CLAIM_TYPES = ("IDENTITY", "EPISODE", "SKILL", "VALUE", "WEAKNESS")
ENTITY_TYPES = ("PERSON", "ORG", "INSTITUTION", "PLACE", "SKILL", "PROJECT", "CREDENTIAL")
MOST_SURFACE = 80
CLAIM = "struct<text:string,claimType:string,speaker:string,mediaStart:string,mediaEnd:string,sourceExcerpt:string,claimedDate:string,confidence:string,basis:string,sensitive:string,favorability:string>"


def _number(value: Column) -> Column:
    return value.try_cast("double")


def claims_of(replies: DataFrame, speakers: DataFrame) -> DataFrame:
    """Claims of extraction replies, with the provenance that the speaker's role gives; interviewers' claims are dropped.

    replies: asset_id, subject_id, reply, source_class, relationship, tier_seed. speakers: asset_id, speaker, speaker_role, speaker_relationship.
    A claim needs a text and a known type; dates that are none, unknown bases and numbers that are none become null or the default.
    """
    rows = replies.select("asset_id", "subject_id", "source_class", "relationship", "tier_seed", F.posexplode(parsed_rows("reply", CLAIM)).alias("seq", "c"))
    rows = rows.select(*rows.columns[:-1], "c.*").withColumn("claim_type", enum("claimType", CLAIM_TYPES)).where((F.trim("text") != "") & F.col("claim_type").isNotNull())
    rows = claim_provenance(rows.join(speakers, ["asset_id", "speaker"], "left"))
    return rows.select(
        "subject_id", "asset_id", F.col("seq").cast("long").alias("seq"), "claim_type", F.trim("text").alias("text"), "speaker", "speaker_role", _number(F.col("mediaStart")).alias("media_start"), _number(F.col("mediaEnd")).alias("media_end"), F.col("sourceExcerpt").alias("source_excerpt"),
        F.date_format(F.try_to_date("claimedDate", "yyyy-MM-dd"), "yyyy-MM-dd").alias("claimed_date"), _number(F.col("confidence")).alias("extraction_confidence"), F.coalesce(enum("basis", ("STATED", "INFERRED")), F.lit("STATED")).alias("basis"),
        F.coalesce(F.lower("sensitive") == "true", F.lit(False)).alias("sensitive"), clip(_number(F.col("favorability")), 0.0, 1.0).alias("favorability"), "prov_source_class", "prov_relationship", "prov_tier",
    )


def mentions_of(replies: DataFrame) -> DataFrame:
    """(batch_id, i, surface, entity_type): surfaces of at most MOST_SURFACE characters and of a known type. replies: batch_id, reply."""
    row = "struct<i:string,issuer:string,mentions:array<struct<surface:string,entityType:string>>>"
    rows = replies.select("batch_id", F.explode(parsed_rows("reply", row)).alias("r")).select("batch_id", F.col("r.i").try_cast("int").alias("i"), F.explode("r.mentions").alias("m")).where("i IS NOT NULL")
    rows = rows.select("batch_id", "i", F.trim("m.surface").alias("surface"), enum("m.entityType", ENTITY_TYPES).alias("entity_type"))
    return rows.where((F.length("surface") > 0) & (F.length("surface") <= MOST_SURFACE) & F.col("entity_type").isNotNull())


def questions_of(replies: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, question) of replies, blank questions and unknown claims dropped; a later question of a claim replaces an earlier one. replies: batch_id, reply."""
    rows = replies.select("batch_id", F.posexplode(parsed_rows("reply", "struct<claimId:string,question:string>")).alias("seq", "r"))
    rows = rows.select("batch_id", "seq", F.trim("r.claimId").alias("claim_id"), F.trim("r.question").alias("question")).where(F.length("question") > 0)
    return rows.groupBy("claim_id").agg(F.max_by("question", F.struct("batch_id", "seq")).alias("question")).join(claims.select("claim_id"), "claim_id", "left_semi")


def draft_errors(turns: str = "turns", most: int = 10) -> Column:
    """Codes of what keeps an array of turns (role, kind, text) from being a draft: number, kinds, ends, blank texts."""
    n = F.coalesce(F.size(turns), F.lit(0))
    first, last = F.try_element_at(F.col(turns), F.lit(1))["role"], F.try_element_at(F.col(turns), F.lit(-1))["role"]
    return F.array_compact(
        F.array(
            F.when((n < 2) | (n > most), F.lit("turns")), F.when(F.exists(turns, lambda t: ~t["kind"].eqNullSafe("TEXT")), F.lit("not_text")), F.when((n > 0) & ~first.eqNullSafe("USER"), F.lit("first_not_user")),
            F.when((n > 0) & ~last.eqNullSafe("MODEL"), F.lit("last_not_model")), F.when(F.exists(turns, lambda t: F.coalesce(F.trim(t["text"]) == "", F.lit(True))), F.lit("blank")),
        )
    )


# --- who speaks

# Roles of speakers, and relations of those who speak about the subject.
ROLES = ("SUBJECT", "ENDORSER", "INTERVIEWER", "OTHER")
RELATIONS = ("SELF", "EXPERT", "PEER", "MANAGER", "MENTOR", "CLIENT", "FAMILY", "INSTITUTION", "PRESS", "UNKNOWN")
#: Confidence from which a proposed attribution is taken without a person, and characters of a speaker's sample.
CONFIDENT, SAMPLE_CHARS = 0.9, 12_000
_ATTRIBUTION, _SPEAKER = "confidence string, speakers map<string,string>", "role string, relationship string, name string"


def speaker_samples(segments: DataFrame, most: int = SAMPLE_CHARS) -> DataFrame:
    """(asset_id, speaker, sample): what each speaker of an asset says, in order, cut to ``most`` characters. segments: asset_id, place, speaker, text."""
    said = segments.where(F.trim("speaker") != "").groupBy("asset_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("s"))
    return said.select("asset_id", "speaker", F.substring(F.array_join(F.transform("s", lambda x: x["text"]), " "), 1, most).alias("sample"))


def attributed(replies: DataFrame, segments: DataFrame, confident: float = CONFIDENT) -> tuple[DataFrame, DataFrame]:
    """Proposed roles (asset_id, speaker, role, relationship, name), and a row an asset: (asset_id, confidence, status).

    Only labels of the transcript and known roles count; a relation is kept for endorsers. An asset with fewer than two speakers, or without a usable role, keeps its own
    provenance (ASSET_LEVEL); a confident attribution goes on (EXTRACTING), another waits for a person (AWAITING_SPEAKER_SELECTION). replies: asset_id, reply.
    """
    labels = segments.where(F.trim("speaker") != "").select("asset_id", "speaker").distinct()
    several = labels.groupBy("asset_id").agg(F.count("*").alias("speakers_n"))
    parsed = replies.select("asset_id", F.from_json(unfenced("reply"), _ATTRIBUTION).alias("r"))
    sure = clip(F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.0)), 0.0, 1.0)
    told = parsed.join(several.where("speakers_n > 1"), "asset_id").select("asset_id", sure.alias("confidence"), F.explode("r.speakers").alias("speaker", "v"))
    told = told.withColumn("v", F.from_json("v", _SPEAKER))  # null where it is no object
    told = told.join(labels, ["asset_id", "speaker"], "left_semi").where(F.upper("v.role").isin(*ROLES))
    role, relation = F.upper("v.role"), F.upper("v.relationship")
    name = F.trim("v.name")
    roles = told.select("asset_id", "confidence", "speaker", role.alias("role"), F.when((role == "ENDORSER") & relation.isin(*RELATIONS), relation).alias("relationship"), F.when(name != "", name).alias("name"))
    gate = roles.groupBy("asset_id").agg(F.max("confidence").alias("confidence"))
    status = F.when(F.col("confidence").isNull(), "ASSET_LEVEL").when(F.col("confidence") >= confident, "EXTRACTING").otherwise("AWAITING_SPEAKER_SELECTION")
    assets = several.select("asset_id").unionByName(replies.select("asset_id")).distinct()
    return roles.drop("confidence"), assets.join(gate, "asset_id", "left").select("asset_id", "confidence", status.alias("status"))
