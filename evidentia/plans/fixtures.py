"""The driver's tables seen as a ledger: the same rows as the CTEs of ``oracle``."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.judging import PRECEDENCE, Replies


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(n: str, *names: str | None):
    """The name at place n modulo their number."""
    k = F.pmod(F.expr(n), F.lit(len(names)))
    out = F
    for i, name in enumerate(names):
        out = out.when(k == i, F.lit(name).cast("string"))
    return out


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").withColumn("q", F.floor(F.col("doc_id") / 20).cast("long"))
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    date = F.expr(
        """CASE q % 6 WHEN 0 THEN NULL WHEN 1 THEN cast(2010 + q % 15 AS string) WHEN 2 THEN concat(2010 + q % 15, '-0', 1 + q % 9)
           ELSE concat(2010 + q % 15, '-0', 1 + q % 9, '-1', q % 9) END"""
    )
    favorability = F.when(F.col("quality") == 0, 0.3).when(F.col("toxic") == 1, 0.45).when(F.col("quality") == 1, 0.8)
    source_class = pick("floor(q / 2)", "SELF", "ENDORSEMENT", "DOCUMENTARY", "PUBLIC_PROFILE", "EVENT_CAPTURE")
    c = d.select(
        "doc_id", "q", F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("claim_id"), F.col("source").alias("subject_id"), F.concat_ws("-", "source", (F.col("q") % 7).cast("string")).alias("asset_id"),
        pick("q", "IDENTITY", "EPISODE", "VALUE", "WEAKNESS", "SKILL").alias("claim_type"), source_class.alias("source_class"), F.when(F.col("q") % 4 == 0, "INFERRED").otherwise("STATED").alias("basis"), favorability.alias("favorability"),
        date.alias("claimed_date"), (F.col("q") % 11 == 0).alias("sensitive"), "text", "lang", pick("q", "SUBJECT", "ENDORSER", "INTERVIEWER", None, None, None, None).alias("speaker_role"),
        pick("q", None, "MANAGER", "EXPERT", None).alias("speaker_relationship"), pick("q", "s1", None).alias("speaker"), pick("q", " Ana  Maria ", None, None, None, None).alias("speaker_name"),
    )
    kind = F.col("source_class")
    return c.withColumns(
        {
            "tier_seed": F.when(kind == "DOCUMENTARY", "HIGH").when(kind == "SELF", "LOW").otherwise("MEDIUM"),
            "relationship": F.when(kind == "SELF", "SELF").when(kind == "ENDORSEMENT", "PEER").when(kind == "DOCUMENTARY", "INSTITUTION").otherwise("UNKNOWN"),
            "attestor_key": F.when(kind == "SELF", F.concat(F.lit("subject:"), "subject_id")).when(kind == "DOCUMENTARY", F.concat(F.lit("issuer:asset:"), "asset_id")).otherwise(F.concat(F.lit("endorser:"), "lang")),
            "explained": F.col("q") % 5 == 2,
            "exemplar_claim_id": F.lit(None).cast("string"),
            "mention_types": F.when(F.col("q") % 3 == 0, F.array(F.lit("ORG"))).when(F.col("q") % 3 == 1, F.array(F.lit("PLACE"), F.lit("SKILL"))).otherwise(F.array().cast("array<string>")),
        }
    )


def reviews(claims_: DataFrame) -> DataFrame:
    rows = claims_.select("claim_id", pick("q", "CONTESTED", "SIDECARED", "APPROVED", None, None, None, None, None, None).alias("decision"), pick("q", "INCLUDE", "EXCLUDE").alias("pii_choice"), F.lit(None).cast("string").alias("justification"))
    return rows.where("decision IS NOT NULL")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).select("doc_id", "subject_id", "claim_id")
    return c.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("subject_id", "claim_id", "embedding")


def explanations(claims_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explanations explain one claim of their group and cite the next."""
    e = claims_.where("q % 10 = 3").select("subject_id", F.concat(F.lit("e"), F.col("q").cast("string")).alias("explanation_id"), "claim_id")
    c = claims_.where("q % 10 = 4").select("subject_id", F.concat(F.lit("e"), (F.col("q") - 1).cast("string")).alias("explanation_id"), "claim_id")
    return e, c


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims of customers that mention suppliers."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").select("subject_id", F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("entity_id"))


def _joined(a: pa.Array, b: pa.Array) -> list[bytes]:
    """The bytes of a#b, cut out of one buffer: faster by far than a Python text of every id."""
    both = pc.binary_join_element_wise(a.cast(pa.large_binary()), b.cast(pa.large_binary()), pa.scalar(b"#", pa.large_binary()))
    at, data = np.frombuffer(both.buffers()[1], np.int64)[: len(both) + 1].tolist(), both.buffers()[2].to_pybytes()
    return [data[x:y] for x, y in zip(at, at[1:], strict=False)]


def judge(pairs: pa.RecordBatch, k: int = 5) -> Replies:
    """Scripted replies: relation and confidence from a hash of the pair and the sample's number; a sixth of the pairs is contradicted by most."""
    ids = _joined(pairs["a"], pairs["b"])
    ends = ["".encode(), *[f"#{i}".encode() for i in range(k)]]
    digests = np.frombuffer(b"".join([sha256(pair + end).digest() for pair in ids for end in ends]), np.uint8).reshape(len(ids), k + 1, 32).astype(np.int32)
    against = (digests[:, :1, 0] % 6 == 0) & (np.arange(k) < 4)
    h = digests[:, 1:, 0] * 256 + digests[:, 1:, 1]
    neutral, repeats, corroborates, contradicts = range(len(PRECEDENCE))
    relation = np.where(against, contradicts, np.array([repeats] * 2 + [corroborates] * 3 + [contradicts] + [neutral] * 4)[h % 10])
    confidence = np.where(against, 0.8 + h % 20 / 100, 0.5 + h % 50 / 100)
    rationale = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(k), len(ids)), pa.int32()), [f"r{i}" for i in range(k)])
    note = pa.DictionaryArray.from_arrays(pa.array(np.zeros(h.size, np.int32), mask=(h % 4 > 0).ravel()), ["same span"])
    return Replies(relation, confidence, rationale, note, np.where(h % 3 > 0, h % 3 == 1, -1))


def with_context(verdicts: DataFrame) -> DataFrame:
    """Half of the verdicts were judged again with context, which turns a third of these neutral."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("#", "b", "a"), 256), 1, 2), 16, 10).cast("int")
    told = h % 2 == 0
    return verdicts.withColumns({"ctx_judged": told, "ctx_relation": F.when(told, F.when(h % 3 == 0, "NEUTRAL").otherwise("CONTRADICTS")), "ctx_confidence": F.when(told, F.col("confidence") * 0.8), "ctx_explanation_relevant": F.col("explanation_relevant")})
