"""Components, redirects and beliefs that follow a delta instead of being computed anew."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.config import Params
from evidentia.operators import scoring
from evidentia.operators.iterate import components, save, saved
from evidentia.sources.tables import overwrite_partitions

#: Subjects of a delta up to which their partitions are named in the plan; beyond, the delta is joined.
NAMED = 1000


def compacted(redirects: DataFrame) -> DataFrame:
    """(entity_id, live_id) for every row of (entity_id, merged_into): where its chain of redirects ends, by pointer doubling.

    A round joins the pointers with themselves, so it halves what is left of each chain, however long; the state is written each round. An entity without a
    redirect, or whose target is unknown, ends its chain. A cycle has no end: its members, and those that lead to it, get the smallest id among them.
    """
    one = save(redirects.select("entity_id", F.coalesce("merged_into", "entity_id").alias("live_id")), "redirects")
    ends = one.select(F.col("entity_id").alias("live_id"), (F.col("live_id") != F.col("entity_id")).alias("goes"))
    first = one.join(ends, "live_id", "left").select("entity_id", "live_id", (~F.coalesce("goes", F.lit(False))).alias("ended"))
    state, told = saved(first, "redirects", n=F.count("*"), open=F.count_if(~F.col("ended")))
    rounds = math.ceil(math.log2(max(2, told["n"] or 0))) + 1
    while told["open"] and rounds:
        onward = state.select(F.col("entity_id").alias("live_id"), F.col("live_id").alias("next_id"), F.col("ended").alias("next_ended"))
        stepped = state.where("NOT ended").join(onward, "live_id").select("entity_id", F.col("next_id").alias("live_id"), F.col("next_ended").alias("ended"))
        state, told = saved(state.where("ended").unionByName(stepped), "redirects", open=F.count_if(~F.col("ended")))
        rounds -= 1
    if not told["open"]:
        return state.select("entity_id", "live_id")
    turning = one.join(state.where("NOT ended").select("entity_id"), "entity_id", "left_semi")
    least = components(turning.select(F.col("entity_id").alias("a"), F.col("live_id").alias("b"))).select(F.col("v").alias("entity_id"), F.col("root").alias("live_id"))
    return state.where("ended").select("entity_id", "live_id").unionByName(least)


def merged_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (v, root) after new edges (a, b): only the roots that these touch are hooked, then the labels follow in one join.

    Vertices of the edges without a label are new. Equal to ``components`` over all edges, as long as a root is its component's smallest vertex.
    """
    to = lambda c: labels.select(F.col("v").alias(c), F.col("root").alias(f"{c}_root"))
    lifted = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    lifted = save(lifted.distinct(), "lifted")
    tops = save(components(lifted).unionByName(lifted.where("a = b").select(F.col("a").alias("v"), F.col("b").alias("root"))).groupBy("v").agg(F.min("root").alias("root")), "tops")
    moved = labels.join(tops.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(tops.join(labels.select("v"), "v", "left_anti"))


def judged_merges(canon: DataFrame, merges: DataFrame) -> DataFrame:
    """(entity_id, target_id, refusal) for each asked merge: null where it stands, else why it is refused.

    SELF, NOT_FOUND, MERGED and TARGET_MERGED (one of the two is merged already), OTHER_TYPE, REPEATED (a further target of one entity; the smallest stands).
    canon: entity_id, entity_type, merged_into.
    """
    side = lambda c, n: canon.select(F.col("entity_id").alias(c), F.col("entity_type").alias(f"{n}_type"), F.col("merged_into").alias(f"{n}_into"), F.lit(True).alias(f"{n}_known"))
    rows = merges.select("entity_id", "target_id").distinct().join(side("entity_id", "own"), "entity_id", "left").join(side("target_id", "other"), "target_id", "left")
    refusal = (
        F.when(F.col("entity_id") == F.col("target_id"), "SELF").when(F.col("own_known").isNull() | F.col("other_known").isNull(), "NOT_FOUND").when(F.col("own_into").isNotNull(), "MERGED")
        .when(F.col("other_into").isNotNull(), "TARGET_MERGED").when(~F.col("own_type").eqNullSafe(F.col("other_type")), "OTHER_TYPE")
    )
    rows = rows.select("entity_id", "target_id", refusal.alias("refusal"))
    first = rows.where("refusal IS NULL").groupBy("entity_id").agg(F.min("target_id").alias("first"))
    return rows.join(first, "entity_id", "left").select("entity_id", "target_id", F.coalesce("refusal", F.when(F.col("target_id") != F.col("first"), "REPEATED")).alias("refusal"))


def merge_entities(mentions: DataFrame, canon: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, entities and the judged merges after a batch of merges (entity_id, target_id), in any order and with any chains.

    Targets are followed to the entity that stays; of a cycle the smallest id stays, and its own merge is refused as CYCLE. The one that stays gains the keys and
    aliases of all that end in it, mentions move there, and redirects point there, those of earlier merges too, so that a chain never grows.
    mentions: claim_id, entity_id, ... canon: entity_id, entity_type, canonical_key, alias_keys, merged_into.
    """
    judged = save(judged_merges(canon, merges), "merges")
    wanted = judged.where("refusal IS NULL").select("entity_id", F.col("target_id").alias("merged_into"))
    targets = wanted.select(F.col("merged_into").alias("entity_id")).join(wanted, "entity_id", "left_anti").distinct().withColumn("merged_into", F.lit(None).cast(wanted.schema["merged_into"].dataType))
    ends = save(compacted(wanted.unionByName(targets)).where("live_id <> entity_id"), "merge-ends")
    stays = judged.join(ends.select("entity_id", F.lit(True).alias("gone")), "entity_id", "left")
    judged = stays.select("entity_id", "target_id", F.coalesce("refusal", F.when(F.col("gone").isNull(), "CYCLE")).alias("refusal"))
    moved = mentions.join(ends, "entity_id", "left").withColumn("entity_id", F.coalesce("live_id", "entity_id")).drop("live_id").distinct().select(*mentions.columns)
    gained = canon.join(ends, "entity_id").select(F.col("live_id").alias("entity_id"), F.explode(F.array_union(F.array("canonical_key"), "alias_keys")).alias("key")).distinct().groupBy("entity_id").agg(F.collect_list("key").alias("gained"))
    later = ends.select(F.col("entity_id").alias("merged_into"), F.col("live_id").alias("further"))
    out = canon.join(gained, "entity_id", "left").join(ends, "entity_id", "left").join(later, "merged_into", "left")
    none = F.array().cast("array<string>")
    aliases = F.array_sort(F.array_except(F.array_union("alias_keys", F.coalesce("gained", none)), F.array("canonical_key")))
    out = out.withColumns({"alias_keys": F.when(F.col("gained").isNotNull(), aliases).otherwise(F.col("alias_keys")), "merged_into": F.coalesce("live_id", "further", "merged_into")})
    return moved, out.select(*canon.columns), judged


# --- beliefs


def store_scores(scores: dict[str, DataFrame], folder: str) -> None:
    """Writes scores by subject; only the partitions of their subjects are replaced."""
    for name, rows in scores.items():
        overwrite_partitions(rows, f"{folder}/{name}")


def stored_scores(spark: SparkSession, folder: str, names: tuple[str, ...] = ("facts", "claims", "trust", "status")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def of_subjects(touched: DataFrame) -> Column | None:
    """A predicate that names the subjects of ``touched``, so that a scan reads only their partitions; None for more than ``NAMED``."""
    some = [r["subject_id"] for r in touched.select("subject_id").distinct().limit(NAMED + 1).collect()]
    return None if len(some) > NAMED else F.col("subject_id").isin(some) if some else F.lit(False)


def rescored(claims: DataFrame, facts: DataFrame, attestors: DataFrame, edges: DataFrame, touched: DataFrame, folder: str, p: Params) -> dict[str, DataFrame]:
    """Scores the subjects of ``touched`` (subject_id) anew and replaces their partitions in the folder of ``store_scores``; others are neither read nor written.

    A subject's beliefs depend on its own claims, facts and edges only, and start from what its claims say, so the result is what a run over all subjects
    gives. claims, facts and edges should be tables partitioned by subject_id. Returns the new scores.
    """
    named = of_subjects(touched)
    own = (lambda df: df.join(touched.select("subject_id").distinct(), "subject_id", "left_semi")) if named is None else lambda df: df.where(named)
    fresh = {name: save(rows, f"rescored-{name}") for name, rows in scoring.score(own(claims), own(facts), attestors, own(edges), p).items()}
    store_scores(fresh, folder)
    return fresh
