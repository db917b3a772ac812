"""Entity resolution, redirects, merges, splits and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import Params
from evidentia.functions.hashing import sha_prefix
from evidentia.operators.blocks import similar
from evidentia.operators.greedy import first_independent, in_order
from evidentia.operators.incremental import compacted
from evidentia.operators.iterate import save


def resolve_exact(mentions: DataFrame, canon: DataFrame) -> DataFrame:
    """Mentions matched by canonical key, then by alias key, of the same type; ``how`` is EXACT, ALIAS or null.

    A key of a merged entity leads to the one that it was merged into; live entities come first, then the smaller id.
    mentions: claim_id, surface_key, entity_type. canon: entity_id, entity_type, canonical_key, alias_keys, merged_into.
    """
    live = canon.join(compacted(canon.select("entity_id", "merged_into")), "entity_id")
    first = F.min_by("live_id", F.struct(F.col("merged_into").isNotNull(), F.col("entity_id")))
    exact = live.groupBy("entity_type", F.col("canonical_key").alias("surface_key")).agg(first.alias("exact_id"))
    alias = live.select("entity_type", "entity_id", "live_id", "merged_into", F.explode("alias_keys").alias("surface_key")).groupBy("entity_type", "surface_key").agg(first.alias("alias_id"))
    rows = mentions.join(exact, ["entity_type", "surface_key"], "left").join(alias, ["entity_type", "surface_key"], "left")
    return rows.select(*mentions.columns, F.coalesce("exact_id", "alias_id").alias("entity_id"), F.when(F.col("exact_id").isNotNull(), "EXACT").when(F.col("alias_id").isNotNull(), "ALIAS").alias("how"))


def nearest_entities(keys: DataFrame, canon: DataFrame, k: int = 1, floor: float = -2.0) -> DataFrame:
    """For each (entity_type, surface_key, embedding) the k most similar live entities of its type: blocks of keys meet blocks of entities."""
    live = canon.where("merged_into IS NULL").select("entity_type", F.col("entity_id").alias("surface_key"), "embedding")
    order = Window.partitionBy("entity_type", "x").orderBy(F.desc("sim"), "y")
    near = similar(keys, live, floor, k, "entity_type", "surface_key", same=False).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return near.select("entity_type", F.col("x").alias("surface_key"), F.col("y").alias("entity_id"), "sim", "r")


def resolve(mentions: DataFrame, canon: DataFrame, p: Params) -> DataFrame:
    """(entity_type, surface_key, entity_id, how, confidence): EXACT and ALIAS by joins; the rest by the nearest entity, MERGED, or REVIEW in the band below, else MINTED.

    Keys take their turn in order, and a minted one can be met by those after it. That choice is greedy over the graph of keys that are similar enough for
    review, see ``greedy``; a key that a stored entity is near enough to is never minted. mentions also has ``embedding``.
    """
    key = ["entity_type", "surface_key"]
    first = resolve_exact(mentions.drop("embedding"), canon)
    known = first.where("entity_id IS NOT NULL").select(*key, "entity_id", "how", F.lit(1.0).alias("confidence")).distinct()
    keys = mentions.join(first.where("entity_id IS NULL").select(*key).distinct(), key, "left_semi")
    keys = in_order(keys.groupBy(*key).agg(F.min("embedding").alias("embedding")), *key)
    stored = nearest_entities(keys, canon, 1, p.entity_review).select(*key, F.col("entity_id").alias("near_id"), "sim")
    rows = save(keys.select(*key, "n").join(stored, key, "left"), "entity-keys")
    near = similar(keys, keys, p.entity_review, None, "entity_type", "surface_key").where("y < x")
    at = lambda c, n: keys.select("entity_type", F.col("surface_key").alias(c), F.col("n").alias(n))
    pairs = save(near.join(at("x", "later"), ["entity_type", "x"]).join(at("y", "earlier"), ["entity_type", "y"]).select("earlier", "later", "sim"), "entity-pairs")
    kept = first_independent(rows.select("n", F.col("near_id").isNotNull().alias("blocked")), pairs)
    state = rows.join(kept.withColumnRenamed("kept", "minted"), "n")
    own = F.concat(F.lit("ent-"), sha_prefix(F.concat_ws("|", "entity_type", "surface_key"), 16))
    new = state.where("minted").select(F.col("n").alias("earlier"), own.alias("mint_id"))
    met = pairs.join(new, "earlier").groupBy(F.col("later").alias("n")).agg(F.min_by(F.struct("mint_id", "sim"), F.struct(-F.col("sim"), F.col("earlier"))).alias("m"))
    rows = state.join(met, "n", "left")
    to_mint = F.col("near_id").isNull() | (F.col("m.sim") > F.col("sim"))
    best = F.when(to_mint, F.col("m.sim")).otherwise(F.col("sim"))
    linked = F.when(to_mint, F.col("m.mint_id")).otherwise(F.col("near_id"))
    how = F.when(F.col("minted"), "MINTED").when(best >= p.entity_merge, "MERGED").otherwise("REVIEW")
    return known.unionByName(rows.select(*key, F.when(F.col("minted"), own).otherwise(linked).alias("entity_id"), how.alias("how"), F.when(F.col("minted"), 1.0).otherwise(best).alias("confidence")))


def alias_growth(resolved: DataFrame) -> DataFrame:
    """(entity_id, alias_keys): the keys that were found near enough to an entity and become its aliases, so that they are exact the next time."""
    return resolved.where("how = 'MERGED'").groupBy("entity_id").agg(F.array_sort(F.collect_set("surface_key")).alias("alias_keys"))


def grown(canon: DataFrame, resolved: DataFrame, mentions: DataFrame) -> DataFrame:
    """The canon (entity_id, entity_type, canonical_key, alias_keys, merged_into, embedding) after a resolution: minted entities are added, aliases appended."""
    gained = alias_growth(resolved).withColumnRenamed("alias_keys", "gained")
    old = canon.select("entity_id", "entity_type", "canonical_key", "alias_keys", "merged_into", "embedding")
    vectors = mentions.groupBy("entity_type", "surface_key").agg(F.min("embedding").alias("embedding"))
    none = F.array().cast("array<string>")
    minted = resolved.where("how = 'MINTED'").join(vectors, ["entity_type", "surface_key"])
    minted = minted.select("entity_id", "entity_type", F.col("surface_key").alias("canonical_key"), none.alias("alias_keys"), F.lit(None).cast("string").alias("merged_into"), "embedding")
    rows = old.unionByName(minted).join(gained, "entity_id", "left")
    new = F.array_except(F.coalesce("gained", none), F.array("canonical_key"))
    return rows.withColumn("alias_keys", F.when(F.col("gained").isNull(), F.col("alias_keys")).otherwise(F.array_union("alias_keys", new))).drop("gained")


def issuer_upgrade(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documentary claims that mention an organisation or institution are attested by the smallest such entity instead of their asset."""
    issuer = mentions.where(F.col("entity_type").isin("ORG", "INSTITUTION")).groupBy("claim_id").agg(F.min("entity_id").alias("issuer"))
    up = F.when(F.col("source_class") == "DOCUMENTARY", F.concat(F.lit("issuer:"), F.col("issuer")))
    return claims.join(issuer, "claim_id", "left").withColumn("attestor_key", F.coalesce(up, "attestor_key")).drop("issuer")


def split_entities(mentions: DataFrame, canon: DataFrame, chosen: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """What becomes of the mentions of the entities ``chosen`` (entity_id), and these entities with the aliases that stay.

    Each surface key is resolved once as if its entity did not exist: another entity's key or alias (EXACT, ALIAS), the nearest other live entity of the type (MERGED, or
    REVIEW in the band below), else a new entity (MINTED). Keys don't meet each other. The canonical and the empty key stay (KEPT); merged entities can't be split.
    mentions: claim_id, entity_type, surface_key, entity_id, embedding.
    """
    split = canon.join(chosen.select("entity_id").distinct(), "entity_id", "left_semi").where("merged_into IS NULL").select(F.col("entity_id").alias("own_id"), F.col("canonical_key").alias("own_key"))
    own = mentions.join(split, F.col("entity_id") == F.col("own_id")).drop("entity_id")
    stays = (F.col("surface_key") == "") | (F.col("surface_key") == F.col("own_key"))
    key = ["own_id", "entity_type", "surface_key"]
    keys = save(own.where(~stays).groupBy(*key).agg(F.min_by("embedding", "claim_id").alias("embedding")), "split-keys")
    live = save(canon.join(compacted(canon.select("entity_id", "merged_into")), "entity_id").select("entity_id", "live_id", "entity_type", "canonical_key", "alias_keys", "merged_into"), "split-canon")
    named = live.select("entity_type", F.col("canonical_key").alias("surface_key"), "entity_id", "live_id", "merged_into", F.lit("EXACT").alias("how"))
    named = named.unionByName(live.select("entity_type", F.explode("alias_keys").alias("surface_key"), "entity_id", "live_id", "merged_into", F.lit("ALIAS").alias("how")))
    hit = keys.select(*key).join(named, ["entity_type", "surface_key"]).where("entity_id <> own_id AND live_id <> own_id")
    order = F.struct(F.col("how") == "ALIAS", F.col("merged_into").isNotNull(), F.col("entity_id"))
    hit = hit.groupBy(*key).agg(F.min_by(F.struct(F.col("live_id").alias("to"), "how"), order).alias("hit"))
    rest = keys.join(hit, key, "left_anti").withColumn("asked", F.to_json(F.struct("own_id", "surface_key")))
    near = nearest_entities(rest.select("entity_type", F.col("asked").alias("surface_key"), "embedding"), canon, 2, p.entity_review).withColumnRenamed("surface_key", "asked")
    near = rest.select(*key, "asked").join(near.withColumnRenamed("entity_id", "to"), ["entity_type", "asked"]).where("to <> own_id")
    near = near.groupBy(*key).agg(F.max_by(F.struct("to", "sim"), F.struct("sim", -F.col("r"))).alias("near"))
    mint = F.concat(F.lit("ent-"), sha_prefix(F.concat_ws("|", F.lit("split"), "own_id", "entity_type", "surface_key"), 16))
    how = F.coalesce("hit.how", F.when(F.col("near.sim") >= p.entity_merge, "MERGED").when(F.col("near.to").isNotNull(), "REVIEW"), F.lit("MINTED"))
    told = keys.select(*key).join(hit, key, "left").join(near, key, "left").select(*key, F.coalesce("hit.to", "near.to", mint).alias("to"), how.alias("how"))
    out = own.select("claim_id", "own_key", *key).join(told, key, "left")
    out = out.select("claim_id", "entity_type", "surface_key", F.col("own_id").alias("from_id"), F.coalesce("to", "own_id").alias("entity_id"), F.coalesce("how", F.lit("KEPT")).alias("how"))
    kept = out.where("how = 'KEPT'").groupBy(F.col("from_id").alias("entity_id")).agg(F.collect_set("surface_key").alias("kept"))
    entities = canon.join(split.select(F.col("own_id").alias("entity_id")), "entity_id").join(kept, "entity_id", "left")
    return out, entities.withColumn("alias_keys", F.array_intersect("alias_keys", F.coalesce("kept", F.array().cast("array<string>")))).drop("kept")


def search(canon: DataFrame, text: str, entity_type: str | None = None) -> DataFrame:
    """Entities whose name, key or an alias holds the text, all for a blank one."""
    t = F.lit(text.strip().lower())
    rows = canon.where(F.col("entity_type") == entity_type) if entity_type else canon
    hit = F.contains(F.lower("canonical_name"), t) | F.contains("canonical_key", t) | F.exists("alias_keys", lambda a: F.contains(a, t))
    return rows.where(hit) if text.strip() else rows


def shared_entities(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Names that both claims of a pair mention, sorted."""
    m = mentions.groupBy("claim_id").agg(F.collect_set("name").alias("names"))
    side = lambda end: m.select(F.col("claim_id").alias(end), F.col("names").alias(f"n{end}"))
    empty = F.array().cast("array<string>")
    names = F.array_intersect(F.coalesce("na", empty), F.coalesce("nb", empty))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("shared_entities", F.array_sort(names)).drop("na", "nb")


