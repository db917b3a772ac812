"""Planning of training conversations: voicing rows, hedging, allocation, near-duplicate removal, caps, subsets, hold-out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import Params
from evidentia.functions.hashing import sha_prefix
from evidentia.functions.text import jaccard, mentions_keyword, word_shingles
from evidentia.operators.greedy import first_independent, in_order
from evidentia.operators.iterate import save

# Hedge levels by rising caution; row: (voice level, may be voiced).
HEDGES = ("ASSERTIVE", "MEASURED", "HEDGED", "RESERVED", "GAP")
ROW_HEDGE = {1: "ASSERTIVE", 2: "ASSERTIVE", 3: "HEDGED", 4: "HEDGED", 5: "GAP", 6: "HEDGED", 7: "MEASURED", 8: "ASSERTIVE", 12: "GAP"}


def voicing_row(p: Params) -> Column:
    """The first matching row of the decision table. Needs sensitive, confirmed_unexplained, score, score_bare, claim_type, conflict, explained, independence."""
    score = F.coalesce("score", F.lit(0.0))
    bare, conflict, independence = F.coalesce("score_bare", score), F.coalesce("conflict", F.lit(0.0)), F.coalesce("independence", F.lit(0.0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    high = F.when(conflict <= p.conflict_epsilon, 1).when(yes("explained"), 2).otherwise(12)
    return (
        F.when(yes("sensitive"), 8)
        .when(yes("confirmed_unexplained"), 5)
        .when((score > 0) & (score - bare >= p.score_bare_gap), 6)
        .when(F.col("claim_type").eqNullSafe("WEAKNESS") & (score >= p.tier_high), 7)
        .when(score >= p.tier_high, high)
        .when(score >= p.tier_medium, F.when(independence >= p.independence_high, 4).otherwise(3))
        .otherwise(12)
    )


def hedge_of(row: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROW_HEDGE.items() for x in kv]), row)


def hedge_rank(hedge: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, HEDGES)), hedge)


def voiced(claims: DataFrame, p: Params) -> DataFrame:
    rows = claims.withColumn("row_id", voicing_row(p))
    return rows.withColumns({"hedge": hedge_of(F.col("row_id")), "sft_eligible": F.col("row_id") != 5})


def kb_posture(p: Params) -> Column:
    """ACKNOWLEDGE_ONLY, ASSERT or HEDGE of a voiced claim."""
    score = F.coalesce("score", F.lit(0.0))
    return F.when((score < p.tier_medium) | F.coalesce("confirmed_unexplained", F.lit(False)) | ~F.col("sft_eligible"), "ACKNOWLEDGE_ONLY").when(score >= p.tier_high, "ASSERT").otherwise("HEDGE")


def kb_lines(rows: DataFrame, p: Params, most: int = 400) -> DataFrame:
    """One line a claim, the smallest ``most`` ids of each subject."""
    order = Window.partitionBy("subject_id").orderBy("claim_id")
    text = F.concat(F.lit('"'), "text", F.lit('" — '), F.replace(kb_posture(p), F.lit("_"), F.lit("-")), F.lit("; score "), F.format_string("%.2f", F.coalesce("score", F.lit(0.0))))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("subject_id", "claim_id", "place", text.alias("line"))


def group_voice(rows: DataFrame, group: str = "fact_id") -> DataFrame:
    """The most cautious voice among a group's eligible members, the smallest id of equals; row 5 if no member is eligible."""
    ok = F.col("sft_eligible")
    best = F.min_by(F.struct("row_id", "hedge"), F.when(ok, F.struct(-hedge_rank(F.col("hedge")), F.col("claim_id"))))
    out = rows.groupBy("subject_id", group).agg(best.alias("v"), F.array_sort(F.collect_list(F.when(ok, F.col("claim_id")))).alias("voiced_ids"), F.count_if(~ok).alias("n_dropped"))
    return out.select("subject_id", group, F.coalesce("v.row_id", F.lit(5)).alias("row_id"), F.coalesce("v.hedge", F.lit("GAP")).alias("hedge"), "voiced_ids", "n_dropped")


#: Conclusions of a situational chain by rising caution; there is no flat assertion.
PHRASES = ("very likely", "it's reasonable to expect")


def situational_hedge(chain: DataFrame, p: Params, group: str = "chain_id") -> DataFrame:
    """What may be concluded from each chain of supporting facts.

    chain: subject_id, ``group``, fact_id, belief, independent, anchored, conflicted. The floors hold for facts that are all believed at least
    at the medium tier, with two independent or one anchored. Conflicted facts are dropped if the others hold the floors; else they stay,
    the tension is named and the phrase is the cautious one; else the floors are unmet. Unconflicted chains are as sure as their weakest.
    """
    clean, low = ~F.col("conflicted"), F.min
    floors = lambda of: (F.count_if(of) > 0) & (low(F.when(of, F.col("belief"))) >= p.tier_medium) & ((F.count_if(of & F.col("independent")) >= 2) | (F.count_if(of & F.col("anchored")) > 0))
    ids = lambda of: F.array_sort(F.collect_list(F.when(of, F.col("fact_id"))))
    got = chain.groupBy("subject_id", group).agg(
        floors(clean).alias("without"), floors(F.lit(True)).alias("with_all"), low(F.when(clean, F.col("belief"))).alias("weakest"), ids(F.col("conflicted")).alias("conflicted_ids"),
        ids(clean).alias("clean_ids"), F.count("*").alias("n_facts"), F.count_if("independent").alias("n_independent"), F.count_if("anchored").alias("n_anchored"),
    )
    none = F.array().cast("array<string>")
    named = ~F.col("without") & F.col("with_all") & (F.size("conflicted_ids") > 0)
    phrase = F.when(F.col("without"), F.when(F.col("weakest") >= p.tier_high, PHRASES[0]).otherwise(PHRASES[1])).when(named, PHRASES[1])
    return got.select(
        "subject_id", group, (F.col("without") | named).alias("floors_met"), phrase.alias("phrase"), F.when(F.col("without"), F.col("conflicted_ids")).otherwise(none).alias("dropped"), F.when(named, F.col("conflicted_ids")).otherwise(none).alias("named_tension"),
        F.when(F.col("without"), F.col("clean_ids")).when(named, F.array_sort(F.array_union("clean_ids", "conflicted_ids"))).otherwise(none).alias("surviving"), "n_facts", "n_independent", "n_anchored",
    )


def violation_class() -> Column:
    """The violation that a plan's rejected answer shows, most specific rule first. Needs category and row_id."""
    row, cat = F.col("row_id"), F.col("category")
    return (
        F.when((cat == "META") | (row == 14), "IMPERSONATION").when(row.isin(13, 8), "BOUNDARY_BREACH").when(row.isin(11, 7), "DENIAL")
        .when(cat == "SITUATIONAL", "UNHEDGED_SPECULATION").when(row.isin(6, 2), "CONTEXT_STRIPPED").otherwise("OVERCLAIM")
    )


def question_class(text: str, classes: dict[str, tuple[str, ...]]) -> Column:
    """The first class, in order, one of whose keywords stands in the question as a word; null if none."""
    out = F
    for name, words in classes.items():
        out = out.when(mentions_keyword(text, words), name)
    return out


def allocate(candidates: DataFrame, p: Params) -> DataFrame:
    """Of each fact-driven category the first ceil(weight * all fact-driven) candidates by place; other categories whole.

    candidates: subject_id, category, place.
    """
    total = sum(p.mix.values())
    weight = F.lit(None).cast("double")
    for name, w in p.mix.items():
        weight = F.when(F.col("category") == name, w / total if total else 0.0).otherwise(weight)
    sizes = candidates.where(F.col("category").isin(*p.mix)).groupBy("subject_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("subject_id", "category").orderBy("place")
    rows = candidates.join(sizes, "subject_id", "left").withColumns({"w": weight, "r": F.row_number().over(order)})
    return rows.where(F.col("w").isNull() | (F.col("r") <= F.ceil(F.col("w") * F.col("n")))).drop("w", "r", "n")


def similar_sets(sets: DataFrame, least: float, group: str = "subject_id", key: str = "place", items: str = "s", shelved: bool = False) -> DataFrame:
    """(group, i, j, similarity) of pairs i < j of non-empty sets in a group with at least this Jaccard similarity.

    Two such sets share one of their rarest items: of a set of n the n - ceil(least n) + 1 rarest. Only those are joined, so that an item
    that most sets have makes no pairs. Equal sets are joined as one, under their smallest key, and only the result is told for each of them. Where ``least`` is so low that
    many pairs share a rare item, ``shelved`` counts all items instead, see ``_on_shelves``: no pair travels then but those of the result.
    """
    rows = sets.where(F.size(items) > 0).select(group, key, items, F.sha2(F.to_json(F.array_sort(items)), 256).alias("class"))
    first = rows.groupBy(group, "class").agg(F.min(key).alias("rep"))
    of = save(rows.select(group, key, "class").join(first, [group, "class"]).select(group, key, "rep"), "equal-sets")
    rows = rows.join(of.where(F.col(key) == F.col("rep")).select(group, key), [group, key], "left_semi").select(group, key, items)
    near = (_on_shelves if shelved else _by_rare_items)(rows, least, group, key, items)
    member = lambda c, rep: of.select(group, F.col(key).alias(c), F.col("rep").alias(rep))
    apart = near.join(member("x", "i"), [group, "i"]).join(member("y", "j"), [group, "j"]).select(group, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity")
    return apart.unionByName(_equal_pairs(of, group, key).withColumn("similarity", F.lit(1.0)))


def _by_rare_items(rows: DataFrame, least: float, group: str, key: str, items: str) -> DataFrame:
    often = rows.select(group, F.explode(items).alias("x")).groupBy(group, "x").agg(F.count("*").alias("df"))
    ranked = rows.select(group, key, F.explode(items).alias("x")).join(often, [group, "x"]).groupBy(group, key).agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("r"))
    n = F.size("r")
    rare = F.slice("r", 1, n - F.ceil(n * F.lit(least) - F.lit(1e-9)).cast("int") + 1)
    rare = ranked.select(group, key, n.alias("size"), F.posexplode(rare).alias("at", "e")).select(group, key, "size", (F.col("at") + 1).alias("at"), F.col("e.x").alias("x"))
    a, b = (rare.select(group, F.col(key).alias(c), F.col("size").alias(f"n{c}"), F.col("at").alias(f"r{c}"), "x") for c in "ij")
    size = (F.col("ni") >= F.col("nj") * least - 1e-9) & (F.col("nj") >= F.col("ni") * least - 1e-9)
    # both sets still hold so much from here on that they can overlap enough, if this is their first common item; for the first it is
    most = 1 + F.least(F.col("ni") - F.col("ri"), F.col("nj") - F.col("rj"))
    enough = most >= F.ceil((F.col("ni") + F.col("nj")) * F.lit(least / (1 + least)) - F.lit(1e-9))
    pairs = a.join(b, [group, "x"]).where((F.col("i") < F.col("j")) & size & enough).select(group, "i", "j").distinct()
    side = lambda c: rows.select(group, F.col(key).alias(c), F.col(items).alias(f"s{c}"))
    near = pairs.join(side("i"), [group, "i"]).join(side("j"), [group, "j"]).select(group, "i", "j", jaccard("si", "sj").alias("similarity"))
    return near.where(F.col("similarity") >= least)


def _on_shelves(rows: DataFrame, least: float, group: str, key: str, items: str, shelf_rows: int = 8192) -> DataFrame:
    """(group, i, j, similarity) of similar sets: a task holds the sets of a shelf by their items, the sets of this and the earlier shelves stream past and count what they have in common with each.

    Exact without candidates: what is shuffled is a set once for each shelf that it meets, and no task holds more than a shelf and a batch.
    """
    shelves = rows.groupBy(group).agg(F.ceil(F.count("*") / shelf_rows).cast("int").alias("shelves"))
    dealt = rows.select(group, key, items).join(shelves, group).withColumn("own", F.pmod(F.xxhash64(key), F.col("shelves")).cast("int"))
    side = lambda shelf, passing: dealt.select(group, shelf.alias("shelf"), F.lit(passing).alias("passing"), "own", key, items)
    both = side(F.col("own"), False).unionByName(side(F.explode(F.sequence("own", F.col("shelves") - 1)), True))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks, group, "shelf").sortWithinPartitions(group, "shelf", "passing")
    kind = rows.schema[key].dataType.simpleString()

    def words(sets: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The items of all sets and where each set's begin."""
        return sets.flatten(), np.r_[0, np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False))]

    def shelf_of(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        flat, at = words(t[items])
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        size = np.diff(at)
        order = np.argsort(codes, kind="stable")
        holders = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        return t[key], size, coded.dictionary, np.split(holders, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shelf = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch[group].dictionary_encode()
            codes, shelf_no, passing = groups.indices.to_numpy(zero_copy_only=False), batch["shelf"].to_numpy(), batch["passing"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(shelf_no) != 0) | (passing[1:] != passing[:-1])) + 1).tolist(), len(codes)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                part, here = batch.slice(x, y - x), (groups.dictionary[int(codes[x])].as_py(), int(shelf_no[x]))
                if here != at:
                    at, held, shelf = here, [], None
                if not passing[x]:
                    held.append(part)
                    continue
                if held:
                    shelf, held = shelf_of(held), []
                if shelf:
                    yield from met(part, at, shelf)

    def met(part: pa.RecordBatch, at: tuple, shelf: tuple) -> Iterator[pa.RecordBatch]:
        keys, size, names, holders = shelf
        flat, begin = words(part[items])
        codes = pc.index_in(flat, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
        found_i, found_j, similar = [], [], []
        for row in range(part.num_rows):
            own = codes[begin[row] : begin[row + 1]]
            common = [holders[c] for c in own[own >= 0]]
            if common:
                both = np.bincount(np.concatenate(common), minlength=len(size))
                likeness = both / (size + (begin[row + 1] - begin[row]) - both)
                hit = np.flatnonzero(likeness >= least)
                found_i.append(np.full(len(hit), row)), found_j.append(hit), similar.append(likeness[hit])
        if found_i:
            mine, theirs = part[key].take(pa.array(np.concatenate(found_i))), keys.take(pa.array(np.concatenate(found_j)))
            # in its own shelf a pair meets twice, and each set itself
            keep = pc.or_(pc.less(mine, theirs), pc.and_(pc.not_equal(part["own"].take(pa.array(np.concatenate(found_i))), at[1]), pc.not_equal(mine, theirs)))
            mine, theirs, similarity = mine.filter(keep), theirs.filter(keep), pa.array(np.concatenate(similar)).filter(keep)
            less = pc.less(mine, theirs)
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(mine), part.schema.field(group).type), pc.if_else(less, mine, theirs), pc.if_else(less, theirs, mine), similarity], [group, "i", "j", "similarity"])

    return both.mapInArrow(run, f"{group} {rows.schema[group].dataType.simpleString()}, i {kind}, j {kind}, similarity double")


def _equal_pairs(of: DataFrame, group: str, key: str, part_rows: int = 1024) -> DataFrame:
    """(group, i, j) of the pairs i < j of one ``rep``, which grow with the square of its rows: these are dealt into parts for either end, and each part meets each, so no task gets more than two parts' pairs at once."""
    parts = of.groupBy(group, "rep").agg(F.count("*").alias("n")).where("n > 1").select(group, "rep", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    rows = of.join(parts, [group, "rep"])
    own, all_ = F.pmod(F.xxhash64(key), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    end = lambda c, x, y: rows.select(group, "rep", F.col(key).alias(c), x.alias("x"), y.alias("y"))
    # the number of tasks follows the pairs, not the few bytes of the keys
    keys, tasks = [group, "rep", "x", "y"], int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return end("i", own, all_).repartition(tasks, *keys).join(end("j", all_, own).repartition(tasks, *keys), keys).where("i < j").select(group, "i", "j")


def keep_first_of_near(questions: DataFrame, p: Params, text: str = "question") -> DataFrame:
    """Greedy removal in order of place: a question goes if an earlier kept one is similar enough. questions: subject_id, place, text.

    The greedy choice is settled by components of the graph of near pairs, see ``greedy``. Of a subject's empty questions the first stays.
    """
    rows = in_order(questions.select("subject_id", "place", word_shingles(text).alias("s")), "subject_id", "place")
    near = similar_sets(rows, p.dedupe_jaccard, key="n").select(F.col("i").alias("earlier"), F.col("j").alias("later"))
    kept = first_independent(rows.where(F.size("s") > 0).select("n", F.lit(False).alias("blocked")), near)
    empty = rows.where(F.size("s") == 0).groupBy("subject_id").agg(F.min("n").alias("n"))
    stay = kept.where("kept").select("n").unionByName(empty.select("n"))
    return questions.join(rows.join(stay, "n", "left_semi").select("subject_id", "place"), ["subject_id", "place"], "left_semi")


def cap_fan_out(plans: DataFrame, cap: int) -> DataFrame:
    """Greedy in order of place: a plan goes if any of its claims is in ``cap`` kept plans already. plans: subject_id, place, claim_ids.

    The rule is sequential within a subject; its plans are streamed in order, only ids enter the Python step, and what is held is one count
    for each claim of the subject at hand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, used = None, {}
        for rows in batches:
            kept = []
            for own, ids in zip(rows["subject_id"], rows["claim_ids"], strict=True):
                if own != subject:
                    subject, used = own, {}
                ok = all(used.get(i, 0) < cap for i in ids)
                kept.append(ok)
                if ok:
                    for i in ids:
                        used[i] = used.get(i, 0) + 1
            yield rows.loc[kept, ["subject_id", "place"]]

    schema = ", ".join(f"{plans.schema[c].name} {plans.schema[c].dataType.simpleString()}" for c in ("subject_id", "place"))
    ordered = plans.select("subject_id", "place", "claim_ids").repartition("subject_id").sortWithinPartitions("subject_id", "place")
    return plans.join(ordered.mapInPandas(run, schema), ["subject_id", "place"], "left_semi")


def claim_subsets(claims: DataFrame, p: Params) -> DataFrame:
    """(subject_id, lap, chunk, subset_id, claim_ids): laps of rotated chunks; a tail shorter than half a chunk joins the one before it.

    Closed form on row numbers: no loop over claims.
    """
    size, laps = p.subset_size, p.subset_laps
    n = F.count("*").over(Window.partitionBy("subject_id"))
    rows = claims.select("subject_id", "claim_id").withColumns({"i": F.row_number().over(Window.partitionBy("subject_id").orderBy("claim_id")) - 1, "n": n})
    rows = rows.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(laps - 1))))
    at = F.pmod(F.col("i") - F.pmod(F.col("lap") * (size // 2 + 1), F.col("n")), F.col("n"))
    last = F.floor((F.col("n") - 1) / size)
    short = (F.col("n") - last * size < (size + 1) // 2) & (last > 0)
    chunk = F.least(F.floor(at / size), F.when(short, last - 1).otherwise(last))
    got = rows.withColumns({"at": at, "chunk": chunk}).groupBy("subject_id", "lap", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "claim_id"))).alias("m"))
    ids = F.transform("m", lambda x: x["claim_id"])
    name = F.concat(F.lit("sp"), F.col("lap").cast("string"), F.lit("-"), F.col("chunk").cast("string"), F.lit("-"), sha_prefix(F.array_join(ids, ","), 6))
    return got.select("subject_id", F.col("lap").cast("long").alias("lap"), F.col("chunk").cast("long").alias("chunk"), name.alias("subset_id"), ids.alias("claim_ids"))


def coverage(planned: DataFrame, targets: DataFrame) -> DataFrame:
    """Planned against target by category, targets without plans included."""
    got = planned.groupBy("category").agg(F.count("*").alias("planned"))
    return targets.join(got, "category", "left").select("category", "target", F.coalesce("planned", F.lit(0)).alias("planned"), F.greatest(F.col("target") - F.coalesce("planned", F.lit(0)), F.lit(0)).alias("short"))


def holdout(examples: DataFrame, p: Params) -> DataFrame:
    """Ids held out of an export: what is held stays, and each category is topped up to its share from the never exported, by hash of the id.

    examples: id, category, holdout, exported (boolean).
    """
    f = min(max(p.holdout_fraction, 0.0), 0.5)
    per = Window.partitionBy("category")
    free = ~F.col("holdout") & ~F.col("exported")
    rows = examples.withColumns({"short": F.floor(F.count("*").over(per) * f) - F.count_if("holdout").over(per), "free": free})
    turn = F.row_number().over(Window.partitionBy("category", "free").orderBy(sha_prefix("id"), "id"))
    return rows.withColumn("turn", turn).where(F.col("holdout") | (F.col("free") & (F.col("turn") <= F.col("short")))).select("category", "id", "holdout")


def hash_sample(rows: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """The n rows of each group whose keys hash lowest."""
    order = Window.partitionBy(group).orderBy(sha_prefix(key), key)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def rotating(items: DataFrame, slots: int, group: str = "subject_id") -> DataFrame:
    """Slot k of a group gets item k modulo the group's size. items: group, item_id."""
    own = Window.partitionBy(group)
    rows = items.withColumns({"i": F.row_number().over(own.orderBy("item_id")) - 1, "n": F.count("*").over(own)})
    reps = F.sequence(F.lit(0), F.lit(int(math.ceil(slots)) - 1))
    return rows.withColumn("slot", F.explode(F.filter(reps, lambda s: F.pmod(s, F.col("n")) == F.col("i")))).select(group, F.col("slot").cast("long").alias("slot"), "item_id")
