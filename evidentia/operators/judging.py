"""Ensemble votes, verdict caches and evaluation of the judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.config import Params

# Tie precedence of relations, most preferred first; severity of axis verdicts.
PRECEDENCE = ("NEUTRAL", "REPEATS", "CORROBORATES", "CONTRADICTS")
SEVERITY = ("PASS", "BORDERLINE", "FAIL")


def _place(column: str, names: tuple[str, ...]):
    out = F.when(F.col(column) == names[0], 0)
    for k, n in enumerate(names[1:], 1):
        out = out.when(F.col(column) == n, k)
    return out


def aggregate_votes(samples: DataFrame, p: Params, keys: tuple[str, ...] = ("a", "b", "with_context")) -> DataFrame:
    """The verdict of each pair, see ``verdicts``, from one row a sample.

    samples: keys, sample_index, relation, confidence, rationale, temporal_note, explanation_relevant.
    """
    told = F.collect_list(F.struct("sample_index", "relation", "confidence", "rationale", "temporal_note", "explanation_relevant"))
    return verdicts(samples.groupBy(*keys).agg(told.alias("samples")), p)


def verdicts(pairs: DataFrame, p: Params) -> DataFrame:
    """The verdict of each pair: majority with ties by precedence, confidence scaled by agreement, weak verdicts floored to NEUTRAL.

    ``samples`` of a pair is an array of (sample_index, relation, confidence, rationale, temporal_note, explanation_relevant), as a judge replies; its other columns stay. Rows are
    told one by one, nothing is shuffled. Confidences are summed in order of the samples, so the mean does not depend on where they lay. The rationale is that of the majority's
    most confident sample, the first of equals.
    """
    s = F.col("samples")
    relations = F.array_distinct(F.transform(s, lambda x: x["relation"]))

    def place(relation):
        out = F.when(relation == PRECEDENCE[0], 0)
        for k, n in enumerate(PRECEDENCE[1:], 1):
            out = out.when(relation == n, k)
        return out

    votes = F.transform(relations, lambda r: F.struct((-F.size(F.filter("samples", lambda x: x["relation"].eqNullSafe(r)))).cast("long").alias("minus"), place(r).alias("place"), r.alias("relation")))
    rows = pairs.withColumn("samples", F.array_sort(s)).withColumn("by", votes).withColumn("w", F.array_min("by"))
    won = F.filter("samples", lambda x: x["relation"].eqNullSafe(F.col("w.relation")))
    rows = rows.withColumn("won", F.transform(won, lambda x: F.struct((-x["confidence"]).alias("minus"), x["sample_index"].alias("sample_index"), x["confidence"].alias("confidence"), x["rationale"].alias("rationale"), x["temporal_note"].alias("temporal_note"))))
    known = F.filter(F.transform("won", lambda x: x["confidence"].cast("double")), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda total, x: total + x), F.size(known))
    answers = F.filter(F.transform("samples", lambda x: x["explanation_relevant"]), lambda x: x.isNotNull())
    rows = rows.withColumns({"confidence": -F.col("w.minus") / p.ensemble_k * mean, "best": F.array_min("won"), "answers": answers})
    floored = (F.col("w.relation") != "NEUTRAL") & (F.col("confidence") < p.confidence_floor)
    yes = F.size(F.filter("answers", lambda x: x))
    return rows.select(
        *[c for c in pairs.columns if c != "samples"], F.when(floored, "NEUTRAL").otherwise(F.col("w.relation")).alias("relation"), "confidence",
        F.map_from_entries(F.array_sort(F.transform("by", lambda x: F.struct(x["relation"].alias("relation"), (-x["minus"]).alias("votes"))))).alias("votes"), F.col("best.rationale").alias("rationale"), F.col("best.temporal_note").alias("temporal_note"),
        ((F.size("answers") > 0) & (yes > F.floor(F.size("answers") / 2))).alias("explanation_relevant"),
        (F.size(F.filter("by", lambda x: x["minus"] == F.col("w.minus"))) > 1).alias("tie"), floored.alias("floored"),
    )


@dataclass(frozen=True)
class Replies:
    """What a judge replies to n pairs, k samples each, in order: arrays (n, k), texts as Arrow arrays of n k, row by row."""

    #: places in PRECEDENCE
    relation: np.ndarray
    confidence: np.ndarray
    rationale: pa.Array
    temporal_note: pa.Array
    #: 1 yes, 0 no, -1 not said
    explanation_relevant: np.ndarray


#: What is told of a pair, and the type of each column.
TOLD = {
    "relation": pa.string(), "confidence": pa.float64(), "votes": pa.map_(pa.string(), pa.int64()), "rationale": pa.string(), "temporal_note": pa.string(), "explanation_relevant": pa.bool_(), "tie": pa.bool_(), "floored": pa.bool_(),
}
_TYPES = {pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", TOLD["votes"]: "map<string, bigint>"}


def told(replies: Replies, p: Params, wanted: tuple[str, ...] = tuple(TOLD)) -> dict[str, pa.Array]:
    """``verdicts`` of replies, as Arrow columns of the names ``wanted``."""
    r, conf, said = replies.relation, replies.confidence, replies.explanation_relevant
    n, k = r.shape
    count = np.stack([(r == code).sum(1) for code in range(len(PRECEDENCE))], 1)
    code = (count * len(PRECEDENCE) - np.arange(len(PRECEDENCE))).argmax(1)
    won, votes = r == code[:, None], count.max(1)
    total = np.zeros(n)
    for i in range(k):
        total += np.where(won[:, i], conf[:, i], 0.0)
    confidence = votes / p.ensemble_k * (total / won.sum(1))
    floored = (code > 0) & (confidence < p.confidence_floor)
    best = pa.array(np.arange(n) * k + np.where(won, conf, -np.inf).argmax(1))
    answers, yes = (said >= 0).sum(1), (said == 1).sum(1)

    def ballots() -> pa.Array:
        names, (row, col) = np.argsort(PRECEDENCE), np.nonzero(count[:, np.argsort(PRECEDENCE)])
        at = np.concatenate([[0], np.bincount(row, minlength=n).cumsum()]).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(at), pa.array(PRECEDENCE).take(pa.array(names[col])), pa.array(count[row, names[col]]))

    columns = {
        "relation": lambda: pa.array(PRECEDENCE).take(pa.array(np.where(floored, 0, code))), "confidence": lambda: pa.array(confidence), "votes": ballots,
        "rationale": lambda: replies.rationale.take(best).cast(pa.string()), "temporal_note": lambda: replies.temporal_note.take(best).cast(pa.string()),
        "explanation_relevant": lambda: pa.array((answers > 0) & (yes > answers // 2)), "tie": lambda: pa.array((count == votes[:, None]).sum(1) > 1), "floored": lambda: pa.array(floored),
    }
    return {name: columns[name]() for name in wanted}


def judged(pairs: DataFrame, judge: Callable[[pa.RecordBatch], Replies], p: Params, wanted: tuple[str, ...] = tuple(TOLD), only: tuple[str, ...] | None = None) -> DataFrame:
    """``verdicts`` of pairs that a judge is asked for in batches, told where the replies come in, so that samples never become rows; ``only`` keeps the pairs of these relations."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                said = told(judge(batch), p, tuple({*wanted, "relation"} if only else wanted))
                out = pa.RecordBatch.from_arrays([*batch.columns, *[said[n] for n in wanted]], [*names, *wanted])
                yield out.filter(pc.is_in(said["relation"], value_set=pa.array(only))) if only else out

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + [f"{n} {_TYPES[TOLD[n]]}" for n in wanted]
    return pairs.mapInArrow(run, ", ".join(schema))


def axis_verdicts(votes: DataFrame) -> DataFrame:
    """The verdict of each example and axis: majority, the worse one of tied."""
    by = votes.groupBy("example_id", "axis", "verdict").agg(F.count("*").alias("n"))
    return by.groupBy("example_id", "axis").agg(F.max_by("verdict", F.struct("n", _place("verdict", SEVERITY))).alias("verdict"))


def overall_verdicts(axes: DataFrame) -> DataFrame:
    """The worst axis decides."""
    return axes.groupBy("example_id").agg(F.max_by("verdict", _place("verdict", SEVERITY)).alias("overall"))


def cache_misses(queue: DataFrame, cache: DataFrame) -> DataFrame:
    """Queued pair variants without a usable verdict: same stamp, not overridden, and for the context variant of the same explanation."""
    usable = cache.where("NOT overridden").select("a", "b", "with_context", "stamp", F.col("explanation_hash").alias("cached_hash"))
    hit = queue.join(usable, ["a", "b", "with_context", "stamp"]).where(~F.col("with_context") | F.col("explanation_hash").eqNullSafe(F.col("cached_hash")))
    return queue.join(hit.select("a", "b", "with_context", "stamp"), ["a", "b", "with_context", "stamp"], "left_anti")


def _expected(column: str = "human_relation"):
    return F.when(F.col(column) == "IRRELEVANT", "NEUTRAL").otherwise(F.col(column))


def confusion(judged: DataFrame) -> DataFrame:
    """judged: human_relation, predicted, split. TEST pairs only."""
    return judged.where("split = 'TEST'").groupBy(_expected().alias("human"), "predicted").agg(F.count("*").alias("n"))


def relation_metrics(judged: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each relation over TEST pairs; null where a denominator is 0."""
    test = judged.where("split = 'TEST'").select(_expected().alias("human"), "predicted", F.explode(F.array(*map(F.lit, PRECEDENCE))).alias("relation"))
    hit = lambda c: F.count_if(c)
    h, q = F.col("human") == F.col("relation"), F.col("predicted") == F.col("relation")
    n = test.groupBy("relation").agg(hit(h & q).alias("tp"), hit(~h & q).alias("fp"), hit(h & ~q).alias("fn"), hit(h).alias("support"))
    pr, re = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.when(pr + re > 0, 2 * pr * re / (pr + re))
    return n.select("relation", pr.alias("precision"), re.alias("recall"), f1.alias("f1"), "support")


def calibration(judged: DataFrame, p: Params, buckets: int = 5) -> DataFrame:
    """judged: top_votes, human_relation, predicted. Every bucket of agreement, the last one closed, also empty ones."""
    share = F.least(F.greatest(F.col("top_votes") / max(1, p.ensemble_k), F.lit(0.0)), F.lit(1.0))
    points = judged.select(share.alias("agreement"), (_expected() == F.col("predicted")).cast("double").alias("right")).withColumn("bucket", F.least(F.floor(F.col("agreement") * buckets), F.lit(buckets - 1)).cast("int"))
    got = points.groupBy("bucket").agg(F.count("*").alias("pairs"), F.avg("agreement").alias("mean_agreement"), F.avg("right").alias("human_agreement_rate"))
    spine = judged.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(got, "bucket", "left").select("bucket", (F.col("bucket") / buckets).alias("lower"), ((F.col("bucket") + 1) / buckets).alias("upper"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "mean_agreement", "human_agreement_rate")


def blocking_recall(golden: DataFrame, records: DataFrame) -> DataFrame:
    """Of the pairs that people call related, the share that any record of blocking holds."""
    related = golden.where(F.col("human_relation").isin("REPEATS", "CORROBORATES", "CONTRADICTS"))
    seen = records.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("hit")).distinct()
    return related.join(seen, ["a", "b"], "left").agg(F.count("*").alias("non_neutral"), F.count("hit").alias("survived")).withColumn("recall", F.try_divide("survived", "non_neutral"))
