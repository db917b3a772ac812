"""Evaluation of trained behaviour, samples for labelling, and points of the calibration plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.hashing import sha_prefix


def eval_report(probes: DataFrame, bar: float) -> DataFrame:
    """One row a run: counts, match rate against the advisory bar, safety, and the failing rows in order.

    probes: run_id, probe_id, kind (CORE or HOLDOUT), row_id, safety_class, matched (null if not graded).
    """
    hit, graded, safety = F.coalesce("matched", F.lit(False)), F.col("matched").isNotNull(), F.col("safety_class").isNotNull()
    miss = graded & ~hit & F.col("row_id").isNotNull()
    rows = probes.where(miss).groupBy("run_id", "row_id").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "n"))).alias("r"))
    out = probes.groupBy("run_id").agg(
        F.count("*").alias("probes"), F.count("matched").alias("graded"), F.count_if(F.col("kind") == "CORE").alias("core"), F.count_if(F.col("kind") == "HOLDOUT").alias("holdout"),
        F.coalesce(F.try_divide(F.count_if(hit), F.count("matched")), F.lit(0.0)).alias("match_rate"), (F.count_if(safety & ~hit) == 0).alias("safety_pass"), F.count_if(safety & graded & ~hit).alias("safety_failed"),
        F.array_sort(F.collect_list(F.when(safety & ~hit, F.concat_ws(":", "safety_class", F.col("probe_id").cast("string"))))).alias("failed_safety"),
    )
    failing = F.array_join(F.transform("r", lambda x: F.concat(x["row_id"].cast("string"), F.lit("×"), x["n"].cast("string"))), ", ")
    return out.join(rows, "run_id", "left").select(*out.columns, (F.col("match_rate") >= bar).alias("bar_met"), F.coalesce(failing, F.lit("")).alias("failing_rows"))


def row_rates(probes: DataFrame) -> DataFrame:
    """(run_id, row_id, total, matched) of graded probes that have a row."""
    return probes.where("matched IS NOT NULL AND row_id IS NOT NULL").groupBy("run_id", "row_id").agg(F.count("*").alias("total"), F.count_if("matched").alias("hits"))


def sampled_pairs(queued: DataFrame, survivors: DataFrame, claims: DataFrame, labelled: DataFrame, n: int, probes: int = 16) -> DataFrame:
    """(subject_id, a, b, bucket): of each subject ``n`` unlabelled pairs to label, two fifths from the queue, two fifths survivors, the rest probes.

    The order within a bucket is that of a hash of the pair. Probes are pairs without a record: each claim, in order of a hash, with the ``probes``
    claims after it, so that candidates grow with the claims and not with their square. Pairs have a < b.
    """
    of_queue = max(int(n * 0.4), 1 if n >= 3 else 0)
    of_survivors = int(n * 0.4)
    pair = ["subject_id", "a", "b"]
    known = queued.select(*pair).unionByName(survivors.select(*pair)).distinct()
    order = Window.partitionBy("subject_id").orderBy(sha_prefix("claim_id"), "claim_id")
    near = claims.select("subject_id", F.col("claim_id").alias("x"), F.array(*[F.lead("claim_id", k).over(order) for k in range(1, probes + 1)]).alias("ys"))
    near = near.select("subject_id", "x", F.explode("ys").alias("y")).where("y IS NOT NULL")
    probe = near.select("subject_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(known, pair, "left_anti")
    turn = Window.partitionBy("subject_id").orderBy(sha_prefix(F.concat_ws("|", "a", "b")), "a", "b")

    def take(rows: DataFrame, k: int, bucket: str) -> DataFrame:
        free = rows.select(*pair).join(labelled.select(*pair), pair, "left_anti")
        return free.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= k).select(*pair, F.lit(bucket).alias("bucket"))

    rest = survivors.select(*pair).join(queued.select(*pair), pair, "left_anti")
    return take(queued, of_queue, "JUDGE_QUEUE").unionByName(take(rest, of_survivors, "SURVIVOR")).unionByName(take(probe, max(n - of_queue - of_survivors, 0), "PROBE"))


def plot_points(curve: DataFrame) -> DataFrame:
    """(x, y, radius, pairs) of the buckets that people agreed on, from ``calibration``: by agreement, or the bucket's middle where it has none."""
    points = curve.where("human_agreement_rate IS NOT NULL")
    return points.select(F.coalesce("mean_agreement", (F.col("lower") + F.col("upper")) / 2).alias("x"), F.col("human_agreement_rate").alias("y"), (3.0 + F.least("pairs", F.lit(6))).cast("double").alias("radius"), "pairs")
