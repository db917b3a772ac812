"""Overlaps of intervals of a place, as an equi join on bins of time.

An interval of length up to 2^k seconds lies in at most two bins of that width. Each interval is stored at its own level, and asks at its own and all longer
levels that occur, again in at most two bins each; so a long one does not fill many bins, and no place is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(level: Column) -> Column:
    """The one or two bins of a level that the interval (s, e) lies in."""
    width = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(F.col("s") / width).cast("long"), F.floor(F.col("e") / width).cast("long"))


def all_overlaps(occupancies: DataFrame) -> DataFrame:
    """(place, first, second, starts, until) for every pair of occupancies of one place that overlap; ``first`` starts earlier, ties by occupant.

    occupancies: place, occupant, start, end (timestamps, end exclusive). Rows with nulls, and empty intervals, overlap nothing; repeated rows of one occupant don't meet.
    The pair is told in the bin of the longer one's level that holds the later start.
    """
    rows = occupancies.where("place IS NOT NULL AND occupant IS NOT NULL AND start < end").select("place", "occupant", F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"))
    rows = rows.withColumn("level", F.greatest(F.ceil(F.log2(F.greatest(F.col("e") - F.col("s"), F.lit(1.0)))), F.lit(0)).cast("int"))
    levels = rows.groupBy("place").agg(F.collect_set("level").alias("levels"))  # at most one entry for each power of two
    stored = rows.select("place", "level", F.explode(_bins(F.col("level"))).alias("bin"), F.col("occupant").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"))
    asked = rows.join(levels, "place").select("place", "occupant", "s", "e", F.col("level").alias("own"), F.explode(F.filter("levels", lambda x: x >= F.col("level"))).alias("level"))
    asked = asked.select("place", "level", F.explode(_bins(F.col("level"))).alias("bin"), "occupant", "s", "e", "own")
    met = asked.join(stored, ["place", "level", "bin"]).where("s < oe AND os < e")
    later = F.floor(F.greatest("s", "os") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    once = (F.col("level") > F.col("own")) & (F.col("occupant") != F.col("other")) | (F.col("level") == F.col("own")) & (F.col("occupant") < F.col("other"))
    met = met.where((F.col("bin") == later) & once)
    ahead = F.struct("s", "occupant") < F.struct(F.col("os").alias("s"), F.col("other").alias("occupant"))
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    time = lambda c: F.timestamp_seconds(c)
    return met.select("place", pick("occupant", "other").alias("first"), pick("other", "occupant").alias("second"), time(F.greatest("s", "os")).alias("starts"), time(F.least("e", "oe")).alias("until"))
