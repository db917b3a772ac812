"""The greedy choice along an order: a node is kept if no earlier kept neighbour speaks against it (the lexicographically first independent set).

The choice in one component of the graph does not depend on another. Components of bounded size are therefore settled whole, many in a task, in order
of their nodes; only what is left, components of more than ``MOST_EDGES`` pairs, is settled in rounds. Chains, however long, are not a matter of rounds.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.iterate import components, save, saved

#: Pairs of a component that a task settles whole, and of all components that it settles.
MOST_EDGES = 1 << 18


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a number ``n`` that rises with the order, over all partitions; written, so that the numbers stay."""
    return save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()), "in-order")


def settle(earlier: list[int], later: list[int], blocked: set[int]) -> dict[int, bool]:
    """Whether each node of the pairs is kept; the pairs in any order."""
    before: dict[int, list[int]] = {}
    for a, b in zip(earlier, later, strict=True):
        before.setdefault(b, []).append(a)
        before.setdefault(a, [])
    kept: dict[int, bool] = {}
    for n in sorted(before):
        kept[n] = n not in blocked and not any(kept[a] for a in before[n])
    return kept


def first_independent(nodes: DataFrame, pairs: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(n, kept) for every node (n, blocked): kept if it is not blocked and no earlier neighbour is kept. pairs: earlier, later, numbers of nodes."""
    pairs = save(pairs.select("earlier", "later").distinct(), "greedy-pairs")
    roots = save(components(pairs.select(F.col("earlier").alias("a"), F.col("later").alias("b"))), "greedy-roots")
    rows = pairs.join(roots.withColumnRenamed("v", "earlier"), "earlier")
    sizes = save(rows.groupBy("root").agg(F.count("*").alias("m")), "greedy-sizes")
    told = sizes.agg(F.sum(F.when(F.col("m") <= most_edges, F.col("m"))).alias("small"), F.count_if(F.col("m") > most_edges).alias("large")).collect()[0]
    stopped = lambda c: nodes.where("blocked").select(F.col("n").alias(c), F.lit(True).alias(f"{c}_blocked"))
    rows = rows.join(sizes, "root").join(stopped("earlier"), "earlier", "left").join(stopped("later"), "later", "left")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        a, b, x, y = (group[c].to_pylist() for c in ("earlier", "later", "earlier_blocked", "later_blocked"))
        kept = settle(a, b, {n for n, s in zip(a + b, x + y, strict=True) if s})
        return pa.table({"n": pa.array(list(kept), pa.int64()), "kept": pa.array(list(kept.values()), pa.bool_())})

    bucket = F.pmod(F.xxhash64("root"), F.lit(max(1, math.ceil((told["small"] or 0) / max(1, most_edges)))).cast("long"))
    decided = rows.where(F.col("m") <= most_edges).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, "n long, kept boolean")
    if told["large"]:
        decided = decided.unionByName(in_rounds(rows.where(F.col("m") > most_edges), nodes))
    decided = save(decided, "greedy-kept")
    return nodes.join(decided, "n", "left").select("n", F.coalesce("kept", ~F.col("blocked")).alias("kept"))


def in_rounds(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, kept) of the nodes of the pairs: in a round, a node without an undecided earlier neighbour is decided."""
    pairs = save(pairs.select("earlier", "later"), "greedy-large")
    own = pairs.select(F.col("earlier").alias("n")).unionByName(pairs.select(F.col("later").alias("n"))).distinct()
    state, left = saved(own.join(nodes, "n").select("n", F.when(F.col("blocked"), False).alias("kept")), "greedy-state", n=F.count_if(F.col("kept").isNull()))
    while left.get("n"):
        ahead = pairs.join(state.select(F.col("n").alias("earlier"), F.col("kept").alias("before")), "earlier")
        told = ahead.groupBy(F.col("later").alias("n")).agg(F.bool_or("before").alias("met"), F.count_if(F.col("before").isNull()).alias("open"))
        now = F.when(F.coalesce("met", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state, left = saved(state.join(told, "n", "left").select("n", F.coalesce("kept", now).alias("kept")), "greedy-state", n=F.count_if(F.col("kept").isNull()))
    return state
