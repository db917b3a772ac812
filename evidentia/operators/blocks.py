"""Similar vectors within groups: blocks of rows meet blocks of rows in Arrow tasks, one matrix product a pair of blocks.

A group of more rows than a block is cut along a projection tree, fitted on a bounded sample of all vectors, so that a block is a ball of near rows. Only the balls
meet all others of their group: x.y is at most c.d + |c| s + |d| r + r s for rows of balls (c, r) and (d, s). A pair of blocks whose bound is under the floor, or
under the k-th similarity that all rows of the one have found by then, is not multiplied. What remains is exact; where vectors have no structure, as random ones of
many dimensions, no bound is small enough and all pairs of blocks meet. The blocks of ``left`` stand on shelves; a shelf is held by one task, past which the other
blocks stream row by row, the most promising first. So a row travels once a shelf that it meets, not once a block, a task holds a shelf and one more block,
whatever the size of a group, and with ``best`` a row of ``left`` leaves with its best alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.iterate import save, saved

#: Rows of a block, rows on average that the tree is fitted on, its depth. Similarities are rounded to so many digits, so that equal vectors tie in every block.
BLOCK_ROWS, SAMPLE_ROWS, DEPTH, DIGITS = 1024, 4096, 10, 10
#: Rows of a block that meet another block at a time, blocks of a shelf.
STRIP, SHELF = 256, 16
#: What rounding could take from a bound.
SLACK = 1e-8


def fitted_tree(sample: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cuts) of a complete binary tree: a node's rows are cut at the widest gap of their middle half, along the line through two far rows."""
    nodes = (1 << depth) - 1
    along, cut = np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
    held = {0: sample}
    for n in range(nodes):
        rows = held.pop(n, sample[:0])
        if len(rows) > 1:
            far = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
            along[n] = rows[((rows - far) ** 2).sum(1).argmax()] - far
            at = rows @ along[n]
            middle = np.sort(at)[len(at) // 4 : 3 * len(at) // 4 + 2]
            gap = int(np.diff(middle).argmax())
            cut[n] = (middle[gap] + middle[gap + 1]) / 2
            if 2 * n + 2 < nodes:
                held[2 * n + 1], held[2 * n + 2] = rows[at <= cut[n]], rows[at > cut[n]]
    return along, cut


def leaves(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int = DEPTH) -> np.ndarray:
    """The path of each row through the tree, as a number of ``depth`` bits, the first turn on top."""
    node, path = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for _ in range(depth):
        right = np.einsum("ij,ij->i", x, tree[0][node]) > tree[1][node]
        path, node = 2 * path + right, 2 * node + 1 + right
    return path


def _lists(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64, copy=False)


def _rows(lists) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, ids) of the rows of the one block in ``lists``."""
    rows = lists.flatten()
    return _lists(rows.field("v")) if len(rows) else np.zeros((0, 0)), np.array(rows.field("id").to_pylist(), object)


def _runs(batches, keys: list[str]):
    """The rows of each run of equal keys, as a table. Only such a run and the batch at hand are held."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _known(rows: DataFrame, group: str, key: str, vector: str) -> tuple[DataFrame, DataFrame, dict]:
    """(group, id, v) of the known rows, the rows of each group, and their sum and maximum. Single floats stay single, they are made double where they are multiplied."""
    v = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.transform(vector, lambda x: x.cast("double"))
    known = rows.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(group, F.col(key).alias("id"), v.alias("v"))
    sizes, told = saved(known.groupBy(group).agg(F.count("*").alias("n")), "block-sizes", total=F.sum("n"), most=F.max("n"))
    return known, sizes, told


def _blocks(known: DataFrame, sizes: DataFrame, told: dict, group: str, block_rows: int) -> DataFrame:
    """(group, block, id, v, c, r, norm, n): the rows with the number of their block in its group; one row of each block has its ball and its number of rows, elsewhere they are null."""
    kind, vector = known.schema[group].dataType.simpleString(), known.schema["v"].dataType.simpleString()
    path = F.lit(0).cast("long")
    if (told["most"] or 0) > block_rows:
        share = int(min(1.0, SAMPLE_ROWS / told["total"]) * (1 << 20))
        sample = known.where(F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1 << 20)) < share).select("v").toArrow()["v"]
        tree = fitted_tree(_lists(sample))

        def place(batches):
            for batch in batches:
                yield batch.append_column("path", pa.array(leaves(_lists(batch["v"]), tree) if batch.num_rows else np.zeros(0, np.int64)))

        known = known.mapInArrow(place, f"{group} {kind}, id string, v {vector}, path long")
        bits = F.least(F.ceil(F.log2(F.col("n") / block_rows)), F.lit(DEPTH)).cast("int")
        path = F.when(F.col("n") > block_rows, F.floor(F.col("path") / F.pow(F.lit(2.0), DEPTH - bits)).cast("long")).otherwise(0)
    placed = known.join(sizes, group).select(group, "id", "v", path.alias("cell"))
    parts = placed.groupBy(group, "cell").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("parts"))
    dealt = placed.join(parts, [group, "cell"]).select(group, (F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "id", "v")

    def ball(batches):
        for rows in _runs(batches, [group, "block"]):
            x, none = _lists(rows["v"]), [None] * (rows.num_rows - 1)
            c = x.mean(0)
            told = ([c.tolist()], [float(np.sqrt(((x - c) ** 2).sum(1).max()))], [float(np.sqrt((c**2).sum()))], [len(x)])
            more = [pa.array(v + none, t) for v, t in zip(told, (pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64()), strict=True)]
            for n, column in zip(("c", "r", "norm", "n"), more, strict=True):
                rows = rows.append_column(n, column)
            yield from rows.combine_chunks().to_batches()

    held = dealt.repartition(group, "block").sortWithinPartitions(group, "block").mapInArrow(ball, f"{group} {kind}, block long, id string, v {vector}, c array<double>, r double, norm double, n long")
    return save(held, "blocks")


def _apart(sim: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Rows don't meet those of their own id; ``b`` is sorted."""
    low, high = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    for i in np.flatnonzero(high > low):
        sim[i, low[i] : high[i]] = -np.inf


def _sorted(vectors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.argsort(ids, kind="stable")
    return vectors[first], ids[first]


def _found(group, x, y, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([group, pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(sim, pa.float64())], ["g", "x", "y", "sim"])


def _met(pairs: DataFrame, group: str, kind: str, floor: float, best: int | None, same: bool) -> DataFrame:
    """(group, x, y, sim, block) of the pairs of blocks (group, xb, xs, ys): the rows of xs with their best of ys."""

    def run(batches):
        for batch in batches:
            # a batch may hold many pairs of blocks: they are read one by one, as views of its buffers, never as Python numbers
            for k in range(batch.num_rows):
                (xs, a), (ys, b) = (_rows(batch[c].slice(k, 1)) for c in ("xs", "ys"))
                ys, b = _sorted(ys, b)
                for at in range(0, len(a), STRIP):
                    part = a[at : at + STRIP]
                    sim = np.round(xs[at : at + STRIP] @ ys.T, DIGITS)
                    if same:
                        _apart(sim, part, b)
                    if best is not None and best < len(b):
                        near = np.argsort(-sim, axis=1, kind="stable")[:, :best]
                        keep = np.take_along_axis(sim, near, 1) >= floor
                        x, y = np.nonzero(keep)[0], near[keep]
                    else:
                        x, y = np.nonzero(sim >= floor)
                    own = [pa.array([v] * len(x), t) for v, t in ((batch[group][k].as_py(), batch.schema.field(group).type), (batch["xb"][k].as_py(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([own[0], pa.array(part[x].tolist(), pa.string()), pa.array(b[y].tolist(), pa.string()), pa.array(sim[x, y]), own[1]], [group, "x", "y", "sim", "xb"])

    return pairs.select(group, "xb", "xs", "ys").mapInArrow(run, f"{group} {kind}, x string, y string, sim double, xb long")


class _Best:
    """The best ``k`` of each row of a block, ties to the smaller id, as blocks go past."""

    def __init__(self, rows: int, k: int, floor: float):
        self.k, self.need, self.top = k, np.full(rows, floor), [[] for _ in range(rows)]

    def meet(self, at: int, sim: np.ndarray, ids: np.ndarray) -> None:
        """``sim`` of the rows from ``at`` with rows of ascending ``ids``."""
        need = self.need[at : at + len(sim), None]
        good = sim >= need
        crowded = np.flatnonzero(good.sum(1) > 4 * self.k)
        if len(crowded):
            near = np.argsort(-sim[crowded], axis=1, kind="stable")[:, : self.k]
            good[crowded] = False
            good[crowded[:, None], near] = sim[crowded[:, None], near] >= need[crowded]
        for i in np.flatnonzero(good.any(1)):
            near = np.flatnonzero(good[i])
            top = sorted([*self.top[at + i], *zip((-sim[i, near]).tolist(), ids[near].tolist(), strict=True)])[: self.k]
            self.top[at + i] = top
            if len(top) == self.k:
                self.need[at + i] = max(self.need[at + i], -top[-1][0])

    def least(self) -> float:
        """No row gains by less; nothing to go by while a row has room."""
        return -np.inf if any(len(t) < self.k for t in self.top) else float(self.need.min())


def _shelved(rows: DataFrame, group: str, kind: str, floor: float, best: int | None, same: bool) -> DataFrame:
    """(group, x, y, sim) of rows (group, shelf, side, block, id, v, meets) in this order: those of side 0 stay until their shelf ends, a block of side 1 meets the blocks that ``meets`` names in one of its rows."""

    def run(batches):
        here, shelf, kind_of = None, {}, None

        def left():
            if best is not None:
                for _, ids, top in shelf.values():
                    found = [(x, y, -minus) for x, t in zip(ids.tolist(), top.top, strict=True) for minus, y in t]
                    yield _found(pa.array([here[0]] * len(found), kind_of), *(list(c) for c in zip(*found, strict=True))) if found else _found(pa.array([], kind_of), [], [], [])

        for t in _runs(batches, [group, "shelf", "side", "block"]):
            at = (t[group][0].as_py(), t["shelf"][0].as_py())
            if at != here:
                yield from left()
                here, shelf, kind_of = at, {}, t.schema.field(group).type
            v, ids = _sorted(_lists(t["v"]), np.array(t["id"].to_pylist(), object))
            if t["side"][0].as_py() == 0:
                shelf[t["block"][0].as_py()] = (v, ids, best is not None and _Best(len(ids), best, floor))
                continue
            for other in t["meets"].drop_null()[0].as_py():
                xs, a, top = shelf[other["xb"]]
                if top and other["bound"] < top.least():
                    continue
                for k in range(0, len(a), STRIP):
                    sim = np.round(xs[k : k + STRIP] @ v.T, DIGITS)
                    if same:
                        _apart(sim, a[k : k + STRIP], ids)
                    if top:
                        top.meet(k, sim, ids)
                    else:
                        x, y = np.nonzero(sim >= floor)
                        yield _found(pa.array([here[0]] * len(x), kind_of), a[k + x].tolist(), ids[y].tolist(), sim[x, y])
        yield from left()

    return rows.mapInArrow(run, f"g {kind}, x string, y string, sim double").withColumnRenamed("g", group)


def similar(
    left: DataFrame, right: DataFrame, floor: float, best: int | None = None, group: str = "subject_id", key: str = "claim_id", vector: str = "embedding", same: bool = True, block_rows: int = BLOCK_ROWS, told: dict | None = None
) -> DataFrame:
    """(group, x, y, sim) of rows x of ``left`` and other rows y of ``right`` in a group with a dot product of ``floor`` or more.

    With ``best`` each x keeps its ``best`` nearest y, ties to the smaller y. Ids are strings; ``same`` says that those of both sides are of one kind, so that equal
    ones don't meet. Vectors are of one length. ``told`` receives the pairs of blocks and how many of them were brought together.
    """
    kind = left.schema[group].dataType.simpleString()
    one = _known(left, group, key, vector)
    two = one if left is right else _known(right, group, key, vector)
    if all((told_["most"] or 0) <= block_rows for *_, told_ in (one, two)):
        packed = lambda known, n: known.groupBy(group).agg(F.collect_list(F.struct("id", "v")).alias(n))
        return _met(packed(one[0], "xs").join(packed(two[0], "ys"), group).withColumn("xb", F.lit(0).cast("long")), group, kind, floor, best, same).drop("xb")
    xs = _blocks(*one, group, block_rows)
    ys = xs if left is right else _blocks(*two, group, block_rows)
    # blocks of near cells share a shelf
    place = F.row_number().over(Window.partitionBy(group).orderBy("block"))
    a = xs.where("n IS NOT NULL").select(group, F.col("block").alias("xb"), F.floor((place - 1) / SHELF).cast("long").alias("shelf"), F.col("c").alias("xc"), F.col("r").alias("xr"), F.col("norm").alias("xn"))
    b = ys.where("n IS NOT NULL").select(group, F.col("block").alias("yb"), F.col("c").alias("yc"), F.col("r").alias("yr"), F.col("norm").alias("yn"))
    centers = F.aggregate(F.zip_with("xc", "yc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    bound = centers + F.col("xn") * F.col("yr") + F.col("yn") * F.col("xr") + F.col("xr") * F.col("yr") + SLACK
    pairs, count = saved(a.join(b, group).select(group, "shelf", "xb", "yb", bound.alias("bound")), "block-pairs", n=F.count("*"), met=F.count_if(F.col("bound") >= floor))
    live = pairs.where(F.col("bound") >= floor)
    shelves = live.select(group, F.col("xb").alias("block"), "shelf").distinct()
    meets = live.groupBy(group, F.col("yb").alias("block"), "shelf").agg(F.max("bound").alias("most"), F.sort_array(F.collect_list(F.struct("bound", "xb")), False).alias("meets"))
    none = F.lit(None).cast("array<struct<bound:double,xb:bigint>>").alias("meets")
    stay = xs.join(shelves, [group, "block"]).select(group, "shelf", F.lit(0).alias("side"), F.lit(0.0).alias("turn"), "block", "id", "v", none)
    pass_ = ys.join(meets, [group, "block"]).select(group, "shelf", F.lit(1).alias("side"), (-F.col("most")).alias("turn"), "block", "id", "v", F.when(F.col("n").isNotNull(), F.col("meets")).alias("meets"))
    # the number of tasks follows the pairs, not the bytes of the rows
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stay.unionByName(pass_).repartition(tasks, group, "shelf").sortWithinPartitions(group, "shelf", "side", "turn", "block")
    if told is not None:
        told |= {"pairs": count["n"], "met": count["met"]}
    return _shelved(rows, group, kind, floor, best, same)
