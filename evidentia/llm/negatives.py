"""Hard negatives by bit-sliced integer products.

Components are integers floor(256 x). Rows lie in blocks and anchors in boxes of bounded size, and every box meets every block in two passes: one finds
each anchor's positives, the other the negatives within the score bounds that follow from them. In a task the bit-planes of the components
are taken most significant first: after a plane, what the lower planes can still add to a score is bounded by the anchor's positive and negative
components, so each pair has an interval. A pair leaves once its interval lies outside every window of its anchor, or below the k-th best
score that is already certain. A plane holds zeros and ones, so its products are exact in 32-bit floats, which count to 2 ** 24.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.mips import integer, packed, unpacked
from evidentia.operators.iterate import save

#: Rows of a block, anchors of a box, blocks that a task takes at most while there are few, anchors whose intervals are held at once.
BLOCK_ROWS, BOX_ROWS, SLOTS, ANCHORS_AT_ONCE = 8192, 1024, 64, 64
#: Share of pairs left below which they are held as a list.
SPARSE = 1 / 16
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def taking_part(vectors: DataFrame, label: Column | str) -> DataFrame:
    """(vec_id, label, x, dim) of the rows that take part: a vec_id, a label, a vector that is not null or empty, and only finite components."""
    known = vectors.select("vec_id", F.col(label).alias("label") if isinstance(label, str) else label.alias("label"), F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0)).alias("x"))
    known = known.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0")
    known = known.where(F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c)))
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x", F.size("x").alias("dim"))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x): integers of 64 bits, or Python's where they don't fit in 52."""
    if np.abs(x).max(initial=0) < 2.0**44:
        return np.floor(x * 256.0).astype(np.int64)
    return np.array([[integer(c) for c in row] for row in x.tolist()], object)


def best(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, need: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates are among the ``need`` first of their key by score, ties to the smaller id, and each key's last such score, where it has so many."""
    worth = np.unique(scores, return_inverse=True)[1] if scores.dtype == object and len(scores) else scores
    order = np.lexsort((ids, -worth, keys))
    sorted_keys = keys[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_keys, sorted_keys)
    floor = np.full(count, -np.inf)
    last = order[rank == need - 1]
    floor[keys[last]] = [f if (f := float(s)) <= s else np.nextafter(f, -np.inf) for s in scores[last].tolist()] if scores.dtype == object else scores[last]
    return order[rank < need], floor


def survivors(q: np.ndarray, x: np.ndarray, live: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, exact score) that may be among the ``need`` best of a window of their anchor, by bit-planes from the top.

    ``low`` and ``high`` bound the windows of each anchor, ``floor`` are scores that so many rows of a window are known to reach. Ties of a floor stay.
    """
    planes = max(int(x.max(initial=0)).bit_length(), int(-1 - x.min(initial=0)).bit_length())
    kind = np.float32 if np.abs(q).sum(1).max(initial=0) < 2**24 else np.float64
    dense, up, down = q.astype(kind), np.maximum(q, 0).sum(1).astype(float), np.minimum(q, 0).sum(1).astype(float)
    at: tuple[np.ndarray, np.ndarray] | None = None
    score = -(2.0**planes) * (dense @ (x < 0).T.astype(kind)).astype(float)
    floor = floor.copy()
    for p in range(planes, -1, -1):
        if p < planes:
            bits = x >> p & 1
            if at is None:
                score += 2.0**p * (dense @ bits.T.astype(kind))
            else:
                score += 2.0**p * np.einsum("ij,ij->i", q[at[0]], bits[at[1]])
        gap = 2.0**p - 1
        a = slice(None) if at is None else at[0]
        least, most = score + (gap * down[a])[:, None] if at is None else score + gap * down[a], score + (gap * up[a])[:, None] if at is None else score + gap * up[a]
        left = np.zeros(score.shape, bool)
        for j in range(low.shape[1]):
            lo, hi = low[a, j], high[a, j]
            if at is None:
                lo, hi = lo[:, None], hi[:, None]
            sure = (least >= lo) & (most <= hi)
            if at is None:
                sure &= live
                if score.shape[1] >= need:
                    floor[:, j] = np.maximum(floor[:, j], np.partition(np.where(sure, least, -np.inf), -need, axis=1)[:, -need])
            else:
                floor[:, j] = np.maximum(floor[:, j], best(a[sure], at[1][sure], least[sure], need, len(q))[1])
            reach = floor[a, j][:, None] if at is None else floor[a, j]
            left |= (most >= np.maximum(lo, reach)) & (least <= hi)
        if at is not None:
            at, score = (at[0][left], at[1][left]), score[left]
        else:
            live = live & left
            if live.mean() < SPARSE or not p:
                at = np.nonzero(live)
                score = score[at]
    return at[0], at[1], score


def wide_pairs(q: np.ndarray, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All live pairs and their exact scores, by Python's integers, cut to 64 bits."""
    a, r = np.nonzero(live)
    return a, r, np.array([min(max(sum(s * t for s, t in zip(q[i].tolist(), x[j].tolist(), strict=True)), LEAST), MOST) for i, j in zip(a.tolist(), r.tolist(), strict=True)], object)


class Search:
    """The best rows of each window of a box's anchors; blocks are taken one by one."""

    def __init__(self, box: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, need: int, same: bool) -> None:
        self.box, self.q, self.low, self.high, self.need, self.same = box, whole_numbers(box["x"]), low, high, need, same
        self.floor = np.full(low.shape, -np.inf)
        self.keys, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def meet(self, block: dict[str, np.ndarray]) -> None:
        x = whole_numbers(block["x"])
        if not self.same:
            for a in range(0, len(self.q), ANCHORS_AT_ONCE):
                own = np.arange(a, min(a + ANCHORS_AT_ONCE, len(self.q)))
                self.take(own, block, x, slice(None), block["labels"] != self.box["labels"][own][:, None])
            return
        for label in np.unique(self.box["labels"]):  # rows of a block are in order of their labels
            own = np.flatnonzero(self.box["labels"] == label)
            rows = slice(*np.searchsorted(block["labels"], [label, label + 1]).tolist())
            if rows.start < rows.stop:
                for a in range(0, len(own), ANCHORS_AT_ONCE):
                    self.take(own[a : a + ANCHORS_AT_ONCE], block, x, rows, True)

    def take(self, own: np.ndarray, block: dict[str, np.ndarray], x: np.ndarray, rows: slice, other: np.ndarray | bool) -> None:
        ids, x, q = block["ids"][rows], x[rows], self.q[own]
        live = (ids != self.box["ids"][own][:, None]) & other
        low, high, wide = self.low[own], self.high[own], q.dtype == object or x.dtype == object
        if not wide and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * 4 * x.shape[1] < 2.0**53:
            a, r, score = survivors(q, x, live, low.astype(float), high.astype(float), self.floor[own].astype(float), self.need)
            score = score.astype(np.int64)
        else:
            a, r, score = wide_pairs(q.astype(object), x.astype(object), live)
        keys, found, scores = [self.keys], [self.ids], [self.scores]
        for j in range(low.shape[1]):
            inside = np.flatnonzero((score >= low[a, j]) & (score <= high[a, j]) & (score >= self.floor[own][a, j]))
            keys.append(own[a[inside]] * low.shape[1] + j)
            found.append(ids[r[inside]])
            scores.append(score[inside].astype(object))
        keys_, found_, scores_ = map(np.concatenate, (keys, found, scores))
        if len(scores_) and max(abs(int(scores_.max())), abs(int(scores_.min()))) < 2**53:
            scores_ = scores_.astype(np.int64)
        first, floor = best(keys_, found_, scores_, self.need, self.low.size)
        self.keys, self.ids, self.scores = keys_[first], found_[first], scores_[first].astype(object)
        self.floor = np.maximum(self.floor, floor.reshape(self.low.shape))


def dealt(rows: DataFrame, size: int, number: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the number of their group of about ``size`` rows of one length, and the groups a length."""
    parts = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("long").alias(f"{number}s"))
    return rows.join(parts, "dim").withColumn(number, F.pmod(F.xxhash64("n", F.lit(number)), F.col(f"{number}s"))).drop(f"{number}s"), parts


def boxed(rows: DataFrame, number: str, *more: str) -> DataFrame:
    """(dim, number, box): the groups as arrays in order of label and vec_id; ``more`` are columns of lists of integers."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        x = group["x"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        box = {"ids": group["vec_id"].to_numpy(), "labels": group["label"].to_numpy(), "n": group["n"].to_numpy(), "x": x}
        for name in more:
            lists = group[name].combine_chunks()
            box[name], box[f"{name}_counts"] = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        return pa.table({"dim": [key[0].as_py()], number: [key[1].as_py()], "box": [packed(**box)]}, pa.schema([("dim", pa.int32()), (number, pa.int64()), ("box", pa.binary())]))

    return rows.groupBy("dim", number).applyInArrow(run, f"dim int, {number} long, box binary")


def met(boxes: DataFrame, blocks: DataFrame, boxes_of: DataFrame, blocks_of: DataFrame, search, schema: str) -> DataFrame:
    """Every box with every block of its length: blocks go once to each box, boxes once to each slot of blocks, and a task holds one box and the blocks of a slot."""
    sizes = boxes_of.join(blocks_of, "dim").select("dim", "boxs", F.greatest(F.least("blocks", F.lit(SLOTS)), F.ceil(F.col("blocks") / SLOTS)).cast("long").alias("slots"))
    boxes = boxes.join(sizes, "dim").select("dim", "box_no", "box", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    blocks = blocks.join(sizes, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("boxs") - 1)).alias("box_no"), F.pmod(F.col("block"), F.col("slots")).alias("slot"), F.col("rows"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        box = unpacked(left["box"][0].as_py()) if left.num_rows and right.num_rows else None
        found = None
        for blob in right["rows"] if box is not None else ():
            found = found or search(box)
            found.meet(unpacked(blob.as_py()))
        width = found.low.shape[1] if found else 1
        keys, ids, scores = (found.keys, found.ids, found.scores) if found else ((), (), ())
        keys = np.asarray(keys, np.int64)
        anchors = box["n"][keys // width] if len(keys) else np.zeros(0, np.int64)
        return pa.table({"anchor": pa.array(anchors, pa.int64()), "place": pa.array(keys % width, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array([int(s) for s in scores], pa.int64())})

    return boxes.groupBy("dim", "box_no", "slot").cogroup(blocks.groupBy("dim", "box_no", "slot")).applyInArrow(run, schema)


FOUND = "anchor long, place long, vec_id long, score long"


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, box_rows: int = BOX_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, label, embedding) that ``anchors`` chooses.

    A score is the inner product of floor(256 x), exact; beyond 64 bits it is cut to them. Higher scores come first, ties by smaller vec_id. An anchor's positives are
    its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive
    are returned. Rows with a null vec_id, label, vector or component, or one that is not finite, take no part; only vectors of one length meet. Rows with the
    anchor's vec_id are the anchor's own; repeated anchors answer once, repeated rows are candidates each. An empty table, or one without
    anchors, gives no rows. Labels are integers. Other columns are not read.
    """
    rows = save(taking_part(vectors, label).withColumn("n", F.monotonically_increasing_id()), "negatives-rows")
    asked = save(rows.where(anchors).dropDuplicates(["vec_id", "label", "x"]), "negatives-anchors")
    blocks, blocks_of = dealt(rows, block_rows, "block")
    blocks = save(boxed(blocks, "block").select("dim", "block", F.col("box").alias("rows")), "negatives-blocks")
    boxes, boxes_of = dealt(asked, box_rows, "box")
    boxes, boxes_of = boxes.withColumnRenamed("box", "box_no"), save(boxes_of, "negatives-sizes")
    blocks_of = save(blocks_of, "negatives-sizes")

    def nearest(box: dict[str, np.ndarray]) -> Search:
        whole = np.full((len(box["ids"]), 1), np.inf)
        return Search(box, -whole, whole, positives, same=True)

    def within(box: dict[str, np.ndarray]) -> Search:
        counts, shape = box["positive_counts"], (len(box["ids"]), positives)
        lows, highs = np.full(shape, MOST, object), np.full(shape, LEAST, object)
        place = np.arange(len(box["positive"])) - np.repeat(np.cumsum(counts) - counts, counts)
        for i, j, p in zip(np.repeat(np.arange(len(counts)), counts).tolist(), place.tolist(), box["positive"].tolist(), strict=True):
            lows[i, j], highs[i, j] = -(-low * p // 100), high * p // 100
        return Search(box, lows, highs, negatives, same=False)

    ranks = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    found = met(boxed(boxes, "box_no"), blocks, boxes_of, blocks_of, nearest, FOUND)
    chosen = save(found.withColumn("r", F.row_number().over(ranks)).where(F.col("r") <= positives), "negatives-positives")
    scores = chosen.groupBy(F.col("anchor").alias("n")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "score"))), lambda s: s["score"]).alias("positive"))
    found = met(boxed(boxes.join(scores, "n"), "box_no", "positive"), blocks, boxes_of, blocks_of, within, FOUND)
    ranks = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= negatives)
    ranked = ranked.select("anchor", (F.col("place") + 1).alias("r"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.join(asked.select(F.col("n").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", "r", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor", "r"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
