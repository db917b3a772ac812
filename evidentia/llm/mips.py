"""Exact top-k inner-product search with ball trees.

The top of one ball tree, fitted on a bounded sample, deals rows and queries into cells of space; a cell's rows are dealt on by a hash of
their id into shards of bounded size. Each shard becomes one ball tree, kept as a row with its center and radius. Queries of a cell are
packed into blocks. A block first searches one pilot tree of its own cell; the k-th scores found there are shared with all other
searches. Before anything moves, each block meets the balls of all shards: only the queries whose inner-product upper bound q.c + |q| r
reaches their k-th score travel to a shard, where leaves are visited by the same bound and skipped below the current k-th score.

Scores are exact integers at any size of the components: where products could leave the integers that doubles hold, doubles with an
error bound only choose the candidates, whose scores are then computed as Python integers.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import save

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 16384, 2048, 256
#: Rows, on average, that the cells are fitted on, the most cells a length of vectors has, the balls that a block meets at once, the blocks that balls meet at once.
SAMPLE_ROWS, CELLS, BALLS, BOXES = 8192, 256, 4096, 64
#: Vectors with a larger integer component go to trees and blocks of their own, so that they do not slow the others.
WIDE = 1 << 24
LEAST = np.iinfo(np.int64).min
FOUND = "query_id long, query_key long, vec_id long, score long"


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, dim, wide, key) of the vectors that take part: not null or empty, no null or non-finite component."""
    known = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0)).alias("x")).where("vec_id IS NOT NULL AND size(x) > 0")
    known = known.where(F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c)))
    return known.select("*", F.size("x").alias("dim"), F.exists("x", lambda c: F.abs(c) * 256 >= WIDE).alias("wide"), F.xxhash64("x").alias("key"))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles, exact below 2 ** 53."""
    return np.floor(x * 256.0)


def integer(x: float) -> int:
    """floor(256 x), exact at any size."""
    return math.floor(x * 256.0) if abs(x) < 2**44 else int(x) * 256


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return dict(found)


def split(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
    """The direction between two far rows, along which a node is cut."""
    far = rows[((rows - center) ** 2).sum(1).argmax()]
    return rows[((rows - far) ** 2).sum(1).argmax()] - far


def cells(sample: np.ndarray, most: int) -> list:
    """The top of a ball tree over a sample: (direction, threshold, left, right), or the number of a cell."""
    count = 0

    def node(rows: np.ndarray, room: int):
        nonlocal count
        if room > 1 and len(rows) > 1 and (along := rows @ split(rows, rows.mean(0))).min() < along.max():
            cut = float(np.median(along))
            left = along <= cut if cut < along.max() else along < cut
            return split(rows, rows.mean(0)), cut if cut < along.max() else np.nextafter(cut, -np.inf), node(rows[left], room // 2), node(rows[~left], room - room // 2)
        count += 1
        return count - 1

    return [node(sample, most), count]


def cell_of(top, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    stack = [(top, np.arange(len(rows)))]
    while stack:
        node, at = stack.pop()
        if isinstance(node, int):
            out[at] = node
        elif len(at):
            left = rows[at] @ node[0] <= node[1]
            stack += [(node[2], at[left]), (node[3], at[~left])]
    return out


def placed(rows: DataFrame, tops: dict) -> DataFrame:
    """``rows`` with their cell; wide vectors, and those of a length without a sample, are in cell 0."""
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", cell long"

    def run(batches):
        for batch in batches:
            dims, wide = batch["dim"].to_numpy(), batch["wide"].to_numpy(zero_copy_only=False)
            cell = np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims[~wide]):
                if (top := tops.get(int(d))) is not None:
                    at = np.flatnonzero((dims == d) & ~wide)
                    cell[at] = cell_of(top[0], integers(matrix(batch["x"].take(pa.array(at)))))
            yield batch.append_column("cell", pa.array(cell))

    return rows.mapInArrow(run, schema)


def build_tree(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree over floor(256 x): nodes in pre-order with center, radius, row range and children (-1 in leaves); rows of a leaf are by id.

    Centers and radii are in units of 2 ** exponent, so that they stay finite.
    """
    exponent = max(0, int(np.frexp(np.abs(x).max())[1]) + 8 - 24)
    rows = scaled(x, exponent)
    order = np.arange(len(ids))
    centers, radii, spans, kids = [], [], [], []

    def node(a: int, b: int) -> int:
        own = rows[order[a:b]]
        center = own.mean(0)
        k = len(centers)
        centers.append(center)
        radii.append(math.sqrt(((own - center) ** 2).sum(1).max()))
        spans.append((a, b))
        kids.append((-1, -1))
        if b - a > LEAF_ROWS and radii[k] > 0:
            along = own @ split(own, center)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, half)]
            kids[k] = node(a, a + half), node(a + half, b)
        return k

    node(0, len(ids))
    for (a, b), (left, _) in zip(spans, kids, strict=True):
        if left < 0:
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
    return {"ids": ids[order], "x": x[order], "centers": np.array(centers), "radii": np.array(radii), "spans": np.array(spans), "kids": np.array(kids), "exponent": np.array(exponent)}


def scaled(x: np.ndarray, exponent: int) -> np.ndarray:
    """floor(256 x) / 2 ** exponent; from 2 ** 44 on, 256 x is an integer itself."""
    if not exponent:
        return integers(x)
    small = np.abs(x) < 2.0**44
    return np.where(small, np.ldexp(np.floor(np.where(small, x, 0) * 256), -exponent), np.ldexp(x, 8 - exponent))


def bounds(centers: np.ndarray, radii: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of each query with the rows of each ball, raised by what rounding could take away."""
    top = q @ centers.T + np.sqrt((q**2).sum(1))[:, None] * radii
    return top + 1e-9 * (np.abs(top) + np.sqrt((q**2).sum(1))[:, None] * np.sqrt((centers**2).sum(1))) + 1e-6


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, x: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Branch and bound over one tree: ids and scores (number of queries by k, empty places have the least score) and the k-th scores, which only grow.

    A row with the query's own id is no candidate; ties go to the smaller id.
    """
    if tree["exponent"] > 0 or np.abs(x).max(initial=0) * 256 >= WIDE:
        return search_wide(tree, query_ids, x, kth, k)
    rows, q = integers(tree["x"]), integers(x)
    if float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * rows.shape[1] >= 2**53:
        return search_wide(tree, query_ids, x, kth, k)
    leaves = np.flatnonzero(tree["kids"][:, 0] < 0)
    place = {int(n): i for i, n in enumerate(leaves)}
    bound = np.full((len(q), len(leaves)), -np.inf)
    kth = kth.copy()
    stack = [(0, np.arange(len(q)))]
    while stack:
        n, at = stack.pop()
        top = bounds(tree["centers"][n : n + 1], tree["radii"][n : n + 1], q[at])[:, 0]
        live = top >= kth[at]
        if n in place:
            bound[at[live], place[n]] = top[live]
        elif live.any():
            stack += [(int(c), at[live]) for c in tree["kids"][n]]
    best, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    turn = np.argsort(-bound, axis=1, kind="stable")
    for t in range(len(leaves)):
        leaf = turn[:, t]
        live = np.flatnonzero((bound[np.arange(len(q)), leaf] >= kth) & (bound[np.arange(len(q)), leaf] > -np.inf))
        if not len(live):
            break
        for n in np.unique(leaf[live]):
            a, b = tree["spans"][leaves[n]]
            at = live[leaf[live] == n]
            scores = q[at] @ rows[a:b].T
            own = tree["ids"][a:b]
            scores[query_ids[at][:, None] == own] = -np.inf
            hit = scores.max(1) >= kth[at]
            at, scores = at[hit], scores[hit]
            if not len(at):
                continue
            first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            all_scores = np.hstack([best[at], np.take_along_axis(scores, first, 1)])
            all_ids = np.hstack([ids[at], own[first]])
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[at], ids[at] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
            kth[at] = np.maximum(kth[at], best[at, k - 1])
    return ids, np.where(best > -np.inf, best, 0).astype(np.int64) + np.where(best > -np.inf, 0, LEAST), kth


def search_wide(tree: dict[str, np.ndarray], query_ids: np.ndarray, x: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``search`` for components of any size: doubles with an error bound choose the candidates, Python integers decide.

    Scores that leave 64 bits are ranked exactly and then written as the nearest 64-bit number. The k-th scores are handed back as they were.
    """
    e, f = int(tree["exponent"]), max(0, int(np.frexp(np.abs(x).max(initial=0))[1]) + 8 - 24)
    rows, q = scaled(tree["x"], e), scaled(x, f)
    unit = 1 << (e + f)
    near = 1e-14 * rows.shape[1] * np.sqrt((q**2).sum(1)) * math.sqrt((rows**2).sum(1).max()) + 1e-6
    least = np.ldexp(kth, -(e + f)) - near
    exact: list[list[tuple[int, int]]] = [[] for _ in q]
    whole: dict[int, list[int]] = {}
    leaves = np.flatnonzero(tree["kids"][:, 0] < 0)
    top = bounds(tree["centers"][leaves], tree["radii"][leaves], q)
    for i in range(len(q)):
        asked = [integer(c) for c in x[i].tolist()]
        for n in np.argsort(-top[i], kind="stable"):
            if top[i, n] < least[i]:
                break
            a, b = tree["spans"][leaves[n]]
            about = np.where(tree["ids"][a:b] == query_ids[i], -np.inf, rows[a:b] @ q[i])
            floor = max(least[i], (np.partition(about, -k)[-k] if b - a > k else -np.inf) - 2 * near[i])
            for j in (a + np.flatnonzero((about >= floor) & (about > -np.inf))).tolist():
                if j not in whole:
                    whole[j] = [integer(c) for c in tree["x"][j].tolist()]
                exact[i].append((-sum(s * t for s, t in zip(asked, whole[j], strict=True)), int(tree["ids"][j])))
            exact[i] = sorted(exact[i])[:k]
            if len(exact[i]) == k:
                least[i] = max(least[i], -exact[i][-1][0] / unit - 2 * near[i])
    ids, best = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), LEAST)
    for i, found in enumerate(exact):
        for r, (s, own) in enumerate(found):
            ids[i, r], best[i, r] = own, min(max(-s, LEAST + 1), -LEAST - 1)
    return ids, best, kth


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the highest inner products of floor(256 x) for each row of ``queries``.

    Both have columns vec_id and embedding. Only vectors of one length meet. A row with the query's vec_id is the query's own. Repeated
    queries answer once, repeated rows are candidates each. No vectors, or none that take part, give no rows. Other columns are not read.
    """
    rows = taking_part(vectors)
    total = rows.count()
    share = int(min(1.0, SAMPLE_ROWS / max(1, total)) * (1 << 20))
    sample = rows.where(~F.col("wide") & (F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(1 << 20)) < share)).select("dim", "x").toArrow()
    dims, most = sample["dim"].to_numpy(), min(CELLS, math.ceil(total / shard_rows))
    tops = {int(d): cells(integers(matrix(sample["x"].take(pa.array(np.flatnonzero(dims == d))))), most) for d in np.unique(dims)}

    def grown(key: tuple, group: pa.Table) -> pa.Table:
        tree = build_tree(group["vec_id"].to_numpy(), matrix(group["x"]))
        own = {"dim": [key[0].as_py()], "cell": [key[2].as_py()], "part": [key[3].as_py()], "wide": [key[1].as_py()], "tree": [packed(**tree)], "center": [(np.ldexp(tree["centers"][0], int(tree["exponent"]))).tolist()], "radius": [float(np.ldexp(tree["radii"][0], int(tree["exponent"])))]}
        return pa.table(own, pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("part", pa.int64()), ("wide", pa.bool_()), ("tree", pa.binary()), ("center", pa.list_(pa.float64())), ("radius", pa.float64())]))

    def boxed(key: tuple, group: pa.Table) -> pa.Table:
        box = packed(ids=group["vec_id"].to_numpy(), keys=group["key"].to_numpy(), x=matrix(group["x"]), kth=np.full(group.num_rows, -np.inf))
        return pa.table({"dim": [key[0].as_py()], "cell": [key[2].as_py()], "turn": [key[3].as_py()], "box": [box]}, pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("turn", pa.int64()), ("box", pa.binary())]))

    def dealt(found: DataFrame, size: int) -> DataFrame:
        """Groups of about ``size`` rows within a cell."""
        keys = ["dim", "wide", "cell"]
        sizes = found.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
        return found.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts"))).groupBy(*keys, "part")

    grown_ = dealt(save(placed(rows, tops), "mips-rows"), shard_rows).applyInArrow(grown, "dim int, cell long, part long, wide boolean, tree binary, center array<double>, radius double")
    trees = save(grown_.withColumn("shard", F.monotonically_increasing_id()), "mips-trees")
    asked = save(placed(taking_part(queries), tops).dropDuplicates(["vec_id", "key"]), "mips-asked")
    boxes = dealt(asked, block_queries).applyInArrow(boxed, "dim int, cell long, turn long, box binary")

    def seeded(batches):
        for batch in batches:
            for dim, box, tree in zip(*[batch[c].to_pylist() for c in ("dim", "box", "tree")], strict=True):
                box = unpacked(box)
                if tree is not None:
                    box["kth"] = search(unpacked(tree), box["ids"], box["x"], box["kth"], k)[2]
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "box": pa.array([packed(**box)], pa.binary())})

    pilots = trees.where("NOT wide AND part = 0").select("dim", "cell", "tree")
    boxes = save(boxes.join(pilots, ["dim", "cell"], "left").select("dim", "box", "tree").mapInArrow(seeded, "dim int, box binary"), "mips-queries")

    def reaching(batches):
        for batch in batches:
            for box, balls in zip(batch["box"].to_pylist(), batch["balls"].to_pylist(), strict=True):
                box = unpacked(box)
                q = integers(box["x"])
                with np.errstate(over="ignore", invalid="ignore"):
                    top = bounds(np.array([b["center"] for b in balls]), np.array([b["radius"] for b in balls]), q)
                for b, column in zip(balls, top.T, strict=True):
                    if len(at := np.flatnonzero(~(column < box["kth"]))):  # a bound that is no number reaches
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([b["shard"]]), "box": pa.array([packed(**{n: v[at] for n, v in box.items()})], pa.binary())})

    # a chunk of balls goes to every slot of boxes, a box to every chunk, so that no key grows with the table
    chunks, slots = max(1, math.ceil(total / shard_rows / BALLS)), max(1, math.ceil(boxes.count() / BOXES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    balls = trees.groupBy("dim", F.pmod(F.col("shard"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("shard", "center", "radius")).alias("balls"))
    balls = balls.select("dim", "chunk", spread(slots).alias("slot"), "balls")
    boxes = boxes.select("dim", spread(chunks).alias("chunk"), F.pmod(F.xxhash64("box"), F.lit(slots)).cast("int").alias("slot"), "box")
    pieces = boxes.join(balls, ["dim", "chunk", "slot"]).select("box", "balls").mapInArrow(reaching, "shard long, box binary")

    def answered(batches):
        for batch in batches:
            for box, tree in zip(batch["box"].to_pylist(), batch["tree"].to_pylist(), strict=True):
                box = unpacked(box)
                ids, best, _ = search(unpacked(tree), box["ids"], box["x"], box["kth"], k)
                at, place = np.nonzero(best > LEAST)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(box["ids"][at]), "query_key": pa.array(box["keys"][at]), "vec_id": pa.array(ids[at, place]), "score": pa.array(best[at, place])})

    found = pieces.join(trees.select("shard", "tree"), "shard").select("box", "tree").mapInArrow(answered, FOUND)
    ranks = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
