"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one point. Centers fitted on a bounded sample deal the points into cells, each point into its nearest two, so that the shards
of neighbouring cells overlap. Every shard becomes a graph of bounded degree: the candidates of a node, its nearest rows of the shard and
some far ones, are pruned robustly (a candidate goes if a chosen neighbour is nearer to it by a factor than the node is). A node's lists of
all its shards are united. Every point then searches the shards of its nearest cells: a greedy search from the shard's medoid (and from
the point itself, where the shard holds it) over the united lists, whose beam is widened as long as half of it is within the range.

Pairs found are decided in doubles; a task returns a forest of its links, not the pairs, so that a group of n near copies costs n rows, and
components join the forests. Links are then counted by exact products within each component, which holds all links of its members. An
audit compares a bounded set of points with all points by brute force; while it finds too little, the search is repeated with wider beams and
more cells.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.mips import matrix
from evidentia.operators.iterate import components, save

SIMILARITY = 0.95
#: Rows of a shard on average, cells a point lies in, cells a point searches, queries of a search task.
SHARD_ROWS, OVERLAP, PROBES, QUERY_ROWS = 4096, 2, 3, 8192
#: Rows, on average, that the centers are fitted on, and the numbers that these hold at most; most cells a length has; turns of the fit. A cell beyond its share is dealt into several shards.
SAMPLE_ROWS, SAMPLE_NUMBERS, MOST_CELLS, TURNS = 16384, 1 << 22, 1024, 4
#: Degree of a node, near and far candidates, and the factor of the pruning.
DEGREE, NEAR, FAR, ALPHA = 24, 48, 16, 1.2
#: Width of a beam, nodes that a step expands at least, queries that step together.
BEAM, STEP, TOGETHER = 24, 4, 256
#: Points of the audit, least recall, and how often the search may be widened.
AUDIT_POINTS, RECALL, WIDENINGS = 256, 0.98, 2
#: Members of a component that meet as one block.
BLOCK_ROWS = 2048

log = logging.getLogger(__name__)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(x, dim) added: the vector over its length, null where it is null, empty, zero, or has a component that is null or not finite."""
    wide = F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0))
    good = F.forall(wide, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c))
    most = F.array_max(F.transform(wide, F.abs))
    kept = F.when((F.size("embedding") > 0) & good & (most > 0), F.transform(wide, lambda c: c / most))  # no square overflows or vanishes
    rows = vectors.withColumn("x", kept)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    return rows.withColumn("x", F.transform("x", lambda c: c / norm)).withColumn("dim", F.size("x"))


@dataclass
class Cells:
    """Centers of each length of vectors."""

    centers: dict[int, np.ndarray]

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        found = self.centers.get(x.shape[1])
        if found is None or len(found) == 1:
            return np.zeros((len(x), 1), np.int64)
        count = min(count, len(found))
        return np.argsort(-(x @ found.T), axis=1, kind="stable")[:, :count]


def fitted(points: DataFrame, total: int, shard_rows: int) -> Cells:
    """Centers of a bounded sample: rows of it at first, then means of the rows nearest to each."""
    length = points.agg(F.avg("dim").alias("dim")).collect()[0]["dim"] or 1
    share = int(min(1.0, min(SAMPLE_ROWS, SAMPLE_NUMBERS / length) / max(1, total)) * (1 << 20))
    sample = points.where(F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1 << 20)) < share).select("dim", "x").toArrow()
    dims, centers = sample["dim"].to_numpy(), {}
    for d in np.unique(dims).tolist():
        rows = matrix(sample["x"].take(pa.array(np.flatnonzero(dims == d))))
        most = min(MOST_CELLS, math.ceil(total * len(rows) / max(1, len(dims)) * OVERLAP / shard_rows), max(1, len(rows) // 8))
        found = rows[np.random.default_rng(7).permutation(len(rows))[:most]]
        for _ in range(TURNS):
            near = (rows @ found.T).argmax(1)
            sums = np.zeros_like(found)
            np.add.at(sums, near, rows)
            norms = np.sqrt((sums**2).sum(1, keepdims=True))
            found = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), found)
        centers[d] = found
    return Cells(centers)


def pruned(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The neighbours of ``nodes`` from their rows of candidates (-1: none), by robust pruning; -1 fills the rows."""
    out = np.full((len(nodes), degree), -1, np.int64)
    valid = (candidates >= 0) & (candidates != nodes[:, None])
    rows = x[np.maximum(candidates, 0)]
    far = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ncd,nd->nc", rows, x[nodes])))
    between = np.sqrt(np.maximum(0.0, 2 - 2 * rows @ rows.transpose(0, 2, 1)))
    far = np.where(valid, far, np.inf)
    every = np.arange(len(nodes))
    for k in range(degree):
        chosen = far.argmin(1)
        some = np.isfinite(far[every, chosen])
        if not some.any():
            break
        out[some, k] = candidates[every, chosen][some]
        gone = alpha * between[every, chosen] <= far
        far[some[:, None] & gone] = np.inf
        far[every, chosen] = np.inf
    return out


def graph(x: np.ndarray) -> np.ndarray:
    """Rows of neighbours (-1: none) of each row of unit vectors."""
    n, r = len(x), np.random.default_rng(11)
    first = np.full((n, DEGREE), -1, np.int64)
    near, far = min(NEAR, n - 1), min(FAR, n - 1)
    if n < 2:
        return first
    for a in range(0, n, TOGETHER):
        own = np.arange(a, min(a + TOGETHER, n))
        likeness = x[own] @ x.T
        likeness[np.arange(len(own)), own] = -np.inf
        close = np.argpartition(-likeness, near - 1, axis=1)[:, :near]
        first[own] = pruned(x, own, np.hstack([close, r.integers(0, n, (len(own), far))]))
    # links back, the nearest of a node first, then pruned again
    a, k = np.nonzero(first >= 0)
    source, target = np.concatenate([a, first[a, k]]), np.concatenate([first[a, k], a])
    both = np.unique(source * n + target)
    source, target = both // n, both % n
    likeness = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-likeness, source))
    source, target = source[order], target[order]
    place = np.arange(len(source)) - np.searchsorted(source, source)
    kept = place < 3 * DEGREE
    wide = np.full((n, 3 * DEGREE), -1, np.int64)
    wide[source[kept], place[kept]] = target[kept]
    return np.vstack([pruned(x, np.arange(a, min(a + TOGETHER, n)), wide[a : a + TOGETHER]) for a in range(0, n, TOGETHER)])


def in_range(x: np.ndarray, lists: np.ndarray, q: np.ndarray, own: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a cosine of ``least`` or more that range-expanding greedy search finds. own: a query's own node, -1 if it has none."""
    medoid = int((x @ x.mean(0)).argmax())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), TOGETHER):
        todo, width = np.arange(a, min(a + TOGETHER, len(q))), beam
        while len(todo):
            hits, nodes = _searched(x, lists, q[todo], own[todo], medoid, least, width)
            more = np.bincount(hits, minlength=len(todo)) * 2 >= width if width < len(x) else np.zeros(len(todo), bool)
            done = ~more[hits]
            found.append((todo[hits[done]], nodes[done]))
            todo, width = todo[more], 4 * width
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _searched(x: np.ndarray, lists: np.ndarray, q: np.ndarray, own: np.ndarray, medoid: int, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, m, step = len(x), len(q), max(STEP, width // 8)
    width = min(width, n)
    seen = np.zeros(m * n, bool)
    ids, likeness, open_ = np.full((m, width), -1, np.int64), np.full((m, width), -np.inf), np.zeros((m, width), bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    every = np.arange(m)
    new = np.unique(np.concatenate([every * n + medoid, (every * n + own)[own >= 0]]))
    while len(new):
        seen[new] = True
        who, node = new // n, new % n
        like = np.einsum("ij,ij->i", q[who], x[node])
        hits.append((who[like >= least], node[like >= least]))
        place = np.arange(len(who)) - np.searchsorted(who, who)
        more = np.full((m, int(place.max()) + 1), -1, np.int64)
        more_like = np.full(more.shape, -np.inf)
        more[who, place], more_like[who, place] = node, like
        ids, likeness, open_ = np.hstack([ids, more]), np.hstack([likeness, more_like]), np.hstack([open_, more >= 0])
        keep = np.argpartition(-likeness, width - 1, axis=1)[:, :width]
        ids, likeness, open_ = (np.take_along_axis(v, keep, 1) for v in (ids, likeness, open_))
        ahead = np.where(open_, likeness, -np.inf)
        take = min(step, width)
        chosen = np.argpartition(-ahead, take - 1, axis=1)[:, :take]
        valid = np.take_along_axis(ahead, chosen, 1) > -np.inf
        who, col = every[:, None].repeat(take, 1)[valid], chosen[valid]
        open_[who, col] = False
        onward = lists[ids[who, col]]
        at = who[:, None] * n + onward
        new = np.unique(at[onward >= 0])
        new = new[~seen[new]]
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex that it reaches) for the vertices of the pairs that reach a smaller one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        low = np.minimum(top[x], top[y])
        before = top.copy()
        np.minimum.at(top, top[x], low)
        np.minimum.at(top, top[y], low)
        top = top[top]
        if (top == before).all():
            break
    small = np.flatnonzero(top != np.arange(len(names)))
    return names[small], names[top[small]]


def graph_lists(shards: DataFrame) -> DataFrame:
    """(id, neighbors): the united lists of every point of the shards (dim, cell, part, id, x)."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        ids, lists = group["id"].to_numpy(), graph(matrix(group["x"]))
        sizes = (lists >= 0).sum(1)
        return pa.table({"id": ids, "neighbors": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids[lists[lists >= 0]], pa.int64()))})

    own = save(shards.groupBy("dim", "cell", "part").applyInArrow(build, "id long, neighbors array<long>"), "graph-lists")
    return save(own.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbors"))).alias("neighbors")), "graph-united")


def searched(placed: DataFrame, shards: DataFrame, lists: DataFrame, similarity: float, probes: int, beam: int) -> DataFrame:
    """Forest edges (a, b) of the links that the points (dim, id, x, cells) find in the shards of their first ``probes`` cells."""
    cell = ["dim", "cell"]
    parts = shards.groupBy(*cell).agg((F.max("part") + 1).alias("parts"))
    asked = placed.select("dim", "id", "x", F.explode(F.slice("cells", 1, probes)).alias("cell"))
    slots = asked.groupBy(*cell).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("slots"))
    sizes = save(parts.join(slots, cell), "graph-sizes")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = asked.join(sizes, cell).select(*cell, spread("parts").alias("part"), F.pmod(F.xxhash64("id", F.lit("slot")), F.col("slots")).alias("slot"), "id", "x")
    nodes = shards.join(lists, "id").join(sizes.drop("parts"), cell).select(*cell, "part", spread("slots").alias("slot"), "id", "x", "neighbors")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        right = right.sort_by("id")
        ids, x, q = right["id"].to_numpy(), matrix(right["x"]), matrix(left["x"])
        flat = right["neighbors"].combine_chunks()
        at, target = np.repeat(np.arange(len(ids)), np.diff(flat.offsets.to_numpy())), flat.flatten().to_numpy()
        local = np.minimum(np.searchsorted(ids, target), len(ids) - 1)
        here = ids[local] == target
        at, local = at[here], local[here]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        near = np.full((len(ids), int(place.max(initial=0)) + 1), -1, np.int64)
        near[at, place] = local
        asking = left["id"].to_numpy()
        own = np.minimum(np.searchsorted(ids, asking), len(ids) - 1)
        who, node = in_range(x, near, q, np.where(ids[own] == asking, own, -1), similarity, beam)
        a, b = forest(asking[who], ids[node])
        return pa.table({"a": a, "b": b})

    by = [*cell, "part", "slot"]
    return asked.groupBy(*by).cogroup(nodes.groupBy(*by)).applyInArrow(run, "a long, b long")


def counted(members: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """(id, links) for the members (root, id, x, copies) of components: the copies of the other members with this cosine or more.

    Small components are counted many in a task. Large ones are cut into blocks; a task holds one block and some of those that it meets, one after the other.
    """
    sizes = save(members.groupBy("root").agg(F.count("*").alias("size")), "graph-components")
    members = members.join(sizes, "root")
    total = sizes.where(F.col("size") <= block_rows).agg(F.sum("size").alias("n")).collect()[0]["n"] or 0

    def own(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("root")
        roots, x, copies = group["root"].to_numpy(), matrix(group["x"]), group["copies"].to_numpy()
        out = np.zeros(len(roots), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(roots)], strict=True):
            out[a:b] = (x[a:b] @ x[a:b].T >= similarity) @ copies[a:b] - copies[a:b]
        return pa.table({"id": group["id"], "links": out})

    buckets = F.pmod(F.xxhash64("root"), F.lit(max(1, math.ceil(total / (2 * block_rows)))).cast("long"))
    small = members.where(F.col("size") <= block_rows).select("dim", buckets.alias("bucket"), "root", "id", "x", "copies")
    small = small.groupBy("dim", "bucket").applyInArrow(own, "id long, links long")

    blocks = F.ceil(F.col("size") / block_rows).cast("long")
    large = members.where(F.col("size") > block_rows).select("root", "id", "x", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("id", F.lit("block")), blocks).alias("block"))
    slot = lambda b: F.floor(b / 32)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    left = large.select("root", "block", spread(slot(F.col("blocks") - 1)).alias("slot"), "id", "x", "copies")
    right = large.select("root", spread(F.col("blocks") - 1).alias("block"), slot(F.col("block")).alias("slot"), "id", "x", "copies")
    right = right.toDF(*[f"other_{c}" for c in right.columns])

    def across(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out, x = np.zeros(a.num_rows, np.int64), matrix(a["x"]) if a.num_rows else None
        ids = a["id"].to_numpy()
        for at in range(0, b.num_rows if a.num_rows else 0, block_rows):
            part = b.slice(at, block_rows)
            near = x @ matrix(part["other_x"]).T >= similarity
            near[ids[:, None] == part["other_id"].to_numpy()] = False
            out += near @ part["other_copies"].to_numpy()
        return pa.table({"id": ids, "links": out})

    by = ["root", "block", "slot"]
    large = left.groupBy(*by).cogroup(right.groupBy(*[f"other_{c}" for c in by])).applyInArrow(across, "id long, links long")
    return small.unionByName(large).groupBy("id").agg(F.sum("links").alias("links"))


def audited(points: DataFrame, links: DataFrame, similarity: float, most: int = AUDIT_POINTS) -> float:
    """Share of the links of a bounded set of points, chosen by a hash of their ids, with other points that ``links`` (id, links) counts; 1 if there are none. Brute force over all points."""
    probe = points.select("id", "dim", "x", "copies").orderBy(F.xxhash64("id", F.lit("audit"))).limit(most).toArrow()
    dims, ids, own = probe["dim"].to_numpy(), probe["id"].to_numpy(), probe["copies"].to_numpy()
    rows = {d: (at := np.flatnonzero(dims == d), matrix(probe["x"].take(pa.array(at)))) for d in np.unique(dims).tolist()}

    def run(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            here, copies = batch["dim"].to_numpy(), batch["copies"].to_numpy()
            for d in set(np.unique(here).tolist()) & set(rows):
                at = np.flatnonzero(here == d)
                of, x = rows[d]
                total[of] += (x @ matrix(batch["x"].take(pa.array(at))).T >= similarity) @ copies[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(total)], ["k", "links"])

    true = dict(points.select("dim", "x", "copies").mapInArrow(run, "k long, links long").groupBy("k").agg(F.sum("links")).toArrow().to_pandas().itertuples(index=False)) if len(ids) else {}
    asked = links.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
    found = dict(asked.join(links, "id").select("id", "links").toArrow().to_pandas().itertuples(index=False))
    want = sum(int(true.get(k, 0)) - int(own[k]) for k in range(len(ids)))
    return sum(int(v) for v in found.values()) / want if want > 0 else 1.0


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, shard_rows: int = SHARD_ROWS, probes: int = PROBES, beam: int = BEAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Rows are linked at a cosine of ``similarity`` or more, in doubles; n_links counts the other rows linked directly, component_id is the smallest vec_id that a
    row reaches, itself included. Vectors that are null, empty, zero, or hold a component that is null or not finite link with nothing, and only vectors of
    one length meet. Repeated rows are rows each, linked with each other. Rows without a vec_id are in no component and link with nothing. An
    empty table gives no rows. Other columns are not read.
    """
    rows = save(unit_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).drop("embedding"), "graph-rows")
    linked = rows.where("x IS NOT NULL AND vec_id IS NOT NULL")
    points = linked.groupBy("x").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("dim").alias("dim"))
    points = save(points.withColumn("id", F.monotonically_increasing_id()), "graph-points")
    total = points.count()
    cells = fitted(points, total, shard_rows)
    widest = max([probes, *map(len, cells.centers.values())])
    probed = min(widest, probes * 4**WIDENINGS)

    def place(batches):
        for batch in batches:
            dims, out = batch["dim"].to_numpy(), [None] * batch.num_rows
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i, found in zip(at.tolist(), cells.nearest(matrix(batch["x"].take(pa.array(at))), probed).tolist(), strict=True):
                    out[i] = found
            yield batch.append_column("cells", pa.array(out, pa.list_(pa.int64())))

    placed = save(points.select("dim", "id", "x", "copies", "least").mapInArrow(place, "dim int, id long, x array<double>, copies long, least long, cells array<long>"), "graph-placed")
    inside = placed.select("dim", "id", "x", F.explode(F.slice("cells", 1, OVERLAP)).alias("cell"))
    sizes = inside.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("parts"))
    shards = inside.join(sizes, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).alias("part"), "id", "x")
    shards = save(shards, "graph-shards")
    lists = graph_lists(shards)
    for turn in range(WIDENINGS + 1):
        edges = save(searched(placed, shards, lists, similarity, probes * 4**turn, beam * 4**turn), "graph-edges")
        roots = save(components(edges), "graph-roots")
        members = placed.join(roots, placed["id"] == roots["v"]).select("dim", "root", "id", "x", "copies")
        links = save(counted(members, similarity, block_rows), "graph-links")
        recall = audited(placed, links, similarity)
        log.info("recall %.4f with %d cells and a beam of %d", recall, probes * 4**turn, beam * 4**turn)
        if recall >= RECALL:
            break
    named = points.join(roots, points["id"] == roots["v"], "left").join(links, "id", "left").select("x", "least", "copies", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = save(named, "graph-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    told = save(named.join(least, "root").select("x", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "graph-told")
    alone = rows.where("x IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.join(told, "x").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
