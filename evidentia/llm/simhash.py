"""SimHash near-duplicates with BK-trees.

Fingerprints of whole texts are grouped first, so copies cost one row. Distinct fingerprints are dealt into shards by the bits under
masks: two fingerprints that differ in at most r bits agree on all but r of r + 2 equal blocks, hence on one mask of two blocks (for
r = 2). A shard becomes a BK-tree whose children are keyed by their Hamming distance to the parent, and a lookup follows only edges
within the radius. A shard with more fingerprints than a tree may hold is dealt again by three parts of the bits that its mask leaves
open, until it fits: with all but nine bits fixed at most 512 distinct fingerprints remain. Trees are built in the task that holds the
shard, not broadcast, since all trees together grow with the corpus. A shard returns a spanning forest of its links, so the links
stay linear in the fingerprints; components then follow on Spark.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import map_chunks, row_hash
from evidentia.operators.iterate import components, save

BITS, SEED, RADIUS, TREE_ROWS = 64, 42, 2, 512
#: Shingles whose bits are counted at once.
SLICE = 1 << 15


def shingles(text: str | None, words: int) -> list[bytes]:
    """The word shingles of a whole text in order, repeats included, A-Z in lower case; with fewer words the whole sequence, with none nothing."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    if len(tokens) <= words:
        return [b" ".join(tokens)]
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(parts: list[bytes], seed: int = SEED) -> int:
    """Bit k is 1 if it is set in over half of the XXH64 of the parts; 0 without parts."""
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(parts), SLICE):
        raw = np.frombuffer(b"".join([digest(p, seed) for p in parts[at : at + SLICE]]), np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(parts)).tobytes(), "big") if parts else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; a null text has no words."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "fp": [signed(fingerprint(shingles(t, words))) for t in rows["text"]]}

    return map_chunks(docs.select("doc_id", "text"), make, "doc_id long, fp long")


class BKTree:
    """Children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, point: int, radius: int) -> list[int]:
        """The numbers of the points within the radius; only edges whose distance could lead there are followed."""
        near: list[int] = []
        stack = [0] if self.points else []
        while stack:
            node = stack.pop()
            d = (point ^ self.points[node]).bit_count()
            if d <= radius:
                near.append(node)
            kids = self.children[node]
            if len(kids) <= 2 * radius + 1:
                stack += [c for e, c in kids.items() if abs(e - d) <= radius]
            else:
                stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return near

    def insert(self, point: int) -> None:
        node, number = 0, len(self.points)
        while number:
            d = (point ^ self.points[node]).bit_count()
            if d not in self.children[node]:
                self.children[node][d] = number
                break
            node = self.children[node][d]
        self.points.append(point)
        self.children.append({})

    def add(self, point: int, radius: int) -> list[int]:
        """Adds a point; the numbers of earlier points within the radius."""
        near = self.near(point, radius)
        self.insert(point)
        return near


def forest(fps: list[int], ids: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges of a forest whose trees are the sets of fingerprints linked within a shard; each is a balanced tree by id, so no id becomes a hub."""
    tree, top = BKTree(), list(range(len(fps)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, fp in enumerate(fps):
        for j in tree.add(fp, radius):
            top[root(j)] = root(i)
    sets: dict[int, list[int]] = {}
    for i, own in enumerate(ids):
        sets.setdefault(root(i), []).append(own)
    return [(own[(k - 1) // 2], own[k]) for own in map(sorted, sets.values()) for k in range(1, len(own))]


def first_masks(radius: int) -> list[int]:
    """Masks of two of radius + 2 equal blocks: any two fingerprints within the radius agree under one of them."""
    edges = [round(k * BITS / (radius + 2)) for k in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def finer(mask: int, radius: int) -> list[int]:
    """Masks that add one of radius + 1 parts of the open bits to a mask."""
    open_bits = [k for k in range(BITS) if not mask >> k & 1]
    return [mask | sum(1 << k for k in open_bits[p :: radius + 1]) for p in range(radius + 1)]


def _dealt(points: DataFrame, masks: DataFrame) -> DataFrame:
    return points.join(F.broadcast(masks), "parent").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp", "id")


def _linked(shards: DataFrame, radius: int) -> DataFrame:
    """Forest edges of every shard; rows of a shard are together and in order."""

    def run(batches):
        key, fps, ids, out = None, [], [], []
        for batch in batches:
            for mask, value, fp, i in zip(*[batch[c].to_pylist() for c in ("mask", "value", "fp", "id")], strict=True):
                if (mask, value) != key:
                    out += forest(fps, ids, radius)
                    key, fps, ids = (mask, value), [], []
                fps.append(fp & (1 << 64) - 1)
                ids.append(i)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out := out + forest(fps, ids, radius):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return shards.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(run, "a long, b long")


def links(points: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Edges (a, b) between ids of distinct fingerprints (fp, id) that connect exactly those within the radius, directly or through others."""
    spark = points.sparkSession
    masks = [(0, m) for m in first_masks(radius)]
    shards, edges = points.withColumn("parent", F.lit(0).cast("long")), []
    while masks:
        plan = spark.createDataFrame([(signed(a), signed(b)) for a, b in masks], "parent long, mask long")
        rows = save(_dealt(shards, plan), "simhash-shards")
        sizes = save(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
        met = rows.join(sizes, ["mask", "value"])
        edges.append(save(_linked(met.where(F.col("n") <= tree_rows).drop("n"), radius), "simhash-edges"))
        if sizes.where(F.col("n") > tree_rows).isEmpty():
            break
        shards = met.where(F.col("n") > tree_rows).select(F.col("mask").alias("parent"), "fp", "id")
        masks = [(m, f) for m in dict.fromkeys(m for _, m in masks) for f in finer(m, radius)]
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints within the radius are linked and component_id is the smallest doc_id that a row reaches, itself included. A text
    without words has fingerprint zero and is linked like any other. Repeated rows repeat. A row with a null doc_id gets the
    component of its fingerprint, null if no row with an id has that fingerprint, and links no others.
    """
    rows = save(fingerprints(docs, words), "simhash-fingerprints")
    points = save(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-points")
    roots = components(links(points, radius))
    named = save(points.join(roots, points["id"] == roots["v"], "left").select("fp", F.coalesce("root", "id").alias("component_id")), "simhash-components")
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of 0.8 or more: shards by minima, candidates by BK-trees over wide sketches, decided by the shingles

#: Words in a shingle, least Jaccard similarity.
WORDS, SIMILARITY = 5, 0.8
#: Bands and minima in a band. A pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 25 = 0.99995, however many documents there are.
BANDS, MINIMA = 25, 5
#: Odd factors that give each minimum its own order of the 64-bit hashes.
FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % k, SEED) | 1 for k in range(BANDS * MINIMA)], np.uint64)
#: 64-bit parts of a sketch, and the bits in which sketches of candidates may differ. A pair at similarity 0.8 differs in up to 0.1525 of them on average, in up to
#: 0.19 if a text has less than FEW shingles, so that each radius is four standard deviations away.
PARTS, SKETCH_RADIUS, FEW, FEW_RADIUS = 32, 377, 10, 460
#: How many of the nearest candidates of a component outside the largest of its shard are compared in each round; then all that are left.
NEAREST = (3, None)
SALTS = np.array([xxhash.xxh64_intdigest(b"part %d" % k, SEED) for k in range(PARTS)], np.uint64)
#: Sketches that a tree of a shard holds, and that meet a tree at once.
SHARD_ROWS = 1024
#: Hashes of shingles that a comparing task remembers.
REMEMBERED = 1 << 21


def hashed(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 of the shingles of a text, in order."""
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(p, SEED) for p in shingles(text, words)]), ">u8").astype(np.uint64))


def bands_of(hashes: np.ndarray) -> list[int]:
    """A 64-bit number a band; equal sets have equal bands, and no two bands share a number. Nothing for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * FACTORS).min(0), out=least)
    return [signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, MINIMA))]


def sketch_of(hashes: np.ndarray) -> bytes:
    """A SimHash of 64 * PARTS bits: a bit is 1 if it is set in over half of the mixed hashes."""
    counts = np.zeros(BITS * PARTS, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] ^ SALTS
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        counts += np.unpackbits((x ^ x >> np.uint64(33)).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def sketched(texts: DataFrame, words: int) -> DataFrame:
    """(id, text, bands) with the sketch of each text and whether it has few shingles."""

    def make():
        def step(rows: dict) -> dict:
            sets = [hashed(t, words) for t in rows["text"]]
            return rows | {"sketch": list(map(sketch_of, sets)), "few": [len(s) < FEW for s in sets]}

        return step

    return map_chunks(texts, make, "id long, text string, bands array<long>, sketch binary, few boolean")


def similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) have at least this Jaccard similarity of distinct shingles."""
    least = Fraction(str(similarity))

    def run(batches):
        known: dict[str, np.ndarray] = {}
        held = 0

        def of(text: str) -> np.ndarray:
            nonlocal held
            if (found := known.pop(text, None)) is None:
                found = hashed(text, words)
                held += len(found)
            known[text] = found  # the last in use stands last
            while held > REMEMBERED and len(known) > 2:
                held -= len(known.pop(next(iter(known))))
            return found

        for batch in batches:
            out = []
            for a, b, s, t in zip(*[batch[c].to_pylist() for c in ("a", "b", "s", "t")], strict=True):
                x, y = of(s), of(t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * least.denominator >= least.numerator * (len(x) + len(y) - both):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    to = lambda c, t: texts.select(F.col("id").alias(c), F.col("text").alias(t))
    return pairs.join(to("a", "s"), "a").join(to("b", "t"), "b").mapInArrow(run, "a long, b long")


def candidates(open_: DataFrame, nearest: int | None) -> DataFrame:
    """Pairs (a, b) of the members (band, id, bands, sketch, few, label, main) of open shards whose sketches are within the radius and whose labels differ.

    The members outside the largest component of a shard become BK-trees, which are sent to all blocks of members of the shard. Each of
    their labels gives its ``nearest`` pairs of a tree and a block, or all. A pair that shares several shards comes from the first of them only.
    """
    size = open_.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("main")).alias("m"))
    turn = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.ceil(F.col(n) / SHARD_ROWS).cast("long")).alias("block")
    rows = open_.join(size, "band")
    packed = F.collect_list(F.struct("id", "label", "sketch", "few", "bands"))
    trees = rows.where("label <> main").select("band", turn("m"), "id", "label", "sketch", "few", "bands").groupBy("band", "block").agg(packed.alias("tree")).drop("block")
    blocks = rows.select("band", turn("n"), "id", "label", "sketch", "few", "bands").groupBy("band", "block").agg(packed.alias("met")).drop("block")

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for band, tree_rows, met in zip(*[batch[c].to_pylist() for c in ("band", "tree", "met")], strict=True):
                out += met_pairs(band, tree_rows, met, nearest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return trees.join(blocks, "band").select("band", "tree", "met").mapInArrow(run, "a long, b long").distinct()


def met_pairs(band: int, tree_rows: list[dict], met: list[dict], nearest: int | None) -> list[tuple[int, int]]:
    """Pairs of a tree's members with those that meet it, whose first common band this is; with ``nearest`` only so many of the smallest distance for each label of the tree."""
    tree, found = BKTree(), {}
    bands = [frozenset(r["bands"]) for r in tree_rows]
    for r in tree_rows:
        tree.insert(int.from_bytes(r["sketch"], "big"))
    for r in met:
        point = int.from_bytes(r["sketch"], "big")
        for at in tree.near(point, FEW_RADIUS):
            other = tree_rows[at]
            if r["label"] != other["label"]:
                d = (point ^ tree.points[at]).bit_count()
                if (d <= SKETCH_RADIUS or r["few"] or other["few"]) and min(bands[at].intersection(r["bands"])) == band:
                    own = found.setdefault(other["label"], [])
                    pair = -d, min(r["id"], other["id"]), max(r["id"], other["id"])
                    if nearest is None or len(own) < nearest:
                        heapq.heappush(own, pair)
                    else:
                        heapq.heappushpop(own, pair)
    return [(a, b) for own in found.values() for _, a, b in own]


def linked_in_shards(members: DataFrame, sketched: DataFrame, words: int, similarity: float) -> DataFrame:
    """(v, root) for the members (id, band, pivot) that are linked by similar pairs of a shard, directly or through others. sketched: id, text, bands, sketch, few.

    First all members of a shard meet one of them, the pivot, so that a large group of near copies is one component early. Then the components
    outside the largest of a shard meet their nearest candidates by BK-trees, in rounds, and at last all that are left.
    """
    far = F.aggregate(F.zip_with("x", "y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, d: s + d)
    words_of = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.conv(F.hex(F.substring("sketch", k * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    sketches, texts = sketched.select("id", "bands", "sketch", "few"), sketched.select("id", "text")
    flat = sketches.select("id", words_of.alias("w"), "few")
    to = lambda c, w: flat.select(F.col("id").alias(c), F.col("w").alias(w), F.col("few").alias(f"few_{c}"))
    near = far <= F.when(F.col("few_a") | F.col("few_b"), FEW_RADIUS).otherwise(SKETCH_RADIUS)
    tried = members.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    tried = save(tried.join(to("a", "x"), "a").join(to("b", "y"), "b").where(near).select("a", "b"), "shard-pairs")
    roots = save(components(similar(tried, texts, words, similarity)), "shard-roots")
    for nearest in NEAREST:
        now = members.join(roots, members["id"] == roots["v"], "left").select("id", "band", F.coalesce("root", "id").alias("label"))
        parts = now.groupBy("band", "label").agg(F.count("*").alias("m")).groupBy("band").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("m", "label")).alias("main"))
        open_ = save(now.join(parts.where("parts > 1").select("band", "main"), "band").join(sketches, "id"), "shard-open")
        pairs = save(candidates(open_, nearest).join(tried, ["a", "b"], "left_anti"), "shard-pairs")
        edges = save(similar(pairs, texts, words, similarity), "shard-edges")
        if not edges.isEmpty():
            roots = save(merged(roots, edges), "shard-roots")
        tried = tried.unionByName(pairs)
    return roots


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (v, root) after further edges (a, b) between their members or vertices of none."""
    to = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"{c}_to"))
    lifted = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
    tops = save(components(lifted), "shard-tops")
    moved = roots.join(tops.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(tops.join(roots.select("v"), "v", "left_anti"))


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, content, component_id, first) of every row with a doc_id: near copies by the exact Jaccard similarity of distinct word shingles.

    ``content`` is a 64-bit hash of the whole row, maps as JSON, so that different rows of one doc_id are told apart; ``component_id`` is the smallest doc_id of the
    group, ``first`` whether the row is the one, by doc_id and content, that stands for it. Equal sets of shingles are one point. Points
    that share a band of minima are a shard; in a shard, BK-trees over wide SimHash sketches give the candidates, and a candidate pair is
    linked if the shingles of the two texts have the similarity. Only texts of shards are read again. Null and empty texts have the empty
    set, and are copies of each other. An empty table gives no rows; other columns enter ``content`` only.
    """
    own = docs.where("doc_id IS NOT NULL").select("doc_id", "text", row_hash(docs).alias("content"))

    def make():
        def step(rows: dict) -> dict:
            sets = [hashed(t, words) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "content": rows["content"], "key": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "bands": list(map(bands_of, sets))}

        return step

    rows = save(map_chunks(own, make, "doc_id long, content long, key binary, bands array<long>"), "near-rows")
    points = rows.groupBy("key").agg(F.min(F.struct("doc_id", "content", "bands")).alias("p")).select("key", "p.*")
    points = save(points.withColumn("id", F.monotonically_increasing_id()), "near-points")
    keyed = points.select("id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min_by("id", F.struct(F.xxhash64("id", F.lit("turn")), "id")).alias("pivot")).where("n > 1").drop("n")
    members = save(keyed.join(shared, "band"), "near-members")
    inside = points.join(members.select("id").distinct(), "id", "left_semi")
    texts = own.join(inside.select("doc_id", "content", "id", "bands"), ["doc_id", "content"]).select("id", "text", "bands").dropDuplicates(["id"])
    roots = linked_in_shards(members, save(sketched(texts, words), "near-texts"), words, similarity)
    named = points.join(roots, points["id"] == roots["v"], "left").select("key", "doc_id", "content", F.coalesce("root", "id").alias("root"))
    named = save(named, "near-named")
    firsts = named.groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("f"))
    placed = save(named.select("key", "root").join(firsts, "root").select("key", "f"), "near-groups")
    return rows.select("doc_id", "content", "key").join(placed, "key").select("doc_id", "content", F.col("f.doc_id").alias("component_id"), (F.struct("doc_id", "content") == F.struct("f.doc_id", "f.content")).alias("first"))


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest doc_id; of several such rows the one of the smallest content hash.

    Different texts under one doc_id are different documents. Rows without a doc_id stay. Only ids and hashes decide; the texts move in
    one join with the rows that go.
    """
    content = "content"
    while content in docs.columns:
        content += "_"
    found = save(near_copies(docs, words, similarity), "near-copies")
    gone = found.where("NOT first").select("doc_id", F.col("content").alias(content)).distinct()
    rows = docs.withColumn(content, row_hash(docs))
    left = rows.join(gone, ["doc_id", content], "left_anti")
    again = save(found.where("first").groupBy("doc_id", F.col("content").alias(content)).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "near-again")
    if not again.isEmpty():
        repeated = rows.join(again, ["doc_id", content], "left_semi").dropDuplicates(["doc_id", content])
        left = left.join(again, ["doc_id", content], "left_anti").unionByName(repeated)
    return left.select(*docs.columns)
