"""Prefix trie of conversations, with subtree sums by heavy-path decomposition.

A turn is a SHA-256 of its role and text. A prefix is its depth and the exclusive or of hashes of (position, turn), 128 bits: such a hash
can be taken along blocks of a conversation, so that no task has to walk a long one alone, and the parent's hash is one operation
away. A node is an aggregate over the rebuilt turns with that prefix; it is named by its smallest member and its depth.

The heavy child of a node is the one with the most members, so that a light edge at least halves the members and a path from the root
has at most log2(conversations) light edges. Heavy paths carry the subtree sums: rounds from the deepest level of paths to the root add the totals
of light paths to the paths that they hang on; then each path, as arrays of bounded length, is summed from its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.iterate import save, saved

#: A conversation takes up to MOST_SHARED - 1 first turns from the first of each FAMILY conversations.
FAMILY, MOST_SHARED = 5, 9
#: Positions of a conversation, or of a path, that one task walks at once, and bytes of ids in a row of a digest.
BLOCK, CHUNK_BYTES = 1024, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth"]


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, content, bytes) in order, and how they lie: (conv_id, part, first, before, n).

    The order is turn, nulls first, then role and a hash of role and text. Rows are sorted over all partitions, so a conversation may
    span several; ``before`` counts its turns in earlier ones.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), content.alias("content"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "content"]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    turns = save(turns.select("conv_id", F.shiftright("at", 33).alias("part"), "at", F.unhex("content").alias("content"), "bytes"), "trie-turns")
    lie = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    own = Window.partitionBy("conv_id")
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, lie.select("conv_id", "part", "first", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(own).alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rebuilt turns (conv_id, depth, content, bytes, last), conversations (conv_id, length), and the greatest depth."""
    turns, lie = numbered(conversations)
    lie = save(lie, "trie-lie")
    sizes = lie.select("conv_id", "n").distinct()
    donors = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    donor, h = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    taken = F.least("h", F.coalesce("donor_n", F.lit(0)))
    plans = sizes.select("conv_id", "n", donor.alias("donor"), h.alias("h")).join(donors, "donor", "left").select("conv_id", "donor", "n", "h", taken.alias("taken"))
    plans = save(plans.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-plans")
    placed = turns.join(lie.drop("n").join(plans, "conv_id"), ["conv_id", "part"]).withColumn("k", F.col("at") - F.col("first") + F.col("before") + 1)
    own = placed.where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("depth"), "content", "bytes", (F.col("k") == F.col("n")).alias("last"))
    heads = placed.where(f"k < {MOST_SHARED} AND conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("donor"), "k", "content", "bytes")
    lent = heads.join(plans.where("taken > 0"), "donor").where("k <= taken")
    lent = lent.select("conv_id", F.col("k").alias("depth"), "content", "bytes", (F.col("k") == F.col("length")).alias("last"))
    rows, told = saved(own.unionByName(lent), "trie-rebuilt", deepest=F.max("depth"))
    return rows, plans.select("conv_id", "length"), told["deepest"] or 0


def running(rows: DataFrame, keys: list[str], position: Column, most: int, block: int, **folds: tuple) -> DataFrame:
    """``rows`` with running folds over the order of the positions 0 to ``most`` of a key, current row included.

    A fold is (column, aggregate, how two of its results combine). Blocks of positions are walked by themselves; their totals, one row
    each, are walked by key only where positions fill more than one block.
    """
    rows = rows.withColumn("_at", position).withColumn("_block", F.floor(F.col("_at") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({name: fold(column).over(inside) for name, (column, fold, _) in folds.items()})
    if most >= block:
        ends = rows.groupBy(*keys, "_block").agg(*[fold(column).alias(name) for name, (column, fold, _) in folds.items()])
        earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "_block", *[fold(name).over(earlier).alias(f"_{name}") for name, (_, fold, _) in folds.items()])
        out = out.join(ends, [*keys, "_block"]).withColumns({name: join(F.col(name), F.col(f"_{name}")) for name, (_, _, join) in folds.items()})
        out = out.drop(*[f"_{name}" for name in folds])
    return out.drop("_at", "_block")


def either(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))


def added(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def digests(ends: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(conv_id, depth, ends_sha256) for the members (conv_id, depth, member) that end at a node.

    Sorted over all partitions the members become rows of joined ids of bounded size; only these are read in order of a node, and hashed as they come.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size, out = None, 0, [], 0, []
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("conv_id", "depth", "member")], strict=True):
                if row[:2] != node or size >= chunk_bytes:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, size = row[:2], row[2], [], 0
                ids.append(str(row[2]))
                size += len(ids[-1]) + 1
            yield packed(out)
            out = []
        if ids:
            yield packed([(*node, first, ",".join(ids))])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["conv_id", "depth", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*[batch[c].to_pylist() for c in ("conv_id", "depth", "ids")], strict=True):
                if (conv, depth) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256(ids.encode())
            yield done(out)
        if node:
            yield done([(*node, state.hexdigest())])

    def done(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True) if rows else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], [*NODE, "ends_sha256"])

    order = [*NODE, "member"]
    rows = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "conv_id long, depth long, first long, ids string")
    rows = save(rows, "trie-ends")
    return rows.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def suffix_sums(nodes: DataFrame, most: int, block: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): sums of ``leaves`` and ``saved`` from each node to the end of its path (head, top).

    A path is cut into arrays of up to ``block`` nodes. An array is summed from its end; what follows a path's array is added where a path has more than one.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["nodes"]
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            at = np.arange(len(flat))
            end = ends[np.searchsorted(ends, at, side="right")] if len(at) else at
            columns = {c: flat.field(c) for c in NODE}
            for name in ("leaves", "saved"):
                total = np.concatenate([[0], np.cumsum(flat.field(name).to_numpy(), dtype=np.int64)])
                columns[name] = pa.array(total[end] - total[at]) if len(at) else flat.field(name)
            after = {c: pa.array(np.repeat(batch[c].to_numpy(), np.diff(lists.offsets.to_numpy()))) for c in ("leaves_after", "saved_after")}
            yield pa.RecordBatch.from_pydict({**{c: columns[c] for c in NODE}, "n_leaves": pa.compute.add(columns["leaves"], after["leaves_after"]), "saved_tokens": pa.compute.add(columns["saved"], after["saved_after"])})

    path = ["head", "top"]
    rows = nodes.withColumn("block", F.floor((F.col("depth") - F.col("top")) / block))
    item = F.sort_array(F.collect_list(F.struct("depth", "conv_id", "leaves", "saved"))).alias("nodes")
    arrays = rows.groupBy(*path, "block").agg(item, F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    after = {c: F.lit(0).cast("long") for c in ("leaves", "saved")}
    if most >= block:
        later = Window.partitionBy(*path).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
        after = {c: F.coalesce(F.sum(c).over(later), F.lit(0).cast("long")) for c in after}
    arrays = arrays.select("nodes", *[v.alias(f"{c}_after") for c, v in after.items()])
    return arrays.mapInArrow(summed, "conv_id long, depth long, n_leaves long, saved_tokens long")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c starts with the first h turns of conversation c - c % 5 (all if fewer, none if it is absent) and goes on with its own turns after its
    first h, where h is the CRC-32 of c in decimal digits, modulo 9. Turns are ordered by turn, nulls first, then role and content hash; null roles and texts are
    empty. Repeated rows are turns each. Rows without a conv_id take no part; an empty table gives no rows, not even the root. Other columns are not read.
    """
    rows, convs, deepest = rebuilt(conversations)
    whole = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).collect()[0]
    root = whole["conv_id"]
    top = F.lit(root).cast("long")
    z = {k: F.xxhash64(F.lit(k), "depth", "content") for k in (1, 2)}
    rows = running(rows.withColumns({f"z{k}": v for k, v in z.items()}), ["conv_id"], F.col("depth") - 1, deepest - 1, block, **{f"p{k}": (F.col(f"z{k}"), F.bit_xor, either) for k in (1, 2)})
    rows = save(rows.select("conv_id", "depth", "p1", "p2", *[F.col(f"p{k}").bitwiseXOR(F.col(f"z{k}")).alias(f"q{k}") for k in (1, 2)], "bytes", "last"), "trie-prefixes")

    nodes = rows.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    nodes = save(nodes, "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("node").alias("parent_conv_id"))
    nodes = save(nodes.join(above, ["depth", "q1", "q2"], "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, top).otherwise(F.col("parent_conv_id"))).drop("q1", "q2"), "trie-nodes")
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("node")).alias("child"))).alias("heavy"))
    children = save(children, "trie-children")
    heavy = children.select((-F.col("heavy.child")).alias("node"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("light"))
    nodes = save(nodes.join(heavy, ["node", "depth"], "left").withColumn("light", F.coalesce("light", F.lit(True))), "trie-nodes")

    met = rows.select("conv_id", "depth", "p1", "p2", "last").join(nodes.select("depth", "p1", "p2", "node", "light"), ["depth", "p1", "p2"])
    met = save(met.select("conv_id", "depth", "node", "light", "last"), "trie-met")
    ends = met.where("last").select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    turnless = convs.where("length = 0").select(top.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    ended = digests(ends.unionByName(turnless))

    head = F.when(F.col("light"), F.struct(F.col("depth").alias("top"), F.col("node").alias("head")))
    led = running(met, ["conv_id"], F.col("depth") - 1, deepest - 1, block, head=(head, F.max, F.greatest), level=(F.when(F.col("light"), 1).otherwise(0), F.sum, added))
    led = led.where("conv_id = node").select("conv_id", "depth", F.coalesce("head.head", top).alias("head"), F.coalesce("head.top", F.lit(0)).cast("long").alias("top"), "level")
    own = nodes.select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "bytes")
    first = conversations.sparkSession.createDataFrame([(root, 0, None, whole["n_convs"], 0, root, 0, 0)] if root is not None else [], "conv_id long, depth long, parent_conv_id long, n_convs long, bytes long, head long, top long, level long")
    tree = own.join(led, NODE).unionByName(first).join(children.select(*NODE, "n_children"), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tree = tree.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    tree, told = saved(tree, "trie-tree", levels=F.max("level"), most=F.max(F.col("depth") - F.col("top")))

    light = light_totals(tree, told["levels"] or 0)
    tree = tree.join(light, NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"light_{c}", F.lit(0).cast("long")) for c in ("leaves", "saved")})
    sums = suffix_sums(tree, told["most"] or 0, block)
    out = tree.select(*NODE, "parent_conv_id", "n_convs", "n_children").join(sums, NODE).join(ended, NODE, "left")
    return out.select(*NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def light_totals(tree: DataFrame, levels: int) -> DataFrame:
    """(conv_id, depth, light_leaves, light_saved): what the light paths that hang on a node hold with all below them.

    Rounds from the deepest level up: the paths of a level have their totals once those of the next are added; a level is at least halved in members, so
    the rounds are logarithmic in the conversations.
    """
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    parent = F.max(F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id"))).alias("parent_conv_id")
    paths = tree.groupBy("head", "top", "level").agg(parent, *sums)
    hold = tree.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("top"), F.col("head").alias("up_head"), F.col("top").alias("up_top"))
    paths = save(paths.where("level > 0").join(hold, ["parent_conv_id", "top"]), "trie-paths")
    totals = paths.select("parent_conv_id", "top", "leaves", "saved").limit(0)
    carried: DataFrame | None = None
    for level in range(levels, 0, -1):
        now = paths.where(F.col("level") == level)
        if carried is not None:
            more = carried.groupBy(F.col("up_head").alias("head"), F.col("up_top").alias("top")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            now = now.join(more, ["head", "top"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")
        carried = save(now, "trie-level")
        totals = totals.unionByName(carried.select("parent_conv_id", "top", "leaves", "saved"))
    return totals.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("light_leaves"), F.sum("saved").alias("light_saved"))
