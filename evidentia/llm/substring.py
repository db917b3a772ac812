"""Removal of word windows that repeat anywhere, by difference-cover anchors.

A difference cover D modulo p has, for any two positions i and j, a shift d < p that puts both i + d and j + d in D. So if two windows
of W words agree, they share an anchor of W - p + 1 words at cover positions. Anchors are hashed only there; windows are extended, that is
hashed whole, only round anchors that occur twice; windows whose XXH3 of the words' own bytes (128 bits) occurs twice are removed. Anchors have
cheap rolling hashes, since a collision there only adds a candidate.

Texts are dealt once into blocks of bounded size; the exchange serves all three passes. A block sends the distinct hashes of each
hash range as one sorted array and gets back one bit for each: does another block have it? A passage in a third of all documents
therefore costs one hash a block, and the answers are a hundredth of what was asked.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 35
#: Bytes of text a block has on average, and bytes of text whose hashes one range gets.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
# Perfect difference sets by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
# An odd multiplier for the rolling hash and the constants of a 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def period_for(window: int) -> int:
    """The longest period that leaves anchors at least a third of the window."""
    return max(p for p in COVERS if window - p + 1 >= max(1, window // 3))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(MIX[0])
    x = (x ^ x >> np.uint64(27)) * np.uint64(MIX[1])
    return x ^ x >> np.uint64(31)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of a block of texts: places in one byte buffer, text number, place within the text."""

    def __init__(self, texts: list[bytes | None]):
        self.data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        word = ~SPACE[self.data]
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
        self.texts = np.searchsorted(first, self.starts, "right") - 1
        self.counts = np.bincount(self.texts, minlength=len(texts)).astype(np.int64)
        self.place = np.arange(len(self.starts)) - (np.cumsum(self.counts) - self.counts)[self.texts]

    def hashes(self, base: int = BASE) -> np.ndarray:
        """A hash of each word: its bytes as a polynomial, then mixed. Equal words have equal hashes; the reverse does not always hold."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        bytes_ = np.repeat(self.starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        offset = np.arange(len(bytes_)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        terms = (self.data[bytes_].astype(np.uint64) + np.uint64(1)) * powers(base, int(lengths.max()))[offset]
        return mixed(np.add.reduceat(terms, np.cumsum(lengths) - lengths) ^ lengths.astype(np.uint64) * np.uint64(MIX[0]))

    def windows(self, size: int, at: np.ndarray, base: int = BASE) -> np.ndarray:
        """A rolling hash of the ``size`` words from each given word on."""
        h = self.hashes(base)
        up, down = powers(base, len(h)), powers(pow(base, -1, 1 << 64), len(h))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
        return mixed((total[at + size] - total[at]) * down[at])

    def digests(self, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the XXH3 of the ``size`` words from each given word on, joined by one space."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        used = np.zeros(len(self.starts) + 1, np.int32)
        np.add.at(used, at, 1)
        np.add.at(used, at + size, -1)
        words = np.flatnonzero(np.cumsum(used[:-1]) > 0)
        joined, ends = self.joined(words)
        first = np.searchsorted(words, at)
        sizes = self.ends[words] - self.starts[words]
        digest = xxhash.xxh3_128_digest
        raw = b"".join([digest(joined[a:b]) for a, b in zip((ends[first] - sizes[first]).tolist(), ends[first + size - 1].tolist(), strict=True)])
        both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def joined(self, words: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the given words, each followed by one space, and where each ends."""
        lengths = self.ends[words] - self.starts[words] + 1
        data = np.where(SPACE[self.data], np.uint8(32), self.data)
        after = np.cumsum(lengths)
        return data[np.repeat(self.starts[words] - after + lengths, lengths) + np.arange(lengths.sum())].tobytes(), after - 1

    def fits(self, size: int) -> np.ndarray:
        """Whether a window from each word on ends within its text."""
        return self.place + size <= self.counts[self.texts]


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words where anchors start, and the anchors' hashes."""
    p = period_for(window)
    cover = np.zeros(p, bool)
    cover[list(COVERS[p])] = True
    long = words.counts[words.texts] >= window
    at = np.flatnonzero(cover[words.place % p] & words.fits(window - p + 1) & long)
    return at, words.windows(window - p + 1, at)


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash range of each hash, by its upper bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def distinct(high: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes as rows of one or two numbers, the place of each input among them, and how often each occurs."""
    order = np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))
    rows = high[order, None] if low is None else np.stack([high[order], low[order]], 1)
    new = np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(1)])
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[new], place, np.bincount(place, minlength=int(new.sum()))


def asked(block: int, rows: np.ndarray, n: int) -> pa.Table:
    """One message for each hash range: the sorted distinct hashes of the block in it."""
    found = ranges(rows[:, 0], n)
    ends = np.searchsorted(found, np.arange(n + 1))
    parts = [k for k in range(n) if ends[k] < ends[k + 1]]
    return pa.table({"range": pa.array(parts, pa.int64()), "block": pa.array([block] * len(parts), pa.int64()), "hashes": pa.array([rows[ends[k] : ends[k + 1]].tobytes() for k in parts], pa.binary())})


def elsewhere(width: int):
    """For all messages of one range: a bit for each hash, set if another block sent it."""

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in group["hashes"].to_pylist()]
        rows = np.concatenate(sent)
        _, place, counts = distinct(*rows.T)
        again = counts[place] > 1
        ends = np.cumsum([len(s) for s in sent])
        bits = [np.packbits(again[e - len(s) : e]).tobytes() for e, s in zip(ends, sent, strict=True)]
        return pa.table({"block": group["block"].cast(pa.int64()), "range": pa.array([key[0].as_py()] * len(bits), pa.int64()), "bits": pa.array(bits, pa.binary())})

    return answer


def told(rows: np.ndarray, counts: np.ndarray, answers: pa.Table, n: int) -> np.ndarray:
    """Which of a block's distinct hashes occur twice, in the block or through the answers of the ranges."""
    again = counts > 1
    found = ranges(rows[:, 0], n)
    for k, bits in zip(answers["range"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        a, b = np.searchsorted(found, [k, k + 1])
        again[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return again


def near_anchors(words: Words, window: int, answers: pa.Table, n: int) -> np.ndarray:
    """Words where windows start that hold an anchor that occurs twice."""
    at, hashes = anchors(words, window)
    rows, place, counts = distinct(hashes)
    hit = at[told(rows, counts, answers, n)[place]] if len(at) else at
    reach = np.zeros(len(words.starts) + 1, np.int32)
    np.add.at(reach, np.maximum(hit - period_for(window) + 1, 0), 1)
    np.add.at(reach, hit + 1, -1)
    starts = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & words.fits(window))
    return starts


def whole_windows(words: Words, window: int, answers: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate windows: where they start, the distinct hashes, the place of each among them, and how often each occurs in the block."""
    at = near_anchors(words, window, answers, n)
    return at, *distinct(*words.digests(window, at))


def remainder(words: Words, removed: np.ndarray) -> list[str]:
    """The digest of each text's kept words, joined by one space."""
    kept = np.flatnonzero(~removed)
    joined, _ = words.joined(kept)
    sizes = np.bincount(words.texts[kept], words.ends[kept] - words.starts[kept] + 1, len(words.counts)).astype(np.int64)
    ends = np.cumsum(sizes)
    return [hashlib.sha256(joined[e - s : max(e - s, e - 1)]).hexdigest() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def without_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``.

    Removed is each word covered by a window of ``window`` words whose sequence also starts anywhere else, in the same text included;
    windows are judged on the input. A null text has no words; repeated rows are texts of their own, so each repeats the other. An empty
    table gives no rows. Only doc_id and text are read.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks, n = max(1, math.ceil(size / block_bytes)), max(1, math.ceil(size / range_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks).cast("long")).alias("block")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), block).repartition(blocks, "block")
    message, answer = "range long, block long, hashes binary", "block long, range long, bits binary"

    def ask_anchors(key: tuple, group: pa.Table) -> pa.Table:
        return asked(key[0].as_py(), distinct(anchors(Words(group["text"].to_pylist()), window)[1])[0], n)

    def ask_windows(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        return asked(key[0].as_py(), whole_windows(Words(group["text"].to_pylist()), window, answers, n)[1], n)

    def remove(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        first, second = (answers.filter(pa.compute.equal(answers["step"], k)) for k in (1, 2))
        words = Words(group["text"].to_pylist())
        at, rows, place, counts = whole_windows(words, window, first, n)
        hit = at[told(rows, counts, second, n)[place]] if len(at) else at
        cover = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        removed = np.cumsum(cover[:-1]) > 0
        gone = np.bincount(words.texts[removed], minlength=len(words.counts)).astype(np.int64)
        return pa.table({"doc_id": group["doc_id"], "n_words": words.counts, "n_removed": gone, "kept_sha256": remainder(words, removed)})

    by_block = lambda df: df.groupBy("block")
    first = by_block(dealt).applyInArrow(ask_anchors, message).groupBy("range").applyInArrow(elsewhere(1), answer)
    second = by_block(dealt).cogroup(by_block(first)).applyInArrow(ask_windows, message).groupBy("range").applyInArrow(elsewhere(2), answer)
    answers = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return by_block(dealt).cogroup(by_block(answers)).applyInArrow(remove, RESULT)
