"""Language identification by prediction with partial matching (PPM, method C).

A byte context tree of order three per language holds frozen counts. The cost of a byte is minus log2 of its probability in the
longest known context, plus an escape for every longer known context in which it was never seen. The language with the shortest
code for the whole text wins. Counts are gathered by Spark from a bounded, documented sample of labelled documents; the frozen
tree is a few MB, is broadcast, and scores every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import map_chunks, map_slices

ORDER = 3
#: Languages up to which the table of their shares is sent to all tasks.
SENT_LANGS = 100_000
#: Documents of each language, on average, that the trees are counted on, and of all languages together.
FIT_DOCS, FIT_TOTAL = 1500, 96_000
#: Bytes that are scored at once; longer texts go in pieces that overlap by ORDER bytes.
PIECE = 1 << 20
UNSEEN_BITS = 8.0
PREDICTED = "doc_id long, lang_pred string, score double, bits_per_byte double"


def is_held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category; fractions, superscripts and circled digits are none."""
    return bool(text) and next(filter(str.isalpha, text), None) is not None


def to_bytes(text: str) -> bytes:
    """Lower case, UTF-8, after as many line ends as the longest context has bytes."""
    return b"\n" * ORDER + text.lower().encode("utf-8", "replace")


def grams(raw: np.ndarray) -> np.ndarray:
    """Every window of ORDER + 1 bytes, as one number."""
    out = np.zeros(len(raw) - ORDER, np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | raw[k : len(raw) - ORDER + k]
    return out


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over a sample with columns lang and text: counted in each task, then summed."""

    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows = batch.to_pydict()
            own: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                own.setdefault(lang, []).append(grams(np.frombuffer(to_bytes(text), np.uint8)))
            for lang, found in own.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                if lang in total:
                    keys, at = np.unique(np.concatenate([total[lang][0], keys]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([total[lang][1], n])).astype(np.int64)
                total[lang] = keys, n
        for lang, (keys, n) in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """The frozen trees of all languages as one trie over byte classes, costs and escapes in bits by node and language.

    ``first[class]`` is the node of a byte, ``child[node, class]`` that of a longer string; 0 stands for strings that no language knows.
    """

    langs: list[str]
    classes: np.ndarray
    first: np.ndarray
    child: np.ndarray
    cost: np.ndarray
    escape: np.ndarray
    root_escape: np.ndarray

    def score(self, raw: bytes) -> np.ndarray:
        """Code length in bits of the bytes after the first ORDER ones, by language."""
        total = np.zeros(len(self.langs))
        data = np.frombuffer(raw, np.uint8)
        for at in range(0, max(1, len(data) - ORDER), PIECE):
            total += self._piece(data[at : at + PIECE + ORDER]).sum(0, dtype=np.float64)
        return total

    def score_many(self, raws: list[bytes]) -> np.ndarray:
        """``score`` of several short texts in one pass."""
        data = np.frombuffer(b"".join(raws), np.uint8)
        if not len(data):
            return np.zeros((len(raws), len(self.langs)))
        bits = np.zeros((len(data) + 1, len(self.langs)))
        np.cumsum(self._piece(data), axis=0, out=bits[ORDER + 1 :])
        ends = np.cumsum([len(r) for r in raws])
        return bits[ends] - bits[ends - [len(r) - ORDER for r in raws]]

    def _piece(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - ORDER
        c = self.classes[data]
        depth = [np.zeros(0, np.int32), self.first[c]]
        for k in range(1, ORDER + 1):
            depth.append(self.child[depth[-1][: len(data) - k], c[k:]])
        bits, open_ = np.zeros((n, len(self.langs)), np.float32), np.arange(n)
        for k in range(ORDER, -1, -1):
            start = open_ + ORDER - k
            node = depth[k + 1][start]
            seen = node > 0
            bits[open_[seen]] += self.cost[node[seen]]
            open_, start = open_[~seen], start[~seen]
            if not len(open_):
                return bits
            bits[open_] += self.escape[depth[k][start]] if k else self.root_escape
        bits[open_] += UNSEEN_BITS
        return bits


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Trees:
    """The trees of the counts of ``count_grams``; ``lang`` indexes ``langs``."""
    count = len(langs)
    levels = []  # by length: sorted keys, counts by language
    for size in range(1, ORDER + 2):
        keys, at = np.unique(gram & ((1 << 8 * size) - 1), return_inverse=True)
        levels.append((keys, np.bincount(at * count + lang, n, len(keys) * count).reshape(-1, count)))
    for size in range(ORDER, 0, -1):  # contexts that were never themselves a coded string, such as the line ends before a text
        keys, counts = levels[size - 1]
        more = np.setdiff1d(levels[size][0] >> 8, keys)
        order = np.argsort(keys := np.concatenate([keys, more]))
        levels[size - 1] = keys[order], np.concatenate([counts, np.zeros((len(more), count))])[order]
    seen = levels[0][0]
    classes = np.zeros(256, np.uint8)
    classes[seen] = np.arange(1, len(seen) + 1)
    starts = np.cumsum([1, *[len(k) for k, _ in levels]])
    child = np.zeros((int(starts[ORDER]), len(seen) + 1), np.int32)
    cost, escape = np.zeros((int(starts[-1]), count), np.float32), np.zeros((int(starts[ORDER]), count), np.float32)
    first, root_escape = child[0].copy(), escape[0].copy()
    below = np.full((1, count), UNSEEN_BITS)
    for size, (keys, counts) in enumerate(levels, 1):
        nodes = np.arange(starts[size - 1], starts[size])
        contexts, at = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.zeros((len(contexts), count)), np.zeros((len(contexts), count))
        np.add.at(total, at, counts)
        np.add.at(kinds, at, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            own = -np.log2(counts / (total + kinds)[at])
        shorter = below[np.searchsorted(levels[size - 2][0], keys & ((1 << 8 * (size - 1)) - 1))] if size > 1 else below
        below = np.where(counts > 0, own, leave[at] + shorter)
        cost[nodes] = below
        if size == 1:
            first[classes[keys]], root_escape = nodes, leave[0].astype(np.float32)
        else:
            known = starts[size - 2] + np.searchsorted(levels[size - 2][0], contexts)
            child[known[at], classes[keys & 255]] = nodes
            escape[known] = leave
    return Trees(langs, classes, first, child, cost, escape, root_escape)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_total: int = FIT_TOTAL) -> Trees | None:
    """Trees from about ``fit_docs`` documents a language among those not held out, drawn by a hash of the id; None if there are none.

    All languages are learned. Where there are so many that they would take more than ``fit_total`` documents, each gets an equal part of these. Rows without text,
    lang or doc_id are not learned from. What reaches the driver is one count for each language and distinct gram of the bounded sample; the trees grow with both.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    each = max(1.0, min(fit_docs, fit_total / len(langs)))
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, each / sizes[k]) * (1 << 20))) for k in langs], "lang string, share long")
    shares = F.broadcast(shares) if len(langs) <= SENT_LANGS else shares
    sample = known.join(shares, "lang").where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 20)) < F.col("share")).select("lang", "text")
    rows = count_grams(sample).toArrow()
    if not rows.num_rows:
        return None
    at = {k: i for i, k in enumerate(langs)}
    lang = np.array([at[k] for k in rows["lang"].to_pylist()], np.int64)
    return build(langs, lang, rows["gram"].to_numpy(), rows["n"].to_numpy())


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Language of every whole text: the shortest code wins, ties go to the first name; ``und`` with score 0 for a null text or one without letters.

    ``score`` is the posterior of that language under equal priors. Columns other than doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        trees = sent.value

        def step(rows: dict) -> dict:
            lang, score, bits = ["und"] * len(rows["text"]), [0.0] * len(rows["text"]), [0.0] * len(rows["text"])
            told = [i for i, t in enumerate(rows["text"]) if trees and has_letter(t)]
            raw = [to_bytes(rows["text"][i]) for i in told]
            short = [k for k, r in enumerate(raw) if len(r) <= PIECE // 8]
            lengths = np.zeros((len(raw), len(trees.langs) if trees else 1))
            for k in range(0, len(short), 32):
                lengths[short[k : k + 32]] = trees.score_many([raw[j] for j in short[k : k + 32]])
            for k in set(range(len(raw))) - set(short):
                lengths[k] = trees.score(raw[k])
            for i, r, x in zip(told, raw, lengths, strict=True):
                best = int(x.argmin())
                lang[i] = trees.langs[best]
                score[i] = float(1 / np.exp2(np.maximum(x.min() - x, -1000)).sum())
                bits[i] = float(x[best]) / (len(r) - ORDER)
            return {"doc_id": rows["doc_id"], "lang_pred": lang, "score": score, "bits_per_byte": bits}

        return step

    return map_chunks(docs.select("doc_id", "text"), make, PREDICTED)


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Fits on the documents that are not held out and predicts all of them."""
    return predict(docs, fit(docs, fit_docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


#: A text whose best code takes more bits a byte than this is in none of the learned languages.
MOST_BITS = 6.5


def in_known_language(docs: DataFrame, fit_docs: int = FIT_DOCS, most_bits: float = MOST_BITS) -> DataFrame:
    """``docs``, all columns, without rows that have no letter or whose best code is longer than ``most_bits`` bits a byte.

    A null or empty text has no letter. Repeated rows stay repeated, an empty table stays empty; without labelled rows nothing is known.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_docs))

    def make():
        trees = sent.value

        def known(text: str | None) -> bool:
            if not trees or not has_letter(text):
                return False
            raw = to_bytes(text)
            return float(trees.score(raw).min()) <= most_bits * (len(raw) - ORDER)

        return lambda batch: batch.filter(pa.array([known(t) for t in batch["text"].to_pylist()], pa.bool_()))

    return map_slices(docs, make, docs.schema)
