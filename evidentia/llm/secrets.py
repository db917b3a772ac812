"""Secret scans: fixed patterns, and a randomness test battery for tokens that no pattern names.

A token's encoding is inferred from its characters. The battery asks how well text like that of the table itself could explain the token,
as words of the table written one after the other. What such text looks like is counted over all documents: which symbol follows which,
which start words, how often words end. Three tests, each with the mean and variance that those counts give: chi-squared uniformity
(text repeats its frequent symbols), runs of character classes (text changes class rarely) and serial dependence (neighbours of text are
likely pairs). Their p-values, which depend on each other, are combined by the Cauchy rule. What is unlike text need not be random: lag-one
serial correlation of the symbols' numbers (sorted alphabets) and symbols far from uniform (fillers) are vetoes. The tokens of the whole table pass one Benjamini-Hochberg step
whose level grows with a token's length; a histogram of the p-values fixes its threshold, so nothing else of a token leaves its task.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import map_chunks, map_slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Symbols of each encoding, and the least chance of a class change that text is taken to have.
ENCODINGS = {
    "hex": ("0123456789abcdef", 0.2), "HEX": ("0123456789ABCDEF", 0.2), "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.08),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", 0.12), "BASE36": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.12),
    "base38": ("0123456789abcdefghijklmnopqrstuvwxyz+/-_", 0.3), "BASE38": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_", 0.3), "base64": (ALPHABET + "-_", 0.3),
}
#: Text is taken to have at least so many four-digit numbers a word, and so many of its words joined by a sign where it is one token.
NUMBERS, SIGNS = 0.05, 0.5
LEVEL = 0.01
#: Lag-one serial correlation from which a token is structured; times its standard error in random text, and at least.
CLEARLY, LEAST_CLEARLY = 4.0, 0.6
#: Standard deviations of chi-squared above that of a uniform token from which a token is structured.
UNEVEN = 6.0
#: Tokens of this length or more are tested at the full level.
FULL_LENGTH = 32
#: The histogram of p-values has so many bins for each halving, and so many in all.
BINS, MOST_BINS = 16, 16 * 256
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, n_tested long, base_sha256 string, spans string, scores string"

_CODES = np.full(256, 64, np.int64)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(64)
_CODES[[ord("-"), ord("_")]] = [62, 63]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each fixed pattern, by start and then kind."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    for word, at in long_words(text, 16):
        out += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(word) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def long_words(text: str, least: int):
    """Words of at least so many characters, with their places. A word within a longer one can't be met first: that one is long too."""
    at = 0
    for word in text.split():
        if len(word) >= least:
            at = text.index(word, at)
            yield word, at
            at += len(word)


def encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token; None for tokens without a digit or without a letter."""
    body = token.rstrip("=")
    if not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return None
    return next((name for name, (alphabet, _) in ENCODINGS.items() if set(body) <= set(alphabet)), "base64")


# --- what the text of the table looks like


def pair_counts(texts: list[str | None]) -> np.ndarray:
    """How often each of the 64 symbols, or none of them (64), is followed by which; text starts and ends with none."""
    raw = " " + " ".join(t for t in texts if t) + " "
    codes = _CODES[np.frombuffer(raw.encode("ascii", "replace"), np.uint8)]
    return np.bincount(codes[:-1] * 65 + codes[1:], minlength=65 * 65)


def counted(docs: DataFrame) -> np.ndarray:
    """``pair_counts`` over all rows of ``docs``: added up in each task, then by Spark; the driver gets 65 x 65 numbers."""

    def run(batches):
        total = np.zeros(65 * 65, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                total += pair_counts(batch["text"].slice(at, 64).to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    out = np.zeros(65 * 65)
    for r in docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


@dataclass
class Expected:
    """For one encoding: cost, mean cost and variance of a next symbol given the last, and class changes likewise; moments of symbol counts."""

    code: dict[str, int]
    cost: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    change: np.ndarray
    squares: float
    cubes: float


def kind_of(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o"


@dataclass
class Text:
    """The tables of all encodings from the pair counts of a corpus; without any, all symbols are alike."""

    counts: np.ndarray
    by_encoding: dict[str, Expected] = field(default_factory=dict)

    def __post_init__(self) -> None:
        n = np.asarray(self.counts, float).reshape(65, 65)
        for name, (signed_alphabet, least) in ENCODINGS.items():
            alphabet = [c for c in signed_alphabet if c not in "-_"]
            size = len(alphabet)
            code = {c: k for k, c in enumerate(alphabet)}
            signs = [code[c] for c in "+/" if c in code]
            code |= dict(zip("-_", signs, strict=False))
            fold = np.zeros((65, size + 1))  # which symbols of the text stand for a symbol of the encoding; case counts for base64 only
            fold[64, size] = 1
            for k, c in enumerate(alphabet):
                for d in {c} if name == "base64" else {c.lower(), c.upper()}:
                    fold[ALPHABET.index(d), k] = 1
            own = fold.T @ n @ fold
            kinds = np.array([kind_of(c) for c in alphabet])
            digits, numbers = np.flatnonzero(kinds == "d"), NUMBERS * own[size].sum() / 10
            own[size, digits] += numbers
            own[digits, size] += numbers
            own[np.ix_(digits, digits)] += numbers * 3 / 10
            within, first = own[:size, :size], own[size, :size] + 1.0
            first = first / first.sum()
            symbols = within.sum(0) + own[size, :size] + 0.5
            symbols = symbols / symbols.sum()
            ends = (own[:size, size] + 0.5) / (own[:size].sum(1) + 1.0)
            inside = within + first * 2.0
            joint = np.tile(first, (size, 1))
            if signs:
                ends[signs] = 1.0
                others = [k for k in range(size) if k not in signs]
                joint[others] *= 1 - SIGNS
                joint[np.ix_(others, signs)] += SIGNS / len(signs)
            chance = (1 - ends)[:, None] * inside / inside.sum(1, keepdims=True) + ends[:, None] * joint
            chance = 0.95 * chance + 0.05 / size
            cost = -np.log2(chance)
            mean = (chance * cost).sum(1)
            change = np.maximum(least, (chance * (kinds[:, None] != kinds)).sum(1))
            self.by_encoding[name] = Expected(code, cost, mean, (chance * cost**2).sum(1) - mean**2, change, float((symbols**2).sum()), float((symbols**3).sum()))

    def p_value(self, token: str) -> float | None:
        """The combined p-value of a token under text; 1 for a token that is clearly structured, None for one without an encoding."""
        if not (name := encoding(token)):
            return None
        e, body = self.by_encoding[name], token.rstrip("=")
        x = np.array([e.code[c] for c in body])
        n = len(x)
        centred = x - x.mean()
        spread = float((centred**2).sum())
        serial = abs(float((centred[1:] * centred[:-1]).sum()) / spread) if spread else 1.0
        if serial >= max(LEAST_CLEARLY, CLEARLY / math.sqrt(n)):
            return 1.0
        equal, size = float((np.bincount(x).astype(float) ** 2).sum()), len(e.cost)
        if size * equal / n - n - (size - 1) > UNEVEN * math.sqrt(2 * (size - 1)):
            return 1.0
        expected = n + n * (n - 1) * e.squares
        variance = 2 * n * (n - 1) * (e.squares - e.squares**2) + 4 * n * (n - 1) * (n - 2) * (e.cubes - e.squares**2)
        p_chi = below((equal - expected) / math.sqrt(max(variance, 1e-9)))
        changes = sum(kind_of(a) != kind_of(b) for a, b in zip(body, body[1:], strict=False))
        q = e.change[x[:-1]]
        p_runs = below(-(changes - 0.5 - float(q.sum())) / math.sqrt(float((q * (1 - q)).sum())))
        a, b = x[:-1], x[1:]
        p_pairs = below(-float((e.cost[a, b] - e.mean[a]).sum()) / math.sqrt(max(float(e.variance[a].sum()), 1e-9)))
        return cauchy(p_chi, p_runs, p_pairs)


def below(z: float) -> float:
    return max(1e-300, 0.5 * math.erfc(-z / math.sqrt(2)))


def cauchy(*ps: float) -> float:
    """One p-value of several that may depend on each other."""
    t = sum(1 / math.tan(math.pi * min(p, 0.99)) for p in ps) / len(ps)
    return 0.5 - math.atan(t) / math.pi if t < 1e6 else 1 / (t * math.pi)


# --- tests and the threshold for all of them


def bin_of(p: float, n: int) -> int:
    """The histogram bin of a p-value, by the length of the token: the higher, the less like text."""
    return min(MOST_BINS, max(0, math.floor(-BINS * math.log2(max(p, 1e-300) / min(1.0, n / FULL_LENGTH)))))


def tested(text: str, taken: list[tuple[str, int, int]], known: Text) -> list[tuple[int, int, int]]:
    """(bin, start, end) of the tokens outside the fixed matches that have an encoding."""
    out = []
    for word, at in long_words(text, 20):
        for m in TOKEN.finditer(word):
            start, end = at + m.start(), at + m.end()
            if not any(a < end and start < b for _, a, b in taken) and (p := known.p_value(m[0])) is not None:
                out.append((bin_of(p, len(m[0])), start, end))
    return out


def threshold(histogram: dict[int, int], level: float = LEVEL) -> int:
    """Benjamini-Hochberg on binned p-values: the lowest bin whose tokens, and all above, are discoveries."""
    total, above, found = sum(histogram.values()), 0, MOST_BINS + 1
    for b in sorted(histogram, reverse=True):
        above += histogram[b]
        if 2 ** (-b / BINS) <= level * above / total:
            found = b
    return found


def fit(docs: DataFrame, level: float = LEVEL) -> tuple[Text, int]:
    """What the text of all ``docs`` looks like, and the bin from which its tokens are secrets: two passes, a fixed number of values each."""
    known = Text(counted(docs))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        found: dict[int, int] = {}
        for batch in batches:
            for text in batch["text"].to_pylist():
                for b, _, _ in tested(text, base_spans(text), sent.value) if text else ():
                    found[b] = found.get(b, 0) + 1
        yield pa.RecordBatch.from_pydict({"bin": pa.array(list(found), pa.int32()), "n": pa.array(list(found.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    return known, threshold({r["bin"]: r["n"] for r in rows}, level)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@dataclass
class Scan:
    base: list[tuple[str, int, int]]
    spans: list[tuple[str, int, int]]
    n_tested: int


def scan(text: str | None, known: Text, least: int) -> Scan:
    """The fixed matches, and all spans by start and kind; a null text is empty."""
    base = base_spans(text or "")
    tests = tested(text or "", base, known)
    return Scan(base, sorted(base + [("random", a, b) for t, a, b in tests if t >= least], key=lambda s: (s[1], KINDS.index(s[0]))), len(tests))


def score_of(text: str, span: tuple[str, int, int], known: Text) -> str:
    """-log10 of the p-value of a span's last token, two digits; empty if it has no encoding."""
    tokens = re.findall(r"[A-Za-z0-9+/_-]+={0,2}", text[span[1] : span[2]])
    p = known.p_value(tokens[-1]) if tokens and len(tokens[-1].rstrip("=")) > 1 else None
    return "" if p is None else f"{-math.log10(p):.2f}"


def find_secrets(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """One row a document: counts of spans by kind and of tested tokens, the spans, and how unlike text each is (-log10 p, fixed matches too).

    Places are code points of the whole text, ends exclusive. Null and empty texts have no spans, repeated rows repeat, an empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, level))

    def make():
        known, least = sent.value

        def step(rows: dict) -> dict:
            out: dict[str, list] = {"doc_id": rows["doc_id"], **{n: [] for n in ("n_assign", "n_access", "n_hex", "n_random", "n_tested", "base_sha256", "spans", "scores")}}
            for text in rows["text"]:
                found = scan(text, known, least)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in found.spans))
                out["n_tested"].append(found.n_tested)
                out["base_sha256"].append(hashlib.sha256(written(found.base).encode()).hexdigest())
                out["spans"].append(written(found.spans))
                out["scores"].append(",".join(score_of(text, s, known) for s in found.spans))
            return out

        return step

    return map_chunks(docs.select("doc_id", "text"), make, SPANS)


def redact(text: str | None, known: Text, least: int, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    if text is None:
        return None
    out, at = [], 0
    for _, a, b in scan(text, known, least).spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redacted(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """``docs`` with its columns as they are, but for secrets in ``text``, and ``n_chars`` where there is one.

    Null texts stay null, repeated rows repeat, an empty table stays empty.
    """
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, level))

    def make():
        known, least = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.set_column(at, batch.schema.field(at), pa.array([redact(t, known, least) for t in batch["text"].to_pylist()], batch.schema.field(at).type))

        return step

    out = map_slices(docs, make, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out
