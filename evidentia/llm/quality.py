"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long of failure bits; a policy is a
versioned bit mask over that long, so a policy is applied, and what each rule alone decides is counted, without the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import map_chunks

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bars", "max_run")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
SYMBOLS = re.compile(r"[#*$%&|<>]")
LETTERS, UPPER = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}")
_LETTERS = bytes(b for b in range(128) if chr(b).isalpha())
_CAPITALS = bytes(b for b in range(128) if chr(b).isupper())

#: Name and failure condition of every rule; the position is its bit. Bits are only ever appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("shouting", "n_letters >= 40 and 10 * n_upper > 7 * n_letters"),
    ("table_bars", "10 * n_bars > 3 * n_words"),
    ("word_run", "max_run >= 10"),
    ("repeated_lines", "n_lines >= 8 and 2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 and (word_chars > 25 * n_words or word_chars < 2 * n_words)"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named set of rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", BASE.rules + ("symbols", "shouting")), Policy("v2", tuple(BIT)))}
CURRENT = "v2"


def repeated_words(words: list) -> int:
    """Words covered by a window of five that the text holds twice or more."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    again = np.zeros(len(windows), bool)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            again[i] = again[j] = True
    ends = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(again)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + 5, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def longest_run(words: list) -> int:
    best = run = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        if run > best:
            best = run
    return best if words else 0


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES; a null text measures as the empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    letters, upper = (len(raw) - len(raw.translate(None, _LETTERS)), len(raw) - len(raw.translate(None, _CAPITALS))) if text.isascii() else (len(LETTERS.findall(text)), len(UPPER.findall(text)))
    return (len(words), word_chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, letters, words.count(b"|"), longest_run(words))


def ledger(docs: DataFrame) -> DataFrame:
    """One row a document: its measurements and ``failed``, the bits of the rules that it fails.

    A null or empty text has no words. A null ``doc_id`` stays null. Repeated rows give repeated rows; columns other than
    ``doc_id`` and ``text`` are ignored.
    """

    def make():
        def step(rows: dict) -> dict:
            got = list(zip(*map(measure, rows["text"]), strict=True))
            return {"doc_id": rows["doc_id"], **dict(zip(MEASURES, got, strict=True))}

        return step

    found = map_chunks(docs.select("doc_id", "text"), make, LEDGER)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return found.withColumn("failed", failed)


def rejects(policy: str | Policy, failed: str = "failed") -> Column:
    """Whether a policy rejects a row of the ledger."""
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def ablations(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and each of its rules: documents rejected by the policy, failing the rule, and rejected by that rule alone.

    One aggregation with map-side partial counts; an empty ledger counts 0 everywhere.
    """
    plans = [(p, r, POLICIES[p].mask, BIT[r]) for p in policies for r in POLICIES[p].rules]
    count = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask))
    one = rows.agg(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), count(hit(mask) != 0).alias("n_rejected"), count(hit(bit) != 0).alias("n_failing"), count(hit(mask) == bit).alias("n_by_it_alone")).alias(f"x{k}") for k, (p, r, mask, bit) in enumerate(plans)])
    return one.select(F.inline(F.array(*[f"x{k}" for k in range(len(plans))])))


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with the verdicts of the base policy and of ``policy``."""
    base = rejects(BASE)
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~rejects(policy)).alias("kept"), "failed", F.lit(policy).alias("policy"))
