"""Text functions on columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(name)), r"\s+", " "))


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """NFKD, which Spark has no function for."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


def folded(text: Column | str) -> Column:
    """The part of surface normalisation after decomposition: marks off, lower case, joined punctuation off, separators to spaces."""
    out = F.lower(F.regexp_replace(col(text), r"\p{M}+", ""))
    out = F.regexp_replace(out, "[.'’`]", "")
    out = F.regexp_replace(out, r'[,;:!?"()\[\]{}<>|\\*~^—–-]', " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalize_surface(surface: Column | str) -> Column:
    """The canonical key of a surface form; keeps + # & / @ _ $, which tell names apart."""
    return folded(decomposed(col(surface)))


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(text)), "[^a-z0-9]+"), lambda t: t != "")


def word_shingles(text: Column | str, n: int = 3) -> Column:
    """Distinct word n-grams over lower-case alphanumeric tokens; the distinct tokens where there are fewer than n."""
    t = tokens(text)
    windows = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.array_distinct(F.when(F.size(t) < n, t).otherwise(windows))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(col(a), col(b)))
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(col(text)) / F.lit(4.0)).cast("long")


def slug(text: Column | str, most: int = 48) -> Column:
    dashed = F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most), "-+$", "")


def safe_filename(name: Column | str, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(col(name), "[^A-Za-z0-9._-]", "_"), 1, most)


def ellipsis(text: Column | str, most: int) -> Column:
    return F.when(F.length(col(text)) > most, F.concat(F.substring(col(text), 1, most), F.lit("…"))).otherwise(col(text))


def without_sentences(text: Column | str, token: str) -> Column:
    """Line by line, without the sentences that hold ``token``; a line's bullet stays if any sentence does."""

    def line(raw: Column) -> Column:
        bullet = F.regexp_extract(raw, r"^\s*[-*•]\s+", 0)
        rest = F.substr(raw, F.length(bullet) + 1)
        kept = F.filter(F.split(rest, r"(?<=[.!?])\s+"), lambda s: ~F.contains(s, F.lit(token)))
        return F.when(F.contains(raw, F.lit(token)), F.when(F.size(kept) > 0, F.concat(bullet, F.array_join(kept, " ")))).otherwise(raw)

    return F.array_join(F.filter(F.transform(F.split(col(text), "\n"), line), lambda x: x.isNotNull()), "\n")


def rendered(template: Column | str, values: dict[str, Column]) -> Column:
    """``{{name}}`` placeholders replaced by columns; a null value renders as nothing."""
    out = col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def embedding_text(kind: Column, text: Column, date: Column) -> Column:
    """``type: text (date)``, leaving out what is null."""
    return F.concat(F.coalesce(F.concat(kind, F.lit(": ")), F.lit("")), F.coalesce(text, F.lit("")), F.coalesce(F.concat(F.lit(" ("), date, F.lit(")")), F.lit("")))


def enum(value: Column | str, names: tuple[str, ...]) -> Column:
    """A tolerant enumeration value: trimmed, upper case, null if unknown."""
    v = F.upper(F.trim(col(value)))
    return F.when(v.isin(*names), v)


def mentions_keyword(text: Column | str, keywords: tuple[str, ...]) -> Column:
    """Whether a keyword stands in the text between characters that are no letters, in any case."""
    return F.rlike(F.lower(col(text)), F.lit(r"(?<!\p{L})(?:" + "|".join(k.lower() for k in keywords) + r")(?!\p{L})"))
