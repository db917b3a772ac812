"""Vectors as arrays, and a deterministic pseudo-embedding."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import col

#: 32-bit FNV-1a: the offset that a hash starts with, and its prime.
OFFSET, PRIME = np.uint32(2166136261), np.uint32(16777619)
#: Characters whose trigrams are hashed at once.
CHARS = 1 << 19


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """Length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(col(v), lambda x: x / norm)).otherwise(col(v))


def trigram_vectors(texts: list[str], dims: int) -> np.ndarray:
    """Rows of unit length: the trigrams of all texts at once, hashed on one array of UTF-16 units; a sign of minus where the hash has its top bit."""
    units = [np.frombuffer(f"^{re.sub(r'[ \t\n\x0b\f\r]+', ' ', t.lower()).strip()}$".encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    sizes = np.array([len(u) for u in units])
    flat = np.concatenate(units).astype(np.uint32)
    row = np.repeat(np.arange(len(units)), sizes)
    starts = np.flatnonzero(np.concatenate([row[2:] == row[:-2], np.zeros(min(2, len(row)), bool)]))
    h = np.full(len(starts), OFFSET)
    for k in range(3):
        h = (h ^ flat[starts + k]) * PRIME
    bucket = np.abs(np.fmod(h.view(np.int32).astype(np.int64), dims))
    out = np.bincount(row[starts] * dims + bucket, np.where(h >> np.uint32(31), -1.0, 1.0), len(units) * dims).reshape(len(units), dims)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def trigram_rows(texts: Iterable[str], dims: int) -> Iterator[np.ndarray]:
    """The rows of ``trigram_vectors``, some texts at a time: about 60 bytes a character are held, of at most ``CHARS`` characters or of one text."""
    few: list[str] = []
    size = 0
    for t in texts:
        if few and size + len(t) > CHARS:
            yield from trigram_vectors(few, dims)
            few, size = [], 0
        few.append(t)
        size += len(t)
    if few:
        yield from trigram_vectors(few, dims)


def pseudo_embedding(text: Column | str, dims: int = 64) -> Column:
    """Signed hashing of character trigrams of the lower-case text, white space collapsed, between marks; unit length. Null stays null."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        rows = trigram_rows(values.dropna(), dims)
        return pd.Series([next(rows) if there else None for there in values.notna()], dtype=object)

    return run(col(text))
