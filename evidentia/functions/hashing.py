"""Deterministic hashes: prefixes of SHA-256, splits, picks, and HMAC."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import col


def sha_prefix(text: Column | str, n: int = 12) -> Column:
    return F.substring(F.sha2(col(text).cast("string"), 256), 1, n)


def hash_split(key: Column | str) -> Column:
    """TEST or TUNE, by the first byte of the hash."""
    return F.when(F.conv(sha_prefix(key, 2), 16, 10).cast("int") % 2 == 0, "TEST").otherwise("TUNE")


def pool_pick(key: Column | str, size: int) -> Column:
    """The whole hash as a number, modulo ``size``."""
    digits = F.split(F.sha2(col(key).cast("string"), 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % size)


def keyed_hash(text: Column | str, key: str) -> Column:
    """HMAC-SHA256 from SHA-256: the key, in a block of 64 bytes, is mixed with the two pads before and after."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda byte: F.lit(bytes(b ^ byte for b in block))
    inner = F.sha2(F.concat(pad(0x36), F.encode(col(text), "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def map_hash(values: Column | str) -> Column:
    """SHA-256 of a map's sorted key=value lines."""
    lines = F.transform(F.map_entries(col(values)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)


def turns_hash(turns: Column | str) -> Column:
    """Twelve digits over ``role|kind|text`` lines of an array of turns."""
    lines = F.transform(col(turns), lambda t: F.concat_ws("|", t["role"], t["kind"], F.coalesce(t["text"], F.lit(""))))
    return sha_prefix(F.array_join(lines, "\n"), 12)
