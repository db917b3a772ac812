"""Numeric functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.config import Params
from evidentia.functions.text import col


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column) -> Column:
    c = clip(p, 1e-9, 1 - 1e-9)
    return F.ln(c / (1 - c))


def sigmoid(s: Column) -> Column:
    return 1 / (1 + F.exp(-s))


def rel(b: Column) -> Column:
    """How far a voice counts: as far as it is believed itself."""
    return clip(2 * b - 1, 0.0, 1.0)


def saturation(mass: Column, midpoint: float) -> Column:
    m = F.greatest(mass, F.lit(0.0))
    return m / (m + midpoint)


def display(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("int")


def claim_prior(p: Params, tier: Column | str = "tier_seed", source_class: Column | str = "source_class", favorability: Column | str = "favorability", basis: Column | str = "basis") -> Column:
    """Tier base in log-odds, a bonus against interest, a penalty for inferred claims."""
    base = F.when(col(tier) == "HIGH", 0.85).when(col(tier) == "MEDIUM", 0.60).otherwise(0.35)
    against = F.coalesce((col(source_class) == "SELF") & (col(favorability) < p.favorability_threshold), F.lit(False))
    s = logit(base) + F.when(against, p.against_interest_bonus).otherwise(0.0) + F.when(col(basis) == "INFERRED", p.inferred_penalty).otherwise(0.0)
    return sigmoid(s)


def tier(score: Column, p: Params) -> Column:
    return F.when(score >= p.tier_high, "HIGH").when(score >= p.tier_medium, "MEDIUM").otherwise("LOW")


def band(score: Column, p: Params) -> Column:
    out = F.when(score >= p.bands[0][0], p.bands[0][1])
    for least, name in p.bands[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("UNSUPPORTED")
