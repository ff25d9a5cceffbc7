"""Ratios, intervals and lookups as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def ratio(hits, total) -> Column:
    """hits / total; null, never 1, where total is 0."""
    return F.try_divide(_col(hits).cast("double"), _col(total).cast("double"))


def ratio_sum(hits, total) -> Column:
    """The sum of hits / total of whole numbers, to 27 decimals: unlike one of doubles it has no order, and a whole sum is whole."""
    return F.sum(_col(hits).cast("decimal(10,0)") / _col(total).cast("decimal(26,0)"))


def thousandths(total: Column) -> Column:
    """The whole thousandths of a ratio_sum."""
    return F.floor(F.round(total * F.lit(1000).cast("decimal(4,0)"), 20)).cast("long")


def wilson(successes, trials, z: float = 1.96) -> Column:
    """struct(low, high): the Wilson interval within 0 and 1; (0, 1) without trials."""
    s, n = _col(successes).cast("double"), F.when(_col(trials) > 0, _col(trials).cast("double"))
    p = s / n
    denominator = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (n * 2.0)) / denominator
    spread = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (n * n * 4.0)) / denominator
    return F.struct(F.coalesce(F.greatest(F.lit(0.0), centre - spread), F.lit(0.0)).alias("low"), F.coalesce(F.least(F.lit(1.0), centre + spread), F.lit(1.0)).alias("high"))


def harmonic(a, b) -> Column:
    """Harmonic mean, 0 where either is 0 or null."""
    a, b = (F.coalesce(_col(x).cast("double"), F.lit(0.0)) for x in (a, b))
    return F.when((a > 0) & (b > 0), F.lit(2.0) * a * b / (a + b)).otherwise(0.0)


def binned(value, bins: Sequence[Sequence[float]]) -> Column:
    """The probability of the first bin [low, high) that holds value; a bin up to 1 has no upper end; null outside."""
    value, out = _col(value), F.lit(None).cast("double")
    for low, high, probability in reversed(list(bins)):
        inside = (value >= low) & (value < high)
        if high >= 1.0:
            inside = inside | (value >= high)
        out = F.when(inside, F.lit(float(probability))).otherwise(out)
    return out


def pick(refined, original, quality, least: float) -> Column:
    """refined where its quality is at least least, else original."""
    return F.coalesce(F.when(_col(quality) >= least, _col(refined)), _col(original))
