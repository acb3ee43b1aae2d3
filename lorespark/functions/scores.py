"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_YEAR = 365.25 * 86400


def effective_confidence(now: Column, confidence: str = "confidence", decay_rate: str = "decay_rate", last_verified: str = "last_verified", expires: str = "expires") -> Column:
    """Confidence after exponential decay since the last check, 0 once expired, within 0 and 1.

    Always relative to ``now``, never to the clock. Null confidence, rate or time give null unless expired.
    """
    passed = F.floor((F.unix_micros(now) - F.unix_micros(F.col(last_verified))) / 1_000_000)
    seconds = F.when(passed > 0, passed).when(passed.isNotNull(), F.lit(0))
    decayed = F.col(confidence) * F.exp(-F.col(decay_rate) * seconds / F.lit(SECONDS_PER_YEAR))
    within = F.when(decayed.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), decayed)))  # greatest and least skip nulls
    return F.when(F.col(expires) <= now, F.lit(0.0)).otherwise(within)


def gaussian(x: Column, at: Column, bandwidth: Column) -> Column:
    """The Gaussian kernel at ``at`` of a value ``x``."""
    return F.exp(-0.5 * F.pow((at - x) / bandwidth, F.lit(2.0))) / (bandwidth * F.lit(2.5066282746310002))
