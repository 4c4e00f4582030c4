"""Score arithmetic.  Scores are whole tenths, so sums are exact and thresholds compare exactly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import dictionaries as D


def from_tenths(score10: Column) -> Column:
    return score10 / F.lit(10.0)


def capped_score(score10: Column, divisor: int, cap: float = 0.95) -> Column:
    """min(score / divisor, cap)."""
    return F.least(score10 / F.lit(10.0 * divisor), F.lit(cap))


def confidence_level(x: Column) -> Column:
    chain = F
    for bound, label in D.CONFIDENCE_LEVELS:
        chain = chain.when(x >= bound, F.lit(label))
    return chain.otherwise(F.lit(D.LOWEST_CONFIDENCE))


def confidence_rank(label: Column) -> Column:
    """Listing order of the labels, best first."""
    labels = [name for _, name in D.CONFIDENCE_LEVELS] + [D.LOWEST_CONFIDENCE]
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, labels)), label), F.lit(0)),
                      F.lit(len(labels) + 1))
