"""Set similarities of titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


#: Similarities from the highest, and the novelty of what reaches them.
NOVELTY = ((0.95, 0.0), (0.8, 0.1), (0.65, 0.25), (0.45, 0.55), (0.25, 0.8))


def novelty(similarity: Column) -> Column:
    """Fixed steps from the highest similarity to history; no history is new."""
    out = F.when(similarity.isNull(), 1.0)
    for least, value in NOVELTY:
        out = out.when(similarity >= least, value)
    return out.otherwise(1.0)


def clamp(x: Column) -> Column:
    """To [0, 1], rounded half up to three places."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 1000 + 0.5) / 1000
