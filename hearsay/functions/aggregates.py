"""Aggregate expressions built from sums, so that every one combines map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """NaN as null: Spark's sums skip null but not NaN."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def mean(c: Column | str) -> Column:
    return F.avg(known(c))


def safe_weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean if the weights sum to more than 0, else the plain mean of what is known.

    Weights may be negative. While weights count, one missing value makes the mean missing;
    one missing weight makes the weights not count.
    """
    v, w = known(value), known(weight)
    complete = F.count_if(w.isNull()) == 0
    weighted = F.when(F.count_if(v.isNull()) == 0, F.sum(v * w) / F.sum(w))
    return F.when(complete & (F.sum(w) > 0), weighted).otherwise(F.avg(v))
