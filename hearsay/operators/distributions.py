"""Histograms, densities and the score-sentiment relation, in one pass after their bounds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.aggregates import known


@dataclass(frozen=True)
class Bounds:
    """What is known of a column before its second pass: one row, so it may pass through the driver."""

    lo: Column
    hi: Column
    sd: Column
    n: Column


def _bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, Bounds]:
    measures = {"lo": F.min, "hi": F.max, "sd": F.stddev, "n": F.count}
    row = df.agg(*[m(known(c)).alias(f"{c} {name}") for c in columns for name, m in measures.items()]).first()
    return {c: Bounds(*[F.lit(row[f"{c} {name}"]).cast("double") for name in measures]) for c in columns}


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / F.lit(bins)
    slot = F.when(width > 0, F.floor((x - lo) / width)).otherwise(F.lit(0))
    # least() skips nulls, so a missing value must be kept out of it
    return F.when(x.isNotNull(), F.least(slot, F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins of one or more series, each over its own range; empty bins count 0."""
    stats = _bounds(df, columns)
    items = [
        F.struct(F.lit(c).alias("series"), _bin(known(c), stats[c].lo, stats[c].hi, bins).alias("bin"))
        for c in columns
    ]
    counts = (
        df.select(F.explode(F.array(*items)).alias("i")).select("i.*")
        .filter(F.col("bin").isNotNull()).groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    edges = [
        F.struct(
            F.lit(c).alias("series"), stats[c].lo.alias("lo"),
            ((stats[c].hi - stats[c].lo) / F.lit(bins)).alias("width"),
        )
        for c in columns
    ]
    slots = (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"), F.explode(F.array(*edges)).alias("e")).select("bin", "e.*")
    )
    joined = slots.join(counts, ["series", "bin"], "left")
    return joined.select(
        "series", "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


@dataclass(frozen=True)
class _Kernel:
    """An even grid of points over a column, and the width of the bell around each value."""

    start: Column
    step: Column
    width: Column
    n: Column
    spread: Column


def _kernel(df: DataFrame, column: str, points: int, cut: float) -> _Kernel:
    s = _bounds(df, [column])[column]
    width = s.sd * F.pow(s.n, F.lit(-0.2))
    start = s.lo - F.lit(cut) * width
    return _Kernel(start, (s.hi - s.lo + F.lit(2 * cut) * width) / F.lit(points - 1), width, s.n, s.sd)


def _summed(values: DataFrame, k: _Kernel, points: int) -> DataFrame:
    """The bells of all ``values(x, mass)`` at every point: a row a value and point, added up by point within the task."""
    at = values.select("x", "mass", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    z = F.try_divide(k.start + F.col("point") * k.step - F.col("x"), k.width)
    sums = at.groupBy("point").agg(F.sum(F.col("mass") * F.exp(F.lit(-0.5) * z * z)).alias("total"))
    scale = k.n * k.width * F.sqrt(F.lit(2.0) * F.pi())
    return sums.filter(F.col("total").isNotNull()).select(
        "point", (k.start + F.col("point") * k.step).alias("x"), (F.col("total") / scale).alias("density")
    )


def density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth n^(-1/5) x standard deviation.

    Exact: every row adds to ``points`` sums, and a task sends on one row of each. Fewer than two
    values, or values that are all the same, have no density: no rows.
    """
    k = _kernel(df, column, points, cut)
    values = df.select(known(column).alias("x"), F.lit(1.0).alias("mass")).filter(F.col("x").isNotNull() & (k.spread > 0))
    return _summed(values, k, points)


def binned(df: DataFrame, column: str, width: Column, origin: Column) -> DataFrame:
    """``(slot, mass)``: each value split between the two ends of its fine bin, by how near it is to them.

    Masses add up, so tables of them from days or files merge by adding, and a task sends on one row a bin.
    """
    at = F.try_divide(known(column) - origin, width)
    slot = F.floor(at)
    ends = F.array(
        F.struct(slot.alias("slot"), (1 - (at - slot)).alias("mass")), F.struct((slot + 1).alias("slot"), (at - slot).alias("mass"))
    )
    rows = df.select(F.explode(F.when(at.isNotNull(), ends).otherwise(F.array())).alias("e")).select("e.*")
    return rows.groupBy("slot").agg(F.sum("mass").alias("mass"))


def binned_density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0, error: float = 1e-4) -> DataFrame:
    """As ``density`` to within ``error`` of the highest density one value can give, from fine bins.

    Splitting a value between the ends of a bin moves the bell's height at any point by at most an eighth of the squared bin width times the bell's
    greatest curvature, its peak over the squared bandwidth. So bins of the bandwidth times the root of 8 x ``error`` keep the bound, and their number depends on
    the range and the bound, not on the rows; only bins meet the points.
    """
    k = _kernel(df, column, points, cut)
    fine = k.width * F.lit((8 * error) ** 0.5)
    origin = k.start + F.lit(cut) * k.width
    bins = binned(df.filter(k.spread > 0), column, fine, origin)
    return _summed(bins.select((origin + F.col("slot") * fine).alias("x"), "mass"), k, points)


def relation(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Counts on a two-way grid, the table behind a scatter plot."""
    s = _bounds(df, [x, y])
    cells = df.select(
        _bin(known(x), s[x].lo, s[x].hi, bins).alias("x_bin"),
        _bin(known(y), s[y].lo, s[y].hi, bins).alias("y_bin"),
    )
    return cells.dropna().groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over rows where both are known."""
    return df.select(known(x).alias("x"), known(y).alias("y")).dropna().agg(
        F.corr("x", "y").alias("correlation"), F.count(F.lit(1)).alias("n")
    )
