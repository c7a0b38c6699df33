"""Probabilities that mean what they say: reliability by bins, and a rising map from scores to shares of hits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators.scoring import Scorer

BINS = 256
MAX_BINS = 4096


def _checked(bins: int) -> int:
    if not 1 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be from 1 to {MAX_BINS}")
    return bins


def bin_of(prob: Column, bins: int) -> Column:
    """Number of the equal bin of [0, 1] that holds ``prob``; values beyond the ends go to the end bins, null and NaN to none."""
    number = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), prob.cast("double"))) * bins)
    # greatest and least pass over nulls
    return F.when(prob.isNotNull() & ~F.isnan(prob.cast("double")), F.least(number, F.lit(bins - 1)).cast("int"))


def reliability(df: DataFrame, prob: str, actual: Column | str, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_prob, share)``: per bin of the probability the rows, their mean probability and the share that came true.

    ``actual`` is true or 1 where the class is the row's. Rows with a null or NaN in either are left out; bins without rows have none.
    At most ``bins`` rows come of each task.
    """
    hit = (F.col(actual) if isinstance(actual, str) else actual).cast("double")
    rows = df.select(bin_of(F.col(prob), _checked(bins)).alias("bin"), F.col(prob).cast("double").alias("p"), hit.alias("hit"))
    rows = rows.filter("bin is not null and hit is not null and not isnan(hit)")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_prob"), F.avg("hit").alias("share"))


def expected_error(reliable: DataFrame) -> DataFrame:
    """``(n, error, worst)`` of a reliability table: mean and largest gap between probability and share, bins weighted by their rows.

    One row; without rows ``n`` is 0 and the rest null.
    """
    gap = F.abs(F.col("mean_prob") - F.col("share"))
    return reliable.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum(gap * F.col("n")), F.sum("n")).alias("error"), F.max(gap).alias("worst")
    )


def pooled(counts: Sequence[float], hits: Sequence[float]) -> list[float]:
    """The never falling shares nearest to ``hits / counts`` in squares weighted by ``counts``, all of which are positive.

    Neighbours that fall are pooled to their common share until none does.
    """
    blocks: list[list[float]] = []  # rows, hits, bins
    for n, h in zip(counts, hits, strict=True):
        blocks.append([n, h, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            more = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], more, strict=True)]
    return [h / n for n, h, size in blocks for _ in range(int(size))]


@dataclass(frozen=True)
class Calibration:
    """One share for each equal bin of [0, 1], never falling."""

    shares: tuple[float, ...]

    def apply(self, prob: Column) -> Column:
        """The share of the probability's bin; null for null and NaN."""
        # one constant, whatever the number of bins
        held = F.from_json(F.lit("[" + ",".join(repr(s) for s in self.shares) + "]"), "array<double>")
        return F.get(held, bin_of(prob, len(self.shares)))


def fit(df: DataFrame, prob: str, actual: Column | str, bins: int = BINS) -> Calibration:
    """The rising map by which bins of ``prob`` come nearest to the shares that came true, from one pass over all rows.

    Rows with a null or NaN probability or ``actual`` are left out. A bin without rows takes the share of the bin below that has some, the lowest
    bins that of the first with some. Without any rows every bin has its middle: probabilities stay about as they are. The driver gets a row a bin.
    """
    found = reliability(df, prob, actual, bins).select("bin", "n", (F.col("share") * F.col("n")).alias("hits")).collect()
    if not found:
        return Calibration(tuple((i + 0.5) / bins for i in range(bins)))
    full = sorted((r["bin"], r["n"], r["hits"]) for r in found)
    shares = dict(zip((b for b, _, _ in full), pooled([n for _, n, _ in full], [h for _, _, h in full]), strict=True))
    now, out = shares[full[0][0]], []
    for i in range(bins):
        now = shares.get(i, now)
        out.append(min(max(now, 0.0), 1.0))
    return Calibration(tuple(out))


class CalibratedScorer:
    """Another scorer's probabilities, each by its calibration; several classes are scaled to add up to 1 again.

    Where all classes come to 0 they get the scorer's own probabilities.
    """

    def __init__(self, scorer: Scorer, calibrations: dict[str, Calibration]):
        self.scorer, self.calibrations = scorer, calibrations

    def score(self, df: DataFrame, text: str) -> DataFrame:
        scored = self.scorer.score(df, text)
        names = list(self.calibrations)
        new = scored.withColumns({f"__{c}": self.calibrations[c].apply(F.col(c)) for c in names})
        if len(names) > 1:
            total = sum((F.col(f"__{c}") for c in names[1:]), F.col(f"__{names[0]}"))
            new = new.withColumn("__total", total)
            new = new.withColumns({f"__{c}": F.when(F.col("__total") > 0, F.col(f"__{c}") / F.col("__total")).otherwise(F.col(c)) for c in names})
        return new.withColumns({c: F.col(f"__{c}") for c in names}).drop("__total", *[f"__{c}" for c in names])


def calibrated(scorer: Scorer, labelled: DataFrame, text: str, classes: dict[str, Column], bins: int = BINS) -> CalibratedScorer:
    """``scorer`` calibrated on ``labelled`` texts that it was not trained on; ``classes`` gives each column's truth.

    One pass a class scores the texts again, so write the scored rows first where the scorer is dear and use ``fit`` on them.
    """
    scored = scorer.score(labelled, text)
    return CalibratedScorer(scorer, {c: fit(scored, c, truth, bins) for c, truth in classes.items()})


def log_loss(df: DataFrame, prob: str, actual: Column | str, floor: float = 1e-6) -> DataFrame:
    """``(n, loss)``: mean natural log loss of the probabilities, held at least ``floor`` away from 0 and 1."""
    if not 0 < floor < 0.5 or math.isnan(floor):
        raise ValueError("floor must be between 0 and 0.5")
    hit = (F.col(actual) if isinstance(actual, str) else actual).cast("double")
    p = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col(prob).cast("double")))
    known = F.col(prob).isNotNull() & ~F.isnan(F.col(prob).cast("double"))
    rows = df.filter(known).select((-hit * F.log(p) - (1 - hit) * F.log(1 - p)).alias("loss")).dropna()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))
