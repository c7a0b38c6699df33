"""Means, shares, extremes and time series of scored posts and comments.

All of them group with map-side partial aggregates, so a month, a label or a community holding a
third of the rows costs its tasks no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.aggregates import known, mean, safe_weighted_mean
from hearsay.functions.scalars import clip_weight, label_sentiment
from hearsay.operators.skew import MAX_BROADCAST_ROWS

STEP = {"month": "1 month", "week": "7 days", "day": "1 day"}


def label_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label with their share (within each ``by`` group); null labels are left out."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def group_mean(df: DataFrame, value: str, by: str | Sequence[str], out: str, weight: str | None = None) -> DataFrame:
    """Plain or weighted mean per group; rows without a group are dropped."""
    by = [by] if isinstance(by, str) else list(by)
    measure = safe_weighted_mean(value, weight) if weight else mean(value)
    return df.dropna(subset=by).groupBy(*by).agg(measure.alias(out), F.count(F.lit(1)).alias("n"))


def period_mean(
    df: DataFrame, ts: Column, period: str, value: str, out: str, weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Mean per month or year (start of period) with its label."""
    stamped = df.withColumn(period, F.date_trunc(period, ts))
    means = group_mean(stamped, value, [*by, period], out, weight)
    return means.withColumn("sentiment_label", label_sentiment(out))


def resample_mean(df: DataFrame, ts: Column, values: Sequence[str], freq: str = "month", weight: str | None = None) -> DataFrame:
    """Mean per period, empty periods included as nulls, labelled by the period's last day.

    The gaps are filled from each period to the next one on the aggregated rows, of which there
    are no more than periods in the time range. Where the weights of a period sum to 0 or less, its
    plain mean is taken.
    """
    def measure(v: str) -> Column:
        if weight is None:
            return mean(v)
        total = F.sum(F.when(known(v).isNotNull(), F.col(weight)))
        return F.when(total > 0, F.sum(known(v) * F.col(weight)) / total).otherwise(mean(v))

    stamped = df.withColumn("period", F.date_trunc(freq, ts)).filter(F.col("period").isNotNull())
    means = stamped.groupBy("period").agg(*[measure(v).alias(v) for v in values])
    following = F.lead("period").over(Window.orderBy("period"))
    step = F.expr(f"interval {STEP[freq]}")
    spans = means.withColumn("last", F.coalesce(following - step, F.col("period")))
    rows = spans.withColumn("at", F.explode(F.sequence("period", "last", step)))
    ends = {"month": F.last_day("at"), "week": F.date_add(F.to_date("at"), 6), "day": F.to_date("at")}
    filled = [F.when(F.col("at") == F.col("period"), F.col(v)).alias(v) for v in values]
    return rows.select(ends[freq].alias("period_end"), *filled)


def year_over_year(yearly: DataFrame, value: str, year: str = "year", by: Sequence[str] = ()) -> DataFrame:
    """Change of a yearly mean against the year before; works on one row per year and series."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(year))
    return yearly.withColumn("previous", before).withColumn("change", F.col(value) - F.col("previous"))


def extreme_row(df: DataFrame, value: str, key: str, largest: bool = True) -> DataFrame:
    """The row with the largest or smallest value; missing values never win, ties go to the key."""
    order = F.desc(value) if largest else F.asc(value)
    return df.filter(known(value).isNotNull()).orderBy(order, key).limit(1)


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def comment_stats(comments: DataFrame, value: str = "sentiment") -> DataFrame:
    """Per post: plain and score-weighted mean of its comments and their number."""
    scored = comments.filter(F.col("post_id").isNotNull()).withColumn("score_w", clip_weight("score"))
    return scored.groupBy("post_id").agg(
        mean(value).alias("comment_sentiment_mean"),
        safe_weighted_mean(value, "score_w").alias("comment_sentiment_wmean"),
        F.count(F.lit(1)).alias("n_comments"),
    )


def with_comment_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """Posts with the statistics of their comments; one row per post on both sides."""
    return posts.join(stats, "post_id", "left")


def engaged(df: DataFrame, min_score: int = 10, min_comments: int = 5) -> DataFrame:
    return df.filter((F.col("score") >= min_score) | (F.col("n_comments") >= min_comments))


def extreme_posts(posts: DataFrame, stats: DataFrame, n: int = 10, most_positive: bool = True) -> DataFrame:
    """The ``n`` engaged posts with the best or worst comments, with their texts.

    The texts do not travel: the ranking uses keys and numbers only, and the ``n`` winners then
    fetch their texts.
    """
    value = "comment_sentiment_wmean"
    order = F.desc_nulls_last(value) if most_positive else F.asc_nulls_last(value)
    ranked = engaged(with_comment_stats(posts.select("post_id", "score"), stats))
    winners = ranked.orderBy(order, "post_id").limit(n).select("post_id", value)
    return posts.join(F.broadcast(winners) if n <= MAX_BROADCAST_ROWS else winners, "post_id")


def in_spans(periods: DataFrame, spans: DataFrame, month: str = "month") -> DataFrame:
    """Mark the months that lie in a named span (name, start, end).

    Spans are unrolled to their months and joined by equality; overlapping spans are listed.
    """
    first = F.date_trunc("month", F.col("start"))
    first = F.when(first < F.col("start").cast("timestamp"), F.add_months(first, 1).cast("timestamp")).otherwise(first)
    months = spans.select(
        "name", F.explode(F.sequence(first, F.date_trunc("month", F.col("end")), F.expr("interval 1 month"))).alias(month)
    )
    names = months.groupBy(month).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("span"))
    return periods.join(names, month, "left").withColumn("in_span", F.col("span").isNotNull())
