"""Means, shares, extremes, windows and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from hearsay.functions.scalars import row_mean
from hearsay.operators import distributions, rollups
from hearsay.session import scratch_path
from hearsay.streaming import rolling


def _rd(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) + 0e0 as {name}"


def _wmean(value: str, weight: str) -> str:
    return f"case when sum({weight}) > 0 then sum({value} * {weight}) / sum({weight}) else avg({value}) end"


def _period_sql(period: str, table: str, measure: str) -> str:
    head = v.SCORED_POSTS if table == "scored" else v.SCORED_COMMENTS
    return (
        f"with {head}, g as (select {period} as p, {measure} as m, count(*) as n from {table} group by {period}) "
        f"select strftime(p, '%Y-%m-%d') as {period}, {_rd('m', 'avg_sentiment')}, "
        f"{v.label_sql('m')} as sentiment_label, n from g"
    )


def _register_periods() -> None:
    sources = {"posts": (v.scored_posts, "scored", "sentiment_post"), "comments": (v.scored_comments, "scored_comments", "sentiment")}
    plain = {"month": "a8_month_mean", "year": "a9_year_mean"}
    weighted = {"month": "a12_weighted_month", "year": "a13_weighted_year"}
    for kind, (frame, table, value) in sources.items():
        for period in ("month", "year"):
            for names, weight in ((plain, None), (weighted, "score_weighted")):
                measure = _wmean(value, weight) if weight else f"avg({value})"

                def query(spark, sf, frame=frame, period=period, value=value, weight=weight):
                    means = rollups.period_mean(frame(spark, sf), v.stamp(), period, value, "m", weight)
                    return means.select(v.day(period, period), v.r("m", "avg_sentiment"), "sentiment_label", "n")

                check(f"{names[period]}_{kind}", _period_sql(period, table, measure))(query)


_register_periods()


@check(
    "a4_label_shares",
    f"with {v.SCORED_POSTS}, l as (select {v.label_sql('sentiment_post')} as sentiment_post_label from scored) "
    f"select sentiment_post_label, count(*) as n, {_rd('count(*) / sum(count(*)) over ()', 'share')} from l group by 1",
)
def a4(spark, sf):
    return rollups.label_counts(v.scored_posts(spark, sf), "sentiment_post_label").select(
        "sentiment_post_label", "n", v.r("share", "share")
    )


@check(
    "a5_label_counts",
    f"with {v.SCORED_COMMENTS}, l as (select {v.label_sql('sentiment')} as comment_sentiment_label from scored_comments) "
    "select comment_sentiment_label, count(*) as n from l group by 1",
)
def a5(spark, sf):
    return rollups.label_counts(v.scored_comments(spark, sf), "comment_sentiment_label").drop("share")


@check(
    "a6_label_counts_by_group",
    f"with {v.SCORED_POSTS}, l as (select subreddit, {v.label_sql('sentiment_post')} as label, count(*) as n from scored group by 1, 2) "
    f"select subreddit, label, n, {_rd('n / sum(n) over (partition by subreddit)', 'share')} from l",
)
def a6(spark, sf):
    counts = rollups.label_counts(v.scored_posts(spark, sf), "sentiment_post_label", ["subreddit"])
    return counts.select("subreddit", F.col("sentiment_post_label").alias("label"), "n", v.r("share", "share"))


@check(
    "a7_group_mean",
    f"with {v.SCORED_POSTS} select subreddit, {_rd('avg(sentiment_post)', 'avg_sentiment')}, count(*) as n from scored group by 1",
)
def a7(spark, sf):
    return rollups.group_mean(v.scored_posts(spark, sf), "sentiment_post", "subreddit", "m").select(
        "subreddit", v.r("m", "avg_sentiment"), "n"
    )


@check(
    "a10_safe_weighted_mean",
    f"with {v.SCORED_COMMENTS} select post_id, {_rd(_wmean('sentiment', '(score - 10)'), 'wmean')}, count(*) as n from scored_comments group by 1",
)
def a10(spark, sf):
    shifted = v.scored_comments(spark, sf).withColumn("w", F.col("score") - 10)
    return rollups.group_mean(shifted, "sentiment", "post_id", "m", "w").select("post_id", v.r("m", "wmean"), "n")


_STATS = (
    f"{v.SCORED_COMMENTS}, stats as (select post_id, avg(sentiment) as m, {_wmean('sentiment', 'greatest(score, 0)')} as w, "
    "count(*) as n_comments from scored_comments group by 1)"
)


@check(
    "a11_comment_stats",
    f"with {_STATS} select post_id, {_rd('m', 'comment_sentiment_mean')}, {_rd('w', 'comment_sentiment_wmean')}, n_comments from stats",
)
def a11(spark, sf):
    return rollups.comment_stats(v.scored_comments(spark, sf)).select(
        "post_id", v.r("comment_sentiment_mean", "comment_sentiment_mean"),
        v.r("comment_sentiment_wmean", "comment_sentiment_wmean"), "n_comments",
    )


_JOINED = f"{v.POSTS}, {_STATS}, joined as (select p.*, m, w, n_comments from posts p left join stats s on s.post_id = p.post_id)"


@check(
    "j3_with_comment_stats",
    f"with {_JOINED} select post_id, title, score, n_comments, {_rd('m', 'comment_sentiment_mean')}, {_rd('w', 'comment_sentiment_wmean')} from joined",
)
def j3(spark, sf):
    joined = rollups.with_comment_stats(v.posts(spark, sf), rollups.comment_stats(v.scored_comments(spark, sf)))
    return joined.select(
        "post_id", "title", "score", "n_comments", v.r("comment_sentiment_mean", "comment_sentiment_mean"),
        v.r("comment_sentiment_wmean", "comment_sentiment_wmean"),
    )


@check("f2_engaged", f"with {_JOINED} select post_id, score, n_comments from joined where score >= 10 or n_comments >= 5")
def f2(spark, sf):
    joined = rollups.with_comment_stats(v.posts(spark, sf), rollups.comment_stats(v.scored_comments(spark, sf)))
    return rollups.engaged(joined).select("post_id", "score", "n_comments")


def _extreme(most_positive: bool):
    def query(spark, sf):
        stats = rollups.comment_stats(v.scored_comments(spark, sf))
        best = rollups.extreme_posts(v.posts(spark, sf), stats, 10, most_positive)
        return best.select("post_id", "title", "body", v.r("comment_sentiment_wmean", "comment_sentiment_wmean"))

    order = "desc" if most_positive else "asc"
    sql = (
        f"with {_JOINED} select post_id, title, body, {_rd('w', 'comment_sentiment_wmean')} from joined "
        f"where score >= 10 or n_comments >= 5 order by w {order} nulls last, post_id limit 10"
    )
    check("t3_most_positive_posts" if most_positive else "t4_most_negative_posts", sql)(query)


_extreme(True)
_extreme(False)


def _argmax(largest: bool):
    def query(spark, sf):
        row = rollups.extreme_row(v.scored_posts(spark, sf), "sentiment_body", "post_id", largest)
        return row.select("post_id", "title", "body", v.r("sentiment_body", "sentiment_body"))

    sql = (
        f"with {v.SCORED_POSTS} select post_id, title, body, {_rd('sentiment_body', 'sentiment_body')} from scored "
        f"order by sentiment_body {'desc' if largest else 'asc'}, post_id limit 1"
    )
    check("a15_most_positive_body" if largest else "a15_most_negative_body", sql)(query)


_argmax(True)
_argmax(False)

_SPINE = (
    "b as (select min(p) as lo, max(p) as hi from g), "
    "spine as (select unnest(generate_series(lo, hi, interval '{step}')) as p from b)"
)


def _resample(freq: str, step: str, end: str):
    def query(spark, sf):
        means = rollups.resample_mean(v.probs(spark, sf), v.stamp(), ["neg_raw", "neg_effective"], freq)
        return means.select(
            F.col("period_end").cast("string").alias("period_end"), v.r("neg_raw", "neg_raw"), v.r("neg_effective", "neg_effective")
        )

    sql = (
        f"with {v.PROBS}, g as (select date_trunc('{freq}', make_timestamp(created_utc*1000000)) as p, avg(neg_raw) as a, "
        f"avg(neg_effective) as b from probs group by 1), {_SPINE.format(step=step)} "
        f"select strftime({end}, '%Y-%m-%d') as period_end, {_rd('g.a', 'neg_raw')}, {_rd('g.b', 'neg_effective')} "
        "from spine left join g on g.p = spine.p"
    )
    check(f"a14_resample_{freq}", sql)(query)


_resample("month", "1 month", "last_day(spine.p)")
_resample("week", "7 days", "spine.p + interval '6 days'")
_resample("day", "1 day", "spine.p")


@check(
    "w1_year_over_year",
    f"with {v.SCORED_POSTS}, y as (select year, avg(sentiment_post) as m from scored group by 1), "
    "l as (select *, lag(m) over (order by year) as p from y) "
    f"select strftime(year, '%Y-%m-%d') as year, {_rd('m', 'avg_sentiment')}, {_rd('p', 'previous')}, {_rd('m - p', 'change')} from l",
)
def w1(spark, sf):
    yearly = rollups.period_mean(v.scored_posts(spark, sf), v.stamp(), "year", "sentiment_post", "m")
    change = rollups.year_over_year(yearly, "m")
    return change.select(v.day("year", "year"), v.r("m", "avg_sentiment"), v.r("previous", "previous"), v.r("change", "change"))


@check(
    "j10_in_spans",
    f"with {v.SCORED_POSTS}, g as (select month, avg(sentiment_post) as m from scored group by 1) "
    f"select strftime(month, '%Y-%m-%d') as month, {_rd('m', 'avg_sentiment')}, "
    "month between date '2023-06-01' and date '2023-10-31' as in_span, "
    "case when month between date '2023-06-01' and date '2023-10-31' then 'release' end as span from g",
)
def j10(spark, sf):
    monthly = rollups.period_mean(v.scored_posts(spark, sf), v.stamp(), "month", "sentiment_post", "m")
    spans = spark.sql("select 'release' as name, date '2023-06-01' as start, date '2023-10-31' as end")
    return rollups.in_spans(monthly, spans).select(v.day("month", "month"), v.r("m", "avg_sentiment"), "in_span", "span")


@check(
    "p14_row_mean",
    f"with {v.SCORED_POSTS} select post_id, {_rd('(sentiment_title + coalesce(score, sentiment_title)) / 2e0', 'both')} from scored",
)
def p14(spark, sf):
    scored = v.scored_posts(spark, sf)
    other = F.coalesce(F.col("score").cast("double"), F.col("sentiment_title"))
    return scored.select("post_id", v.r(row_mean("sentiment_title", other), "both"))


def _bins(x: str, bins: int) -> str:
    return f"cast(least(floor(({x} - lo_{x}) / ((hi_{x} - lo_{x}) / {bins}e0)), {bins - 1}) as int)"


_RANGES = ", ".join(f"min({x}) as lo_{x}, max({x}) as hi_{x}" for x in ("neg_raw", "neg_effective"))


@check(
    "a17_histogram",
    f"with {v.PROBS}, b as (select {_RANGES} from probs), c as ("
    + " union all ".join(f"select '{x}' as series, {_bins(x, 50)} as bin from probs, b" for x in ("neg_raw", "neg_effective"))
    + "), n as (select series, bin, count(*) as n from c group by all), "
    + "s as (select series, unnest(range(50)) as bin, lo, (hi - lo) / 50e0 as width from ("
    + " union all ".join(f"select '{x}' as series, lo_{x} as lo, hi_{x} as hi from b" for x in ("neg_raw", "neg_effective"))
    + f") x) select s.series, cast(s.bin as int) as bin, {_rd('lo + s.bin * width', 'left_edge')}, coalesce(n, 0) as n "
    "from s left join n on n.series = s.series and n.bin = s.bin",
)
def a17(spark, sf):
    bins = distributions.histogram(v.probs(spark, sf), ["neg_raw", "neg_effective"], 50)
    return bins.select("series", "bin", v.r("left_edge", "left_edge"), "n")


@check(
    "a17_histogram_positive",
    f"with {v.PROBS}, b as (select min(pos_prob) as lo_pos_prob, max(pos_prob) as hi_pos_prob from probs), c as ("
    + " union all ".join(f"select '{x}' as series, {_bins(x, 50)} as bin from probs, b" for x in ("pos_prob",))
    + "), n as (select series, bin, count(*) as n from c group by all), "
    + "s as (select series, unnest(range(50)) as bin, lo, (hi - lo) / 50e0 as width from ("
    + " union all ".join(f"select '{x}' as series, lo_{x} as lo, hi_{x} as hi from b" for x in ("pos_prob",))
    + f") x) select s.series, cast(s.bin as int) as bin, {_rd('lo + s.bin * width', 'left_edge')}, coalesce(n, 0) as n "
    "from s left join n on n.series = s.series and n.bin = s.bin",
)
def a17_positive(spark, sf):
    bins = distributions.histogram(v.probs(spark, sf), ["pos_prob"], 50)
    return bins.select("series", "bin", v.r("left_edge", "left_edge"), "n")


@check(
    "a18_density",
    f"with {v.PROBS}, b as (select min(neg_effective) as lo, max(neg_effective) as hi, count(*) as n, "
    "stddev_samp(neg_effective) * pow(count(*), -2e-1) as h from probs), "
    "p as (select unnest(range(200)) as point), g as (select point, n, h, lo - 3 * h + point * (hi - lo + 6 * h) / 199 as x from p, b) "
    f"select cast(point as int) as point, {_rd('any_value(g.x)', 'x', 8)}, "
    f"{_rd('sum(exp(-5e-1 * ((g.x - neg_effective) / h) * ((g.x - neg_effective) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 'density', 8)} "
    "from g, probs group by point",
)
def a18(spark, sf):
    return distributions.density(v.probs(spark, sf), "neg_effective").select("point", v.r("x", "x", 8), v.r("density", "density", 8))


_FINE = "(h * sqrt(8e0 * 1e-4))"


@check(
    "a18_binned_density",
    f"with {v.PROBS}, b as (select min(neg_effective) as lo, max(neg_effective) as hi, count(*) as n, "
    "stddev_samp(neg_effective) * pow(count(*), -2e-1) as h from probs), "
    f"f as (select (neg_effective - lo) / {_FINE} as spot from probs, b), "
    "m as (select floor(spot) as slot, 1 - (spot - floor(spot)) as mass from f union all select floor(spot) + 1, spot - floor(spot) from f), "
    "c as (select slot, sum(mass) as mass from m group by 1), "
    "p as (select unnest(range(200)) as point), g as (select point, n, h, lo, lo - 3 * h + point * (hi - lo + 6 * h) / 199 as x from p, b), "
    f"z as (select point, n, h, x, mass, (x - (lo + slot * {_FINE})) / h as z from g, c) "
    f"select cast(point as int) as point, {_rd('any_value(x)', 'x', 8)}, "
    f"{_rd('sum(mass * exp(-5e-1 * z * z)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 'density', 7)} from z group by point",
)
def a18_binned(spark, sf):
    found = distributions.binned_density(v.probs(spark, sf), "neg_effective")
    return found.select("point", v.r("x", "x", 8), v.r("density", "density", 7))


@check(
    "a19_relation",
    f"with {v.SCORED_POSTS}, q as (select score, sentiment_post from scored where score is not null), "
    "k as (select * from scored), b as (select min(score) as lo_score, max(score) as hi_score, min(sentiment_post) as lo_sentiment_post, "
    f"max(sentiment_post) as hi_sentiment_post from k) select {_bins('score', 20)} as x_bin, {_bins('sentiment_post', 20)} as y_bin, count(*) as n "
    "from q, b group by 1, 2",
)
def a19(spark, sf):
    return distributions.relation(v.scored_posts(spark, sf), "score", "sentiment_post")


@check(
    "a19_correlation",
    f"with {v.SCORED_POSTS} select {_rd('corr(score, sentiment_post)', 'correlation')}, count(score) as n from scored where score is not null",
)
def a19_correlation(spark, sf):
    found = distributions.correlation(v.scored_posts(spark, sf), "score", "sentiment_post")
    return found.select(v.r("correlation", "correlation"), "n")


@check(
    "r2_daily_sums",
    "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, count(value) as n_known, "
    f"{_rd('sum(value)', 'total', 6)}, {_rd('sum(cast(user_id as double))', 'weights', 6)}, {_rd('sum(value * user_id)', 'weighted', 4)} from events group by 1",
)
def r2(spark, sf):
    days = rolling.daily_sums(v.table(spark, sf, "events"), "ts", "value", "user_id")
    return days.select(
        v.day("day", "day"), "n", "n_known", v.r("total", "total", 6), v.r("weights", "weights", 6), v.r("weighted", "weighted", 4)
    )


@check(
    "r2_monthly_from_days",
    "select strftime(date_trunc('month', ts), '%Y-%m-%d') as month, count(*) as n, "
    f"{_rd('avg(value)', 'mean')}, {_rd(_wmean('value', 'user_id'), 'weighted_mean')} from events group by 1",
)
def r2_months(spark, sf):
    days = rolling.daily_sums(v.table(spark, sf, "events"), "ts", "value", "user_id")
    return rolling.roll_up(days).select(v.day("month", "month"), "n", v.r("mean", "mean"), v.r("weighted_mean", "weighted_mean"))


@check(
    "r2_day_stream",
    f"select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, {_rd('sum(value)', 'total', 6)} from events group by 1",
)
def r2_stream(spark, sf):
    schema = v.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = scratch_path(spark, "days")
    rolling.store_days(events, "ts", "value", "user_id", path, scratch_path(spark, "stream")).awaitTermination()
    return rolling.stored_days(spark, path).select(v.day("day", "day"), "n", v.r("total", "total", 6))
