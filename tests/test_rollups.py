import math

import pytest
from pyspark.sql import functions as F

from hearsay.operators import distributions, rollups

STATS = "post_id string, comment_sentiment_wmean double, n_comments bigint"


def test_null_groups_are_dropped(spark):
    df = spark.createDataFrame([("2020-01-05", 1.0, 1), ("2020-01-09", 3.0, 3), (None, 9.0, 1)], "d string, v double, w int")
    rows = rollups.period_mean(df, F.to_timestamp("d"), "month", "v", "m", "w").collect()
    assert [(r.m, r.n, r.sentiment_label) for r in rows] == [(2.5, 2, "positive")]


def test_negative_weights_are_not_clipped_in_periods_but_are_per_post(spark):
    df = spark.createDataFrame([("p", 1.0, -1), ("p", 3.0, 3)], "post_id string, sentiment double, score int")
    assert rollups.group_mean(df, "sentiment", "post_id", "m", "score").first().m == 4.0
    assert rollups.comment_stats(df).first().comment_sentiment_wmean == 3.0


@pytest.mark.parametrize("freq, ends", [("month", ["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30"]), ("day", None), ("week", None)])
def test_resample_fills_gaps_and_labels_period_ends(spark, freq, ends):
    df = spark.createDataFrame([("2020-01-05", 1.0), ("2020-01-25", 3.0), ("2020-04-02", 5.0)], "d string, v double")
    rows = rollups.resample_mean(df, F.to_timestamp("d"), ["v"], freq).orderBy("period_end").collect()
    if ends:
        assert [str(r.period_end) for r in rows] == ends and [r.v for r in rows] == [2.0, None, None, 5.0]
    else:
        step = {"day": 1, "week": 7}[freq]
        gaps = {(b.period_end - a.period_end).days for a, b in zip(rows, rows[1:])}
        assert gaps == {step} and sum(r.v is not None for r in rows) == 3
        assert freq == "day" or all(r.period_end.weekday() == 6 for r in rows)


def test_resample_of_weighted_rows_equals_repeated_rows(spark):
    df = spark.createDataFrame([("2020-01-05", 1.0, 3), ("2020-01-06", 5.0, 1), ("2020-01-07", None, 9)], "d string, v double, w int")
    assert rollups.resample_mean(df, F.to_timestamp("d"), ["v"], "month", "w").first().v == 2.0


def test_ties_go_to_the_key_and_missing_never_wins(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", math.nan), ("d", None), ("e", -1.0)], "k string, v double")
    assert rollups.extreme_row(df, "v", "k").first().k == "a"
    assert rollups.extreme_row(df, "v", "k", largest=False).first().k == "e"


def test_extreme_posts_keep_unknown_last_and_need_engagement(spark):
    posts = spark.createDataFrame([("a", 1, "t"), ("b", 50, "t"), ("c", None, "t"), ("d", 10, "t"), ("e", 9, "t")], "post_id string, score bigint, body string")
    stats = spark.createDataFrame([("a", 0.9, 5), ("c", 0.1, 7), ("d", -0.5, 1), ("e", 1.0, 4)], STATS)
    best = rollups.extreme_posts(posts, stats, 2).collect()
    worst = rollups.extreme_posts(posts, stats, 9, most_positive=False).collect()
    assert {r.post_id for r in best} == {"a", "c"} and {r.post_id for r in worst} == {"a", "b", "c", "d"}


def test_texts_do_not_travel_to_the_ranking(spark, tmp_path):
    spark.createDataFrame([("a", 11, "text")], "post_id string, score bigint, body string").write.parquet(str(tmp_path / "p"))
    stats = spark.createDataFrame([("a", 0.9, 5)], STATS)
    plan = rollups.extreme_posts(spark.read.parquet(str(tmp_path / "p")), stats)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("body" in line for line in scans) == 1 and len(scans) == 2


def test_shares_sum_to_one_within_groups(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "p"), ("x", "n"), ("y", "p"), ("y", None)], "g string, l string")
    rows = rollups.label_counts(df, "l", ["g"]).groupBy("g").agg(F.sum("share").alias("s"), F.sum("n").alias("n")).orderBy("g").collect()
    assert [(r.s, r.n) for r in rows] == [(1.0, 3), (1.0, 1)]


def test_year_over_year(spark):
    df = spark.createDataFrame([(2020, 1.0), (2021, 3.0)], "year int, v double")
    assert [r.change for r in rollups.year_over_year(df, "v").orderBy("year").collect()] == [None, 2.0]


def test_spans_list_overlaps(spark):
    months = spark.sql("select explode(sequence(timestamp'2023-05-01', timestamp'2023-08-01', interval 1 month)) as month")
    spans = spark.sql("select * from values ('a', date'2023-06-01', date'2023-07-15'), ('b', date'2023-06-02', date'2023-08-31') t(name, start, end)")
    assert [r.span for r in rollups.in_spans(months, spans).orderBy("month").collect()] == [None, "a", "a, b", "b"]


def test_histogram_keeps_empty_bins_and_leaves_nulls_out(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, None), (10.0, 1.0), (math.nan, 1.0)], "a double, b double")
    rows = distributions.histogram(df, ["a", "b"], 5).collect()
    assert len(rows) == 10
    counts = {(r.series, r.bin): r.n for r in rows}
    assert [counts["a", i] for i in range(5)] == [2, 0, 0, 0, 1] and sum(counts["b", i] for i in range(5)) == 3


def test_density_integrates_to_one_and_matches_brute_force(spark):
    values = [0.1, 0.2, 0.2, 0.7, 0.9]
    rows = distributions.density(spark.createDataFrame([(v,) for v in values], "v double"), "v", points=400, cut=6.0).orderBy("point").collect()
    n, mean = len(values), sum(values) / len(values)
    h = n ** -0.2 * math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
    for r in rows[::37]:
        want = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want)
    assert sum(r.density for r in rows) * (rows[1].x - rows[0].x) == pytest.approx(1.0, abs=1e-3)


def test_relation_and_correlation_skip_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 1.0)], "x double, y double")
    assert distributions.relation(df, "x", "y", 2).agg(F.sum("n")).first()[0] == 2
    row = distributions.correlation(df, "x", "y").first()
    assert row.n == 2 and row.correlation == pytest.approx(1.0)


def test_weights_that_sum_to_nothing_give_the_plain_mean(spark):
    df = spark.createDataFrame([("2020-01-05", 1.0, 1), ("2020-01-09", 3.0, -1), ("2020-02-01", 4.0, 0), ("2020-03-01", None, 2), ("2020-04-01", 2.0, 2), ("2020-04-02", 8.0, 1)], "d string, v double, w int")
    rows = rollups.resample_mean(df, F.to_timestamp("d"), ["v"], "month", "w").orderBy("period_end").collect()
    assert [r.v for r in rows] == [2.0, 4.0, None, 4.0]


@pytest.mark.parametrize("values", [[5.0, 5.0, 5.0], [1.0], [None], []])
def test_no_spread_has_no_density(spark, values):
    assert distributions.density(spark.createDataFrame([(v,) for v in values], "x double"), "x").count() == 0


def test_binned_density_keeps_its_bound(spark):
    import math
    import random

    from hearsay.operators import distributions

    r = random.Random(6)
    df = spark.createDataFrame([(r.choice((r.gauss(0, 1), r.gauss(6, 0.2))),) for _ in range(3000)] + [(None,), (float("nan"),)], "x double")
    exact = {p.point: (p.x, p.density) for p in distributions.density(df, "x").collect()}
    n, sd = 3000, df.dropna().selectExpr("stddev(x)").first()[0]
    peak = 1 / (sd * n**-0.2 * math.sqrt(2 * math.pi))
    for error in (1e-2, 1e-4, 1e-6):
        close = {p.point: (p.x, p.density) for p in distributions.binned_density(df, "x", error=error).collect()}
        assert set(close) == set(exact) == set(range(200))
        assert all(abs(close[i][0] - exact[i][0]) < 1e-9 and abs(close[i][1] - exact[i][1]) <= error * peak for i in exact)
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert distributions.binned_density(same, "x").count() == distributions.density(same, "x").count() == 0
