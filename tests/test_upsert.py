import json
import uuid

import pytest
from pyspark.sql import functions as F

from hearsay import schemas, session
from hearsay.operators import normalize, skew, upsert
from hearsay.plans import ingest
from hearsay.session import scratch_path
from hearsay.sources import landing, tables


@pytest.fixture
def database(spark):
    name = f"t{uuid.uuid4().hex}"
    tables.create_tables(spark, name, scratch_path(spark, name), buckets=4)
    return name


def posts(spark, rows):
    return normalize.conform(spark.createDataFrame(rows, "post_id string, title string, score bigint, subreddit string"), schemas.POSTS)


def test_create_is_repeatable_and_listed(spark, database):
    tables.create_tables(spark, database, scratch_path(spark, database), buckets=4)
    assert [r.name for r in tables.list_tables(spark, database).collect()] == ["comments", "posts"]
    tables.drop(spark, f"{database}.comments")
    tables.drop(spark, f"{database}.comments")
    assert [r.name for r in tables.list_tables(spark, database).collect()] == ["posts"]


def test_first_write_wins_and_repeat_adds_nothing(spark, database):
    name = f"{database}.posts"
    first = upsert.insert_or_ignore(posts(spark, [("a", "old", 1, "s"), (None, "x", 1, "s")]), name, "post_id")
    again = posts(spark, [("a", "new", 2, "s"), ("b", "b", 3, "s")])
    second, third = (upsert.insert_or_ignore(again, name, "post_id") for _ in range(2))
    assert (first, second, third) == (upsert.Inserted(1, 1), upsert.Inserted(2, 1), upsert.Inserted(2, 0))
    assert {(r.post_id, r.title) for r in spark.table(name).collect()} == {("a", "old"), ("b", "b")}


def test_stored_keys_are_not_shuffled(spark, database):
    name = f"{database}.posts"
    tables.append(posts(spark, [(str(i), "t", i, "s") for i in range(200)]), name)
    assert tables.bucket_count(spark, name) == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = posts(spark, [("1", "t", 1, "s")]).join(tables.keys(spark, name, "post_id"), "post_id", "left_anti")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "LeftAnti" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_replace_may_read_what_it_replaces(spark, database):
    name, folder = f"{database}.kept", scratch_path(spark, "kept")
    tables.replace(spark.range(3).toDF("x"), name, folder)
    tables.replace(spark.table(name).filter("x > 0"), name, folder)
    assert spark.table(name).count() == 2


def test_union_skips_missing_frames(spark):
    both = upsert.safe_union([None, spark.sql("select 1 as a"), spark.sql("select 2 as b")])
    assert sorted(tuple(r) for r in both.select("a", "b").fillna(0).collect()) == [(0, 2), (1, 0)]
    assert upsert.safe_union([None]) is None


def test_dedup_takes_the_first_in_order(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, o int")
    assert {tuple(r) for r in upsert.dedup(df, "k", ["o"]).collect()} == {("a", 1), ("b", 5)}


def test_dedup_cuts_copies_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    plan = upsert.dedup(df, "k", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 97).cast("string")).alias("k"),
        F.lit("same").alias("v"))
    right = spark.range(60).select(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("r"))
    got = skew.lookup_join(left, right, "k", how, max_broadcast_rows=0)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_salting_spreads_identical_rows(spark):
    copies = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("k"))
    hot = skew.hot_keys(copies, ["k"], 8).collect()
    assert [(r.k, r["__cuts"]) for r in hot] == [("hot", 8)]
    even = spark.range(800).select((F.col("id") % 100).alias("k"))
    assert skew.hot_keys(even, ["k"], 8).count() == 0


@pytest.mark.parametrize("n", [2, 1500])
def test_top_n_per_group(spark, n):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    got = skew.top_n_per_group(df, ["g"], [F.desc("x")], n)
    assert got.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("m")).orderBy("g").collect() == [
        (0, n, 5998 - 2 * (n - 1)), (1, n, 5999 - 2 * (n - 1))]


def test_top_up_takes_sweeps_only_while_posts_are_wanted(spark, database):
    name, taken = f"{database}.posts", []

    def sweeps(*parts):
        for part in parts:
            taken.append(part)
            rows = [(str(i), f"t{i}", 1, "s", i) for i in part] + [(None, "t", 1, "s", 9)]
            yield spark.createDataFrame(rows, "id string, title string, score bigint, subreddit string, sweep_rank int")

    found = ingest.top_up(spark, sweeps(range(3), range(3), range(2, 8), range(20)), name, 6)
    assert found == [ingest.Round(3, 3, 3, 3), ingest.Round(3, 0, 3, 3), ingest.Round(6, 5, 8, 0)] and len(taken) == 3
    assert ingest.top_up(spark, sweeps(range(50)), name, 8) == [] and len(taken) == 3
    assert ingest.top_up(spark, sweeps(range(9)), name, 100) == [ingest.Round(9, 1, 9, 91)]
    assert ingest.top_up(spark, [], name, 100) == []


def test_listing_modes_and_limits(spark):
    with pytest.raises(ValueError):
        landing.check_modes(["top", "best"])
    landed = spark.createDataFrame(
        [(str(i), i, "s", m, t) for i in range(5) for m, t in (("top", "year"), ("top", "all"), ("new", "none"))],
        "id string, rank bigint, subreddit string, mode string, time_filter string")
    got = landing.listing(landed, "s", ["top", "new"], "year", 2)
    assert sorted((r.id, r.mode, r.time_filter) for r in got.collect()) == [
        ("0", "new", "none"), ("0", "top", "year"), ("1", "new", "none"), ("1", "top", "year")]


def test_listing_filters_reach_the_partitions(spark):
    path = scratch_path(spark, "listing")
    one = spark.createDataFrame([("1", 1.0, "t", "b", "a", 1, 1, "/p", 1, "s", "top", "year")], schemas.LISTING)
    one.write.partitionBy("subreddit", "mode", "time_filter").parquet(path)
    plan = landing.listing(landing.read_listing(spark, path), "s", "top")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "subreddit" in filters and "mode" in filters


def test_missing_author_and_epoch_zero(spark):
    row = spark.createDataFrame([("1", 0.0, None, None, None, 1, 1, "/p", 1, "s", "top", "year")], schemas.LISTING)
    shaped = landing.shape_listing(row).first()
    assert (shaped.author, shaped.title, shaped.created_date, shaped.permalink) == ("None", "", None, "https://reddit.com/p")


def test_threads_any_depth_and_bad_records(spark):
    reply = {"kind": "t1", "id": "d25", "body": "deep"}
    for level in range(24, 0, -1):
        reply = {"kind": "t1", "id": f"d{level}", "created_utc": 1.0, "author": None, "body": "x", "score": 1, "replies": [reply, {"kind": "more"}]}
    path = scratch_path(spark, "threads")
    lines = [json.dumps({"post_id": "p", "permalink": "/p", "comments": [reply]}), "{broken", json.dumps({"post_id": "q", "permalink": "/q", "comments": []})]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    threads = landing.read_threads(spark, path)
    flat = landing.flatten_threads(threads).collect()
    assert sorted(r.comment_id for r in flat) == sorted(f"d{i}" for i in range(1, 26))
    assert {r.author for r in flat} == {"None"} and {r.parent_permalink for r in flat} == {"https://reddit.com/p"}
    assert [r[0] for r in landing.bad_threads(threads.cache()).collect()] == ["{broken"]


def test_comments_take_subreddit_only_if_all_are_missing(spark):
    stored = posts(spark, [("1", "t", 1, "red"), ("2", "t", 1, "blue")])
    bare = spark.createDataFrame([("1", "c1"), ("2", "c2"), ("3", "c3"), (None, "c4"), ("1", None)], "post_id string, comment_id string")
    got = normalize.normalise_comments(bare, stored)
    assert {(r.comment_id, r.subreddit) for r in got.collect()} == {("c1", "red"), ("c2", "blue"), ("c3", None)}
    some = bare.withColumn("subreddit", F.when(F.col("comment_id") == "c1", "own"))
    assert {r.subreddit for r in normalize.normalise_comments(some, stored).collect()} == {"own", None}


def test_candidates_use_an_anti_join(spark):
    p = posts(spark, [("1", "t", 5, "s"), ("2", "t", None, "s"), ("3", "t", 9, "s"), ("4", "t", 9, "s")])
    c = spark.createDataFrame([("3", "c"), (None, "d")], "post_id string, comment_id string")
    found = upsert.comment_candidates(p, c)
    assert [r.post_id for r in found.collect()] == ["4", "1", "2"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "TakeOrderedAndProject" in plan


def test_upsert_comments_leaves_strays_out(spark, database):
    tables.append(posts(spark, [("1", "t", 1, "red")]), f"{database}.posts")
    landed = spark.createDataFrame([("1", "c1"), ("1", "c1"), ("9", "c2")], "post_id string, comment_id string").withColumn("created_utc", F.lit(5.0))
    ids = landed.select("post_id")
    runs = [ingest.upsert_comments(spark, landed, ids, f"{database}.posts", f"{database}.comments") for _ in range(2)]
    assert runs == [upsert.Inserted(1, 1), upsert.Inserted(1, 0)]
    assert [(r.comment_id, r.subreddit) for r in spark.table(f"{database}.comments").collect()] == [("c1", "red")]
    strays = upsert.without_parent(landed, spark.table(f"{database}.posts")).collect()
    assert [r.comment_id for r in strays] == ["c2"]


def test_csv_round_trip(spark):
    df = spark.createDataFrame([("1", 'two\nlines "quoted", comma'), ("2", "back\\slash")], "id string, body string")
    path = scratch_path(spark, "csv")
    tables.export_csv(df, path)
    assert sorted(tables.import_csv(spark, path, df.schema).collect()) == sorted(df.collect())


def test_a_key_given_twice_is_stored_once_and_nothing_staged_stays(spark, database):
    import os

    name = f"{database}.posts"
    rows = posts(spark, [("a", "second", 2, "s"), ("a", "first", 1, "s"), ("b", "b", 1, "s"), ("b", "b", 1, "s")])
    shared = os.path.join(session.shared_dir(spark).removeprefix("file:"), "hearsay")
    before = set(os.listdir(shared))
    assert upsert.insert_or_ignore(rows, name, "post_id", ["score"]) == upsert.Inserted(2, 2)
    assert {(r.post_id, r.title) for r in spark.table(name).collect()} == {("a", "first"), ("b", "b")}
    assert set(os.listdir(shared)) == before
    with pytest.raises(ZeroDivisionError), session.staged(rows, "broken"):
        raise ZeroDivisionError
    assert set(os.listdir(shared)) == before


def test_replace_keeps_the_buckets(spark, database):
    name, folder = f"{database}.posts", scratch_path(spark, "versions")
    tables.append(posts(spark, [(str(i), "t", i, "s") for i in range(50)]), name)
    tables.replace(spark.table(name).filter("score < 20"), name, folder)
    assert tables.bucket_count(spark, name) == 4 and spark.table(name).count() == 20
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = posts(spark, [("1", "t", 1, "s"), ("99", "t", 1, "s")]).join(tables.keys(spark, name, "post_id"), "post_id", "left_anti")
        assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert [r.post_id for r in fresh.collect()] == ["99"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert upsert.insert_or_ignore(posts(spark, [("1", "x", 1, "s"), ("99", "x", 1, "s")]), name, "post_id") == upsert.Inserted(2, 1)
    tables.replace(spark.range(3).toDF("x"), name, folder)
    assert spark.table(name).columns == ["x"]


def test_tables_without_buckets_and_bucket_numbers(spark):
    name = f"t{uuid.uuid4().hex}"
    tables.create_tables(spark, name, scratch_path(spark, name))
    rows = posts(spark, [("a", "t", 1, "s")])
    assert [upsert.insert_or_ignore(rows, f"{name}.posts", "post_id").added for _ in range(2)] == [1, 0]
    assert tables.bucket_count(spark, f"{name}.posts") is None
    assert (tables.buckets_for(1), tables.buckets_for(100 << 40)) == (1, 204800)


def test_numbered_is_a_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    assert [(r.x, r.n) for r in skew.numbered(df, [F.desc("x")], "n").orderBy("n").collect()] == [(999 - i, i) for i in range(1000)]
    assert skew.numbered(df.limit(0), [F.col("x")], "n").count() == 0


def test_no_text_passes_the_ranking_of_a_listing(spark, tmp_path):
    rows = [(str(i), 1.0, "t" * 50, "b" * 50, "a", 1, 1, "/p", i % 40, "s", "top", "year") for i in range(200)] + [(None, 1.0, None, None, None, 1, 1, "/p", 0, "s", "top", "year")]
    path = str(tmp_path / "landed")
    spark.createDataFrame(rows, schemas.LISTING).write.parquet(path)
    picked = landing.listing(spark.read.parquet(path), "s", "top", "year", 30)
    assert picked.count() == 30
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "body" not in below.split("Relation")[0] and "title" not in below.split("Relation")[0]


def test_top_n_in_steps(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_GROUPS", 2)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    try:
        df = spark.range(0, 5000, 1, 13).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5000).alias("x"))
        for n in (2, 50):
            got = sorted((r.g, r.rank_in_group, r.x) for r in skew.top_n_per_group(df, ["g"], [F.desc("x")], n).collect())
            every = {g: sorted((r.x for r in df.filter(F.col("g") == g).collect()), reverse=True)[:n] for g in range(3)}
            assert got == [(g, i + 1, x) for g in range(3) for i, x in enumerate(every[g])]
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_shuffle_partitions_follow_the_input():
    assert session.shuffle_partitions_for(0) == 200 and session.shuffle_partitions_for(100 << 40) == 819200
