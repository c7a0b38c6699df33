"""Sources, normalisation, joins between posts and comments, dedup, inserts and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from hearsay import schemas
from hearsay.operators import normalize, rollups, threads, upsert
from hearsay.plans import ingest
from hearsay.session import cut_lineage, scratch_path
from hearsay.sources import landing, tables
from hearsay.streaming import inserts

SUBS = [f"src{i}" for i in range(20)]
TIME_FILTERS = ["year"]
ISO = "strftime(make_timestamp(cast({c} as bigint)*1000000), '%Y-%m-%dT%H:%M:%SZ')"


def _database(spark: SparkSession) -> tuple[str, str]:
    """A database of its own in the shared folder, with the two keyed tables."""
    name = f"hearsay_{uuid.uuid4().hex}"
    location = scratch_path(spark, name)
    tables.create_tables(spark, name, location, buckets=8)
    return name, location


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Keys taken as stored already: the documents someone labelled."""
    return v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"))


STORED = "stored as (select cast(doc_id as varchar) as post_id from labels)"

_POST_COLUMNS = "post_id, created_utc, author, title, body, score, num_comments, permalink, subreddit, mode"


def _picked(limit: int) -> str:
    """The first rows of every listing."""
    return (
        "picked as (select * from landed qualify "
        f"row_number() over (partition by subreddit, mode order by rank, id) <= {limit})"
    )


@check("s1_scan_posts", f"with {v.POSTS} select {_POST_COLUMNS} from posts")
def s1_posts(spark, sf):
    return v.posts(spark, sf)


@check("s1_scan_comments", f"with {v.COMMENTS} select * from comments")
def s1_comments(spark, sf):
    return v.comments(spark, sf)


@check("s2_key_scan", f"with {v.POSTS} select post_id from posts")
def s2(spark, sf):
    database, _ = _database(spark)
    tables.append(normalize.normalise_posts(v.posts(spark, sf)), f"{database}.posts")
    return tables.keys(spark, f"{database}.posts", "post_id")


@check(
    "s4_listing",
    f"with {v.LISTING}, {_picked(25)} select id, subreddit, mode, rank from picked",
)
def s4(spark, sf):
    picked = landing.listing(v.landed(spark, sf), SUBS, ["top", "hot", "new"], "year", 25)
    return picked.select("id", "subreddit", "mode", F.col("rank").cast("bigint").alias("rank"))


_SHAPED = (
    "select id, created_utc, strftime(make_timestamp(cast(created_utc as bigint)*1000000), '%Y-%m-%d %H:%M:%S') as created_date, "
    "coalesce(author, 'None') as author, coalesce(title, '') as title, coalesce(body, '') as body, score, num_comments, "
    "'https://reddit.com' || permalink as permalink, subreddit, mode, rank from landed"
)


@check("s5_shape_listing", f"with {v.LISTING} {_SHAPED}")
def s5(spark, sf):
    shaped = landing.shape_listing(v.landed(spark, sf)).drop("time_filter")
    return shaped.withColumn("rank", F.col("rank").cast("bigint")).withColumn(
        "created_date", F.date_format("created_date", "yyyy-MM-dd HH:mm:ss")
    )


@check(
    "s4_listing_files",
    f"with {v.LISTING}, {_picked(500)} select id, subreddit, mode, rank from picked where subreddit in ('src3', 'src7') and mode <> 'new'",
)
def s4_files(spark, sf):
    path = scratch_path(spark, "listing")
    landed = v.landed(spark, sf).select([F.col(f.name).cast(f.dataType) for f in schemas.LISTING])
    landed.write.partitionBy("subreddit", "mode", "time_filter").parquet(path)
    picked = landing.listing(landing.read_listing(spark, path), ["src3", "src7"], ["top", "hot"], "year")
    return picked.select("id", "subreddit", "mode", "rank")


@check(
    "s6_comments_for_posts",
    f"with {v.POSTS}, {v.COMMENTS} select c.* from comments c where post_id in (select post_id from posts where score >= 100)",
)
def s6(spark, sf):
    wanted = v.posts(spark, sf).filter(F.col("score") >= 100)
    return landing.comments_for_posts(v.comments(spark, sf), wanted)


@check(
    "s6_flatten_threads",
    f"with {v.COMMENTS}, c as (select post_id, comment_id, cast(created_utc as double) as created_utc, author, body, score, "
    "'https://reddit.com/r/x/' || post_id as parent_permalink from comments) select * from c "
    "union all select post_id, comment_id || '_r', created_utc + 60, 'None', 're: ' || body, score + 1, parent_permalink from c "
    "union all select post_id, comment_id || '_rr', created_utc + 120, author, '', null, parent_permalink from c",
)
def s6_threads(spark, sf):
    leaf = "struct<kind:string,id:string,created_utc:double,author:string,body:string,score:bigint"

    def reply(kind, suffix, delay, author, body, score, *replies):
        fields = [
            F.lit(kind).alias("kind"), F.concat("comment_id", F.lit(suffix)).alias("id"),
            (F.col("created_utc") + delay).cast("double").alias("created_utc"),
            author.cast("string").alias("author"), body.cast("string").alias("body"), score.cast("bigint").alias("score"),
        ]
        return F.struct(*fields, *[x.alias("replies") for x in replies])

    none, body = F.lit(None), F.col("body")
    third = F.array(reply("t1", "_rr", 120, F.col("author"), none, none))
    stub = reply("more", "_more", 0, none, none, none, none.cast(f"array<{leaf}>>"))
    second = F.array(stub, reply("t1", "_r", 60, none, F.concat(F.lit("re: "), body), F.col("score") + 1, third))
    first = F.array(reply("t1", "", 0, F.col("author"), body, F.col("score"), second))
    record = F.struct("post_id", F.concat(F.lit("/r/x/"), F.col("post_id")).alias("permalink"), first.alias("comments"))
    path = scratch_path(spark, "threads")
    v.comments(spark, sf).select(F.to_json(record).alias("value")).write.text(path)
    return landing.flatten_threads(landing.read_threads(spark, path))


@check(
    "s8_replace_table",
    f"with {v.POSTS} select post_id, title || '!' as title, score from posts",
)
def s8(spark, sf):
    database, location = _database(spark)
    name = f"{database}.kept"
    tables.replace(v.posts(spark, sf).select("post_id", "title", "score"), name, location)
    tables.replace(spark.table(name).withColumn("title", F.concat("title", F.lit("!"))), name, location)
    return tables.scan(spark, name)


@check(
    "s9_append",
    f"with {v.POSTS}, {v.COMMENTS} select post_id as id, body from posts union all select comment_id, body from comments",
)
def s9(spark, sf):
    database, _ = _database(spark)
    name = f"{database}.staging"
    tables.append(v.posts(spark, sf).select(F.col("post_id").alias("id"), "body"), name)
    tables.append(v.comments(spark, sf).select("body", F.col("comment_id").alias("id")), name)
    return tables.scan(spark, name)


@check("s12_csv_export", f"with {v.POSTS} select post_id, body, score from posts")
def s12(spark, sf):
    path = scratch_path(spark, "csv")
    out = v.posts(spark, sf).select("post_id", "body", F.col("score").cast("bigint").alias("score"))
    tables.export_csv(out, path)
    return tables.import_csv(spark, path, out.schema).withColumn("body", F.coalesce("body", F.lit("")))


# posts, and the turns of conversations as replies to each other: a third of them below post 0, some below posts that are not there, some in circles
_REPLIES = """
select concat('d', cast(doc_id as string)) as id, cast(null as string) as parent_id from {documents} union all
select concat(cast(conv_id as string), '_', cast(turn as string)) as id,
  case when turn = 0 and conv_id % 11 = 5 then concat(cast(conv_id as string), '_1')
       when turn = 0 and conv_id % 13 = 4 then concat('gone', cast(conv_id as string))
       when turn = 0 and conv_id % 3 = 0 then 'd0'
       when turn = 0 then concat('d', cast(conv_id as string))
       when turn % 4 = 3 then concat(cast(conv_id as string), '_', cast(turn - 2 as string))
       else concat(cast(conv_id as string), '_', cast(turn - 1 as string)) end as parent_id
from {conversations}"""
_THREADS = (
    f"replies as ({v.duck(_REPLIES)}), top as (select id, id as root, 0::bigint as depth, parent_id is not null as lost, [id] as path from replies "
    "where parent_id is null or parent_id not in (select id from replies)), "
    "walk as (select * from top union all select r.id, w.root, w.depth + 1, w.lost, list_append(w.path, r.id) from walk w join replies r on r.parent_id = w.id), "
    "placed as (select r.id, root, depth, case when lost is null then 'cycle' when lost then 'orphan' else 'ok' end as status, path "
    "from replies r left join walk using (id))"
)


def _placed(spark, sf, **options):
    replies = spark.sql(_REPLIES, documents=v.table(spark, sf, "documents"), conversations=v.table(spark, sf, "conversations"))
    return threads.threads(replies, **options)


@check("s6_threads_of_replies", f"with recursive {_THREADS} select id, root, depth, status, array_to_string(path, '/') as path from placed")
def s6_replies(spark, sf):
    return _placed(spark, sf, with_path=True).withColumn("path", F.array_join("path", "/"))


@check(
    "s6_thread_sizes",
    f"with recursive {_THREADS}, levels as (select root, depth, count(*) as n from placed where root is not null group by 1, 2) "
    "select root, cast(sum(n) as bigint) as n, max(depth) as depth, max(n) as widest from levels group by 1",
)
def s6_sizes(spark, sf):
    return threads.thread_sizes(_placed(spark, sf))


_NORMAL = (
    "select id as post_id, cast(created_utc as bigint) as created_utc, {iso} as date, coalesce(author, 'None') as author, "
    "coalesce(title, '') as title, coalesce(body, '') as body, score, num_comments, "
    "'https://reddit.com' || permalink as permalink, subreddit, mode from landed"
).format(iso=ISO.format(c="created_utc"))


@check("p1_normalise_posts", f"with {v.LISTING} {_NORMAL}")
def p1(spark, sf):
    return normalize.normalise_posts(landing.shape_listing(v.landed(spark, sf)))


def _comments_sql(source: str) -> str:
    return (
        f"select c.post_id, comment_id, p.subreddit, c.created_utc, {ISO.format(c='c.created_utc')} as date, c.author, c.body, "
        f"c.score, cast(null as varchar) as parent_permalink from {source} c left join posts p on p.post_id = c.post_id"
    )


def _normal_comments(max_broadcast_rows: int):
    def query(spark, sf):
        return normalize.normalise_comments(
            v.stray_comments(spark, sf), v.posts(spark, sf), spread_by=["comment_id"], max_broadcast_rows=max_broadcast_rows
        )

    return query


_P2 = f"with {v.POSTS}, {v.STRAY_COMMENTS} {_comments_sql('stray')}"
check("p2_normalise_comments", _P2)(_normal_comments(100_000))
check("j6_subreddit_salted", _P2)(_normal_comments(0))


@check("p3_rename_present", f"with {v.LISTING} select id as post_id, title, mode from landed")
def p3(spark, sf):
    return normalize.rename_present(v.landed(spark, sf).select("id", "title", "mode"))


@check("p4_derive_date", f"with {v.COMMENTS} select comment_id, {ISO.format(c='created_utc')} as date from comments")
def p4(spark, sf):
    return normalize.derive_date(v.comments(spark, sf)).select("comment_id", "date")


@check(
    "p5_conform",
    f"with {v.COMMENTS} select post_id, comment_id, cast(null as varchar) as subreddit, created_utc, cast(null as varchar) as date, "
    "author, body, score, cast(null as varchar) as parent_permalink from comments",
)
def p5(spark, sf):
    return normalize.conform(v.comments(spark, sf).withColumn("extra", F.lit(1)), schemas.COMMENTS)


@check(
    "p6_coerce_types",
    f"with {v.POSTS} select post_id, score, cast(null as bigint) as num_comments, cast(created_utc as bigint) as created_utc from posts",
)
def p6(spark, sf):
    raw = v.posts(spark, sf).select(
        "post_id", F.concat("score", F.lit(".0")).alias("score"), F.concat("num_comments", F.lit("x")).alias("num_comments"),
        F.col("created_utc").cast("double").alias("created_utc"),
    )
    return normalize.conform(raw, schemas.POSTS).select("post_id", "score", "num_comments", "created_utc")


@check("p7_drop_missing", f"with {v.POSTS} select post_id, score from posts where score is not null")
def p7(spark, sf):
    return normalize.drop_missing(v.posts(spark, sf).select("post_id", "score"), "score")


@check("f1_equality", f"with {v.POSTS} select post_id, subreddit from posts where subreddit = 'src7'")
def f1(spark, sf):
    return v.posts(spark, sf).filter(F.col("subreddit") == "src7").select("post_id", "subreddit")


def _not_stored(max_broadcast_rows: int):
    def query(spark, sf):
        kept = upsert.not_stored(
            v.landed(spark, sf), _labelled(spark, sf), "id", "post_id", max_broadcast_rows=max_broadcast_rows
        )
        return kept.select("id", "mode")

    return query


_J5 = f"with {v.LISTING}, {STORED} select id, mode from landed where id not in (select post_id from stored)"
check("j5_not_stored", _J5)(_not_stored(100_000))
check("f5_not_stored_salted", _J5)(_not_stored(0))


@check(
    "j1_comment_candidates",
    f"with {v.POSTS}, {v.COMMENTS}, cc as (select post_id, count(*) as c from comments group by post_id) "
    "select p.post_id, score from posts p left join cc on cc.post_id = p.post_id where coalesce(cc.c, 0) = 0 "
    "order by score desc nulls last, p.post_id limit 5000",
)
def j1(spark, sf):
    return upsert.comment_candidates(v.posts(spark, sf), v.comments(spark, sf))


_J2 = (
    f"with {v.POSTS}, {v.COMMENTS} select p.post_id, p.subreddit, p.mode, p.score, p.num_comments, "
    "count(c.comment_id) as stored_comments from posts p left join comments c on c.post_id = p.post_id group by all"
)


@check("j2_stored_comment_counts", _J2)
def j2(spark, sf):
    posts = v.posts(spark, sf).select("post_id", "subreddit", "mode", "score", "num_comments")
    return upsert.stored_comment_counts(posts, v.comments(spark, sf))


@check("t2_most_commented", _J2 + " order by stored_comments desc, score desc nulls last, p.post_id limit 5")
def t2(spark, sf):
    order = [F.desc("stored_comments"), F.desc_nulls_last("score"), F.col("post_id")]
    return rollups.top_rows(j2(spark, sf), order, 5)


def _parents(kept: bool, max_broadcast_rows: int):
    def query(spark, sf):
        side = upsert.with_parent if kept else upsert.without_parent
        rows = side(v.stray_comments(spark, sf), v.posts(spark, sf), max_broadcast_rows=max_broadcast_rows)
        return rows.select("comment_id", "post_id")

    return query


def _parents_sql(kept: bool) -> str:
    return (
        f"with {v.POSTS}, {v.STRAY_COMMENTS} select comment_id, post_id from stray "
        f"where post_id {'in' if kept else 'not in'} (select post_id from posts)"
    )


check("j7_with_parent", _parents_sql(True))(_parents(True, 100_000))
check("j7_with_parent_salted", _parents_sql(True))(_parents(True, 0))
check("j7_violations", _parents_sql(False))(_parents(False, 100_000))


@check(
    "j8_cascade_delete",
    f"with {v.COMMENTS}, {STORED} select comment_id, post_id from comments where post_id not in (select post_id from stored)",
)
def j8(spark, sf):
    return upsert.cascade_delete(v.comments(spark, sf), _labelled(spark, sf)).select("comment_id", "post_id")


@check(
    "a1_table_counts",
    f"with {v.POSTS}, {v.COMMENTS} select 'posts' as name, count(*) as n from posts union all select 'comments', count(*) from comments",
)
def a1(spark, sf):
    return upsert.table_counts(posts=v.posts(spark, sf), comments=v.comments(spark, sf))


@check(
    "a2_key_check",
    f"with {v.LISTING} select count(*) as n_rows, count(distinct id) as n_keys, count(*) = count(distinct id) as is_unique from landed",
)
def a2(spark, sf):
    return upsert.key_check(v.landed(spark, sf), "id")


@check("a3_comments_per_post", f"with {v.COMMENTS} select post_id, count(*) as n from comments group by post_id")
def a3(spark, sf):
    return v.comments(spark, sf).groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))


@check(
    "u1_safe_union",
    f"with {v.POSTS}, {v.COMMENTS} select post_id, title, cast(null as varchar) as comment_id, body from posts "
    "union all select post_id, null, comment_id, body from comments",
)
def u1(spark, sf):
    left = v.posts(spark, sf).select("post_id", "title", "body")
    right = v.comments(spark, sf).select("comment_id", "post_id", "body")
    return upsert.safe_union([None, left, right])


_PLACE = "case mode when 'top' then 1 when 'hot' then 2 else 3 end"
_FIRST = (
    f"firsts as (select * from (select *, row_number() over (partition by id order by {_PLACE}, rank) as rn from landed) x where rn = 1)"
)


@check(
    "u2_first_per_key",
    f"with {v.LISTING} select id, mode, rank from (select *, row_number() over (partition by id order by {_PLACE}, rank) as rn from landed) x where rn = 1",
)
def u2(spark, sf):
    ranked = v.landed(spark, sf).withColumn("place", F.array_position(F.lit(["top", "hot", "new"]), F.col("mode")))
    first = upsert.dedup(ranked.select("id", "mode", "rank", "place"), "id", ["place", "rank"])
    return first.select("id", "mode", F.col("rank").cast("bigint").alias("rank"))


def _swept(spark, sf, stored):
    return ingest.sweep(v.landed(spark, sf), stored, SUBS, ["top", "hot", "new"], TIME_FILTERS)


@check(
    "u3_sweep",
    f"with {v.LISTING}, {STORED}, {_picked(1000)} select id, subreddit, mode from picked where id not in (select post_id from stored)",
)
def u3(spark, sf):
    return _swept(spark, sf, _labelled(spark, sf)).select("id", "subreddit", "mode")


@check(
    "u4_insert_posts",
    f"with {v.LISTING}, {STORED}, {_FIRST}, fresh as (select * from firsts where id not in (select post_id from stored)) "
    "select cast(1 as int) as run, count(*) as attempted, count(*) as added from fresh union all select 2, count(*), 0 from fresh",
)
def u4(spark, sf):
    """All landed rows of all sources, whatever their rank."""
    database, _ = _database(spark)
    ranked = landing.shape_listing(v.landed(spark, sf)).withColumn("sweep_rank", F.struct(
        F.array_position(F.lit(["top", "hot", "new"]), F.col("mode")).alias("listing"), F.col("rank").alias("rank")
    ))
    swept = upsert.not_stored(ranked, _labelled(spark, sf), "id", "post_id").drop("rank", "time_filter")
    runs = [ingest.insert_posts(spark, swept, f"{database}.posts") for _ in (1, 2)]
    shown = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("run"), F.lit(x.attempted).cast("bigint").alias("attempted"), F.lit(x.added).cast("bigint").alias("added"))
        for i, x in enumerate(runs)
    ]))
    counts = spark.table(f"{database}.posts").agg(F.count(F.lit(1)).alias("stored"))
    return counts.select(shown.alias("x")).select("x.*")


_ROUND = f"(coalesce(list_position({SUBS}, subreddit), 21) - 1) // 5 * 2 + case mode when 'top' then 0 else 1 end"


@check(
    "u4_top_up",
    f"with {v.LISTING}, places as (select id, {_ROUND} as place from landed where mode <> 'new' group by 1, 2), "
    "firsts as (select id, min(place) as place from places group by 1), ids as (select count(*) * 5 // 8 as target from firsts), "
    "tried as (select place, count(*) as attempted from places group by 1), brought as (select place, count(*) as added from firsts group by 1), "
    "sums as (select place, attempted, coalesce(added, 0) as added, sum(coalesce(added, 0)) over (order by place) as total from tried left join brought using (place)) "
    "select cast(place + 1 as int) as round, attempted, added, cast(total as bigint) as total, cast(greatest(target - total, 0) as bigint) as wanted "
    "from sums, ids where total - added < target",
)
def u4_top_up(spark, sf):
    """Five sources' listings a round, the top ones and then the hot ones, until five eighths of all landed posts are stored."""
    database, _ = _database(spark)
    landed = v.landed(spark, sf)
    shaped = landing.shape_listing(landed).withColumn("sweep_rank", F.struct("rank")).drop("rank", "time_filter")
    target = landed.select("id").distinct().count() * 5 // 8
    named = [F.col("subreddit").isin(SUBS[i : i + 5]) for i in range(0, len(SUBS), 5)]
    groups = [*named, ~F.coalesce(F.col("subreddit").isin(SUBS), F.lit(False))]
    sweeps = (shaped.filter(group & (F.col("mode") == mode)) for group in groups for mode in ("top", "hot"))
    rounds = ingest.top_up(spark, sweeps, f"{database}.posts", target)
    rows = [(i + 1, x.attempted, x.added, x.total, x.wanted) for i, x in enumerate(rounds)]
    return spark.createDataFrame(rows, "round int, attempted long, added long, total long, wanted long")


@check(
    "u5_insert_or_ignore",
    f"with {v.POSTS}, {STORED} select post_id, title, case when post_id in (select post_id from stored) then -1 else score end as score from posts",
)
def u5(spark, sf):
    database, _ = _database(spark)
    name, posts = f"{database}.posts", normalize.normalise_posts(v.posts(spark, sf))
    old = posts.join(_labelled(spark, sf), "post_id", "left_semi").withColumn("score", F.lit(-1).cast("bigint"))
    upsert.insert_or_ignore(old, name, "post_id")
    upsert.insert_or_ignore(posts, name, "post_id")
    return spark.table(name).select("post_id", "title", "score")


@check(
    "u6_upsert_comments",
    f"with {v.POSTS}, {v.STRAY_COMMENTS}, n as ({_comments_sql('stray')}) select * from n where post_id in (select post_id from posts)",
)
def u6(spark, sf):
    database, _ = _database(spark)
    tables.append(normalize.normalise_posts(v.posts(spark, sf)), f"{database}.posts")
    stray = v.stray_comments(spark, sf)
    for _ in (1, 2):
        ingest.upsert_comments(spark, stray, stray, f"{database}.posts", f"{database}.comments")
    return spark.table(f"{database}.comments")


@check(
    "s13_insert_and_list",
    f"with {v.POSTS}, {v.COMMENTS} select 'posts' as name, count(*) as n from posts union all select 'comments', count(*) from comments",
)
def s13(spark, sf):
    database, _ = _database(spark)
    tables.append(normalize.normalise_posts(v.posts(spark, sf)), f"{database}.posts")
    tables.append(normalize.normalise_comments(v.comments(spark, sf), v.posts(spark, sf)), f"{database}.comments")
    counts = upsert.table_counts(**{n: spark.table(f"{database}.{n}").select("post_id") for n in ("posts", "comments")})
    return tables.list_tables(spark, database).join(counts, "name")


@check(
    "a16_count_delta",
    f"with {v.POSTS}, {v.COMMENTS}, {STORED}, b as (select 'posts' as name, count(*) as n from posts where post_id in (select post_id from stored) "
    "union all select 'comments', count(*) from comments where post_id in (select post_id from stored)), "
    "a as (select 'posts' as name, count(*) as n from posts union all select 'comments', count(*) from comments) "
    "select name, 'run' as label, a.n - b.n as added, a.n as total from a join b using (name)",
)
def a16(spark, sf):
    posts, comments, stored = v.posts(spark, sf), v.comments(spark, sf), _labelled(spark, sf)
    before = upsert.table_counts(
        posts=posts.join(stored, "post_id", "left_semi"), comments=comments.join(stored, "post_id", "left_semi")
    )
    return upsert.count_delta(before, upsert.table_counts(posts=posts, comments=comments), "run")


@check("t1_best_scores", f"with {v.POSTS} select post_id, score from posts order by score desc nulls last, post_id limit 20")
def t1(spark, sf):
    return rollups.top_rows(v.posts(spark, sf).select("post_id", "score"), [F.desc_nulls_last("score"), F.col("post_id")], 20)


@check("t6_head", f"with {v.POSTS} select post_id, title from posts order by post_id limit 250")
def t6(spark, sf):
    return rollups.top_rows(v.posts(spark, sf).select("post_id", "title"), [F.col("post_id")], 250)


@check("r1_insert_stream", f"with {v.COMMENTS} select comment_id, post_id, created_utc, body from comments")
def r1(spark, sf):
    database, _ = _database(spark)
    path, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "stream")
    landed = normalize.conform(v.comments(spark, sf), schemas.COMMENTS)
    # every comment lands twice, in two files at least
    landed.unionByName(landed).repartition(4, "body").write.parquet(path)
    stream = inserts.landed_stream(spark, path, schemas.COMMENTS, files_per_batch=2)
    inserts.insert_stream(stream, f"{database}.comments", "comment_id", ["created_utc"], checkpoint).awaitTermination()
    return spark.table(f"{database}.comments").select("comment_id", "post_id", "created_utc", "body")


@check(
    "s7_create_drop_list",
    "select * from (values ('comments', 1, 0), ('posts', 1, 0), ('posts', 2, (select count(*) from documents))) x(name, step, n)",
)
def s7(spark, sf):
    """Create twice, list; fill one table, create again, drop the other twice, list."""
    database, location = _database(spark)
    tables.create_tables(spark, database, location, buckets=8)
    empty = upsert.table_counts(**{r.name: spark.table(f"{database}.{r.name}") for r in tables.list_tables(spark, database).collect()})
    first = tables.list_tables(spark, database).join(cut_lineage(empty), "name").withColumn("step", F.lit(1))
    first = cut_lineage(first)
    tables.append(normalize.normalise_posts(v.posts(spark, sf)), f"{database}.posts")
    tables.create_tables(spark, database, location, buckets=8)
    for _ in (1, 2):
        tables.drop(spark, f"{database}.comments")
    counts = upsert.table_counts(posts=spark.table(f"{database}.posts").select("post_id"))
    second = tables.list_tables(spark, database).join(counts, "name").withColumn("step", F.lit(2))
    return first.unionByName(second).select("name", "step", F.col("n").cast("bigint").alias("n"))


@check("s10_drop_table", "select 'posts' as name")
def s10(spark, sf):
    database, _ = _database(spark)
    tables.append(normalize.normalise_comments(v.comments(spark, sf), v.posts(spark, sf)), f"{database}.comments")
    tables.drop(spark, f"{database}.comments")
    tables.drop(spark, f"{database}.comments")
    return tables.list_tables(spark, database)
