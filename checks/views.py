"""Posts, comments, listings, probabilities and word scores derived from the shared tables.

Each view is one SQL text that both engines run, or a DataFrame with the SQL that equals it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions.text import split_words
from hearsay.sources.tables import scan_files
from hearsay.plans.sentiment import core_scorer, score_comments, score_posts

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


# The test files hold one row group each, which is one task. The benchmark deals the texts' rows over the
# cores, as the files of a table of any size would be; nothing else does.
DEAL_ROWS = False


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # dates are compared as text, so a session of the caller's must read them in UTC too
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = scan_files(spark, f"{sf}/{name}.parquet", T.StructType.fromDDL(TABLES[name]))
    dealt = DEAL_ROWS and name in ("documents", "conversations")
    return rows.repartition(spark.sparkContext.defaultParallelism) if dealt else rows


POSTS_SQL = """
select cast(doc_id as string) as post_id,
  1388534400 + ((doc_id*7919) % 4018)*86400 + ((doc_id*613) % 86400) as created_utc,
  case when doc_id % 17 = 0 then 'None' else concat('user', cast(doc_id % 97 as string)) end as author,
  split_part(text, chr(10), 1) as title,
  case when n_chars % 7 = 0 then ''
       when n_chars % 5 = 0 then concat(text, ' https://i.redd.it/abc.png?width=640&amp;format=png tail')
       when n_chars % 5 = 1 then concat('> quoted line', chr(10), text)
       when n_chars % 5 = 2 then concat(text, ' see u/some-one and @Other &amp; https://example.org/x?y=1')
       else text end as body,
  case when doc_id % 23 = 0 then null else (doc_id*31) % 203 - 3 end as score,
  doc_id % 12 as num_comments,
  concat('https://reddit.com/r/', source, '/comments/', cast(doc_id as string)) as permalink,
  source as subreddit,
  case doc_id % 3 when 0 then 'top' when 1 then 'hot' else 'new' end as mode
from {documents}"""

COMMENTS_SQL = """
select concat(cast(conv_id as string), '_', cast(turn as string)) as comment_id,
  cast(conv_id as string) as post_id,
  1388534400 + ((conv_id*7919) % 4018)*86400 + (turn+1)*3600 as created_utc,
  role as author, text as body,
  (conv_id*13 + turn*7) % 41 - 5 as score
from {conversations}"""

# comments of which some point at posts that do not exist
STRAY_COMMENTS_SQL = """
select concat(cast(conv_id as string), '_', cast(turn as string)) as comment_id,
  cast(case when turn = 3 then conv_id + 1000000 else conv_id end as string) as post_id,
  1388534400 + ((conv_id*7919) % 4018)*86400 + (turn+1)*3600 as created_utc,
  role as author, text as body,
  (conv_id*13 + turn*7) % 41 - 5 as score
from {conversations}"""

# three listings of all documents, in the order each mode would show them
LISTING_SQL = """
select cast(doc_id as string) as id, cast(1388534400 + ((doc_id*7919) % 4018)*86400 as double) as created_utc,
  split_part(text, chr(10), 1) as title, case when n_chars % 7 = 0 then null else text end as body,
  case when doc_id % 17 = 0 then null else concat('user', cast(doc_id % 97 as string)) end as author,
  (doc_id*31) % 203 - 3 as score, doc_id % 12 as num_comments,
  concat('/r/', source, '/comments/', cast(doc_id as string)) as permalink,
  case mode when 'top' then 203 - (doc_id*31) % 203 when 'hot' then 12 - doc_id % 12 else 4018 - (doc_id*7919) % 4018 end as rank,
  source as subreddit, mode, case mode when 'top' then 'year' else 'none' end as time_filter
from (select *, {modes} as mode from {documents}) x"""

PROBS_SQL = """
select post_id, created_utc, subreddit, score, title, body, neg_prob, neu_prob, pos_prob, sarcasm_prob,
  neg_prob - pos_prob as neg_raw,
  (1e0 - sarcasm_prob) * (neg_prob - pos_prob) + sarcasm_prob * (35e-2 * (neg_prob - pos_prob) + 1e-1) as neg_effective
from (select *, exp(a) / (exp(a) + exp(b) + exp(g)) as neg_prob, exp(b) / (exp(a) + exp(b) + exp(g)) as neu_prob,
        exp(g) / (exp(a) + exp(b) + exp(g)) as pos_prob
      from (select p.*, ((cast(post_id as bigint)*37) % 61) / 20e0 - 15e-1 as a,
              ((cast(post_id as bigint)*17) % 41) / 20e0 - 1e0 as b,
              ((cast(post_id as bigint)*53) % 71) / 20e0 - 175e-2 as g,
              ((cast(post_id as bigint)*29) % 101) / 100e0 as sarcasm_prob
            from posts p) l) q"""

# White space and word characters, spelled out for an engine whose classes are ASCII.
SP = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NSP = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
W = r"[\p{L}\p{N}_]"


def duck(sql: str) -> str:
    sql = sql.replace("{modes}", "unnest(['top', 'hot', 'new'])")
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def words_sql(text: str) -> str:
    """List of lower-case alphanumeric words of a text."""
    stripped = rf"regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9\t-\r\x1c-\x20\x85\p{{Z}}]', '', 'g')"
    return f"list_filter(regexp_split_to_array({stripped}, '{SP}+'), lambda w: w <> '')"


VALENCE_SQL = "((ascii(w)*7 + length(w)*13) % 9 - 4)"


def compound_sql(text: str) -> str:
    total = f"coalesce(list_sum(list_transform({words_sql(text)}, lambda w: {VALENCE_SQL})), 0)"
    return f"round({total} / sqrt({total} * {total} + 15e0), 4)"


def label_sql(score: str) -> str:
    return f"case when {score} > 5e-2 then 'positive' when {score} < -5e-2 then 'negative' else 'neutral' end"


POSTS = f"posts as ({duck(POSTS_SQL)})"
COMMENTS = f"comments as ({duck(COMMENTS_SQL)})"
STRAY_COMMENTS = f"stray as ({duck(STRAY_COMMENTS_SQL)})"
LISTING = f"landed as ({duck(LISTING_SQL)})"
PROBS = f"{POSTS}, probs as ({PROBS_SQL})"
SCORED_POSTS = (
    f"{POSTS}, scored as (select *, (sentiment_title + sentiment_body) / 2e0 as sentiment_post, "
    "coalesce(score, 0) as score_weighted, "
    "date_trunc('month', make_timestamp(created_utc*1000000)) as month, "
    "date_trunc('year', make_timestamp(created_utc*1000000)) as year from "
    f"(select *, {compound_sql('body')} as sentiment_body, {compound_sql('title')} as sentiment_title from posts) s)"
)
SCORED_COMMENTS = (
    f"{COMMENTS}, scored_comments as (select *, {compound_sql('body')} as sentiment, coalesce(score, 0) as score_weighted, "
    "date_trunc('month', make_timestamp(created_utc*1000000)) as month, "
    "date_trunc('year', make_timestamp(created_utc*1000000)) as year from comments)"
)


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(POSTS_SQL, documents=table(spark, sf, "documents"))


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(COMMENTS_SQL, conversations=table(spark, sf, "conversations"))


def stray_comments(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(STRAY_COMMENTS_SQL, conversations=table(spark, sf, "conversations"))


def landed(spark: SparkSession, sf: str) -> DataFrame:
    sql = LISTING_SQL.replace("{modes}", "explode(array('top', 'hot', 'new'))")
    return spark.sql(sql, documents=table(spark, sf, "documents"))


def probs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(PROBS_SQL.replace("from posts p", "from {posts} p"), posts=posts(spark, sf))


def formula_valence(w: Column) -> Column:
    """A valence for any word, so that invented prose scores too."""
    return ((F.ascii(w) * 7 + F.length(w) * 13) % 9 - 4).cast("double")


def plain_words(text: Column) -> Column:
    return split_words(F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9\s\x1c-\x1f]", ""))


FORMULA_SCORER = core_scorer(formula_valence, plain_words)


def scored_posts(spark: SparkSession, sf: str) -> DataFrame:
    return score_posts(posts(spark, sf), FORMULA_SCORER)


def scored_comments(spark: SparkSession, sf: str) -> DataFrame:
    return score_comments(comments(spark, sf), FORMULA_SCORER)


def stamp() -> Column:
    return F.timestamp_seconds("created_utc")


def r(c: Column | str, name: str, digits: int = 9) -> Column:
    """A double as compared: rounded, never negative zero."""
    value = F.col(c) if isinstance(c, str) else c
    return (F.round(value, digits) + F.lit(0.0)).alias(name)


def day(c: Column | str, name: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(name)
