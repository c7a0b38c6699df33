"""Cleaners, tokens and the scalar functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from hearsay.functions import scalars, text
from hearsay.operators import lemmas
from hearsay.operators.normalize import lists_to_text
from hearsay.operators.skew import explode_words
from hearsay.plans.cleaning import clean_comments, clean_posts
from hearsay.session import cut_lineage

NSP, SP, W = v.NSP, v.SP, v.W
STOP = "'the', 'and', 'is', 'in', 'to', 'of'"


def strip_links_sql(c: str) -> str:
    return f"regexp_replace({c}, 'http{NSP}+|www{NSP}+|@{W}+', '', 'g')"


def tokens_sql(c: str, keep: str = "a-z0-9", stop: str = STOP, urls: bool = True) -> str:
    low = f"lower(coalesce({c}, ''))"
    low = strip_links_sql(low) if urls else low
    kept = rf"regexp_replace({low}, '[^{keep}\t-\r\x1c-\x20\x85\p{{Z}}]', '', 'g')"
    listed = f"and w not in ({stop})" if stop else ""
    return f"list_filter(regexp_split_to_array({kept}, '{SP}+'), lambda w: w <> '' {listed})"


def clean_sql(c: str, **options) -> str:
    return f"array_to_string({tokens_sql(c, **options)}, ' ')"


def media_sql(c: str) -> str:
    hosts = r"preview\.redd\.it|i\.redd\.it|v\.redd\.it|redditstatic\.com"
    pattern = rf"(?i)(https?://)?(({hosts})|({NSP}+\.(png|jpe?g|webp|gif|mp4))(\?{NSP}+)?)"
    return f"regexp_replace({c}, '{pattern}', ' ', 'g')"


def params_sql(c: str) -> str:
    names = "|".join(text.MEDIA_PARAMS)
    return rf"regexp_replace({c}, '(?i)(^|[^\p{{L}}\p{{N}}_])({names})={NSP}+', '\1 ', 'g')"


def handles_sql(c: str) -> str:
    return rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])u/[A-Za-z0-9_-]+|@[A-Za-z0-9_]+', '\1@user', 'g')"


def urls_sql(c: str) -> str:
    return rf"regexp_replace({c}, 'https?://{NSP}+|www\.{NSP}+', 'http', 'g')"


def quotes_sql(c: str) -> str:
    return rf"regexp_replace({c}, '(^|\n){SP}{{0,3}}>{SP}[^\n]*', '', 'g')"


def spaces_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


def preprocess_sql(c: str) -> str:
    out = params_sql(media_sql(f"coalesce({c}, '')"))
    return spaces_sql(f"replace({quotes_sql(urls_sql(handles_sql(out)))}, '&amp;', '&')")


def _one(name: str, expression, sql) -> None:
    """One text function over post bodies."""
    def query(spark, sf):
        return v.posts(spark, sf).select("post_id", expression("body").alias("body"))

    check(name, f"with {v.POSTS} select post_id, {sql('body')} as body from posts")(query)


_one("x1_clean_text", text.clean_text, clean_sql)
_one("x1_clean_letters", lambda c: text.clean_text(c, keep_numbers=False, remove_urls=False),
     lambda c: clean_sql(c, keep="a-z", urls=False))
_one("x6_media_urls", text.strip_media_urls, media_sql)
_one("x7_media_params", text.strip_media_params, params_sql)
_one("x8_mask_handles", text.mask_handles, handles_sql)
_one("x9_mask_urls", text.mask_urls, urls_sql)
_one("x10_drop_quotes", text.drop_quotes, quotes_sql)
_one("x11_unescape", text.unescape_ampersand, lambda c: f"replace({c}, '&amp;', '&')")
_one("x12_collapse_spaces", text.collapse_spaces, spaces_sql)
_one("x13_preprocess", text.preprocess, preprocess_sql)

_WORDS = ("que", "der", "la", "with", "for", "on")


@check(
    "x4_stop_words",
    f"with {v.COMMENTS} select comment_id, "
    f"{clean_sql('body', stop=', '.join(repr(w) for w in _WORDS))} as body from comments",
)
def x4(spark, sf):
    return v.comments(spark, sf).select("comment_id", text.clean_text("body", stop_words=_WORDS).alias("body"))


@check(
    "x2_clean_posts",
    f"with {v.POSTS} select post_id, score, num_comments, created_utc, "
    "strftime(make_timestamp(created_utc*1000000), '%Y-%m-%d %H:%M:%S') as date, "
    f"{clean_sql('title')} as title_clean, {clean_sql('body')} as body_clean from posts",
)
def x2(spark, sf):
    cleaned = clean_posts(v.posts(spark, sf))
    return cleaned.select(
        "post_id", "score", "num_comments", "created_utc",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "title_clean", "body_clean",
    )


@check(
    "x3_comment_tokens",
    f"with {v.COMMENTS}, t as (select comment_id, {tokens_sql('body')} as tokens from comments) "
    "select comment_id, len(tokens) as n_tokens, array_to_string(tokens, '|') as tokens from t",
)
def x3(spark, sf):
    cleaned = clean_comments(v.comments(spark, sf))
    return cleaned.select(
        "comment_id", F.size("body_tokens").cast("bigint").alias("n_tokens"),
        F.array_join("body_tokens", "|").alias("tokens"),
    )


# every word that ends in s, with the s dropped
_LEMMAS = f"lemmas as (select distinct w as token, substring(w, 1, length(w) - 1) as lemma from (select unnest({tokens_sql('text')}) as w from documents) where length(w) > 3 and w like '%s')"


_LEMMA_TABLES: dict = {}


def _lemma_table(spark, sf, docs):
    """Made once per session and folder, as a lemma list is there before the texts are read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LEMMA_TABLES:
        words = explode_words(docs, [], "tokens").filter((F.length("token") > 3) & F.col("token").endswith("s"))
        lemma = F.expr("substring(token, 1, length(token) - 1)")
        _LEMMA_TABLES[key] = cut_lineage(words.distinct().withColumn("lemma", lemma))
    return _LEMMA_TABLES[key]


def _lemma_query(max_rows: int):
    def query(spark, sf):
        docs = v.table(spark, sf, "documents").select("doc_id", text.clean_tokens("text").alias("tokens"))
        done = lemmas.lemmatise(docs, "tokens", _lemma_table(spark, sf, docs), max_rows=max_rows)
        return done.select("doc_id", F.array_join("tokens", " ").alias("lemmas"))

    return query


_LEMMA_SQL = (
    f"with {_LEMMAS}, t as (select doc_id, {tokens_sql('text')} as tokens from documents), "
    "e as (select doc_id, unnest(tokens) as w, unnest(range(len(tokens))) as pos from t), "
    "j as (select doc_id, pos, coalesce(lemma, w) as w from e left join lemmas on w = token), "
    "g as (select doc_id, string_agg(w, ' ' order by pos) as lemmas from j group by doc_id) "
    "select t.doc_id, coalesce(g.lemmas, '') as lemmas from t left join g using (doc_id)"
)
check("x5_lemmatise", _LEMMA_SQL)(_lemma_query(lemmas.MAX_DICTIONARY_ROWS))
check("x5_lemmatise_by_join", _LEMMA_SQL)(_lemma_query(0))


_ENDINGS = (
    f"d as (select unnest({tokens_sql('text')}) as token from documents), t as (select distinct token from d where length(token) > 0), "
    "p as (select token, case when token like '%ing' then left(token, length(token) - 3) || 'e' when token like '%ies' then left(token, length(token) - 3) || 'y' "
    "when token like '%s' and length(token) % 2 = 0 then left(token, length(token) - 1) else token end as lemma from t)"
)


@check(
    "x5_ending_counts",
    f"with {_ENDINGS}, e as (select token, lemma, unnest(range(1, least(length(token) - 1, 6) + 1)) as l from p where length(token) > 1), "
    "r as (select right(token, l) as suffix, case when left(token, length(token) - l) = left(lemma, length(token) - l) and length(lemma) >= length(token) - l "
    "then substr(lemma, length(token) - l + 1) end as replacement from e), "
    "c as (select suffix, replacement, count(*) as n from r group by 1, 2), "
    "m as (select suffix, cast(sum(n) as bigint) as m from c group by 1) "
    "select suffix, replacement, n, m from c join m using (suffix) where replacement is not null",
)
def x5_endings(spark, sf):
    """How often each ending of the texts' words becomes which, by lemmas made by a formula."""
    words = v.table(spark, sf, "documents").select(F.explode(text.clean_tokens("text")).alias("token")).distinct()
    size = F.length("token")
    lemma = (
        F.when(F.col("token").endswith("ing"), F.concat(F.left("token", size - 3), F.lit("e")))
        .when(F.col("token").endswith("ies"), F.concat(F.left("token", size - 3), F.lit("y")))
        .when(F.col("token").endswith("s") & (size % 2 == 0), F.left("token", size - 1)).otherwise(F.col("token"))
    )
    return lemmas.ending_counts(words.select("token", lemma.alias("lemma")))


@check(
    "p10_lists_to_text",
    f"with {v.COMMENTS} select comment_id, {clean_sql('body')} as body_tokens from comments",
)
def p10(spark, sf):
    cleaned = clean_comments(v.comments(spark, sf)).select("comment_id", "body_tokens")
    return lists_to_text(cleaned)


@check("p11_full_text", f"with {v.POSTS} select post_id, title || ':' || chr(10) || body as full_post from posts")
def p11(spark, sf):
    return v.posts(spark, sf).select("post_id", text.full_text().alias("full_post"))


_BLOB = "unhex(array_join(reverse(regexp_extract_all(lpad(hex({c}), 16, '0'), '(..)', 1)), ''))"


@check(
    "p8_bytes_to_long",
    f"with {v.POSTS} select post_id, score, created_utc, "
    "cast(case when score < 0 then 18446744073709551616::hugeint + score else score end as varchar) as unsigned_score from posts",
)
def p8(spark, sf):
    blobs = v.posts(spark, sf).select(
        "post_id", F.expr(_BLOB.format(c="cast(score as bigint)")).alias("score"),
        F.expr(_BLOB.format(c="created_utc")).alias("created_utc"),
    )
    return blobs.select(
        "post_id",
        scalars.bytes_to_long("score").alias("score"),
        scalars.bytes_to_long("created_utc").alias("created_utc"),
        scalars.bytes_to_long("score", unsigned=True).cast("string").alias("unsigned_score"),
    )


@check(
    "p9_epoch_to_timestamp",
    f"with {v.COMMENTS} select comment_id, "
    "strftime(make_timestamp(created_utc*1000000), '%Y-%m-%dT%H:%M:%SZ') as iso, "
    "strftime(make_timestamp(created_utc*1000), '%Y-%m-%dT%H:%M:%SZ') as iso_of_ms from comments",
)
def p9(spark, sf):
    return v.comments(spark, sf).select(
        "comment_id",
        scalars.epoch_to_iso("created_utc").alias("iso"),
        F.date_format(scalars.epoch_to_timestamp("created_utc", "ms"), scalars.ISO_UTC).alias("iso_of_ms"),
    )


@check(
    "d1_parse_date",
    "select event_id, strftime(case when event_type = 'click' then null else ts end, '%Y-%m-%d %H:%M:%S') as parsed from events",
)
def d1(spark, sf):
    raw = F.when(F.col("event_type") == "click", "no date").otherwise(F.date_format("ts", scalars.ISO_UTC))
    parsed = scalars.parse_date(raw)
    return v.table(spark, sf, "events").select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@check(
    "d2_period_start",
    f"with {v.POSTS}, t as (select post_id, make_timestamp(created_utc*1000000) as ts from posts) select post_id, "
    "strftime(date_trunc('month', ts), '%Y-%m-%d') as month, strftime(date_trunc('year', ts), '%Y-%m-%d') as year from t",
)
def d2(spark, sf):
    return v.posts(spark, sf).select(
        "post_id", v.day(scalars.month_start(v.stamp()), "month"), v.day(scalars.year_start(v.stamp()), "year")
    )


@check(
    "d3_numeric_epoch",
    f"with {v.POSTS} select post_id, strftime(make_timestamp(created_utc*1000000), '%Y-%m-%d %H:%M:%S') as of_number, "
    "strftime(make_timestamp(created_utc*1000000), '%Y-%m-%d %H:%M:%S') as of_text from posts",
)
def d3(spark, sf):
    shown = lambda c, kind, name: F.date_format(scalars.parse_date(c, kind), "yyyy-MM-dd HH:mm:ss").alias(name)
    return v.posts(spark, sf).select(
        "post_id", shown("created_utc", "bigint", "of_number"),
        shown(scalars.epoch_to_iso("created_utc"), "string", "of_text"),
    )


@check(
    "d4_softmax",
    f"with {v.PROBS} select post_id, round(neg_prob, 9) as neg_prob, round(neu_prob, 9) as neu_prob, round(pos_prob, 9) as pos_prob from probs",
)
def d4(spark, sf):
    key = F.col("post_id").cast("bigint")
    logits = [(key * 37 % 61) / 20.0 - 1.5, (key * 17 % 41) / 20.0 - 1.0, (key * 53 % 71) / 20.0 - 1.75]
    shown = zip(scalars.softmax(*logits), ("neg_prob", "neu_prob", "pos_prob"))
    return v.posts(spark, sf).select("post_id", *[v.r(p, n) for p, n in shown])


@check(
    "d5_coerce_numbers",
    f"with {v.POSTS} select post_id, score as whole, cast(score as double) as number from posts",
)
def d5(spark, sf):
    raw = F.when(F.col("score").isNull(), "abc").otherwise(F.concat(F.lit(" "), F.col("score").cast("string"), F.lit(".0")))
    return v.posts(spark, sf).select("post_id", scalars.to_long(raw).alias("whole"), scalars.to_double(F.trim(raw)).alias("number"))


@check(
    "d6_clip_weights",
    f"with {v.COMMENTS} select comment_id, cast(greatest(score, 0) as double) as clipped, score as filled from comments",
)
def d6(spark, sf):
    return v.comments(spark, sf).select(
        "comment_id", scalars.clip_weight(F.col("score").cast("string")).alias("clipped"),
        scalars.fill_weight("score").alias("filled"),
    )


@check(
    "p15_weights",
    f"with {v.POSTS} select post_id, coalesce(score, 0) as filled, cast(greatest(coalesce(score, 0), 0) as double) as clipped from posts",
)
def p15(spark, sf):
    return v.posts(spark, sf).select(
        "post_id", scalars.fill_weight("score").alias("filled"), scalars.clip_weight("score").alias("clipped")
    )


@check("d7_list_join", f"with {v.POSTS} select post_id, {clean_sql('title')} as title from posts")
def d7(spark, sf):
    return v.posts(spark, sf).select("post_id", F.array_join(text.clean_tokens("title"), " ").alias("title"))
