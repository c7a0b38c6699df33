"""Word-list scores, labels, probabilities and the sarcasm result table."""

from __future__ import annotations

import math

import uuid

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from checks.text import tokens_sql
from hearsay.functions import lexicon as lx
from hearsay.functions import scalars
from hearsay.functions.aggregates import safe_weighted_mean
from hearsay.operators import calibration, counted, normalize, rollups, scoring
from hearsay.operators.skew import explode_words
from hearsay.plans import sarcasm, sentiment
from hearsay.session import cut_lineage, scratch_path

FULL = "title || ':' || chr(10) || body"


def _rd(expr: str, name: str) -> str:
    return f"round({expr}, 9) + 0e0 as {name}"


@check(
    "m9_score_posts",
    f"with {v.SCORED_POSTS} select post_id, {_rd('sentiment_body', 'sentiment_body')}, {_rd('sentiment_title', 'sentiment_title')}, "
    f"{_rd('sentiment_post', 'sentiment_post')}, {v.label_sql('sentiment_body')} as sentiment_body_label, "
    f"{v.label_sql('sentiment_title')} as sentiment_title_label, {v.label_sql('sentiment_post')} as sentiment_post_label, "
    "score_weighted from scored",
)
def m9(spark, sf):
    scored = v.scored_posts(spark, sf)
    return scored.select(
        "post_id", *[v.r(f"sentiment_{p}", f"sentiment_{p}") for p in ("body", "title", "post")],
        *[f"sentiment_{p}_label" for p in ("body", "title", "post")], "score_weighted",
    )


@check(
    "m9_score_comments",
    f"with {v.SCORED_COMMENTS} select comment_id, {_rd('sentiment', 'sentiment')}, {v.label_sql('sentiment')} as label, score_weighted from scored_comments",
)
def m9_comments(spark, sf):
    scored = v.scored_comments(spark, sf)
    return scored.select("comment_id", v.r("sentiment", "sentiment"), F.col("comment_sentiment_label").alias("label"), "score_weighted")


_WORDS = f"words as (select doc_id, unnest({v.words_sql('text')}) as w from documents)"
_LEXICON = f"lexicon as (select distinct w as token, {v.VALENCE_SQL} as valence from words where length(w) > 4)"
_M1 = (
    f"with {_WORDS}, {_LEXICON}, t as (select doc_id, sum(valence) as s from words join lexicon on w = token group by 1) "
    "select d.doc_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15e0), 4) + 0e0 as compound "
    "from documents d left join t on t.doc_id = d.doc_id"
)


def _tokens(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", v.plain_words(F.col("text")).alias("tokens"))


_LISTS: dict = {}


def _lexicon(spark, sf):
    """Valences of all longer words, as a table made from the documents; short words stay free to modify them.

    Made once per session and folder, as a word list is there before the texts are scored.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LISTS:
        words = explode_words(_tokens(spark, sf), [], "tokens").filter(F.length("token") > 4).distinct()
        _LISTS[key] = cut_lineage(words.withColumn("valence", v.formula_valence(F.col("token"))))
    return _LISTS[key]


@check("m1_lexicon_core", _M1)
def m1(spark, sf):
    scorer = sentiment.lexicon_scorer(_lexicon(spark, sf), rules=False)
    docs = v.table(spark, sf, "documents").select("doc_id", F.array_join(v.plain_words(F.col("text")), " ").alias("plain"))
    return scorer(docs, "plain", "compound").select("doc_id", v.r("compound", "compound"))


@check("m1_lexicon_by_join", _M1)
def m1_join(spark, sf):
    scored = sentiment.score_by_join(_tokens(spark, sf), "doc_id", "tokens", _lexicon(spark, sf), "compound")
    return scored.select("doc_id", v.r("compound", "compound"))


@check("m1_lexicon_by_join_salted", _M1)
def m1_join_salted(spark, sf):
    scored = sentiment.score_by_join(
        _tokens(spark, sf), "doc_id", "tokens", _lexicon(spark, sf), "compound", max_broadcast_rows=0
    )
    return scored.select("doc_id", v.r("compound", "compound"))


@check(
    "m2_label_sentiment",
    f"with {v.SCORED_POSTS} select post_id, {v.label_sql('sentiment_body')} as label from scored",
)
def m2(spark, sf):
    return v.scored_posts(spark, sf).select("post_id", scalars.label_sentiment("sentiment_body").alias("label"))


@check(
    "m3_label_score",
    f"with {v.SCORED_POSTS} select post_id, 'mostly ' || {v.label_sql('sentiment_body')} as label from scored".replace(
        "|| case", "|| (case").replace("'neutral' end as label", "'neutral' end) as label"),
)
def m3(spark, sf):
    return v.scored_posts(spark, sf).select("post_id", scalars.label_score("sentiment_body").alias("label"))


@check(
    "m6_effective_negativity",
    f"with {v.PROBS} select post_id, {_rd('neg_raw', 'neg_raw')}, {_rd('neg_effective', 'neg_effective')} from probs",
)
def m6(spark, sf):
    given = v.probs(spark, sf).drop("neg_raw", "neg_effective")
    return scoring.with_negativity(given).select("post_id", v.r("neg_raw", "neg_raw"), v.r("neg_effective", "neg_effective"))


_NAMES = {"neg_prob": "negative_prob", "neu_prob": "neutral_prob", "pos_prob": "positive_prob",
          "sarcasm_prob": "sarcasm_prob", "neg_raw": "negative_raw", "neg_effective": "neg_w_sarcasm"}


def _scores(spark, sf):
    return normalize.rename_scores(v.probs(spark, sf)).withColumn("full_post", F.concat("title", F.lit(":\n"), "body"))


@check(
    "p12_rename_scores",
    f"with {v.PROBS} select post_id, " + ", ".join(_rd(a, b) for a, b in _NAMES.items()) + " from probs",
)
def p12(spark, sf):
    return _scores(spark, sf).select("post_id", *[v.r(c, c) for c in _NAMES.values()])


@check(
    "m10_result_table",
    f"with {v.PROBS} select " + ", ".join(_rd(a, b) for a, b in _NAMES.items())
    + f", {FULL} as full_post, strftime(make_timestamp(created_utc*1000000), '%Y-%m-%d %H:%M:%S') as date, post_id from probs",
)
def m10(spark, sf):
    posts = v.posts(spark, sf).withColumn("date", v.stamp())
    table = sarcasm.result_table(posts, _scores(spark, sf))
    return table.select(
        *[v.r(c, c) for c in _NAMES.values()], "full_post", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "post_id"
    )


_BY_TEXT = (
    f"with {v.PROBS}, f as (select *, {FULL} as full_post from probs), "
    "j as (select l.post_id, l.subreddit, l.created_utc, r.neg_raw, r.neg_effective from f l left join f r "
    "on l.full_post is not distinct from r.full_post) "
)


def _by_text(max_broadcast_rows: int):
    def query(spark, sf):
        posts = v.posts(spark, sf).withColumn("full_post", F.concat("title", F.lit(":\n"), "body"))
        joined = sarcasm.attach_scores(posts, _scores(spark, sf), by="text", max_broadcast_rows=max_broadcast_rows)
        return joined.select("post_id", "copies", v.r("negative_raw", "negative_raw"), v.r("neg_w_sarcasm", "neg_w_sarcasm"))

    return query


_J4 = _BY_TEXT + f"select post_id, count(*) as copies, {_rd('avg(neg_raw)', 'negative_raw')}, {_rd('avg(neg_effective)', 'neg_w_sarcasm')} from j group by 1"
check("j4_scores_by_text", _J4)(_by_text(100_000))
check("j4_scores_by_text_salted", _J4)(_by_text(0))


@check("j4_text_means", _BY_TEXT + f"select subreddit, {_rd('avg(neg_effective)', 'mean')}, count(*) as n from j group by 1")
def j4_means(spark, sf):
    posts = v.posts(spark, sf).withColumn("full_post", F.concat("title", F.lit(":\n"), "body"))
    joined = sarcasm.attach_scores(posts, _scores(spark, sf), by="text")
    means = joined.groupBy("subreddit").agg(
        safe_weighted_mean("neg_w_sarcasm", "copies").alias("m"), F.sum("copies").alias("n")
    )
    return means.select("subreddit", v.r("m", "mean"), "n")


@check("f3_complaints", f"with {v.PROBS} select post_id, {_rd('neg_effective', 'neg_effective')} from probs where neg_effective > 2e-1")
def f3(spark, sf):
    return v.probs(spark, sf).filter(scalars.is_complaint("neg_effective")).select("post_id", v.r("neg_effective", "neg_effective"))


@check(
    "p13_most_negative",
    f"with {v.PROBS} select post_id, {FULL} as full_post, {_rd('neg_effective', 'neg_effective')}, {_rd('sarcasm_prob', 'sarcasm_prob')} "
    "from probs order by probs.neg_effective desc, post_id limit 1",
)
def p13(spark, sf):
    best = rollups.extreme_row(v.probs(spark, sf), "neg_effective", "post_id")
    return best.select(
        "post_id", F.concat("title", F.lit(":\n"), "body").alias("full_post"),
        v.r("neg_effective", "neg_effective"), v.r("sarcasm_prob", "sarcasm_prob"),
    )


def _judged(spark, sf):
    labels = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"), "toxic")
    judged = v.scored_posts(spark, sf).join(labels, "post_id")
    return judged.select(
        "post_id", "toxic", (F.col("sentiment_body_label") == "negative").cast("int").alias("by_body"),
        (F.col("sentiment_post_label") == "negative").cast("int").alias("by_post"),
    )


_JUDGED = (
    f"{v.SCORED_POSTS}, judged as (select post_id, toxic, case when sentiment_body < -5e-2 then 1 else 0 end as by_body, "
    "case when sentiment_post < -5e-2 then 1 else 0 end as by_post from scored join labels on cast(doc_id as varchar) = post_id)"
)


@check(
    "m11_accuracy",
    f"with {_JUDGED}, a as (select 'by_body' as labelling, count(*) as n, avg(case when by_body = toxic then 1 else 0 end) as a from judged "
    "union all select 'by_post', count(*), avg(case when by_post = toxic then 1 else 0 end) from judged) "
    f"select labelling, n, {_rd('a', 'accuracy')}, {_rd('''a - (select a from a where labelling = 'by_body')''', 'gain')} from a",
)
def m11(spark, sf):
    found = scoring.accuracy(_judged(spark, sf), "toxic", by_body="by_body", by_post="by_post")
    return found.select("labelling", "n", v.r("accuracy", "accuracy"), v.r("gain", "gain"))


_POISSON = []
_chance, _below = math.exp(-1), 0.0
for _k in range(1, 13):
    _below += _chance
    _POISSON.append(f"cast(u >= {_below!r}e0 as int)")
    _chance /= _k


@check(
    "m11_gain_interval",
    f"with {_JUDGED}, r as (select post_id, cast(by_post = toxic as int) - cast(by_body = toxic as int) as more from judged), "
    "e as (select more, rep, cast('0x' || md5('gain:' || post_id || ':' || rep)[1:8] as bigint) / 4294967296e0 as u from r, (select unnest(range(200)) as rep) x), "
    f"w as (select rep, more, {' + '.join(_POISSON)} as w from e), "
    "b as (select rep, sum(w * more) / sum(w) as g, count(*) as n, sum(more) / count(*) as gain from w group by 1), "
    "l as (select any_value(n) as n, any_value(gain) as gain, list(g order by g) as g from b) "
    f"select n, {_rd('gain', 'gain')}, {_rd('g[5]', 'low')}, {_rd('g[195]', 'high')} from l",
)
def m11_interval(spark, sf):
    found = scoring.gain_interval(_judged(spark, sf), "post_id", "toxic", "by_body", "by_post")
    return found.select("n", v.r("gain", "gain"), v.r("low", "low"), v.r("high", "high"))


@check("m11_confusion", f"with {_JUDGED} select by_post, toxic, count(*) as n from judged group by 1, 2")
def m11_confusion(spark, sf):
    return scoring.confusion(_judged(spark, sf), "by_post", "toxic")


def _trained(spark, sf):
    """Stand-in models: polarity from the labels, sarcasm from a glad title over a sour body."""
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    labels = v.table(spark, sf, "labels")
    polarity = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    classes = docs.join(labels, "doc_id").select("text", polarity.alias("label"))
    mixed = ((F.col("sentiment_title") > 0) & (F.col("sentiment_body") < 0)).cast("int")
    ironic = v.scored_posts(spark, sf).select(F.concat("title", F.lit(":\n"), "body").alias("text"), mixed.alias("label"))
    return (
        scoring.PipelineScorer(scoring.train_classifier(classes, "text", "label"), scoring.SENTIMENT_COLUMNS),
        scoring.PipelineScorer(scoring.train_classifier(ironic, "text", "label"), scoring.SARCASM_COLUMNS),
    )


@check("m4_class_probabilities")
def m4(spark, sf):
    polarity, _ = _trained(spark, sf)
    return polarity.score(v.posts(spark, sf).select("post_id", "body"), "body").drop("body")


@check("m5_sarcasm_probability")
def m5(spark, sf):
    _, irony = _trained(spark, sf)
    return irony.score(v.posts(spark, sf).select("post_id", "body"), "body").drop("body")


@check("m7_score_texts")
def m7(spark, sf):
    polarity, irony = _trained(spark, sf)
    return scoring.score_texts(v.posts(spark, sf).select("post_id", "body"), "body", polarity, irony)


@check("m8_score_table")
def m8(spark, sf):
    polarity, irony = _trained(spark, sf)
    return sarcasm.score_table(v.posts(spark, sf), polarity, irony)


def _lag(name: str, k: int, default: str = "null") -> str:
    return f"coalesce(lag({name}, {k}) over w, {default})"


def _rules_sql() -> str:
    """The published rules as window functions over one row per word."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    punctuation = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    tokens = f"list_filter(regexp_split_to_array(text, '{v.SP}+'), lambda w: w <> '')"
    neighbours = ", ".join(
        f"{_lag('low', k, repr(''))} as l{k}, {_lag('val is null', k, 'false')} as p{k}, {_lag('boost', k)} as b{k}, "
        f"{_lag('neg', k, 'false')} as n{k}, {_lag('caps', k, 'false')} as c{k}" for k in (1, 2, 3)
    )
    steps, v0 = [], "v0"
    turned = {
        1: "case when n1 then -74e-2 else 1e0 end",
        2: "case when l2 = 'never' and l1 in ('so', 'this') then 125e-2 when l2 = 'without' and l1 = 'doubt' then 1e0 when n2 then -74e-2 else 1e0 end",
        3: "case when (l3 = 'never' and l2 in ('so', 'this')) or l1 in ('so', 'this') then 125e-2 "
           "when l3 = 'without' and (l2 = 'doubt' or l1 = 'doubt') then 1e0 when n3 then -74e-2 else 1e0 end",
    }
    for k, damp in ((1, "1e0"), (2, "95e-2"), (3, "9e-1")):
        loud = f"case when c{k} and mixed then 733e-3 else 0e0 end"
        gain = f"coalesce(case when v < 0 then -b{k} else b{k} end + case when v > 0 then {loud} else -({loud}) end, 0e0) * {damp}"
        steps.append(f"g{k} as (select * replace (case when p{k} then v + {gain} else v end as v) from {v0}), "
                     f"t{k} as (select * replace (case when p{k} then v * ({turned[k]}) else v end as v) from g{k})")
        v0 = f"t{k}"
    words = {-3: "l3", -2: "l2", -1: "l1", 0: "low", 1: "next_low", 2: "after_low"}

    def phrase(places):
        return "(" + " || ' ' || ".join(words[o] for o in places) + ")"

    def idiom(places):
        return f"case {phrase(places)} " + " ".join(f"when '{k}' then {x}e0" for k, x in lx.IDIOMS.items()) + " end"

    found = f"coalesce({', '.join(idiom(p) for p in lx.IDIOM_PLACES)}, v)" + "".join(
        f" - case when {phrase(p)} in ({listed(lx.SOFT_PHRASES)}) then 293e-3 else 0e0 end" for p in lx.SOFT_PLACES
    )
    steps.append(f"t4 as (select * replace (case when p3 then {found} else v end as v) from t3)")
    return (
        f"with {_WORDS}, {_LEXICON}, "
        f"e as (select doc_id, unnest(range(len(t))) as pos, unnest(t) as raw from (select doc_id, {tokens} as t from documents)), "
        f"s as (select doc_id, pos, case when length(trim(raw, '{punctuation}')) > 2 then trim(raw, '{punctuation}') else raw end as w from e), "
        f"f as (select doc_id, pos, lower(w) as low, cast(valence as double) as val, case when lower(w) in ({listed(lx.STRENGTHENERS)}) then 293e-3 "
        f"when lower(w) in ({listed(lx.SOFTENERS)}) then -293e-3 end as boost, (lower(w) in ({listed(lx.NEGATIONS)}) or contains(lower(w), 'n''t')) as neg, "
        "(w = upper(w) and w <> lower(w)) as caps from s left join lexicon on token = lower(w)), "
        "m as (select doc_id, sum(cast(caps as int)) > 0 and sum(cast(caps as int)) < count(*) as mixed, min(case when low = 'but' then pos end) as turn from f group by 1), "
        f"n as (select f.*, mixed, turn, {neighbours}, coalesce(lead(low) over w, '') as next_low, coalesce(lead(low, 2) over w, '') as after_low, lead(val) over w as next_val "
        "from f join m using (doc_id) window w as (partition by f.doc_id order by pos)), "
        "z as (select *, case when l1 = 'no' or l2 = 'no' or (l3 = 'no' and l1 in ('or', 'nor')) then val * -74e-2 when low = 'no' and next_val is not null then 0e0 else val end as v from n), "
        "v0 as (select * replace (case when caps and mixed then v + case when v > 0 then 733e-3 else -733e-3 end else v end as v) from z), "
        + ", ".join(steps)
        + ", d as (select *, case when val is null or boost is not null or (low = 'kind' and next_low = 'of') then 0e0 "
        "when l1 = 'least' and p1 and l2 not in ('at', 'very') then v * -74e-2 else v end as x from t4), "
        "y as (select doc_id, sum(x * case when turn is null or pos = turn then 1e0 when pos < turn then 5e-1 else 15e-1 end order by pos) as total from d group by 1), "
        "q as (select doc_id, coalesce(total, 0e0) as total, length(text) - length(replace(text, '!', '')) as bangs, "
        "length(text) - length(replace(text, '?', '')) as asks from documents left join y using (doc_id)), "
        "st as (select doc_id, total, least(bangs, 4) * 292e-3 + case when asks < 2 then 0e0 when asks <= 3 then asks * 18e-2 else 96e-2 end as em from q), "
        "a as (select doc_id, total + case when total > 0 then em when total < 0 then -em else 0e0 end as s from st) "
        "select doc_id, round(s / sqrt(s * s + 15e0), 4) + 0e0 as compound from a"
    )


@check("m1_lexicon_rules", _rules_sql())
def m1_rules(spark, sf):
    scorer = sentiment.lexicon_scorer(_lexicon(spark, sf))
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return scorer(docs, "text", "compound").select("doc_id", v.r("compound", "compound"))


@check("m1_lexicon_rules_joined", _rules_sql())
def m1_rules_joined(spark, sf):
    scorer = sentiment.lexicon_scorer(_lexicon(spark, sf), max_rows=0)
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return scorer(docs, "text", "compound").select("doc_id", v.r("compound", "compound"))


def _laws(scored, columns):
    """Each probability between 0 and 1, and whether they differ between rows at all."""
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.col(c).between(0, 1)
    return inside, F.lit(scored.agg(*[F.max(c) - F.min(c) > 1e-6 for c in columns[:1]]).first()[0])


_EVERY_POST = f"with {v.POSTS} select post_id, true as inside, true as differs"


@check("m4_class_probability_laws", f"{_EVERY_POST}, true as adds_up from posts")
def m4_laws(spark, sf):
    scored = cut_lineage(m4(spark, sf))
    inside, differs = _laws(scored, scoring.SENTIMENT_COLUMNS)
    total = F.col("neg_prob") + F.col("neu_prob") + F.col("pos_prob")
    return scored.select("post_id", inside.alias("inside"), differs.alias("differs"), (F.abs(total - 1) < 1e-9).alias("adds_up"))


@check("m5_sarcasm_probability_laws", f"{_EVERY_POST} from posts")
def m5_laws(spark, sf):
    scored = cut_lineage(m5(spark, sf))
    inside, differs = _laws(scored, scoring.SARCASM_COLUMNS)
    return scored.select("post_id", inside.alias("inside"), differs.alias("differs"))


_NEGATIVITY = f"{_EVERY_POST}, true as raw_again, true as effective_again"


def _recomputed(scored, names):
    """Raw and sarcasm-aware negativity worked out again from the four probabilities."""
    scored = cut_lineage(scored)
    neg, pos, sarcasm, raw, effective = (F.col(n) for n in names)
    inside, differs = _laws(scored, [names[0], names[1], names[2]])
    again = (1 - sarcasm) * (neg - pos) + sarcasm * (F.lit(0.35) * (neg - pos) + F.lit(0.10))
    return scored.select(
        "*", inside.alias("inside"), differs.alias("differs"), (F.abs(raw - (neg - pos)) < 1e-9).alias("raw_again"),
        (F.abs(effective - again) < 1e-9).alias("effective_again"),
    )


@check("m7_score_laws", f"{_NEGATIVITY}, body from posts")
def m7_laws(spark, sf):
    rows = _recomputed(m7(spark, sf), ("neg_prob", "pos_prob", "sarcasm_prob", "neg_raw", "neg_effective"))
    return rows.select("post_id", "inside", "differs", "raw_again", "effective_again", "body")


@check("m8_score_table_laws", f"{_NEGATIVITY}, {FULL} as full_post from posts")
def m8_laws(spark, sf):
    rows = _recomputed(m8(spark, sf), ("negative_prob", "positive_prob", "sarcasm_prob", "negative_raw", "neg_w_sarcasm"))
    full = F.col("full_post" if "full_post" in rows.columns else "text")
    return rows.select("post_id", "inside", "differs", "raw_again", "effective_again", full.alias("full_post"))


@check(
    "s3_result_scan",
    f"with {v.PROBS} select " + ", ".join(_rd(a, b) for a, b in _NAMES.items())
    + f", {FULL} as full_post, strftime(make_timestamp(created_utc*1000000), '%Y-%m-%d %H:%M:%S') as date, post_id from probs",
)
def s3(spark, sf):
    """The result table written, replaced and read back."""
    name, folder = f"results_{uuid.uuid4().hex}", scratch_path(spark, "results")
    posts = v.posts(spark, sf).withColumn("date", v.stamp())
    for _ in (1, 2):
        stored = sarcasm.store_result_table(posts, _scores(spark, sf), name, folder)
    return stored.select(
        *[v.r(c, c) for c in _NAMES.values()], "full_post", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "post_id"
    )


@check(
    "p13_most_positive",
    f"with {v.PROBS} select post_id, {FULL} as full_post, {_rd('pos_prob', 'pos_prob')} from probs order by probs.pos_prob desc, post_id limit 1",
)
def p13_positive(spark, sf):
    best = rollups.extreme_row(v.probs(spark, sf), "pos_prob", "post_id")
    return best.select("post_id", F.concat("title", F.lit(":\n"), "body").alias("full_post"), v.r("pos_prob", "pos_prob"))


_POLARITY = "case when toxic = 1 then 0 when quality = 1 then 2 else 1 end"


def _counted_sql(labelled: str, scored: str, columns: dict[int, str], classes: int) -> str:
    """``p`` with the probabilities of ``scored(post_id, text)`` by the words of ``labelled(text, label)``."""
    each = range(classes)
    n = ", ".join(f"count(*) filter (label = {i}) as n{i}" for i in each)
    logs = ", ".join(f"ln((n{i} + 1e0) / (t{i} + v)) as w{i}" for i in each)
    sums = ", ".join(f"sum(w{i}) as s{i}" for i in each)
    whole = ", ".join(f"coalesce(s{i}, 0) + ln((n{i} + 1e0) / (n + {classes})) as s{i}" for i in each)
    top = f"greatest({', '.join(f's{i}' for i in each)})"
    total = " + ".join(f"exp(s{i} - {top})" for i in each)
    return (
        f"l as ({labelled}), lw as (select label, unnest({tokens_sql('text')}) as token from l), "
        f"c as (select token, {n} from lw group by 1), sizes as (select count(*) as n, {n} from l), "
        f"t as (select count(*) as v, {', '.join(f'sum(n{i}) as t{i}' for i in each)} from c), w as (select token, {logs} from c, t), "
        f"x as ({scored}), xw as (select post_id, unnest({tokens_sql('text')}) as token from x), "
        f"s as (select post_id, {sums} from xw join w using (token) group by 1), "
        f"z as (select post_id, {whole} from x left join s using (post_id), sizes), "
        f"p as (select post_id, {', '.join(f'exp(s{i} - {top}) / ({total}) as {c}' for i, c in columns.items())} from z)"
    )


_CLASSES = dict(enumerate(scoring.SENTIMENT_COLUMNS))
_COUNTED_POLARITY = _counted_sql(
    f"select text, {_POLARITY} as label from documents join labels using (doc_id)", "select post_id, body as text from posts", _CLASSES, 3
)


def _counted_polarity(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text").join(v.table(spark, sf, "labels"), "doc_id")
    polarity = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return counted.count_classifier(docs.select("text", polarity.alias("label")), "text", "label", scoring.SENTIMENT_COLUMNS)


@check(
    "m4_counted_probabilities",
    f"with {v.POSTS}, {_COUNTED_POLARITY} select post_id, {', '.join(_rd(c, c) for c in _CLASSES.values())} from p",
)
def m4_counted(spark, sf):
    scored = _counted_polarity(spark, sf).score(v.posts(spark, sf).select("post_id", "body"), "body")
    return scored.select("post_id", *[v.r(c, c) for c in scoring.SENTIMENT_COLUMNS])


_FULL_TEXT = "title || chr(58) || chr(10) || body"


@check(
    "m5_counted_sarcasm",
    f"with {v.SCORED_POSTS}, "
    + _counted_sql(
        f"select {_FULL_TEXT} as text, cast(sentiment_title > 0 and sentiment_body < 0 as int) as label from scored",
        "select post_id, body as text from posts", {1: "sarcasm_prob"}, 2,
    )
    + f" select post_id, {_rd('sarcasm_prob', 'sarcasm_prob')} from p",
)
def m5_counted(spark, sf):
    mixed = ((F.col("sentiment_title") > 0) & (F.col("sentiment_body") < 0)).cast("int")
    ironic = v.scored_posts(spark, sf).select(F.concat("title", F.lit(":\n"), "body").alias("text"), mixed.alias("label"))
    model = counted.count_classifier(ironic, "text", "label", scoring.SARCASM_COLUMNS)
    scored = model.score(v.posts(spark, sf).select("post_id", "body"), "body")
    return scored.select("post_id", v.r("sarcasm_prob", "sarcasm_prob"))


CELLS = 64
_TRUTH = (
    f"{v.PROBS}, judged as (select neg_prob as p, cast(toxic as double) as hit from probs join labels on cast(doc_id as varchar) = post_id), "
    f"cells as (select cast(least(floor(p * {CELLS}), {CELLS - 1}) as int) as bin, count(*) as n, avg(p) as mean_prob, avg(hit) as share, sum(hit) as hits "
    "from judged group by 1)"
)


def _judged_probs(spark, sf):
    labels = v.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"), "toxic")
    return v.probs(spark, sf).select("post_id", "neg_prob").join(labels, "post_id")


@check("m4_reliability", f"with {_TRUTH} select bin, n, {_rd('mean_prob', 'mean_prob')}, {_rd('share', 'share')} from cells")
def m4_reliability(spark, sf):
    found = calibration.reliability(_judged_probs(spark, sf), "neg_prob", "toxic", CELLS)
    return found.select("bin", "n", v.r("mean_prob", "mean_prob"), v.r("share", "share"))


# a pooled share is the largest, over where a run may begin, of the smallest share of a run that reaches the bin or beyond it
_POOLED = (
    "runs as (select a.bin as a, b.bin as b, sum(c.hits) / sum(c.n) as share from cells a join cells b on a.bin <= b.bin "
    "join cells c on c.bin between a.bin and b.bin group by 1, 2), "
    "lows as (select i.bin, r.a, min(r.share) as low from cells i join runs r on i.bin between r.a and r.b group by 1, 2), "
    "shares as (select bin, max(low) as share from lows group by 1), "
    f"held as (select bin, coalesce((select share from shares s where s.bin <= x.bin order by s.bin desc limit 1), "
    f"(select share from shares order by bin limit 1)) as share from (select unnest(range({CELLS})) as bin) x)"
)


@check(
    "m4_calibrated",
    f"with {_TRUTH}, {_POOLED} select post_id, {_rd('share', 'neg_prob')} from probs "
    f"join held on bin = cast(least(floor(neg_prob * {CELLS}), {CELLS - 1}) as int)",
)
def m4_calibrated(spark, sf):
    """Negative probabilities of all posts as the rising map from the labelled ones gives them."""
    found = calibration.fit(_judged_probs(spark, sf), "neg_prob", "toxic", CELLS)
    return v.probs(spark, sf).select("post_id", v.r(found.apply(F.col("neg_prob")), "neg_prob"))


@check(
    "m4_expected_error",
    f"with {_TRUTH} select cast(sum(n) as bigint) as n, {_rd('sum(abs(mean_prob - share) * n) / sum(n)', 'error')}, "
    f"{_rd('max(abs(mean_prob - share))', 'worst')} from cells",
)
def m4_error(spark, sf):
    found = calibration.expected_error(calibration.reliability(_judged_probs(spark, sf), "neg_prob", "toxic", CELLS))
    return found.select("n", v.r("error", "error"), v.r("worst", "worst"))


@check(
    "m1_word_list_share",
    f"with w as (select source, unnest({v.words_sql('text')}) as w from documents), {_WORDS}, {_LEXICON} "
    f"select source, count(*) as words, count(token) as listed, {_rd('count(token) / count(*)', 'share')} from w x left join lexicon on x.w = token group by 1",
)
def m1_share(spark, sf):
    rows = v.table(spark, sf, "documents").select("source", v.plain_words(F.col("text")).alias("tokens"))
    return sentiment.word_list_share(rows, ["source"], "tokens", _lexicon(spark, sf)).select("source", "words", "listed", v.r("share", "share"))
