"""The rules as column expressions against a plain loop over words."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hearsay.functions import english
from hearsay.functions import lexicon as lx
from hearsay.plans import sentiment

WORDS = {"good": 1.9, "great": 3.1, "bad": -2.5, "broken": -2.1, "hate": -2.7, "no": -1.2, "love": 3.2, "kind": 2.4, "fix": 0.5, "bomb": -2.2, "death": -2.9}
FILLER = ["the", "boat", "river", "but", "so", "very", "barely", "not", "never", "without", "doubt", "least", "at", "this",
          "or", "nor", "of", "isn't", "kinda", "ABC", ":)", "A",
          "ass", "bus", "stop", "yeah", "right", "heart", "kiss", "sort", "just", "enough"]


def expected(text):
    tokens = []
    for token in text.split():
        bare = token.strip(lx.PUNCTUATION)
        tokens.append(bare if len(bare) > 2 else token)
    low = [t.lower() for t in tokens]
    caps = [t.upper() == t and t.lower() != t for t in tokens]
    mixed = 0 < sum(caps) < len(tokens)

    def boost(w):
        return lx.BOOST_STEP if w in lx.STRENGTHENERS else -lx.BOOST_STEP if w in lx.SOFTENERS else None

    def negates(w):
        return w in lx.NEGATIONS or "n't" in w

    def at(i):
        return low[i] if 0 <= i < len(low) else ""

    scores = []
    for i, w in enumerate(low):
        if boost(w) is not None or w not in WORDS or (w == "kind" and at(i + 1) == "of"):
            scores.append(0.0)
            continue
        v = WORDS[w]
        if w == "no" and at(i + 1) in WORDS:
            v = 0.0
        if at(i - 1) == "no" or at(i - 2) == "no" or (at(i - 3) == "no" and at(i - 1) in ("or", "nor")):
            v = WORDS[w] * lx.NEGATION_FACTOR
        if caps[i] and mixed:
            v += lx.CAPS_STEP if v > 0 else -lx.CAPS_STEP
        for d in (1, 2, 3):
            if i - d < 0 or at(i - d) in WORDS:
                continue
            b = boost(at(i - d))
            if b is not None:
                b = -b if v < 0 else b
                if caps[i - d] and mixed:
                    b += lx.CAPS_STEP if v > 0 else -lx.CAPS_STEP
                v += b * lx.DISTANCE_DAMPING[d - 1]
            doubt = any(at(i - k) == "doubt" for k in range(1, d))
            if d == 2 and at(i - 2) == "never" and at(i - 1) in ("so", "this"):
                v *= lx.NEVER_FACTOR
            elif d == 3 and ((at(i - 3) == "never" and at(i - 2) in ("so", "this")) or at(i - 1) in ("so", "this")):
                v *= lx.NEVER_FACTOR
            elif d > 1 and at(i - d) == "without" and doubt:
                pass
            elif negates(at(i - d)):
                v *= lx.NEGATION_FACTOR
        if i > 2 and at(i - 3) not in WORDS:
            for places in lx.IDIOM_PLACES[::-1]:
                v = lx.IDIOMS.get(" ".join(at(i + o) for o in places), v)
            v -= lx.BOOST_STEP * sum(" ".join(at(i + o) for o in places) in lx.SOFT_PHRASES for places in lx.SOFT_PLACES)
        if at(i - 1) == "least" and at(i - 2) not in ("at", "very"):
            v *= lx.NEGATION_FACTOR
        scores.append(v)
    if "but" in low:
        turn = low.index("but")
        scores = [s * (lx.BEFORE_BUT if i < turn else lx.AFTER_BUT if i > turn else 1.0) for i, s in enumerate(scores)]
    total = sum(scores)
    asked = text.count("?")
    stress = min(text.count("!"), 4) * 0.292 + (0 if asked < 2 else asked * 0.18 if asked <= 3 else 0.96)
    total += stress if total > 0 else -stress if total < 0 else 0
    return total / math.sqrt(total * total + 15)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(WORDS.items()), "token string, valence double")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    made = []
    for _ in range(3000):
        words = [rng.choice([*WORDS, *FILLER]) for _ in range(rng.randint(1, 9))]
        words = [w.upper() if rng.random() < 0.15 else w for w in words]
        made.append(" ".join(w + rng.choice(["", "", "", "!", "?", "...", "??"]) for w in words))
    fixed = [None, "", "GREAT", "A GREAT view, and great tea!", "not very good", "never so good", "the least good", "at least good",
             "that cake is the bomb", "it is a bad ass bike", "a kiss of death", "it was just enough good"]
    return spark.createDataFrame(list(enumerate([*fixed, *made])), "id int, t string").cache()


def test_rules_match_the_loop(spark, texts, lexicon):
    rows = sentiment.lexicon_scorer(lexicon)(texts, "t", "s").collect()
    bad = [(r.t, r.s, expected(r.t or "")) for r in rows if abs(r.s - expected(r.t or "")) > 6e-5]
    assert not bad, bad[:3]
    assert len({r.s for r in rows}) > 500 and all(-1 <= r.s <= 1 for r in rows)


def test_every_way_to_hold_the_lexicon_scores_alike(spark, texts, lexicon):
    again = texts.union(texts.limit(50)).withColumn("id", F.when(F.col("id") % 5 > 0, F.col("id")))  # null and repeated ids, repeated texts
    held = sentiment.lexicon_scorer(lexicon)(again, "t", "s").select("id", "t", "s")
    for options in ({}, {"max_broadcast_rows": 0}):
        joined = sentiment.lexicon_scorer(lexicon, max_rows=0, **options)(again, "t", "s").select("id", "t", "s")
        assert held.exceptAll(joined).count() == 0 and joined.exceptAll(held).count() == 0


# worked out by hand from the rules: sum of valences, then x / sqrt(x * x + 15)
BY_HAND = {
    "good": 0.4404, "not good": -0.3412, "no no good": -0.1326, "VERY good tea": 0.6028, "good!": 0.4926, "good but bad": -0.5859,
}


def test_scores_worked_out_by_hand(spark, lexicon):
    rows = sentiment.lexicon_scorer(lexicon)(spark.createDataFrame([(t,) for t in BY_HAND], "t string"), "t", "s").collect()
    assert {r.t: r.s for r in rows} == BY_HAND


def test_scoring_is_narrow_and_stays_in_the_jvm(spark, texts, lexicon):
    plan = sentiment.lexicon_scorer(lexicon)(texts, "t", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_dictionary_lookup(spark):
    table = spark.createDataFrame([(f"w{i}", i) for i in range(5000)] + [('q"\\', 7), (None, 1)], "k string, v int")
    index = lx.dictionary(table, "k", "v")
    probe = table.select("k", "v", lx.lookup(index, F.col("k")).alias("got"), lx.lookup(index, F.concat("k", F.lit("x"))).alias("none"))
    assert probe.filter("k is not null and (got is null or got <> v)").count() == 0 and probe.filter("none is not null").count() == 0


def test_post_scores_use_raw_text_and_mean_of_both(spark, lexicon):
    posts = spark.createDataFrame([("1", "GREAT game", "bad patch", None), ("2", None, None, 3)], "post_id string, title string, body string, score bigint")
    rows = sentiment.score_posts(posts, sentiment.lexicon_scorer(lexicon)).orderBy("post_id").collect()
    assert rows[0].sentiment_title == pytest.approx(expected("GREAT game"), abs=6e-5)
    assert rows[0].sentiment_post == pytest.approx((rows[0].sentiment_title + rows[0].sentiment_body) / 2)
    assert (rows[1].sentiment_post, rows[1].sentiment_post_label, rows[0].score_weighted) == (0.0, "neutral", 0)


def test_own_list_files_and_emoji(spark, tmp_path):
    score = sentiment.lexicon_scorer(english.word_list(spark))
    rows = score(spark.createDataFrame([("What a lovely day",), ("a dreadful, dreadful film",), ("the chair",)], "t string"), "t", "s").collect()
    assert rows[0].s > 0.3 and rows[1].s < -0.5 and rows[2].s == 0
    (tmp_path / "list.txt").write_text("yay\t2.5\t0.1\t[3, 2]\nnay\t-2.5\n\nbroken line\n")
    listed = english.read_word_list(spark, str(tmp_path / "list.txt"))
    assert sorted(tuple(r) for r in listed.collect()) == [("nay", -2.5), ("yay", 2.5)]
    names = lx.dictionary(spark.createDataFrame([("☀", "lovely sun"), ("☔", "rain")], "e string, n string"), "e", "n")
    got = spark.createDataFrame([("hot☀day ☔",), ("plain  text",), (None,)], "t string").select(lx.name_emoji("t", names).alias("t"))
    assert [r.t for r in got.collect()] == ["hot lovely sun day rain", "plain text", None]
    assert "the" in english.stop_words() and len(english.stop_words()) > 100


def test_a_list_too_big_to_hold_is_looked_up_where_the_texts_lie(spark, texts, lexicon):
    joined = sentiment.lexicon_scorer(lexicon, max_rows=0)(texts, "t", "s")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    core = sentiment.lexicon_scorer(lexicon, rules=False, max_rows=0)(texts, "t", "s")
    held = sentiment.lexicon_scorer(lexicon, rules=False)(texts, "t", "s")
    assert core.exceptAll(held).count() == 0 and held.exceptAll(core).count() == 0
    assert "Exchange" not in core._jdf.queryExecution().executedPlan().toString()


def test_a_list_without_words_and_texts_without_words(spark, lexicon):
    texts = spark.createDataFrame([(None,), ("",), (" ! ",)], "t string")
    for words in (lexicon, lexicon.limit(0)):
        for rules in (True, False):
            assert {r.s for r in sentiment.lexicon_scorer(words, rules, max_rows=-1)(texts, "t", "s").collect()} == {0.0}
