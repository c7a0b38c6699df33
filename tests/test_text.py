"""Cleaners against Python's own regular expressions, on literal and generated texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hearsay.operators import lemmas
from hearsay.functions import text

# The patterns both cleaners must agree with.
LINKS = re.compile(r"http\S+|www\S+|@\w+")
HANDLE = re.compile(r"(?<!\w)u\/[A-Za-z0-9_-]+|\@[A-Za-z0-9_]+")
URL = re.compile(r"https?://\S+|www\.\S+")
QUOTE = re.compile(r"(^|\n)\s{0,3}>\s.*")
MEDIA = re.compile(
    r"(https?://)?((preview\.redd\.it|i\.redd\.it|v\.redd\.it|redditstatic\.com)"
    r"|(\S+\.(?:png|jpe?g|webp|gif|mp4))(?:\?\S+)?)", re.IGNORECASE)
PARAMS = re.compile(
    r"(\b(w|width|h|height|format|auto|fit|crop|quality|q|s|amp|fps|duration|loop|mute|controls)=\S+)", re.IGNORECASE)
STOP = {"the", "and", "is", "in", "to", "of"}

PIECES = [
    "u/bob-1", "au/x", "u/", "@Other", "a@b.c", "http", "https://a.b/c?d=1", "HTTP://X", "www.x", "www", "awww", "i.redd.it",
    "xi.redd.it/a", "https://i.redd.it/abc.png?width=640&amp;format=png", "pic.PNG", "..png", ".png", "a.jpeg?x", "b.gif?", "v.redd.it/z.mp4",
    "redditstatic.com", "width=3", "Q=1", "-s=5", "ss=5", "ſ=1", "&amp;", "&amp;amp;", ">", "> quoted", ">no", "\n> line", "\n   > deep",
    "\n    > deeper", "\r\n", " ", "\x1c", "\x85", "\xa0", "　", "\t", "\n", " ", "  ", "café", "naïve", "don't", "The", "the", "İstanbul",
    "K", "ß", "²", "x²", "é", "日本", "42", "_a_", "é@é", "@é", "éu/x", "🙃", "is", "of", "",
]


def expected_clean(value, keep_numbers=True, remove_urls=True):
    low = (value or "").lower()
    low = LINKS.sub("", low) if remove_urls else low
    kept = re.sub(r"[^a-z0-9\s]" if keep_numbers else r"[^a-z\s]", "", low)
    return [w for w in kept.split() if w not in STOP]


def expected_preprocess(value, previews=True):
    out = value or ""
    for pattern, mask in ([(MEDIA, " "), (PARAMS, " ")] if previews else []) + [(HANDLE, "@user"), (URL, "http"), (QUOTE, "")]:
        out = pattern.sub(mask, out)
    return " ".join(out.replace("&amp;", "&").split())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    made = ["".join(rng.choice(PIECES) + rng.choice(["", " ", "", "."]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([None, *PIECES, *made])], "id int, t string").cache()


@pytest.mark.parametrize("options", [{}, {"keep_numbers": False}, {"remove_urls": False}])
def test_clean_matches_python(texts, options):
    rows = texts.select("t", text.clean_tokens("t", **options).alias("k"), text.clean_text("t", **options).alias("c")).collect()
    bad = [(r.t, r.k, expected_clean(r.t, **options)) for r in rows if list(r.k) != expected_clean(r.t, **options)]
    assert not bad, bad[:3]
    assert all(r.c == " ".join(r.k) for r in rows)


@pytest.mark.parametrize("previews", [True, False])
def test_preprocess_matches_python(texts, previews):
    rows = texts.select("t", text.preprocess("t", previews).alias("p")).collect()
    bad = [(r.t, r.p, expected_preprocess(r.t, previews)) for r in rows if r.p != expected_preprocess(r.t, previews)]
    assert not bad, bad[:3]


def test_media_pattern_is_linear(spark):
    long = spark.range(1).select(F.repeat(F.lit("a."), 200_000).alias("t"))
    assert long.select(F.length(text.strip_media_urls("t")).alias("n")).first().n == 400_000


def test_stop_words_keep_duplicates_and_order(spark):
    row = spark.sql("select array('b', 'the', 'a', 'b') as w").select(text.without_words("w", ["the"]).alias("w")).first()
    assert row.w == ["b", "a", "b"]
    assert spark.sql("select array('b') as w").select(text.without_words("w", []).alias("w")).first().w == ["b"]


def test_lemma_runs_after_stop_words(spark):
    row = spark.sql("select 'the cats' as t").select(text.clean_text("t", lemma=lambda w: F.rtrim(w, F.lit("s"))).alias("c")).first()
    assert row.c == "cat"


@pytest.mark.parametrize("options", [{}, {"max_rows": 0}, {"max_rows": 0, "max_broadcast_rows": 0}])
def test_lemmas_do_not_depend_on_keys_or_size(spark, options):
    rows = [(None, ["cats", "ran", "cats"]), (1, ["cats", "ran", "cats"]), (1, ["mice"]), (2, []), (3, None), (4, ["dogs", None, "ok"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    table = spark.createDataFrame([("cats", "cat"), ("mice", "mouse"), ("dogs", "dog"), ("dogs", "aog")], "token string, lemma string")
    got = lemmas.lemmatise(df, "tokens", table, **options)
    assert got.columns == df.columns
    want = [(None, ["cat", "ran", "cat"]), (1, ["cat", "ran", "cat"]), (1, ["mouse"]), (2, []), (3, None), (4, ["dog", None, "ok"])]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
