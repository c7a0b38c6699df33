"""Lexicon sentiment of one text as one expression: no explode, no shuffle, no Python worker.

The word table stays a DataFrame. ``dictionary`` turns a bounded one into an array of small maps
held by an uncorrelated scalar subquery, so that looking a word up costs one array access and a
map of a few entries. The rules are those of Hutto & Gilbert (2014), by position in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.text import split_words

# Constants of the published rules.
NORMAL_ALPHA = 15.0
CAPS_STEP = 0.733
BOOST_STEP = 0.293
NEGATION_FACTOR = -0.74
NEVER_FACTOR = 1.25
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
EXCLAMATION_STEP, EXCLAMATION_MAX = 0.292, 4
QUESTION_STEP, QUESTION_FEW, QUESTION_MANY = 0.18, 3, 0.96

# Fixed values, from the published rules (public, MIT licence): words that strengthen, soften or turn the next ones.
STRENGTHENERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably",
    "decidedly", "deeply", "effing", "enormous", "enormously", "entirely", "especially",
    "exceptional", "exceptionally", "extreme", "extremely", "fabulously", "flipping", "flippin",
    "frackin", "fracking", "fricking", "frickin", "frigging", "friggin", "fully", "fuckin",
    "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely", "incredible",
    "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "total", "totally",
    "tremendous", "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very",
)
SOFTENERS = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginal",
    "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight",
    "slightly", "somewhat", "sorta", "sortof", "sort-of",
)
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "neednt", "never", "none", "nope",
    "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "uh-uh", "wasnt",
    "werent", "without", "wont", "wouldnt", "rarely", "seldom", "despite",
)
# Phrases with a valence of their own, and phrases that soften.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0,
    "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}
SOFT_PHRASES = ("just enough", "kind of", "sort of")
IDIOM_PLACES = ((0, 1, 2), (0, 1), (-1, 0), (-2, -1, 0), (-2, -1), (-3, -2, -1), (-3, -2))
SOFT_PLACES = ((-3, -2, -1), (-3, -2), (-2, -1))
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

BUCKETS = 1024
SLOT_WORDS = 4
# as a broadcast: some ten megabytes of words
MAX_DICTIONARY_ROWS = 250_000


def buckets_for(rows: int) -> int:
    """Slots for a dictionary of so many rows, each of a few words."""
    return max(BUCKETS, 1 << max(0, (rows // SLOT_WORDS - 1).bit_length()))


def dictionary(df: DataFrame, key: str, value: str, buckets: int = BUCKETS) -> Column:
    """A bounded two-column table as one constant for ``lookup``; a key listed twice keeps the larger.

    Callers check the size (``bounded``): like a broadcast, the value passes through the driver
    and is held by every task. Spark reads the constant once, when it optimises the query.
    """
    words = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(value).alias("v"))
    filled = words.groupBy(F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("b")).agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")
    )
    kind = f"map<string,{words.schema['v'].dataType.simpleString()}>"
    slots = df.sparkSession.range(buckets).select(F.col("id").alias("b"))
    placed = slots.join(filled, "b", "left").select("b", F.coalesce(F.to_json("m"), F.lit("{}")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda s: s["m"])
    text = placed.agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))).head()[0]
    return F.from_json(F.lit(text), f"array<{kind}>")


def lookup(index: Column, word: Column, buckets: int = BUCKETS) -> Column:
    """Value of a word in a ``dictionary``, null if it is not listed."""
    slot = F.element_at(index, (F.pmod(F.xxhash64(word), F.lit(buckets)) + 1).cast("int"))
    return F.try_element_at(slot, word)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(total: Column) -> Column:
    """Sum of valences squeezed into [-1, 1], four digits."""
    # |x| / sqrt(x^2 + alpha) never exceeds 1, so there is nothing to clip; null stays null
    return F.round(total / F.sqrt(total * total + F.lit(NORMAL_ALPHA)), 4)


def core_compound(tokens: Column, valence: Callable[[Column], Column]) -> Column:
    """Compound score from word valences alone; no words is 0."""
    total = F.aggregate(
        tokens, F.lit(0.0), lambda sum_, w: sum_ + F.coalesce(valence(w).cast("double"), F.lit(0.0))
    )
    return F.coalesce(let(total, normalise), F.lit(0.0))


def sentiment_words(text: Column | str) -> Column:
    """Words without the punctuation around them; what would get shorter than three stays as it is."""
    def bare(word: Column) -> Column:
        inner = F.btrim(word, F.lit(PUNCTUATION))
        return F.when(F.length(inner) > 2, inner).otherwise(word)

    return F.transform(split_words(text), bare)


def word_facts(words: Column, valence: Callable[[Column], Column]) -> Column:
    """What the rules need to know about each word, looked up once."""
    def facts(pair: Column) -> Column:
        low = pair["low"]
        boost = F.when(low.isin(list(STRENGTHENERS)), F.lit(BOOST_STEP)).when(
            low.isin(list(SOFTENERS)), F.lit(-BOOST_STEP)
        )
        return F.struct(
            low.alias("low"),
            valence(low).cast("double").alias("val"),
            boost.alias("boost"),
            (low.isin(list(NEGATIONS)) | low.contains("n't")).alias("neg"),
            pair["caps"].alias("caps"),
        )

    return F.transform(cased_words(words), facts)


def cased_words(words: Column) -> Column:
    """Each word in lower case, and whether it stands in capitals."""
    def cased(word: Column) -> Column:
        return F.struct(F.lower(word).alias("low"), ((word == F.upper(word)) & (word != F.lower(word))).alias("caps"))

    return F.transform(words, cased)


def _word_score(facts: Column, mixed_case: Column, x: Column, i: Column) -> Column:
    """Valence of the word at ``i`` after its neighbours had their say."""
    def at(offset: int) -> Column:
        # get() answers null outside the array, negative positions included
        return F.get(facts, i + F.lit(offset))

    def low(offset: int) -> Column:
        return F.coalesce(at(offset)["low"], F.lit(""))

    def neg(offset: int) -> Column:
        return F.coalesce(at(offset)["neg"], F.lit(False))

    def plain(offset: int) -> Column:
        """There is a word there and it has no valence of its own."""
        return at(offset)["low"].isNotNull() & at(offset)["val"].isNull()

    so_this = ("so", "this")
    after_no = (low(-1) == "no") | (low(-2) == "no") | ((low(-3) == "no") & low(-1).isin("or", "nor"))
    start = (
        # a "no" before the word has the last say, also over another "no"
        F.when(after_no, x["val"] * F.lit(NEGATION_FACTOR))
        .when((low(0) == "no") & at(1)["val"].isNotNull(), F.lit(0.0))
        .otherwise(x["val"])
    )
    shouted = lambda v: v + F.when(
        x["caps"] & mixed_case, F.when(v > 0, F.lit(CAPS_STEP)).otherwise(F.lit(-CAPS_STEP))
    ).otherwise(F.lit(0.0))

    def boosted(distance: int) -> Callable[[Column], Column]:
        def step(v: Column) -> Column:
            prev = at(-distance)
            loud = F.when(prev["caps"] & mixed_case, F.lit(CAPS_STEP)).otherwise(F.lit(0.0))
            sized = F.when(v < 0, -prev["boost"]).otherwise(prev["boost"]) + F.when(v > 0, loud).otherwise(-loud)
            gain = F.coalesce(sized, F.lit(0.0)) * F.lit(DISTANCE_DAMPING[distance - 1])
            return F.when(plain(-distance), v + gain).otherwise(v)
        return step

    def turned(distance: int) -> Callable[[Column], Column]:
        nearer = range(1, distance)
        if distance == 1:
            factor = F.when(neg(-1), F.lit(NEGATION_FACTOR))
        else:
            if distance == 2:
                stressed = (low(-2) == "never") & low(-1).isin(*so_this)
            else:
                stressed = ((low(-3) == "never") & low(-2).isin(*so_this)) | low(-1).isin(*so_this)
            doubt = F.lit(False)
            for d in nearer:
                doubt = doubt | (low(-d) == "doubt")
            factor = (
                F.when(stressed, F.lit(NEVER_FACTOR))
                .when((low(-distance) == "without") & doubt, F.lit(1.0))
                .when(neg(-distance), F.lit(NEGATION_FACTOR))
            )
        return lambda v: F.when(plain(-distance), v * F.coalesce(factor, F.lit(1.0))).otherwise(v)

    def phrase(places: tuple[int, ...]) -> Column:
        return F.concat_ws(" ", *[low(o) for o in places])

    def idiomatic(v: Column) -> Column:
        """A phrase around the word takes its place; the phrase nearest behind or after it counts first."""
        values = F.create_map(*[F.lit(x) for pair in IDIOMS.items() for x in pair])
        found = F.coalesce(*[F.try_element_at(values, phrase(p)) for p in IDIOM_PLACES], v)
        for places in SOFT_PLACES:
            found = found - F.when(phrase(places).isin(list(SOFT_PHRASES)), F.lit(BOOST_STEP)).otherwise(F.lit(0.0))
        return F.when(plain(-3), found).otherwise(v)

    def least(v: Column) -> Column:
        hit = (low(-1) == "least") & plain(-1) & ~low(-2).isin("at", "very")
        return F.when(hit, v * F.lit(NEGATION_FACTOR)).otherwise(v)

    steps = [shouted]
    for distance in (1, 2, 3):
        steps += [boosted(distance), turned(distance)]
    steps += [idiomatic, least]
    score = start
    for step in steps:
        score = let(score, step)
    silent = x["val"].isNull() | x["boost"].isNotNull() | ((low(0) == "kind") & (low(1) == "of"))
    return F.when(silent, F.lit(0.0)).otherwise(score)


def punctuation_emphasis(text: Column) -> Column:
    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(EXCLAMATION_MAX))
    asked = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    question = (
        F.when(asked <= 1, F.lit(0.0))
        .when(asked <= QUESTION_FEW, asked * F.lit(QUESTION_STEP))
        .otherwise(F.lit(QUESTION_MANY))
    )
    return marks * F.lit(EXCLAMATION_STEP) + question


def stressed(total: Column, source: Column) -> Column:
    """The compound score from a text's sum of valences and its punctuation."""
    emphasis = punctuation_emphasis(source)
    louder = let(total, lambda t: t + F.when(t > 0, emphasis).when(t < 0, -emphasis).otherwise(F.lit(0.0)))
    return let(louder, normalise)


def lexicon_sentiment(df: DataFrame, text: str, valence: Callable[[Column], Column], out: str) -> DataFrame:
    """``df`` with the compound score of ``text`` in ``out``; null or empty text scores 0.

    Narrow: each row is scored where it lies, whatever its source or author holds of the data.
    """
    facts, flags, scores, turn = f"__{out}_facts", f"__{out}_mixed", f"__{out}_scores", f"__{out}_but"
    source = F.coalesce(F.col(text), F.lit(""))
    but = F.col(turn)

    def around_but(score: Column, i: Column) -> Column:
        position = i + 1
        return score * (
            F.when(position < but, F.lit(BEFORE_BUT)).when(position > but, F.lit(AFTER_BUT)).otherwise(F.lit(1.0))
        )

    def add_up(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    total = F.when(but == 0, add_up(F.col(scores))).otherwise(add_up(F.transform(scores, around_but)))
    return (
        df.withColumn(facts, word_facts(sentiment_words(source), valence))
        # columns of their own: inside the lambdas they would be worked out again for every word
        .withColumn(flags, F.exists(facts, lambda x: x["caps"]) & F.exists(facts, lambda x: ~x["caps"]))
        .withColumn(turn, F.array_position(F.transform(F.col(facts), lambda x: x["low"]), "but"))
        .withColumn(
            scores,
            F.transform(F.col(facts), lambda x, i: _word_score(F.col(facts), F.col(flags), x, i)),
        )
        .withColumn(out, stressed(total, source))
        .drop(facts, flags, scores, turn)
    )


def name_emoji(text: Column | str, names: Column, buckets: int = BUCKETS) -> Column:
    """``text`` with each emoji of a ``dictionary`` of (emoji, name) replaced by its name, as words of their own.

    Emoji of several characters are not joined; modifiers and joiners without a name stay. Null stays null.
    """
    source = F.col(text) if isinstance(text, str) else text
    spaced = F.transform(F.split(source, ""), lambda c: let(
        lookup(names, c, buckets), lambda n: F.when(n.isNotNull(), F.concat(F.lit(" "), n, F.lit(" "))).otherwise(c)
    ))
    return F.btrim(F.regexp_replace(F.array_join(spaced, ""), " {2,}", " "))
