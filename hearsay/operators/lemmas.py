"""Replace tokens by their lemmas from a (token, lemma) table, and by rules of endings learned from it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.lexicon import MAX_DICTIONARY_ROWS, buckets_for, dictionary, lookup
from hearsay.operators.skew import lookup_join
from hearsay.session import cut_lineage


LONGEST = 6
SUPPORT = 5
PRECISION = 0.7
MAX_RULES = 20_000


def ending_counts(lemmas: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(suffix, replacement, n, m)``: of the ``m`` tokens with an ending, up to ``longest`` letters, how many become their lemma by replacing it.

    A token gives a rule for each ending that holds all in which it differs from its lemma, and leaves a letter ahead; so the longer ones say
    in what company an ending changes, or stays. A token with several lemmas counts by the greatest, once.
    """
    pairs = lemmas.filter("token is not null and lemma is not null").groupBy("token").agg(F.max("lemma").alias("lemma"))
    same = F.expr(
        "aggregate(sequence(1, greatest(least(length(token), length(lemma)), 1)), 0, (s, i) -> if(left(token, i) = left(lemma, i), i, s))"
    )
    size = F.length("token")
    upto = F.least(size - 1, F.lit(longest))
    sized = pairs.filter(size > 1).select("token", "lemma", same.alias("same"), size.alias("size"), upto.alias("upto"))
    each = sized.select("token", "lemma", "same", "size", F.explode(F.sequence(F.lit(1), F.col("upto"))).alias("l"))
    cut = F.expr("right(token, l)").alias("suffix")
    holds = F.col("l") >= F.col("size") - F.col("same")
    rules = each.select(cut, F.when(holds, F.expr("substring(lemma, size - l + 1)")).alias("replacement"))
    counts = rules.groupBy("suffix", "replacement").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("suffix").agg(F.sum("n").alias("m"))
    return counts.filter("replacement is not null").join(ends, "suffix").select("suffix", "replacement", "n", "m")


def ending_rules(
    lemmas: DataFrame, longest: int = LONGEST, support: int = SUPPORT, precision: float = PRECISION, max_rules: int = MAX_RULES
) -> DataFrame:
    """``(suffix, replacement, n, m)``: the rule of each ending that ``support`` tokens follow, and ``precision`` of all that have the ending.

    The commonest replacement of an ending is its rule (of equally common ones the least). A rule that says what that of the next shorter
    ending says is left out. No more than ``max_rules``, those with most tokens: they are held as constants.
    """
    best = F.min(F.struct((-F.col("n")).alias("order"), "replacement", "m")).alias("b")
    counts = ending_counts(lemmas, longest).filter(F.col("n") >= support).groupBy("suffix").agg(best)
    good = counts.select("suffix", "b.replacement", (-F.col("b.order")).alias("n"), "b.m").filter(F.col("n") >= F.lit(precision) * F.col("m"))
    good = cut_lineage(good)
    shorter = good.select(F.col("suffix").alias("tail"), F.col("replacement").alias("known"))
    told = good.withColumn("tail", F.expr("substring(suffix, 2)")).join(shorter, "tail", "left")
    implied = F.coalesce(F.concat(F.expr("left(suffix, 1)"), "known") == F.col("replacement"), F.lit(False))
    return told.filter(~implied).select("suffix", "replacement", "n", "m").orderBy(F.desc("n"), "suffix").limit(max_rules)


def by_ending(rules: DataFrame) -> Callable[[Column], Column]:
    """A token to the lemma that the rule of its longest listed ending gives; without one it stays."""
    held = {r["suffix"]: r["replacement"] for r in rules.select("suffix", "replacement").limit(MAX_RULES).collect()}
    if not held:
        return lambda w: w
    index = F.from_json(F.lit(json.dumps(held)), "map<string,string>")

    def lemma(w: Column) -> Column:
        tries = [
            F.when(F.length(w) > l, F.concat(F.left(w, F.length(w) - l), F.try_element_at(index, F.right(w, F.lit(l)))))
            for l in sorted({len(x) for x in held}, reverse=True)
        ]
        return F.coalesce(*tries, w)

    return lemma


def lemmatise(
    df: DataFrame, tokens: str, lemmas: DataFrame, max_rows: int = MAX_DICTIONARY_ROWS, rules: DataFrame | None = None, **options
) -> DataFrame:
    """``df`` with each token of ``tokens`` replaced; unlisted tokens stay, and so does a null list.

    With ``rules`` (see ``ending_rules``) unlisted tokens get the lemma that their ending tells.
    The result is the same for a table of any size. One of checked size is looked up row by row. A
    larger one is joined, token by token, and each list's tokens are put back in order. A list is
    known by its own hash (128 bits): keys do not matter, and copies are looked up once.
    """
    guess = by_ending(rules) if rules is not None else lambda w: w
    size = lemmas.count()
    if size <= max_rows:
        buckets = buckets_for(size)
        index = dictionary(lemmas, "token", "lemma", buckets)
        return df.withColumn(tokens, F.transform(tokens, lambda w: F.coalesce(lookup(index, w, buckets), guess(w))))
    key = ["__k1", "__k2"]
    keyed = df.withColumns({"__k1": F.xxhash64(tokens), "__k2": F.xxhash64(F.lit(1), tokens)})
    distinct = keyed.select(*key, tokens).filter(F.col(tokens).isNotNull()).dropDuplicates(key)
    words = distinct.select(*key, F.posexplode(tokens).alias("pos", "token"))
    known = lemmas.groupBy("token").agg(F.max("lemma").alias("lemma"))
    found = lookup_join(words, known, "token", "left", spread_by=[*key, "pos"], bounded_by=lemmas, **options)
    item = F.struct("pos", F.coalesce(F.col("lemma"), guess(F.col("token"))).alias("word"))
    lists = found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["word"]).alias("__words"))
    joined = keyed.join(lists, key, "left")
    return joined.withColumn(tokens, F.when(F.col(tokens).isNotNull(), F.coalesce("__words", tokens))).select(*df.columns)
