"""Lemmas by endings, gains with their uncertainty, merged day sums."""

import random
from collections import Counter

from pyspark.sql import functions as F

from hearsay.operators import lemmas, scoring
from hearsay.streaming import rolling


def made_lemmas(seed, n):
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        stem = "".join(r.choice("bcdfgklmnprtvw") + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice("bdgklmnprt")
        out |= {stem: stem, f"{stem}s": stem, f"{stem}ing": stem, f"{stem}ies": f"{stem}y", f"{stem}ness": f"{stem}ness"}
    return out


def test_endings_tell_lemmas_of_unlisted_words(spark):
    table = made_lemmas(1, 400) | {"was": "be", "a": "a", "mice": "mouse"}
    pairs = spark.createDataFrame([*table.items(), ("x", None), (None, "x"), ("was", "ba")], "token string, lemma string")
    want = Counter()
    ends = Counter()
    for token, lemma in table.items():
        for size in range(1, min(len(token) - 1, 6) + 1):
            ends[token[-size:]] += 1
            stem = token[:-size]
            if lemma.startswith(stem):
                want[token[-size:], lemma[len(stem):]] += 1
    assert {(r.suffix, r.replacement): (r.n, r.m) for r in lemmas.ending_counts(pairs).collect()} == {k: (n, ends[k[0]]) for k, n in want.items()}
    rules = lemmas.ending_rules(pairs)
    told = {r.suffix: r.replacement for r in rules.collect()}
    assert told["ies"] == "y" and told["ing"] == "" and told["ss"] == "ss" and "ness" not in told
    held_out = {t: w for t, w in made_lemmas(2, 200).items() if t not in table}
    df = spark.createDataFrame([(1, [*held_out, "was", "zz", None]), (2, None), (3, [])], "id int, tokens array<string>")
    for size in (10_000_000, 0):
        got = {r.id: r.tokens for r in lemmas.lemmatise(df, "tokens", pairs, size, rules=rules).collect()}
        assert got[1][-3] == "be" and got[1][-1] is None and got[2] is None and got[3] == []
        right = sum(a == b for a, b in zip(got[1], held_out.values(), strict=False))
        assert right > 0.97 * len(held_out)
        plain = {r.id: r.tokens for r in lemmas.lemmatise(df, "tokens", pairs, size).collect()}
        assert plain[1][:5] == list(held_out)[:5]
    none = lemmas.ending_rules(pairs.limit(0))
    assert lemmas.lemmatise(df, "tokens", pairs, rules=none).filter("id = 1").first().tokens[0] == next(iter(held_out))


def test_gain_interval(spark):
    r = random.Random(5)
    rows = [(i, a := r.randint(0, 1), a if r.random() < 0.6 else 1 - a, a if r.random() < 0.75 else 1 - a) for i in range(1500)]
    df = spark.createDataFrame([*rows, (None, 1, 1, 0), (9999, None, 1, 0), (9998, 1, None, 0)], "id int, actual int, base int, other int")
    found = scoring.gain_interval(df, "id", "actual", "base", "other").first()
    gain = sum((o == a) - (b == a) for _, a, b, o in rows) / len(rows)
    assert found.n == 1500 and abs(found.gain - gain) < 1e-12 and found.low < gain < found.high
    # about the normal interval
    diffs = [(o == a) - (b == a) for _, a, b, o in rows]
    spread = (sum((d - gain) ** 2 for d in diffs) / len(diffs) ** 2) ** 0.5
    assert abs((found.high - found.low) / (2 * 1.96 * spread) - 1) < 0.2
    again = scoring.gain_interval(df.repartition(7), "id", "actual", "base", "other").first()
    assert (again.low, again.high) == (found.low, found.high)
    none = scoring.gain_interval(df.limit(0), "id", "actual", "base", "other").first()
    assert none.n == 0 and none.gain is None and none.low is None
    mean = spark.range(20_000).select(scoring._poisson(F.rand(1)).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(mean[0] - 1) < 0.03 and abs(mean[1] - 1) < 0.05


def days(spark, n, value):
    return spark.createDataFrame([(f"2024-01-{1 + (n + i) % 9:02d} 10:00:00", float(value + i), 1.0) for i in range(4)], "ts string, v double, w double")


def test_merged_folders_hold_every_batch_once(spark, tmp_path, monkeypatch):
    path, want = str(tmp_path / "days"), Counter()
    most = 0

    def write(n):
        rolling.daily_sums(days(spark, n, n), "ts", "v", "w").write.mode("overwrite").parquet(f"{path}/batch={n}")

    def total():
        return {str(r.day)[:10]: (r.n, r.total) for r in rolling.stored_days(spark, path).collect()}

    for n in range(14):
        rolling.merge_days(spark, path, n, fan=2)
        if n in (5, 9):  # a batch that failed half way comes again
            write(n)
            rolling.merge_days(spark, path, n, fan=2)
        write(n)
        for r in days(spark, n, n).collect():
            want[r.ts[:10], "n"] += 1
            want[r.ts[:10], "v"] += r.v
        most = max(most, len(rolling.day_folders(spark, path)))
    assert total() == {d: (want[d, "n"], want[d, "v"]) for d, _ in want}
    assert most <= 6 and len(rolling.day_folders(spark, path)) <= 6


def test_a_crash_in_a_merge_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "days")
    for n in range(6):
        rolling.daily_sums(days(spark, n, n), "ts", "v", "w").write.parquet(f"{path}/batch={n}")
    rows = lambda: sorted(map(tuple, rolling.stored_days(spark, path).collect()))
    before, (files, kind) = rows(), rolling._files(spark, path)

    class Dying:
        """Fails at the given call."""

        def __init__(self, call):
            self.call = call

        def __getattr__(self, name):
            if name == self.call:
                raise RuntimeError("gone")
            return getattr(files, name)

    whole = rolling._files
    for call in ("create", "delete"):
        monkeypatch.setattr(rolling, "_files", lambda *_, call=call: (Dying(call), kind))
        try:
            rolling.merge_days(spark, path, 5, fan=2)
        except RuntimeError:
            pass
        monkeypatch.setattr(rolling, "_files", whole)
        assert rows() == before
    rolling.merge_days(spark, path, 5, fan=2)
    assert rows() == before and len(rolling.day_folders(spark, path)) <= 3
