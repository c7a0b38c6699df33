"""Learned vectors, the neighbour layout and the tree of areas against plain versions."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
import pytest

from hearsay.operators import areas, layout, linear, topics, wordvectors


def texts(seed, n):
    """Two themes; in each, two words that are used alike but hardly ever together."""
    r = random.Random(seed)
    themes = [("bread oven flour yeast dough".split(), ("baker", "cook")), ("boat sail river anchor mast".split(), ("sailor", "skipper"))]
    out = []
    for i in range(n):
        words, twins = themes[i % 2]
        line = []
        for _ in range(8):
            line += r.sample(words, 3) + [twins[r.random() < 0.5]] + [f"f{r.randrange(30)}"]
        out.append((i, line))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id int, tokens array<string>, word string, n int")


def test_pairs_and_pmi_equal_plain_counts(spark):
    rows = texts(1, 40) + [(100, None), (101, []), (102, ["alone"]), (103, ["bread", None, "bread"])]
    counts = Counter(w for _, t in rows for w in t or [] if w is not None)
    want = Counter()
    for _, t in rows:
        for i, a in enumerate(t or []):
            for b in (t or [])[i + 1 : i + 4]:
                if a is not None and b is not None and counts[a] >= 4 and counts[b] >= 4:
                    want[a, b] += 1
                    want[b, a] += 1
    pairs = wordvectors.cooccurrences(frame(spark, rows), "tokens", 3, 4)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == want
    side = Counter()
    for (a, _), n in want.items():
        side[a] += n
    total = sum(n**0.75 for n in side.values())
    pmi = {p: sum(math.log(n / (side[a] * side[b] ** 0.75 / total)) for a, b in (p, p[::-1])) / 2 for p, n in want.items()}
    got = {(r.a, r.b): r.pmi for r in wordvectors.positive_pmi(pairs).collect()}
    assert set(got) == {p for p, x in pmi.items() if x > 0} and all(abs(got[p] - pmi[p]) < 1e-9 for p in got)


def test_word_vectors_equal_eigenvectors_and_know_synonyms(spark):
    pairs = wordvectors.cooccurrences(frame(spark, texts(2, 200)), "tokens", 4, 5)
    pmi = wordvectors.positive_pmi(pairs)
    words = {r.word: np.array(r.vector) for r in wordvectors.word_vectors(pmi, 34).collect()}
    names = sorted(words)
    matrix = np.zeros((len(names),) * 2)
    for r in pmi.collect():
        matrix[names.index(r.a), names.index(r.b)] = r.pmi
    values, vectors = np.linalg.eigh(matrix)
    first = np.argsort(-values)[:34]
    best = vectors[:, first] * np.maximum(values[first], 0) @ vectors[:, first].T
    got = np.array([words[n] for n in names])
    assert len(names) == 44 and np.allclose(got @ got.T, best, atol=1e-9)  # the span holds all words
    words = {r.word: np.array(r.vector) for r in wordvectors.word_vectors(pmi, 6, passes=6).collect()}

    def nearest(word):
        v = words[word]
        return max((x for x in themes if x != word), key=lambda x: v @ words[x] / np.linalg.norm(words[x]) / np.linalg.norm(v))

    themes = {w: t for t, own in enumerate(("bread oven flour yeast dough baker cook".split(), "boat sail river anchor mast sailor skipper".split())) for w in own}
    assert all(themes[nearest(w)] == themes[w] for w in themes)
    cosine = lambda a, b: words[a] @ words[b] / np.linalg.norm(words[a]) / np.linalg.norm(words[b])
    assert cosine("baker", "cook") > cosine("baker", "sailor") + 0.3 and cosine("sailor", "skipper") > cosine("cook", "skipper") + 0.3


def test_text_vectors(spark):
    rows = texts(3, 60) + [(900, None), (901, []), (902, ["unheard"])]
    out = {r.id: np.array(r.vector) for r in wordvectors.learned_vectors(frame(spark, rows), "id", "tokens", 5).collect()}
    assert set(out) == {i for i, _ in rows} and all(len(x) == 5 for x in out.values())
    assert all(abs(np.linalg.norm(out[i]) - 1) < 1e-9 for i in range(60)) and all(not out[i].any() for i in (900, 901, 902))
    own = np.mean([out[0] @ out[i] for i in range(2, 60, 2)])
    other = np.mean([out[0] @ out[i] for i in range(1, 60, 2)])
    assert own > other + 0.3
    assert wordvectors.learned_vectors(frame(spark, []), "id", "tokens", 5).count() == 0


def trust(points, placed, k):
    """Share of the k nearest in the layout that are not far in the data, as usually defined."""
    n = len(points)
    rank = np.argsort(np.argsort(((points[:, None] - points[None]) ** 2).sum(axis=2) - np.eye(n), axis=1), axis=1)
    near = np.argsort(((placed[:, None] - placed[None]) ** 2).sum(axis=2) - np.eye(n), axis=1)[:, 1 : k + 1]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])


@pytest.mark.parametrize("shape", ["roll", "clusters"])
def test_layout_keeps_neighbours_better_than_components(spark, shape):
    rng = np.random.default_rng(4)
    if shape == "roll":
        t = 1.5 * np.pi * (1 + 2 * rng.random(900))
        points = np.c_[t * np.cos(t), 60 * rng.random(900), t * np.sin(t)]
    else:
        points = rng.standard_normal((12, 30)).repeat(40, axis=0) * 4 + rng.standard_normal((480, 30))
    df = spark.createDataFrame([(i, p.tolist(), "x") for i, p in enumerate(points)], "id int, v array<double>, at string")
    placed = layout.spectral_layout(df, "id", "v", 2, landmarks=300, nearest=5)
    assert placed.columns == ["id", "v", "at", "reduced"]
    ours = np.array([r.reduced for r in placed.orderBy("id").collect()])
    theirs = np.array([r.c for r in topics.reduce_dimensions(df, "v", 2, "c").orderBy("id").collect()])
    assert trust(points, ours, 8) > trust(points, theirs, 8) + (0.005 if shape == "roll" else 0.02) and trust(points, ours, 8) > 0.85


def test_layout_of_odd_rows(spark):
    schema = "id int, v array<double>"
    assert layout.spectral_layout(spark.createDataFrame([], schema), "id", "v").count() == 0
    rows = [(1, None), (2, [float("nan"), 1.0]), (3, [1.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [1.0, None])]
    out = [(r.id, r.reduced) for r in layout.spectral_layout(spark.createDataFrame(rows, schema), "id", "v").collect()]
    assert sorted(i for i, x in out if x is None) == [1, 2, 3, 5] and [x for i, x in out if i == 4] == [[0.0, 0.0]] * 2


def test_linear_helpers(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((50, 4))
    a[:, 3] = a[:, 0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id int, v array<double>").repartition(5)
    assert np.allclose(linear.gram(df, "v", 4), a.T @ a)
    q = np.array([r.v for r in linear.orthonormal(df, "v", 4).collect()])
    product = q.T @ q
    assert np.allclose(product @ product, product) and round(np.trace(product)) == 3
    assert linear.gram(df.filter("id < 0"), "v", 4).tolist() == np.zeros((4, 4)).tolist()


def plain_tree(docs):
    """Average similarity of all pairs of topics, from scratch at every step."""
    tf = {}
    for t, words in docs:
        tf.setdefault(t, Counter()).update(words)
    every = Counter()
    for c in tf.values():
        every.update(c)
    average = sum(every.values()) / len([c for c in tf.values() if c])
    weight = {t: {w: n * math.log1p(average / every[w]) for w, n in c.items()} for t, c in tf.items()}
    size = Counter(t for t, _ in docs)

    def cosine(a, b):
        x, y = weight[a], weight[b]
        lengths = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(x[w] * y.get(w, 0) for w in x) / lengths if lengths else 0.0

    base = {(a, b): cosine(a, b) for a in tf for b in tf}
    area, steps = {t: [t] for t in tf}, []
    while len(area) > 1:
        def alike(a, b):
            both = [(size[x] * size[y], base[x, y]) for x in area[a] for y in area[b]]
            return sum(n * s for n, s in both) / sum(n for n, _ in both)

        s, a, b = min((-round(alike(a, b), 12), a, b) for a in area for b in area if a < b)
        area[a] += area.pop(b)
        steps.append((len(steps), a, b, -s, sum(size[t] for t in area[a])))
    return steps


def test_merge_tree_equals_plain_loop_and_cuts_to_any_number(spark):
    r = random.Random(9)
    docs = []
    for t in range(42):
        own = [f"w{t % 5}_{r.randrange(12)}" for _ in range(10)] + [f"t{t}"]
        docs += [(t, r.choices(own, k=8) + [f"c{r.randrange(5)}"]) for _ in range(r.randint(1, 6))]
    docs += [(42, []), (43, ["c1", "c2"])]
    df = spark.createDataFrame([(*d, 1) for d in docs + [(-1, ["c0"]), (None, ["c0"])]], "topic int, tokens array<string>, step int").repartition(3)
    tree = areas.merge_tree(df, "topic", "tokens")
    got, want = [tuple(x) for x in tree.orderBy("step").collect()], plain_tree(docs)
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(got, want, strict=True))
    five = {r.topic: r.area for r in areas.cut(tree, 7).collect()}
    assert len(set(five.values())) == 7 and all(five[t] == five[t % 5] for t in range(42))
    assert len({r.area for r in areas.cut(tree, 1).collect()}) == 1 and len({r.area for r in areas.cut(tree, 99).collect()}) == 44
    assert areas.merge_tree(df.filter("topic = 3"), "topic", "tokens").count() == 0
    with pytest.raises(ValueError, match="least"):
        areas.cut(tree, 0)


def test_pairs_travel_as_numbers_one_way(spark):
    rows = texts(1, 40) + [(100, None), (101, []), (103, ["bread", None, "bread"])]
    words, pairs = wordvectors.numbered_pairs(frame(spark, rows), "tokens", 3, 4)
    assert dict(pairs.dtypes) == {"a": "bigint", "b": "bigint", "n": "bigint"}
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    names = {r.id: r.token for r in words.collect()}
    assert sorted(names) == list(range(len(names)))
    named = {(names[r.a], names[r.b]): r.n for r in pairs.collect()}
    assert named == {(r.a, r.b): r.n for r in wordvectors.cooccurrences(frame(spark, rows), "tokens", 3, 4).collect()}


def test_the_matrix_stays_where_it_is(spark, monkeypatch):
    pmi = wordvectors.positive_pmi(wordvectors.cooccurrences(frame(spark, texts(2, 60)), "tokens", 4, 5))
    monkeypatch.setattr(wordvectors, "SHARD_ROWS", 8)
    rows = wordvectors._random_rows(pmi.select(F.col("a").alias("word")).distinct(), 4, 1)
    got = {r.word: np.array(r.v) for r in wordvectors._applied(pmi.repartition(3, "a").sortWithinPartitions("a"), rows, 4).collect()}
    vectors, want = {r.word: np.array(r.v) for r in rows.collect()}, {}
    for r in pmi.collect():
        want[r.a] = want.get(r.a, 0) + r.pmi * vectors[r.b]
    assert set(got) == set(want) and all(np.allclose(got[w], want[w], atol=1e-9) for w in want)


def test_the_matrix_is_read_in_blocks(spark, monkeypatch):
    """A pass over the matrix reads a row for many cells, and sums that cross blocks meet."""
    pmi = wordvectors.positive_pmi(wordvectors.cooccurrences(frame(spark, texts(2, 60)), "tokens", 4, 5))
    monkeypatch.setattr(wordvectors, "BLOCK_CELLS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks = wordvectors._blocks(pmi.repartition(3, "a").sortWithinPartitions("a")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cells = pmi.collect()
    assert len(blocks) <= len(cells) / 50 + 3
    number = {r.b: r.key for r in pmi.select("b", F.xxhash64("b").alias("key")).collect()}
    got = Counter()
    for r in blocks:
        first, keys, places, values = (np.frombuffer(r[c], kind) for c, kind in wordvectors.BLOCK.items())
        words = np.repeat(np.array(r.words, dtype=object), np.diff(np.r_[first, len(places)]))
        got.update(zip(words, keys[places].tolist(), values.tolist()))
    assert got == Counter((r.a, number[r.b], r.pmi) for r in cells)


def test_any_number_of_words_needs_no_shuffle_of_pairs(spark, monkeypatch):
    words, pairs = wordvectors.numbered_pairs(frame(spark, texts(1, 40)), "tokens", 3, 4)
    want = {(r.a, r.b): r.pmi for r in wordvectors.positive_pmi(pairs).collect()}
    monkeypatch.setattr(wordvectors, "MAX_NUMBERED", 5)
    monkeypatch.setattr(wordvectors, "bits_for", lambda rows: 2)
    pmi = wordvectors.positive_pmi(pairs)
    assert "Exchange" not in pmi._jdf.queryExecution().executedPlan().toString()
    assert want and {(r.a, r.b): r.pmi for r in pmi.collect()} == want
