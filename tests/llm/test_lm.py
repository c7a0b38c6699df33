"""The language model against a plain one over dictionaries, and its probabilities as a distribution."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hearsay.llm import lm

TEXTS = [
    "the cat sat on the mat", "The cat ran", "a dog sat on the cat", "", None, "the the the the", "dog  dog\tdog\ncat",
    "a cat sat on a mat and the dog ran on the mat", "mat", "the cat sat on the mat",
]


def sequence(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["</s>"]


class Plain:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter()
        for text in texts:
            words = ["<s>"] * (order - 1) + sequence(text)
            top.update(tuple(words[i : i + order]) for i in range(len(words) - order + 1))
        self.levels = {order: top}
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.discounts = {n: self.discount(c.values()) for n, c in self.levels.items()}
        self.sums = {n: defaultdict(list) for n in self.levels}
        for n, counts in self.levels.items():
            for g, c in counts.items():
                self.sums[n][g[:-1]].append(c)
        self.types = len({g[-1] for g in top})

    @staticmethod
    def discount(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return [0.0, *(min(max(d, 0.05), top) for d, top in zip(raw, (0.95, 1.95, 2.95)))]

    def p(self, gram):
        n = len(gram)
        lower = 1 / (self.types + 1) if n == 1 else self.p(gram[1:])
        counts = self.sums[n].get(gram[:-1])
        if not counts:
            return lower
        d, total = self.discounts[n], sum(counts)
        c = self.levels[n].get(gram, 0)
        return max(c - d[min(c, 3)], 0) / total + sum(d[min(k, 3)] for k in counts) / total * lower


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_a_plain_model(spark, order):
    train = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*train, (20, "the bird sat on the dog"), (None, "Cat")], "doc_id long, text string")
    model = lm.train(docs.filter("doc_id < 20"), order)
    plain = Plain(TEXTS, order)
    rows = lm.score(docs.selectExpr("*", "doc_id >= 20 as held_out"), model).collect()
    counts = Counter(w for t in TEXTS for w in sequence(t))
    total = sum(counts.values())
    texts = dict(train) | {20: "the bird sat on the dog", None: "Cat"}
    assert len(rows) == len(texts)
    for row in rows:
        words = ["<s>"] * (order - 1) + sequence(texts[row.doc_id])
        grams = [tuple(words[i : i + order]) for i in range(len(words) - order + 1)]
        assert row.n_tokens == len(grams)
        assert row.n_known == sum(g[-1] in counts for g in grams)
        assert row.train_tokens == total
        base = sum(math.log10((counts[g[-1]] + 0.5) / (total + 0.5 * (len(counts) + 1))) for g in grams)
        assert row.base_score == pytest.approx(base, abs=1e-9)
        assert row.score == pytest.approx(sum(math.log10(plain.p(g)) for g in grams), abs=1e-9)
        assert row.held_out == (row.doc_id == 20)


@pytest.mark.parametrize("before", ["", "the", "on the", "unheard of"])
def test_probabilities_sum_to_one(spark, before):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    model = lm.train(docs, 2)
    words = sorted({w for t in TEXTS for w in sequence(t)} - {"</s>"})
    tokens, counts = lm._sequence(pa.array([f"{before} {w}" for w in words] + [before, f"{before} newword"]))
    p, _ = lm.score_tokens(model, tokens, counts)
    at = np.cumsum(counts) - 1
    last = np.r_[p[at[:-2] - 1], p[at[-2]], p[at[-1] - 1]]  # each word, the end, and the mass of any unknown word
    assert last.sum() == pytest.approx(1.0, abs=1e-9)


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    model = lm.train(docs)
    assert lm.score(docs, model).count() == 0
    one = spark.createDataFrame([(1, "a b", True)], docs.schema)
    row = lm.score(one, model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_arrays_mapped_or_fetched_in_pieces(spark, tmp_path):
    from hearsay.llm import arrays as a

    keys = np.sort(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000))
    df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "key long, n long").repartition(3)
    bits = 4
    # shards cut between tasks, so that some have several pieces
    rows = df.withColumn("__shard", a.shard_of("key", bits)).sortWithinPartitions("__shard")
    assert a.write_shards(rows, f"file://{tmp_path}", "t", a.by_key).count() == 5000
    wanted = np.sort(np.r_[keys[::3], keys[5] + 1, keys[0] - 1])
    for local in (True, False):
        found = a.Arrays(f"file://{tmp_path}", "t", bits)
        if not local:
            found.local = None  # as for a store that cannot be mapped
        values, there = found.find(wanted, ["n", ""], -1)
        want = {int(k): i for i, k in enumerate(keys)}
        assert values.tolist() == [want.get(int(k), -1) for k in wanted]
        assert there.tolist() == [1 if int(k) in want else -1 for k in wanted]
        assert local or len(found.maps) <= a.FETCHED_SHARDS


def test_the_query_reads_two_words_of_context(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in lm.op6_lm_score(spark, str(tmp_path)).collect()}
    learned = [t for i, t in enumerate(TEXTS) if not rows[i].held_out]
    plain = Plain(learned, 3)
    for i, text in enumerate(TEXTS):
        words = ["<s>"] * 2 + sequence(text)
        want = sum(math.log10(plain.p(tuple(words[j : j + 3]))) for j in range(len(words) - 2))
        assert rows[i].score == pytest.approx(want, abs=1e-9)


def test_training_leaves_little_but_the_arrays(spark):
    """Most n-grams are unique: what is kept of each decides how much disk the job takes. Some words here are frequent, most are not."""
    from pathlib import Path

    from hearsay.session import shared_dir

    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in np.minimum(draw.zipf(1.3, 200), 5000)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    at = Path(shared_dir(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in at.rglob("*") if f.is_file())
    before = held()
    model = lm.train(docs, 3)
    left = held() - before
    plain = Plain(texts, 3)
    assert left / len(plain.levels[3]) < 32
    assert 0 < model.frequent < plain.types / 10  # both kinds of contexts are there
    rows = lm.score(docs.selectExpr("*", "false as held_out"), model).collect()
    for row in rows[:40]:
        words = ["<s>"] * 2 + sequence(texts[row.doc_id])
        want = sum(math.log10(plain.p(tuple(words[j : j + 3]))) for j in range(len(words) - 2))
        assert row.score == pytest.approx(want, abs=1e-9)


def test_files_follow_the_tasks_not_the_shards(spark, monkeypatch):
    """A mapped file holds a descriptor: one for each shard and name would be more than a process may have."""
    import os

    from hearsay.llm import arrays as a

    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in np.minimum(draw.zipf(1.3, 200), 5000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "SHARD_ROWS", 100)
    model = lm.train(docs, 3)
    tasks = sum(max(8, 2 ** model.bits[f"grams{n}"] // 8) for n in (1, 2, 3))
    assert model.bits["grams3"] >= 6 and len(os.listdir(model.folder.removeprefix("file:"))) <= tasks + 2
    rows = {r.doc_id: r.score for r in lm.score(docs.selectExpr("*", "false as held_out"), model).collect()}
    plain = Plain(texts, 3)
    for i, text in enumerate(texts[:10]):
        words = ["<s>"] * 2 + sequence(text)
        want = sum(math.log10(plain.p(tuple(words[j : j + 3]))) for j in range(len(words) - 2))
        assert rows[i] == pytest.approx(want, abs=1e-9)
    # where files cannot be mapped, too, and however few are mapped at a time
    name, bits = "contexts3", model.bits["contexts3"]
    keys = np.sort(np.concatenate([part for shard in range(-(2 ** (bits - 1)), 2 ** (bits - 1)) for part in a.Arrays(model.folder, name, bits)._pieces(shard)]))
    want = a.Arrays(model.folder, name, bits).find(keys, ["n", ""])
    fetched = a.Arrays(model.folder, name, bits)
    fetched.local = None
    assert len(keys) and want[1].all()
    assert all((x == y).all() for x, y in zip(fetched.find(keys, [""]), want[1:], strict=True))


def test_a_process_maps_a_bounded_number_of_files(tmp_path):
    import os
    import resource

    from hearsay import arrays as a

    assert a.MAPPED_FILES <= resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 2
    bits, most = 14, a._mapped.cache_info().maxsize
    for shard in range(-(2**13), 2**13):
        np.save(f"{tmp_path}/t~{shard}~0.npy", np.array([shard << (64 - bits)]))
    held = len(os.listdir("/proc/self/fd"))
    keys = np.arange(-(2**13), 2**13) << (64 - bits)
    assert a.Arrays(str(tmp_path), "t", bits).find(keys, [""])[0].all()
    assert len(os.listdir("/proc/self/fd")) - held <= most
