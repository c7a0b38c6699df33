"""Shards against a plain ranking in memory."""

import hashlib
import zlib
from collections import Counter

import pytest

from hearsay import session
from hearsay.llm import common, sharding
from hearsay.operators import skew


def draw(*what):
    return int(hashlib.md5(":".join(what).encode()).hexdigest()[:12], 16) / 2**48


def brute(rows, n_shards, seed="shards"):
    made = []
    for i, text, source in rows:
        data = (text or "").encode()
        crc = zlib.crc32(data)
        made.append((source or "", draw(seed, "" if i is None else str(i), str(crc)), (i is not None, i or 0), crc, len(data) + 1))
    by_source = {}
    for row in sorted(made):
        by_source.setdefault(row[0], []).append(row)
    placed = []
    for source, own in by_source.items():
        phase = draw(seed, "source", source)
        placed += [((rank + phase) / len(own), *row[1:], source) for rank, row in enumerate(own)]
    out, n, used = Counter(), len(rows), Counter()
    for position, (_, _, (known, i), crc, size, _) in enumerate(sorted(placed)):
        shard = position * n_shards // n
        out[(i if known else None, size, crc, shard, used[shard])] += 1
        used[shard] += 1
    return out


def frame(spark, rows):
    rows = [(*r, "de", 3, 1, 1) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int, slot int, copies int")


ROWS = [(i, f"text {i % 90} é", "abcd"[min(i % 7, 3)] if i % 50 else f"rare{i}") for i in range(700)]
ROWS += [(None, "no id", "a"), (None, "no id", "a"), (3, None, "a"), (3, "", None), (3, "", ""), (3, "", ""), (5, "other", "a"), (5, "ü" * 40_000, "b")]


@pytest.mark.parametrize("n_shards", [1, 7, 16])
def test_equals_plain_ranking(spark, n_shards):
    out = sharding.shards(frame(spark, ROWS).repartition(5), n_shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out) == brute(ROWS, n_shards)
    assert len({(r.doc_id, r.text_hash, r.source, r["copy"]) for r in out}) == len(ROWS)


def test_every_shard_holds_the_mixture(spark):
    sizes = {"big": 3000, "mid": 800, "low": 160, **{f"one{i}": 1 for i in range(300)}}
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    out = sharding.shards(frame(spark, rows), 16).toPandas()
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for source in ("big", "mid", "low"):
        held = out[out.source == source].groupby("shard").size()
        assert len(held) == 16 and (held - sizes[source] / 16).abs().max() <= 1 + sizes[source] / len(rows) * 40
    ones = out[out.source.str.startswith("one")].groupby("shard").size()
    assert len(ones) == 16 and ones.max() < 45  # spread, not gathered in the middle
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)


def test_same_again_and_other_seeds(spark):
    df = frame(spark, ROWS)
    runs = [set(map(tuple, sharding.shards(d, 4, seed).collect())) for d, seed in ((df.repartition(9), "x"), (df.coalesce(1), "x"), (df, "y"))]
    assert runs[0] == runs[1] != runs[2]


def test_few_and_no_rows(spark):
    assert sharding.shards(frame(spark, [])).count() == 0
    out = sharding.shards(frame(spark, [(1, "a", "s"), (2, "b", None), (3, None, "s")]), 16).collect()
    assert sorted(r.slot for r in out) == [0, 0, 0] and len({r.shard for r in out}) == 3


def test_few_tables_are_staged_and_texts_read_once(spark, monkeypatch, tmp_path):
    shared = tmp_path / "shared"
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(shared))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = frame(spark, ROWS).repartition(5)
    out = sharding.shards(docs.mapInArrow(counted, docs.schema), 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out) == brute(ROWS, 4)
    assert sorted(p.name.partition("-")[0] for p in (shared / "hearsay").iterdir()) == ["ranged", "ranged", "sources"]
    assert seen.value == len(ROWS)


def test_sources_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "bounded", lambda df, max_rows: False)
    out = sharding.shards(frame(spark, ROWS).repartition(5), 7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out) == brute(ROWS, 7)


def test_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(common, "COPY_CHUNK", 4)
    df = spark.createDataFrame([("a", 1), ("b", 4), ("c", 9)], "k string, n long")
    out = common.per_copy(df, "n", "copy").groupBy("k").agg({"copy": "collect_set"}).collect()
    assert {r[0]: sorted(r[1]) for r in out} == {"a": [0], "b": [0, 1, 2, 3], "c": list(range(9))}


def test_written_shards_hold_all_rows(spark, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(frame(spark, ROWS), path, 4)
    back = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r.text or "", r.source or "") for r in back) == Counter((i, t or "", s or "") for i, t, s in ROWS)
    for shard in range(4):
        slots = sorted(r.slot for r in back if r["shard"] == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(ROWS) / 4) < 1
