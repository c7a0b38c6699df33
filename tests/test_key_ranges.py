"""Inserts that open only files whose key range holds a new key."""

import uuid

import pytest
from pyspark.sql import functions as F

from hearsay.operators import upsert
from hearsay.session import scratch_path
from hearsay.sources import key_ranges, tables


def _table(spark, buckets=None, kind="string"):
    database = f"t{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, database)}'")
    clause = f" CLUSTERED BY (k) INTO {buckets} BUCKETS" if buckets else ""
    spark.sql(f"CREATE TABLE {database}.rows (k {kind}, v bigint) USING parquet{clause}")
    return f"{database}.rows"


def _batch(spark, numbers, v=0):
    return spark.createDataFrame([(f"{n:06d}", v + n) for n in numbers], "k string, v long")


@pytest.mark.parametrize("buckets", [None, 3])
def test_files_opened_do_not_grow_with_the_table(spark, buckets, monkeypatch):
    monkeypatch.setattr(key_ranges, "MAX_RANGE_FILES", 3)
    name = _table(spark, buckets)
    opened, stored = [], []
    for batch in range(8):  # ids rise; each batch repeats the last ten of the batch before
        rows = _batch(spark, range(max(0, batch * 100 - 10), batch * 100 + 100))
        picked = key_ranges.files_that_may_hold(rows, name, "k")
        stored.append(len(key_ranges.stored_files(spark, name)))
        opened.append(stored[-1] if picked is None else len(picked))
        assert upsert.insert_by_ranges(rows, name, "k").added == 100
    assert max(opened) <= max(opened[1:4]) and stored[-1] >= 6 * stored[1]
    assert len(key_ranges.stored_files(spark, key_ranges.ranges_of(name))) <= key_ranges.MAX_RANGE_FILES
    assert sorted(r.k for r in spark.table(name).collect()) == [f"{n:06d}" for n in range(800)]
    one = key_ranges.read_files(spark, name, key_ranges.stored_files(spark, name)[:1], "k")
    one._jdf.queryExecution().toRdd().count()
    leaf = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().get("numFiles").get().value() == 1
    # one late row opens the files around it and no others
    late = key_ranges.files_that_may_hold(_batch(spark, [250, 799]), name, "k")
    assert len(late) <= 2 * max(opened[1:4])
    assert key_ranges.files_that_may_hold(_batch(spark, [9999]), name, "k") == []
    assert upsert.insert_by_ranges(_batch(spark, [250, 799]), name, "k").added == 0


def test_same_rows_as_the_plain_insert_whatever_others_write(spark):
    name, plain = _table(spark), _table(spark)
    steps = [range(0, 50), range(300, 340), [3, 7, 310, 500, 501], range(20, 330, 7), []]
    for i, numbers in enumerate(steps):
        rows = _batch(spark, numbers, v=i * 10_000)
        rows = rows.union(_batch(spark, numbers, v=i * 10_000 + 5)).union(spark.createDataFrame([(None, 1)], "k string, v long"))
        got = upsert.insert_by_ranges(rows, name, "k", ["v"])
        assert got == upsert.insert_or_ignore(rows, plain, "k", ["v"])
        if i == 1:  # another writer, unseen by the ranges
            for t in (name, plain):
                tables.append(_batch(spark, range(500, 502), v=7), t)
        if i == 2:  # ranges lost
            tables.drop(spark, key_ranges.ranges_of(name))
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, spark.table(plain).collect()))
    assert upsert.insert_by_ranges(_batch(spark, range(0, 20)), name, "k").added == 0


def test_places_among_edges_are_exact(spark):
    edges = [2, 3, 5, 8, 13]
    rows = spark.range(0, 16)
    held = F.lit(edges)
    for n in range(1, 6):
        got = {r.id: r.cell for r in rows.select("id", key_ranges._cell(F.col("id"), held, n).alias("cell")).collect()}
        for k in range(16):
            below = [i for i, e in enumerate(edges[:n]) if e <= k]
            assert got[k] == (-1 if not below else 2 * below[-1] + (edges[below[-1]] != k))


def test_null_keys_numbers_and_stale_ranges(spark):
    name = _table(spark, kind="bigint")
    tables.append(spark.createDataFrame([(None, 1)], "k long, v long"), name)
    rows = spark.createDataFrame([(n, n) for n in (-5, 0, 7)], "k long, v long")
    assert upsert.insert_by_ranges(rows, name, "k").added == 3
    assert key_ranges.files_that_may_hold(rows.filter("k = 100"), name, "k") == []
    # ranges of files that are gone are ignored
    tables.replace(spark.table(name).filter("k <> 0"), name, scratch_path(spark, "versions"))
    assert upsert.insert_by_ranges(rows, name, "k").added == 1
    assert sorted(r.k for r in spark.table(name).filter("k is not null").collect()) == [-5, 0, 7]
