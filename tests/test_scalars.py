import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hearsay.functions import scalars
from hearsay.functions.aggregates import safe_weighted_mean


def test_labels_are_strict_and_missing_is_neutral(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0501,), (-0.0501,), (math.nan,), (None,)], "s double")
    got = [r[0] for r in df.select(scalars.label_sentiment("s")).collect()]
    assert got == ["neutral", "neutral", "positive", "negative", "neutral", "neutral"]
    assert [r[0] for r in df.select(scalars.label_score("s")).collect()] == ["mostly " + g for g in got]


@pytest.mark.parametrize("rows, want", [
    ([(1.0, 0.0), (3.0, 0.0)], 2.0),
    ([(1.0, -2.0), (3.0, 1.0)], 2.0),
    ([(1.0, -1.0), (3.0, 3.0)], 4.0),
    ([(1.0, 1.0), (None, 3.0)], None),
    ([(1.0, 0.0), (None, 0.0)], 1.0),
    ([(math.nan, 0.0), (3.0, 0.0)], 3.0),
    ([(1.0, None), (3.0, 3.0)], 2.0),
    ([], None),
])
def test_safe_weighted_mean(spark, rows, want):
    df = spark.createDataFrame(rows, "v double, w double")
    assert df.agg(safe_weighted_mean("v", "w")).first()[0] == want


def test_bytes(spark):
    blobs = [bytes.fromhex(h) for h in ("0A00000000000000", "FDFFFFFFFFFFFFFF", "FD", "0100", "")]
    df = spark.createDataFrame([(b,) for b in blobs] + [(None,)], "b binary")
    signed = [r[0] for r in df.select(scalars.bytes_to_long("b")).collect()]
    assert signed == [10, -3, 253, 1, 0, None]
    assert df.select(scalars.bytes_to_long("b", unsigned=True)).collect()[1][0] == Decimal(2**64 - 3)


def test_casts(spark):
    df = spark.createDataFrame([("12.0",), (" 7 ",), ("abc",), (None,)], "x string")
    assert [r[0] for r in df.select(scalars.to_long("x")).collect()] == [12, 7, None, None]
    big = spark.createDataFrame([(2**53 + 1,)], "x bigint")
    assert big.select(scalars.to_long("x", "bigint")).first()[0] == 2**53 + 1


def test_epochs(spark):
    df = spark.createDataFrame([("0",), ("1700000000",), ("x",), ("1e18",)], "e string")
    assert [r[0] for r in df.select(scalars.epoch_to_iso("e")).collect()] == [
        "1970-01-01T00:00:00Z", "2023-11-14T22:13:20Z", None, None]
    assert [r[0] is None for r in df.select(scalars.listing_timestamp("e")).collect()] == [True, False, True, True]


def test_effective_negativity_ends(spark):
    df = spark.createDataFrame([(0.4, 0.0), (0.4, 1.0)], "raw double, p double")
    plain, full = [r[0] for r in df.select(scalars.effective_negativity("raw", "p")).collect()]
    assert plain == 0.4 and full == pytest.approx(0.35 * 0.4 + 0.10)


def test_softmax_sums_to_one_even_for_large_logits(spark):
    df = spark.createDataFrame([(1000.0, 999.0, -5.0)], "a double, b double, c double")
    row = df.select(*scalars.softmax("a", "b", "c")).first()
    assert sum(row) == pytest.approx(1.0) and row[0] > row[1] > row[2]


def test_row_mean_and_weights(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(scalars.row_mean("a", "b")).collect()] == [1.0, None, 1.5]
    raw = spark.createDataFrame([("-3",), ("x",), (None,), ("4",)], "s string")
    assert [r[0] for r in raw.select(scalars.clip_weight("s")).collect()] == [0.0, 0.0, 0.0, 4.0]


def test_complaint_gate_is_strict_and_skips_nan(spark):
    df = spark.createDataFrame([(0.2,), (0.21,), (math.nan,), (None,)], "s double")
    assert [r.s for r in df.filter(scalars.is_complaint("s")).collect()] == [0.21]


def test_parse_date_reads_both_forms(spark):
    df = spark.createDataFrame([("2023-11-14T22:13:20Z",), ("2023-11-14 22:13:20",), ("soon",)], "d string")
    got = [r[0] for r in df.select(F.date_format(scalars.parse_date("d"), "HH:mm")).collect()]
    assert got == ["22:13", "22:13", None]


def test_blobs_longer_than_a_number_are_null(spark):
    df = spark.createDataFrame([(bytes(range(1, 10)),), (bytes([7]),), (b"",), (None,)], "b binary")
    rows = df.select(scalars.bytes_to_long("b").alias("s"), scalars.bytes_to_long("b", unsigned=True).cast("string").alias("u")).collect()
    assert [(r.s, r.u) for r in rows] == [(None, None), (7, "7"), (0, "0"), (None, None)]
