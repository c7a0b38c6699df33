"""Key ranges of a table's files, so that an insert opens only files that may hold its keys.

Beside a keyed table lies a small one, ``<table>__key_ranges``: file, least and greatest key. It only says which files need not
be opened: a file it does not name is always read, what it says of files that are gone is ignored, and the
table may be written by others. So losing it, or a crash between the table's files and their ranges, costs time and never rows.
Keys that rise with time (as ids of posts and comments do) leave old files alone however many there are.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.session import discard
from hearsay.sources import tables

MAX_FILES = 100_000  # names the driver goes through; a table of more is read whole
MAX_RANGE_FILES = 16
KEY_KINDS = ("string", "bigint", "int")


def ranges_of(table: str) -> str:
    return f"{table}__key_ranges"


def stored_files(spark: SparkSession, table: str) -> list[str]:
    """The names of the table's files now (each write gives its own): a listing, nothing is opened."""
    spark.catalog.refreshTable(table)
    return sorted({path.rsplit("/", 1)[-1] for path in spark.table(table).inputFiles()})


def unnoted(spark: SparkSession, table: str) -> list[str]:
    """Files of the table without a noted range; too many to go through are left unnoted."""
    files, ranges = stored_files(spark, table), ranges_of(table)
    if len(files) > MAX_FILES or not spark.catalog.tableExists(ranges):
        return files if len(files) <= MAX_FILES else []
    spark.catalog.refreshTable(ranges)
    noted = {r.file for r in spark.table(ranges).select("file").collect()}
    return [f for f in files if f not in noted]


def read_files(spark: SparkSession, table: str, files: Sequence[str], *columns: Column | str) -> DataFrame:
    """The named columns of some of the table's files: Spark leaves the others out when it lists them."""
    return spark.table(table).filter(F.col("_metadata.file_name").isin(list(files))).select(*columns)


def _location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").select("data_type").first()[0]


def _range_rows(spark: SparkSession, table: str, key: str, files: Sequence[str]) -> DataFrame:
    rows = read_files(spark, table, files, F.col("_metadata.file_name").alias("file"), F.col(key).alias("k"))
    ends = rows.groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("greatest"))
    # files without rows are named too, with no range
    return spark.createDataFrame([(f,) for f in files], "file string").join(ends, "file", "left")


def add_ranges(spark: SparkSession, table: str, key: str, files: Sequence[str]) -> None:
    """Note the ranges of new files. Their own small files are brought together once there are many."""
    if not files:
        return
    ranges = ranges_of(table)
    tables.append(_range_rows(spark, table, key, files).coalesce(1), ranges)
    if len(stored_files(spark, ranges)) > MAX_RANGE_FILES:
        kept = spark.table(ranges).dropDuplicates(["file"]).coalesce(1)
        old = _location(spark, ranges)
        tables.replace(kept, ranges, f"{_location(spark, table).rstrip('/')}__ranges")
        discard(spark, old)  # only the one writer reads ranges


def _cell(key: Column, edges: Column, n: int) -> Column:
    """Where a key lies among ``n`` sorted edges: ``2 i`` at edge i, ``2 i + 1`` above it, ``-1`` below all; by halving."""
    steps = [1 << i for i in reversed(range(max(1, math.ceil(math.log2(n + 1)))))]
    below = F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, width: F.when((at + width <= n) & (F.get(edges, at + width - 1) <= key), at + width).otherwise(at),
    )
    return F.when(below == 0, F.lit(-1)).otherwise(2 * (below - 1) + F.when(F.get(edges, below - 1) == key, 0).otherwise(1))


def files_that_may_hold(keys: DataFrame, table: str, key: str) -> list[str] | None:
    """Files of ``table`` whose range holds one of ``keys``, and those of unknown range; ``None`` if all must be read (other kinds of keys too).

    Each key finds its place among the sorted ends of the ranges in about log2(files) comparisons, in its own task; the
    distinct places, at most twice the number of files, come to the driver, which holds the names of the files already.
    """
    spark = keys.sparkSession
    files = stored_files(spark, table)
    ranges = ranges_of(table)
    kind = spark.table(table).schema[key].dataType.simpleString()
    if kind not in KEY_KINDS or len(files) > MAX_FILES or not spark.catalog.tableExists(ranges):
        return None
    spark.catalog.refreshTable(ranges)
    there = set(files)
    known = {r.file: (r.least, r.greatest) for r in spark.table(ranges).collect() if r.file in there}
    if not known:
        return None
    found = sorted({end for ends in known.values() for end in ends if end is not None})
    if not found:
        return [f for f in files if f not in known]
    edges = F.from_json(F.lit(json.dumps(found)), f"array<{kind}>")  # a constant of bounded size
    cells = keys.filter(F.col(key).isNotNull()).select(_cell(F.col(key), edges, len(found)).alias("cell")).distinct()
    hit = sorted(r.cell for r in cells.collect())

    def holds(file: str) -> bool:
        least, greatest = known.get(file, (found[0], found[0]))
        if least is None:  # no keys, or null ones
            return False
        first, last = 2 * bisect_left(found, least), 2 * bisect_left(found, greatest)
        at = bisect_left(hit, first)
        return at < len(hit) and hit[at] <= last

    picked = [f for f in files if f not in known or holds(f)]
    return None if len(picked) == len(files) else picked
