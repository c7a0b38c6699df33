"""Catalogue tables: create, scan, append, replace, list, drop, export.

Keyed tables may be bucketed by their key, so that the check for stored keys reads the table where
it lies instead of shuffling it. Comments are bucketed by their own key, not by post: one post
may own a third of them, and its bucket would be as large.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay import schemas

BUCKET_BYTES = 512 << 20


def buckets_for(table_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets a table of this size should have: each a task's worth."""
    return max(1, -(-table_bytes // bucket_bytes))


def create_tables(spark: SparkSession, database: str, location: str, buckets: int | None = None) -> None:
    """Create the database and its two keyed tables where they do not exist yet.

    ``buckets`` follows from the size a table is expected to reach (``buckets_for``). Without it the tables are
    not bucketed: an insert then shuffles the stored keys, and only those, in as many tasks as their size needs.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name, schema, key in (
        ("posts", schemas.POSTS, schemas.POSTS_KEY),
        ("comments", schemas.COMMENTS, schemas.COMMENTS_KEY),
    ):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        clause = f" CLUSTERED BY ({key}) INTO {buckets} BUCKETS" if buckets else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{clause}")


def bucket_count(spark: SparkSession, table: str) -> int | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Num Buckets'").select("data_type").head(1)
    return int(rows[0][0]) if rows and int(rows[0][0]) > 0 else None


def scan(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def scan_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def keys(spark: SparkSession, table: str, key: str) -> DataFrame:
    """Stored keys as a DataFrame; only that column is read and nothing is collected."""
    return spark.table(table).select(key)


def append(df: DataFrame, table: str, sort_by: str | None = None) -> None:
    """Append by column name; rows of a bucketed table are brought to their bucket first.

    With ``sort_by`` files are sorted by that column, and those of a table without buckets hold a range of it each.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        df.write.saveAsTable(table)
        return
    target = spark.table(table)
    ordered = df.select(target.columns)
    buckets = bucket_count(spark, table)
    if buckets:
        key = [c.name for c in spark.catalog.listColumns(table) if c.isBucket]
        ordered = ordered.repartition(buckets, *key)
    elif sort_by:
        ordered = ordered.repartitionByRange(F.col(sort_by))
    (ordered.sortWithinPartitions(sort_by) if sort_by else ordered).write.insertInto(table)


def replace(df: DataFrame, table: str, location: str) -> str:
    """Write a new version beside the old one, then point the table at it in one step.

    A bucketed table keeps its buckets. The frame may read the very table it replaces: its files stay
    until someone removes them. A table of other columns is dropped and made anew.
    """
    spark = df.sparkSession
    name = f"{table.split('.')[-1]}-{uuid.uuid4().hex}"
    path = f"{location.rstrip('/')}/{name}"
    there = spark.catalog.tableExists(table)
    buckets = bucket_count(spark, table) if there else None
    same = there and [(f.name, f.dataType) for f in spark.table(table).schema] == [(f.name, f.dataType) for f in df.schema]
    if buckets and same:
        key = [c.name for c in spark.catalog.listColumns(table) if c.isBucket]
        written = f"{table}__{uuid.uuid4().hex}"
        df.repartition(buckets, *key).write.option("path", path).bucketBy(buckets, *key).saveAsTable(written)
        drop(spark, written)  # the entry only: the files lie outside the catalogue's folder
    else:
        df.write.parquet(path)
    if same:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
    else:
        drop(spark, table)
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{path}'")
    return path


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Names of the database's tables, sorted."""
    return spark.sql(f"SHOW TABLES IN {database}").filter(~F.col("isTemporary")).select(
        F.col("tableName").alias("name")
    ).orderBy("name")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; line breaks and quotes inside texts survive the round trip."""
    df.write.option("header", True).option("escape", '"').csv(path)


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
    return reader.csv(path)
