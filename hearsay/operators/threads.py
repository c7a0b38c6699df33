"""Threads from flat replies that name the post or reply they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.skew import lookup_join
from hearsay.session import cut_lineage

OK, ORPHAN, CYCLE = "ok", "orphan", "cycle"


def threads(replies: DataFrame, key: str = "id", parent: str = "parent_id", with_path: bool = False) -> DataFrame:
    """``(key, root, depth, status)`` for every row: the top of its thread and how many steps below that it is.

    A row without a parent is the top of a thread (depth 0). A row whose parent is not there is the top of what hangs below it, and all of that
    is an ``orphan``. Rows that answer each other in a circle, and what hangs below them, are a ``cycle`` and have neither root nor depth.
    ``with_path`` adds the keys from the top down to the row: as long as the row is deep.

    Keys are unique; rows without one are left out. Pointers double their reach in every round, so the rounds are the binary digits of the greatest
    depth. Only rows that have not reached a top go on, and the row they point to is found by ``lookup_join``: a post may own any share of the replies, and
    they are spread over the tasks. A round in which no row reaches a top leaves only circles, and ends it.
    """
    rows = replies.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("up"))
    there = rows.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    found = lookup_join(rows, there, "up", "left", spread_by=["id"])
    top = F.col("there").isNull()
    path = F.when(top, F.array("id")).otherwise(F.array("up", "id"))
    ways = cut_lineage(found.select(
        "id", F.when(top, F.col("id")).otherwise(F.col("up")).alias("to"), F.when(top, 0).otherwise(1).cast("long").alias("depth"),
        top.alias("is_top"), (top & F.col("up").isNotNull()).alias("lost"), *([path.alias("path")] if with_path else []),
    ))
    more = ["path"] if with_path else []
    done = ways.filter("is_top").drop("is_top")
    waiting = ways.filter("not is_top").drop("is_top").withColumn("lost", F.lit(None).cast("boolean"))
    while True:
        # a pointer goes on by that of the row it ends at: to the top, or as far again as it has come
        step = done.unionByName(waiting).select(
            F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("further"), F.col("lost").alias("found"),
            *([F.col("path").alias("above")] if with_path else []),
        )
        whole = [F.concat("above", F.slice("path", 2, F.size("path"))).alias("path")] if with_path else []
        moved = cut_lineage(lookup_join(waiting, step, "to", "inner", spread_by=["id"]).select(
            "id", F.col("next").alias("to"), (F.col("depth") + F.col("further")).alias("depth"), F.col("found").alias("lost"), *whole
        ))
        now, waiting = moved.filter("lost is not null"), moved.filter("lost is null")
        done = done.unionByName(now)
        if now.isEmpty() or waiting.isEmpty():
            break
    kind = rows.schema["id"].dataType
    circles = waiting.select(
        "id", F.lit(None).cast(kind).alias("to"), F.lit(None).cast("long").alias("depth"), "lost",
        *([F.lit(None).cast(f"array<{kind.simpleString()}>").alias("path")] if with_path else []),
    )
    out = done.unionByName(circles)
    status = F.when(F.col("lost").isNull(), CYCLE).when(F.col("lost"), ORPHAN).otherwise(OK)
    return out.select(F.col("id").alias(key), F.col("to").alias("root"), "depth", status.alias("status"), *more)


def thread_sizes(placed: DataFrame) -> DataFrame:
    """Per thread its rows, its depth and the rows at its widest level; counted by level first, so a large thread is no hot key."""
    levels = placed.filter(F.col("root").isNotNull()).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))
    return levels.groupBy("root").agg(F.sum("n").alias("n"), F.max("depth").alias("depth"), F.max("n").alias("widest"))
