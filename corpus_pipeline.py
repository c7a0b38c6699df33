"""From the documents table to packed training sequences, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. Rows with nulls stay unless a stage rejects them
for its own reason; empty tables pass through.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.llm import jaccard, mixing, packing, substrings, toxicity
from hearsay.llm.common import global_positions, step, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TARGETS: dict[str, float] | None = None  # weights by source; None tempers their sizes
SEGMENT_DOCS = 1 << 14


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely toxic than not go. The model learns from the whole ``documents`` table and ``labels``."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.rate(docs.select(*COLUMNS), model).filter(~F.col("toxicity.toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram similarity, that of the smallest id stays.

    Documents without an id or without words are in no group and stay. Rows that share an id are compared by their texts like any others (of
    linked ones under the smallest id, that of the least text hash stays); rows equal in id and text stay once.
    """
    keyed = docs.select(*COLUMNS).withColumn("own_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    named = keyed.filter("doc_id is not null")
    per_id = named.groupBy("doc_id").agg(F.min("own_hash").alias("a"), F.max("own_hash").alias("b"), F.count(F.lit(1)).alias("n"))
    most, reused = per_id.agg(F.max("n"), F.max((F.col("a") < F.col("b")).cast("int"))).first()
    if reused:  # several texts under one id: each (id, text) is compared under a number of its own, in the same order
        kinds = step(named.groupBy("doc_id", "own_hash").agg(F.count(F.lit(1)).alias("n")).drop("n"), "kinds")
        numbers = step(global_positions(kinds, ["doc_id", "own_hash"]), "numbers")
        texts = named.select("doc_id", "own_hash", "text").join(numbers, ["doc_id", "own_hash"])
        compared = step(texts.select(F.col("position").alias("doc_id"), "text"), "compared")
        kept = jaccard.jaccard_groups(compared).filter("class_id = doc_id").select(F.col("doc_id").alias("position"))
        keep = kept.join(numbers, "position").select(F.col("doc_id").alias("kept_id"), F.col("own_hash").alias("kept_hash"))
    else:
        groups = jaccard.jaccard_groups(docs).filter("class_id = doc_id")
        keep = groups.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    keep = step(keep, "keep")
    kept = named.join(keep, (F.col("doc_id") == F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash")), "left_semi")
    if (most or 0) > 1:  # some id is repeated
        kept = kept.dropDuplicates(["doc_id", "own_hash"])
    return kept.select(*COLUMNS).unionByName(keyed.filter("doc_id is null").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id holds too are cut out. A text that loses words is its other
    words joined by one space; any other text stays as it is. ``n_chars`` follows the text.
    """
    others = docs.select(*COLUMNS).withColumn("no_text", F.col("text").isNull())
    found = substrings.repeats(others, carry=("lang", "source", "n_chars", "no_text"), clean_as_is=True)
    lost = F.col("n_removed") > 0
    return found.select(
        "doc_id", F.when(~F.col("carried.no_text"), F.col("kept")).alias("text"),
        F.col("carried.lang").alias("lang"), F.col("carried.source").alias("source"),
        F.when(lost, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: the files written from this hold it from the first part to the last."""
    # rows that are the same in all of these come at one place
    placed = mixing.mix(docs, TARGETS).filter("copy = 0").select(
        F.col("doc_id").alias("at_id"), F.col("text_hash").alias("at_hash"), F.col("source").alias("at_source"), "position"
    )
    placed = step(placed, "placed")
    keyed = docs.select(*COLUMNS).withColumn("own_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("own_hash") == F.col("at_hash")
    for ours, theirs in (("doc_id", "at_id"), ("source", "at_source")):
        same = same & F.col(ours).eqNullSafe(F.col(theirs))
    return keyed.join(placed, same).orderBy("position").select(*COLUMNS)


def in_written_order(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` as read from files, and each row's place in them: from the first part to the last, in each from its first row on.

    Rows that no files hold are all at place 0.
    """
    try:
        rows = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs, F.lit(0).cast("long")
    part = F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1)
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.expr("try_cast(__part as long)"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file, so the window and the broadcast are as small as their number
    bases = files.withColumn("__part", part).select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(bases), "__file"), F.col("__base") + F.col("__row")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with the checksum of their ids.

    The mixture is cut into segments of ``SEGMENT_DOCS`` documents, each with the target shares, and the curve orders the
    documents of a segment: so sequences follow the mixture from segment to segment, and hold neighbours of the curve.
    """
    rows, place = in_written_order(docs)
    segment = F.floor(place / SEGMENT_DOCS)
    return packing.digest(packing.pack(rows, packing.tokenizer_path(), segment=segment))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = step(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
