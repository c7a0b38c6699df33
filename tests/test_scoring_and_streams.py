import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.operators import normalize, scoring
from hearsay.plans import cleaning, sarcasm
from hearsay.session import scratch_path
from hearsay.sources import tables
from hearsay.streaming import inserts, rolling

DEMO = [
    "The soup came cold, and the waiter laughed",
    "They open at nine on weekdays.",
    "Lovely bread, warm and fresh!",
    "Cold plates, sour wine.",
]


def test_models_of_the_user_see_whole_preprocessed_texts(spark):
    def three_classes():
        def predict(texts):
            lengths = np.array([len(t) for t in texts], dtype=np.float32)
            return np.stack([lengths / 1000, 1 - lengths / 500, lengths / 1000], axis=1)

        return predict

    def one_class():
        return lambda texts: np.array([[0.25]] * len(texts), dtype=np.float32)

    df = spark.createDataFrame([("1", "see  u/bob"), ("2", "x" * 400)], "id string, t string")
    out = scoring.score_texts(
        df, "t", scoring.BatchScorer(three_classes, scoring.SENTIMENT_COLUMNS), scoring.BatchScorer(one_class, scoring.SARCASM_COLUMNS)
    ).orderBy("id").collect()
    assert out[0].neg_prob == pytest.approx(len("see @user") / 1000) and out[1].neg_prob == pytest.approx(0.4)
    assert all(r.neg_prob + r.neu_prob + r.pos_prob == pytest.approx(1.0) for r in out)
    assert out[0].neg_raw == pytest.approx(0) and out[0].neg_effective == pytest.approx(0.025)


def test_trained_scorers_on_the_demo_sentences(spark):
    train = spark.createDataFrame(
        [("cold sour soup", 0), ("sour wine cold", 0), ("they open weekdays", 1), ("nine", 1), ("lovely warm bread", 2), ("fresh lovely", 2)],
        "text string, label int")
    polarity = scoring.PipelineScorer(scoring.train_classifier(train, "text", "label"), scoring.SENTIMENT_COLUMNS)
    irony = scoring.PipelineScorer(
        scoring.train_classifier(train.withColumn("label", (F.col("label") == 2).cast("int")), "text", "label"), scoring.SARCASM_COLUMNS)
    demo = spark.createDataFrame(list(enumerate(DEMO)), "id int, t string")
    table = scoring.score_column(demo, "t", polarity, irony, keys=["id"])
    assert table.columns == ["id", "text", *scoring.SCORE_COLUMNS]
    rows = table.orderBy("id").collect()
    assert all(r.neg_prob + r.neu_prob + r.pos_prob == pytest.approx(1.0) and 0 <= r.sarcasm_prob <= 1 for r in rows)
    assert rows[2].neg_raw < 0 < rows[3].neg_raw
    assert "Python" not in table._jdf.queryExecution().executedPlan().toString()


def test_result_table_has_its_schema(spark):
    posts = spark.createDataFrame([("1", "t", "b"), ("2", None, "b")], "post_id string, title string, body string").withColumn("date", F.current_timestamp())
    scores = posts.select("post_id", *[F.lit(0.5).alias(c) for c in sarcasm.RESULT_SCORES])
    rows = sarcasm.as_result(sarcasm.result_table(posts, scores)).orderBy("post_id").collect()
    assert [r.full_post for r in rows] == ["t:\nb", None]


def test_accuracy_gain(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 1, 0), (0, 0, 0), (1, 0, None)], "actual int, plain int, better int")
    rows = {r.labelling: r for r in scoring.accuracy(df, "actual", plain="plain", better="better").collect()}
    assert rows["plain"].accuracy == 0.5 and rows["better"].accuracy == 1.0 and rows["better"].gain == 0.5 and rows["better"].n == 3


def test_cleaning_decodes_blobs_and_keeps_raw_text(spark):
    blob = (1700000000).to_bytes(8, "little")
    df = spark.createDataFrame([("c", blob, (5).to_bytes(8, "little"), "The Cats!")], "comment_id string, created_utc binary, score binary, body string")
    row = cleaning.clean_comments(df).withColumn("date", F.date_format("date", "yyyy-MM-dd")).first()
    assert (row.date, row.score, row.body, row.body_clean, row.body_tokens) == ("2023-11-14", 5, "The Cats!", "cats", ["cats"])
    as_text = normalize.lists_to_text(cleaning.clean_comments(df).select("body_tokens"))
    assert as_text.first().body_tokens == "cats"


def test_text_columns_need_no_python_and_no_shuffle(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("post_id"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit(1).alias("score"), F.lit(1).alias("num_comments"), F.lit(5).alias("created_utc"))
    plan = cleaning.clean_posts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


COMMENT = "comment_id string, post_id string, created_utc bigint, body string"


def test_stream_ends_like_the_batch_insert_and_replays_add_nothing(spark):
    database = f"t{uuid.uuid4().hex}"
    tables.create_tables(spark, database, scratch_path(spark, database), buckets=4)
    name, path = f"{database}.comments", scratch_path(spark, "landed")
    rows = [(str(i % 7), "p", 1700000000 + i, f"b{i}") for i in range(20)] + [(None, "p", 1, "x")]
    landed = normalize.conform(spark.createDataFrame(rows, COMMENT), spark.table(name).schema)
    landed.repartition(3).write.parquet(path)

    def run(checkpoint):
        stream = inserts.landed_stream(spark, path, landed.schema, 1)
        inserts.insert_stream(stream, name, "comment_id", ["created_utc"], checkpoint).awaitTermination()

    run(scratch_path(spark, "stream"))
    assert sorted(r.comment_id for r in spark.table(name).collect()) == [str(i) for i in range(7)]
    run(scratch_path(spark, "stream"))
    assert spark.table(name).count() == 7


def test_daily_sums_roll_up_to_weighted_means(spark):
    df = spark.createDataFrame(
        [("2020-01-01", 1.0, 1.0), ("2020-01-01", 2.0, 3.0), ("2020-01-09", 5.0, 0.0), ("2020-02-01", 1.0, -2.0), ("2020-02-01", 3.0, 1.0), ("2020-03-01", None, 1.0)],
        "d string, v double, w double").withColumn("ts", F.to_timestamp_ntz("d"))
    rows = rolling.roll_up(rolling.daily_sums(df, "ts", "v", "w")).orderBy("month").collect()
    assert [(r.n, r.mean, r.weighted_mean) for r in rows] == [(3, 8 / 3, 7 / 4), (2, 2.0, 2.0), (1, None, None)]


def test_day_stream_counts_late_rows_and_replayed_batches_once(spark):
    rows = [("2020-03-05 10:00:00", 1.0, 1.0), ("2020-03-01 09:00:00", 2.0, 1.0), ("2020-03-05 11:00:00", 3.0, 2.0), ("2020-02-20 00:00:00", 5.0, 1.0), (None, 9.0, 1.0)]
    schema = "at string, v double, w double"
    path, stored, checkpoint = (scratch_path(spark, x) for x in ("landed", "days", "stream"))
    for row in rows:  # a file and a micro-batch each, the oldest last
        spark.createDataFrame([row], schema).withColumn("ts", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(path)
    landed = spark.read.parquet(path)

    def run(name):
        stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(path)
        rolling.store_days(stream, "ts", "v", "w", stored, name).awaitTermination()

    def days():
        return sorted((str(r.day)[:10], r.n, r.total, r.weighted) for r in rolling.stored_days(spark, stored).collect())

    want = [("2020-02-20", 1, 5.0, 5.0), ("2020-03-01", 1, 2.0, 2.0), ("2020-03-05", 2, 4.0, 7.0)]
    run(checkpoint)
    assert days() == want
    run(scratch_path(spark, "stream"))  # every batch again under its number
    assert days() == want


def test_training_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([("good day", 1.0), ("bad day", 0.0), ("a day", 1.0), ("no day", 0.0)], "t string, l double")
    model = scoring.train_classifier(rows.select(seen("t").alias("t"), "l"), "t", "l", features=16, iterations=2)
    assert read.value == 4
    scored = scoring.PipelineScorer(model, ("p",)).score(rows, "t").collect()
    assert all(0 < r.p < 1 for r in scored)
