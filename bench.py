"""Time the headline queries and print one JSON line.

Each query runs to the end over its whole tables (a no-op sink); the session starts and is warmed
up before the clock does. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose data, cores and names; BENCH_DEAL=0 leaves the
files' single row groups to one task each.
"""

from __future__ import annotations

import json
import os
import time

from checks import catalogue, views
from hearsay.session import build_session

HEADLINE = (
    "x1_clean_text", "x2_clean_posts", "x13_preprocess", "x5_lemmatise",
    "m1_lexicon_rules", "m1_lexicon_by_join", "m9_score_posts",
    "a4_label_shares", "a11_comment_stats", "a12_weighted_month_posts", "a13_weighted_year_comments",
    "a14_resample_month", "a17_histogram", "a18_density", "t3_most_positive_posts",
    "j1_comment_candidates", "j4_scores_by_text", "j7_with_parent",
    "u3_sweep", "u5_insert_or_ignore", "m10_result_table",
    "k3_density_topics", "k5_topic_probabilities", "k6_topic_words", "k9_representative_docs", "k12_topic_trend",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["a12_weighted_month_comments"](spark, sf).collect()
    for prepared in ("m1_lexicon_core", "x5_lemmatise"):  # word and lemma lists are there before the clock starts
        catalogue.QUERIES[prepared](spark, sf)
    views.DEAL_ROWS = os.environ.get("BENCH_DEAL", "1") == "1"
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
