"""A small English word list to start with: (token, valence), valences between -4 and 4."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession

BY_VALENCE = {
    3.0: "superb wonderful brilliant excellent delightful outstanding marvellous adore love perfect magnificent",
    2.0: "good happy great enjoy enjoyed pleasant friendly lovely nice kind thanks thank helpful praise proud success charming cheerful beautiful",
    1.0: "okay fine calm clean clear easy fair fresh hope like ready safe smooth support useful warm welcome working works",
    -1.0: "late loud slow odd dull doubt lack limited miss missing noisy rough tired unclear unsure weak",
    -2.0: "bad sad angry annoying boring broken cold complaint confusing dirty fail failed fault lost mess mistake poor problem rude sour ugly unhappy useless worry wrong",
    -3.0: "awful cruel disaster disgusting dreadful hate horrible nasty terrible vile worst worthless miserable",
}


def word_list(spark: SparkSession) -> DataFrame:
    rows = [(word, valence) for valence, words in BY_VALENCE.items() for word in words.split()]
    return spark.createDataFrame(rows, "token string, valence double")


def read_word_list(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A file of lines ``token<tab>valence``; more fields are ignored, and so are lines without a number."""
    lines = spark.read.text(path).selectExpr(f"split(value, '{separator}') as f")
    return lines.selectExpr("trim(get(f, 0)) as token", "try_cast(trim(get(f, 1)) as double) as valence").filter(
        "token <> '' and valence is not null"
    )


def stop_words() -> list[str]:
    """Spark's own English stop words, for ``clean_tokens(stop_words=...)``; the default there stays its short list."""
    return StopWordsRemover.loadDefaultStopWords("english")
