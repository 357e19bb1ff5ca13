from __future__ import annotations

import pytest

#: Rows with every awkward case: nulls, empty and blank texts, ties, repeated rows, odd characters and a long text.
AWKWARD = [
    (1, "one two three four five six seven", "en", "web"), (2, None, None, None), (None, "text without an id", "en", "web"), (3, "", "fr", None), (4, " \n\t ", None, "web"),
    (5, "one two three four five six seven", "en", "web"), (5, "one two three four five six seven", "en", "web"), (6, "日本語 テキスト 🎉 \x00 é", None, "forum"), (7, "w " * 30_000, "en", "web"),
    (8, "a" * 50_000, "en", "web"), (9, "12 34 !? --", "de", "web"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns whose names operators might use themselves.
CLASHING = ("id", "doc", "node", "chunk", "key", "u", "l", "d", "t", "n", "a", "b", "c", "_k", "_id", "kept", "words", "score", "class_id", "x", "m0", "lead", "row", "gone", "k1", "k2", "th", "pos", "part", "block", "values")


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(AWKWARD, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
