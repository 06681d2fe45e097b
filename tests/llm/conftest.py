import pytest
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"
CLASHES = ("row", "given", "id", "mark", "key", "size", "n_words", "lines", "cell", "label", "a", "kept")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with names the operators use."""
    long = " ".join(f"word{i % 977} the{i % 13}" for i in range(20_000))
    rows = [
        (0, None, "s"),
        (1, "", "s"),
        (2, "one two three four five six", None),
        (2, "one two three four five six", None),
        (3, "one two three four five six", "t"),
        (None, "All Rights Reserved\n\nCC BY general public license", "t"),
        (None, None, None),
        (4, long, "t"),
        (5, long + " end", "t"),
        (6, "a " * 3000, "s"),
        (7, "Été K\n\n\n<b>&amp; \x0b tab", "s"),
    ]
    frame = spark.createDataFrame(
        [Row(doc_id=d, text=t, source=s, **{c: f"{c}-{d}" for c in CLASHES}) for d, t, s in rows],
        "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES),
    )
    return frame


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
