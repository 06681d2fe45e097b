"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from stopwise.llm import (
    decontaminate,
    licenses,
    mixing,
    ngrams,
    pages,
    periodicity,
    quality,
    resampling,
    sharding,
    simhash,
    substrings,
    toxicity,
    wordpieces,
)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def benchmark(spark):
    rows = [(1, "three four five"), (1, "three four five"), (None, "word1 the1"), (2, None), (3, "...")]
    return spark.createDataFrame(rows, "item_id long, text string")


def labelled(spark):
    return spark.createDataFrame([(0, 0), (2, 0), (3, 0), (3, 1), (4, 1), (4, 1), (None, 1), (7, None)], "doc_id long, toxic int")


OPERATORS = {
    "tokens": (lambda df: wordpieces.count_tokens(df, VOCABULARY), "n_tokens", 0),
    "pages": (lambda df: pages.main_text(df.withColumn("url", F.lit(None).cast("string")), page="text"), "text", ""),
    "substrings": (lambda df: substrings.repeated_substrings(df, length=20, gram=8), "n_removed", 0),
    "quality": (quality.judge, "kept", False),
    "simhash": (simhash.near_duplicates, "fingerprint", "0" * 16),
    "sharding": (lambda df: sharding.shard(df, shards=3), "size", 1),
    "ngrams": (lambda df: ngrams.score_texts(df, block_text=1000), "n_tokens", 1),
    "mixing": (mixing.mix, "taken", 0),
    "decontaminate": (lambda df: decontaminate.find_contamination(df, benchmark(df.sparkSession)), "n_hit", 0),
    "licenses": (licenses.scan, "labels", ""),
    "periodicity": (periodicity.find_runs, "collapsed", ""),
    "resampling": (lambda df: resampling.resample(df, benchmark(df.sparkSession)), "n_features", 0),
    "toxicity": (lambda df: toxicity.score_texts(df, toxicity.learn(df, labelled(df.sparkSession))), "predicted", 0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    operator, column, of_null = OPERATORS[name]
    found = operator(odd).collect()
    assert len(found) == odd.count()
    values = [r[column] for r in found if r["source"] == "s" and r["doc_id"] in (0, 1)]
    assert values == [of_null, of_null]
    assert {r["given"] for r in found} == {r["given"] for r in odd.select("given").collect()}
    copies = [r[column] for r in found if r["doc_id"] in (2, 3)]
    assert len(copies) == 3 and (name in ("mixing", "quality") or len(set(copies)) == 1)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    operator, column, _ = OPERATORS[name]
    found = operator(empty)
    assert column in found.columns and found.count() == 0
