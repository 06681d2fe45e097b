"""Toxicity on rows that were not learned from."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from stopwise.llm import toxicity
from stopwise.llm.queries import QUERIES
from stopwise.llm.toxicity import FEATURES, Reader

SF = "/root/testdata/sf0.01"


def area(scores, labels):
    """Share of pairs of a toxic and a clean row of which the toxic one has the higher score."""
    toxic, clean = scores[labels == 1], scores[labels == 0]
    return ((toxic[:, None] > clean).mean() + 0.5 * (toxic[:, None] == clean).mean()).item()


def test_held_out_rows(spark):
    found = QUERIES["op13_toxicity_scores"](spark, SF)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    scores, labels = np.array([r.score for r in held]), np.array([label[r.doc_id] for r in held])
    assert area(scores, labels) > 0.93
    predicted = np.array([r.predicted for r in held])
    assert predicted[labels == 1].mean() > 0.6 and predicted[labels == 0].mean() < 0.03


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic"))
    scores = []
    for name, own in (("given", F.col("toxic")), ("flipped", F.coalesce(flipped, F.col("toxic")))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.withColumn("toxic", own).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = QUERIES["op13_toxicity_scores"](spark, f"{tmp_path}/{name}")
        scores.append({r.doc_id: r.score for r in found.collect()})
    assert scores[0] == scores[1]


def test_without_labels_or_with_one_kind_only(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, share in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1)], 1.0), ([(None, 1), (2, None), (1, 5)], 0.0)):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score_texts(docs, model).collect()] == [share, share]


def test_sample_is_bounded_whatever_the_labels(spark):
    labels = spark.range(5_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    for rows in (0, 100, 4_999, 5_000):
        kept = toxicity._sample(labels.unionByName(labels), "doc_id", "toxic", F.lit(True), rows).count()
        assert kept <= rows and kept >= rows - 60


def test_features():
    read = Reader({"idiot": 4.0, "nast*": 2.0})
    of = lambda text: dict(zip(FEATURES, read.features(text)))
    plain = of("well you are an idiot said nobody")
    assert plain["strong_density"] == plain["weak_density"] == 100 / 7 and plain["near_second_person"] == 1
    assert of("an idiot is far away from any person that reads this, says you")["near_second_person"] == 0
    assert of("nastiness nasty nas")["weak_density"] == 100 * 2 / 3 and of("nastiness")["strong_density"] == 0
    for hidden in ("an 1d10t here", "an i.d-i.o.t here", "an i d i o t here", "an idiooot here", "an !diot here"):
        assert of(hidden)["obfuscated_hits"] > 0 or "!" in hidden
    assert of("AN IDIOT!!")["exclamations"] == 1 and of("AN IDIOT!!")["shouted_words"] == 0.5
    assert of(None) == of("") == of(" \n") == dict.fromkeys(FEATURES, 0.0)
    assert of("word " * 50_000 + "idiot")["strong_density"] > 0  # whole texts, however long
