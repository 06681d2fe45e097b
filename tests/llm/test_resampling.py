"""Importance resampling against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stopwise.llm.queries import QUERIES
from stopwise.llm.resampling import bucket_counts, resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(text, longest=2, buckets=10_000):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def expected(docs, items):
    """(doc_id, n_features, weight, score, rank) of all documents."""
    here, there = Counter(), Counter()
    for _, text in docs:
        here.update(features(text)[1])
    for text in items:
        there.update(features(text)[1])
    s, t = sum(here.values()), sum(there.values())
    gain = [math.floor(1000 * math.log((there[b] + 1) * (s + 10_000) / ((here[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows, enough = [], []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score))
        if n >= 20:
            enough.append((-score, doc_id))
    drawn = sorted(enough)[: 25 * len(enough) // 100]
    rank = {doc_id: i + 1 for i, (_, doc_id) in enumerate(drawn)}
    return sorted((*r, rank.get(r[0])) for r in rows)


def test_query_equals_brute_force(spark, documents, tmp_path):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    shared = "A line that many texts share, word for word, and more than once\n"
    docs += [(5_000 + i, f"{shared}\n\n{'. ' * (i % 3)}{i}\n{shared}{i % 7}\nÉté 7\x0bb\n") for i in range(200)]
    docs += [(9_001, None), (9_002, ""), (9_003, "\n\n..."), (9_004, "one\ntwo\nthree"), (9_005, "x " * 20_000)]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, shared]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in items], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ours = sorted(tuple(r) for r in QUERIES["op12_target_resampling"](spark, str(tmp_path)).collect())
    assert ours == expected(docs, items)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_across_short_lines_are_counted(spark, longest):
    texts = ["a\nb\n\nc d\ne", "a b\nc", "a\nb\n\nc d\ne", None, "\n", "A,b\n-\n...\nC"]
    found = bucket_counts(spark.createDataFrame([(t,) for t in texts], "text string"), longest=longest, buckets=50)
    plain = Counter(b for t in texts for b in features(t, longest, 50)[1])
    assert {r.bucket: r.n for r in found.collect()} == dict(plain)


def test_ranks_are_gapless_and_favour_the_target(spark):
    rows = [(i, ("alpha beta gamma " if i % 5 == 0 else f"noise{i % 11} more{i % 13} ") * 12) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([("alpha beta gamma " * 50,)], "text string")
    drawn = resample(docs, target).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in drawn] == list(range(1, 501))
    assert [r.score for r in drawn] == sorted((r.score for r in drawn), reverse=True)
    # A draw without weights would take 100 of these 400.
    assert sum(r.doc_id % 5 == 0 for r in drawn) > 200


def test_no_rows_are_drawn_without_enough_words(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    found = resample(docs, docs.where("1 = 0")).collect()
    assert [r["rank"] for r in found] == [None, None] and {r.n_features for r in found} == {0, 5}


def test_equal_scores_go_to_the_smaller_key(spark):
    docs = spark.range(40).select((F.col("id") % 20).alias("doc_id"), F.lit("w " * 30).alias("text"))
    found = resample(docs, docs).where("rank is not null").orderBy("rank").collect()
    assert len(found) == 10 and [r.doc_id for r in found[::2]] == [r.doc_id for r in found[1::2]]
