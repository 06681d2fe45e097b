"""Groups of near copies in the quality stage: one document of the group must reach the end of the pipeline."""

import pytest
from pyspark.sql import Row

import corpus_pipeline
from stopwise.llm import quality

GROUP = 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 copies of one text, each with another edited line, number or case, among pages that share a line."""
    root = tmp_path_factory.mktemp("copies")
    rows = []
    for i in range(GROUP):
        lines = [f"line {k} " + " ".join(f"w{(k * 31 + j * 17) % 997}q" for j in range(20)) for k in range(50)]
        at = i % 50
        lines[at] = [lines[at] + f" edit{i}", lines[at] + f" {i}", lines[at].upper()][i % 3]
        rows.append((i, "\n".join(lines)))
    for i in range(30):
        rows.append((1000 + i, "Read more on our site\n" + " ".join(f"{chr(97 + k % 26)}{'xyz'[k % 3] * (i + 1)}{k}" for k in range(80))))
    docs = [Row(doc_id=d, text=t, lang="en", source="h", n_chars=len(t)) for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this is in a text")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_quality_stage_keeps_near_copies_and_cuts_boilerplate(spark, folder):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, given, folder).collect()}
    texts = {r.doc_id: r.text for r in given.collect()}
    assert all(found.get(i) == texts[i] for i in range(GROUP))
    assert all(found[d] == t.split("\n", 1)[1] for d, t in texts.items() if d >= 1000)


def test_one_near_copy_reaches_the_shards(spark, folder):
    found = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert len([d for d in found if d < 1000]) == 1


def test_near_copies_of_one_line_count_once(spark):
    """30 texts that differ in one line all stay whole; so do groups that make up a whole host."""
    common = [" ".join(f"{chr(97 + (k * 7 + j) % 26)}w{k}x{j}" for j in range(12)) for k in range(9)]
    for size in (4, 30):
        rows = [(i, "h", "\n".join([*common, f"edit {chr(97 + i % 26) * (i + 1)} of this text"])) for i in range(size)]
        found = quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
        assert [(r.kept, r.removed_words) for r in found] == [(True, 0)] * size


@pytest.mark.parametrize("size", [15, 2_000])
def test_boilerplate_goes_in_small_and_large_hosts(spark, size):
    """A line of every text, one of a tenth and one of three texts; the last stays."""
    rows = []
    for i in range(size):
        own = [" ".join(f"t{i}n{k}w{j}z" for j in range(30)) for k in range(3)]
        own = [x.translate(str.maketrans("0123456789", "abcdefghij")) for x in own]
        lines = ["All rights of this site are kept", *own]
        lines += ["Sign up for our letter"] * (i % 2 == 0 if size < 100 else i % 10 == 0)
        lines += ["three texts hold this line"] * (i < 3)
        rows.append((i, "h", "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for r in quality.judge(docs, keep_text=True).collect():
        assert r.kept and "All rights" not in r.text and "Sign up" not in r.text
        assert ("three texts hold this line" in r.text) == (r.doc_id < 3)


def test_lines_are_removed_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality.judge(docs).collect()
    assert sum(r.removed_words for r in found) > 1_000
    # Few documents fall that the base rules leave.
    assert sum(not r.kept and not r.base_failed for r in found) < 0.02 * len(found)
