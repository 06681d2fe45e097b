"""Text queries against their SQL, on the whole smallest tables and on odd rows."""

import duckdb
import pytest

from stopwise.llm import licenses
from stopwise.llm.oracle import ORACLE
from stopwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in found), key=repr)


def of_sql(name, **tables):
    connection = duckdb.connect()
    for table, path in tables.items():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    found = connection.execute(ORACLE[name])
    return rows([c[0] for c in found.description], found.fetchall())


def of_spark(frame):
    return rows(frame.columns, [tuple(r) for r in frame.collect()])


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, name):
    tables = {t: f"{SF}/{t}.parquet" for t in ("documents", "benchmark")}
    assert of_spark(QUERIES[name](spark, SF)) == of_sql(name, **tables)


@pytest.mark.parametrize("name", ORACLE)
def test_odd_rows_equal_the_sql(spark, odd, tmp_path, name):
    """Nulls, repeated rows, a line that all documents of a host share, notices, and short and null items."""
    shared = [(100 + i, f"Page  {i}\nRead MORE at 7 news\n" + " ".join(f"w{i}x{k}" for k in range(60)), "h") for i in range(30)]
    quotes = [(200 + i, f"a\n\n{text}\n\nb".replace(" the ", "\nthe "), None) for i, (_, text) in enumerate(licenses.NOTICES)]
    more = spark.createDataFrame(shared + quotes, "doc_id long, text string, source string")
    docs = odd.select("doc_id", "text", "source").unionByName(more)
    items = [(1, "three four five"), (1, "three four five"), (None, "word1 the1"), (2, None), (3, "..."), (4, shared[3][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for table, frame in {"documents": docs, "benchmark": benchmark}.items():
        frame.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    tables = {t: f"{tmp_path}/{t}.parquet/*.parquet" for t in ("documents", "benchmark")}
    ours = of_spark(QUERIES[name](spark, str(tmp_path)))
    assert ours == of_sql(name, **tables)
    if name == "op4_quality_rules":
        removed = {r[ours[0].index("doc_id")]: r[ours[0].index("removed_words")] for r in ours[1]}
        assert all(removed[d] > 0 for d, *_ in shared)
