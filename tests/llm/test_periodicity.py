"""Periodic runs against a search through all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stopwise.llm.periodicity import SuffixTree, all_runs, find_runs, runs_of
from stopwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def smallest_period(s):
    border, k = [0] * len(s), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = border[k - 1]
        k += s[i] == s[k]
        border[i] = k
    return len(s) - border[-1]


def brute(s, least, exponent):
    found = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and smallest_period(s[i : j + q]) == q:
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def found(s, least, exponent):
    return [tuple(r) for r in runs_of(np.array(s, dtype=np.int32), least, exponent).tolist()]


def test_runs_of_planted_and_random_sequences():
    draw = random.Random(5)
    for _ in range(400):
        letters = draw.choice((1, 2, 3, 6))
        s = [draw.randrange(letters) for _ in range(draw.randrange(110))]
        if len(s) > 10 and draw.random() < 0.7:
            a = draw.randrange(len(s))
            p = draw.randint(1, max(1, (len(s) - a) // 3))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(len(s))]
        for least, exponent in ((24, 3), (3, 3), (10, 4), (7, 3), (8, 3)):
            assert found(s, least, exponent) == brute(s, least, exponent)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_all_runs_of_two_periods(s):
    assert [tuple(r) for r in all_runs(np.array(s, dtype=np.int64), 2).tolist()] == brute(s, 2, 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=30))
def test_tree_gives_common_extensions_and_ranks(s):
    tree = SuffixTree(list(s))
    n = len(s)
    pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
    common = tree.common(*(np.array(c) for c in zip(*pairs)))
    for (i, j), k in zip(pairs, common.tolist()):
        assert s[i : i + k] == s[j : j + k]
        assert i + k == n or j + k == n or s[i + k] != s[j + k]
    for sign in (1, -1):
        order = sorted(range(n + 1), key=lambda i: [sign * x for x in s[i:]])
        assert [tree.ranks(sign < 0)[i] for i in order] == list(range(n + 1))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers: dict = {}
    runs = brute([numbers.setdefault(w, len(numbers)) for w in words], 24, 3)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), *best, digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_equals_brute_force(spark, documents, tmp_path):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1]) < 12_000]
    odd = [(10_000 + i, t) for i, t in enumerate((None, "", " \x0b\n", "a " * 200, "x y " * 30 + "z " * 50, "é\x1cb " * 40))]
    # Ids of which the text is made to repeat itself.
    odd += [(i, " ".join(f"w{i}.{k}" for k in range(i % 97))) for i in range(20_000, 20_400) if zlib.crc32(str(i).encode()) % 10 == 0]
    spark.createDataFrame(rows + odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ours = sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect())
    assert ours == sorted(expected(*r) for r in rows + odd)
    assert sum(r[1] > 0 for r in ours) > 30


def test_collapsed_text_and_spans_of_a_row(spark):
    text = "start " + "to be or not " * 9 + "end"
    (row,) = find_runs(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    assert row.collapsed == "start to be or not end" and row.n_words == 38
    assert [tuple(r) for r in row.runs] == [tuple(row.strongest)] == [(1, 36, 4)]
