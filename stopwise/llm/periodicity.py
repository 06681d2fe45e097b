"""Periodic runs of words: suffix trees of a text and its reversal, constant-time common extensions, Lyndon roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import packed, unpacked

RUN = "struct<start:bigint,length:bigint,period:bigint>"
# Rows a task holds at a time; texts can be long.
BATCH = 512

_END = 0  # closes every sequence; smaller than all symbols in both orders


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of symbols 1, 2, ..., with an Euler tour for common extensions.

    ``edges`` maps a node and the first symbol of an edge to the child; a node stands for the prefix of
    ``depth`` symbols of the suffixes below it. ``leaf[i]`` is the node of suffix ``i``, the closing
    symbol included.
    """

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, _END]
        size = self.size = len(text)
        width = max(text) + 1
        begin, stop, depth, parent, link = [0], [0], [0], [-1], [0]
        edges: dict[int, int] = {}
        leaf = [0] * size
        node, edge, along, waiting = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            fresh = 0
            waiting += 1
            while waiting:
                if not along:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    at = i - waiting + 1
                    leaf[at] = edges[key] = len(begin)
                    begin.append(i)
                    stop.append(size)
                    depth.append(size - at)
                    parent.append(node)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    span = stop[child] - begin[child]
                    if along >= span:
                        node, edge, along = child, edge + span, along - span
                        continue
                    if text[begin[child] + along] == symbol:
                        along += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = edges[key] = len(begin)
                    at = i - waiting + 1
                    leaf[at] = split + 1
                    begin += (begin[child], i)
                    stop += (begin[child] + along, size)
                    depth += (depth[node] + along, size - at)
                    parent += (node, split)
                    link += (0, 0)
                    begin[child] += along
                    parent[child] = split
                    edges[split * width + symbol] = split + 1
                    edges[split * width + text[begin[child]]] = child
                    if fresh:
                        link[fresh] = split
                    fresh = split
                waiting -= 1
                if node == 0 and along:
                    along -= 1
                    edge = i - waiting + 1
                else:
                    node = link[node]
        self.leaf = np.array(leaf, np.int64)
        self.depth = np.array(depth, np.int32)
        self.parent = np.array(parent, np.int64)
        self.first_symbol = np.array(text, np.int64)[np.array(begin, np.int64)]
        self._minima: list[np.ndarray] = []

    def _children(self, descending: bool) -> tuple[list[int], list[int]]:
        """Children of all nodes by first symbol, the closing symbol first, and where those of each node begin."""
        symbol = -self.first_symbol if descending else self.first_symbol
        symbol = np.where(self.first_symbol == _END, np.iinfo(np.int64).min, symbol)
        order = np.lexsort((symbol[1:], self.parent[1:])) + 1
        starts = np.searchsorted(self.parent[order], np.arange(len(self.parent) + 1))
        return order.tolist(), starts.tolist()

    def ranks(self, descending: bool = False) -> list[int]:
        """The rank of every suffix, by the order of the symbols or the reverse of it; a prefix comes first."""
        children, starts = self._children(descending)
        rank, depth, size, found = [0] * self.size, self.depth.tolist(), self.size, 0
        stack = [0]
        while stack:
            node = stack.pop()
            low, high = starts[node], starts[node + 1]
            if low == high:
                rank[size - depth[node]] = found
                found += 1
            else:
                stack += children[low:high][::-1]
        return rank

    def _tour(self) -> None:
        """Depths along the Euler tour, the first place of every node, and minima over powers of two."""
        children, starts = self._children(False)
        parent, tour, first = self.parent.tolist(), [], [0] * len(self.parent)
        place = list(starts)
        node = 0
        while node >= 0:
            if place[node] == starts[node]:
                first[node] = len(tour)
            tour.append(node)
            at = place[node]
            if at < starts[node + 1]:
                place[node] = at + 1
                node = children[at]
            else:
                node = parent[node]
        self._first = np.array(first, np.int64)
        low = self.depth[np.array(tour, np.int64)]
        self._minima = [low]
        step = 1
        while 2 * step <= len(tour):
            low = np.minimum(low[:-step], low[step:])
            self._minima.append(low)
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the suffixes at ``a`` and ``b`` agree: the depth of their leaves' lowest common ancestor."""
        if not self._minima:
            self._tour()
        x, y = self._first[self.leaf[a]], self._first[self.leaf[b]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((y - x + 1).astype(np.float64))[1] - 1
        found = np.empty(len(x), np.int64)
        for k in np.unique(level).tolist():
            mine = level == k
            table = self._minima[k]
            found[mine] = np.minimum(table[x[mine]], table[y[mine] - (1 << k) + 1])
        return found


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For every suffix but the closing one, the nearest smaller suffix to its right."""
    last = len(rank) - 1
    found = [last] * last
    for i in range(last - 1, -1, -1):
        j = i + 1
        while j < last and rank[j] > rank[i]:
            j = found[j]
        found[i] = j
    return np.array(found, np.int64)


def all_runs(ids: np.ndarray, exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence that are ``exponent`` (2 or more) periods long.

    Every run holds a Lyndon word, in the order of the symbols or its reverse, as long as its period
    and the longest that begins at its place: the word up to the next smaller suffix. Each such word
    is extended both ways by the common extension of its two ends.
    """
    if not len(ids):
        return np.empty((0, 3), np.int64)
    symbols = (np.unique(ids, return_inverse=True)[1] + 1).tolist()
    size = len(symbols)
    ahead, behind = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for descending in (False, True):
        at = np.arange(size, dtype=np.int64)
        period = _next_smaller(ahead.ranks(descending)) - at
        few = exponent * period <= size
        at, period = at[few], period[few]
        right = ahead.common(at, at + period)
        left = behind.common(size - at, size - at - period)
        length = left + period + right
        long = length >= exponent * period
        found.append(np.stack([(at - left)[long], length[long], period[long]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Parts of the sequence outside of which no run of ``least`` and ``exponent`` periods can lie.

    Every gram of such a run, of the length chosen here, stands in it again one period away, which is
    at most the run's length by ``exponent``. So a run, as far as it extends, lies in one stretch of
    grams that have an equal one that near, and so does its search. Equal hashes of different grams
    can only make a stretch longer.
    """
    gram = max(1, least - 2 * (least // exponent))
    count = len(ids) - gram + 1
    if len(ids) < least:
        return []
    hashed = np.zeros(count, np.uint64)
    for k in range(gram):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + count].astype(np.uint64) + np.uint64(1)
    order = np.argsort(hashed, kind="stable")
    gaps = np.diff(order)
    gaps[hashed[order[1:]] != hashed[order[:-1]]] = len(ids)
    near = np.full(count, len(ids), np.int64)
    near[order[:-1]] = gaps
    near[order[1:]] = np.minimum(near[order[1:]], gaps)

    found, left = [], [(0, count)]
    while left:
        low, high = left.pop()
        fits = near[low:high] <= (high - low + gram - 1) // exponent
        if fits.all():
            found.append((low, high + gram - 1))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], fits.view(np.int8), [0]))))
        left += [
            (low + a, low + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a + gram - 1 >= least
        ]
    return sorted(found)


def runs_of(ids: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``least`` words and ``exponent`` periods."""
    rows = [np.empty((0, 3), np.int64)]
    for low, high in _stretches(ids, least, exponent):
        found = all_runs(ids[low:high], exponent)
        found = found[found[:, 1] >= least]
        found[:, 0] += low
        rows.append(found)
    return np.concatenate(rows)


def _finder(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for begin in range(0, big.num_rows, BATCH):
                batch = big.slice(begin, BATCH)
                sizes, runs, best, kept = [], [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    found = runs_of(ids, least, exponent).tolist()
                    sizes.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    top = None
                    for r in found:  # by start, then period: ties go to the first
                        if top is None or r[1] * top[2] > top[1] * r[2]:
                            top = r
                    best.append(None if top is None else dict(zip(("start", "length", "period"), top)))
                    if found:
                        change = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in found:
                            change[start + period] += 1
                            change[start + length] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    kept.append(b" ".join(words).decode("utf-8"))
                run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        pa.array(sizes, pa.int64()),
                        pa.array(runs, pa.list_(run_type)),
                        pa.array(best, run_type),
                        pa.array(kept, pa.string()),
                    ],
                    names=["row", "n_words", "runs", "strongest", "collapsed"],
                )

    return run


def find_runs(docs: DataFrame, text: str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """Every row of ``docs``, without its text, with the periodic runs of the words of its whole text.

    A run is a stretch of words with smallest period ``period`` that no neighbouring word extends, at
    least ``least`` words and ``exponent`` (3 or more) periods long. Added are ``n_words``, ``runs``
    (by start, then period; starts count words from 0), ``strongest``, the run with the most periods
    (ties: smallest start, then period; null if there is none), and ``collapsed``, the words joined by
    one space without those that any run holds after its first period.

    Words are separated by the white space of ASCII. Null and empty texts have no words, no runs and an
    empty ``collapsed``; repeated rows are treated each; an empty table gives no rows; columns with the
    added names are replaced. Nothing is shuffled; a task holds one text with some hundred bytes for
    each word of its repeated stretches.
    """
    if exponent < 3 or least < exponent:
        raise ValueError("runs need three periods and as many words at least")
    kept = [c for c in docs.columns if c != text]
    rows = packed(docs).select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        F.col(f"given.`{text}`").alias("text"),
    )
    out = rows.select(
        "row",
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast(f"array<{RUN}>").alias("runs"),
        F.lit(None).cast(RUN).alias("strongest"),
        F.lit("").alias("collapsed"),
    )
    found = rows.mapInArrow(_finder(least, exponent), out.schema)
    return unpacked(found, kept, **{c: F.col(c) for c in ("n_words", "runs", "strongest", "collapsed")})
