"""Benchmark decontamination: test phrases are searched in an FM-index of every shard of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stopwise.llm.common import packed, unpacked

# Bytes of benchmark text that are broadcast at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 4_000_000
# Every such text position keeps its suffix position.
SAMPLE = 16

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes(
    c if c in _WORD else (c + 32 if 65 <= c <= 90 else 32) for c in range(256)
)  # words in lower case, all else as blanks
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Bits:
    """A bit vector with the number of set bits before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class _Wavelet:
    """Wavelet tree stored level by level (the matrix form), with vectorised rank."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels, self.zeros, self.width = [], [], width
        for level in reversed(range(width)):
            bits = (symbols >> level) & 1
            self.levels.append(_Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low = np.zeros_like(at)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.width - 1 - level)) & 1 == 1
            a, b = bits.rank(low), bits.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros_like(at)
        for bits, zeros in zip(self.levels, self.zeros):
            one, before = bits.get(at), bits.rank(at)
            found = found * 2 + one
            at = np.where(one, zeros + before, at - before)
        return found


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; 0 ends a text, and each 0 is a symbol of its own."""
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + ends.sum()).astype(np.int64)
    step = 1
    while True:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(symbols) - 1:
            return order
        step *= 2


class FMIndex:
    """FM-index of texts over symbols 1 and up, each text ended by 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(symbols)
        before = symbols[order - 1]
        self.size = int(symbols.max()) + 1
        self.tree = _Wavelet(before, max(1, int(self.size - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.size))])
        marked = (order % sample == 0) | (before == 0)
        self.marked, self.places, self.length = _Bits(marked.astype(np.uint8)), order[marked], len(symbols)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows at once: the range of suffixes that begin with each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.length, np.int64)
        alive = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, column]
            known = symbol < self.size
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            base = self.first[symbol]
            low[alive] = base + self.tree.rank(symbol, low[alive])
            high[alive] = base + self.tree.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the nearest sampled position."""
        rows, steps = rows.copy(), np.zeros_like(rows)
        walking = np.flatnonzero(~self.marked.get(rows))
        while len(walking):
            at = rows[walking]
            symbol = self.tree.symbol(at)
            rows[walking] = self.first[symbol] + self.tree.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.marked.get(rows[walking])]
        return self.places[self.marked.rank(rows)] + steps


def phrase_block(items: list[tuple], window: int) -> dict:
    """The distinct windows of benchmark items as symbols, and the items of each window."""
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        found = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(text)]
        size = min(window, len(found))
        for start in range(len(found) - size + 1 if found else 0):
            owners = by_length.setdefault(size, {}).setdefault(tuple(found[start : start + size]), set())
            if item is not None:
                owners.add(str(item))
    return {
        "vocabulary": vocabulary,
        "phrases": [(n, np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for n, w in by_length.items()],
    }


def _search(texts: list[str | None], block: dict) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """Words, hit spans and hit items of each text, by one FM-index of the texts.

    Words that no phrase has end a text, and stretches shorter than every phrase are not indexed.
    """
    get = block["vocabulary"].get
    counts, parts = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        found = tokens(text)
        counts[i] = len(found)
        parts.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
        parts.append(np.zeros(1, np.int64))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    del parts
    if not block["phrases"] or not len(symbols):
        return counts, spans, items
    shortest = min(n for n, _, _ in block["phrases"])
    ends = np.flatnonzero(symbols == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    long = ends - starts >= shortest
    if not long.any():
        return counts, spans, items
    sizes = ends[long] - starts[long] + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    places = np.repeat(starts[long] - offsets, sizes) + np.arange(int(sizes.sum()))
    index = FMIndex(symbols[places])
    begin = np.concatenate([[0], np.cumsum(counts + 1)])
    cover = np.zeros(len(symbols) + 1, np.int64)
    for length, phrases, owners in block["phrases"]:
        low, high = index.search(phrases)
        times = np.maximum(high - low, 0)
        if not times.any():
            continue
        phrase = np.repeat(np.arange(len(phrases)), times)
        rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        at = places[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        text = np.searchsorted(begin, at, side="right") - 1
        for t, p in np.unique(np.stack([text, phrase], axis=1), axis=0):
            items[t].update(owners[p])
    hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    for start, end in zip(edges[::2], edges[1::2]):
        t = int(np.searchsorted(begin, start, side="right") - 1)
        spans[t].append((int(start - begin[t]), int(end - begin[t])))
    return counts, spans, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    found = [m.span() for m in _WORDS.finditer(raw)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at : found[start][0]])
        at = found[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _searcher(block, schema: pa.Schema, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts, spans, items = _search(texts, block.value)
            for i, (old, known) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                if old:
                    spans[i] = _merged([(s["start"], s["end"]) for s in old], spans[i])
                items[i] = sorted(items[i].union(known))
            clean = [without(t, s) if last and s else t for t, s in zip(texts, spans)]
            columns = {
                "n_words": counts,
                "spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
                "items": items,
                "clean": clean,
            }
            arrays = [pa.array(columns[n], schema.field(n).type) if n in columns else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with its words, the spans of words that benchmark items hit, and the items.

    Columns added (or replaced): ``n_words``, ``spans`` (array of start and end word, end excluded,
    merged and in order), ``n_hit``, ``items`` (distinct ids as text, sorted as text) and
    ``contaminated`` (a twentieth of the words or more is hit). With ``keep_text`` the text comes
    back, and ``clean_text`` is the text without the spans; else the text column is left out.

    An item's windows are its ``window`` consecutive words, or all its words if it has fewer; words
    are runs of letters, digits and non-ASCII characters, A-Z in lower case. Null texts have no
    words; an item without words hits nothing; an item with a null id hits words but is not listed;
    repeated items count once; an empty benchmark hits nothing, and empty documents give no rows.

    Each Arrow batch is a shard with an index of its own, bounded by the session's batch limits, so
    nothing is shuffled. The benchmark comes to the driver and is broadcast block by block, at most
    ``block_bytes`` (or one item) at a time; spans of the blocks are merged.
    """
    rows = packed(docs)
    spark = docs.sparkSession
    kept = [c for c in docs.columns if keep_text or c != text]
    found = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in docs.columns if c != text], F.lit(1).alias("_unused")).alias("row"),
        F.col(f"given.`{text}`").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        F.lit(None).cast("string").alias("clean"),
    )
    names = found.schema
    # The struct of the other columns is passed on as it comes; its type is not needed.
    fields = [pa.field("row", pa.null()), *to_arrow_schema(found.drop("row").schema)]
    blocks = _blocks(benchmark.select(F.col(f"`{item}`"), F.col(f"`{item_text}`")), block_bytes)
    current = next(blocks, [])
    while True:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(phrase_block(current, window))
        found = found.mapInArrow(_searcher(shared, pa.schema(fields), following is None and keep_text), names)
        if following is None:
            break
        current = following
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    more = {text: F.col("text"), "clean_text": F.col("clean")} if keep_text else {}
    counted = found.withColumn("hit", hit)
    return unpacked(
        counted,
        kept,
        n_words=F.col("n_words"),
        spans=F.col("spans"),
        n_hit=F.col("hit"),
        items=F.col("items"),
        contaminated=(F.col("hit") > 0) & (20 * F.col("hit") >= F.col("n_words")),
        **more,
    )


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for item, text in items.toLocalIterator():
        more = len((text or "").encode("utf-8", "surrogatepass"))
        if block and size + more > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += more
    if block:
        yield block
