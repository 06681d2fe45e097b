"""Removal of repeated byte strings by hash-compared suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from stopwise.llm.common import packed, scratch, unpacked

# Bytes of the strings that mark places where texts may be equal.
GRAM = 128
# Different surroundings of a gram that one task may hold; those of more are compared window by window.
GROUP = 100_000
# Surroundings that are sorted at a time.
SHARD = 4_000
# Bytes of surroundings that are sorted together, which take some forty times as much memory; the sums of the
# prefix hashes would not overflow below 2 ** 24.
SORTED_BYTES = 1 << 22
# Text bytes that are marked at once.
CHUNK = 1 << 19
# Bits of the filter that keeps unaffected texts out of the shuffle, in words of 64.
FILTER_WORDS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


class _Powers:
    """Powers of a number modulo 2 ** 64 or a prime, as many as were asked for so far."""

    def __init__(self, base: int, modulus: int):
        self.base, self.modulus, self.known = base, modulus, np.ones(1, np.uint64)

    def upto(self, size: int) -> np.ndarray:
        while len(self.known) < size:
            step = np.uint64(pow(self.base, len(self.known), self.modulus))
            more = self.known * step
            if self.modulus < 1 << 64:
                more %= np.uint64(self.modulus)
            self.known = np.concatenate([self.known, more])
        return self.known[:size]


_FORWARD, _BACKWARD = _Powers(_BASE, 1 << 64), _Powers(_INVERSE, 1 << 64)
_MODULAR = [_Powers(1_000_003, p) for p in _PRIMES]


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """The best of every ``size`` neighbours, by doubling."""
    width, found = 1, values
    while 2 * width <= size:
        found = best(found[:-width], found[width:])
        width *= 2
    rest = size - width
    return best(found[: len(found) - rest], found[rest:]) if rest else found


def marks(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Marked places and their gram hashes, of texts that follow each other in ``data``.

    Every window of ``length`` bytes marks its grams of least hash, so equal windows have a mark at
    the same place, and a text has about two marks in ``length - gram`` bytes.
    """
    reach = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * _FORWARD.upto(len(data)), dtype=np.uint64)])
    hashes = (sums[gram:] - sums[:-gram]) * _BACKWARD.upto(len(data) - gram + 1)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(32))) | np.uint64(1)
    least = _sliding(hashes, reach, np.minimum)
    windows = np.arange(len(least))
    text = np.searchsorted(starts, windows, side="right") - 1
    ends = np.concatenate([starts[1:], [len(data)]])
    least[windows + length > ends[text]] = 0  # windows that reach into the next text
    pad = np.zeros(reach - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), reach, np.maximum) == hashes)
    return chosen, hashes[chosen]


class Suffixes:
    """Suffixes of equal length or less in one buffer, compared by prefix hashes and binary search."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = np.append(data, 0), starts, sizes
        n = len(data)
        self.sums = []
        for powers in _MODULAR:
            # Terms stay below 2 ** 39 and a buffer below 2 ** 24 bytes, so sums do not overflow.
            terms = (data.astype(np.uint64) + np.uint64(1)) * powers.upto(n)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))
        self.turned = [powers.upto(n + 1)[::-1] for powers in _MODULAR]

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        for sums, turned, prime in zip(self.sums, self.turned, map(np.uint64, _PRIMES)):
            one = (sums[a + size] - sums[a]) % prime * turned[a] % prime
            two = (sums[b + size] - sums[b]) % prime * turned[b] % prime
            same &= one == two
        return same

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b have in common at their beginning."""
        high = np.minimum(self.sizes[a], self.sizes[b])
        low, first, second = np.zeros_like(high), self.starts[a], self.starts[b]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            same = self._equal(first[open_], second[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix a comes before suffix b; a suffix comes after its beginnings."""
        common = self.extension(a, b)
        ended = common == np.minimum(self.sizes[a], self.sizes[b])
        byte_a, byte_b = self.data[self.starts[a] + common], self.data[self.starts[b] + common]
        shorter = self.sizes[a] <= self.sizes[b] if or_equal else self.sizes[a] < self.sizes[b]
        return np.where(ended, shorter, byte_a < byte_b)

    def order(self, groups: np.ndarray) -> np.ndarray:
        """Merge sort within each group, all runs of a round at once.

        An element's place is its own plus its rank in the other run. Rounds go on for the elements of
        groups that are longer than a run.
        """
        n = len(groups)
        order = np.argsort(groups, kind="stable")
        bounds = np.flatnonzero(np.diff(groups[order])) + 1
        begins, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [n]])
        sizes = ends - begins
        group_start, group_end = np.repeat(begins, sizes), np.repeat(ends, sizes)
        width = 1
        while width < sizes.max(initial=0):
            place = np.flatnonzero(group_end - group_start > width)
            start, end = group_start[place], group_end[place]
            run = (place - start) // width
            left = run % 2 == 0
            low = np.minimum(start + np.where(left, run + 1, run - 1) * width, end)
            high = np.minimum(low + width, end)
            begin = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                own, other = order[place[open_]], order[middle]
                from_left = left[open_]
                before = np.empty(len(open_), bool)
                # A left element goes before its equals of the right run, a right one after those of the left.
                before[from_left] = self.less(other[from_left], own[from_left], False)
                before[~from_left] = self.less(other[~from_left], own[~from_left], True)
                low[open_[before]] = middle[before] + 1
                high[open_[~before]] = middle[~before]
            target = place + (low - begin) - np.where(left, 0, width)
            merged = order.copy()
            merged[target] = order[place]
            order, width = merged, width * 2
        return order

    def neighbours(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order, and the bytes each has in common with the one before; -1 in another group.

        Extensions of neighbours are checked byte by byte. If one is wrong, two different strings had
        equal hashes, and the suffixes are sorted by their bytes instead.
        """
        order = self.order(groups)
        common = self._common(order, groups, self.extension)
        if not self._right(order, common):
            pieces = [self.data[s : s + n].tobytes() for s, n in zip(self.starts, self.sizes)]
            order = np.array(sorted(range(len(groups)), key=lambda i: (groups[i], pieces[i])))
            common = self._common(order, groups, self._by_bytes)
        return order, common

    def _common(self, order: np.ndarray, groups: np.ndarray, extension) -> np.ndarray:
        common = np.full(len(order), -1)
        inside = np.flatnonzero(groups[order[1:]] == groups[order[:-1]]) + 1
        common[inside] = extension(order[inside - 1], order[inside])
        return common

    def _by_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = []
        for x, y in zip(a, b):
            size = min(self.sizes[x], self.sizes[y])
            differ = np.flatnonzero(self.data[self.starts[x] :][:size] != self.data[self.starts[y] :][:size])
            found.append(differ[0] if len(differ) else size)
        return np.array(found, np.int64)

    def _right(self, order: np.ndarray, common: np.ndarray) -> bool:
        inside = np.flatnonzero(common >= 0)
        for part in np.array_split(inside, max(1, len(inside) // 2000)):
            if not len(part):
                continue
            a, b, size = order[part - 1], order[part], common[part]
            steps = np.arange(int(size.max()) + 1)
            last = len(self.data) - 1
            x = self.data[np.minimum(self.starts[a][:, None] + steps, last)]
            y = self.data[np.minimum(self.starts[b][:, None] + steps, last)]
            if ((x != y) & (steps < size[:, None])).any():
                return False
            ended = size == np.minimum(self.sizes[a], self.sizes[b])
            at = size[~ended]
            rows = np.flatnonzero(~ended)
            if (x[rows, at] >= y[rows, at]).any():
                return False
        return True


def repeated_offsets(
    contexts: list[bytes], left: np.ndarray, groups: np.ndarray, length: int, reach: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the least and greatest bytes before its mark at which a repeated window starts.

    A context is the text around a mark with ``left`` bytes before it. Suffixes from the mark on are
    sorted, and so are the bytes before the mark, read backward. A window that starts ``o`` bytes
    before the mark occurs in two contexts if these share ``o`` bytes before and ``length - o`` from
    the mark on: if they are in one run of common bytes in either order. None: greatest is -1.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    after = Suffixes(data, starts + left, sizes - left)
    order_a, common_a = after.neighbours(groups)
    before = Suffixes(data[::-1], len(data) - starts - left, left)
    order_b, common_b = before.neighbours(groups)
    least, greatest = np.full(len(contexts), reach), np.full(len(contexts), -1)
    run_a, run_b = np.empty(len(contexts), np.int64), np.empty(len(contexts), np.int64)
    for o in range(reach):
        fits = np.flatnonzero((left >= o) & (sizes - left >= length - o))
        if len(fits) < 2:
            continue
        run_a[order_a] = np.cumsum(common_a < length - o)
        run_b[order_b] = np.cumsum(common_b < o)
        _, back, times = np.unique(run_a[fits] * (len(contexts) + 1) + run_b[fits], return_inverse=True, return_counts=True)
        hit = fits[times[back] > 1]
        least[hit] = np.minimum(least[hit], o)
        greatest[hit] = o
    return least, greatest


def offsets_of_many(
    contexts: list[bytes], left: np.ndarray, length: int, reach: int, sorted_bytes: int
) -> tuple[np.ndarray, np.ndarray]:
    """As ``repeated_offsets`` for one group that is too large to sort at once.

    Windows that start ``low`` to ``high`` bytes before the mark all hold ``low`` bytes before it and
    ``length - high + 1`` from it on. Contexts that differ in these have no such window in common, so they
    are told apart by them; what is still together and too large is looked at for each half of
    the offsets. Contexts that agree in all that the windows can hold repeat wherever these fit, and
    one of them goes on for all.
    """
    before = left.tolist()
    behind = [len(c) - b for c, b in zip(contexts, before)]
    least, greatest = [reach] * len(contexts), [-1] * len(contexts)

    def hit(i: int, low: int, high: int) -> None:
        if low < least[i]:
            least[i] = low
        if high > greatest[i]:
            greatest[i] = high

    waiting = [(range(len(contexts)), 0, reach)]
    while waiting:
        members, low, high = waiting.pop()
        core, widest = length - high + 1, length - low
        members = [i for i in members if before[i] >= low and behind[i] >= core]
        if len(members) < 2:
            continue
        if high - low > 8 and sum(min(before[i], high - 1) + min(behind[i], widest) for i in members) <= sorted_bytes:
            size = np.array([min(before[i], high - 1) for i in members], np.int64)
            parts = [contexts[i][max(0, before[i] - high + 1) : before[i] + widest] for i in members]
            first, last = repeated_offsets(parts, size, np.zeros(len(parts), np.int64), length, high)
            for i, a, b in zip(members, first.tolist(), last.tolist()):
                if b >= 0:
                    hit(i, a, b)
            continue
        shared: dict[bytes, list[int]] = {}
        for i in members:
            at = before[i]
            shared.setdefault(xxh3_128_digest(contexts[i][at - low : at + core]), []).append(i)
        for together in shared.values():
            if len(together) < 2:
                continue
            if high - low == 1:
                for i in together:
                    hit(i, low, low)
                continue
            different: dict[tuple, int] = {}
            for i in together:
                at, most = before[i], min(before[i], high - 1)
                first = different.setdefault((most, xxh3_128_digest(contexts[i][at - most : at + widest])), i)
                if first != i:
                    for x in (first, i):
                        hit(x, max(low, length - behind[x]), min(high - 1, before[x]))
            if len(different) > 1:
                ones, middle = list(different.values()), (low + high) // 2
                waiting += [(ones, low, middle), (ones, middle, high)]
    return np.array(least), np.array(greatest)


_MARK = pa.schema([("a", pa.int64()), ("b", pa.int32()), ("at", pa.int32()), ("gram", pa.int64())])
_CONTEXT = pa.schema(
    [
        ("key", pa.binary()),
        ("gram", pa.int64()),
        ("a", pa.int64()),
        ("b", pa.int32()),
        ("low", pa.int32()),
        ("high", pa.int32()),
        ("before", pa.int32()),
        ("context", pa.binary()),
    ]
)
_OFFSETS = pa.schema([("key", pa.binary()), ("least", pa.int32()), ("greatest", pa.int32())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _marker(length: int, gram: int):
    def flush(texts: list[bytes], a: list[int], b: list[int]) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        at, found = marks(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64), starts[:-1], length, gram)
        text = np.searchsorted(starts[:-1], at, side="right") - 1
        return _batch(_MARK, np.array(a)[text], np.array(b)[text], at - starts[text], found.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, a, b, size = [], [], [], 0
        for batch in batches:
            columns = (batch.column(c) for c in ("a", "b", "text"))
            for x, y, text in zip(*columns):
                raw = _utf8(text.as_py())
                if len(raw) < length:
                    continue
                texts.append(raw)
                a.append(x.as_py())
                b.append(y.as_py())
                size += len(raw)
                if size >= CHUNK:
                    yield flush(texts, a, b)
                    texts, a, b, size = [], [], [], 0
        if texts:
            yield flush(texts, a, b)

    return run


def _contexts(length: int, reach: int):
    """The bytes around each mark, from ``low`` to ``high``, ``before`` of them before the mark.

    Rows without context are regions known to repeat in the text itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, text = (batch.column(c)[i].as_py() for c in ("a", "b", "text"))
                found = batch.column("marks")[i].values
                raw, seen = _utf8(text), {}
                for at, gram in zip(found.field("at").to_pylist(), found.field("gram").to_pylist()):
                    low, high = max(0, at - reach + 1), min(len(raw), at + length)
                    context = raw[low:high]
                    key = hashlib.blake2b(b"%d %d " % (gram, at - low) + context, digest_size=16).digest()
                    first = seen.setdefault(key, at)
                    if first == at:
                        rows.append((key, gram, a, b, low, high, at - low, context))
                    else:
                        # What occurs twice is repeated whole.
                        least, greatest = max(0, length - (high - at)), min(reach - 1, at - low)
                        if least <= greatest:
                            for place in (first, at):
                                rows.append((key, 0, a, b, place - greatest, place - least + length, 0, None))
                    if len(rows) >= 5000:
                        yield _batch(_CONTEXT, *zip(*rows))
                        rows = []
        if rows:
            yield _batch(_CONTEXT, *zip(*rows))

    return run


def _repeats(length: int, reach: int, shard: int, sorted_bytes: int):
    """Offsets of repeated windows of different contexts; rows come sorted by gram."""

    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        grams, left = rows["gram"].to_numpy(), rows["before"].to_numpy().astype(np.int64)
        contexts = rows["context"].to_pylist()
        if sum(map(len, contexts)) >= sorted_bytes:
            least, greatest = offsets_of_many(contexts, left, length, reach, sorted_bytes)
        else:
            least, greatest = repeated_offsets(contexts, left, grams, length, reach)
        hit = np.flatnonzero(greatest >= 0)
        if len(hit):
            yield _batch(_OFFSETS, rows["key"].take(pa.array(hit)).combine_chunks(), least[hit], greatest[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole groups of two or more
        group: list[pa.RecordBatch] = []  # the last gram's rows
        size, members, gram = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column("gram").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grams)) + 1).tolist(), len(grams)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if group and grams[start] != gram:
                    if members > 1:
                        if held and size + members > shard:
                            yield from flush(held)
                            held, size = [], 0
                        held, size = held + group, size + members
                    group, members = [], 0
                gram = grams[start]
                group.append(batch.slice(start, end - start))
                members += end - start
        if members > 1 and held and size + members > shard:
            yield from flush(held)
            held = []
        if members > 1:
            held = held + group
        if held:
            yield from flush(held)

    return run


def _windows(length: int, reach: int):
    """Every window of a context by hash, for grams with very many different surroundings."""
    schema = pa.schema([("window", pa.binary()), ("key", pa.binary()), ("offset", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                context, before = row["context"], row["before"]
                windows, offsets = [], []
                for o in range(max(0, length - len(context) + before), min(reach - 1, before) + 1):
                    window = context[before - o : before - o + length]
                    windows.append(hashlib.blake2b(b"%d %d " % (row["gram"], o) + window, digest_size=16).digest())
                    offsets.append(o)
                yield _batch(schema, windows, [row["key"]] * len(offsets), offsets)

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged regions of each text, and the hash of what they leave."""
    schema = pa.schema(
        [
            ("a", pa.int64()),
            ("b", pa.int32()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("kept", pa.string()),
        ]
    )
    for batch in batches:
        spans, kept = [], []
        for text, regions in zip(batch.column("text"), batch.column("regions")):
            raw, merged, at, digest = _utf8(text.as_py()), [], 0, hashlib.sha256()
            found = regions.values
            for r in sorted(zip(found.field("low").to_pylist(), found.field("high").to_pylist())):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            for start, end in merged:
                digest.update(raw[at:start])
                at = end
            digest.update(raw[at:])
            spans.append([{"start": s, "end": e} for s, e in merged])
            kept.append(digest.hexdigest())
        yield _batch(schema, batch.column("a"), batch.column("b"), spans, kept)


def without(text: str, spans: list) -> bytes:
    """The bytes of a text outside the spans."""
    raw, kept, at = _utf8(text), [], 0
    for start, end in spans:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]])


def _affected(texts: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """``texts`` without most of those whose key is not in ``keys``; the filter has a fixed size."""
    word, bit = F.pmod(F.shiftright("a", 6), F.lit(words)), F.col("a").bitwiseAND(63).cast("int")
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    filter_ = keys.groupBy(word.alias("word")).agg(F.bit_or(flag).alias("flags"))
    return texts.join(F.broadcast(filter_), word == F.col("word")).where(F.col("flags").bitwiseAND(flag) != 0)


def repeated_substrings(
    docs: DataFrame,
    text: str = "text",
    length: int = 400,
    gram: int = GRAM,
    group: int = GROUP,
    shard: int = SHARD,
    sorted_bytes: int = SORTED_BYTES,
    words: int = FILTER_WORDS,
) -> DataFrame:
    """Every row of ``docs``, without its text, with the spans of bytes that repeated strings cover.

    Columns added (or replaced): ``n_bytes``, ``spans`` (start and end byte, end excluded, maximal and
    in order), ``n_removed`` and ``kept_sha256``. A byte is covered if it lies in a string of
    ``length`` bytes that also starts anywhere else in the texts, the same one included. Spans can
    cut characters, so they are given in bytes; ``without`` applies them.

    Null texts are empty; texts shorter than ``length`` have no span; copies and repeated rows cover
    each other whole; an empty table gives no rows.

    Every window of ``length`` bytes marks its gram of least hash, so equal windows meet at an equal
    gram. Only places whose gram occurs elsewhere keep the bytes around them. Equal surroundings are
    one, so copies cost little; different ones of the same gram are compared by suffix sorting
    (``Suffixes``), in shards of about ``shard``, or one gram's alone up to ``sorted_bytes``. A gram
    with more than ``group`` different surroundings is compared window by window in an aggregation
    instead, which combines before it shuffles, and one with more bytes than are sorted together is cut
    up by what its windows must share (``offsets_of_many``). A gram that very many texts hold is no hot key: the repeated grams are
    written before they are joined, so that Spark can split the marks of one of them over tasks. Texts
    are told apart by 96-bit hash, surroundings by 128-bit hash.
    """
    if not 0 < gram < length:
        raise ValueError("grams are shorter than the strings")
    if shard * (2 * length - gram) > sorted_bytes:
        shard = max(1, sorted_bytes // (2 * length - gram))
    reach = length - gram + 1
    rows = packed(docs)
    store = scratch(docs, "substrings")
    body = F.coalesce(F.col(f"given.`{text}`"), F.lit(""))
    keys = [F.xxhash64(body).alias("a"), F.hash(body).alias("b")]
    texts = rows.select(*keys, body.alias("text")).where(F.octet_length("text") >= length)

    marked = store.save(texts.mapInArrow(_marker(length, gram), "a bigint, b int, at int, gram bigint"), "marks")
    # A gram counts as repeated if it is at two places of the distinct texts.
    place = F.xxhash64("a", "b", "at")
    repeated = marked.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = store.save(repeated.where(F.col("first") != F.col("last")).select("gram"), "repeated")
    places = store.save(marked.join(repeated, "gram").select("a", "b", "at", "gram"), "places")
    of_text = places.groupBy("a", "b").agg(F.collect_set(F.struct("at", "gram")).alias("marks"))
    once = _affected(texts, places, words).groupBy("a", "b").agg(F.first("text").alias("text"))
    around = once.join(of_text, ["a", "b"]).mapInArrow(
        _contexts(length, reach),
        "key binary, gram bigint, a bigint, b int, low int, high int, before int, context binary",
    )
    around = store.save(around, "contexts")
    known = around.where(F.col("context").isNull()).select("a", "b", "low", "high")
    marked_places = around.where(F.col("context").isNotNull())

    # Equal surroundings are compared once; those of more than one place repeat whole.
    distinct = marked_places.groupBy("key").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("gram", "before", "context")]
    )
    distinct = store.save(distinct, "distinct")
    sizes = distinct.groupBy("gram").agg(F.count("*").alias("members")).where(F.col("members") > group)
    many = store.save(sizes.select("gram"), "many")
    offsets = "key binary, least int, greatest int"
    usual = (
        distinct.select("key", "gram", "before", "context")
        .join(many, "gram", "left_anti")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_repeats(length, reach, shard, sorted_bytes), offsets)
    )
    windows = (
        distinct.select("key", "gram", "before", "context")
        .join(many, "gram", "left_semi")
        .mapInArrow(_windows(length, reach), "window binary, key binary, offset int")
    )
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    hot = windows.join(twice, "window").groupBy("key").agg(F.min("offset").alias("least"), F.max("offset").alias("greatest"))
    own_least = F.greatest(F.lit(0), length - F.octet_length("context") + F.col("before")).alias("least")
    own_greatest = F.least(F.lit(reach - 1), F.col("before")).alias("greatest")
    own = distinct.where("n > 1").select("key", own_least, own_greatest).where("least <= greatest")
    found = own.unionByName(usual).unionByName(hot)
    found = found.groupBy("key").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    mark = F.col("low") + F.col("before")
    matched = marked_places.select("key", "a", "b", "low", "before").join(found, "key")
    matched = matched.select("a", "b", (mark - F.col("greatest")).alias("low"), (mark - F.col("least") + length).alias("high"))
    regions = store.save(known.unionByName(matched), "regions")

    narrow = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in docs.columns if c != text], F.lit(1).alias("_unused")).alias("row"),
        *keys,
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body.cast("binary"), 256).alias("sha"),
    )
    narrow = store.save(narrow, "documents")
    copies = narrow.where(F.col("n_bytes") >= length).groupBy("a", "b").agg(F.count("*").alias("n"))
    copies = copies.where("n > 1").select("a", "b", F.lit(True).alias("copied"))
    by_text = regions.groupBy("a", "b").agg(F.collect_list(F.struct("low", "high")).alias("regions"))
    by_text = store.save(by_text.join(copies, ["a", "b"], "left_anti"), "covered")
    whole = _affected(texts, by_text, words).groupBy("a", "b").agg(F.first("text").alias("text"))
    cut = whole.join(by_text, ["a", "b"]).mapInArrow(
        _cutter, "a bigint, b int, spans array<struct<start:bigint,end:bigint>>, kept string"
    )
    changed = cut.withColumn("copied", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    changed = store.save(changed, "changed")

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(F.col("copied"), all_of_it).otherwise(F.coalesce("spans", none))
    kept_sha: Column = F.when(F.col("copied"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept", "sha"))
    joined = narrow.join(changed, ["a", "b"], "left").withColumn("spans", spans)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return unpacked(
        joined,
        [c for c in docs.columns if c != text],
        n_bytes=F.col("n_bytes"),
        spans=F.col("spans"),
        n_removed=removed,
        kept_sha256=kept_sha,
    )
