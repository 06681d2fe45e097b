"""N-gram scores from a log-frequency Bloom filter that is broadcast to the workers."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stopwise.llm.common import packed, scratch, unpacked

# The end of a text; no word can hold a line feed.
END = b"\n"
# Tokens that a task counts before it hands on what it has.
FLUSH_TOKENS = 3_000_000
# Text bytes for each block of n-grams; a block is merged, and its part of the filter built, by one task.
BLOCK_TEXT = 16_000_000
# Words whose exact counts are broadcast: seen so often at least, and no more than this many, at
# sixteen bytes each. Rarer words are joined.
HEAD_COUNT = 3
HEAD_WORDS = 2_000_000
# Filter bytes that are broadcast at once; a larger filter is probed part by part.
FILTER_BYTES = 128_000_000
BITS_PER_ENTRY, PROBES, MAX_LEVEL = 8, 4, 48
# Weight of the lower order, in occurrences of the word before.
SMOOTHING = 50.0

_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def text_tokens(text: str | None) -> list[bytes]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * _ODD + second)


class _Tokens:
    """Token numbers of many texts, and the hash of each distinct token."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[END]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> int:
        found = text_tokens(text)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)))
        self.size += len(found)
        return len(found)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), np.uint64, len(self.numbers))


def _packed_counts(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart, and counts; compressed."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked_counts(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, size * 12, codec="zstd"), np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view(np.uint64)[:, 0]
    counts = np.ascontiguousarray(raw[8 * size :].reshape(4, size).T).view(np.uint32)[:, 0]
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


_PART = pa.schema([("grams", pa.int32()), ("block", pa.int32()), ("size", pa.int32()), ("data", pa.binary())])


def _counter(bits: int):
    """Counts of one- and two-token grams of what a task reads, by block of hashes."""

    def flush(seen: _Tokens) -> pa.RecordBatch:
        numbers, hashes = np.concatenate(seen.parts), seen.hashes()
        single = np.bincount(numbers, minlength=len(hashes))
        # A text's first token follows the end of the text before it, as each does the first.
        before = np.concatenate([[0], numbers[:-1]])
        pairs, counts = np.unique(before * len(hashes) + numbers, return_counts=True)
        double = _pair(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])
        rows = []
        for grams, found, times in ((1, hashes, single), (2, double, counts)):
            order = np.argsort(found)
            found, times = found[order], times[order]
            cuts = np.searchsorted(found >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            for block, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if b > a:
                    rows.append((grams, block, b - a, _packed_counts(found[a:b], times[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PART)], schema=_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Tokens()
        for batch in batches:
            for text in batch.column("text"):
                seen.add(text.as_py())
                if seen.size >= FLUSH_TOKENS:
                    yield flush(seen)
                    seen = _Tokens()
        if seen.size:
            yield flush(seen)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One block's counts of all tasks added up."""
    parts = [_unpacked_counts(d, n) for d, n in zip(table["data"].to_pylist(), table["size"].to_pylist())]
    hashes, counts = np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])
    del parts
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    hashes, counts = hashes[first], np.add.reduceat(counts, first)
    return pa.table(
        {
            "grams": table["grams"][:1],
            "block": table["block"][:1],
            "size": pa.array([len(hashes)], pa.int64()),
            "total": pa.array([int(counts.sum())], pa.int64()),
            "entries": pa.array([int(_levels(counts).sum())], pa.int64()),
            "hashes": pa.array([hashes.tobytes()], pa.binary()),
            "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
        }
    )


def _levels(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 1 for 1, 2 up to 3, 3 up to 7, and so on."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], MAX_LEVEL)


def level_counts() -> np.ndarray:
    """The count that stands for each level: the middle of its range."""
    powers = 2.0 ** np.arange(MAX_LEVEL)
    return np.concatenate([[0.0], (powers + 2 * powers - 1) / 2])


def _read(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int64)


def _per_block(body, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = body(batch.slice(i, 1).to_pylist()[0])
                if found.num_rows:
                    yield found.cast(schema)

    return run


def _probe_places(hashes: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """The bits of a gram at a level, in a part of ``size`` bits."""
    one = _mix(hashes + np.uint64(level * int(_ODD) % (1 << 64)))
    step, start = (one >> _HALF) | np.uint64(1), one & np.uint64(0xFFFFFFFF)
    for i in range(PROBES):
        at = (start + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)
        yield (at * np.uint64(size)) >> _HALF


def filter_part(row: dict, size: int) -> np.ndarray:
    """A block's part of the filter: each gram at every level up to its own."""
    hashes, counts = _read(row)
    levels, bits = _levels(counts), np.zeros(size, np.uint8)
    for level in range(1, int(levels.max()) + 1):
        for at in _probe_places(hashes[levels >= level], level, size):
            bits[at] = 1
    return np.packbits(bits, bitorder="little")


class BloomCounts:
    """Quantised counts of grams from a filter of equal parts, one for each block of hashes."""

    def __init__(self, parts: dict[int, bytes], bits: int, size: int):
        self.first, self.bits, self.size = min(parts, default=0), bits, size
        self.data = np.frombuffer(b"".join(parts[b] for b in sorted(parts)), np.uint8)
        self.blocks = len(parts)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each gram, 0 if it or its block is not here: probed upward until a miss."""
        found = np.zeros(len(hashes), np.uint8)
        block = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) - self.first
        here = np.flatnonzero((block >= 0) & (block < self.blocks))
        base = block[here].astype(np.uint64) * np.uint64(self.size)
        level = 1
        while len(here) and level <= MAX_LEVEL:
            alive = np.ones(len(here), bool)
            for at in _probe_places(hashes[here], level, self.size):
                place = base + at
                alive &= (self.data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            here, base = here[alive], base[alive]
            found[here] = level
            level += 1
        return found


def _scorer(shared, schema: pa.Schema, smoothing: float, total: int, distinct: int, last: bool):
    """Levels of every token's grams from the filter's part at hand; with the last part, the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        head, head_counts, bloom = model["head"], model["counts"], model["bloom"]
        values, floor = level_counts(), np.log10(total + distinct + 1)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                seen = _Tokens()
                sizes = np.array([seen.add(t) for t in batch.column("text").to_pylist()], np.int64)
                numbers, hashes = np.concatenate(seen.parts), seen.hashes()
                before = np.concatenate([[0], numbers[:-1]])
                single = bloom.levels(hashes)
                double = bloom.levels(_pair(hashes[before], hashes[numbers]))
                old = b"".join(x or b"" for x in batch.column("levels").to_pylist())
                if old:
                    earlier = np.frombuffer(old, np.uint8).reshape(-1, 2)
                    levels = np.stack([np.maximum(single[numbers], earlier[:, 0]), np.maximum(double, earlier[:, 1])], axis=1)
                else:
                    levels = np.stack([single[numbers], double], axis=1)
                ends = np.cumsum(sizes)
                columns: dict = {}
                if not last:
                    raw = levels.tobytes()
                    columns["levels"] = [raw[2 * (e - n) : 2 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                else:
                    columns["levels"] = [None] * len(sizes)
                    count = values[levels[:, 0]]
                    of_end = values[int(levels[np.flatnonzero(numbers == 0)[0], 0])]
                    history = np.concatenate([[of_end], count[:-1]])
                    pair = np.minimum(values[levels[:, 1]], history)
                    lower = (count + 1) / (total + distinct + 1)
                    score = np.log10((pair + smoothing * lower) / (history + smoothing))
                    at = np.searchsorted(head, hashes)
                    at[at == len(head)] = 0
                    known = head[at] == hashes if len(head) else np.zeros(len(hashes), bool)
                    exact = np.where(known, head_counts[at] if len(head) else 0, 0)
                    base = np.where(known, np.log10(exact + 1) - floor, 0.0)
                    starts = ends - sizes
                    columns["n_tokens"] = sizes
                    columns["n_known"] = np.add.reduceat(known[numbers].astype(np.int64), starts)
                    columns["base"] = np.add.reduceat(base[numbers], starts)
                    columns["score"] = np.add.reduceat(score, starts)
                    rare = []
                    for s, e in zip(starts.tolist(), ends.tolist()):
                        mine = numbers[s:e]
                        which, times = np.unique(mine[~known[mine]], return_counts=True)
                        signed = hashes[which].view(np.int64).tolist()
                        rare.append([{"hash": h, "times": n} for h, n in zip(signed, times.tolist())])
                    columns["rare"] = rare
                arrays = [
                    pa.array(columns[n], schema.field(n).type) if n in columns else batch.column(n) for n in schema.names
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return run


def score_texts(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    parts: int = 7,
    held_out: int = 2,
    smoothing: float = SMOOTHING,
    head_words: int = HEAD_WORDS,
    filter_bytes: int = FILTER_BYTES,
    block_text: int = BLOCK_TEXT,
) -> DataFrame:
    """Every row of ``docs``, without its text, with its log10 probability under two models.

    Rows whose crc32 of ``key`` as text modulo ``parts`` is ``held_out`` are not learnt from. Columns
    added (or replaced): ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one single tokens, exact counts) and ``score``: two-token
    probabilities ``(c(h w) + s P(w)) / (c(h) + s)``, their counts read from the filter.

    Tokens are the words of the whole text, A-Z in lower case, and one end. Null texts are an end
    only; a null key is the empty text for crc32 (so learnt from); repeated rows are counted and
    scored each; an empty table gives no rows. Tokens and grams are told apart by 64-bit hash.

    Counting: a task counts grams of what it reads and hands on compressed counts by block of hashes;
    each block is merged by one task, and there are as many blocks as the text needs. The filter
    takes each gram at every level up to the logarithm of its count; blocks build their own part of
    it. It is broadcast in parts of at most ``filter_bytes``, with levels kept in a table between two
    parts. Exact counts are broadcast for the ``head_words`` most frequent words at most; the rest
    is joined.
    """
    rows = packed(docs)
    spark, store = docs.sparkSession, scratch(docs, "ngrams")
    kept = [c for c in docs.columns if c != text]
    mark = F.crc32(F.coalesce(F.col(f"given.`{key}`").cast("string"), F.lit("")).cast("binary")) % parts == held_out
    source = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        F.monotonically_increasing_id().alias("id"),
        mark.alias("held_out"),
        F.col(f"given.`{text}`").alias("text"),
    )
    learnt = source.where(~F.col("held_out")).select("text")
    size = learnt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(-(-size // block_text)).bit_length())
    gathered = learnt.mapInArrow(_counter(bits), "grams int, block int, size int, data binary")
    merged = gathered.groupBy("grams", "block").applyInArrow(
        _merge, "grams int, block int, size bigint, total bigint, entries bigint, hashes binary, counts binary"
    )
    counts = store.save(merged, "counts")
    sums = {g: (n, t) for g, n, t in counts.groupBy("grams").agg(F.sum("size"), F.sum("total")).collect()}
    distinct, total = sums.get(1, (0, 0))

    # The frequent words: the lowest count so that the words with it or more are few enough.
    words = counts.where("grams = 1").select("hashes", "counts")
    histogram = words.mapInArrow(_per_block(_count_sizes, _SIZES), "count bigint, words bigint")
    least, held = HEAD_COUNT, 0
    for count, n in histogram.groupBy("count").agg(F.sum("words")).orderBy(F.desc("count")).toLocalIterator():
        held += n
        if count < HEAD_COUNT:
            break
        if held > head_words:
            least = count + 1
            break
    head_rows = words.mapInArrow(_per_block(_head(least), _HEAD), "hashes binary, counts binary").collect()
    head = np.concatenate([np.frombuffer(r[0], np.uint64) for r in head_rows] or [np.zeros(0, np.uint64)])
    head_counts = np.concatenate([np.frombuffer(r[1], np.int64) for r in head_rows] or [np.zeros(0, np.int64)])
    order = np.argsort(head)
    head, head_counts = head[order], head_counts[order].astype(np.int64)
    del head_rows

    # One filter for both orders: a block's part holds what the block has of either.
    entries = counts.agg(F.sum("entries")).first()[0] or 0
    part_bits = 64 * max(1, -(-int(entries * BITS_PER_ENTRY) // (64 << bits)))
    per_round = max(1, filter_bytes * 8 // part_bits)
    state = source.withColumn("levels", F.lit(None).cast("binary"))
    result = state.drop("text")
    for name, kind in (("n_tokens", "bigint"), ("n_known", "bigint"), ("base", "double"), ("score", "double")):
        result = result.withColumn(name, F.lit(0).cast(kind))
    result = result.withColumn("rare", F.array().cast("array<struct<hash:bigint,times:bigint>>"))
    for low in range(0, 1 << bits, per_round):
        blocks = counts.where((F.col("block") >= low) & (F.col("block") < low + per_round))
        built = blocks.select("block", "hashes", "counts").mapInArrow(
            _per_block(_build(part_bits), _BUILT), "block int, data binary"
        )
        parts_here: dict[int, np.ndarray] = {}
        for block, data in built.toLocalIterator():
            bits_here = np.frombuffer(data, np.uint8)
            parts_here[block] = parts_here[block] | bits_here if block in parts_here else bits_here
        whole = {
            b: bytes(parts_here[b]) if b in parts_here else bytes(part_bits // 8)
            for b in range(low, min(low + per_round, 1 << bits))
        }
        model = {"head": head, "counts": head_counts, "bloom": BloomCounts(whole, bits, part_bits)}
        shared = spark.sparkContext.broadcast(model)
        del parts_here, whole, model
        last = low + per_round >= 1 << bits
        target = result.schema if last else state.schema
        names = [f.name for f in target.fields]
        others = to_arrow_schema((result if last else state).drop("row").schema)
        arrow = pa.schema([others.field(n) if n != "row" else pa.field("row", pa.null()) for n in names])
        scored = state.mapInArrow(_scorer(shared, arrow, smoothing, total, distinct, last), target)
        state = store.save(scored, f"scores-{low}")

    # Rare words: their counts by hash, each word once for a document.
    rare = state.select("id", F.explode("rare").alias("x")).select("id", "x.hash", "x.times")
    tail = words.mapInArrow(_per_block(_tail(least), _TAIL), "hash bigint, count bigint")
    value = F.log10((F.coalesce("count", F.lit(0)) + 1).cast("double")) - F.log10(F.lit(float(total + distinct + 1)))
    added = (
        rare.join(tail, "hash", "left")
        .groupBy("id")
        .agg(
            F.sum(F.col("times") * value).alias("rare_base"),
            F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    return unpacked(
        state.join(added, "id", "left"),
        kept,
        held_out=F.col("held_out"),
        n_tokens=F.col("n_tokens"),
        n_known=F.col("n_known") + F.coalesce("rare_known", F.lit(0)),
        train_tokens=F.lit(int(total)).cast("long"),
        base_score=F.col("base") + F.coalesce("rare_base", F.lit(0.0)),
        score=F.col("score"),
    )


_SIZES = pa.schema([("count", pa.int64()), ("words", pa.int64())])
_HEAD = pa.schema([("hashes", pa.binary()), ("counts", pa.binary())])
_TAIL = pa.schema([("hash", pa.int64()), ("count", pa.int64())])
_BUILT = pa.schema([("block", pa.int32()), ("data", pa.binary())])


def _count_sizes(row: dict) -> pa.RecordBatch:
    values, words = np.unique(_read(row)[1], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values), pa.array(words)], schema=_SIZES)


def _head(least: int):
    def body(row: dict) -> pa.RecordBatch:
        hashes, counts = _read(row)
        often = counts >= least
        return pa.RecordBatch.from_arrays(
            [pa.array([hashes[often].tobytes()], pa.binary()), pa.array([counts[often].tobytes()], pa.binary())], schema=_HEAD
        )

    return body


def _tail(least: int):
    def body(row: dict) -> pa.RecordBatch:
        hashes, counts = _read(row)
        seldom = counts < least
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes[seldom].view(np.int64)), pa.array(counts[seldom])], schema=_TAIL
        )

    return body


def _build(part_bits: int):
    def body(row: dict) -> pa.RecordBatch:
        data = filter_part(row, part_bits).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), pa.array([data], pa.binary())], schema=_BUILT)

    return body


def is_held_out(key: str, parts: int = 7, held_out: int = 2) -> bool:
    return zlib.crc32(key.encode()) % parts == held_out
