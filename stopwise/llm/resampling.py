"""Importance resampling towards a target: hashed word runs, counted once for every distinct line."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import packed, scratch, unpacked
from stopwise.operators.numbering import number_within

# Lines that a task remembers with their features, and the length of the longest of them.
REMEMBERED, MEMORABLE = 50_000, 2_000
# Lines that are counted at a time.
LINES = 4_000

# Bytes of words stay, A-Z lower-cased; all others separate.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def words_of(segment: bytes) -> list[bytes]:
    return segment.translate(_WORD_BYTES).split()


def _hashes(words: list[bytes], longest: int) -> list[int]:
    """Hashes of all runs of up to ``longest`` words, joined by one space."""
    spaced = [b" " + w for w in words]
    hashed = [crc32(w) for w in words]
    found = list(hashed)
    for k in range(1, longest):
        hashed = [crc32(word, h) for h, word in zip(hashed, spaced[k:])]
        found += hashed
    return found


def _across(tail: list[bytes], head: list[bytes], longest: int) -> list[int]:
    """Hashes of the runs that begin in ``tail`` and end in ``head``, the next line's first words."""
    both, found = tail + head, []
    for begin in range(len(tail)):
        h = crc32(both[begin])
        for end in range(begin + 1, min(begin + longest, len(both))):
            h = crc32(b" " + both[end], h)
            if end >= len(tail):
                found.append(h)
    return found


class _Counts:
    """Features by bucket, gathered over a task."""

    def __init__(self, buckets: int):
        self.buckets, self.n = buckets, np.zeros(buckets, np.int64)
        self._hashes: list[int] = []
        self._lengths: list[int] = []
        self._times: list[int] = []

    def add(self, hashes: list[int], times: int) -> None:
        self._hashes += hashes
        self._lengths.append(len(hashes))
        self._times.append(times)
        if len(self._lengths) >= LINES:
            self.flush()

    def flush(self) -> None:
        bucket = np.array(self._hashes, np.int64) % self.buckets
        np.add.at(self.n, bucket, np.repeat(np.array(self._times, np.int64), self._lengths))
        self._hashes, self._lengths, self._times = [], [], []

    def batch(self) -> pa.RecordBatch:
        self.flush()
        used = np.flatnonzero(self.n)
        arrays = [pa.nulls(len(used), pa.binary()), pa.array(used, pa.int64()), pa.array(self.n[used], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["line", "bucket", "n"])


def _cut(longest: int, buckets: int):
    """Distinct lines of each batch with their occurrences, and the features that run across lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = _Counts(buckets)
        for batch in batches:
            lines: dict[bytes, int] = {}
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                tail: list[bytes] = []
                for line in (text or b"").split(b"\n"):
                    words = words_of(line)
                    if not words:
                        continue
                    lines[line] = lines.get(line, 0) + 1
                    if longest > 1:
                        if tail:
                            across.add(_across(tail, words[: longest - 1], longest), 1)
                        tail = (tail + words[1 - longest :])[1 - longest :]
            arrays = [
                pa.array(list(lines), pa.binary()),
                pa.nulls(len(lines), pa.int64()),
                pa.array(list(lines.values()), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["line", "bucket", "n"])
        yield across.batch()

    return run


def _count(longest: int, buckets: int):
    """Features by bucket: of each distinct line once, times its occurrences, and those counted before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(buckets)
        for batch in batches:
            for line, bucket, n in zip(*(batch.column(c).to_pylist() for c in ("line", "bucket", "n"))):
                if line is None:
                    counts.n[bucket] += n
                else:
                    counts.add(_hashes(words_of(line), longest), n)
        yield counts.batch()

    return run


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """``bucket`` and ``n``: how many runs of 1 to ``longest`` words of all texts fall into each bucket.

    A run's bucket is the CRC-32 of its words, lower-cased and joined by one space, modulo ``buckets``.
    Texts are cut into lines; equal lines are brought together, beginning with those of one batch, and
    the runs of each distinct line are computed once and counted as often as the line occurs. Runs that
    reach from one line into another are added from the texts. Null and empty texts have none.
    """
    given = texts.select(F.col(f"`{text}`").alias("text"))
    schema = "line binary, bucket bigint, n bigint"
    lines = given.mapInArrow(_cut(longest, buckets), schema)
    distinct = lines.groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    counted = distinct.mapInArrow(_count(longest, buckets), schema)
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(here: list[int], target: list[int]) -> list[int]:
    """Of every bucket, a thousand times the log of how much likelier the target has it, smoothed by one."""
    size, all_here, all_target = len(here), sum(here), sum(target)
    return [
        math.floor(1000 * math.log((t + 1) * (all_here + size) / ((s + 1) * (all_target + size))))
        for s, t in zip(here, target)
    ]


def _scorer(shared, seed: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(shared.value, np.int64)
        known: dict[bytes, tuple] = {}

        def worth(hashes: list[int]) -> int:
            return int(gain[np.array(hashes, np.int64) % len(gain)].sum())

        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                n_words = n_features = total = 0
                tail: list[bytes] = []
                for line in (text or b"").split(b"\n"):
                    found = known.get(line)
                    if found is None:
                        words = words_of(line)
                        hashes = _hashes(words, longest)
                        ends = (words[: longest - 1], words[1 - longest :]) if longest > 1 else ([], [])
                        found = (len(words), len(hashes), worth(hashes), *ends)
                        if len(line) <= MEMORABLE:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[line] = found
                    count, features, value, first, last = found
                    if not count:
                        continue
                    n_words, n_features, total = n_words + count, n_features + features, total + value
                    if longest > 1:
                        if tail:
                            hashes = _across(tail, first, longest)
                            n_features, total = n_features + len(hashes), total + worth(hashes)
                        tail = (tail + last)[1 - longest :]
                weight = total // n_features if n_features else 0
                draw = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
                score = weight + math.floor(-1000 * math.log(-math.log((draw + 0.5) / 4294967296)))
                for column, value in zip(columns, (n_words, n_features, weight, score)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["row", "key", "n_words", "n_features", "weight", "score"],
            )

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    percent: int = 25,
    least_words: int = 20,
    longest: int = 2,
    buckets: int = 10_000,
) -> DataFrame:
    """Every row of ``docs``, without its text, with its weight towards the texts of ``target`` and its rank.

    ``weight`` is the floored mean over the text's features (runs of 1 to ``longest`` words) of the
    gain of their buckets (see ``gains``), 0 without features. ``score`` adds noise of the Gumbel
    distribution that depends on ``seed`` and the key only, so the highest scores are a draw without
    replacement by weight. Of the rows of at least ``least_words`` words, ``percent`` of a hundred with
    the highest scores are drawn, and have the ``rank`` 1, 2, ... by score, then key; for others it is
    null. Added besides are ``n_words`` and ``n_features``.

    Null and empty texts have no features and are never drawn. Repeated rows are one each: ties of
    score and key are broken by features and weight, and rows equal in these too are interchangeable.
    A null key counts as an empty one and comes first among ties. Empty tables give no rows, an empty
    target gains from its smoothing alone. Columns with the added names are replaced. Only the counts
    of ``buckets`` buckets come to the driver; ranks are places of a range sort over all tasks.
    """
    here, there = (
        {r.bucket: r.n for r in bucket_counts(df, text, longest, buckets).collect()} for df in (docs, target)
    )
    gain = gains([here.get(b, 0) for b in range(buckets)], [there.get(b, 0) for b in range(buckets)])
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in docs.columns if c != text]
    rows = packed(docs).select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        F.col(f"given.`{key}`").alias("key"),
        F.col(f"given.`{text}`").alias("text"),
    )
    added = ("n_words", "n_features", "weight", "score")
    out = rows.select("row", "key", *[F.lit(0).cast("long").alias(c) for c in added])
    scored = rows.mapInArrow(_scorer(shared, seed, longest), out.schema)
    scored = scratch(docs, "resampling").save(scored.withColumn("enough", F.col("n_words") >= least_words), "scored")
    drawn = scored.where("enough").count() * percent // 100
    order = [F.desc("score"), F.col("key").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    ranked = number_within(scored, ["enough"], order, "place")
    rank = F.when(F.col("enough") & (F.col("place") <= drawn), F.col("place"))
    return unpacked(ranked, kept, **{c: F.col(c) for c in added}, rank=rank)
