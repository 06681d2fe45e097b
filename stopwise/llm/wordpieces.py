"""Token counts by greedy longest match, read off an automaton without building the pieces."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import packed, unpacked

# Vocabulary bytes that may be broadcast.
MAX_VOCABULARY = 16_000_000
# Words whose counts a task remembers.
REMEMBERED = 200_000
# How a text is cut into words before they are matched: fixed, as the vocabulary expects it.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a vocabulary file: a piece in base64 and its rank on each line."""
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary is larger than {MAX_VOCABULARY} bytes")
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """Trie of the pieces with failure links and the number of pieces that following one completes.

    ``link[v]`` is where matching goes on if no edge of ``v`` fits: at the end of what is left of the
    path to ``v`` once its longest leading pieces are cut off; ``popped[v]`` is how many those are.
    A link of -1 means that no piece begins the path. So a word is matched in one pass over its bytes.
    """

    def __init__(self, pieces: list[bytes]):
        self.next: dict[int, int] = {}
        parent, symbol, ends = [-1], [0], [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                edge = node << 8 | byte
                child = self.next.get(edge)
                if child is None:
                    child = self.next[edge] = len(parent)
                    parent.append(node)
                    symbol.append(byte)
                    ends.append(False)
                node = child
            if node:
                ends[node] = True
        self.link, self.popped = [-1] * len(parent), [0] * len(parent)
        depth = np.zeros(len(parent), np.int64)
        for node in range(1, len(parent)):
            depth[node] = depth[parent[node]] + 1
        for node in np.argsort(depth, kind="stable")[1:].tolist():
            if ends[node]:
                self.link[node], self.popped[node] = 0, 1
                continue
            at, count = self.link[parent[node]], self.popped[parent[node]]
            while at >= 0 and (at << 8 | symbol[node]) not in self.next:
                count += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.next[at << 8 | symbol[node]], count

    def count(self, word: bytes) -> int:
        """Pieces of the word by greedy longest match; 1, an unknown word, if they cannot cover it."""
        follow, link, popped = self.next.get, self.link, self.popped
        node, total = 0, 0
        for byte in word:
            child = follow(node << 8 | byte)
            while child is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                child = follow(node << 8 | byte)
            node = child
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return total


def _counter(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, find, known = shared.value, regex.compile(pattern).findall, {}
        for batch in batches:
            sizes, lengths = [], []
            for text in batch.column("text").to_pylist():
                found = find(text or "")
                total = 0
                for word in found:
                    count = known.get(word)
                    if count is None:
                        count = automaton.count(word.encode("utf-8", "surrogatepass"))
                        if len(known) >= REMEMBERED:
                            known.clear()
                        if len(word) <= 64:
                            known[word] = count
                    total += count
                sizes.append(total)
                lengths.append(len(found))
            arrays = [batch.column("row"), pa.array(lengths, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", pattern: str = WORDS) -> DataFrame:
    """Every row of ``docs``, without its text, with ``n_words`` and ``n_tokens`` of its whole text.

    ``vocabulary`` is the path of a file of byte pieces (see ``read_vocabulary``), read by the driver;
    its automaton is broadcast, its size bounded by ``MAX_VOCABULARY``. The text is cut into words by
    ``pattern``; a word's pieces are its greedy longest matches, and a word that the pieces cannot
    cover is one unknown token.

    Null and empty texts have no tokens; repeated rows are counted each; an empty table gives no
    rows; columns with the added names are replaced. Nothing is shuffled.
    """
    rows = packed(docs)
    kept = [c for c in docs.columns if c != text]
    narrow = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        F.col(f"given.`{text}`").alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))
    out = narrow.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_tokens"))
    found = narrow.mapInArrow(_counter(shared, pattern), out.schema)
    return unpacked(found, kept, n_words=F.col("n_words"), n_tokens=F.col("n_tokens"))
