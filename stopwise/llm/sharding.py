"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopwise.llm.common import packed, scratch, unpacked
from stopwise.operators.numbering import number_within

# Bits of a sort key: of the text's hash, of the key's hash, and of the row.
TEXT_BITS, KEY_BITS, ROW_BITS = 36, 19, 8
BITS = TEXT_BITS + KEY_BITS + ROW_BITS
# Cells that a round of counting divides an interval of keys into: 2 ** CELL_BITS.
CELL_BITS = 12
# Bytes and rows on average after which a shard is sorted over several tasks.
PIECE_BYTES, PIECE_ROWS = 1 << 30, 1_000_000


def sort_key(text: Column, key: Column, row: Column) -> Column:
    """A number of 63 bits; equal texts are neighbours, but can be divided between them."""

    def part(value: Column, bits: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)

    return (
        F.shiftleft(part(text, TEXT_BITS), KEY_BITS + ROW_BITS)
        + F.shiftleft(part(key.cast("string"), KEY_BITS), ROW_BITS)
        + part(row, ROW_BITS)
    )


def splitters(keyed: DataFrame, parts: int, tolerance: float) -> tuple[list[tuple[int, int]], int]:
    """(key, rows below it) for the ``parts - 1`` boundaries, and all bytes, from rows (key, size).

    A round counts the exact bytes of the cells that hold a wanted boundary, in all partitions at
    once. A boundary is settled if an edge of a cell is within ``tolerance`` of a part's bytes, or if
    its cell is a single key; else the cell is divided again. Between rounds the driver holds the
    counts of at most ``2 ** CELL_BITS`` cells for each open boundary.
    """
    shift = BITS - CELL_BITS
    first = _counted(keyed, shift)
    total = sum(size for _, size, _ in first)
    # An open boundary: its place in bytes, and the cells it is in with what lies below them.
    found: dict[int, tuple[int, int]] = {}
    open_ = {i: (first, 0, 0) for i in range(1, parts)}
    sums: dict[int, tuple[list[int], list[int]]] = {}
    while open_:
        deeper: dict[int, list[tuple[int, int, int]]] = {}
        sums.clear()
        for i, (counts, low, below) in open_.items():
            wanted = total * i / parts
            known = sums.get(id(counts))
            if known is None:
                ends, rows, a, b = [], [], low, below
                for _, size, n in counts:
                    a, b = a + size, b + n
                    ends.append(a)
                    rows.append(b)
                known = sums[id(counts)] = (ends, rows)
            ends, rows = known
            if not counts:
                found[i] = (1 << BITS, 0)
                continue
            at = min(bisect_left(ends, wanted), len(counts) - 1)
            cell, size, n = counts[at]
            before, after = ends[at] - size, ends[at]
            start, stop = cell << shift, (cell + 1) << shift
            near_start = wanted - before <= after - wanted
            if min(wanted - before, after - wanted) <= tolerance * total / parts or shift == 0:
                found[i] = (start, rows[at] - n) if near_start else (stop, rows[at])
            else:
                deeper.setdefault(cell, []).append((i, before, rows[at] - n))
        if not deeper:
            break
        shift_next = max(0, shift - CELL_BITS)
        step = shift - shift_next
        counted = _count_within(keyed, shift, step, sorted(deeper))
        open_ = {i: (counted[cell], a, b) for cell, which in deeper.items() for i, a, b in which}
        shift = shift_next
    # Boundaries never cross, also where one key is too large to divide.
    ordered = []
    for i in range(1, parts):
        ordered.append(max(found[i], ordered[-1]) if ordered else found[i])
    return ordered, total


def _counted(rows: DataFrame, shift: int) -> list[tuple[int, int, int]]:
    """(cell, bytes, rows) of the cells of 2 ** shift keys, in order."""
    cells = rows.groupBy(F.shiftright("key", shift).alias("cell"))
    return sorted(map(tuple, cells.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()))


def _count_within(keyed: DataFrame, shift: int, step: int, cells: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Counts of the 2 ** step cells within each of ``cells``."""
    found: dict[int, list[tuple[int, int, int]]] = {c: [] for c in cells}
    for c, size, n in _counted(keyed.where(F.shiftright("key", shift).isin(cells)), shift - step):
        found[c >> step].append((c, size, n))
    return found


def shard(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    shards: int = 16,
    tolerance: float = 0.001,
    piece_bytes: int = PIECE_BYTES,
    piece_rows: int = PIECE_ROWS,
    keep_text: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` and its ``slot`` there, shards of near equal bytes.

    Columns added (or replaced): ``size`` (UTF-8 bytes and one more), ``text_crc32``, ``shard`` from 0,
    ``slot`` (gapless from 0 in each shard). The text comes back with ``keep_text`` only.

    Rows are in the order of a key from text, ``key`` and row, so equal texts are neighbours. Exact
    bytes below candidate boundaries are counted until every boundary is within ``tolerance`` of a
    shard's bytes; then rows are exchanged once. Shards that have, on average, up to ``piece_bytes`` and
    ``piece_rows`` are sorted in a task each, larger ones over many tasks (``number_within``); either
    gives the same slots.

    Null texts are empty (size 1); null keys are equal keys; copies and repeated rows may be divided
    between neighbouring shards; a single text larger than a shard stays whole; an empty table gives
    no rows. The driver holds the counts of key cells: ``2 ** CELL_BITS`` for each boundary between
    shards, whatever the rows and their bytes.
    """
    rows = packed(docs)
    store = scratch(docs, "sharding")
    body = F.coalesce(F.col(f"given.`{text}`"), F.lit(""))
    kept = [c for c in docs.columns if keep_text or c != text]
    keyed = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("crc"),
        sort_key(body, F.col(f"given.`{key}`"), F.monotonically_increasing_id()).alias("key"),
    )
    keyed = store.save(keyed, "rows")
    narrow = keyed.select("key", "size")
    bounds = [key for key, _ in splitters(narrow, shards, tolerance)[0]]

    # The shard of a row: those that begin in its cell of keys at or below it, after those before.
    shift = BITS - CELL_BITS
    edges = [0, *bounds]
    cells = []
    for cell in range(1 << CELL_BITS):
        low, high = bisect_right(edges, cell << shift), bisect_right(edges, ((cell + 1) << shift) - 1)
        cells.append((cell, low - 1, edges[low:high]))
    places = docs.sparkSession.createDataFrame(cells, "cell int, first int, edges array<bigint>")
    inside = F.size(F.filter("edges", lambda e: e <= F.col("key")))
    dealt = keyed.join(F.broadcast(places), F.shiftright("key", shift).cast("int") == F.col("cell"))
    dealt = dealt.withColumn("shard", F.col("first") + inside).drop("cell", "first", "edges")
    n, total = narrow.agg(F.count(F.lit(1)), F.sum("size")).first()
    order = [F.col("key"), F.col("crc")]
    if n <= shards * piece_rows and (total or 0) <= shards * piece_bytes:
        slot = F.row_number().over(Window.partitionBy("shard").orderBy(*order))
        placed = dealt.withColumn("place", slot)
    else:
        placed = number_within(dealt, ["shard"], order, "place")
    return unpacked(
        placed,
        kept,
        size=F.col("size"),
        text_crc32=F.col("crc"),
        shard=F.col("shard").cast("int"),
        slot=(F.col("place") - 1).cast("long"),
    )
