"""Quality rules: lines that many documents of a host share are removed, depleted documents rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import SPACE, let, packed, scratch, unpacked, words

# A host's line is shared by too many if more of its documents have it than this number and this multiple
# of the square root of their number: 3 of up to 36 documents, 11 of 500, 707 of two million.
MIN_DOCUMENTS = 3
GROWTH = 0.5
# A document is depleted if fewer words, or less of its words, than this are left.
MIN_WORDS = 50
MIN_LEFT = 0.5
# Shared lines up to this number are compared within each row; more are joined.
LITERAL_LINES = 10_000
# A text is one of a group of near copies if lines of other texts of its host hold this share of its words.
COPY_SHARE = 0.75


def _repeated(tokens: Column) -> Column:
    """Words that lie in a three-word window found at least twice, the first included.

    Windows are compared by 64-bit hash. They are sorted with their places; equal neighbours are
    repeated, and a repeated window covers as many words as lie before the next repeated one, three
    at most.
    """
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        n = F.size(h) - 2
        pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(h, F.lit(3), n), lambda a, b: F.xxhash64(a, b))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("hash"), i.alias("place"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            same = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, F.lit(2), n), lambda a, b: a["hash"] == b["hash"])
            # Element i of the sorted windows is repeated if it equals the one before or after it.
            before = F.concat(F.array(F.lit(False)), same)
            after = F.concat(same, F.array(F.lit(False)))
            found = F.zip_with(before, after, lambda a, b: a | b)
            marked = F.zip_with(s, found, lambda x, f: F.when(f, x["place"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            n = F.size(p)
            steps = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, F.lit(2), n), lambda a, b: F.least(F.lit(3), b - a))
            return F.when(n > 0, F.aggregate(steps, F.lit(3), lambda a, b: a + b)).otherwise(0)

        return let(let(ordered, places), total)

    return F.when(
        F.size(tokens) >= 4,
        let(
            let(hashes, windows),
            lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0),
        ),
    ).otherwise(0)


def text_counts(text: Column) -> dict[str, Column]:
    """Counts of a text's words, symbols, repeated lines and repeated words."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    found = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return {
        "counts": found,
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def normalised(line: Column) -> Column:
    """Lower case, white space as one space, digits as 0: how lines are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), r"\d+", "0"))


def near_copies(texts: DataFrame, copy_share: float) -> DataFrame:
    """Distinct texts (``host content held``) with ``content`` replaced by one value per group of near copies.

    Lines are compared as they are. A text belongs to a group if lines that another text of the host
    holds have ``copy_share`` of its words. Such lines are ordered by the texts that hold them, then by
    their MD5, and the line in the middle of their words names the group: boilerplate stands above it
    and edited lines below, so a group has a few names at most, however many texts and edits it has.
    """
    lines = texts.select("host", "content", F.explode("held").alias("x")).select("host", "content", "x.raw", "x.words")
    times = lines.groupBy("host", "raw").agg(F.count("*").alias("times")).where("times > 1")
    common = (
        lines.join(times, ["host", "raw"])
        .groupBy("host", "content")
        .agg(
            F.sum("words").alias("common"),
            F.sort_array(F.collect_list(F.struct("times", "raw", "words"))).alias("found"),
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("raw"))
    middle = F.aggregate(
        "found",
        start,
        lambda at, x: F.when(2 * at["n"] >= F.col("common"), at).otherwise(
            F.struct((at["n"] + x["words"]).alias("n"), x["raw"].alias("raw"))
        ),
    )
    named = common.select("host", "content", "common", middle["raw"].alias("name"))
    total = F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return texts.join(named, ["host", "content"], "left").select(
        "host",
        F.when(F.col("common") >= copy_share * total, F.col("name"))
        .otherwise(F.col("content").cast("string"))
        .alias("content"),
        F.array_distinct("held.line").alias("held"),
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    growth: float = GROWTH,
    min_words: int = MIN_WORDS,
    min_left: float = MIN_LEFT,
    keep_text: bool = False,
    literal_lines: int = LITERAL_LINES,
    copy_share: float = COPY_SHARE,
) -> DataFrame:
    """Every row of ``docs`` with its counts, the words its removed lines had, and the verdict.

    The text itself is returned only with ``keep_text``; then it lacks the removed lines.

    Columns added: ``n_words word_chars n_symbols n_dup_lines n_repeat_words removed_words
    removed_lines base_failed kept``; columns of ``docs`` with such a name are replaced.
    ``removed_lines`` has the hashes of the lines to remove (see ``remove_lines``).

    Lines are normalised and hashed with their host. A line is removed in a host if more than
    ``min_documents`` of the host's documents hold it, and more than ``growth`` times the square root of
    their number. Near copies count as one document (see ``near_copies``), so groups of copies do not
    make each other's lines look like boilerplate; which copy to keep is the business of
    deduplication. ``kept`` is false for texts that fail the base rules, or of which fewer than
    ``min_words`` words or less than ``min_left`` of the words remain.

    Null texts are empty texts and fail; null hosts are one host; repeated rows and ties get equal
    verdicts; an empty table gives no rows. Texts are read whole, once to count lines and once to
    judge. Only hashes and counts are shuffled; counts are combined before the shuffle, so a line that
    every document has is no hot key. Up to ``literal_lines`` shared lines are looked up within the
    row; more are joined to the documents, with the same result.
    """
    rows = packed(docs)
    body, place = F.col(f"given.`{text}`"), F.col(f"given.`{host}`")
    counts = text_counts(body)
    split = F.split(F.coalesce(body, F.lit("")), "\n")

    def hashed(line: Column, *more: Column) -> Column:
        return let(
            normalised(line),
            lambda x: F.struct(
                F.xxhash64(place, x).alias("line"),
                F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("words"),
                *more,
            ),
        )

    line_hashes = F.filter(F.transform(split, lambda line: hashed(line)), lambda x: x["words"] > 0)
    kept_columns = [c for c in docs.columns if keep_text or c != text]
    store = scratch(docs, "quality")

    # Texts are told apart by hash and length. The per-host line hash holds the host, so a line is one number.
    content = F.xxhash64(body, F.length(body))
    exact = lambda line: F.substring(F.md5(line.cast("binary")), 1, 16).alias("raw")
    held = F.filter(F.transform(split, lambda line: hashed(line, exact(line))), lambda x: x["words"] > 0)
    distinct = (
        rows.select(F.xxhash64(place).alias("host"), content.alias("content"), held.alias("held"))
        .groupBy("host", "content")
        .agg(F.array_distinct(F.first("held")).alias("held"))
    )
    distinct = store.save(distinct, "distinct")
    counted = store.save(near_copies(distinct, copy_share), "copies")
    holding = counted.select("host", "content", F.explode("held").alias("line")).distinct()
    per_line = (
        holding.groupBy("line")
        .agg(F.count("*").alias("documents"), F.first("host").alias("host"))
        .where(F.col("documents") > min_documents)
    )
    per_host = counted.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of"))
    too_many = F.col("documents") > growth * F.sqrt("of")
    shared = store.save(per_line.join(per_host, "host").where(too_many).select("line"), "shared")

    judged = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept_columns], F.lit(1).alias("_unused")).alias("row"),
        F.monotonically_increasing_id().alias("id"),
        *[v.alias(k) for k, v in counts.items()],
        line_hashes.alias("lines"),
    )
    lines = [r[0] for r in shared.limit(literal_lines + 1).collect()]
    if len(lines) <= literal_lines:
        # A set of literals is looked up at the same cost however many they are.
        judged = judged.withColumn("held", F.filter("lines", lambda x: x["line"].isin(lines))).select(
            "row",
            "id",
            *counts,
            F.array_distinct("held.line").alias("removed_lines"),
            F.aggregate("held", F.lit(0), lambda n, x: n + x["words"]).alias("removed_words"),
        )
    else:
        judged = store.save(judged, "documents")
        hits = (
            judged.select("id", F.explode("lines").alias("x"))
            .select("id", "x.line", "x.words")
            .join(shared, "line")
            .groupBy("id")
            .agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
        )
        judged = judged.join(hits, "id", "left")
    n = F.col("counts.n_words")
    left = n - F.coalesce(F.col("removed_words"), F.lit(0))
    removed = F.coalesce(F.col("removed_lines"), F.array().cast("array<bigint>"))
    cut = {text: remove_lines(F.col(f"row.`{text}`"), F.col(f"row.`{host}`"), removed)} if keep_text else {}
    failed = (n < 50) | (100 * F.col("counts.n_repeat_words") > 50 * n)
    return unpacked(
        judged,
        kept_columns,
        n_words=n,
        word_chars=F.col("counts.word_chars"),
        n_symbols=F.col("n_symbols"),
        n_dup_lines=F.col("n_dup_lines"),
        n_repeat_words=F.col("counts.n_repeat_words"),
        removed_words=F.coalesce(F.col("removed_words"), F.lit(0)).cast("long"),
        removed_lines=removed,
        **cut,
        base_failed=failed,
        # The id keeps a later filter above the counts, which would else be computed twice.
        kept=~failed & (left >= min_words) & (left >= min_left * n) & (F.col("id") >= 0),
    )


def remove_lines(text: Column, host: Column, removed: Column) -> Column:
    """The text without the lines whose hashes ``removed`` lists."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(host, normalised(x))))
    return F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(text)
