"""SQL for the text queries that SQL can express, written from their definitions and not from their steps."""

from __future__ import annotations

import string

from stopwise.llm import licenses, quality

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKEN = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH given AS (
    SELECT row_number() OVER () AS id, doc_id, source, text, coalesce(text, '') AS body FROM documents
),
document AS (
    SELECT *, regexp_extract_all(body, '{_TOKEN}') AS words,
        list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_TOKEN}')) AS full_lines
    FROM given
),
word AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM document),
triple AS (
    SELECT id, place, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS triple
    FROM word WINDOW w AS (PARTITION BY id ORDER BY place)
),
repeated AS (
    SELECT id, place FROM triple WHERE triple IS NOT NULL QUALIFY count(*) OVER (PARTITION BY id, triple) > 1
),
covered AS (
    SELECT id, count(DISTINCT place + step) AS n_repeat_words
    FROM repeated CROSS JOIN (VALUES (0), (1), (2)) AS steps (step) GROUP BY id
),
raw_line AS (SELECT id, source, text, unnest(full_lines) AS raw FROM document),
line AS (
    SELECT id, source, text, raw, trim(regexp_replace(regexp_replace(
        lower(raw), '{_BLANK}', ' ', 'g'), '\d+', '0', 'g'), ' ') AS line
    FROM raw_line
),
held AS (SELECT DISTINCT source, text, raw, line, len(string_split(line, ' ')) AS words FROM line),
times AS (SELECT source, raw, count(*) AS times FROM held GROUP BY source, raw HAVING count(*) > 1),
common AS (
    SELECT held.*, md5(held.raw) AS md5, sum(words) OVER (PARTITION BY held.source, text) AS common,
        sum(words) OVER (PARTITION BY held.source, text ORDER BY times, md5(held.raw)) AS upto
    FROM held JOIN times ON held.raw = times.raw AND held.source IS NOT DISTINCT FROM times.source
),
middle AS (
    SELECT source, text, common, arg_min(md5, upto) AS name FROM common WHERE 2 * upto >= common
    GROUP BY source, text, common
),
total AS (SELECT source, text, sum(words) AS words FROM held GROUP BY source, text),
-- Near copies: three quarters of the words are in lines that other texts of the host hold too.
counted_as AS (
    SELECT texts.source, texts.text,
        CASE WHEN common >= {quality.COPY_SHARE} * total.words THEN 'copy of ' || name
            WHEN texts.text IS NOT NULL THEN 'text ' || texts.text ELSE 'none' END AS counted
    FROM (SELECT DISTINCT source, text FROM given) AS texts
    LEFT JOIN middle ON middle.text = texts.text AND middle.source IS NOT DISTINCT FROM texts.source
    LEFT JOIN total ON total.text = texts.text AND total.source IS NOT DISTINCT FROM texts.source
),
host AS (SELECT source, count(DISTINCT counted) AS documents FROM counted_as GROUP BY source),
holding AS (
    SELECT held.source, held.line, count(DISTINCT counted) AS documents
    FROM held JOIN counted_as ON held.text = counted_as.text AND held.source IS NOT DISTINCT FROM counted_as.source
    GROUP BY held.source, held.line
),
shared AS (
    SELECT holding.source, holding.line
    FROM holding JOIN host ON holding.source IS NOT DISTINCT FROM host.source
    WHERE holding.documents > {quality.MIN_DOCUMENTS}
        AND holding.documents > {quality.GROWTH} * sqrt(host.documents)
),
removed AS (
    SELECT line.id, sum(len(string_split(line.line, ' '))) AS removed_words
    FROM line JOIN shared ON line.line = shared.line AND line.source IS NOT DISTINCT FROM shared.source
    GROUP BY line.id
),
counted AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
        len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
    FROM document LEFT JOIN covered USING (id) LEFT JOIN removed USING (id)
),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND n_words - removed_words >= {quality.MIN_WORDS}
        AND n_words - removed_words >= {quality.MIN_LEFT} * n_words AS kept,
    removed_words::BIGINT AS removed_words
FROM failed
"""


def _benchmark_hits(window: int) -> str:
    following = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, window))
    starts = [" || ' ' || ".join(["word", *(f"w{k}" for k in range(1, size))]) for size in range(1, window + 1)]
    return rf"""
WITH document AS (
    SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents
),
item AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM benchmark),
item_start AS (
    SELECT item_id, words, least({window}, len(words)) AS size,
        unnest(generate_series(1, len(words) - least({window}, len(words)) + 1)) AS place
    FROM item WHERE len(words) > 0
),
item_window AS (
    SELECT DISTINCT item_id, size, array_to_string(words[place : place + size - 1], ' ') AS phrase FROM item_start
),
phrase AS (SELECT DISTINCT size, phrase FROM item_window),
word AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM document),
ahead AS (
    SELECT id, place, word, {following} FROM word WINDOW w AS (PARTITION BY id ORDER BY place)
),
start AS (SELECT id, place, [{", ".join(starts)}] AS by_size FROM ahead),
found AS (
    SELECT start.id, start.place, phrase.size, phrase.phrase
    FROM start CROSS JOIN (SELECT DISTINCT size FROM phrase) AS sizes
    JOIN phrase ON phrase.size = sizes.size AND phrase.phrase = start.by_size[sizes.size]
),
hit AS (
    SELECT id, count(DISTINCT place) AS n_hit
    FROM (SELECT id, unnest(generate_series(place, place + size - 1)) AS place FROM found) AS places GROUP BY id
),
owner AS (
    SELECT DISTINCT found.id, item_window.item_id::VARCHAR AS item
    FROM found JOIN item_window USING (size, phrase) WHERE item_window.item_id IS NOT NULL
),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM owner GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM document LEFT JOIN hit USING (id) LEFT JOIN items USING (id)
"""


def _license_scan() -> str:
    steps = max(len(p.split()) for p in licenses.PHRASES.values())
    following = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, steps))
    columns = ["word", *(f"w{k}" for k in range(1, steps))]
    tests = {
        label: " AND ".join(f"{c} = '{word}'" for c, word in zip(columns, phrase.split()))
        for label, phrase in licenses.PHRASES.items()
    }
    places = " UNION ALL ".join(f"SELECT id, place, '{label}' AS label FROM ahead WHERE {t}" for label, t in tests.items())
    sets = [(label, licenses._distinct_words(notice)) for label, notice in licenses.NOTICES]
    held = ", ".join(f"({i}, '{label}', '{w}', {len(s)})" for i, (label, s) in enumerate(sets) for w in s)
    return rf"""
WITH document AS (
    SELECT row_number() OVER () AS id, doc_id, {_LOWER} AS body, regexp_extract_all({_LOWER}, '{_WORD}') AS words
    FROM documents
),
word AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM document),
ahead AS (SELECT id, place, word, {following} FROM word WINDOW w AS (PARTITION BY id ORDER BY place)),
found AS ({places}),
base AS (
    SELECT id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM found GROUP BY id
),
notice AS (SELECT * FROM (VALUES {held}) AS words (notice, label, word, size)),
block AS (
    -- Every line with the one after it.
    SELECT id, false AS wrapped, lines[number] || chr(10) || coalesce(lines[number + 1], '') AS block, number
    FROM (
        SELECT id, string_split(body, chr(10)) AS lines, generate_subscripts(string_split(body, chr(10)), 1) AS number
        FROM document
    ) AS line
    UNION ALL
    SELECT id, true, unnest(string_split_regex(body, '\n[\x20\x09-\x0D]*\n')),
        generate_subscripts(string_split_regex(body, '\n[\x20\x09-\x0D]*\n'), 1)
    FROM document
),
block_word AS (
    SELECT id, wrapped, number, unnest(list_distinct(regexp_extract_all(block, '{_WORD}'))) AS word FROM block
),
held AS (
    SELECT id, wrapped, number, notice, label, count(*) / size AS share
    FROM block_word JOIN notice USING (word)
    WHERE wrapped = (size >= {licenses.WRAPPED})
    GROUP BY id, wrapped, number, notice, label, size
    HAVING count(*) >= {licenses.CONTAINMENT} * size - 1e-9
),
share AS (SELECT id, max(share) AS share FROM held GROUP BY id),
labelled AS (
    SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT id, label FROM found UNION ALL SELECT id, label FROM held) AS every GROUP BY id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM document LEFT JOIN base USING (id) LEFT JOIN share USING (id) LEFT JOIN labelled USING (id)
"""


ORACLE: dict[str, str] = {
    "op4_quality_rules": QUALITY_RULES,
    "op9_benchmark_hits": _benchmark_hits(window=13),
    "op10_license_scan": _license_scan(),
}
