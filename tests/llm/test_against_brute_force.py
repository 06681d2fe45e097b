"""Operators against plain Python on the smallest tables, or on rows made for the case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from copies import normal, shared_lines

from stopwise.llm import (
    decontaminate,
    licenses,
    mixing,
    ngrams,
    pages,
    quality,
    sharding,
    simhash,
    substrings,
    weights,
    wordpieces,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def test_token_counts(documents, texts):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pieces = set(wordpieces.read_vocabulary(path))
    longest = max(map(len, pieces))

    def greedy(word):
        at = count = 0
        while at < len(word):
            size = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in pieces), 0)
            if not size:
                return 1
            at, count = at + size, count + 1
        return count

    import regex

    for r in wordpieces.count_tokens(documents, path).limit(60).collect():
        assert r.n_tokens == sum(greedy(w.encode()) for w in regex.findall(wordpieces.WORDS, texts[r.doc_id]))


@pytest.mark.parametrize("pieces", [[b"a", b"ab", b"abc", b"bcd", b"d"], [b"a", b"aa", b"aaab"], [b"ab"]])
def test_automaton_equals_greedy_match(pieces):
    automaton, generator = wordpieces.Automaton(pieces), random.Random(1)
    for _ in range(500):
        word = bytes(generator.choice(b"abcd") for _ in range(generator.randrange(9)))
        at, count = 0, 0
        while at < len(word):
            size = max((len(p) for p in pieces if word.startswith(p, at)), default=0)
            if not size:
                count = 1
                break
            at, count = at + size, count + 1
        assert automaton.count(word) == count


PAGE = (
    "<html><head><title>T</title><script>x='</p>'</script></head><body class='has-sidebar'><nav><a>Menu</a></nav>"
    "<div class='cookie-notice'>We use cookies</div><div class=promo>Buy</div><article class='post'><header><h1>Head"
    " &amp; line</h1><span>by A</span></header><p>First&nbsp;<b>bold</b>\n text<br>more<p>Second &lt;tag&gt;<form>"
    "<input>Search</form><aside>Side</aside><div>Shared by all</div><section id=comments><p>Nice!</section></article>"
    "<footer>Foot</footer>"
)


def test_page_structure():
    lines = [t for t, _ in pages.page_lines(PAGE)]
    assert lines == ["Head & line", "First bold text more", "Second <tag>", "Shared by all"]


def test_lines_shared_with_the_nearest_page_go(spark):
    def plain(i):
        own = "".join(f"<p>own {i} {k}</p>" for k in range(4))
        return f"<body><div>Site name</div>{own}<div>Read more</div></body>"

    rows = [(i, f"http://h/a/{i}", plain(i)) for i in range(30)] + [(30, "http://h/a/7?x=1", plain(7))]
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(30):
        assert found[i] == "\n".join(f"own {i} {k}" for k in range(4))
    # A copy is no template: it is told by its other neighbour only.
    assert found[30] == found[7]


def test_longest_common_subsequence():
    generator = random.Random(2)
    for _ in range(200):
        a, b = ([generator.randrange(5) for _ in range(generator.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = [a[i] for i in pages.aligned(a, b)]
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(x in rest for x in found)


def test_offsets_of_many_contexts():
    """A large group against all windows of all pairs, with few letters so that much is shared."""
    draw = random.Random(8)
    for length, gram, limit in ((30, 10, 1), (30, 10, 400), (24, 20, 1), (40, 8, 900)):
        reach = length - gram + 1
        mark = bytes(draw.choices(b"ab", k=gram))
        tails = [bytes(draw.choices(b"ab", k=draw.randrange(reach + 4))) for _ in range(6)]
        heads = [bytes(draw.choices(b"ab", k=draw.randrange(reach + 4))) for _ in range(6)]
        found = set()
        while len(found) < 60:
            head, tail = draw.choice(heads), draw.choice(tails)
            if draw.random() < 0.5:
                head = bytes(draw.choices(b"ab", k=3)) + head
            if draw.random() < 0.5:
                tail = tail[: draw.randrange(len(tail) + 1)] + bytes(draw.choices(b"ab", k=4))
            head, tail = head[-(reach - 1) :], (mark + tail)[:length]
            found.add((head, tail))
        contexts, left = [h + t for h, t in sorted(found)], np.array([len(h) for h, _ in sorted(found)])
        times = Counter()
        windows = [
            {o: c[b - o : b - o + length] for o in range(reach) if b >= o and len(c) - b >= length - o}
            for c, b in zip(contexts, left.tolist())
        ]
        for of in windows:
            times.update(of.items())
        hits = [[o for o, w in of.items() if times[o, w] > 1] for of in windows]
        least, greatest = substrings.offsets_of_many(contexts, left, length, reach, limit)
        assert least.tolist() == [min(h, default=reach) for h in hits]
        assert greatest.tolist() == [max(h, default=-1) for h in hits]


@pytest.mark.parametrize("settings", [{}, {"group": 1}, {"shard": 2}, {"sorted_bytes": 1_500}, {"length": 40, "gram": 12, "group": 3}])
def test_repeated_strings(documents, texts, settings):
    size = settings.get("length", 400)
    raw = {d: t.encode() for d, t in texts.items()}
    starts = Counter(t[i : i + size] for t in raw.values() for i in range(len(t) - size + 1))
    for r in substrings.repeated_substrings(documents, **settings).collect():
        text = raw[r.doc_id]
        covered = bytearray(len(text))
        for i in range(len(text) - size + 1):
            if starts[text[i : i + size]] > 1:
                covered[i : i + size] = b"\1" * size
        kept = bytes(c for c, x in zip(text, covered) if not x)
        assert r.n_bytes == len(text) and r.n_removed == sum(covered)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert substrings.without(texts[r.doc_id], [(s.start, s.end) for s in r.spans]) == kept


@pytest.mark.parametrize("literal_lines", [10_000, 0])
def test_quality_rules(documents, texts, literal_lines):
    rules = {"min_documents": 1, "growth": 0.2, "literal_lines": literal_lines}
    hosts = {r.doc_id: r.source for r in documents.collect()}
    gone_of = shared_lines([(hosts[d], t) for d, t in texts.items()], least=1, growth=0.2)
    assert any(gone_of.values())
    for r in quality.judge(documents, **rules).collect():
        text, host = texts[r.doc_id], hosts[r.doc_id]
        tokens = TOKEN.findall(text)
        triples = list(zip(tokens, tokens[1:], tokens[2:]))
        times = Counter(triples)
        repeated = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if TOKEN.search(x)]
        shared = [x for x in lines if normal(x) in gone_of[host]]
        gone = sum(len(TOKEN.findall(x)) for x in shared)
        failed = len(tokens) < 50 or 100 * len(repeated) > 50 * len(tokens)
        left = len(tokens) - gone
        expected = (len(tokens), sum(map(len, tokens)), len(lines) - len(set(lines)), len(repeated), gone, failed)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.removed_words, r.base_failed) == expected
        assert r.kept == (not failed and left >= 50 and 2 * left >= len(tokens))


@pytest.mark.parametrize("block", [20_000, 5])
def test_links_equal_all_pairs(spark, block):
    generator = random.Random(3)
    marks = [0, (1 << 64) - 1]
    for _ in range(60):
        mark = generator.getrandbits(64)
        for _ in range(generator.randrange(1, 30)):
            marks.append(mark)
            for _ in range(generator.randrange(5)):
                mark ^= 1 << generator.randrange(64)
    marks = sorted(set(marks))
    frame = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "mark long")
    parent = {m: m for m in marks}

    def root(parents, m):
        while parents[m] != m:
            m = parents[m]
        return m

    found = dict(parent)
    whole = np.array(marks, np.uint64)
    for m in marks:
        for other in whole[np.bitwise_count(whole ^ np.uint64(m)) <= 3].tolist():
            parent[root(parent, m)] = root(parent, other)
    for a, b in simhash.links(frame, 3, block).collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() >= 1
        found[root(found, a)] = root(found, b)
    groups = [Counter(), Counter()]
    for parents, group in zip((parent, found), groups):
        group.update(Counter(root(parents, m) for m in marks).values())
        assert all(root(parent, m) == root(parent, root(parents, m)) for m in marks)
    assert groups[0] == groups[1]


@pytest.mark.parametrize("settings", [{}, {"piece_bytes": 1}, {"piece_rows": 10}])
def test_shards(documents, texts, settings, monkeypatch):
    counted = []
    plain = sharding._counted

    def watched(*args):
        counted.append(plain(*args))
        return counted[-1]

    monkeypatch.setattr(sharding, "_counted", watched)
    found = sharding.shard(documents, shards=4, tolerance=0.01, **settings).collect()
    # What comes to the driver does not depend on the pieces: cells of three boundaries.
    assert max(map(len, counted)) <= 3 * 2**sharding.CELL_BITS and len(counted) <= 6
    assert sorted(r.doc_id for r in found) == sorted(texts)
    total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
    for shard in range(4):
        mine = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 4) <= largest + 0.02 * total / 4
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in found)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 for r in found)
    whole = sharding.shard(documents, shards=4, tolerance=0.01).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in found} == {(r.doc_id, r.shard, r.slot) for r in whole}


@pytest.mark.parametrize("settings", [{}, {"head_words": 100}, {"block_text": 20_000, "filter_bytes": 4_000}])
def test_scores(documents, texts, settings):
    learnt, tokens = Counter(), {}
    for d, t in texts.items():
        tokens[d] = t.encode().lower().split() + [ngrams.END]
        if not ngrams.is_held_out(str(d)):
            learnt.update(tokens[d])
    n, v = sum(learnt.values()), len(learnt)
    score = base = 0
    for r in ngrams.score_texts(documents, **settings).collect():
        expected = sum(math.log10((learnt[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id])
        assert r.base_score == pytest.approx(expected, rel=1e-9) and r.train_tokens == n
        assert r.n_known == sum(w in learnt for w in tokens[r.doc_id]) and r.n_tokens == len(tokens[r.doc_id])
        assert r.held_out == ngrams.is_held_out(str(r.doc_id)) and r.score < 0
        if r.held_out:
            score, base = score + r.score, base + r.base_score
    assert score > base  # the model foretells texts it has not seen better than single words do


def test_drawn_documents_are_those_of_the_smallest_keys(spark, documents):
    """The copies of every document, from its key and a plain sort of each source."""
    weight = weights.fit_weight(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    text, key = documents["text"], documents["doc_id"]
    mark = mixing.draw_marks(text, key, 42)
    keyed = documents.select("doc_id", mark.alias("mark"), mixing.draw_keys(mark, weight(text)).alias("draw"))
    draws = {r.doc_id: (r.draw, r.mark) for r in keyed.collect()}
    assert len({round(r.w, 6) for r in documents.select(weight(text).alias("w")).collect()}) > 5
    for cells in (4096, 1):
        found = mixing.mix(documents, weight=weight, cells=cells).collect()
        for source in {r.source for r in found}:
            mine = sorted((r for r in found if r.source == source), key=lambda r: draws[r.doc_id])
            size, target = mine[0].source_size, mine[0].target
            whole, taken = int(target // size), 0
            for r in mine:
                part = bool(r["size"]) and taken + r["size"] / 2 <= target - whole * size
                taken = taken + r["size"] if part else math.inf
                assert r.copies == whole + part and r.taken == r.copies * r["size"]


def test_fitted_weights_follow_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned, rest = (labels.where(f"doc_id % 2 = {k}") for k in (0, 1))
    weight = weights.fit_weight(docs, learned)
    judged = docs.join(rest, "doc_id").select("quality", weight(docs["text"]).alias("w")).collect()
    mean = [sum(r.w for r in judged if r.quality == q) / sum(r.quality == q for r in judged) for q in (0, 1)]
    assert mean[1] > 0.9 and mean[0] < 0.3 and all(weights.LEAST <= r.w <= 1 for r in judged)
    # Null and empty texts have a weight too; without labels all weigh one.
    odd = spark.createDataFrame([(None,), ("",), ("word " * 20_000,)], "text string")
    assert all(0 < r[0] <= 1 for r in odd.select(weight(odd["text"])).collect())
    none = weights.fit_weight(docs, labels.where("quality = 1"))
    assert {r[0] for r in odd.select(none(odd["text"])).collect()} == {1.0}


def test_mix(documents):
    found = mixing.mix(documents).collect()
    assert {(r.doc_id, r.taken) for r in found} == {(r.doc_id, r.taken) for r in mixing.mix(documents).collect()}
    sources = sorted({r.source for r in found})
    sizes = {s: sum(r["size"] for r in found if r.source == s) for s in sources}
    shares = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    targets, free, rest = {}, set(sources), 1.5 * sum(sizes.values())
    while True:
        share = {s: rest * shares[s] / sum(shares[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(targets[s] for s in over)
        free -= over
    targets |= share
    for s in sources:
        mine = [r for r in found if r.source == s]
        assert all(r.target == pytest.approx(targets[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[s]) <= max(r["size"] for r in mine)
        assert all(r.copies in (int(targets[s] // sizes[s]), int(targets[s] // sizes[s]) + 1) for r in mine)


@pytest.mark.parametrize("settings", [{}, {"block_text": 20_000, "filter_bytes": 40_000}])
def test_scores_from_quantised_counts(documents, texts, settings, monkeypatch):
    """Every score from exact counts, rounded to the middle of their power of two, with and without several parts."""
    monkeypatch.setattr(ngrams, "BITS_PER_ENTRY", 120)  # so large a filter has no false hits here
    single, double, tokens = Counter(), Counter(), {}
    for d, t in texts.items():
        tokens[d] = t.encode().lower().split() + [ngrams.END]
        if not ngrams.is_held_out(str(d)):
            single.update(tokens[d])
            double.update(zip([ngrams.END, *tokens[d]], tokens[d]))
    n, v = sum(single.values()), len(single)

    def rounded(count):
        low = 1 << (count.bit_length() - 1) if count else 0
        return (low + 2 * low - 1) / 2 if count else 0.0

    for r in ngrams.score_texts(documents, **settings).collect():
        expected = 0.0
        for before, word in zip([ngrams.END, *tokens[r.doc_id]], tokens[r.doc_id]):
            history = rounded(single[before])
            pair = min(rounded(double[before, word]), history)
            lower = (rounded(single[word]) + 1) / (n + v + 1)
            expected += math.log10((pair + ngrams.SMOOTHING * lower) / (history + ngrams.SMOOTHING))
        assert r.score == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("block_bytes", [4_000_000, 500])
def test_decontamination(spark, documents, texts, block_bytes):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = {}
    for r in items.collect():
        found = WORD.findall(lower(r.text))
        size = min(13, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            windows.setdefault(tuple(found[i : i + size]), set()).add(str(r.item_id))
    sizes = {len(w) for w in windows}
    for r in decontaminate.find_contamination(documents, items, block_bytes=block_bytes, keep_text=True).collect():
        found, hit, owners = WORD.findall(lower(texts[r.doc_id])), set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                window = tuple(found[i : i + size])
                if window in windows:
                    hit.update(range(i, i + size))
                    owners |= windows[window]
        assert (r.n_words, r.n_hit, r["items"]) == (len(found), len(hit), sorted(owners))
        assert WORD.findall(lower(r.clean_text)) == [w for i, w in enumerate(found) if i not in hit]


def test_license_phrases_and_notices(spark, documents, texts):
    for r in licenses.scan(documents).collect():
        found = WORD.findall(lower(texts[r.doc_id]))
        places = [
            (i, label)
            for label, phrase in licenses.PHRASES.items()
            for i in range(len(found))
            if found[i : i + len(phrase.split())] == phrase.split()
        ]
        assert (r.n_words, r.n_base) == (len(found), len(places))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == (min(places)[0] if places else None, max(places)[0] if places else None)
        quoted = set()
        for label, notice in licenses.NOTICES:
            wanted = licenses._distinct_words(notice)
            lines = texts[r.doc_id].split("\n")
            two = [f"{x}\n{y}" for x, y in zip(lines, [*lines[1:], ""])]
            parts = two if len(wanted) < licenses.WRAPPED else re.split(r"\n\s*\n", texts[r.doc_id])
            if any(len(set(WORD.findall(lower(p))) & set(wanted)) >= 0.9 * len(wanted) for p in parts):
                quoted.add(label)
        assert r.labels == ",".join(sorted(quoted | {x for _, x in places}))
    wrapped = licenses.NOTICES[10][1].replace(" copies", "\ncopies").replace(" to ", "\nto ")
    frame = spark.createDataFrame([(1, f"Intro.\n\n{wrapped}\n\nEnd."), (2, "the license is released")], "doc_id int, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(frame).collect()} == {1: "mit", 2: ""}
