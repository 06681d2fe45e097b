"""The main text of web pages: structure first, then differences from the page with the nearest URL."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import packed, scratch, unpacked
from stopwise.operators.numbering import number_within
from stopwise.operators.storage import BROADCAST_BYTES

# Names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr br img".split()
)
_RAW = frozenset("script style textarea title noframes noembed iframe xmp".split())
_NOISE_TAGS = frozenset(
    "head script style textarea title noscript iframe template nav footer aside menu dialog select button svg"
    " canvas object audio video map noframes noembed".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class and id of what is no part of an article.
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_ADVERTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adslot sponsor sponsored sponsors promo"
    " promoted promotion related recommended recommendations".split()
)
_FURNITURE = frozenset(
    "banner cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter"
    " subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share"
    " sharing social widget widgets toolbar pagination pager login search skip copyright alert paywall".split()
)
# Lines of so many words are sentences; menus and labels have fewer.
_SENTENCE = 10
# Names are looked at in this order, each on what the ones before have left: blocks of a name are kept if
# they have this share of the sentences. Comments are kept only if there is hardly anything else.
_KEPT_SHARES = (("0", 0.9), ("1", 0.5), ("2", 0.5))
# Articles, or main, are the text if they have this share of the sentences of what is around them.
_REGION_SHARE = 0.25
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PART = re.compile(r"(?<![a-z])(?:no|has|with|without|is)[-_][a-z]+|[a-z]+")


def _kind(tag: str, attributes: str) -> str:
    """What an element's tag and attributes make it: ``noise``, ``header``, ``?`` and a name if in doubt, or nothing.

    Only a tag that says so, or being hidden, makes noise for certain. Names and roles are used for other
    things too, so they give a doubt: 0 comments, 1 adverts, 2 furniture, each with its name.
    """
    if tag in _NOISE_TAGS:
        return "noise"
    found = {}
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), next(filter(None, values), "").lower())
    if not found:
        return "?2 form" if tag == "form" else "header" if tag == "header" else ""
    style = found.get("style", "").replace(" ", "")
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style:
        return "noise"
    if tag in ("html", "body"):
        return ""
    parts = set(_NAME_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}")))
    if parts & _COMMENTS:
        return "?0 " + " ".join(sorted(parts & _COMMENTS))
    if parts & _ADVERTS:
        return "?1 " + " ".join(sorted(parts & _ADVERTS))
    named = parts & _FURNITURE if tag not in ("article", "main") else set()
    if found.get("role") in _NOISE_ROLES:
        named |= {"role " + found["role"]}
    if named or tag == "form":
        return "?2 " + " ".join(sorted(named) or ["form"])
    return "header" if tag == "header" or "header" in parts and tag not in ("article", "main") else ""


def page_lines(page: str | None) -> list[tuple[str, bool]]:
    """The page's text blocks in order, each with whether differencing may delete it.

    Noise (scripts, menus, headers, footers, asides, hidden elements) is left out. Forms and blocks with
    a name or role of comments, adverts or furniture (widget, share, notice) are left out too, unless
    those of one name hold half of the page's sentences, or of comments nine tenths; comments are
    taken off first, then adverts, and both for certain if they stand beside an article or main with
    text. Named blocks that stay are open to deletion. If articles hold a
    quarter of the sentences of main, or of the page without main, only their text counts; else main's
    if it holds a quarter of the page's, else all. What else stands in a paragraph, heading, list or
    table of an article or main is open to no deletion.
    """
    page = page or ""
    lines: list[tuple[str, int, bool, frozenset[str]]] = []
    # tag, kind, region (1 in main, 2 in an article, 3 in both), prose, names in doubt
    stack: list[tuple[str, str, int, bool, frozenset[str]]] = []
    kind, region, prose, doubts = "", 0, False, frozenset()
    parts: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, region, prose, doubts))

    def add(text: str) -> None:
        if kind != "noise" and (kind != "header" or any(s[0] in _HEADINGS for s in stack)):
            parts.append(text)

    def pop_to(depth: int) -> None:
        nonlocal kind, region, prose, doubts
        del stack[depth:]
        kind, region, prose, doubts = stack[-1][1:] if stack else ("", 0, False, frozenset())

    while at < size:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        close, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        elif tag in ("br", "img", "wbr") and tag == "br":
            add(" ")
        if close:
            for depth in range(len(stack) - 1, -1, -1):
                name = stack[depth][0]
                if name == tag:
                    pop_to(depth)
                    break
                if tag in _INLINE and name not in _INLINE:
                    break
            continue
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag not in _INLINE:
            # A block ends an open paragraph, an item ends the item before it.
            ends = {"p"} | ({tag} if tag in ("li", "tr", "td", "th", "dd", "dt", "option") else set())
            for depth in range(len(stack) - 1, -1, -1):
                name = stack[depth][0]
                if name in ends:
                    pop_to(depth)
                    break
                if name not in _INLINE:
                    break
        own = _kind(tag, attributes)
        within = doubts
        if own.startswith("?"):
            within, own = doubts | {own[1:]}, ""
        inside = kind if kind == "noise" or not own else own
        if own == "header" and region == 0:
            inside = "noise"
        new_region = region | (2 if tag == "article" else 1 if tag == "main" else 0)
        stack.append((tag, inside, new_region, prose or tag in _PROSE, within))
        kind, region, prose, doubts = stack[-1][1:]
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else size
    flush()
    weights = [len(t) if t.count(" ") >= _SENTENCE - 1 else 0 for t, *_ in lines]
    left = list(zip(lines, weights))
    for rank, share in _KEPT_SHARES:
        whole = sum(w for _, w in left)
        held = {name: 0 for line, _ in left for name in line[3] if name[0] == rank}
        for line, weight in left:
            for name in line[3] & held.keys():
                held[name] += weight
        little = {name for name, weight in held.items() if not weight or weight < share * whole}
        left_of = [x for x in left if not x[0][3] & little]
        if rank < "2" and any(line[1] for line, _ in left if not line[3] & held.keys()):
            # An article or main has text: comments and adverts beside it are what they are called.
            left_of = [x for x in left_of if x[0][1] or not x[0][3] & held.keys()]
        left = left_of
    # Articles beside main come first if they hold no less than main.
    beside = [w for x, w in left if x[1] == 2]
    first = beside and sum(beside) >= sum(w for x, w in left if x[1] & 1)
    best = 0
    for bit in (2,) if first else (1, 2):
        inside = [x for x in left if x[0][1] & bit]
        if inside and sum(w for _, w in inside) >= _REGION_SHARE * sum(w for _, w in left):
            left, best = inside, bit
    return [(t, not (p and best) or bool(d - {"2 form"})) for (t, _, p, d), _ in left]


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)", 1))


def page_path(url: Column) -> Column:
    """The path without query, fragment, ending and last slash; numbers are padded, to sort by size."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?[^/?#]*|[?#].*$", "")
    plain = F.regexp_replace(bare, r"(?:\.[a-zA-Z]{1,5})?/*$", "")
    padded = F.regexp_replace(plain, r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


def aligned(ours: list[int], theirs: list[int]) -> list[int]:
    """Places in ``ours`` of a longest common subsequence, by rows of bits.

    Lines that the other page lacks are left out before, and equal beginnings and ends are cut off.
    """
    common = set(ours) & set(theirs)
    a = [i for i, x in enumerate(ours) if x in common]
    b = [x for x in theirs if x in common]
    head = 0
    while head < min(len(a), len(b)) and ours[a[head]] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and ours[a[-1 - tail]] == b[-1 - tail]:
        tail += 1
    found = a[:head] + a[len(a) - tail :]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    # Bit j of a row is 0 where the length grows with b[j].
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for i in a:
        hit, last = places.get(ours[i], 0), rows[-1]
        both = last & hit
        rows.append(((last + both) | (last & ~hit)) & full)

    def length(row: int, j: int) -> int:
        return j - (row & ((1 << j) - 1)).bit_count()

    i, j = len(a), len(b)
    while i and j:
        if length(rows[i - 1], j) == length(rows[i], j):
            i -= 1
        elif length(rows[i], j - 1) == length(rows[i], j):
            j -= 1
        else:
            found.append(a[i - 1])
            i, j = i - 1, j - 1
    return sorted(found)


def _lines(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, opens = [], [], []
            for page in batch.column("html").to_pylist():
                lines = page_lines(page)
                texts.append([t for t, _ in lines])
                marks.append([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in lines])
                opens.append([o for _, o in lines])
            columns = {"lines": texts, "marks": marks, "open": opens}
            arrays = [pa.array(columns[n], schema.field(n).type) if n in columns else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return run


def _shared(copy_share: float):
    """Open lines of a page that a neighbour has too, unless most of either is the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.to_pydict()
            drop = []
            for marks, open_, *others in zip(data["marks"], data["open"], data["before"], data["after"]):
                gone: set[int] = set()
                for other in others:
                    if other:
                        same = aligned(marks, other)
                        if len(same) <= copy_share * min(len(marks), len(other)):
                            gone.update(i for i in same if open_[i])
                drop.append(sorted(gone))
            arrays = [batch.column("id"), pa.array(drop, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "drop"])

    return run


def template_lines(placed: DataFrame, least: int, share: float) -> DataFrame:
    """Per host the lines that at least ``least`` and more than ``share`` of its different pages hold.

    Equal pages are one. A host has fewer such lines than its pages have on average, divided by ``share``.
    """
    different = placed.select("host", F.xxhash64("marks").alias("content"), "marks").groupBy("host", "content")
    different = different.agg(F.first("marks").alias("marks"))
    holding = different.select("host", F.explode(F.array_distinct("marks")).alias("mark"))
    times = holding.groupBy("host", "mark").agg(F.count("*").alias("times")).where(F.col("times") >= least)
    pages_of = different.groupBy("host").agg(F.count("*").alias("of"))
    shared = times.join(pages_of, "host").where(F.col("times") > share * F.col("of"))
    return shared.groupBy("host").agg(F.collect_set("mark").alias("template"))


def broadcast_templates(template: DataFrame) -> DataFrame:
    """Broadcast if the templates, measured, are small, so that a large host is not one task."""
    lines = template.agg(F.sum(F.size("template") + 32)).first()[0] or 0
    return F.broadcast(template) if 16 * lines <= BROADCAST_BYTES else template


def main_text(
    pages: DataFrame,
    url: str = "url",
    page: str = "html",
    copy_share: float = 0.6,
    template_pages: int = 4,
    template_share: float = 0.5,
) -> DataFrame:
    """Every row of ``pages``, without its html, with the main ``text`` and its length ``n_chars``.

    Blocks of text are found by the page's structure (``page_lines``). Within each host, pages are
    ordered by URL path, and each is compared with the pages before and after it: lines of a longest
    common subsequence are template lines and are deleted. Two kinds are not: paragraphs and the like
    inside an article or main, which are its text whatever other pages quote, and lines shared with a
    page of which more than ``copy_share`` is the same, which is a copy and not a template.

    Null and empty pages give an empty text; null URLs are one host with an empty path; equal paths
    are ordered by row; repeated rows are copies of each other; an empty table gives no rows. Columns
    with the added names are replaced. Only 64-bit line hashes are shuffled to pair the pages; a host
    of any share of the pages is range sorted over all tasks.
    """
    rows = packed(pages)
    store = scratch(pages, "pages")
    kept = [c for c in pages.columns if c != page]
    narrow = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        F.monotonically_increasing_id().alias("id"),
        F.col(f"given.`{url}`").alias("url"),
        F.col(f"given.`{page}`").alias("html"),
    )
    added = "array<string> lines array<bigint> marks array<boolean> open".split()
    out = narrow.drop("html")
    for kind, name in zip(added[::2], added[1::2]):
        out = out.withColumn(name, F.array().cast(kind))
    types = {"lines": pa.list_(pa.string()), "marks": pa.list_(pa.int64()), "open": pa.list_(pa.bool_())}
    arrow = pa.schema([pa.field(n, types.get(n, pa.null())) for n in out.columns])
    found = store.save(narrow.mapInArrow(_lines(arrow), out.schema), "lines")

    marked = found.select("id", page_host(F.col("url")).alias("host"), page_path(F.col("url")).alias("path"), "marks", "open")
    placed = number_within(marked, [], [F.col("host"), F.col("path"), F.col("id")], "place")
    placed = store.save(placed.drop("path"), "places")
    template = store.save(template_lines(placed, template_pages, template_share), "template")
    opened = F.zip_with("open", "marks", lambda o, m: o | F.coalesce(F.array_contains("template", m), F.lit(False)))
    placed = placed.join(broadcast_templates(template), "host", "left").withColumn("open", opened).drop("template")
    open_pages = placed.where(F.exists("open", lambda x: x))

    def neighbour(step: int, name: str) -> DataFrame:
        return placed.select((F.col("place") + step).alias("place"), "host", F.col("marks").alias(name))

    pairs = open_pages.join(neighbour(1, "before"), ["place", "host"], "left").join(
        neighbour(-1, "after"), ["place", "host"], "left"
    )
    drops = pairs.select("id", "marks", "open", "before", "after").mapInArrow(
        _shared(copy_share), "id bigint, drop array<int>"
    )
    drops = store.save(drops.where(F.size("drop") > 0), "drops")
    left = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False)))
    text = F.array_join(F.when(F.col("drop").isNull(), F.col("lines")).otherwise(left), "\n")
    return unpacked(
        found.select("row", "id", "lines").join(drops, "id", "left").withColumn("text", text),
        kept,
        text=F.col("text"),
        n_chars=F.length("text").cast("long"),
        n_deleted=F.coalesce(F.size("drop"), F.lit(0)).cast("long"),
    )
