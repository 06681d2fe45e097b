"""Layouts in which the story stands where menus, forms and teasers usually do."""

import random
import re
from html.parser import HTMLParser

import pytest

from stopwise.llm import pages
from stopwise.llm.queries import QUERIES

STORY = [f"This is sentence number {i} of the story and it has more than ten words." for i in range(6)]
TEXT = "".join(f"<p>{line}</p>" for line in STORY)
MENU = "<div class='search'>Search</div><div class='share'><a>Share</a></div>"
TEASER = "<article><p>A teaser of another story, to be read on another page of this site.</p></article>"

LAYOUTS = {
    "form around the page": f"<body><form id='aspnetForm' action='x'>{MENU}{TEXT}<input></form></body>",
    "widgets around paragraphs": "<body>"
    + MENU
    + "".join(f"<div class='elementor-widget-container'><p>{x}</p></div>" for x in STORY)
    + "</body>",
    **{
        name: f"<body>{MENU}<{tag}>{TEXT}</{tag.split()[0]}></body>"
        for name, tag in {
            "sponsored article": "article class='sponsored-post'",
            "ad free": "div class=ad-free-content",
            "discussion": "div id='discussion'",
            "promo wrapper": "div class='promo-wrapper'",
            "newsletter": "div class='newsletter'",
            "form role": "form role='form'",
            "alert role": "div role=alert",
            "header named banner": "header class='banner'",
        }.items()
    },
    "related research in main": f"<body><main><section class='related-research'>{TEXT}</section></main></body>",
    "teaser beside main": f"<body><main>{TEXT}</main>{TEASER}</body>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_the_story_is_found(layout):
    assert [t for t, _ in pages.page_lines(LAYOUTS[layout])] == STORY


def test_small_blocks_stay_noise():
    page = f"<body>{MENU}<form><p>Write your name here to get all the news of the week by mail.</p></form><article>{TEXT}</article></body>"
    assert pages.page_lines(page) == [(x, False) for x in STORY]


def test_long_comments_go():
    """Comments of more words than the story, also where the story stands in a block with a name."""
    talk = "".join(f"<div class='comment'><p>I think that point {i} is wrong, and here are ten words on why.</p></div>" for i in range(9))
    for box in ("article", "div class='elementor-widget-container'", "div class='promo-box'", "div"):
        page = f"<body>{MENU}<{box}>{TEXT}</{box.split()[0]}><section id='comments'>{talk}</section></body>"
        assert [t for t, _ in pages.page_lines(page)] == STORY


def test_template_paragraph_within_articles_goes(spark):
    """A paragraph of all articles of a host goes, one of a few stays, and copies of an article stay whole."""

    def page(i, *more):
        own = "".join(f"<p>Sentence {k} of article {i}, which no other article of this site has at all.</p>" for k in range(5))
        return "<body><article>" + own + "".join(f"<p>{x}</p>" for x in more) + "</article></body>"

    every, some = "Read all of our articles on this site every day.", "A passage that three articles quote word for word."
    rows = [(i, f"http://h/a/{i}", page(i, every, *[some] * (i < 3))) for i in range(12)]
    rows += [(100 + i, f"http://copies/a/{i}", page(77)) for i in range(8)]
    rows += [(200 + i, f"http://few/a/{i}", page(i + 50, every)) for i in range(3)]
    found = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(12):
        assert every not in found[i].text and (some in found[i].text) == (i < 3) and found[i].n_deleted == 1
    assert all(found[i].n_deleted == 0 and found[i].text for i in found if i >= 100)


def test_given_pages_equal_their_article(spark):
    """Every given page: the blocks of its article, found by a parser of the standard library."""

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attributes):
            self.inside |= tag == "article"
            if tag in ("p", "h1", "div", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag in ("p", "h1", "div"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    found = QUERIES["op2_page_text"](spark, "/root/testdata/sf0.01").collect()
    given = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(found) == len(given)
    for r in found:
        parser = Article()
        parser.feed(given[r.page_id] or "")
        parser.close()
        text = "\n".join(filter(None, (" ".join(b.split()) for b in parser.blocks)))
        assert r.text == text and r.n_chars == len(text)


def test_differences_equal_a_plain_comparison(spark):
    """The whole query on made pages: neighbours by path, common lines by a table of lengths."""
    draw = random.Random(4)
    boxes = [f"box {k}" for k in range(6)]
    rows = []
    for i in range(60):
        lines = [x for x in boxes if draw.random() < 0.6]
        lines += [f"own line {i} {k}" for k in range(draw.randrange(7))]
        if i % 9 == 0 and rows:
            body = rows[-1][2]
        else:
            draw.shuffle(lines)
            body = "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
        rows.append((i, f"http://{'ab'[i % 2]}.com/x/{draw.randrange(100)}/{i}?q={i}", body))
    frame = spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(1)
    found = {r.page_id: r.text for r in pages.main_text(frame).collect()}

    def common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        return table[0][0]

    lines = {i: re.findall("<div>(.*?)</div>", body) for i, _, body in rows}
    for host in "ab":
        own = sorted((tuple(int(n) for n in re.findall(r"/(\d+)", u)), i) for i, u, _ in rows if f"//{host}." in u)
        for at, (_, i) in enumerate(own):
            kept = set(lines[i])
            for near in own[max(0, at - 1) : at] + own[at + 1 : at + 2]:
                other = lines[near[1]]
                n = common(lines[i], other)
                if n <= 0.6 * min(len(lines[i]), len(other)):
                    # Lines stand once in a page, so one that no longest common subsequence can do without is in it.
                    kept -= {x for x in lines[i] if x in other and common([y for y in lines[i] if y != x], other) < n}
            assert set(found[i].split("\n")) - {""} <= kept
            assert all(x in found[i].split("\n") for x in lines[i] if x.startswith("own line") and "copy" not in x and
                       not any(x in lines[j] for _, j in own if j != i))
