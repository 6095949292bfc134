"""Main texts against pages put together from known parts."""

import random
import time

import pytest

pytest.importorskip("pulseloom.llm")

from pulseloom.llm import queries
from pulseloom.llm.html_extract import extract, main_text

ONE = "A long paragraph of text that says something to the reader and goes on."
TWO = "Another one that goes on for a while, too, as paragraphs do."
BOTH = f"<p>{ONE}</p><p>{TWO}</p>"
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{ONE}</p><![foo bar]><p>AFTER all of it</p></article>", f"{ONE} AFTER all of it"),
        (f"<article><p>{ONE}</p><!foo><?bar><!-- c --><!--><p>{TWO}</p></article>", f"{ONE} {TWO}"),
        (f"<body>{NAV}<div class='content with-sidebar'>{BOTH}</div></body>", f"{ONE} {TWO}"),
        (f"<body>{NAV}<div class='post no-comments'>{BOTH}</div></body>", f"{ONE} {TWO}"),
        (f"<body>{NAV}<div class='job-search'>{BOTH}</div></body>", f"{ONE} {TWO}"),
        (f"<body>{NAV}<section class='legal'>{BOTH}</section></body>", f"{ONE} {TWO}"),
        (f"<body>{NAV}<section class='notice'>{BOTH}</section></body>", f"{ONE} {TWO}"),
        (f"<article><div class='entry-header'><h1>Head</h1></div>{BOTH}</article>", f"Head {ONE} {TWO}"),
        (f"<article><header class='header'><h1>Head</h1></header>{BOTH}</article>", f"Head {ONE} {TWO}"),
        (f"<body>{NAV}<div class='post'><header><h1>Head</h1></header>{BOTH}</div></body>", f"Head {ONE} {TWO}"),
        (f"<main><h1>Head</h1><p>lead</p><article>{BOTH}</article></main>", f"Head {ONE} {TWO}"),
        (f"<body><header><h1>Site</h1>{NAV}</header><article>{BOTH}</article></body>", f"{ONE} {TWO}"),
        (f"<article><p>{ONE}</p><div class='ad'>buy</div><p>{TWO}</p><section id='comments'><p>{ONE}</p><p>{ONE}</p></section></article>", f"{ONE} {TWO}"),
        (f"<article>{BOTH}<div><article class='comment'>me too, and more of it</article></div></article>", f"{ONE} {TWO}"),
        (f"<body><div class='cookie-notice'><p>{ONE}</p></div><div id='SideBar'>{ONE}</div><article><p>{TWO}</p></article></body>", TWO),
        (f"<body><form id='page'><div><main>{BOTH}</main></div><input value='x'></form></body>", f"{ONE} {TWO}"),
        (f"<body><nav><ul><li>a</ul><article>{BOTH}</article></body>", f"{ONE} {TWO}"),
        (f"<body>{NAV}<div class='ad'>buy it</div><footer>f</footer></body>", ""),
        (f"<article><p>{ONE}</p><!-- never closed <p>{TWO}</p>", ONE),
        (f"<article><p>{ONE}</p><a href='never closed", ONE),
        (f"<article><p>{ONE} a < b\n\t c&nbsp;&amp; d&#65;&#x42;&eacute;<b>f</b>g &#{'9' * 5000};</p>", f"{ONE} a < b c & dABéfg �"),
        (f"<article><div><p>{ONE}</div></div></div><p>{TWO}</p></article><p>outside</p>", f"{ONE} {TWO}"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_pages_of_known_parts():
    """An article of random blocks among random things that stand beside one."""
    rng = random.Random(5)
    words = lambda a, b: " ".join("w" * rng.randrange(1, 9) + str(rng.randrange(99)) for _ in range(rng.randrange(a, b)))
    names = ["ad", "sidebar", "left-sidebar", "comments", "article-comments", "cookie-consent", "site-footer", "main-menu", "adBox"]
    for _ in range(300):
        inside = lambda: rng.choice([f"<div class='{rng.choice(names)}'><p>{words(1, 30)}</p></div>", f"<form>{words(1, 9)}</form>", f"<script>{words(1, 9)}</p></script>", f"<aside><h2>{words(1, 4)}</h2></aside>", "<!-- x -->", ""])
        outside = lambda: "".join(rng.choice([inside(), f"<nav>{words(1, 20)}</nav>", f"<footer>{words(1, 20)}</footer>", f"<div class='misc'>{words(1, 3)}</div>"]) for _ in range(3))
        want, html = [], ""
        for k in range(rng.randrange(1, 12)):
            text = words(1 if k else 12, 60)
            want.append(text)
            kind = "h1" if not k else rng.choice(["p", "h2", "li", "blockquote", "pre", "div", "td"])
            html += f"<{kind}>{text.replace(' ', rng.choice([' ', '  ', chr(10), '<b> </b>']))}" + ("" if kind in ("p", "li") and rng.random() < 0.3 else f"</{kind}>") + inside()
        centre = rng.choice(["article", "main", "article class='sidebar-less post'"])
        page = f"<html><head><title>{words(1, 4)}</title></head><body class='sidebar'>{outside()}<{centre}>{html}</{centre.split()[0]}>{outside()}</body></html>"
        assert main_text(page) == " ".join(want), page


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</b>" * 20_000 + "x", "<b>" + "<div>" * 20_000 + "</b>" * 20_000 + "x", "<article>x" * 20_000, "<article><div>" * 9_000 + "</div>" * 9_000 + "x", "<!--" * 50_000 + ">", "</" * 100_000, "<a " * 70_000, "<script>" + "</" * 100_000, "&" * 200_000, "<table><tr><td>" * 9_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 2  # a tenth of a second here


def test_query(spark):
    """The pages' articles, cut out with string functions, as all pages of the table have one article element."""
    import html
    import re

    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op10_html_extract(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]]["html"])[1]
        text = re.sub(r"<(/?)(p|h1|br)>", " ", article)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", text)).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


def test_clashing_columns(spark):
    x = spark.createDataFrame([(1, "u", f"<article>{BOTH}</article>", "own", "own")], "page_id long, url string, html string, text string, mark string")
    assert extract(x).first().asDict() == {"page_id": 1, "url": "u", "mark": "own", "text": f"{ONE} {TWO}", "n_chars": len(f"{ONE} {TWO}")}
