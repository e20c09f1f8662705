"""Main text of pages: varied pages with expected text, a plain second reading of the generated pages, and hostile input."""

import itertools
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from specmill.llm import html_text

P1 = "The town council met on Monday and agreed, after a long debate, to build a new bridge over the river."
P2 = "Work will begin in spring & should end within two years, the mayor said."
P3 = "Kurz."
REMARK = "I totally agree with this article, it is really the best one that I have read today, thank you so much for it."
ARTICLE = ["New bridge", P1, P2, P3]
HTML_ARTICLE = f"<h1>New bridge</h1><p>{P1}</p><p>{P2.replace('&', '&amp;')}<p>{P3}</p>"

#: Ways to stand around an article.
AROUND = [
    "<article>{}</article>",
    "<main><article>{}</article></main>",
    "<main>{}</main>",
    "<div itemprop=articleBody>{}</div>",
    "<div class='post-content'>{}</div>",
    "<div class='layout has-sidebar'><article>{}</article></div>",
    "<div class='site-content has-sidebar'>{}</div>",
    "<div class=comments-open>{}</div>",
    "<div class='with-comments'><main>{}</main></div>",
    "<div class='sidebar-layout'><div id=content>{}</div></div>",
    "<div>{}</div>",
    "{}",
    "<table><tr><td>{}</table>",
    "<form action=/page><div class=entry>{}</div></form>",
    "<article class='post category-popular tag-search'>{}</article>",
]
#: What is never part of it, before and after the article.
NOISE = [
    ("<nav><ul><li><a href=/>Home</a><li><a href=/n>News of the day</a></ul></nav>", "<footer><p>Imprint of the town paper. All rights reserved by us and by others.</p></footer>"),
    ("<div class=menu><a href=/>Home</a> <a href=/a>About our newspaper and its people</a></div>", f"<div id=comments><p>{REMARK}</p><p>{REMARK}</p><p>{REMARK}</p></div>"),
    ("<div class='cookie-notice'>We use cookies to improve your experience on this site, please accept them all. <button>OK</button></div>", f"<section class=comment-list><div class=comment><p>{REMARK}</p></div></section>"),
    ("<header class=top><h2>The Daily Paper</h2><p>Everything that you need to know, every day of the year.</p></header>", "<aside><p>Sidebar words that are long enough to look like a paragraph of text, are they not?</p></aside>"),
    ("<div class=ad>Buy now! The best shoes in the world are here for you today, and only today.</div>", "<div class='related-posts'><a href=/1>Old bridge falls into the river</a><p>Another story that you may like to read.</p></div>"),
    ("<script>var a = '<p>Not a paragraph of the article at all, never.</p>';</script><style>p{}</style>", "<form><label>Your address</label><input name=q><p>Enter your email to subscribe to our letters today please.</p></form>"),
]


def page(around, noise):
    return f"<!DOCTYPE html><html><head><title>New bridge - Paper</title></head><body class='single comments-open has-sidebar'>{noise[0]}{around.format(HTML_ARTICLE)}{noise[1]}</body></html>"


@pytest.mark.parametrize(("around", "noise"), list(itertools.product(AROUND, NOISE)))
def test_article_in_a_page(around, noise):
    assert html_text.main_text(page(around, noise)).split("\n\n") == ARTICLE


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<div>Kurz.</div>", ["Kurz."]),
        (f"<article><div class='article-header'><h1>New bridge</h1></div><p>{P1}</p></article>", ["New bridge", P1]),
        (f"<article><h1 class=header>New bridge</h1><p>{P1}</p></article>", ["New bridge", P1]),
        (f"<article><p>{P1}</p><p class=popular>{P1} {P3}</p><p>{P3}</p></article>", [P1, f"{P1} {P3}", P3]),
        (f"<div><h1>New bridge</h1><p>{P1}</p><p>{P1} Again.</p></div>", ["New bridge", P1, f"{P1} Again."]),
        (f"<article><p>{P1}</p><div class=ad>{REMARK}</div><p>{P3}</p></article>", [P1, P3]),
        (f"<article><p>{P1}</p><ul class=share><li><a href=a>Tell a friend</a></ul><p>{P3}</p></article>", [P1, P3]),
        (f"<main><article><p>{P1} {P1}</p></article><article class=teaser><p>{P3}</p></article><section id=comments><article><p>{REMARK}</p></article></section></main>", [f"{P1} {P1}"]),
        (f"<article><p>{P1}</p><p><a href=x>Read the whole report of the council here</a></p><p>{P3}</p></article>", [P1, "Read the whole report of the council here", P3]),
        (f"<article><ol><li>One step.<li>Another step.</ol><blockquote>{P3}</blockquote><pre>a\n  b</pre></article>", ["One step.", "Another step.", P3, "a b"]),
        (f"<div style='display:none'>{REMARK}</div><p>{P1}</p><template><p>{REMARK}</p></template>", [P1]),
        (f"<p>{P1}<!-- {REMARK} --></p><!-- never closed <p>{REMARK}</p>", [P1]),
        ("<p>a &lt; b &#228;&eacute;&nbsp;c &unknown; d.</p>", ["a < b äé c &unknown; d."]),
        (f"<p title='a > b' data-x=\"'\">{P1}</p>", [P1]),
        (f"<p>{P1}</p><nav>menu", [P1]),
        ("<p>今日は新しい橋について町の議会で長い話し合いがあった。</p><p>来年の春に始まる。</p>", ["今日は新しい橋について町の議会で長い話し合いがあった。", "来年の春に始まる。"]),
        (f"<div class='post'><a href=1>Teaser of another story</a></div><div><h1>New bridge</h1><p>{P1}</p><p>{P1} Again.</p></div>", ["New bridge", P1, f"{P1} Again."]),
        *((f"<article><p>{P1}</p><{tag}>{P2[:40]} again.</{tag.split()[0]}><p>{P3}</p></article>", [P1, f"{P2[:40]} again.", P3]) for tag in ("p class=share-note", "p class='subscription-model'", "p class=share-price", "p id=menu-prices", "p class=paywall-debate")),
        *((f"<article><p>{P1}</p><{tag}><p>{P2[:40]} again.</p></{tag.split()[0]}><p>{P3}</p></article>", [P1, f"{P2[:40]} again.", P3]) for tag in ("section id=follow-up", "section class=social-policy", "div class=survey-results")),
        (f"<main><h1>New bridge</h1><p>{P1}</p><section class=kommentare><h3>Kommentare</h3><div><p>Anna</p><p>{REMARK}</p></div><div><p>Bert</p><p>{REMARK}</p></div></section></main>", ["New bridge", P1]),
        (f"<article><h1>New bridge</h1><p>{P1}</p><ol class=thread><li><p>Anna, 12:30</p><p>{REMARK}</p><li><p>Bert, 13:05</p><p>{REMARK}</p></ol></article>", ["New bridge", P1]),
        (f"<article><h1>New bridge</h1><p>{P1}</p><h3>3 Comments</h3><div><p>Anna</p><p>{REMARK}</p></div></article>", ["New bridge", P1]),
        (f"<article><h1>New bridge</h1><p>{P1}</p><div>3 Comments</div><div><p>{REMARK}</p></div></article>", ["New bridge", P1]),
        (f"<article><h2>Comments</h2><p>{P1}</p></article>", ["Comments", P1]),
        (f"<article><p>{P1}</p><ol><li><p>12 May</p><p>{P2[:40]} began.</p><li><p>13 June</p><p>{P2[:40]} ended.</p></ol></article>", [P1, "12 May", f"{P2[:40]} began.", "13 June", f"{P2[:40]} ended."]),
        (f"<div class=article><header><h1>New bridge</h1></header><p>{P1}</p><p>{P1} Again.</p></div>", ["New bridge", P1, f"{P1} Again."]),
        (f"<div><header><h1>New bridge</h1></header><p>{P1}</p><p>{P1} Again.</p></div>", ["New bridge", P1, f"{P1} Again."]),
        (f"<div><header><h1><a href=/>The Daily Paper</a></h1><p>Every day of the year.</p></header><p>{P1}</p><p>{P1} Again.</p></div>", [P1, f"{P1} Again."]),
        (f"<div id=page><header><h1>The Daily Paper</h1></header><article><p>{P1}</p><p>{P1} Again.</p></article></div>", [P1, f"{P1} Again."]),
    ],
)
def test_parts_of_pages(body, want):
    assert html_text.main_text(f"<html><body>{body}</body></html>").split("\n\n") == want


@pytest.mark.parametrize("body", ["<nav>a</nav>", "<ul><li><a href=/>Home</a><li><a href=/b>About</a></ul>", "<footer>(c) 2020 us</footer>", "<div class=ad>Buy now! The best shoes in the world.</div><nav>a</nav>", "<script>x</script>", "<form><label>Your name</label><p>Send it to us now please.</p></form>"])
def test_pages_without_an_article(body):
    assert html_text.main_text(f"<body>{body}</body>") == ""


class Plain(HTMLParser):
    """The blocks of the article element, read in another way."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_generated_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = Plain()
        plain.feed(r.html)
        assert html_text.main_text(r.html) == "\n\n".join(t for t in (" ".join(b.split()) for b in plain.blocks) if t), r.page_id


@pytest.mark.parametrize("unit", ["<" + "a" * 50, "<div>x", "<p>x</b></i>", "<b><p>x</p>", "<li><b>x", "</div>", "<a \"", "<a x='", "<!--", "<![CDATA[", "<td><p>x", "<h1>x<h2>", "&amp;<", "\x00<￿>", "<div class='ad post'>x</div>", "<script>", "</script ", "<li><p>x 10:00<p>y", "<h2>Comments</h2>", "<div><div>10:00<p>x</div>", "<div><header><h1>x", "<table><tr><td>x", "<div><span>x</div>"])
def test_a_megabyte_of_anything_takes_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    html_text.main_text(text)
    html_text.main_text("<script>" + text)
    assert time.process_time() - began < 12
    began = time.process_time()
    html_text.main_text(text[:250_000])
    assert time.process_time() - began < 2


def test_rows(spark):
    whole = page(AROUND[0], NOISE[0])
    rows = [(1, "u", whole), (None, None, None), (2, "u", ""), (3, "u", "<nav>a</nav>"), (4, "u", "<article><p>a<p>b &am</article>"), (1, "u", whole), (5, "u", "<" * 3000)]
    got = html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars")).collect()
    assert Counter((r.page_id, r.text) for r in got if r.page_id != 5) == Counter([(1, "\n\n".join(ARTICLE))] * 2 + [(None, ""), (2, ""), (3, ""), (4, "a\n\nb &am")])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
