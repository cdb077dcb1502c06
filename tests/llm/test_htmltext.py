from __future__ import annotations

import random
from html import escape
from html.parser import HTMLParser

import __spark_entry__ as entry
from tidewater.llm import htmltext
from tidewater.llm.htmltext import main_blocks
from tidewater.sources.scans import table

FOLDER = "/root/testdata/sf0.001"


class ArticleText(HTMLParser):
    """Blocks of <article> as the standard parser reads them (pages whose article is marked)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.now = 0, [], ""

    def flush(self):
        if self.depth and self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.flush()
        elif tag == "br":
            self.now += " "
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now += data


def test_query_equals_a_plain_parser_on_all_pages(spark):
    pages = {r.page_id: r for r in table(spark, FOLDER, "pages").collect()}
    out = entry.queries()["op13_main_text"](spark, FOLDER).collect()
    assert len(out) == len(pages)
    for r in out:
        plain = ArticleText()
        plain.feed(pages[r.page_id].html)
        plain.close()
        assert r.text.split("\n") == plain.blocks
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor über naïve R&D a<b".split()


def sentence(rng, least=1, most=40):
    words = [rng.choice(WORDS) + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(least, most))]
    return " ".join(words) + "."


FURNITURE = [
    lambda r: "<nav><ul>" + "".join(f"<li><a href='/{i}'>{escape(sentence(r, 1, 3))}</a>" for i in range(r.randint(3, 9))) + "</ul></nav>",
    lambda r: f"<header><h2>{escape(sentence(r))}</h2><p>{escape(sentence(r))}</p></header>",
    lambda r: f"<footer>&copy; {escape(sentence(r))}</footer>",
    lambda r: f"<aside><p>{escape(sentence(r))}</p></aside>",
    lambda r: f"<div class=\"ad\">{escape(sentence(r))}</div>",
    lambda r: f"<div id=sidebar><p>{escape(sentence(r))}<p>{escape(sentence(r))}</div>",
    lambda r: f"<div class='box cookie-notice' role=\"alert\"><p>{escape(sentence(r))}</p></div>",
    lambda r: f"<form action=x>{escape(sentence(r))}<input name=q><textarea><p>x</p></textarea><button>{escape(sentence(r, 1, 3))}</button></form>",
    lambda r: f"<script>if (a < b) document.write('<p>{sentence(r)}</p>');</script>",
    lambda r: f"<style>p > a {{ color: red }}</style><!-- <p>{escape(sentence(r))}</p> -->",
    lambda r: "<section id=comments><h3>Comments</h3>" + f"<article class=comment><p>{escape(sentence(r))}</p></article>" * r.randint(1, 4) + "</section>",
    lambda r: f"<p hidden>{escape(sentence(r))}</p><div style='display: none'>{escape(sentence(r))}</div>",
]

CONTENT = [
    lambda r, s: (f"<p>{escape(s)}</p>", [s]),
    lambda r, s: (f"<p>{escape(s)}\n", [s]),
    lambda r, s: (f"<h2>{escape(s)}</h2>", [s]),
    lambda r, s: (f"<p><b>{escape(s[: len(s) // 2])}</b>{escape(s[len(s) // 2 :])}</p>", [s]),
    lambda r, s: (f"<ul><li>{escape(s)}<li>{escape(s)}</ul>", [s, s]),
    lambda r, s: (f"<blockquote>\n  <p>{escape(s)}</p>\n</blockquote>", [s]),
    lambda r, s: (f"<table><tr><td>{escape(s)}</td><td>{escape(s)}</table>", [s, s]),
    lambda r, s: (f"<p>{escape(s)}<br/>{escape(s)}</p>", [f"{s} {s}"]),
    lambda r, s: (f"<pre>{escape(s.replace(' ', chr(10) + ' '))}</pre>", [s]),
    lambda r, s: (f"<section><h3>{escape(s)}</h3><div><p>{escape(s)}</p></div></section>", [s, s]),
]

FRAMES = [
    ("<article>", "</article>"),
    ("<article class='post has-sidebar'>", "</article>"),
    ("<main><div>", "</div></main>"),
    ("<div class=wrapper><div><article>", "</article></div></div>"),
    ("<div class='layout with-sidebar'><main id=m>", "</main></div>"),
]


def test_marked_articles_among_furniture_come_out_whole():
    rng = random.Random(13)
    for _ in range(400):
        start, end = rng.choice(FRAMES)
        body, want = "", []
        for _ in range(rng.randint(1, 8)):
            if rng.random() < 0.4:
                body += rng.choice(FURNITURE[:1] + FURNITURE[2:])(rng)  # the headings of an own header stay
            html, blocks = rng.choice(CONTENT)(rng, sentence(rng))
            body, want = body + html, want + blocks
        before = "".join(rng.choice(FURNITURE)(rng) for _ in range(rng.randint(0, 4)))
        after = "".join(rng.choice(FURNITURE)(rng) for _ in range(rng.randint(0, 4)))
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{start}{body}{end}{after}"
        assert main_blocks(page + rng.choice(["", "</body></html>"])) == want, page


def test_unmarked_articles_are_found_by_points():
    rng = random.Random(14)
    for _ in range(100):
        texts = [sentence(rng, 12, 40) for _ in range(rng.randint(3, 8))]
        links = "".join(f"<a href=/{i}>{escape(sentence(rng, 2, 4))}</a> " for i in range(12))
        page = (
            f"<div>{links}</div><div><div><p>" + "</p><p>".join(map(escape, texts)) + f"</p></div></div><div><a href=x>{escape(sentence(rng))}</a></div>"
        )
        assert main_blocks(page) == texts


def test_layout_names_and_wrapping_forms_do_not_cut_the_article():
    text = "A sentence, with a comma, of some length to be read."
    for page in (
        f"<div class='page with-sidebar'><article><p>{text}</p></article><div class=sidebar>no</div></div>",
        f"<form id=aspnet><div class=menu>no</div><div><p>{text}</p></div></form>",
        f"<div class='menu-open'><main><p>{text}</p></main></div>",
        f"<div><div><p>{text}</p></div></div><div class=sidebar><article class=comment><p>{text} no</p></article></div>",
    ):
        assert main_blocks(page) == [text]


def test_names_in_one_word_and_names_that_only_sound_alike():
    text = "A sentence, with a comma, of some length to be read."
    for name in ("commentlist", "rightsidebar", "cookieBar", "adsbygoogle", "topnav", "site-footer", "newsletterbox"):
        assert main_blocks(f"<div><div class=entry><p>{text}</p></div><div class='{name}'><p>{text} no, no, no</p></div></div>") == [text], name
    assert main_blocks(f"<div class=commentary><p>{text}</p></div>") == [text]
    assert main_blocks(f"<body class='comments-open'><article class='post comments-open'><p>{text}</p></article>") == [text]


def test_headings_of_an_own_header_stay():
    page = "<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by x</p></header><p>Body text.</p><footer>f</footer></article>"
    assert main_blocks(page) == ["Title", "Body text."]


def test_menu_inside_the_article_goes_but_lists_stay():
    links = "".join(f"<li><a href=/{i}>chapter {i}</a></li>" for i in range(5))
    page = f"<article><ul>{links}</ul><p>Text with <a href=x>a link</a>.</p><ul><li>one</li><li>two</li></ul></article>"
    assert main_blocks(page) == ["Text with a link.", "one", "two"]


def test_references_and_broken_markup():
    assert main_blocks("<article><p>&lt;p&gt; &amp &copy;&nbsp;&#x41;&#66; &bogus; 1 < 2</p></article>") == ["<p> & © AB &bogus; 1 < 2"]
    assert main_blocks("no tags, only text") == ["no tags, only text"]
    assert main_blocks("<article><p title='a > b'>one<p>two</article") == ["one", "two"]
    assert main_blocks("<article>x<!-- open") == ["x"]
    assert main_blocks("<article>x<!-->y</article>") == ["x y"] or main_blocks("<article>x<!-->y</article>") == ["xy"]
    assert main_blocks("<article>a</div></b></p>b</article>") == ["a", "b"]
    assert main_blocks(None) == main_blocks("") == main_blocks("<script>x") == main_blocks("<nav>x</nav>") == []


def test_time_grows_with_the_page():
    for page in ("<div>" * 50_000 + "x", "<b>" * 50_000 + "<div></div>" * 50_000, "<a " * 100_000, "<p x='" * 100_000, "</x>" * 100_000,
                 "<p>a, b</p>" * 50_000, "<li><table>" * 20_000, "<!--" * 100_000, "&" * 300_000, "<article>" * 20_000 + "<p>x"):
        main_blocks(page)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "u", "k"), (1, "", "u", "k"), (None, "<article>a, b</article>", None, "k"), (None, "<article>a, b</article>", None, "k")]
    pages = spark.createDataFrame(rows, "text long, html string, `n.chars` string, row string")
    out = sorted((r.row["text"] or 0, r.row["n.chars"] or "", r.text, r.n_chars) for r in htmltext.extracted(pages).collect())
    assert out == [(0, "", "a, b", 4), (0, "", "a, b", 4), (1, "u", "", 0), (1, "u", "", 0)]
    assert htmltext.extracted(pages.limit(0)).count() == 0
    assert htmltext.extracted(pages.select("html")).count() == 4
