"""Main text against the pages' own article element, read with another parser."""

from html.parser import HTMLParser

import numpy as np
import pytest

from millrace.llm import html_text as H
from millrace.llm.common import read_table


class Article(HTMLParser):
    """Blocks inside <article>, for the simple pages of the test tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.parts.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.parts.append("")
        if tag == "article":
            self.on = False

    def handle_data(self, data):
        if self.on:
            self.parts[-1] += data


def article(page):
    a = Article()
    a.feed(page)
    a.close()
    return "\n".join(t for t in (" ".join(p.split()) for p in a.parts) if t)


def test_pages(spark, sf_dir):
    rows = H.op6_block_text(spark, sf_dir).join(read_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect()
    assert len(rows) == read_table(spark, sf_dir, "pages").count()
    assert np.mean([r.text == article(r.html) for r in rows]) > 0.99
    assert all(r.n_chars == len(r.text) for r in rows)


def test_tree_knows_its_table():
    for page, marks in H.LABELLED:
        assert "".join(map(str, H.trained().predict(H.features(H.blocks(page))))) == marks


def test_tree_asks_for_the_neighbours():
    used = H.trained().used()
    assert used & {"links_before", "links_after"} and used & {"words_before", "words_after"}


WORDS = " ".join(f"plain{i} word{i}" for i in range(30)) + "."


@pytest.mark.parametrize("page,want", [
    (f"<body class='has-sidebar'><article><h1>Title here</h1><p>{WORDS}</p></article></body>", f"Title here\n{WORDS}"),
    (f"<article class='post with-comments'><p>{WORDS}</p><p>Short.</p></article>", f"{WORDS}\nShort."),
    (f"<svg viewBox='0 0 1 1'/><article><p>{WORDS}</p></article><svg><text>no</text></svg>", WORDS),
    (f"<article><div class='entry-header'><h1>Title here</h1></div><p>{WORDS}</p></article>", f"Title here\n{WORDS}"),
    (f"<html id=menu><form id=aspnet><main><p>{WORDS}</p></main></form></html>", WORDS),
    (f"<div class='layout sidebar-right'><div class=text><p>{WORDS}</p></div><div class=sidebar><p>{WORDS}</p></div></div>", WORDS),
    (f"<article><p>{WORDS}</p><h3>Related</h3><ul><li><a href=/>One story more</a><li><a href=/>Another story</a></ul></article>", WORDS),
    (f"<article><p>{WORDS}</p><div class=comments><p>{WORDS}</p></div></article>", WORDS),
])
def test_misleading_names(page, want):
    assert H.page_text(page, H.trained()) == want


def test_blocks():
    got = H.blocks("<title>No</title><script>var t='</p>x<p>'</script><!-- <p>no --><p>A &amp;\n <b>b</b>c<br>d &#x41;&eacute &am</p>"
                   "<div class='top menu'>x <a href='a>b'>y z</a></div>tail <i>open")
    assert [(b[0], b[1], round(b[2], 2), b[5]) for b in got] == [
        ("A & bc d Aé &am", 6, 0.0, False), ("x y z", 3, 0.67, True), ("tail open", 2, 0.0, False)]


def test_odd_pages(spark):
    t = H.trained()
    assert [H.page_text(p, t) for p in (None, "", "  ", "<", "<p", "<!--", "<script>x", "</p></article>")] == [""] * 8
    deep = "<div>" * 3000 + "<article><p>Text here.</p>" + "</div>" * 10
    assert H.page_text(deep, t) == "Text here."
    long = "<article>" + "<p>Some words of text.</p>" * 50_000
    assert H.page_text(long, t).count("\n") == 49_999
    df = spark.createDataFrame([(1, None), (1, "<article><p>a</p>")], "page_id long, html string")
    assert sorted(r[0] for r in df.select(H.main_text(df.html)).collect()) == ["", "a"]
    assert df.limit(0).select(H.main_text(df.html)).count() == 0
