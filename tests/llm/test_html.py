import os
import time
from html.parser import HTMLParser

import pytest

from verbatim.llm import html

from .helpers import EDGES


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p class="a"">one</p><p class="b"">two</p>', "one\n\ntwo"),
        ("<a title=don't>Click</a> <p>it's fine</p>tail", "Click\n\nit's fine\n\ntail"),
        ('<p "hidden>a</p><p title=x"y hidden>b</p>c', "a\n\nc"),
        ("<a href='x>unclosed", "unclosed"),
        ('<a title = "a > b">c</a>', "c"),
        ("<a title= 'a > \"b'>c</a>", "c"),
        ("<p a=>b</p><p =\"c>d</p>", "b\n\nd"),
        ("<p/class='x>y'/>a</p title='>'>b", "a\n\nb"),
        ('<p data-x="hidden">a</p><p style="display:none">b</p>', "a"),
    ],
)
def test_quotes_open_a_value_only_after_an_equals_sign(page, text):
    assert html.extract(page) == text


def test_stray_quotes_take_linear_time():
    began = time.time()
    assert html.extract("<a title=don't b='c \"d>x</a> " * 20_000).count("x") > 0
    assert html.extract("<p class=\"a\"\">x</p>" * 20_000).count("x") == 20_000
    assert time.time() - began < 20


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr>stray<td>a</td></tr></table>", "stray\na"),
        ("<table><tr><td>a</td> tail</tr></table>", "tail\na"),
        ("<table><tr><td>a<td>b</td>tail<tr><td>c<td>d</table>", "tail\na  b\nc  d"),
        ("<table><colgroup><col>stray<tr><td>a</table>", "stray\na"),
        ("a<xmp><b>x</b> &amp;\n  y</xmp>b", "a\n\n<b>x</b> &amp;\n  y\n\nb"),
        ("<xmp hidden>x</xmp>b<xmp>left open", "b\n\nleft open"),
    ],
)
def test_text_beside_cells_and_in_xmp_is_kept(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("depth", range(248, 260))
@pytest.mark.parametrize("inner", ["<table><tr><td>", "<table><tr><td>y<td>", "<table><tbody><tr><th>y</th>", "<table><colgroup>", "<ul><li>y<li>", "<p>y</p>", "<xmp>", "<table><caption>"])
def test_no_text_is_lost_at_the_depth_limit(depth, inner):
    want = ["y", "x"] if "y" in inner else ["x"]
    assert sorted(html.extract("<div>" * depth + inner + "x").replace("- ", "").split()) == sorted(want)
    assert sorted(html.extract("<div>" * (depth % 3) + "<table><tr><td>" * 300 + inner + "x").replace("- ", "").split()) == sorted(want)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title=it's>Hello it's fine</p><p>after</p>", "Hello it's fine\n\nafter"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide  z\na  b  c"),
        ("<table><tr><td>a<td>bb<td>c<tr><td colspan='2'>x<td>y</table>", "a  bb  c\nx      y"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<table><tr><td colspan=1000>a<td colspan=1000>b</table>", "a  b"),
        ("<div style='visibility:hidden'>a<p style='visibility:visible'>b<i style='visibility: hidden'>c</i>d</p>e</div>f", "bd\n\nf"),
        ("<div style='display:none'>a<p style='display:block;visibility:visible'>b</p></div>c", "c"),
        ("<p style='display:none;display:inline'>a</p><p style='visibility:visible;visibility:collapse'>b</p>", "a"),
        ("<table><tr><td style='visibility:hidden'>a<td>b<tr><td>c<td>d</table>", "   b\nc  d"),
        ("<dialog open>a</dialog><dialog>b</dialog>", "a"),
    ],
)
def test_spans_and_visibility(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("depth", [10, 300, 5000])
def test_rules_hold_at_any_depth(depth):
    assert html.extract("<div>" * depth + "<div style='display:none'>secret</div>x<ul><li>y</ul>" + "</div>" * depth + "z") == "x\n\n- y\n\nz"
    assert html.extract("<table><tr><td>" * depth + "a<td>b" + "</table>" * depth + "z").split() == ["a", "b", "z"]
    assert html.extract("<ul><li>" * depth + "a").split()[-1] == "a"


def test_time_grows_with_length_alone():
    began = time.time()
    assert html.extract('<a b="' * 170_000) == '<a b="' * 170_000
    assert time.time() - began < 3  # about 0.1 s
    for page in ("<!" * 300_000, "<a b='\"" * 80_000 + "'>\"", "<div>" * 80_000 + "x", "<p><td>" + "<div>" * 60_000, "<table><tr><td>x<td>" * 8000, "<table><tr>" + "<td rowspan=0 colspan=900>x" * 2000 + "<tr><td>y" * 2000, "<colgroup>" * 50_000):
        began = time.time()
        html.extract(page)
        assert time.time() - began < 30, page[:30]


class Words(HTMLParser):
    """Visible words by another parser: only what hides text is followed, no layout."""

    def __init__(self):
        super().__init__()
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in html.VOID:
            self.out.append(" " if tag == "br" else "")
            return
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        self.open.append((tag, tag in html.HIDDEN or "hidden" in a or "display:none" in style or "visibility:hidden" in style or tag == "dialog" and "open" not in a))
        self.out.append(" " if tag in html.BLOCK or tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        self.out.append(" " if tag in html.BLOCK or tag in ("td", "th") else "")

    def handle_data(self, data):
        if not any(gone for _, gone in self.open):
            self.out.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_words_of_pages_equal_another_parsers(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(pages) > 100
    for r in pages:
        parser = Words()
        parser.feed(r["html"] or "")
        parser.close()
        got = [w for line in html.extract(r["html"]).split("\n") for w in line.split()]
        marks = lambda words: [w for w in words if w != "-" and not (w[:-1].isdigit() and w[-1] == ".")]
        assert marks(got) == marks("".join(parser.out).split()), r["page_id"]


def test_page_edges(spark):
    rows = [(d, t, 1, "x", "y") for d, t in EDGES] + [(50, "<p>w</p>" * 200_000, 1, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string, id int, text string, raw string")
    got = html.extract_pages(pages)
    assert got.columns == ["page_id", "text"]
    assert sorted((str(r["page_id"]), r["text"]) for r in got.collect()) == sorted((str(d), html.extract(t)) for d, t, *_ in rows)
    assert html.extract(rows[-1][1]) == "\n\n".join(["w"] * 200_000)
    assert html.extract_pages(pages.where("false")).count() == 0
