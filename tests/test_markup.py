"""Sanitizing against markup that is broken or means harm, by cases written out by hand."""

import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from folioworks.functions import markup as M
from folioworks.functions import text as X
from folioworks.operators import content as C


def column(spark, change, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, h string")
    return [r[0] for r in df.orderBy("i").select(change(F.col("h"))).collect()]


KEPT = [
    # nothing is joined over a tag that goes: what is left is no script and no frame
    ("a<scr<meta>ipt src=x>alert(1)</scr<meta>ipt>b", "a<scr<meta>ipt src=x>alert(1)</scr<meta>ipt>b"),
    ("a<ifr<form>ame src=x>b", "a<ifr<form>ame src=x>b"),
    ("a<<meta>script>b", "a<<meta>script>b"[:2] + "script>b"),
    # a sign in quotes ends no tag, one outside a value's quotes does
    ('<input value="a>b">c', "c"), ("<p title='<form>'>c", "<p title='<form>'>c"), ("<p a\"='>'>c", "<p a\"='>'>c"),
    # elements end with those around them, and formatting ends alone
    ("<div><form>x</div>t", "<div></div>t"), ("<b><form></b>x</form>y", "<b></b>y"), ("<p><audio>x<p>t", "<p><p>t"), ("<ul><li><form>a<li>b</ul>", "<ul><li><li>b</ul>"),
    ("<table><tr><td><form>a<td>b</table>c", "<table><tr><td><td>b</table>c"), ("<i><form><b></i>x</b></form>y", "<i></i>y"),
    # but not over the edge of an object or a cell
    ("<div><object></div>x</object>y</div>", "<div>y</div>"), ("<object><div></object>x</div>y", "x</div>y"), ("<form><table><td></form>x</table>y</form>z", "z"),
    # what raw elements and comments hold is no markup
    ("<style>a<form>b</style>c", "<style>a<form>b</style>c"), ("<!-- <form> -->x<!--y--!><script>z</script>w<!-->v", "<!-- <form> -->x<!--y--!>w<!-->v"), ("<textarea><form></textarea>x", "x"),
    ("<iframe><p></iframe>x", "x"), ("<title><form></title>x", "<title><form></title>x"), ("<script>'</script >'</SCRIPT\n>x", "'x"),
    # no tags: a sign before a space, declarations, processing instructions
    ("a < form > b", "a < form > b"), ("<!doctype html><?x <form>?>y", "<!doctype html><?x <form>?>y"), ("</ form>x", "</ form>x"),
    # without an end
    ("a<form>open", "a"), ('a<img src="x onerror=b', "a"), ("a<script>b", "a"), ("a<style>b", "a<style>b</style>"), ("a<form", "a"), ("a</div", "a"), ("a<", "a<"),
    ("stray</form></select>y", "strayy"), ("<XML><p>i</xml><Template>t</template><noscript><p>n</noscript>k", "k"), ("<é><form>x</é>", "<é>"), ("", ""), (None, None),
]


def test_elements(spark):
    assert list(zip([a for a, _ in KEPT], column(spark, C.sanitize_tags, [a for a, _ in KEPT]))) == KEPT


class Names(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.seen = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, [n for n, _ in attrs]))


def test_no_dropped_element_is_left(spark):
    """Every cut of these pages, through both steps, as another reader of HTML sees it."""
    html = '<div a="x>"><form/onx=1 b=\'>\'><scr<script>ipt>x</scr</script>ipt><b onclick="a>b"onload=c><object><p></object></b></form><img/onerror=q src=w>'
    cuts = [html[i:] + html[:i] for i in range(len(html))]
    for out in column(spark, lambda h: C.sanitize_attrs(C.sanitize_tags(h)), cuts):
        for tag, names in Names(out).seen:
            assert tag not in C.DROPPED_TAGS and not [n for n in names if n.startswith("on")], out


def test_tokens_joined_are_the_text(spark):
    texts = [a for a, _ in KEPT if a] + ["<a <b <c", "<!--", "<p a=1 / b>", "</", "x<!x", '<a b="c'] + ["<script>" * 3]
    assert column(spark, lambda h: F.array_join(M.tokens_of(h), ""), texts) == texts


ATTRIBUTES = [
    ('<a title="x onclick=y" onclick=z>k</a>', '<a title="x onclick=y">k</a>'), ("<img/onerror=alert(1) src=x>", "<img src=x>"), ('<img src="a"onerror="b">', '<img src="a">'),
    ("<a href=&#100;ata:text/html,x>", "<a>"), ("<a href=' data:text/html,x' src='data:image/png'>", "<a src='data:image/png'>"), ("<br onx />", "<br/>"), ("<a href=x/ onb=c>", "<a href=x/>"),
    ("<script onload=x>a onclick=y</script>", "<script>a onclick=y</script>"), ("<!-- <a onx=1> -->", "<!-- <a onx=1> -->"), ("<a on=1 ON\n=\n'2' ono>", "<a>"), ("</a onx=1>", "</a onx=1>"),
    ("<a b=c>", "<a b=c>"), ("<a  b = c  d>", "<a  b = c  d>"), ("onclick=x <p>", "onclick=x <p>"), (None, None),
]


def test_attributes(spark):
    assert column(spark, C.sanitize_attrs, [a for a, _ in ATTRIBUTES]) == [b for _, b in ATTRIBUTES]
    flags = column(spark, C.attribute_flags, [a for a, _ in ATTRIBUTES])
    assert [f and f.handlers for f in flags][:3] == [1, 1, 1] and flags[3].inline_html == flags[4].inline_html == 1 and [f and f.handlers for f in flags][7:11] == [1, 0, 3, 0]


def test_presentation_and_links_keep_quoted_values(spark):
    cases = ['<p title="a width=3" width=3/>', '<img/width=3 align=left title="style=x">', "<font color='>'face=x>y</font>"]
    assert column(spark, C.strip_presentation, cases) == ['<p title="a width=3">', '<img/width=3 title="style=x">', "<font>y</font>"]
    links = ['<a title="x target=y" href="/in"target=q>', '<a title="rel=1"rel=2 href="http://x">']
    assert column(spark, C.harden_links, links) == ['<a title="x target=y" href="/in">', '<a title="rel=1" href="http://x" target="_blank" rel="noopener noreferrer">']


def test_body(spark):
    cases = [
        ("<head><script>'<body>'</script></head><body a='>'><p>x</body>y", "<p>x"), ("<title><body></title><!--<body>--><body>r", "r"),
        ("<html><HEAD a><title></head></title></head>z", "<html>z"), ("q", "q"), ("<head>open", "<head>open"), (None, None),
    ]
    assert column(spark, C.body_of, [a for a, _ in cases]) == [b for _, b in cases]


@pytest.mark.parametrize(
    "page,change,left",
    [
        ("<form>" * 8000 + "x", C.sanitize_tags, ""),
        ("<div>" * 4000 + "<form>x" + "</div>" * 4000 + "y", C.sanitize_tags, "<div>" * 4000 + "</div>" * 4000 + "y"),
        ("<p><select><option>a<b>" * 4000 + "</select>z", C.sanitize_tags, "<p>z"),
        ("<a " * 40_000, C.sanitize_tags, ""),
        ("<script>" * 40_000, C.sanitize_tags, ""),
        ("<a " + "x=1 onx='2' " * 20_000 + ">", C.sanitize_attrs, "<a" + " x=1" * 20_000 + ">"),
        ("<" * 40_000, X.strip_tags, "<" * 40_000),
    ],
)
def test_long_broken_pages_take_no_longer(spark, page, change, left):
    column(spark, change, [page[:2000]])
    began = time.time()
    assert column(spark, change, [page]) == [left]
    assert time.time() - began < 10  # a walk that looked back would take minutes
