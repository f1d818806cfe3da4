"""Operators on small tables, against cases written out by hand and plain statements of their rules."""

import random
import re

from pyspark.sql import functions as F

from folioworks.functions import encodings as E
from folioworks.functions import paths as P
from folioworks.functions import text as X
from folioworks.operators import content as C
from folioworks.operators import detection as DT
from folioworks.operators import navigation as N
from folioworks.operators import state as R
from folioworks.sources import entries as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def tree_rule(tags):
    """Parents by a stack: what a reader of the tags from left to right keeps."""
    stack, last, out = [-1], None, []
    for t in tags:
        if t == "u":
            stack.append(stack[-1] if last is None else last)
            last = None
        elif t == "/":
            if len(stack) > 1:
                last = stack.pop()
        else:
            out.append(stack[-1])
            last = len(out) - 1
    return out


def test_sitemap_parents(spark):
    rng = random.Random(3)
    streams = ["".join(rng.choice("uu//nnn") for _ in range(rng.randint(0, 16))) for _ in range(250)]
    html = {"u": "<UL>", "/": "</ul>", "n": '<object type="text/sitemap"><param name=Name value="x"></object>'}
    docs = spark.createDataFrame([("a", str(i), "".join(html[c] for c in s)) for i, s in enumerate(streams)], "archive_id string, path string, text string")
    got = {}
    for r in N.sitemap_nodes(docs).select("path", "node_id", "parent_id").collect():
        got.setdefault(int(r.path), {})[r.node_id] = r.parent_id
    for i, s in enumerate(streams):
        want = tree_rule(s)
        assert [got.get(i, {}).get(k) for k in range(len(want))] == want, s


def test_sitemap_content(spark):
    text = """<OBJECT type='text/site properties'><param name=x value=y></OBJECT><ul><li>
    <object type="text/sitemap"><param name="Name" value="A &amp; B"><param name='Local' value='a\\b.htm'><param name=Local value=c.htm></object>
    <ul><li><OBJECT type=text/sitemap><PARAM NAME=Name VALUE="Folder"></OBJECT><ul><object type="text/sitemap"><param name=local value=d.htm></object></ul></ul>
    <object type="text/sitemap"><param name="keyword" value="k"></object></ul>"""
    nodes = N.sitemap_nodes(spark.createDataFrame([("a", "/x/t.hhc", text)], "archive_id string, path string, text string"))
    assert rows(nodes.select("node_id", "parent_id", "name", "local", "locals"), "node_id") == [
        (0, -1, "A & B", "a\\b.htm", ["a\\b.htm", "c.htm"]), (1, 0, "Folder", None, []), (2, 1, "d.htm", "d.htm", ["d.htm"]),
    ]
    assert [r.local for r in N.toc_nodes(nodes).orderBy("node_id").collect()] == ["/x/a/b.htm", None, "/x/d.htm"]
    assert rows(N.index_entries(nodes).select("pos", "label", "targets"), "pos") == [(0, "A & B", ["/x/a/b.htm", "/x/c.htm"]), (1, "A & B, Folder, d.htm", ["/x/d.htm"])]


def test_chapter_rows(spark):
    text = """pages[2]=['02_1','<b>T&amp;2</b>','1'];pages[10]=["f\\"q",'T10','1','<img src="x">'];
    pages [ 1 ] = ['01','T1','9',' Vol [1] '] ; pages[3]=['only'];"""
    items = N.pages_items(spark.createDataFrame([("a", "/p.js", text)], "archive_id string, path string, text string"))
    assert rows(items.select("idx", "file", "title", "volume"), "idx") == [(1, "01", "T1", "Vol [1]"), (2, "02_1", "T&2", None), (10, 'f"q', "T10", None)]


def test_reading_order_and_navigation(spark):
    toc = spark.createDataFrame([("a", 0, "A", "/A.htm"), ("a", 1, "Group", None), ("a", 2, "B", "/b.htm"), ("a", 3, "again", "/a.HTM")], "archive_id string, pos int, name string, local string")
    docs = spark.createDataFrame([("a", 0, "/a.htm"), ("a", 1, "/c.htm")], "archive_id string, pos int, path string")
    spine = N.reading_order(toc, docs)
    assert rows(spine.select("position", "path"), "position") == [(0, "/A.htm"), (1, "/b.htm"), (2, "/c.htm")]
    named = N.toc_labels(spine, toc)
    assert [r.label for r in named.orderBy("position").collect()] == ["A", "B", "c.htm"]
    nav = rows(N.spine_nav(named).select("position", "prev_label", "next_path", "percent", "chapters"), "position")
    assert nav == [(0, None, "/b.htm", 33, 3), (1, "A", "/c.htm", 67, 3), (2, "B", None, 100, 3)]
    entries = spark.createDataFrame([("a", 0, "/Home.htm"), ("a", 1, "/INDEX.htm")], "archive_id string, entry_seq int, path string")
    assert rows(N.promote_entry(spine, entries).select("position", "path", "entry_name"), "position")[0] == (0, "/INDEX.htm", "Index")


def test_fallback(spark):
    docs = spark.createDataFrame([("a", 0, "/x/1.htm"), ("a", 1, "/2.htm"), ("a", 2, "/x/3.htm"), ("b", 0, "/y/1.htm")], "archive_id string, pos int, path string")
    got = rows(N.fallback_toc(docs).select("archive_id", "pos", "group_no", "folder", "name"), "archive_id", "pos")
    assert got == [("a", 0, 0, "x", "1"), ("a", 1, 1, "(top)", "2"), ("a", 2, 0, "x", "3"), ("b", 0, None, None, "1")]


def test_sanitizing(spark):
    cases = [
        ("a<script>var x='</p>'</script>b<script>open", "ab"),
        ("<form><p>x<select><option>1</select></form>y", "y"),
        ("<p>k<input type=text><META a></form>l</p>", "<p>kl</p>"),
        ("<iframe src=x>t</iframe><object><embed></object>z", "z"),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, h string")
    assert [r[0] for r in df.orderBy("i").select(C.sanitize_tags(F.col("h"))).collect()] == [b for _, b in cases]
    cases = [
        ('<a onclick="x>y" HREF="p" ONLOAD=z>on x=1</a>', '<a HREF="p">on x=1</a>'),
        ("<a href='data:text/html,x' src=\"data:image/png\">", '<a src="data:image/png">'),
        ("<a href='javascript:go()'>", "<a href='javascript:go()'>"),
        ("", ""),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, h string")
    assert [r[0] for r in df.orderBy("i").select(C.sanitize_attrs(F.col("h"))).collect()] == [b for _, b in cases]


def test_references(spark):
    html = "<a href='b.htm#f'>x</a><img SRC=\"/i%20j.gif\"><body background=http://x/y><a href='#z'><a href=''><td background=\"..\\q.gif\">"
    refs = C.references(spark.createDataFrame([("a", "/d/p.htm", html)], "archive_id string, path string, html string"))
    got = rows(refs.select("at", "tag", "attr", "target_path", "fragment"), "at")
    assert [g[1:] for g in got] == [("a", "href", "/d/b.htm", "f"), ("img", "src", "/i j.gif", ""), ("body", "background", None, ""), ("a", "href", None, "z"), ("td", "background", "/q.gif", "")]
    entries = spark.createDataFrame([("a", 0, "/D/B.HTM")], "archive_id string, entry_seq int, path string")
    assert {r.target_path for r in C.missing_references(refs, entries).collect()} == {"/i j.gif", "/q.gif"}
    kinds = {r.raw: r.link_class for r in C.classify_links(refs).collect()}
    assert kinds == {"b.htm#f": "internal", "/i%20j.gif": "internal", "http://x/y": "external", "#z": "fragment", "..\\q.gif": "internal"}


def column(spark, change, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, h string")
    return [r[0] for r in df.orderBy("i").select(change(F.col("h"))).collect()]


def test_script_navigation(spark):
    cases = [
        ("location='a.htm'", ["'a.htm'"]), ("window.location.href = \"b\"", ['"b"']), ("location.replace('c', 1)", ["'c'"]), ("location.assign(x+'d')", ["x+'d'"]),
        ("if (location == 'x') {}", []), ("if (location.href === 'x') {}", []), ("foo.location = 'x'", []), ("'location=\"x\"'", []), ("// location='x'", []),
        ("/* location='x' */ self.location='e'", ["'e'"]), ("location.hash = 'x'", []), ("location.search = '?x'", []), ("mylocation='x'", []),
        # no name of the set: another window's, and members with space around the dot
        ("parent.location='f'; this.location.href='g'", ["'g'"]), ("top . location.replace('c')", []), ("obj . location = 'x'", []),
        # an argument is more than its first literal, and ends at a comma outside brackets
        ("location.href = 'a' + id + '.htm'", ["'a' + id + '.htm'"]), ("location = f(x), y = 'z'", ["f(x)"]), ("location.href = f(\"a\",\"b\");", ['f("a","b")']),
        ("location.assign(f(1, [2, 3]), 4)", ["f(1, [2, 3])"]), ("document.location = url;x", ["url"]), ("location = {a: ';'}\nlocation='n'", ["{a: ';'}", "'n'"]),
        # templates and regular expressions
        ("`location='no'`", []), ("x = /location='no'/; top.location='t'", ["'t'"]), ("x = /[/]location='no'/g.test(y)", []), ("a = b / c; location='q' / 2", ["'q' / 2"]),
        ("location=\"a\";location.href=\"b\";", ['"a"', '"b"']), ("document.location.href = \"x\" /* c, */ + 'y'", ["\"x\" /* c, */ + 'y'"]), ("location=", []), (None, []),
    ]
    got = column(spark, C.navigation_arguments, [s for s, _ in cases])
    assert [g or [] for g in got] == [w for _, w in cases]
    df = spark.createDataFrame([("a", "/p", "location='x\\n'; location = f('y')")], "archive_id string, path string, text string")
    assert rows(C.script_nav_edges(df).select("at", "argument", "target"), "at") == [(0, "'x\\n'", "x\n"), (1, "f('y')", None)]


def test_navigation_rewritten_in_place(spark):
    names = ("document.location", "document.location.href", "location.href", "location", "this.location", "window.location", "top.location", "self.location")
    cases = [(f'{x} = "x";', 'go("x");') for x in names] + [(f'{x}("x");', 'go("x");') for x in ("location.assign", "location.replace")]
    same = ['if (location.href == "x") {}', 'if (location.href === "x") {}', "var s = \"location.href = 'x'\";", '// location.href = "x";\n', '/* location.href = "x"; */', 'obj.location = "x";', 'location.hash = "#f";', 'location.search = "?x";', "location=", "location.assign()", "no names", "", None]
    cases += [(x, x) for x in same] + [
        ('location.href = f("a","b");', 'go(f("a","b"));'), ('location.href="a";location.href="b";', 'go("a");go("b");'), ('location.href = "a" + "b";', 'go("a" + "b");'), ("document.location = url;", "go(url);"),
        ("a;\n location =  x  // why\n;b", "a;\n go(x)  // why\n;b"), ("location = /* y */ x /* z */;", "go(/* y */x) /* z */;"), ("location.replace('c', 1) ;", "go('c', 1) ;"), ("if(a)location={b:';'}\nc", "if(a)go({b:';'})\nc"), ("location = 'a' , b", "go('a') , b"),
    ]
    assert column(spark, lambda s: C.rewrite_navigation(s, "go"), [a for a, _ in cases]) == [b for _, b in cases]
    page = "<p onclick=\"location='a'\"><SCRIPT x>location='b'</script ><script src=y></script><style>location='c'</style><script>top.location='d'"
    assert column(spark, lambda h: C.rewrite_page_scripts(h, "go"), [page, None]) == [page.replace("location='b'", "go('b')").replace("top.location='d'", "go('d')"), None]


def test_last_of_a_spelling_in_the_archives_order(spark):
    pages = spark.createDataFrame([("a", 3, "/F.htm", "old?"), ("a", 9, "/f.htm", "new"), ("a", 1, "/x.htm", "<iframe src=F.HTM></iframe>")], "archive_id string, entry_seq int, path string, html string")
    got = {r.path: r.html for r in C.inline_frames(pages).collect()}
    assert "new" in got["/x.htm"]
    turned = pages.withColumn("entry_seq", -F.col("entry_seq"))
    assert "old?" in {r.path: r.html for r in C.inline_frames(turned).collect()}["/x.htm"]
    sheets = spark.createDataFrame([("a", 2, "/S.css", "p{}"), ("a", 1, "/s.css", "q{}")], "archive_id string, entry_seq int, path string, css string")
    linked = spark.createDataFrame([("a", "/x.htm", "<link rel=stylesheet href=s.css>")], "archive_id string, path string, html string")
    assert [r.css for r in C.page_styles(linked, sheets).collect()] == ["p{}"]


def test_deep_nesting_goes_whole(spark):
    forms = "<form>" * 9 + "x" + "</form>y" * 9
    cases = [(forms + "z", "yz"), ("a<FORM><button>b</form>c<select>d</select>", "ac"), ("<object><form><object>1</object>2</form></object>k", "k"), ("a<form>open", "a"), (None, None)]
    assert column(spark, C.sanitize_tags, [a for a, _ in cases]) == [b for _, b in cases]


def test_hardened_links(spark):
    cases = [
        ('<a target="_self" rel=x href="http://x">', '<a href="http://x" target="_blank" rel="noopener noreferrer">'),
        ("<A HREF=mailto:x target />", '<A HREF=mailto:x target="_blank" rel="noopener noreferrer"/>'),
        ('<a href="/in" target=_top>', '<a href="/in">'), ('<a href="javascript:x()" target=q>', '<a href="javascript:x()" target="_blank" rel="noopener noreferrer">'), ('<area href="http://x">', '<area href="http://x">'),
    ]
    assert column(spark, C.harden_links, [a for a, _ in cases]) == [b for _, b in cases]


def test_backgrounds_keep_styles(spark):
    cases = [
        ('<td id="a" style="color:red" BACKGROUND = "i.gif">', "<td id=\"a\" style=\"color:red;background-image:url('i.gif')\">"),
        ("<body style='margin:0; background-image: url(o.gif); top:1px;' background=n.gif/>", "<body style=\"margin:0; top:1px;background-image:url('n.gif/')\">"),
        ("<td background=\"it's.gif\">", "<td style=\"background-image:url('it%27s.gif')\">"),
        ("<td background='http://x/y.gif'>", "<td background='http://x/y.gif'>"), ("<p>background=x</p>", "<p>background=x</p>"),
    ]
    assert column(spark, C.project_background, [a for a, _ in cases]) == [b for _, b in cases]


def test_frames_in_frames(spark):
    pages = [
        ("/i.htm", '[<iframe src="sub/p.htm">no frames</iframe>]'), ("/sub/p.htm", "P<frame src=q.htm>"), ("/sub/q.htm", "Q<frame src='r.txt'>"), ("/sub/r.txt", "R"), ("/q.htm", "WRONG"),
        ("/case.htm", "<frame src=/two.htm>"), ("/TWO.htm", "upper"), ("/two.htm", "lower"), ("/odd.htm", "\x01<frame src=none.htm><frame src='a.gif'><iframe src=http://x/p.htm></iframe>\x01"), ("/a.gif", "GIF"),
    ]
    df = spark.createDataFrame([("a", p, h) for p, h in pages] + [("b", "/sub/p.htm", "other")], "archive_id string, path string, html string")
    got = {(r.archive_id, r.path): r.html for r in C.inline_frames(df).collect()}
    assert len(got) == len(pages) + 1
    assert got["a", "/i.htm"] == "[<div class=\"frame\">P<div class=\"frame\">Q<frame src='r.txt'></div></div>]"
    assert got["a", "/sub/q.htm"] == 'Q<div class="frame">R</div>'
    assert got["a", "/case.htm"] == '<div class="frame">lower</div>'
    assert got["a", "/odd.htm"] == dict(pages)["/odd.htm"] and got["b", "/sub/p.htm"] == "other"
    links = [("<frameset><FRAME name=a src=/f.htm></frameset>", '<div><p><a href="/f.htm">→ /f.htm</a></p></div>'), ("<iframe src='a\"b.htm'>x<b>y</b></iframe>", '<p><a href="a&quot;b.htm">→ a"b.htm</a></p>'), ("<iframe src=http://x></iframe>", "<iframe src=http://x></iframe>")]
    assert column(spark, C.frames_to_links, [a for a, _ in links]) == [b for _, b in links]


def test_css_in_place(spark):
    sheets = [
        ("/c/1.css", "@import url('2.css');p{background:url(i.gif)}@import \"http://x/y.css\";@import 'none.css';"), ("/c/2.css", "@import 'd/3.css' screen; b{}"), ("/c/d/3.css", "@import \"4.css\";u{x:URL( \"j.gif\" )}"),
        ("/c/d/4.css", "@import '5.css';v{}"), ("/c/d/5.css", "@import '6.css';w{}"), ("/c/d/6.css", "deep"),
    ]
    df = spark.createDataFrame([("a", p, c) for p, c in sheets], "archive_id string, path string, css string")
    urls = spark.createDataFrame([("a", "/c/1.css", "i.gif", "U1"), ("a", "/c/d/3.css", "j.gif", "U2")], "archive_id string, path string, raw string, url string")
    whole = {r.path: r.whole for r in C.expand_css(df, urls).collect()}
    assert whole["/c/1.css"] == "@import '6.css';w{}v{}u{x:url(\"U2\")} b{}p{background:url(\"U1\")}" and whole["/c/d/5.css"] == "deepw{}"
    assert {(r.path, r.target) for r in C.css_urls(df).collect()} == {("/c/1.css", "/c/i.gif"), ("/c/d/3.css", "/c/d/j.gif")}
    pages = spark.createDataFrame([("a", "/p.htm", "<link rel=StyleSheet href='C/2.CSS'><style>q{}</style><link rel=icon href=c/1.css>")], "archive_id string, path string, html string")
    assert rows(C.page_styles(pages, df).select("kind", "base", "css"), "kind") == [("inline", "/p.htm", "q{}"), ("linked", "/C/2.CSS", "@import 'd/3.css' screen; b{}")]


def test_references_rewritten_in_any_quotes(spark):
    html = "<img src=old1 href=\"old2\"><a HREF = 'old&amp;3' title='src=old1'>old1</a><p data-src=old1>"
    pages = spark.createDataFrame([("a", "/p", html), ("a", "/q", html)], "archive_id string, path string, html string")
    urls = spark.createDataFrame([("a", "/p", "old1", "n1"), ("a", "/p", "old2", 'n"2'), ("a", "/p", "old&3", "n3"), ("a", "/p", "old1", "n1")], "archive_id string, path string, raw string, url string")
    got = {r.path: r.html for r in C.rewrite_refs(pages, urls).collect()}
    assert got == {"/p": "<img src=\"n1\" href=\"n&quot;2\"><a HREF = \"n3\" title='src=old1'>old1</a><p data-src=old1>", "/q": html}


def test_audit(spark):
    html = "<script>x</script><FORM onsubmit=y><a href=' javascript:a()' ONCLICK='b'><img src='data:text/html,x'></form><p>on x=1</p>"
    pages = spark.createDataFrame([("a", "/p", html), ("a", "/q", "<p>")], "archive_id string, path string, html string")
    assert rows(C.sanitize_audit(pages).select("path", "what", "n"), "what") == [("/p", "form", 1), ("/p", "handler", 2), ("/p", "inline html", 1), ("/p", "script", 1), ("/p", "script link", 1)]


def test_scripts_once_and_decoded(spark):
    pages = spark.createDataFrame([("a", "/p.htm", "<script src=s.js></script><script src='http://x/s.js'></script><script>y</script>")], "archive_id string, path string, html string")
    entries = [("a", 0, "/s.js", "old".encode(), "gbk"), ("a", 1, "/S.JS", "中文".encode("gbk"), "gbk"), ("b", 0, "/s.js", b"other", "gbk")]
    df = spark.createDataFrame(entries, "archive_id string, entry_seq long, path string, content binary, encoding string")
    with E.lenient_charsets(spark):
        found = C.script_sources(pages, df)
        found.schema
    assert [(r.script_path, r.text) for r in found.collect()] == [("/S.JS", "中文")]


def test_sitemaps_however_deep(spark):
    """Lists nested 600 deep and files of more tags than are walked at a time; each node's trail is its parent's and itself."""
    rng = random.Random(4)
    streams = ["u" * 600 + "n" + "uuu" + "n" + "/" * 700 + "n", "n" * 700, "un" * 300 + "/n" * 300] + ["".join(rng.choice("uu//nnnn") for _ in range(900)) for _ in range(3)]
    html = {"u": "<UL>", "/": "</ul>", "n": '<object type="text/sitemap"><param name=Name value="x"></object>'}
    docs = spark.createDataFrame([("a", str(i), "".join(html[c] for c in s)) for i, s in enumerate(streams)], "archive_id string, path string, text string")
    got = {}
    for r in N.sitemap_nodes(docs).collect():
        got.setdefault(int(r.path), {})[r.node_id] = (r.parent_id, [t.id for t in r.trail])
    for i, s in enumerate(streams):
        want = tree_rule(s)
        assert [got[i][k][0] for k in range(len(want))] == want
        assert all(trail == ([] if parent < 0 else got[i][parent][1]) + [k] for k, (parent, trail) in got[i].items())


def test_trail_to_the_first_node(spark):
    toc = [("a", 0, None, [(0, "V")]), ("a", 1, "/x.htm", [(0, "V"), (1, "X")]), ("a", 2, "/X.htm", [(2, "again")])]
    df = spark.createDataFrame(toc, "archive_id string, node_id int, local string, trail array<struct<id:int,name:string>>")
    targets = spark.createDataFrame([("a", "/x.HTM"), ("a", "/none.htm"), ("b", "/x.htm")], "archive_id string, path string")
    got = {(r.archive_id, r.path): (r.node_id, r.trail) for r in N.ancestor_trail(df, targets).collect()}
    assert got == {("a", "/x.HTM"): (1, ["V", "X"]), ("a", "/none.htm"): (None, None), ("b", "/x.htm"): (None, None)}


def test_which_script_counts(spark):
    row = "pages[%d]=['f%d','T%d'];"
    good = "".join(row % (i, i, i) for i in range(3))
    files = [
        (0, "/0.js", row % (1, 1, 1) + row % (2, 2, 2) + row % (3, 3, 3)), (1, "/few.js", row % (0, 0, 0) + row % (1, 1, 1)), (2, "/big.js", good + " " * 600_000), (3, "/e.js", ""), (4, "/no.txt", good),
        (6, "/yes.JS", good.replace("T", "章")), (7, "/later.js", good),
    ]
    df = spark.createDataFrame([("a", s, p, t.encode("gbk"), "gbk") for s, p, t in files], "archive_id string, entry_seq int, path string, content binary, encoding string")
    with E.lenient_charsets(spark):
        found = N.chapter_scripts(df)
        found.schema
    assert [(r.path, r.text) for r in found.collect()] == [("/yes.JS", good.replace("T", "章"))]


def test_navigation_chain(spark):
    """Contents file, chapter rows, texts, folders: the first that has anything; with the documents that go with it."""
    sitemap = spark.createDataFrame([("s", 0, -1, "A", "/a.htm")], "archive_id string, node_id int, parent_id int, name string, local string")
    synthetic = spark.createDataFrame([("s", 0, "no", "/1.txt", 0, None), ("y", 0, "one", "/1.txt", 0, None), ("y", 1, "two", "/2.txt", 1, "V"), ("y", 2, "three", "/3.txt", 1, "V"), ("y", 3, "four", "/4.txt", 2, "V")], "archive_id string, pos int, title string, local string, volume_no int, volume string")
    flat = spark.createDataFrame([("y", 0, "no", "/1.txt"), ("f", 0, "1", "/1.txt"), ("f", 1, "2", "/2.txt")], "archive_id string, pos int, name string, local string")
    docs = spark.createDataFrame([(a, i, p) for a in "syfd" for i, p in enumerate(("/x/1.htm", "/2.htm", "/x/3.htm"))], "archive_id string, pos int, path string")
    nodes, own = N.book_navigation(sitemap, synthetic, flat, docs)
    got = {}
    for r in nodes.orderBy("archive_id", "node_id").collect():
        got.setdefault((r.archive_id, r.source), []).append((r.node_id, r.parent_id, r.name, r.local))
    assert got == {
        ("s", 0): [(0, -1, "A", "/a.htm")],
        ("y", 1): [(0, -1, "one", "/1.txt"), (1, -1, "V", None), (2, 1, "two", "/2.txt"), (3, 1, "three", "/3.txt"), (4, -1, "V", None), (5, 4, "four", "/4.txt")],
        ("f", 2): [(0, -1, "1", "/1.txt"), (1, -1, "2", "/2.txt")],
        ("d", 3): [(0, -1, "x", None), (1, 0, "1", "/x/1.htm"), (2, 0, "3", "/x/3.htm"), (3, -1, "(top)", None), (4, 3, "2", "/2.htm")],
    }
    lists = {}
    for r in own.orderBy("archive_id", "pos").collect():
        lists.setdefault((r.archive_id, r.synthetic), []).append(r.path)
    pages = ["/x/1.htm", "/2.htm", "/x/3.htm"]
    assert lists == {("s", False): pages, ("d", False): pages, ("y", True): ["/1.txt", "/2.txt", "/3.txt", "/4.txt"], ("f", True): ["/1.txt", "/2.txt"]}


def test_override_decodes_everything_again(spark):
    contents = '<ul><li><object type="text/sitemap"><param name="Name" value="Жук"><param name="Local" value="a.htm"></object></ul>'
    entries = [("a", 0, "/toc.hhc", contents.encode("cp1251")), ("a", 1, "/a.htm", "Жук".encode("cp1251")), ("b", 0, "/b.htm", "é".encode())]
    df = spark.createDataFrame(entries, "archive_id string, entry_seq int, path string, content binary")
    encodings = spark.createDataFrame([("a", "koi8-r"), ("b", "gbk")], "archive_id string, encoding string")
    chosen = spark.createDataFrame([("a", "windows-1251"), ("b", None)], "archive_id string, override string")
    found = DT.redecoded(df, encodings, chosen)
    assert rows(found.select("path", "encoding", "text"), "path") == [("/a.htm", "windows-1251", "Жук"), ("/toc.hhc", "windows-1251", contents)]
    nodes = N.sitemap_nodes(found.where("path = '/toc.hhc'").select("archive_id", "path", "text"))
    assert [(r.name, r.local) for r in nodes.collect()] == [("Жук", "a.htm")]
    back = spark.createDataFrame([("b", "")], "archive_id string, override string")
    assert rows(DT.redecoded(df, encodings, back).select("path", "encoding", "text"), "path") == [("/b.htm", "utf-8", "é")]


def test_titles_from_properties(spark):
    props = [("a", 3, 0, "Жук ".encode("cp1251") + b"\0rest"), ("a", 3, 1, b"later"), ("b", 3, 0, b" \0x"), ("c", 1, 0, b"no")]
    df = spark.createDataFrame(props, "archive_id string, code int, prop_seq int, value binary")
    encodings = spark.createDataFrame([("a", "windows-1251", "lcid"), ("b", "utf-8", "default")], "archive_id string, encoding string, encoding_source string")
    with E.lenient_charsets(spark):
        titles = N.book_titles(df, encodings)
        titles.schema
    entries = spark.createDataFrame([(x, 5) for x in "abc"], "archive_id string, length long")
    none = spark.createDataFrame([], "archive_id string")
    info = N.book_info(entries, none, none.withColumn("synthetic", F.lit(True)), encodings, titles)
    assert rows(info.select("archive_id", "title", "encoding"), "archive_id") == [("a", "Жук", "windows-1251"), ("b", "b", "utf-8"), ("c", "c", None)]


def test_open_keeps_what_is_stored(spark):
    stored = [(1, "a", "/c", 42.0, 0.5, "T", 10, 20, "gbk"), (2, "a", "/d", 1.0, 0.1, "U", 11, 21, None)]
    opens = [(1, "a", 30, 1, "new", None), (1, "a", 40, 2, "newer", "big5"), (3, "b", 50, 3, "first", None)]
    at = lambda c: F.timestamp_seconds(c).alias(c)
    s = spark.createDataFrame(stored, "user_id int, archive_id string, chapter string, scroll double, progress double, title string, first_opened long, last_opened long, encoding string")
    s = s.withColumns({c: at(c) for c in ("first_opened", "last_opened")})
    o = spark.createDataFrame(opens, "user_id int, archive_id string, ts long, event_id int, title string, encoding string").withColumn("ts", at("ts"))
    got = R.open_merge(s, o).withColumns({c: F.unix_seconds(c) for c in ("first_opened", "last_opened")})
    assert rows(got, "user_id") == [(1, "a", "/c", 42.0, 0.5, "newer", 10, 40, "big5"), (2, "a", "/d", 1.0, 0.1, "U", 11, 21, None), (3, "b", None, 0.0, 0.0, "first", 50, 50, None)]


def test_numbers_and_accents_in_order(spark):
    names = ["a01", "a1", "Á1", "a9", "a10", "a" + "1" * 30 + "0", "a" + "1" * 30 + "1", "b"]
    df = spark.createDataFrame([(x,) for x in reversed(names)], "s string")
    assert [r[0] for r in df.orderBy(P.natural_key(F.col("s")), "s").collect()] == names
    coded = "&#0000000000065;&#x00000000000000041;&#99999999999999999999;&#x110000;&amp;lt;&#0;x"
    assert column(spark, X.decode_entities, [coded]) == ["AA&#99999999999999999999;&#x110000;&lt;\0x"]


def test_stale_and_progress(spark):
    rng = random.Random(1)
    events = [(i, rng.randint(0, 2), rng.choice([None, *range(-2, 9)])) for i in range(300)]
    top, want = {}, []
    for i, f, s in events:
        if s is None or s > top.get(f, 0):
            want.append(i)
            if s is not None:
                top[f] = s
    df = spark.createDataFrame(events, "event_id int, frame_id int, seq int")
    assert [r.event_id for r in R.drop_stale(df).orderBy("event_id").collect()] == want
    df = spark.createDataFrame([(1, 0.5, 3), (-1, 0.2, 3), (2, 9.0, 3), (0, 0.0, 0)], "p int, r double, n int")
    assert [r[0] for r in df.select(R.reading_progress(F.col("p"), F.col("r"), F.col("n"))).collect()] == [0.5, 0.0, 1.0, 0.0]


def test_entry_files(spark, tmp_path):
    (tmp_path / "book1" / "sub").mkdir(parents=True)
    (tmp_path / "book1" / "sub" / "a.htm").write_bytes(b"xyz")
    (tmp_path / "book2").mkdir()
    (tmp_path / "book2" / "b.txt").write_bytes(b"q")
    got = rows(S.read_entries(spark, str(tmp_path)).select("archive_id", "path", "length", "content"), "archive_id")
    assert got == [("book1", "/sub/a.htm", 3, bytearray(b"xyz")), ("book2", "/b.txt", 1, bytearray(b"q"))]


def test_data_url_and_slices(spark):
    df = spark.createDataFrame([(bytearray(b"q" * 100), 90, 10), (bytearray(b"abc"), 2, 2), (bytearray(b"abc"), 3, 0), (bytearray(b"abc"), -1, 1)], "c binary, o int, n int")
    got = [(r.x.ok, r.x.bytes, r.u) for r in df.select(S.content_slice(F.col("c"), F.col("o"), F.col("n")).alias("x"), S.data_url(F.lit("t"), F.col("c")).alias("u")).collect()]
    assert [g[0] for g in got] == [True, False, True, False] and got[0][1] == b"q" * 10 and got[2][1] == b""
    assert not re.search(r"\s", got[0][2])
