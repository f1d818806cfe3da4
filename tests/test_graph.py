"""The united graph and what is reached in it, against a plain search."""

import random
from collections import deque

from folioworks.operators import graph as G


def test_edges_of_all_kinds(spark):
    html = """<a href="B.htm#x">b</a><iframe src=c.htm></iframe><frame src="d/D.htm"><img src="i.gif"><link rel=stylesheet href=s.css><script src="x.js"></script>
    <script>location.href = 'e.htm'; parent.location='no.htm'; location = 'http://h/';</script><script>top.location='/F.htm'</script><a href="http://h/">o</a><a href="#top">f</a>"""
    pages = spark.createDataFrame([("a", "/P/a.htm", html), ("b", "/a.htm", "<p>none</p>")], "archive_id string, path string, html string")
    sheets = spark.createDataFrame([("a", "/p/s.css", "@import 't.css'; p{background:url(j.gif)}")], "archive_id string, path string, css string")
    scripts = spark.createDataFrame([("a", "/p/x.js", "location.replace('g.htm')")], "archive_id string, path string, text string")
    got = {tuple(r) for r in G.link_edges(pages, sheets, scripts).select("archive_id", "from_key", "to_key", "kind").collect()}
    page = "/p/a.htm"
    assert got == {("a", page, f"/p/{x}", kind) for x, kind in [("b.htm", "link"), ("c.htm", "frame"), ("d/d.htm", "frame"), ("i.gif", "asset"), ("s.css", "style"), ("x.js", "script"), ("e.htm", "navigation")]} | {
        ("a", page, "/f.htm", "navigation"), ("a", "/p/s.css", "/p/t.css", "import"), ("a", "/p/s.css", "/p/j.gif", "asset"), ("a", "/p/x.js", "/p/g.htm", "navigation"),
    }


def test_reach(spark):
    rng = random.Random(4)
    nodes = [(a, f"/N{i}.htm") for a in "ab" for i in range(60)]
    edges = [(a, f"/n{rng.randint(0, 59)}.htm", f"/n{rng.randint(0, 64)}.htm") for a in "ab" for _ in range(70)] + [("a", "/n1.htm", "/n1.htm")]
    starts = [("a", "/n0.htm"), ("a", "/N1.htm"), ("b", "/n5.htm"), ("b", "/none.htm"), ("c", "/n0.htm")]
    want = {}
    there = {(a, p.lower()) for a, p in nodes}
    todo = deque(((a, p.lower()), 0) for a, p in starts)
    while todo:
        node, steps = todo.popleft()
        if node in there and node not in want:
            want[node] = steps
            todo.extend(((a, y), steps + 1) for a, x, y in edges if (a, x) == node)
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = G.reachable(frame(nodes, "archive_id string, path string"), frame(edges, "archive_id string, from_key string, to_key string"), frame(starts, "archive_id string, path string"))
    assert {(r.archive_id, r.path_key): r.steps for r in got.collect()} == {n: want.get(n) for n in there}
    nothing = G.reachable(frame(nodes, "archive_id string, path string"), frame(edges, "archive_id string, from_key string, to_key string"), frame([("z", "/q")], "archive_id string, path string"))
    assert nothing.where("steps is null").count() == len(nodes)


def test_one_host_is_dealt_out(spark, tmp_path):
    """Markup is read by several tasks where all pages are of one host, not by the one that numbers them."""
    from folioworks.plans.links import _tree

    rows = [(i, f"http://h/{i}", f"<p>{i}") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = _tree(spark, str(tmp_path))[0]
        assert sum(1 for part in made.rdd.glom().collect() if part) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r.path, r.html[:6]) for r in made.collect()) == sorted((f"/p/{i}.htm", f"<p>{i}<a "[:6]) for i in range(200))
