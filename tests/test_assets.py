"""Files that pages show: found, missing, outside, and in odd markup."""

from folioworks.operators.content import asset_references, put_assets

PAGES = "archive_id string, path string, html string"


ASSETS = "archive_id string, path string, url string, entry_seq long"


def test_put_assets(spark):
    there = [("/D/I.GIF", "old"), ("/d/i.gif", "u:1"), ("/j.png", "u:2"), ("/d/null.gif", None)]
    cases = {
        "<img src=i.gif>": '<img src="u:1" loading="lazy">',
        "<IMG ALT='' SRC='../J.png?x#y' loading=eager/>": '<IMG ALT=\'\' src="u:2" loading="lazy">',
        "<img src=no.gif>": '<img alt="[missing: no.gif]" loading="lazy">',
        "<img src=null.gif alt=''>": '<img alt="[missing: null.gif]" loading="lazy">',
        "<img src='a&quot;b.gif'>": '<img alt="[missing: a&quot;b.gif]" loading="lazy">',
        "<img alt=kept src=no.gif>": '<img alt=kept loading="lazy">',
        "<img src=>": "<img src=>",
        "<img>": "<img>",
        "<img src='data:x'><img src=blob:x><img src=HTTPS://h/i.gif>": "<img src='data:x'><img src=blob:x><img src=HTTPS://h/i.gif>",
        "<input src=i.gif><input type=Image src=i.gif>": '<input src=i.gif><input type=Image src="u:1" loading="lazy">',
        "<td background=i.gif>": "<td style=\"background-image:url('u:1')\">",
        "<td background=no.gif style='x:y'>": "<td style='x:y'>",
        "<td background='http://h/i.gif'>": "<td background='http://h/i.gif'>",
        "<b style='x:url(i.gif) url(no.gif)'>": '<b style="x:url(&quot;u:1&quot;) url(no.gif)">',
        "<td background=/j.png style='x:url(i.gif)'>": "<td style=\"x:url(&quot;u:1&quot;);background-image:url('u:2')\">",
        "<p title='<img src=i.gif>'><!-- <img src=i.gif> --><script>'<img src=i.gif>'</script>": "<p title='<img src=i.gif>'><!-- <img src=i.gif> --><script>'<img src=i.gif>'</script>",
        "": "",
    }
    cases[None] = None
    pages = spark.createDataFrame([("a", f"/d/p{i}.htm", html) for i, html in enumerate(cases)], PAGES)
    known = spark.createDataFrame([("a", p, u, i) for i, (p, u) in enumerate(there)], ASSETS)
    got = {r.path: r.html for r in put_assets(pages, known).collect()}
    assert len(got) == len(cases)
    for i, (html, want) in enumerate(cases.items()):
        assert got[f"/d/p{i}.htm"] == want, html


def test_asset_references(spark):
    html = "<img src=a.gif><img src=a.gif><td background='/b.gif' style=\"x:URL('c.gif')\"><img src=http://h/d.gif><a href=e.gif>"
    pages = spark.createDataFrame([("a", "/d/p.htm", html), ("a", "/q.htm", None), ("b", "/d/p.htm", "<img src=../../a.gif>")], PAGES)
    got = sorted(tuple(r) for r in asset_references(pages).collect())
    assert got == [
        ("a", "/d/p.htm", "/b.gif", "/b.gif"), ("a", "/d/p.htm", "a.gif", "/d/a.gif"), ("a", "/d/p.htm", "c.gif", "/d/c.gif"), ("b", "/d/p.htm", "../../a.gif", "/a.gif"),
    ]


def test_no_pages(spark):
    assert put_assets(spark.createDataFrame([], PAGES), spark.createDataFrame([], ASSETS)).count() == 0
