"""Whole jobs: queries over small tables of their own, against plain statements of their rules."""

import random
import re
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from folioworks.functions import text as X
from folioworks.plans import catalog
from folioworks.plans.trees import _scripts


@pytest.fixture
def run(spark, tmp_path):
    """run(query, table, rows, schema): the query's rows over that one table."""

    def work(name, table, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]

    return work


PAGES = [
    (0, "http://a/0", '<meta charset="utf-8">é'),
    (1, "http://a/1", '<meta charset="GB2312">x'),
    (2, "http://a/2", "﻿plain"),
    (3, "http://b/3", "<p>章</p>"),
    (4, "http://b/4", "<p>only ascii</p>"),
    (5, "http://b/5", '<meta charset="klingon">�abc'),
]


def test_encoding_report(run):
    got = run("encoding_report", "pages", PAGES, "page_id long, url string, html string")
    assert sorted(got, key=str) == sorted(
        [("a", "utf-8", "meta", 1), ("a", "gbk", "meta", 1), ("a", "utf-8", "bom", 1), ("b", "utf-8", "heuristic", 2), ("b", None, None, 1), (None, None, None, 6)], key=str
    )
    same = run("encoding_report", "pages", PAGES[:1], "page_id long, url string, html string")
    assert sorted(same, key=str) == sorted([("a", "utf-8", "meta", 1), (None, "utf-8", "meta", 1)], key=str)


def test_encoding_classes(run):
    got = run("encoding_classes", "pages", PAGES, "page_id long, url string, html string")
    got = {r[:4]: (r[4], r[5]) for r in got}
    marked = len("<p>章</p>") + len(PAGES[5][2])
    assert got == {
        ("a", "utf-8", "meta", "multibyte"): (1, 0.0), ("a", "gbk", "meta", "ascii"): (1, 0.0), ("a", "utf-8", "bom", "multibyte"): (1, 0.0),
        ("b", "utf-8", "heuristic", "multibyte"): (2, pytest.approx(1 / marked)), ("b", None, None, "ascii"): (1, 0.0),
        (None, None, None, None): (6, pytest.approx(1 / (sum(len(p[2]) for p in PAGES) - 1))),
    }


def shape(content):
    """What a reader of the first 64 KiB from left to right says."""
    n, i, several = min(len(content), 65536), 0, False
    while i < n:
        b = content[i]
        size = 1 if b < 0x80 else 2 if b & 0xE0 == 0xC0 else 3 if b & 0xF0 == 0xE0 else 4 if b & 0xF8 == 0xF0 else 0
        if not size:
            return "invalid"
        if size > 1:
            if i + size > n:
                break
            if any(content[i + k] & 0xC0 != 0x80 for k in range(1, size)):
                return "invalid"
            several = True
        i += size
    return "multibyte" if several else "ascii"


LONG = [(i, text) for i, text in enumerate(t for text in ("a" * 13000 + "é", "a" * 65535 + "é", "a" * 65534 + "é", "a" * 65534 + "章章", "a" * 70000, "章" * 30000, "x") for t in [text] * 60)]


def planted(seq, text):
    return text.encode() + (b"\xff\xfe x" if seq % 5 == 0 else b"\xe4\xb8" if seq % 5 == 1 else b"")


@pytest.mark.parametrize("name", ["utf8_class", "sniff_encoding", "effective_encoding"])
def test_long_documents(run, name):
    want = {}
    for seq, text in LONG:
        content = planted(seq, text)
        if name == "utf8_class":
            want[seq] = (shape(content),)
        elif name == "sniff_encoding":
            third = shape(content) == "multibyte"
            want[seq] = [("big5", "meta"), ("utf-8", "bom"), ("utf-8", "heuristic") if third else (None, None)][seq % 3]
        else:
            default = "gbk" if seq % 4 == 1 else "utf-8"
            want[seq] = ("euc-kr" if seq % 4 == 0 else "utf-8" if shape(content) == "multibyte" else default,)
    got = run(name, "documents", LONG, "doc_id long, text string")
    assert {r[0]: r[1:] for r in got} == want


def test_flat_toc(run):
    script = "document.write('x')"
    docs = [(i, "src0", "x") for i in range(3, 17)] + [(i, "few", "x") for i in range(20, 29)] + [(i, "ten", None) for i in range(30, 40)]
    docs += [(i, "first", script if i == 98 else "x") for i in (98, 99, 100)] + [(i, "later", script if i == 202 else "x") for i in (200, 201, 202)]
    docs += [(300, "two", script), (301, "two", "x"), (310, "empty", ""), (311, "empty", script), (312, "empty", "x")]
    want = {(s, i, str(d), f"/txt/{d}.txt") for s, ids in (("src0", range(3, 17)), ("ten", range(30, 40)), ("first", (98, 99, 100))) for i, d in enumerate(ids)}
    assert set(run("flat_toc", "documents", docs, "doc_id long, source string, text string")) == want


def test_extraction_quality(run):
    texts = ["a < b & c > d", "&lt; &amp; &#65; x", "<b>bold</b>", "document.write(1 && 2)", "plain  text", "y" * 60 + " <", "", None, " & "]
    docs = list(enumerate(texts))
    want = []
    for i, t in docs:
        shown = " ".join([*(t or "").split(), *(["章"] if i % 2 == 0 else [])])
        want.append((i, len(shown), len(shown) < 50, "document.write(" in shown, i % 2 == 0))
    assert sorted(run("extraction_quality", "documents", docs, "doc_id long, text string")) == want


def test_long_fingerprints(run):
    sample = 256 * 1024
    base = "章" * 100_000 + "é" * 300_000
    rows = [(0, base), (1, base), (2, base[:90_000] + "字" + base[90_001:]), (3, base[:-1] + "è"), (4, "a" * 786_432), (5, "a" * 786_433), (6, "a" * 786_432 + "b"), (7, "short"), (8, None)]
    want = {}
    for i, text in rows:
        want[i] = None
        if text is not None:
            b = text.encode()
            n = len(b)
            parts = b if n <= 3 * sample else b[:sample] + b[n // 2 : n // 2 + sample] + b[-sample:]
            want[i] = sha256(b"size=%d;" % n + parts).hexdigest()
    assert want[0] == want[2] != want[3]
    assert dict(run("content_fingerprint", "documents", rows, "doc_id long, text string")) == want
    assert run("duplicate_content", "documents", rows, "doc_id long, text string") == [(want[0], 3, 0)]


def test_css_four_steps(run):
    got = run("css_refs", "pages", [(k, "http://h/", "<style>p{}</style>") for k in range(1, 8)], "page_id long, url string, html string")
    want = [("h", k, f"/css/s{k + n}.css" if k + n <= 7 else "/css/none.css", n) for k in range(1, 8) for n in range(1, 5) if k + n <= 8]
    assert sorted(got) == sorted(want)


def written(src):
    """What the write calls write, by counting parentheses outside literals."""
    out, at = [], 0
    while m := re.compile(r"document\s*\.\s*write(?:ln)?\s*\(").search(src, at):
        i, depth = m.end(), 1
        while i < len(src) and depth:
            if src[i] in "'\"":
                j = i + 1
                while j < len(src) and src[j] != src[i]:
                    j += 2 if src[j] == "\\" and j + 1 < len(src) else 1
                out.append(re.sub(r"(?s)\\(.)", r"\1", src[i + 1 : j]))
                i = j + 1
            else:
                depth += {"(": 1, ")": -1}.get(src[i], 0)
                i += 1
        at = i
    return "".join(out)


def test_deep_write_calls(spark):
    nested = lambda n: "document.write(" + "f(" * n + "'x'" + ")" * n + " + 'y'); other('no');"
    texts = [nested(n) for n in (0, 4, 5, 8, 40)] + ["it's " + nested(8) + " don't " + nested(1), nested(8)[:30], "document.write(", None]
    rng = random.Random(5)
    parts = ["document.write(", "document . writeln (", "(", "(", "((((((", ")", ")", "))))", "'", '"', "\\", "d", "a b", "'(q)'", '"\\")"', "\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = [r[0] for r in df.select(X.docwrite_html(F.col("s")), "i").orderBy("i").collect()]
    for text, html in zip(texts, got):
        # an escape of n or b stands for a control character, which the plain rule leaves out
        assert html == (None if text is None else written(text)) or re.search(r"\\[nbd]", text), text


def test_scripts_are_bounded(spark, run, tmp_path):
    """A hot source's chapters are dealt over scripts of at most a thousand rows; none is lost."""
    docs = [(i, "hot") for i in range(0, 7000, 2)] + [(i, "cold") for i in range(1, 9, 2)]
    got = run("pages_items", "documents", docs, "doc_id long, source string")
    assert sorted((r[1], r[0]) for r in got) == sorted(docs)
    spark.createDataFrame([(1, "http://h/a", "<a href='/b'>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r[2] for r in run("pages_refs", "documents", docs, "doc_id long, source string")) == sorted([f"/txt/f{i}.txt" for i, _ in docs] + ["/b"])
    toc = run("synthetic_toc", "documents", docs, "doc_id long, source string")
    kept = [i for i, s in docs if s == "hot" and i % 5 != 3]
    assert sorted((r[1], r[3]) for r in toc if r[0] == "hot") == [(n, f"/txt/f{i}.TXT") for n, i in enumerate(kept)]
    scripts = _scripts(spark, str(tmp_path)).select("archive_id", "path", F.size(F.split("text", "\n")).alias("n")).collect()
    assert len(scripts) == 8 and max(r.n for r in scripts) <= 1001


def test_encoding_cube_by_samples(run, tmp_path):
    """Query and SQL go by the same samples: pages longer than 64 KiB, characters that lie across its end, late declarations, marks of the page's own."""
    head = '<meta charset="utf-8">'
    bodies = ["", None, "<p>ascii", "é�章", head + "x" * 65513 + "é", head + "x" * 65514, head + "x" * 65510 + "章章", "x" * 70000 + "é", head + "é" + "x" * 70000, "é" * 1018 + "charset=utf8 x", " " * 2040 + head, "﻿" + head, "CHARSET = 'klingon'é", "<p CHARSET\x0b= Unicode>"]
    pages = [(5 * i + k, f"http://h{i}/{k}", html) for i, html in enumerate(bodies) for k in range(5)]
    got = run("encoding_cube", "pages", pages, "page_id long, url string, html string")
    want = duckdb.sql(f"WITH pages AS (FROM '{tmp_path}/pages.parquet/*.parquet') {catalog.ORACLE_SQL['encoding_cube'].replace('WITH ', ', ', 1)}").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    long = {r[2:4] for r in got if r[0] == "h7" and r[4] == 0}
    assert ("heuristic", "invalid") not in long and (None, "invalid") not in long and (None, "ascii") in long
