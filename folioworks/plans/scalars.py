"""Queries of the column functions: paths, text, encodings, entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encodings as enc
from ..functions import paths as P
from ..functions import text as X
from ..sources import entries as S
from .derived import BOOK_SQL, PAGES_SQL, book, pages
from .registry import query, table

MEDIA_CASE = "CASE ext WHEN 'txt' THEN 'text/plain' WHEN 'css' THEN 'text/css' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' ELSE 'application/octet-stream' END"


@query(f"WITH {BOOK_SQL} SELECT archive_id, path, length FROM b")
def scan_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book(spark, sf_dir).select("archive_id", "path", "length")


@query(f"WITH {BOOK_SQL}, x AS (SELECT *, lower(string_split(path, '.')[-1]) AS ext FROM b), y AS (SELECT archive_id, {MEDIA_CASE} AS mime, length FROM x) SELECT archive_id, mime, count(*) AS entries, CAST(sum(length) AS BIGINT) AS bytes FROM y GROUP BY ROLLUP(archive_id, mime)")
def entry_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inventory_totals(book(spark, sf_dir))


@query(f"WITH {BOOK_SQL} SELECT archive_id, path FROM b WHERE NOT starts_with(path, '/#')")
def content_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.content_entries(book(spark, sf_dir)).select("archive_id", "path")


@query(f"""WITH {BOOK_SQL}, k AS (SELECT archive_id, lower(path) AS key, arg_max(path, entry_seq) AS path FROM
 (SELECT archive_id, path, entry_seq FROM b UNION ALL SELECT archive_id, upper(path), entry_seq + 1000000000 FROM b WHERE entry_seq % 3 = 0) GROUP BY ALL),
 w AS (SELECT archive_id, replace(path, 'html', 'HTML') AS wanted FROM b UNION ALL SELECT archive_id, '/none' || entry_seq FROM b WHERE entry_seq % 4 = 0)
 SELECT w.archive_id, w.wanted, k.path AS resolved, k.path IS NOT NULL AS found FROM w LEFT JOIN k ON w.archive_id = k.archive_id AND lower(w.wanted) = k.key""")
def resolve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book(spark, sf_dir).select("archive_id", "path", "entry_seq")
    twice = b.unionByName(b.where("entry_seq % 3 = 0").select("archive_id", F.upper("path").alias("path"), (F.col("entry_seq") + 1_000_000_000).alias("entry_seq")))
    wanted = b.select("archive_id", F.replace("path", F.lit("html"), F.lit("HTML")).alias("wanted")).unionByName(
        b.where("entry_seq % 4 = 0").select("archive_id", F.concat(F.lit("/none"), F.col("entry_seq").cast("string")).alias("wanted"))
    )
    return S.resolve(wanted, twice)


@query("SELECT page_id, octet_length(encode(html)) >= page_id * 10 + 64 AS ok, CASE WHEN octet_length(encode(html)) >= page_id * 10 + 64 THEN lower(hex(array_slice(encode(html), page_id * 10 + 1, page_id * 10 + 64))) END AS part FROM pages")
def content_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = S.content_slice(F.encode("html", "UTF-8"), F.col("page_id") * 10, F.lit(64))
    return table(spark, sf_dir, "pages").select("page_id", cut.alias("c")).select("page_id", "c.ok", F.lower(F.hex("c.bytes")).alias("part"))


#: A text's bytes; every thousandth document is repeated until it is past the size up to which whole contents count.
_LARGE_SQL = """d AS (SELECT doc_id, encode(CASE WHEN doc_id % 1000 = 77 THEN repeat(text, CAST(1 + 800000 // greatest(1, octet_length(encode(text))) AS BIGINT)) ELSE text END) AS b FROM documents), s AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
 f AS (SELECT doc_id, sha256(encode('size=' || n || ';') || CASE WHEN n <= 786432 THEN b ELSE array_slice(b, 1, 262144) || array_slice(b, n // 2 + 1, n // 2 + 262144) || array_slice(b, n - 262143, n) END) AS fingerprint FROM s)"""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.greatest(F.lit(1), F.octet_length("text"))
    large = F.repeat("text", (1 + F.floor(800000 / size)).cast("int"))
    text = F.when(F.col("doc_id") % 1000 == 77, large).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.encode(text, "UTF-8").alias("content"), F.col("doc_id").alias("entry_seq"))


@query(f"WITH {_LARGE_SQL} SELECT doc_id, fingerprint FROM f")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null for a null text."""
    return _contents(spark, sf_dir).select(F.col("entry_seq").alias("doc_id"), S.fingerprint(F.col("content")).alias("fingerprint"))


@query(f"WITH {_LARGE_SQL} SELECT fingerprint, count(*) AS copies, min(doc_id) AS first_seq FROM f GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are one group, without a fingerprint."""
    return S.duplicate_groups(_contents(spark, sf_dir))


@query("""WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS v FROM customer), a AS (SELECT k // 8 AS archive_id, k % 5 AS code, min(k) AS s FROM p GROUP BY ALL),
 f AS (SELECT a.archive_id, a.code, p.v FROM a JOIN p ON a.s = p.k WHERE a.code IN (0, 1, 3, 4))
 SELECT archive_id, max(v) FILTER (code = 0) AS p0, max(v) FILTER (code = 1) AS p1, max(v) FILTER (code = 3) AS p3, max(v) FILTER (code = 4) AS p4 FROM f GROUP BY archive_id
 UNION ALL SELECT DISTINCT archive_id, NULL, NULL, NULL, NULL FROM a x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.archive_id = x.archive_id)""")
def sys_props_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("long")
    value = F.encode(F.concat("c_name", F.lit("\0rest")), "UTF-8")
    rows = c.select(F.expr("cast(c_custkey as long) div 8").alias("archive_id"), k.alias("prop_seq"), (k % 5).cast("int").alias("code"), value.alias("value"))
    wide = S.first_properties(rows)
    return wide.select("archive_id", *[F.col(str(n)).alias(f"p{n}") for n in (0, 1, 3, 4)])


@query("SELECT part.p_partkey AS p_partkey, 'data:text/plain;base64,' || to_base64(encode(repeat(p_name, 20))) AS url FROM part")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.repeat("p_name", 20), "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", S.data_url(F.lit("text/plain"), content).alias("url"))


@query("SELECT p_partkey, '/' || p_brand || '/sub dir/' || replace(p_name, ' ', '+') || '.htm' AS target FROM part")
def normalize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    target = F.concat(F.lit("sub%20dir/./x/../"), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit(".htm"))
    brand = F.replace("p_brand", F.lit("#"), F.lit("%23"))
    up = F.concat(F.lit("../"), brand, F.lit("\\"), target, F.lit("?q=1#top"))
    whole = F.concat(F.lit("mk:@MSITStore:C:\\x\\book.chm::/"), brand, F.lit("/"), target)
    href = F.when(k % 3 == 0, up).when(k % 3 == 1, whole).otherwise(F.concat(F.lit(" ../../../"), brand, F.lit("//"), target, F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", P.normalize_path(F.lit("/base/page.htm"), href).alias("target"))


@query("SELECT page_id, CASE WHEN strpos(url, '#') > 0 THEN substr(url, strpos(url, '#') + 1) ELSE '' END AS fragment FROM pages")
def link_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.fragment_of(F.col("url")).alias("fragment"))


@query(f"WITH {BOOK_SQL}, x AS (SELECT *, lower(string_split(path, '.')[-1]) AS ext FROM b) SELECT archive_id, path, {MEDIA_CASE} AS mime FROM x")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book(spark, sf_dir).select("archive_id", "path", P.mime_for(F.col("path")).alias("mime"))


@query(f"WITH {BOOK_SQL} SELECT path, lower(path) LIKE '%.htm' OR lower(path) LIKE '%.html' AS html_page, lower(path) LIKE '%.txt' AS text_page, lower(path) NOT LIKE '%.css' AS renderable FROM b")
def renderable_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return book(spark, sf_dir).select("path", P.is_html(path).alias("html_page"), P.is_text(path).alias("text_page"), P.is_renderable(path).alias("renderable"))


@query("SELECT page_id, page_id % 3 <> 2 AS external FROM pages")
def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.when(F.col("page_id") % 3 == 0, F.upper("url")).when(F.col("page_id") % 3 == 1, F.lit("\u00a0mailto:a@b")).otherwise(F.regexp_extract("url", "//[^/]+(.*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", P.is_external(href).alias("external"))


@query(r"SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY list_transform(regexp_extract_all(lower(p_type || ' ' || p_partkey), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), p_partkey) AS place FROM part")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    key = P.natural_key(F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string")))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(key, "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", place.alias("place"))


_NAMED = "replace(replace(replace(replace(p_name, ' ', ' & '), 'r', '<r>'), 'e', 'é'), 'o', chr(128512))"


@query(f"SELECT p_partkey, {_NAMED} || ' &unknown; &lt;' AS decoded FROM part")
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.split("p_name", "")
    one = lambda c: F.when(c == " ", " &AMP; ").when(c == "r", "&lt;r&gt;").when(c == "e", "&#xe9;").when(c == "o", "&#128512;").otherwise(c)
    coded = F.concat(F.array_join(F.transform(pieces, one), ""), F.lit(" &unknown; &amp;lt;"))
    return table(spark, sf_dir, "part").select("p_partkey", X.decode_entities(coded).alias("decoded"))


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query(r"""WITH x AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents), y AS (SELECT *, substr(t, 1, 48) AS h FROM x),
 z AS (SELECT *, CASE WHEN strpos(reverse(h), ' ') > 0 THEN length(h) - strpos(reverse(h), ' ') ELSE -1 END AS cut FROM y)
 SELECT doc_id, CASE WHEN length(t) <= 48 THEN t ELSE rtrim(CASE WHEN cut > 8 THEN substr(h, 1, cut + 1) ELSE h END) || '…' END AS title FROM z""")
def tidy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", r"(?U)\s+", " ")
    return table(spark, sf_dir, "documents").select("doc_id", X.tidy_title(text).alias("title"))


@query(r"SELECT doc_id, array_to_string(list_transform(string_split_regex(text, '\r?\n'), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE '<p>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' END), chr(10)) AS html FROM documents")
def plain_text_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.plain_to_html(F.col("text")).alias("html"))


def _script(text, seq):
    """A chapter written by a script; every third isn't one."""
    quoted = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    head = F.when(seq % 3 == 0, "show(").otherwise("document . write(")
    return F.concat(F.lit("var a = (1);\n"), head, F.lit('"<p>" + (x) + "'), quoted, F.lit("\");\ndocument.writeln('</p>') // \"("))


@query("SELECT doc_id, true AS is_script FROM documents WHERE text IS NOT NULL AND (doc_id % 3 <> 0 OR length(text) < 3000) UNION ALL SELECT doc_id, strpos(substr('var a = (1);' || chr(10) || 'show(\"<p>\" + (x) + \"' || replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\");' || chr(10) || 'document.writeln(''</p>'') // \"(', 1, 4096), 'document.writeln(') > 0 FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0 AND length(text) >= 3000 UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def docwrite_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", X.is_docwrite(_script(F.col("text"), F.col("doc_id"))).alias("is_script"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN '' ELSE '<p>' || text END || '</p>' AS html FROM documents")
def docwrite_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", X.docwrite_html(_script(F.col("text"), F.col("doc_id"))).alias("html"))


@query("SELECT doc_id, text FROM documents")
def unescape_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    coded = F.replace(F.replace(coded, F.lit("é"), F.lit("\\u00e9")), F.lit("t"), F.lit("\\x74"))
    return table(spark, sf_dir, "documents").select("doc_id", X.unescape_js(coded).alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'gbk' WHEN 1 THEN 'shift_jis' WHEN 2 THEN 'windows-1252' WHEN 3 THEN 'windows-874' WHEN 4 THEN 'utf-8' END AS charset FROM customer")
def charset_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("GB2312", "Shift-JIS", "latin1", "TIS-620", "UTF8", "klingon")])
    name = F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", enc.canonical_charset(name).alias("charset"))


@query("SELECT p_partkey, p_name AS name, 'v ' || p_brand AS value, p_type AS bare FROM part")
def tag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit('<param NAME="first" name = "'), "p_name", F.lit("\" value='v&#32;"), "p_brand", F.lit("' Type="), F.replace("p_type", F.lit(" "), F.lit("&#32;")), F.lit(">"))
    return table(spark, sf_dir, "part").select("p_partkey", X.attribute(tag, "name").alias("name"), X.attribute(tag, "value").alias("value"), X.attribute(tag, "type").alias("bare"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '.' || p_brand WHEN p_partkey % 4 = 1 THEN 'a.b' ELSE p_name END AS name FROM part")
def doc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    base = F.when(k % 4 == 0, F.concat(F.lit("."), "p_brand")).when(k % 4 == 1, F.lit("a.b.htm")).when(k % 4 == 2, F.concat("p_name", F.lit(".html"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", P.doc_name(F.concat(F.lit("/x.y/"), base)).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'utf-8' WHEN page_id % 4 = 1 THEN 'gbk' END AS charset FROM pages")
def meta_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 4 == 1, F.regexp_replace("html", 'charset="utf-8"', "charset = 'GB2312'")).when(F.col("page_id") % 4 == 3, F.regexp_replace("html", "charset", "x")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", enc.meta_charset(F.encode(html, "UTF-8")).alias("charset"))


#: The shape of the first 64 KiB: the first character of several bytes has to fit in, and so has the planted byte that is none.
_ASCII_HEAD = r"length(regexp_extract(text, '^[\x00-\x7F]*'))"
_CLASS = f"""CASE WHEN text IS NULL THEN NULL WHEN doc_id % 5 = 0 AND octet_length(encode(text)) < 65536 THEN 'invalid'
 WHEN {_ASCII_HEAD} < length(text) AND {_ASCII_HEAD} + octet_length(encode(substr(text, {_ASCII_HEAD} + 1, 1))) <= 65536 THEN 'multibyte' ELSE 'ascii' END"""


def _bytes(text, seq):
    content = F.encode(text, "UTF-8")
    return F.when(seq % 5 == 0, F.concat(content, F.lit(bytearray(b"\xff\xfe x")))).when(seq % 5 == 1, F.concat(content, F.lit(bytearray(b"\xe4\xb8")))).otherwise(content)


@query(f"SELECT doc_id, {_CLASS} AS class FROM documents")
def utf8_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", enc.utf8_class(_bytes(F.col("text"), F.col("doc_id"))).alias("class"))


@query(f"""WITH x AS (SELECT doc_id, {_CLASS} AS class FROM documents)
 SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'big5' WHEN doc_id % 3 = 1 OR class = 'multibyte' THEN 'utf-8' END AS encoding,
 CASE WHEN doc_id % 3 = 0 THEN 'meta' WHEN doc_id % 3 = 1 THEN 'bom' WHEN class = 'multibyte' THEN 'heuristic' END AS source FROM x""")
def sniff_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    seq = F.col("doc_id")
    head = F.when(seq % 3 == 0, F.lit(bytearray(b'<meta charset="Big5">'))).when(seq % 3 == 1, F.lit(bytearray(b"\xef\xbb\xbf"))).otherwise(F.lit(bytearray(b"")))
    return rows.select("doc_id", enc.sniff(F.concat(head, _bytes(F.col("text"), seq))).alias("s")).select("doc_id", "s.encoding", "s.source")


@query(f"""WITH x AS (SELECT doc_id, {_CLASS} AS class FROM documents)
 SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'euc-kr' WHEN class = 'multibyte' THEN 'utf-8' WHEN doc_id % 4 = 1 THEN 'gbk' ELSE 'utf-8' END AS encoding FROM x""")
def effective_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    seq = F.col("doc_id")
    override = F.when(seq % 4 == 0, "euc-kr").when(seq % 4 == 2, "")
    default = F.when(seq % 4 == 1, "gbk")
    return rows.select("doc_id", enc.effective_encoding(_bytes(F.col("text"), seq), override, default).alias("encoding"))


@query("SELECT doc_id, text FROM documents")
def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded as GB18030, UTF-16 apart, and decoded by the charset found for each row."""
    rows = table(spark, sf_dir, "documents")
    seq = F.col("doc_id")
    with enc.lenient_charsets(spark):
        coded = F.when(seq % 2 == 0, F.encode("text", "GB18030")).otherwise(F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode("text", "UTF-8")))
        name = F.when(seq % 2 == 0, "gb18030").otherwise("no-such-charset")
        out = rows.select("doc_id", enc.decode_text(coded, name).alias("text"))
        out.schema  # analysed while the settings hold
    return out


_SHAPED = r"""d AS (SELECT archive_id, html, regexp_extract(html, '(?i)charset\s*=\s*["'']?\s*(\w[\w.:-]*)', 1) AS m FROM e),
 k AS (SELECT archive_id, CASE WHEN lower(m) IN ('utf-8', 'utf8', 'unicode') THEN 'utf-8' WHEN m <> '' THEN lower(m) WHEN octet_length(encode(html)) > length(html) THEN 'utf-8' END AS encoding,
 CASE WHEN m <> '' THEN 'meta' WHEN octet_length(encode(html)) > length(html) THEN 'heuristic' END AS source,
 CASE WHEN octet_length(encode(html)) > length(html) THEN 'multibyte' ELSE 'ascii' END AS class, length(html) AS chars, length(html) - length(replace(html, chr(65533), '')) AS marks FROM d)"""


def _shared(c: str) -> str:
    return f"CASE WHEN min({c}) = max({c}) AND count({c}) = count(*) THEN min({c}) END AS {c}"


@query(f"WITH {PAGES_SQL}, {_SHAPED} SELECT archive_id, encoding, source, count(*) AS documents FROM k GROUP BY ALL UNION ALL SELECT NULL, {_shared('encoding')}, {_shared('source')}, count(*) FROM k")
def encoding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.detection import encoding_report as report

    return report(pages(spark, sf_dir), ("encoding", "source")).drop("replaced")


@query(f"WITH {PAGES_SQL}, {_SHAPED} SELECT archive_id, encoding, source, class, count(*) AS documents, sum(marks) / sum(chars) AS replaced FROM k GROUP BY ALL UNION ALL SELECT NULL, {_shared('encoding')}, {_shared('source')}, {_shared('class')}, count(*), sum(marks) / sum(chars) FROM k")
def encoding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.detection import encoding_report as report

    return report(pages(spark, sf_dir))


_ALIAS_SQL = "MAP {" + ", ".join(f"'{name}': '{charset}'" for name, charset in enc.ALIASES.items()) + "}"

#: Pages with other charsets, a mark alone, nothing that tells, or bytes that are none, by number. A declaration counts in
#: the first 2,048 bytes, the shape is that of the whole characters in the first 64 KiB, and the byte that is none ends the page.
#: Signs are counted as UTF-8's, so markup that isn't ASCII and declares another charset by its own letters is beyond this SQL.
_MIXED = r"""p AS (SELECT archive_id, entry_seq % 5 AS k, CASE WHEN entry_seq % 5 < 2 THEN html ELSE regexp_replace(html, 'charset', 'x', 'g') END AS t FROM e),
 m AS (SELECT archive_id, k, CASE WHEN k = 1 THEN regexp_replace(replace(t, '"utf-8"', 'GB2312'), '[^\x00-\x7F]', '', 'g') ELSE t END AS t FROM p),
 c AS (SELECT archive_id, k, CASE WHEN k = 2 THEN chr(65279) || t ELSE t END AS t FROM m),
 h AS (SELECT *, left(regexp_replace(regexp_replace(regexp_replace(left(t, 2048), '[\x{80}-\x{7FF}]', '||', 'g'), '[\x{800}-\x{FFFF}]', '|||', 'g'), '[\x{10000}-\x{10FFFF}]', '||||', 'g'), 2048) AS head FROM c),
 x AS (SELECT archive_id, k, """ + _ALIAS_SQL + r"""[lower(regexp_extract(head, '(?i)charset[\s\x0B]*=[\s\x0B]*["'']?[\s\x0B]*(\w[\w.:-]*)', 1))] AS meta, starts_with(t, chr(65279)) AS bom,
 length(t) - CASE WHEN starts_with(t, chr(65279)) THEN 1 ELSE 0 END + CASE WHEN k = 4 THEN 1 ELSE 0 END AS chars, length(t) - length(replace(t, chr(65533), '')) + CASE WHEN k = 4 THEN 1 ELSE 0 END AS marks,
 CASE WHEN k = 4 AND octet_length(encode(t)) < 65536 THEN 'invalid' WHEN octet_length(encode(regexp_extract(t, '^[\x00-\x7F]*[^\x00-\x7F]'))) BETWEEN 1 AND 65536 THEN 'multibyte' WHEN t IS NOT NULL THEN 'ascii' END AS class FROM h),
 y AS (SELECT archive_id, chars, marks, CASE WHEN meta IS NOT NULL THEN meta WHEN bom OR class = 'multibyte' THEN 'utf-8' END AS encoding,
 CASE WHEN meta IS NOT NULL THEN 'meta' WHEN bom THEN 'bom' WHEN class = 'multibyte' THEN 'heuristic' END AS source, class FROM x)"""


@query(f"""WITH {PAGES_SQL}, {_MIXED} SELECT archive_id, encoding, source, class, CAST(grouping_id(archive_id, encoding, source, class) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS documents, sum(marks) / nullif(sum(chars), 0) AS replaced
 FROM y GROUP BY CUBE (archive_id, encoding, source, class)""")
def encoding_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are, in another charset, with a mark only, with neither, and with a byte that is none."""
    from ..operators.detection import encoding_cube as cube

    e = pages(spark, sf_dir)
    k = F.col("entry_seq") % 5
    bare = F.replace("html", F.lit("charset"), F.lit("x"))
    other = F.regexp_replace(F.replace("html", F.lit('"utf-8"'), F.lit("GB2312")), r"[^\x00-\x7F]", "")
    coded = F.encode(F.when(k == 0, F.col("html")).when(k == 1, other).otherwise(bare), "UTF-8")
    content = F.when(k == 2, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), coded)).when(k == 4, F.concat(coded, F.lit(bytearray(b"\xff")))).otherwise(coded)
    return cube(e.select("archive_id", content.alias("content")))


_BOOKENC = f"""WITH {PAGES_SQL}, c AS (SELECT archive_id, length(archive_id) % 4 AS r, count(*) AS n FROM e GROUP BY archive_id)
 SELECT archive_id, CASE r WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gbk' WHEN 2 THEN 'shift_jis' ELSE 'utf-8' END AS encoding, CASE r WHEN 0 THEN 'meta' WHEN 3 THEN 'default' ELSE 'lcid' END AS source FROM c"""


@query(_BOOKENC)
def book_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.detection import book_encodings

    e = pages(spark, sf_dir)
    r = F.length("archive_id") % 4
    plain = F.regexp_replace(F.regexp_replace("html", "charset", "x"), r"[^\x00-\x7F]", "")
    rows = e.select("archive_id", "entry_seq", F.concat(F.lit("/p"), F.col("entry_seq").cast("string"), F.lit(".htm")).alias("path"), F.when(r == 0, F.col("content")).otherwise(F.encode(plain, "UTF-8")).alias("content"))
    archives = e.select("archive_id", F.when(r == 1, 0x0804).when(r == 2, 0x0409).otherwise(0).alias("lcid"), F.when(r == 2, F.lit(bytearray(b"\x11\x04\x00\x00"))).alias("locale_property")).distinct()
    return book_encodings(rows, archives)


_ASCII = r"regexp_replace(html, '[^\x00-\x7F]', '', 'g')"


@query(f"WITH {PAGES_SQL} SELECT archive_id, entry_seq, CASE WHEN length(archive_id) % 2 = 0 THEN 'windows-1251' ELSE 'utf-8' END AS encoding, {_ASCII} || CASE WHEN length(archive_id) % 2 = 0 THEN 'Ж' ELSE chr(65533) END AS text FROM e")
def encoding_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a byte that isn't theirs: half of the hosts have an override that fits it, the others' declaration is believed."""
    from ..operators.detection import redecoded

    e = pages(spark, sf_dir)
    content = F.concat(F.encode(F.regexp_replace("html", r"[^\x00-\x7F]", ""), "UTF-8"), F.lit(bytearray(b"\xc6")))
    entries = e.select("archive_id", "entry_seq", "path", content.alias("content"))
    hosts = e.select("archive_id").distinct()
    chosen = hosts.select("archive_id", F.when(F.length("archive_id") % 2 == 0, "windows-1251").otherwise("").alias("override"))
    return redecoded(entries, hosts.withColumn("encoding", F.lit("koi8-r")), chosen).select("archive_id", "entry_seq", "encoding", "text")
