"""Queries of navigation: contents, indexes, reading orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import navigation as N
from ..sources.entries import content_entries as only_content
from .derived import BOOK_SQL, PAGES_SQL, SPINE_SQL, TOC_SQL, book, docs, pages, sitemap_docs
from .registry import query, table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.sitemap_nodes(sitemap_docs(spark, sf_dir))


def _toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that the reading order, the labels and the reports share."""
    return N.toc_nodes(_nodes(spark, sf_dir)).withColumn("pos", F.col("node_id"))


def _spine(spark: SparkSession, sf_dir: str, toc: DataFrame) -> DataFrame:
    return N.reading_order(toc, docs(spark, sf_dir))


@query(f"WITH {TOC_SQL} SELECT archive_id, node_id, parent_id, depth + 1 AS depth, name, substr(local, 2) AS local FROM nodes")
def sitemap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("archive_id", "node_id", "parent_id", "depth", "name", "local")


@query(f"WITH {TOC_SQL} SELECT archive_id, node_id, parent_id, depth + 1 AS depth, name, local FROM nodes")
def toc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.toc_nodes(_nodes(spark, sf_dir)).drop("trail")


_KEY = r"list_transform(regexp_extract_all(lower(label), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END)"


@query(f"""WITH {TOC_SQL}, i AS (SELECT a.archive_id, a.node_id, p.name || ', ' || a.name AS label, a.local FROM nodes a JOIN nodes p ON a.archive_id = p.archive_id AND a.parent_id = p.node_id WHERE a.local IS NOT NULL)
 SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY {_KEY}, label, node_id) - 1 AS pos, label, local AS target FROM i""")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.index_entries(_nodes(spark, sf_dir)).select("archive_id", "pos", "label", F.array_join("targets", "|").alias("target"))


@query(f"""WITH {PAGES_SQL}, f AS (SELECT archive_id, entry_seq, '/n' || entry_seq || CASE WHEN entry_seq % 4 = 0 THEN '.HHC' WHEN entry_seq % 4 = 1 THEN '.hhk' ELSE '.htm' END AS path FROM e),
 p AS (SELECT archive_id, max(entry_seq) FILTER (entry_seq % 4 = 2) AS s FROM e GROUP BY archive_id)
 SELECT f.archive_id, CASE WHEN p.s % 3 = 0 THEN '/n' || p.s || '.htm' ELSE NULL END AS stated_path,
 coalesce(CASE WHEN any_value(p.s) % 3 = 0 THEN '/n' || any_value(p.s) || '.htm' END, arg_min(path, entry_seq) FILTER (path LIKE '%.HHC')) AS toc_path,
 arg_min(path, entry_seq) FILTER (path LIKE '%.hhk') AS index_path FROM f JOIN p ON f.archive_id = p.archive_id GROUP BY f.archive_id, p.s""")
def find_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("entry_seq")
    ext = F.when(seq % 4 == 0, ".HHC").when(seq % 4 == 1, ".hhk").otherwise(".htm")
    files = pages(spark, sf_dir).select("archive_id", "entry_seq", F.concat(F.lit("/n"), seq.cast("string"), ext).alias("path"))
    stated = files.groupBy("archive_id").agg(F.max(F.when(seq % 4 == 2, seq)).alias("s"))
    name = F.concat(F.lit("/n"), F.col("s").cast("string"), F.lit(".htm"))
    stated = stated.select("archive_id", F.when(F.col("s") % 3 == 0, F.upper(name)).otherwise(F.lit("/gone.hhc")).alias("toc_path"), F.lit(None).cast("string").alias("index_path"), F.when(F.col("s") % 3 == 0, name).alias("stated_path"))
    found = N.find_sitemaps(files, stated.drop("stated_path"))
    return found.join(stated.select("archive_id", "stated_path"), "archive_id").select("archive_id", "stated_path", "toc_path", "index_path")


_ITEMS = """i AS (SELECT source AS archive_id, doc_id, doc_id AS idx, 'f' || doc_id AS file, 'Ch. ' || doc_id AS title,
 CASE WHEN doc_id % 50 < 2 THEN 'V"' || (doc_id // 50) END AS volume FROM documents)"""


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of each source with the rows of its chapters, a thousand numbers to a script, in shuffled order."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    volume = F.when(F.col("doc_id") % 50 < 2, F.concat(F.lit(",'V\\\""), F.expr("cast(doc_id div 50 as string)"), F.lit("'"))).when(F.col("doc_id") % 50 == 2, F.lit(",' <img src=\"x\">'")).otherwise(F.lit(""))
    row = F.concat(F.lit("pages["), n, F.lit("] = [ 'f"), n, F.lit("',\"<b>Ch.</b>&#32;"), n, F.lit("\", '12'"), volume, F.lit("];\n"))
    rows = d.groupBy(F.col("source").alias("archive_id"), F.expr("doc_id div 1000").alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("doc_id")).alias("o"), row.alias("row")))), lambda x: x["row"]), "").alias("text"))
    return rows.select("archive_id", F.concat(F.lit("/js/pages"), F.col("block").cast("string"), F.lit(".js")).alias("path"), "text")


@query(f"WITH {_ITEMS} SELECT archive_id, idx, file, title, volume FROM i")
def pages_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.pages_items(_scripts(spark, sf_dir)).select("archive_id", F.col("idx").cast("long").alias("idx"), "file", "title", "volume")


@query(f"""WITH {_ITEMS}, k AS (SELECT *, '/txt/f' || doc_id || '.TXT' AS local FROM i WHERE doc_id % 5 <> 3), g AS (SELECT *, count(*) OVER (PARTITION BY archive_id) AS n FROM k),
 o AS (SELECT archive_id, idx, title, local, volume, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, CAST(count(volume) OVER (PARTITION BY archive_id ORDER BY idx) AS INTEGER) AS volume_no FROM g WHERE n >= 3 WINDOW w AS (PARTITION BY archive_id ORDER BY idx))
 SELECT archive_id, pos, title, local, volume_no, CASE WHEN volume_no > 0 THEN first_value(volume) OVER (PARTITION BY archive_id, volume_no ORDER BY pos) END AS volume FROM o""")
def synthetic_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 5 <> 3")
    entries = d.select(F.col("source").alias("archive_id"), F.col("doc_id").alias("entry_seq"), F.concat(F.lit("/txt/f"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("path"), F.lit(1).alias("length"))
    return N.synthetic_toc(N.pages_items(_scripts(spark, sf_dir)), entries)


@query(r"""WITH x AS (SELECT source AS archive_id, doc_id, '/txt/' || doc_id || '.txt' AS local, coalesce(regexp_matches(substr(text, 1, 4096), 'document\s*\.\s*write(ln)?\s*\('), false) AS s FROM documents WHERE text IS NULL OR text <> ''),
 y AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY archive_id) AS n, first_value(s) OVER w AS f FROM x WINDOW w AS (PARTITION BY archive_id ORDER BY doc_id))
 SELECT archive_id, pos, CAST(doc_id AS VARCHAR) AS name, local FROM y WHERE n >= 10 OR (n >= 3 AND f)""")
def flat_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return N.flat_toc(d.select(F.col("source").alias("archive_id"), F.concat(F.lit("/txt/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text"))


@query(rf"""WITH {BOOK_SQL}, h AS (SELECT archive_id, path FROM b WHERE NOT starts_with(path, '/#') AND (path LIKE '%.htm' OR path LIKE '%.html')), l AS (SELECT *, path AS label FROM h)
 SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY {_KEY}, path) - 1 AS pos, path FROM l""")
def doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.doc_paths(book(spark, sf_dir))


@query(rf"""WITH {BOOK_SQL}, h AS (SELECT archive_id, path FROM b WHERE NOT starts_with(path, '/#') AND (path LIKE '%.htm' OR path LIKE '%.html')), l AS (SELECT *, path AS label FROM h),
 d AS (SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY {_KEY}, path) - 1 AS pos, path, regexp_extract(path, '^(/[A-Za-z]+)/', 1) AS dir FROM l),
 g AS (SELECT archive_id, dir, min(pos) AS f FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY f) - 1 AS no, count(*) OVER (PARTITION BY archive_id) AS n FROM g)
 SELECT d.archive_id, CASE WHEN n > 1 THEN no END AS group_no, CASE WHEN n > 1 THEN substr(d.dir, 2) END AS folder, pos, regexp_extract(path, '/([^/]+)\.[^.]+$', 1) AS name, path AS local
 FROM d JOIN r ON d.archive_id = r.archive_id AND d.dir = r.dir""")
def fallback_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fallback_toc(N.doc_paths(only_content(book(spark, sf_dir))))


#: Hosts of four kinds, by the length of their names: with a contents file; with texts and scripts of chapter rows; with
#: texts alone; with pages alone. What their kind doesn't give (too few texts, say) comes from the folders of their pages.
_NAV_SQL = TOC_SQL + """, h AS (SELECT archive_id, entry_seq, length(archive_id) % 4 AS kind, row_number() OVER (PARTITION BY archive_id ORDER BY entry_seq) - 1 AS i, count(*) OVER (PARTITION BY archive_id) AS rows FROM e),
 dc AS (SELECT archive_id, CASE WHEN entry_seq % 2 = 0 THEN 'html' ELSE 'Text' END AS folder, entry_seq, row_number() OVER (PARTITION BY archive_id ORDER BY entry_seq % 2, entry_seq) - 1 AS pos FROM e),
 dp AS (SELECT *, '/' || folder || '/p' || entry_seq || '.htm' AS path, min(pos) OVER (PARTITION BY archive_id, folder) AS head, count(DISTINCT folder) OVER (PARTITION BY archive_id) AS folders FROM dc),
 gr AS (SELECT *, CASE WHEN head = 0 THEN 0 ELSE 1 END AS g FROM dp),
 n0 AS (SELECT archive_id, node_id, parent_id, name, local FROM nodes WHERE length(archive_id) % 4 = 0),
 tx AS (SELECT *, count(*) OVER (PARTITION BY archive_id) AS texts FROM h WHERE kind = 2 OR (kind = 1 AND entry_seq % 7 <> 3)),
 s1 AS (SELECT *, CASE WHEN i % 5 = 2 THEN 'V' || i END AS volume FROM tx WHERE kind = 1 AND texts >= 3 AND rows >= 3),
 s2 AS (SELECT *, row_number() OVER w - 1 AS pos, count(volume) OVER w AS vn FROM s1 WINDOW w AS (PARTITION BY archive_id ORDER BY i)),
 s3 AS (SELECT *, min(pos) OVER (PARTITION BY archive_id, vn) + vn - 1 AS head FROM s2),
 n1 AS (SELECT archive_id, pos + vn AS node_id, CASE WHEN vn > 0 THEN head ELSE -1 END AS parent_id, 'Kap é ' || entry_seq AS name, '/txt/p' || entry_seq || '.TXT' AS local FROM s3
 UNION ALL SELECT archive_id, head, -1, max(volume), NULL FROM s3 WHERE vn > 0 GROUP BY archive_id, head),
 f1 AS (SELECT *, row_number() OVER w - 1 AS pos, first_value(entry_seq) OVER w AS first_seq FROM tx WINDOW w AS (PARTITION BY archive_id ORDER BY entry_seq)),
 n2 AS (SELECT archive_id, pos AS node_id, -1 AS parent_id, 'p' || entry_seq AS name, '/txt/p' || entry_seq || '.TXT' AS local FROM f1 WHERE texts >= 10 OR (texts >= 3 AND first_seq % 2 = 0)),
 n3 AS (SELECT archive_id, CASE WHEN folders = 1 THEN pos ELSE pos + g + 1 END AS node_id, CASE WHEN folders = 1 THEN -1 ELSE head + g END AS parent_id, 'p' || entry_seq AS name, path AS local FROM gr
 UNION ALL SELECT archive_id, head + g, -1, max(folder), NULL FROM gr WHERE folders > 1 GROUP BY archive_id, head, g),
 every AS (SELECT 0 AS source, * FROM n0 UNION ALL SELECT 1, * FROM n1 UNION ALL SELECT 2, * FROM n2 UNION ALL SELECT 3, * FROM n3),
 best AS (SELECT archive_id, min(source) AS source FROM every GROUP BY archive_id), nav AS (SELECT every.* FROM every JOIN best USING (archive_id, source))"""


def _navigation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    from ..functions.encodings import lenient_charsets

    e = pages(spark, sf_dir)
    seq, kind = F.col("entry_seq"), F.length("archive_id") % 4
    n = seq.cast("string")
    docs_ = N.doc_paths(e.select("archive_id", F.concat(F.when(seq % 2 == 0, "/html/p").otherwise("/Text/p"), n, F.lit(".htm")).alias("path")))
    sitemap = N.toc_nodes(N.sitemap_nodes(sitemap_docs(spark, sf_dir).where(kind == 0)))
    held = e.where((kind == 2) | ((kind == 1) & (seq % 7 != 3)))
    texts = held.select("archive_id", "entry_seq", F.concat(F.lit("/txt/p"), n, F.lit(".TXT")).alias("path"), F.when(seq % 2 == 0, "document.write('x')").otherwise("plain").alias("text"), F.lit(1).alias("length"))
    i = F.col("i").cast("string")
    numbered = e.where(kind == 1).withColumn("i", F.row_number().over(Window.partitionBy("archive_id").orderBy("entry_seq")) - 1)
    volume = F.when(F.col("i") % 5 == 2, F.concat(F.lit(",'V"), i, F.lit("'"))).otherwise(F.lit(""))
    row = F.concat(F.lit("pages["), i, F.lit("]=['p"), n, F.lit("','<b>Kap é</b> "), n, F.lit("','1'"), volume, F.lit("];"))
    script = numbered.groupBy("archive_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("i")).alias("o"), row.alias("row")))), lambda x: x["row"]), "\n").alias("text"))
    files = F.array(*[F.struct(F.lit(k).alias("entry_seq"), F.lit(path).alias("path"), text.alias("text")) for k, path, text in (
        (1, "/js/0.js", F.lit("pages[1]=['p1','no'];pages[2]=['p2','no'];pages[3]=['p3','no'];")), (2, "/js/a.JS", F.col("text")),
        (3, "/js/b.js", F.lit("pages[0]=['p1','no'];pages[1]=['p2','no'];pages[2]=['p3','no'];")),
    )])
    scripts = script.select("archive_id", F.explode(files).alias("f")).where((F.col("f.entry_seq") < 3) | (F.size(F.split("text", "\n")) >= 3))
    scripts = scripts.select("archive_id", "f.entry_seq", "f.path", F.encode("f.text", "ISO-8859-1").alias("content"), F.lit("windows-1252").alias("encoding"))
    with lenient_charsets(spark):
        chosen = N.chapter_scripts(scripts)
        chosen.schema  # analysed while the settings hold
    synthetic = N.synthetic_toc(N.pages_items(chosen), texts)
    return N.book_navigation(sitemap, synthetic, N.flat_toc(texts), docs_)


@query(f"WITH {_NAV_SQL} SELECT archive_id, source, node_id, parent_id, name, local FROM nav")
def nav_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of hosts from their contents file, else their chapter rows, else their texts, else their folders."""
    return _navigation(spark, sf_dir)[0].select("archive_id", "source", "node_id", "parent_id", "name", "local")


@query(f"""WITH {_NAV_SQL} SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY node_id) - 1 AS pos, local AS path, true AS synthetic FROM nav WHERE source IN (1, 2) AND local IS NOT NULL
 UNION ALL SELECT dp.archive_id, pos, path, false FROM dp JOIN best USING (archive_id) WHERE source IN (0, 3)""")
def nav_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that go with these contents."""
    return _navigation(spark, sf_dir)[1]


@query(f"WITH {SPINE_SQL} SELECT archive_id, position, path FROM spine")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spine(spark, sf_dir, _toc(spark, sf_dir))


@query(f"WITH {SPINE_SQL} SELECT archive_id, position, path, CASE WHEN CAST(regexp_extract(path, '([0-9]+)', 1) AS INTEGER) % 4 = 3 THEN substr(path, 7) ELSE regexp_extract(path, '(p[0-9]+)', 1) END AS label FROM spine")
def toc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = _toc(spark, sf_dir)
    return N.toc_labels(_spine(spark, sf_dir, toc), toc)


@query(f"""WITH {SPINE_SQL}, h AS (SELECT archive_id, bool_or(entry_seq % 3 = 0) AS d, bool_or(entry_seq % 3 = 1) AS i FROM e GROUP BY archive_id),
 f AS (SELECT archive_id, CASE WHEN i THEN '/INDEX.htm' WHEN d THEN '/default.htm' END AS path, CASE WHEN i THEN 'Index' END AS entry_name FROM h)
 SELECT archive_id, 0 AS position, path, entry_name FROM f WHERE path IS NOT NULL
 UNION ALL SELECT s.archive_id, s.position + CASE WHEN f.path IS NULL THEN 0 ELSE 1 END, s.path, NULL FROM spine s JOIN f ON s.archive_id = f.archive_id""")
def entry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pages(spark, sf_dir)
    extra = e.where("entry_seq % 3 < 2").select("archive_id", "entry_seq", F.when(F.col("entry_seq") % 3 == 0, "/default.htm").otherwise("/INDEX.htm").alias("path"))
    return N.promote_entry(_spine(spark, sf_dir, _toc(spark, sf_dir)), extra)


@query(f"WITH {TOC_SQL} SELECT archive_id, node_id, name FROM nodes n WHERE contains(name, '7') OR EXISTS (SELECT 1 FROM nodes c WHERE c.archive_id = n.archive_id AND c.parent_id = n.node_id AND contains(c.name, '7'))")
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.filter_toc(_nodes(spark, sf_dir), "7").select("archive_id", "node_id", "name")


@query(f"WITH {TOC_SQL} SELECT archive_id, node_id, node_id AS ancestor_id, 0 AS steps FROM nodes UNION ALL SELECT archive_id, node_id, parent_id, 1 FROM nodes WHERE parent_id >= 0")
def toc_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.ancestors(_nodes(spark, sf_dir))


@query(f"""WITH {TOC_SQL} SELECT e.archive_id, '/HTML/p' || e.entry_seq || '.htm' AS path, n.node_id, 'Vol ' || (n.entry_seq % 3) || ' > ' || n.name AS trail FROM e LEFT JOIN nodes n ON e.archive_id = n.archive_id AND e.entry_seq = n.entry_seq""")
def toc_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names from the root to the first entry that names each document, without regard to case."""
    targets = docs(spark, sf_dir).select("archive_id", F.replace("path", F.lit("/html/"), F.lit("/HTML/")).alias("path"))
    return N.ancestor_trail(_toc(spark, sf_dir), targets).select("archive_id", "path", "node_id", F.array_join("trail", " > ").alias("trail"))


@query(f"""WITH {TOC_SQL}, i AS (SELECT a.archive_id, a.node_id, p.name || ', ' || a.name AS label, a.local FROM nodes a JOIN nodes p ON a.archive_id = p.archive_id AND a.parent_id = p.node_id WHERE a.local IS NOT NULL),
 k AS (SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY {_KEY}, label, node_id) - 1 AS pos, label FROM i) SELECT archive_id, pos, label FROM k WHERE contains(lower(label), 'vol 1') ORDER BY archive_id, pos LIMIT 40""")
def index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.filter_index(N.index_entries(_nodes(spark, sf_dir)), "VOL 1", 40).select("archive_id", "pos", "label")


@query(f"""WITH {SPINE_SQL}, l AS (SELECT archive_id, position, path, regexp_extract(path, '(p[0-9]+)', 1) || CASE WHEN CAST(regexp_extract(path, '([0-9]+)', 1) AS INTEGER) % 4 = 3 THEN '.htm' ELSE '' END AS label FROM spine)
 SELECT archive_id, position, path, lag(path) OVER w AS prev_path, lag(label) OVER w AS prev_label, lead(path) OVER w AS next_path, lead(label) OVER w AS next_label,
 CAST(floor((position + 1) * 100 / count(*) OVER (PARTITION BY archive_id) + 0.5) AS INTEGER) AS percent, count(*) OVER (PARTITION BY archive_id) AS chapters FROM l WINDOW w AS (PARTITION BY archive_id ORDER BY position)""")
def spine_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = _toc(spark, sf_dir)
    return N.spine_nav(N.toc_labels(_spine(spark, sf_dir, toc), toc))


@query(f"""WITH {SPINE_SQL}, s AS (SELECT archive_id, count(*) AS entry_count, CAST(sum(length) AS BIGINT) AS file_size FROM b GROUP BY archive_id),
 c AS (SELECT archive_id, count(*) AS toc_count FROM nodes GROUP BY archive_id), d AS (SELECT archive_id, count(*) AS doc_count FROM docs GROUP BY archive_id)
 SELECT s.archive_id, CASE WHEN length(s.archive_id) % 2 = 0 THEN 'Sité ' || s.archive_id ELSE regexp_replace(s.archive_id, '\\.[^.]+$', '') END AS title, 'utf-8' AS encoding, 'meta' AS encoding_source,
 entry_count, file_size, coalesce(toc_count, 0) AS toc_count, doc_count, false AS synthetic FROM s LEFT JOIN c ON s.archive_id = c.archive_id LEFT JOIN d ON s.archive_id = d.archive_id""")
def book_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.encodings import lenient_charsets
    from ..operators.detection import book_encodings

    e = pages(spark, sf_dir)
    as_html = e.select("archive_id", "entry_seq", F.concat(F.lit("/p"), F.col("entry_seq").cast("string"), F.lit(".htm")).alias("path"), "content")
    archives = e.select("archive_id", F.lit(0).alias("lcid"), F.lit(None).cast("binary").alias("locale_property")).distinct()
    found = book_encodings(as_html, archives).withColumnRenamed("source", "encoding_source")
    named = F.when(F.length("archive_id") % 2 == 0, F.concat(F.lit(" Sité "), "archive_id")).otherwise(" ")
    first = archives.select("archive_id", F.lit(3).alias("code"), F.lit(0).alias("prop_seq"), F.encode(F.concat(named, F.lit("\0rest")), "UTF-8").alias("value"))
    with lenient_charsets(spark):
        titles = N.book_titles(first.unionByName(first.withColumns({"prop_seq": F.lit(1), "value": F.encode(F.lit("later"), "UTF-8")})), found)
        titles.schema  # analysed while the settings hold
    return N.book_info(book(spark, sf_dir), _toc(spark, sf_dir), docs(spark, sf_dir).withColumn("synthetic", F.lit(False)), found, titles)


@query(f"""WITH {SPINE_SQL} SELECT archive_id, count(*) FILTER (entry_seq % 4 <> 3) AS toc_targets, count(*) FILTER (entry_seq % 5 <> 4) AS documents,
 count(*) FILTER (entry_seq % 4 = 3 AND entry_seq % 5 <> 4) AS unlisted, count(*) FILTER (entry_seq % 4 <> 3 AND entry_seq % 5 = 4) AS dangling, count(DISTINCT entry_seq % 3) FILTER (entry_seq % 4 <> 3) AS volumes FROM e
 WHERE entry_seq % 4 <> 3 OR entry_seq % 5 <> 4 GROUP BY archive_id""")
def nav_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nav_coverage(_toc(spark, sf_dir), docs(spark, sf_dir).where("pos % 5 <> 4"))
