"""Archive tables derived from the given tables, and the same derivations as SQL (the *_SQL common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.entries import site_entries
from .registry import table

#: Pages as entries: host, page number, path of the URL, markup.
PAGES_SQL = """e AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS archive_id, page_id AS entry_seq,
 regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, html FROM pages)"""

#: Pages as files of a book: a folder by language part of the path, an extension by number.
BOOK_SQL = PAGES_SQL + """, b AS (SELECT archive_id, entry_seq,
 CASE WHEN entry_seq % 7 = 6 THEN '/#SYS/' WHEN entry_seq % 2 = 0 THEN '/html/' ELSE '/Text/' END || 'p' || entry_seq
 || CASE WHEN entry_seq % 5 = 0 THEN '.TXT' WHEN entry_seq % 5 = 1 THEN '.css' WHEN entry_seq % 5 = 2 THEN '.html' ELSE '.htm' END AS path,
 html, octet_length(encode(html)) AS length FROM e)"""

#: Contents of an archive: a volume for each remainder of the page number by 3, pages in order below it; every fourth page is left out.
TOC_SQL = BOOK_SQL + """, v AS (SELECT archive_id, entry_seq, 'Vol ' || (entry_seq % 3) AS volume, 'p' || entry_seq AS name,
 '/html/p' || entry_seq || '.htm' AS local FROM e WHERE entry_seq % 4 <> 3),
 t AS (SELECT archive_id, volume, entry_seq, name, local, 1 AS lvl FROM v
 UNION ALL SELECT archive_id, volume, -1, volume, NULL, 0 FROM v GROUP BY archive_id, volume),
 n AS (SELECT archive_id, CAST(row_number() OVER (PARTITION BY archive_id ORDER BY volume, entry_seq) - 1 AS INTEGER) AS node_id,
 volume, lvl, name, local, entry_seq FROM t),
 nodes AS (SELECT a.archive_id, a.node_id, CASE WHEN a.lvl = 0 THEN -1 ELSE p.node_id END AS parent_id, a.lvl AS depth, a.name, a.local, a.entry_seq
 FROM n a LEFT JOIN n p ON a.lvl = 1 AND p.lvl = 0 AND a.archive_id = p.archive_id AND a.volume = p.volume)"""

#: All documents of an archive, also those that its contents leave out.
SPINE_SQL = TOC_SQL + """, docs AS (SELECT archive_id, entry_seq, '/html/p' || entry_seq || '.htm' AS path FROM e),
 s0 AS (SELECT archive_id, 0 AS part, node_id AS o, local AS path FROM nodes WHERE local IS NOT NULL
 UNION ALL SELECT d.archive_id, 1, entry_seq, path FROM docs d WHERE entry_seq % 4 = 3),
 spine AS (SELECT archive_id, CAST(row_number() OVER (PARTITION BY archive_id ORDER BY part, o) - 1 AS INTEGER) AS position, path FROM s0)"""

#: Events as messages of reading frames.
EVENTS_SQL = """ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, user_id % 10 AS frame_id, event_type,
 CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events),
 m AS (SELECT *, CASE event_type WHEN 'view' THEN 'navigate' WHEN 'click' THEN 'request' WHEN 'error' THEN NULL ELSE event_type END AS type,
 '/c/' || k || '.htm' AS path, CASE WHEN event_type = 'signup' THEN NULL ELSE k END AS seq, 'a' || (k % 5) AS archive_id,
 CASE WHEN k % 4 = 0 THEN 'other' ELSE 'frame' END AS source FROM ev)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_entries(table(spark, sf_dir, "pages"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pages(spark, sf_dir)
    seq = F.col("entry_seq")
    folder = F.when(seq % 7 == 6, "/#SYS/").when(seq % 2 == 0, "/html/").otherwise("/Text/")
    ext = F.when(seq % 5 == 0, ".TXT").when(seq % 5 == 1, ".css").when(seq % 5 == 2, ".html").otherwise(".htm")
    path = F.concat(folder, F.lit("p"), seq.cast("string"), ext)
    return e.select("archive_id", "entry_seq", path.alias("path"), "content", "html", F.octet_length("content").cast("long").alias("length"))


def sitemap_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contents file for each archive, in the sloppy markup of such files."""
    e = pages(spark, sf_dir).where("entry_seq % 4 <> 3")
    seq = F.col("entry_seq").cast("string")
    item = F.concat(F.lit('<LI><OBJECT type="text/sitemap"><param name="Name" value="p'), seq, F.lit("\"><param name='Local' value=html/p"), seq, F.lit(".htm></OBJECT>"))
    volumes = e.groupBy("archive_id", F.concat(F.lit("Vol "), F.col("entry_seq") % 3).alias("volume")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_seq", item.alias("item")))), lambda x: x["item"]), "\n").alias("items")
    )
    block = F.concat(F.lit('<li><object type="text/sitemap"><param name="Name" value="'), "volume", F.lit('"></object>\n<UL>'), "items", F.lit("</UL>\n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("volume", block.alias("block")))), lambda x: x["block"]), "")
    head = F.lit('<html><body><object type="text/site properties"><param name="Window" value="x"></object></ul><ul>')
    return volumes.groupBy("archive_id").agg(F.concat(head, whole, F.lit("</ul></body>")).alias("text")).withColumn("path", F.lit("/toc.hhc"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of each archive, numbered by page."""
    return pages(spark, sf_dir).select("archive_id", F.col("entry_seq").alias("pos"), F.concat(F.lit("/html/p"), F.col("entry_seq").cast("string"), F.lit(".htm")).alias("path"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "view", "navigate").when(F.col("event_type") == "click", "request").when(F.col("event_type") != "error", F.col("event_type"))
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("user_id") % 10).alias("frame_id"), "event_type", k.alias("k"), "value", kind.alias("type"),
        F.concat(F.lit("/c/"), k.cast("string"), F.lit(".htm")).alias("path"), F.when(F.col("event_type") != "signup", k).alias("seq"),
        F.concat(F.lit("a"), (k % 5).cast("string")).alias("archive_id"), F.when(k % 4 == 0, "other").otherwise("frame").alias("source"),
    )
