"""Queries of reading state over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import requests as Q
from ..operators import state as R
from ..sources.entries import upsert_shelf
from .derived import EVENTS_SQL, messages
from .registry import query, table

_CHAPTERS = "/c/%d.htm"


@query("SELECT event_id, greatest(0.0, least(1.0, (event_id % 7 - 1 + least(1.0, value)) / greatest(1, event_id % 5))) AS progress FROM events")
def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", R.reading_progress(F.col("event_id") % 7 - 1, F.col("value"), F.col("event_id") % 5).alias("progress"))


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM m),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM a)
 SELECT user_id, arg_max(path, event_id) AS path, count(*) AS activities, max(event_id) AS last_event FROM s GROUP BY user_id, no""")
def debounced_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours instead of milliseconds, as the events of a user lie that far apart."""
    m = messages(spark, sf_dir)
    saves = R.debounced_saves(m, "6 hours")
    last = m.groupBy("user_id", F.col("ts").alias("last_ts")).agg(F.max("event_id").alias("last_event"))
    return saves.join(last, ["user_id", "last_ts"]).select("user_id", "path", "activities", "last_event")


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT *, event_id // 400 AS f FROM m), w AS (SELECT *, greatest(0, coalesce(max(seq) OVER (PARTITION BY f ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS top FROM d)
 SELECT event_id, f AS frame_id, seq FROM w WHERE seq IS NULL OR seq > top""")
def stale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("frame_id", F.expr("event_id div 400"))
    return R.drop_stale(m).select("event_id", "frame_id", "seq")


@query(f"WITH {EVENTS_SQL} SELECT event_id, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < ts + to_minutes(k * 5), false) AS superseded FROM m")
def superseded_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    done = F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 300_000_000)
    return R.superseded(m.withColumn("done_ts", done)).select("event_id", "superseded")


@query(f"WITH {EVENTS_SQL} SELECT event_id FROM m WHERE source = 'frame' AND frame_id IN (1, 3, 5)")
def trusted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    known = m.where("frame_id in (1, 3, 5)").select("frame_id").distinct()
    return R.trusted(m, known, "frame").select("event_id")


@query(f"WITH {EVENTS_SQL} SELECT CASE type WHEN 'navigate' THEN 'navigate' WHEN 'request' THEN 'request' ELSE 'other' END AS route, count(*) AS messages FROM m WHERE type IS NOT NULL GROUP BY 1")
def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.route(messages(spark, sf_dir)).groupBy("route").agg(F.count(F.lit(1)).alias("messages"))


@query(f"WITH {EVENTS_SQL} SELECT path, arg_min(event_id, ts) AS event_id, count(*) AS requests FROM m GROUP BY path")
def dedup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedup_requests(messages(spark, sf_dir))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, q AS (SELECT event_id AS id, path, ts AS t, ts + to_hours(user_id % 30) AS done, event_type <> 'signup' AS kept FROM m WHERE event_type <> 'error'),
 x AS (SELECT path, ts FROM m WHERE event_type = 'error'),
 f AS (SELECT q.*, CASE WHEN kept THEN (SELECT min(ts) FROM x WHERE x.path = q.path AND x.ts >= q.done) ELSE done END AS fin FROM q),
 n AS (SELECT f.*, (SELECT arg_min(g.id, (g.t, g.id)) FROM q g WHERE g.path = f.path AND g.t >= f.fin AND (g.t > f.t OR g.t = f.t AND g.id > f.id)) AS next_id FROM f),
 c AS (SELECT arg_min(id, (t, id)) AS id FROM q GROUP BY path UNION ALL SELECT n.next_id FROM c JOIN n ON n.id = c.id WHERE n.next_id IS NOT NULL)
 SELECT q.path, q.id AS event_id, c.id IS NOT NULL AS fetched, last_value(c.id IGNORE NULLS) OVER (PARTITION BY q.path ORDER BY q.t, q.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served_by FROM q LEFT JOIN c ON c.id = q.id""")
def shared_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests that take some hours, sign-ups of which find nothing; errors throw the path's answer out."""
    m = messages(spark, sf_dir)
    done = F.timestamp_micros(F.unix_micros("ts") + F.col("user_id") % 30 * 3_600_000_000)
    asked = m.where("event_type <> 'error'").select("path", "event_id", "ts", done.alias("done_ts"), (F.col("event_type") != "signup").alias("found"))
    return Q.fetches(asked, m.where("event_type = 'error'").select("path", "ts"), span=24 * 3600)


@query(f"WITH {EVENTS_SQL}, c AS (SELECT *, lag(archive_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM m) SELECT event_id, user_id, archive_id AS path FROM c WHERE archive_id IS DISTINCT FROM was")
def path_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("path", F.col("archive_id"))
    return R.path_changes(m).select("event_id", "user_id", "path")


@query(f"WITH {EVENTS_SQL} SELECT event_id, user_id, last_value(CASE WHEN k % 2 = 0 THEN path END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_path FROM m")
def current_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    spine = m.where("k % 2 = 0").select(F.upper("path").alias("path")).distinct()
    return R.current_path(m, spine)


@query(f"WITH {EVENTS_SQL} SELECT user_id, archive_id, arg_max(path, event_id) AS path, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS title, arg_max(value, event_id) AS progress, max(event_id) AS last_event FROM m GROUP BY user_id, archive_id")
def reading_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("title", F.when(F.col("event_type") != "view", F.col("event_type"))).withColumn("progress", F.col("value"))
    out = R.reading_state(m)
    last = m.groupBy("user_id", "archive_id").agg(F.max("event_id").alias("last_event"))
    return out.join(last, ["user_id", "archive_id"]).drop("last_opened")


@query(f"WITH {EVENTS_SQL} SELECT user_id, archive_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM m GROUP BY user_id, archive_id")
def first_last_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.first_last_open(messages(spark, sf_dir))
    return out.select("user_id", "archive_id", F.unix_micros("first_opened").alias("first_us"), F.unix_micros("last_opened").alias("last_us"), "events")


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, archive_id, arg_max(path, event_id) AS chapter, arg_max(value, event_id) AS scroll, arg_max(event_type, event_id) AS title, min(ts) AS a, max(ts) AS b, 'gbk' AS encoding FROM m WHERE event_type <> 'click' GROUP BY ALL),
 o AS (SELECT user_id, archive_id, min(ts) AS a, max(ts) AS b, arg_max(source, event_id) AS title, max(event_id) AS last FROM m WHERE event_type = 'click' GROUP BY ALL),
 l AS (SELECT o.*, CASE WHEN m.k % 2 = 0 THEN 'big5' END AS encoding FROM o JOIN m ON o.last = m.event_id)
 SELECT coalesce(s.user_id, l.user_id) AS user_id, coalesce(s.archive_id, l.archive_id) AS archive_id, s.chapter, coalesce(s.scroll, 0) AS scroll, CASE WHEN s.user_id IS NULL THEN 0.0 ELSE 0.25 END AS progress,
 CASE WHEN l.user_id IS NULL THEN s.title ELSE l.title END AS title, epoch_us(coalesce(s.a, l.a)) AS first_us, epoch_us(coalesce(l.b, s.b)) AS last_us, CASE WHEN l.user_id IS NULL THEN s.encoding ELSE l.encoding END AS encoding
 FROM s FULL JOIN l ON s.user_id = l.user_id AND s.archive_id = l.archive_id""")
def open_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks open archives whose records the other events made."""
    m = messages(spark, sf_dir)
    old = m.where("event_type <> 'click'").groupBy("user_id", "archive_id").agg(
        F.max_by("path", "event_id").alias("chapter"), F.max_by("value", "event_id").alias("scroll"), F.lit(0.25).alias("progress"), F.max_by("event_type", "event_id").alias("title"),
        F.min("ts").alias("first_opened"), F.max("ts").alias("last_opened"), F.lit("gbk").alias("encoding"),
    )
    opens = m.where("event_type = 'click'").select("user_id", "archive_id", "ts", "event_id", F.col("source").alias("title"), F.when(F.col("k") % 2 == 0, "big5").alias("encoding"))
    out = R.open_merge(old, opens)
    return out.select("user_id", "archive_id", "chapter", "scroll", "progress", "title", F.unix_micros("first_opened").alias("first_us"), F.unix_micros("last_opened").alias("last_us"), "encoding")


_SHELF = f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, archive_id, arg_max(k, event_id) AS k, arg_max(value, event_id) AS scroll, max(event_id) AS last FROM m GROUP BY user_id, archive_id)"""


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.groupBy("user_id", "archive_id").agg(F.max_by("k", "event_id").alias("k"), F.max_by("value", "event_id").alias("scroll"), F.max("event_id").alias("last_opened"))


@query(_SHELF + """, b AS (SELECT archive_id, min(k) AS f FROM m WHERE k % 3 <> 1 GROUP BY archive_id)
 SELECT user_id, s.archive_id, CASE WHEN k % 3 = 1 THEN '/c/' || f || '.htm' ELSE '/c/' || k || '.htm' END AS path, CASE WHEN k % 3 = 0 THEN scroll ELSE 0 END AS scroll FROM s JOIN b ON s.archive_id = b.archive_id""")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    name = F.concat(F.lit("/c/"), F.col("k").cast("string"), F.lit(".htm"))
    m = messages(spark, sf_dir).where("k % 3 <> 1").select("archive_id", "k").distinct()
    spine = m.select("archive_id", name.alias("path"), (F.row_number().over(Window.partitionBy("archive_id").orderBy("k")) - 1).alias("position"))
    shelf = _shelf(spark, sf_dir).withColumn("chapter", F.when(F.col("k") % 3 == 2, F.upper(name)).otherwise(name))
    return R.resume_points(shelf, spine)


@query(_SHELF + " SELECT user_id, archive_id, last FROM s WHERE user_id % 4 <> 1 ORDER BY last DESC LIMIT 100")
def shelf_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = _shelf(spark, sf_dir)
    gone = shelf.where("user_id % 4 = 1").select("user_id", "archive_id")
    return R.shelf_recent(shelf, gone, 100).select("user_id", "archive_id", F.col("last_opened").alias("last"))


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT user_id, archive_id, arg_max(k, event_id) AS k, max(event_id) AS last, arg_max(event_type, event_id) AS t FROM m GROUP BY user_id, archive_id)
 SELECT user_id, archive_id, k, last FROM l WHERE NOT (t = 'signup' AND last >= 5000)""")
def shelf_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shelf of the first 5,000 events' time, then the later events as changes; a sign-up removes a record."""
    m = messages(spark, sf_dir)
    rows = m.select("user_id", "archive_id", "k", F.col("event_id").alias("last"), "event_type")
    old = rows.where("last < 5000").groupBy("user_id", "archive_id").agg(F.max_by("k", "last").alias("k"), F.max("last").alias("last"))
    changes = rows.where("last >= 5000").select("user_id", "archive_id", "k", "last", (F.col("event_type") == "signup").alias("deleted"))
    return upsert_shelf(old, changes, ["user_id", "archive_id"], "last")


@query("""WITH s AS (SELECT conv_id AS archive_id, turn AS position, '/t' || turn || '.htm' AS path FROM conversations)
 SELECT archive_id, position, path, coalesce(array_to_string(list(path) OVER (PARTITION BY archive_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '|'), '') AS ahead FROM s""")
def read_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    spine = c.select(F.col("conv_id").alias("archive_id"), F.col("turn").alias("position"), F.concat(F.lit("/t"), F.col("turn").cast("string"), F.lit(".htm")).alias("path"))
    return R.read_ahead(spine).withColumn("ahead", F.array_join("ahead", "|"))
