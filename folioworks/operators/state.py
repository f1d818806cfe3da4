"""Reading state from events, in batch: progress, stale messages, debounced saves, the shelf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reading_progress(position: Column, ratio: Column, chapters: Column) -> Column:
    """How much of a book is read, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (position + F.least(F.lit(1.0), ratio)) / F.greatest(F.lit(1), chapters)))


def debounced_saves(events: DataFrame, gap: str = "800 milliseconds") -> DataFrame:
    """events(user_id, ts, event_id, path) with no next one of the user within the gap: the state that is saved."""
    session = F.session_window("ts", gap)
    return events.groupBy("user_id", session).agg(F.max_by("path", F.struct("ts", "event_id")).alias("path"), F.count(F.lit(1)).alias("activities"), F.max("ts").alias("last_ts")).drop("session_window")


def drop_stale(events: DataFrame, order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Events of a frame whose seq is above every earlier one of the frame; those without seq pass."""
    before = Window.partitionBy("frame_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.greatest(F.lit(0), F.coalesce(F.max("seq").over(before), F.lit(0)))
    return events.withColumn("top", top).where(F.col("seq").isNull() | (F.col("seq") > F.col("top"))).drop("top")


def superseded(requests: DataFrame) -> DataFrame:
    """requests(user_id, event_id, ts, done_ts) with whether a newer request of the user came before the answer."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return requests.withColumn("superseded", F.coalesce(F.lead("ts").over(order) < F.col("done_ts"), F.lit(False)))


def trusted(events: DataFrame, sources: DataFrame, tag: str) -> DataFrame:
    """Events with our tag from a known frame."""
    return events.where(F.col("source") == tag).join(sources.select("frame_id"), "frame_id", "left_semi")


def route(events: DataFrame) -> DataFrame:
    """events with `route`: navigate, request or other; rows without a type or path are malformed and go."""
    kind = F.when(F.col("type") == "navigate", "navigate").when(F.col("type") == "request", "request").otherwise("other")
    return events.where(F.col("type").isNotNull() & F.col("path").isNotNull()).withColumn("route", kind)


def dedup_requests(events: DataFrame) -> DataFrame:
    """The first request of each path."""
    return events.groupBy("path").agg(F.min(F.struct("ts", "event_id")).alias("f"), F.count(F.lit(1)).alias("requests")).select("path", "f.event_id", "requests")


def path_changes(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn("was", F.lag("path").over(order)).where(~F.col("path").eqNullSafe(F.col("was"))).drop("was")


def current_path(events: DataFrame, spine: DataFrame) -> DataFrame:
    """events with the last path up to then that is in the reading order; others don't move it."""
    known = spine.select(F.lower("path").alias("path_key"), F.lit(True).alias("known")).distinct()
    seen = events.withColumn("path_key", F.lower("path")).join(known, "path_key", "left")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seen.select("event_id", "user_id", F.last(F.when(F.col("known"), F.col("path")), ignorenulls=True).over(order).alias("current_path"))


def reading_state(events: DataFrame) -> DataFrame:
    """The latest record of each user and archive, by event time; fields that it lacks come from the latest that has them."""
    order = F.struct("ts", "event_id")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return events.groupBy("user_id", "archive_id").agg(latest("path"), latest("title"), F.max_by("progress", order).alias("progress"), F.max("ts").alias("last_opened"))


def first_last_open(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "archive_id").agg(F.min("ts").alias("first_opened"), F.max("ts").alias("last_opened"), F.count(F.lit(1)).alias("events"))


def open_merge(stored: DataFrame, opens: DataFrame) -> DataFrame:
    """The records of stored(user_id, archive_id, chapter, scroll, progress, title, first_opened, last_opened, encoding)
    after opens(user_id, archive_id, ts, event_id, title, encoding).

    An opened archive keeps its first opening, chapter, scroll and progress from the stored
    record (none, 0 and 0 without one); its last opening, title and override of the encoding
    are the latest opening's. Records that weren't opened stay as they are."""
    latest = F.max_by(F.struct("title", "encoding"), F.struct("ts", "event_id"))
    now = opens.groupBy("user_id", "archive_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), latest.alias("now"))
    both = stored.join(now.hint("merge"), ["user_id", "archive_id"], "full_outer")
    opened = F.col("last_ts").isNotNull()
    new = lambda c: F.when(opened, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(
        "user_id", "archive_id", "chapter", F.coalesce("scroll", F.lit(0.0)).alias("scroll"), F.coalesce("progress", F.lit(0.0)).alias("progress"), new("title"),
        F.coalesce("first_opened", "first_ts").alias("first_opened"), F.when(opened, F.col("last_ts")).otherwise(F.col("last_opened")).alias("last_opened"), new("encoding"),
    )


def resume_points(shelf: DataFrame, spine: DataFrame) -> DataFrame:
    """Where each record of shelf(user_id, archive_id, chapter, scroll) goes on: its chapter if the reading order
    still has it, else the first; the scroll position only on exactly the saved path."""
    first = spine.where(F.col("position") == 0).select("archive_id", F.col("path").alias("first_path"))
    known = spine.select("archive_id", F.lower("path").alias("key"), F.col("path").alias("kept_path"))
    joined = shelf.withColumn("key", F.lower("chapter")).join(known.hint("merge"), ["archive_id", "key"], "left").join(first.hint("merge"), "archive_id", "left")
    path = F.coalesce("kept_path", "first_path")
    return joined.select("user_id", "archive_id", path.alias("path"), F.when(path == F.col("chapter"), F.col("scroll")).otherwise(F.lit(0.0)).alias("scroll"))


def shelf_recent(shelf: DataFrame, removed: DataFrame, most: int = 400) -> DataFrame:
    """The latest records that weren't removed; the cut is the feature."""
    return shelf.join(removed, ["user_id", "archive_id"], "left_anti").orderBy(F.desc("last_opened"), "user_id", "archive_id").limit(most)


def read_ahead(spine: DataFrame, k: int = 5) -> DataFrame:
    """The next k chapters of each position."""
    ahead = Window.partitionBy("archive_id").orderBy("position").rowsBetween(1, k)
    return spine.select("archive_id", "position", "path", F.collect_list("path").over(ahead).alias("ahead"))
