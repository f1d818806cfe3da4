"""The same reading state over streams; each operator has its batch twin in operators.state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import in_order


def debounced_saves(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of activities; one is saved when the watermark has passed its end."""
    late = events.withWatermark("ts", delay)
    return late.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.max_by("path", F.struct("ts", "event_id")).alias("path"), F.count(F.lit(1)).alias("activities"), F.max("ts").alias("last_ts")
    ).drop("session_window")


def _fresh(top: int | None, event: dict) -> tuple[int | None, tuple | None]:
    seq = event.get("seq")
    row = (event["event_id"], event.get("frame_id"), seq)
    if seq is None:
        return top, row
    return (seq, row) if seq > (top or 0) else (top, None)


def drop_stale(events: DataFrame, delay: str = "1 minute", idle_ms: int | None = None) -> DataFrame:
    """Events(event_id, ts, frame_id, seq) above the greatest seq that their frame had, by event time; the state of an idle frame goes."""
    return in_order(events, ["frame_id"], ["seq"], _fresh, "event_id long, frame_id long, seq long", delay, idle_ms)


def _moved(path: str | None, event: dict) -> tuple[str | None, tuple | None]:
    path = event["path"] if event.get("known") else path
    return path, (event["event_id"], event.get("user_id"), path)


def current_path(events: DataFrame, spine: DataFrame, delay: str = "1 minute", idle_ms: int | None = None) -> DataFrame:
    """Events(event_id, ts, user_id, path) with the last path up to then, by event time, that is in the reading
    order of spine(path), a table; others don't move it."""
    known = spine.select(F.lower("path").alias("path_key"), F.lit(True).alias("known")).distinct()
    seen = events.withColumn("path_key", F.lower("path")).join(known, "path_key", "left")
    return in_order(seen, ["user_id"], ["path", "known"], _moved, "event_id long, user_id long, current_path string", delay, idle_ms)


def superseded(requests: DataFrame, completions: DataFrame, delay: str = "1 minute", longest: str = "1 hour") -> DataFrame:
    """(event_id, superseded) of answered requests(user_id, event_id, ts): whether a newer request of the user,
    by (ts, event_id), came before the answer of completions(event_id, done_ts).

    Both are streams. A request meets its answer within `longest`, and newer requests until
    the answer, by interval joins, whose state goes as both watermarks move on; a request
    without a newer one comes out when none can come any more. Unanswered ones don't."""
    asked = requests.select("user_id", "event_id", "ts").withWatermark("ts", delay)
    answers = completions.select(F.col("event_id").alias("answered_id"), "done_ts").withWatermark("done_ts", delay)
    answered = asked.join(answers, F.expr(f"event_id = answered_id AND done_ts >= ts - INTERVAL {longest} AND done_ts <= ts + INTERVAL {longest}"))
    # a stream has one event time: from here on the answer's time is a number
    answered = answered.select("user_id", "event_id", "ts", F.unix_micros("done_ts").alias("done_us"))
    newer = requests.select(F.col("user_id").alias("newer_user"), F.col("event_id").alias("newer_id"), F.col("ts").alias("newer_ts")).withWatermark("newer_ts", delay)
    before = f"user_id = newer_user AND newer_ts >= ts AND newer_ts <= ts + INTERVAL {longest} AND unix_micros(newer_ts) < done_us AND (newer_ts > ts OR newer_id > event_id)"
    both = answered.join(newer, F.expr(before), "leftOuter")
    # one row of those that several newer requests met
    return both.select("event_id", "ts", F.col("newer_id").isNotNull().alias("superseded")).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "superseded")


def dedup_requests(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path"])
