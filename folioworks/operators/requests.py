"""Which requests of a path are fetched, and which share a fetch under way or an answer that is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import discard, written

#: Before every number that a row has, and after every time.
FIRST, NEVER = -(1 << 63), (1 << 63) - 1


def _along(rows: DataFrame, value: Column, name: str, order: tuple[str, ...], after: bool = False, own: bool = False) -> DataFrame:
    """rows(key, slice, ...) with the greatest value of the rows before each one in its key (the least of
    those after it, if `after`), its own counted if `own`; null where none has one.

    A window covers one slice of a key; what the other slices hold is one row a slice. So a
    key with most rows spreads over as many tasks as it has slices."""
    fold, both = (F.min, F.least) if after else (F.max, F.greatest)
    way = F.desc if after else F.asc
    near = Window.partitionBy("key", "slice").orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    far = Window.partitionBy("key").orderBy(way("slice")).rowsBetween(Window.unboundedPreceding, -1)
    valued = rows.withColumn("_value", value)
    slices = valued.groupBy("key", "slice").agg(fold("_value").alias("_value")).select("key", "slice", fold("_value").over(far).alias("_far"))
    inside = valued.withColumn("_near", fold("_value").over(near))
    return inside.join(slices.hint("merge"), ["key", "slice"]).withColumn(name, both("_near", "_far")).drop("_value", "_near", "_far")


def _first_after(points: DataFrame, marks: DataFrame, name: str, span: int, *beside: str) -> DataFrame:
    """points(key, at, no, ...) with the struct(at, no, *beside) of the first of marks(key, at, no, *beside) after
    each, by (at, no); a mark at the point's own place isn't after it."""
    mark = F.struct("at", "no", *beside)
    made = marks.select("key", "at", "no", F.lit(0).alias("kind"), mark.alias("mark"))
    both = points.withColumn("kind", F.lit(1)).unionByName(made, allowMissingColumns=True).withColumn("slice", F.expr(f"at div {span}"))
    return _along(both, F.col("mark"), name, ("at", "no", "kind"), after=True).where("kind = 1").drop("kind", "mark", "slice")


def fetches(requests: DataFrame, evictions: DataFrame, span: int = 3600) -> DataFrame:
    """(path, event_id, fetched, served_by) of requests(path, event_id, ts, done_ts, found), given evictions(path, ts).

    Paths count without regard to case, and a path's requests go by (ts, event_id). A request
    is fetched unless an earlier fetch of its path is under way (its done_ts is later) or has
    found an answer that is still kept: until the path's first eviction at or after done_ts.
    An eviction before that takes nothing out. served_by is the fetch that a request is
    answered by, its own event_id if it is fetched. A fetch without done_ts stays under way;
    one whose done_ts lies before its start ends at once; a null `found` counts as not found.

    A request's end is known without knowing whether it is fetched, so each has a successor:
    the path's first request at or after its end, which is fetched if it is. Those after all
    ends before them are fetched in any case and begin an island; inside an island the fetched
    ones are found by doubling: each round adds what lies twice as many successors on, so the
    rounds are the logarithm of an island's fetches. Windows cover `span` seconds of a path,
    so one path may have most of the requests.

    event_id is unique. Requests without path, ts or event_id and evictions without path or
    ts are none; empty tables give no rows; other columns are ignored."""
    span_us = span * 1_000_000
    asked = requests.where("path is not null and ts is not null and event_id is not null")
    start, end = F.unix_micros("ts"), F.unix_micros("done_ts")
    asked = asked.select(F.lower("path").alias("key"), "path", F.col("event_id").cast("long").alias("id"), start.alias("start"), F.greatest(start, F.coalesce(end, F.lit(NEVER))).alias("done"), F.coalesce("found", F.lit(False)).alias("kept"))
    out = evictions.where("path is not null and ts is not null").select(F.lower("path").alias("key"), F.unix_micros("ts").alias("at"), F.lit(0).cast("long").alias("no"))
    # what is never answered, or not kept, has its end already: it isn't looked up, so these don't meet in one slice
    looked = F.col("kept") & (F.col("done") < NEVER)
    gone = _first_after(asked.where(looked).withColumns({"at": F.col("done"), "no": F.lit(FIRST)}), out, "gone", span_us)
    ended = gone.withColumn("over", F.coalesce("gone.at", F.lit(NEVER))).unionByName(asked.where(~looked).withColumn("over", F.col("done")), allowMissingColumns=True)
    ended = written(ended.select("key", "path", F.col("start").alias("at"), F.col("id").alias("no"), "over"), "ends")

    lined = _along(ended.withColumn("slice", F.expr(f"at div {span_us}")), F.col("over"), "latest", ("at", "no"))
    lined = written(lined.select("key", "path", "at", "no", "over", (F.col("latest").isNull() | (F.col("at") >= F.col("latest"))).alias("head")), "islands")
    # all that one eviction ends have the same successor, which is looked up once
    later = lined.where((F.col("over") > F.col("at")) & (F.col("over") < NEVER)).select("key", F.col("no").alias("id"), "over")
    times = later.select("key", F.col("over").alias("at"), F.lit(FIRST).alias("no")).distinct()
    times = written(_first_after(times, lined, "next", span_us, "head").select("key", F.col("at").alias("over"), "next"), "times")
    at_once = lined.where("over <= at").select("key", "at", "no", F.col("no").alias("id"))
    following = later.join(times.hint("merge"), ["key", "over"]).select("key", "id", "next")
    following = following.unionByName(_first_after(at_once, lined, "next", span_us, "head").select("key", "id", "next")).where("next is not null and not next.head")
    jumps = written(following.select("key", "id", F.col("next.no").alias("to")), "jumps")
    fetched = written(lined.where("head").select("key", F.col("no").alias("id")), "fetched")
    while True:
        more = written(fetched.join(jumps.hint("merge"), ["key", "id"]).select("key", F.col("to").alias("id")), "more")
        if more.isEmpty():
            break
        again = jumps.select("key", F.col("id").alias("to"), F.col("to").alias("further"))
        twice = written(jumps.join(again.hint("merge"), ["key", "to"]).select("key", "id", F.col("further").alias("to")), "jumps")
        both = written(fetched.unionByName(more), "fetched")
        discard(more, jumps, fetched)
        fetched, jumps = both, twice
    discard(more, jumps, ended, times)

    marked = fetched.select("key", F.col("id").alias("no"), F.lit(True).alias("own"))
    known = lined.join(marked.hint("merge"), ["key", "no"], "left").withColumn("slice", F.expr(f"at div {span_us}"))
    by = _along(known, F.when(F.col("own"), F.struct("at", "no")), "by", ("at", "no"), own=True)
    return by.select("path", F.col("no").alias("event_id"), F.coalesce("own", F.lit(False)).alias("fetched"), F.col("by.no").alias("served_by"))
