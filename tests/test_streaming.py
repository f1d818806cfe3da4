"""Streams read to their end give what the batch twins give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from folioworks.operators import state as R
from folioworks.sources import entries as S
from folioworks.streaming import events as V
from folioworks.streaming import shelf as SH


def events(n=200):
    rng = random.Random(2)
    base, t = dt.datetime(2024, 1, 1), 0
    for i in range(n):
        t += rng.choice([1, 5, 2000])
        yield i, base + dt.timedelta(seconds=t), rng.randint(0, 3), rng.randint(0, 2), rng.choice([None, *range(1, 40)]), f"/c{rng.randint(0, 9)}.htm"


NAMES = "event_id long, ts timestamp, user_id long, frame_id long, seq long, path string"


def source(spark, folder, rows):
    spark.createDataFrame(rows, NAMES).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(NAMES).parquet(folder)


def drained(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_debounce(spark, tmp_path):
    rows = list(events())
    end = rows[-1][1] + dt.timedelta(days=30)
    more = [(10_000 + u, end, u, 0, None, "/end") for u in range(4)]
    stream = source(spark, f"{tmp_path}/in", rows)
    source(spark, f"{tmp_path}/in", more)
    got = drained(V.debounced_saves(stream, "100 seconds", "1 hour"), "saves", tmp_path)
    batch = R.debounced_saves(spark.createDataFrame(rows, NAMES), "100 seconds")
    key = ["user_id", "path", "activities", "last_ts"]
    assert sorted(map(tuple, got.where("path <> '/end'").select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


CLOSE = dt.timedelta(days=30)


def shuffled(spark, folder, rows, names=NAMES, files=4, window=12, seed=5, rest=None):
    """The rows as a stream of several files, each row up to `window` places from where it belongs, then one that moves the watermark on."""
    rng = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda i: i + rng.random() * window)
    size = -(-len(order) // files)
    for i in range(files):
        spark.createDataFrame([rows[j] for j in order[i * size : i * size + size]], names).coalesce(1).write.mode("append").parquet(folder)
    last = max(r[1] for r in rows) + CLOSE
    spark.createDataFrame([(-1, last, *[rest] * (len(rows[0]) - 2))], names).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stale(spark, tmp_path):
    """Shuffled files give what the batch gives in order of time; numbers beyond doubles stay apart."""
    big = 2**60
    rows = [(i, ts, u, f, None if seq is None else big + seq, path) for i, ts, u, f, seq, path in events()]
    got = drained(V.drop_stale(shuffled(spark, f"{tmp_path}/in", rows), "10 days"), "stale", tmp_path)
    batch = R.drop_stale(spark.createDataFrame(rows, NAMES), order=("ts", "event_id"))
    key = ["event_id", "frame_id", "seq"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, batch.select(key).collect())) and got.count() > 10


def test_stale_goes_on_after_a_restart_and_forgets_idle_frames(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    at = lambda i, minutes, seq: (i, base + dt.timedelta(minutes=minutes), 0, 7, seq, "/")
    parts = [[at(1, 0, 5), at(2, 1, 4)], [at(3, 20, 5), at(4, 21, 6)], [at(5, 2000, 1)], [at(6, 9000, 9)]]
    for i, rows in enumerate(parts):
        stream = source(spark, f"{tmp_path}/in", rows)
        q = V.drop_stale(stream, "1 minute", idle_ms=86_400_000).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        q = q.option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    # 4: 6 is above 5, kept over the restart; 5: a day without an event, so the frame starts anew
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 4, 5]


def test_current_path(spark, tmp_path):
    rows = list(events())
    spine = spark.createDataFrame([(f"/C{i}.htm",) for i in (1, 4, 6)], "path string")
    got = drained(V.current_path(shuffled(spark, f"{tmp_path}/in", rows), spine, "10 days"), "paths", tmp_path)
    batch = R.current_path(spark.createDataFrame(rows, NAMES), spine)
    key = ["event_id", "user_id", "current_path"]
    assert sorted(map(str, got.where("event_id >= 0").select(key).collect())) == sorted(map(str, batch.select(key).collect()))


def test_superseded(spark, tmp_path):
    """Requests and answers as two streams, both out of order, give the batch's verdicts."""
    rng = random.Random(8)
    base, rows, t = dt.datetime(2024, 1, 1), [], 0
    for i in range(160):
        t += rng.choice([0, 1, 3, 40])
        ts = base + dt.timedelta(seconds=t)
        rows.append((i, ts, rng.randint(0, 4), ts + dt.timedelta(seconds=rng.choice([0, 1, 2, 10, 60]))))
    asked = shuffled(spark, f"{tmp_path}/asked", [r[:3] for r in rows], "event_id long, ts timestamp, user_id long", rest=9)
    done = shuffled(spark, f"{tmp_path}/done", [(r[0], r[3]) for r in rows], "event_id long, done_ts timestamp", seed=6)
    got = drained(V.superseded(asked, done, "1 day", "10 minutes"), "superseded", tmp_path)
    batch = R.superseded(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, done_ts timestamp"))
    want = {r.event_id: r.superseded for r in batch.collect()}
    rows = got.where("event_id >= 0").collect()
    assert {r.event_id: r.superseded for r in rows} == want and len(rows) == len(want) and len(set(want.values())) == 2


def test_requests(spark, tmp_path):
    rows = list(events())
    got = drained(V.dedup_requests(source(spark, f"{tmp_path}/in", rows), "1000 days"), "requests", tmp_path)
    assert sorted(r.path for r in got.collect()) == sorted({r[5] for r in rows})


def test_shelf_sink(spark, tmp_path):
    rows = list(events())
    source(spark, f"{tmp_path}/in", rows[:100])
    source(spark, f"{tmp_path}/in", rows[100:])
    put = SH.shelf_sink(f"{tmp_path}/shelf", ["user_id"], "event_id")
    stream = spark.readStream.schema(NAMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = SH.read_shelf(spark, f"{tmp_path}/shelf")
    assert sorted(map(tuple, got.select("user_id", "event_id").collect())) == sorted((u, max(r[0] for r in rows if r[2] == u)) for u in {r[2] for r in rows})


def test_shelf_sink_deletes(spark, tmp_path):
    """A latest row marked as deleted takes its record away; a repeated batch gives the same."""
    put = SH.shelf_sink(f"{tmp_path}/shelf", ["k"], "n", buckets=3)
    batches = [[("a", 1, False), ("b", 1, False)], [("a", 2, True), ("c", 1, False)], [], [("b", 0, True), ("c", 3, True), ("a", 3, False)], [("a", 4, True), ("b", 4, True)]]
    want = [{("a", 1), ("b", 1)}, {("b", 1), ("c", 1)}, {("b", 1), ("c", 1)}, {("b", 1), ("a", 3)}, set()]
    for i, rows in enumerate(batches):
        for _ in range(2):
            put(spark.createDataFrame(rows, "k string, n int, deleted boolean"), i)
            assert {tuple(r) for r in SH.read_shelf(spark, f"{tmp_path}/shelf").collect()} == want[i]
    assert sorted(x.name for x in (tmp_path / "shelf" / "manifests").iterdir() if not x.name.startswith(".")) == ["3", "4"]


def test_shelf_batch_of_one_key_writes_one_bucket(spark, tmp_path):
    put = SH.shelf_sink(f"{tmp_path}/shelf", ["k"], "n", buckets=16)
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "shelf" / "data").rglob("*.parquet")}
    put(spark.range(500).selectExpr("id AS k", "1 AS n"), 0)
    before = files()
    put(spark.createDataFrame([(7, 2)], "k long, n int"), 1)
    after = files()
    assert {k: v for k, v in after.items() if k in before} == before  # nothing that was there is touched
    assert len(after) == len(before) + 1
    assert {tuple(r) for r in SH.read_shelf(spark, f"{tmp_path}/shelf").collect()} == {(i, 2 if i == 7 else 1) for i in range(500)}
    # a stream that starts again gives the batch's shelf
    put(spark.createDataFrame([(7, 3), (8, 2)], "k long, n int"), 2)
    assert SH.read_shelf(spark, f"{tmp_path}/shelf").where("n > 1").count() == 2


def test_entry_stream(spark, tmp_path):
    (tmp_path / "in" / "book").mkdir(parents=True)
    (tmp_path / "in" / "book" / "a.txt").write_bytes(b"hello")
    got = drained(S.stream_entries(spark, f"{tmp_path}/in").select("archive_id", "path", F.col("length")), "files", tmp_path)
    assert [tuple(r) for r in got.collect()] == [("book", "/a.txt", 5)]
