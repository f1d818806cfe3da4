"""Files of archives: empty ones, ranges, and a stream that goes on."""

import os
import time

from folioworks.sources import archive_files as A
from folioworks.sources import entries as S


def made(tmp_path):
    files = {"book/a b.txt": b"hello", "book/d/empty.htm": b"", "book/d/e.css": b"p{}", "other/x.bin": bytes(range(256)) * 40, "other/y": b"", "loose.txt": b"no archive's"}
    for name, content in files.items():
        place = tmp_path / "in" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content)
        os.utime(place, (1_700_000_000, 1_700_000_000))
    return f"{tmp_path}/in", {(n.split("/", 1)[0], "/" + n.split("/", 1)[1]): c for n, c in files.items() if "/" in n}


def test_batch_has_files_without_a_byte(spark, tmp_path):
    root, want = made(tmp_path)
    for where in (root, f"file://{root}"):
        assert {(r.archive_id, r.path): bytes(r.content) for r in S.read_entries(spark, where).collect()} == want
        rows = A.archive_files(spark, where).collect()
        assert {(r.archive_id, r.path): bytes(r.content) for r in rows} == want and all(r.length == len(r.content) for r in rows)
    assert {(r.path, r.length, r.content) for r in A.archive_files(spark, root, only="empty", content="false").collect()} == {("/d/empty.htm", 0, None), ("/y", 0, None)}
    assert A.archive_files(spark, f"{tmp_path}/none").count() == 0


def test_tasks_are_cut_by_bytes_and_files(tmp_path, monkeypatch):
    root, want = made(tmp_path)
    monkeypatch.setattr(A, "SPLIT_BYTES", 100)
    tasks = A.ArchiveReader({"path": root}).partitions()
    assert [len(t.files) for t in tasks] == [3, 1, 1] and sum(len(t.files) for t in tasks) == len(want)
    monkeypatch.setattr(A, "SPLIT_FILES", 2)
    assert [len(t.files) for t in A.ArchiveReader({"path": root, "content": "false"}).partitions()] == [2, 2, 1]


def test_stream_goes_on_and_has_empty_files(spark, tmp_path):
    root, want = made(tmp_path)

    def drained():
        rows = S.stream_entries(spark, root).select("archive_id", "path", "length", "content")
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return {(r.archive_id, r.path): bytes(r.content) for r in spark.read.parquet(f"{tmp_path}/out").collect()}, spark.read.parquet(f"{tmp_path}/out").count()

    assert drained() == (want, len(want))
    late = tmp_path / "in" / "book" / "later"
    late.write_bytes(b"")
    os.utime(late, (time.time() - 60, time.time() - 60))
    assert drained() == (want | {("book", "/later"): b""}, len(want) + 1)
    same = tmp_path / "in" / "book" / "same"  # of the very time that the offset holds
    same.write_bytes(b"s")
    os.utime(same, ns=(late.stat().st_mtime_ns, late.stat().st_mtime_ns))
    assert drained() == (want | {("book", "/later"): b"", ("book", "/same"): b"s"}, len(want) + 2)


def test_slices_read_their_range_only(spark, tmp_path, monkeypatch):
    root, want = made(tmp_path)
    data = want["other", "/x.bin"]
    cases = [(0, 10, True), (10_000, 240, True), (10_000, 241, False), (0, 0, True), (-1, 2, False), (3, -1, False), (None, 1, False)]
    rows = [(f"{root}/other/x.bin", o, n, i) for i, (o, n, _) in enumerate(cases)] + [(f"{root}/none", 0, 1, 90), (None, 0, 1, 91), (f"{root}/other/y", 0, 0, 92)]
    got = {r.i: r for r in A.read_slices(spark.createDataFrame(rows, "file string, offset long, length long, i int")).collect()}
    for i, (o, n, ok) in enumerate(cases):
        assert got[i].ok == ok and (bytes(got[i].bytes) == data[o : o + n] if ok else got[i].bytes is None)
    assert not got[90].ok and not got[91].ok and got[92].ok and bytes(got[92].bytes) == b""
