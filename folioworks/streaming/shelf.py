"""The shelf as a keyed table that grows by batches: only the buckets that a batch touches are written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.entries import upsert_shelf

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose manifests are there, in order."""
    place, fs = _files(spark, f"{path}/manifests")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(place) if x.getPath().getName().isdigit()) if fs.exists(place) else []


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    place, fs = _files(spark, f"{path}/manifests/{number}")
    stream = spark.sparkContext._jvm.org.apache.hadoop.fs.FSDataInputStream(fs.open(place))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _put_manifest(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Written beside and renamed, so that a reader sees a whole manifest or none."""
    draft, fs = _files(spark, f"{path}/manifests/.{number}")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    place, _ = _files(spark, f"{path}/manifests/{number}")
    fs.delete(place, False)
    if not fs.rename(draft, place):
        raise OSError(f"manifest {number} of {path} couldn't be put in place")


def _table(spark: SparkSession, path: str, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
    places = [f"{path}/data/{version}/bucket={b}" for b, version in manifest["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(manifest["schema"]).parquet(*places) if places else None


def read_shelf(spark: SparkSession, path: str) -> DataFrame:
    """The shelf at path after its last whole batch."""
    numbers = _manifests(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no shelf at {path}")
    manifest = _manifest(spark, path, numbers[-1])
    found = _table(spark, path, manifest)
    return spark.createDataFrame([], manifest["schema"]) if found is None else found


def shelf_sink(path: str, keys: list[str], order: str, buckets: int = BUCKETS):
    """A foreachBatch function that keeps the latest row of each key at path.

    A latest row that is marked `deleted` removes its record; a batch without that column
    removes none. Records lie in buckets by a hash of their keys. A batch reads the buckets
    that its keys fall in, and writes these anew under its number; a manifest a batch says
    under which number each bucket lies, so the others stay where they are. Batches are
    numbered by the stream, and a repeated one starts from the manifest before it again; of older
    manifests and buckets only what a repetition needs stays. A batch without rows writes
    its manifest only. The number of buckets belongs to the shelf's first manifest."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes = batch if "deleted" in batch.columns else batch.withColumn("deleted", F.lit(False))
        earlier = [n for n in _manifests(spark, path) if n < number]
        columns = changes.drop("deleted")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema)
        before = _manifest(spark, path, earlier[-1]) if earlier else {"count": buckets, "schema": schema, "buckets": {}}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(before["count"])).cast("int")
        changes = changes.persist()  # read for the buckets and for the rows
        try:
            touched = sorted(r[0] for r in changes.select(bucket.alias("b")).distinct().collect())  # at most `buckets`
            now = dict(before["buckets"])
            if touched:
                old = _table(spark, path, before, touched)
                merged = upsert_shelf(columns.limit(0) if old is None else old, changes, keys, order)
                merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{number}")
                place, fs = _files(spark, f"{path}/data/{number}")
                there = {int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(place) if "=" in x.getPath().getName()}
                now = {b: v for b, v in now.items() if int(b) not in touched} | {str(b): number for b in touched if b in there}
        finally:
            changes.unpersist()
        _put_manifest(spark, path, number, {**before, "buckets": now})
        # what neither this manifest nor the one before it names is read no more
        needed = {*now.values(), *before["buckets"].values(), number}
        place, fs = _files(spark, f"{path}/data")
        for x in fs.listStatus(place) if fs.exists(place) else ():
            if int(x.getPath().getName()) not in needed and int(x.getPath().getName()) < number:
                fs.delete(x.getPath(), True)
        for n in earlier[:-1]:
            fs.delete(_files(spark, f"{path}/manifests/{n}")[0], False)

    return put
