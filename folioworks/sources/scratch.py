"""Tables written out on the way: where they lie, and how they go again."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
#: Where tables of written() lie, for discard().
_places: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and everything runs on one machine (tests) a folder of our own
    is made; on a cluster it has to be set."""
    global _own_folder
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="folioworks-")
    return f"file://{_own_folder}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_folder(spark)}/folioworks-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: object) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _places[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        path = _places.pop(df, None)
        if path:
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
