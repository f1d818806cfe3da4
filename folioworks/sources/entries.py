"""Where archive entries come from and go to: files, tables of pages, streams, the shelf."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.paths import is_content, mime_for
from .archive_files import OPENED, empty_entries, stream_archive_files

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def _as_entries(files: DataFrame, root: str) -> DataFrame:
    below = rf"\Q{root.rstrip('/').split(':')[-1].lstrip('/')}\E/([^/]+)(/.*)$"
    rows = files.select(F.regexp_extract("path", below, 1).alias("archive_id"), F.regexp_extract("path", below, 2).alias("path"), "length", "content", "modificationTime")
    return rows.where(F.col("archive_id") != "")  # a file beside the archives' folders is none's


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries of extracted archives: one folder under root is one archive. Unread columns are pruned.

    Spark's reader leaves out files without a byte; these come from a listing of the same
    folder, but for stores that only Spark opens."""
    files = _as_entries(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root)
    return files.unionByName(empty_entries(spark, root)) if urlparse(root).scheme in OPENED else files


def stream_entries(spark: SparkSession, root: str) -> DataFrame:
    """The same as files arrive, whole ones and such without a byte alike; from stores that only
    Spark opens without the latter."""
    if urlparse(root).scheme in OPENED:
        rows = stream_archive_files(spark, root)
        return rows.select("archive_id", "path", "length", "content", F.col("modified").alias("modificationTime"))
    source = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    return _as_entries(source.load(root), root)


def site_entries(pages: DataFrame) -> DataFrame:
    """Scraped pages as entries: the host is the archive, the URL's path the entry's."""
    return pages.select(
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("archive_id"),
        F.col("page_id").alias("entry_seq"),
        F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
        "html",
    )


def inventory(entries: DataFrame) -> DataFrame:
    return entries.select("archive_id", "entry_seq", "path", F.octet_length("content").cast("long").alias("length"), mime_for(F.col("path")).alias("mime"))


def inventory_totals(entries: DataFrame) -> DataFrame:
    """Entries and bytes by archive and media type, with subtotals."""
    sized = inventory(entries)
    return sized.rollup("archive_id", "mime").agg(F.count(F.lit(1)).alias("entries"), F.sum("length").alias("bytes"))


def content_entries(entries: DataFrame) -> DataFrame:
    return entries.where(is_content(F.col("path")))


def last_per_key(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The row of each key with the greatest order."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place")


def resolve(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """paths(archive_id, wanted) with the entry that each means, without regard to case; the last duplicate wins."""
    key = [F.col("archive_id"), F.lower("path")]
    known = last_per_key(entries.select("archive_id", "path", "entry_seq"), key, "entry_seq").select(
        F.col("archive_id").alias("own_id"), F.lower("path").alias("path_key"), "path", "entry_seq"
    )
    joined = paths.join(known, (F.col("archive_id") == F.col("own_id")) & (F.lower("wanted") == F.col("path_key")), "left")
    return joined.select("archive_id", "wanted", F.col("path").alias("resolved"), F.col("path").isNotNull().alias("found"))


def content_slice(content: Column, offset: Column, length: Column) -> Column:
    """struct(ok, bytes): a range of the content; not ok where it is negative or passes the end."""
    ok = (offset >= 0) & (length >= 0) & (offset + length <= F.octet_length(content))
    return F.struct(ok.alias("ok"), F.when(ok, F.substring(content, offset.cast("int") + 1, length.cast("int"))).alias("bytes"))


def fingerprint(content: Column, sample: int = 256 * 1024) -> Column:
    """SHA-256 over the size and the head, middle and tail samples; over the whole content up to three samples' size."""
    size = F.octet_length(content)
    prefix = F.encode(F.concat(F.lit("size="), size.cast("string"), F.lit(";")), "UTF-8")
    middle = (size / 2).cast("int")
    parts = F.concat(F.substring(content, 1, sample), F.substring(content, middle + 1, F.lit(sample)), F.substring(content, -sample, sample))
    return F.sha2(F.concat(prefix, F.when(size <= 3 * sample, content).otherwise(parts)), 256)


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """Fingerprints that several entries have."""
    rows = entries.select(fingerprint(F.col("content")).alias("fingerprint"), "entry_seq")
    return rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("entry_seq").alias("first_seq")).where("copies > 1")


def first_properties(sys_props: DataFrame) -> DataFrame:
    """The first value of each code of an archive, cut at its first zero byte, one column a code."""
    first = sys_props.groupBy("archive_id", "code").agg(F.min_by("value", "prop_seq").alias("value"))
    text = F.substring_index(F.decode("value", "ISO-8859-1"), "\0", 1)
    return first.withColumn("value", text).groupBy("archive_id").pivot("code", [0, 1, 3, 4]).agg(F.first("value"))


def data_url(mime: Column, content: Column) -> Column:
    packed = F.translate(F.base64(content), "\r\n", "")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), packed)


def upsert_shelf(shelf: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """shelf after changes: the latest row of each key wins, a latest row marked `deleted` removes it."""
    rows = shelf.withColumn("deleted", F.lit(False)).unionByName(changes)
    return last_per_key(rows, [F.col(k) for k in keys], order).where(~F.col("deleted")).drop("deleted")
