"""Contiguous shards of equal bytes from global prefix sums of row sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, table

#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def balanced_shards(docs: DataFrame, shards: int = 40, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Shard 0 to shards-1 and slot in it for each row of docs(doc_id, text).

    Rows lie in ascending doc_id (null first, then by text checksum and size); a row's
    bytes, its text's UTF-8 bytes plus row_bytes, come after those of all rows before it.
    Cuts lie at equal targets of the total, and a row goes where its middle byte lies, so
    shards are contiguous and differ by one row's size at most. A null text has no bytes.
    Equal rows are kept apart as rows; an empty table gives no rows; other columns are
    ignored. Only 24 bytes a row are shuffled, never a text, however long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = ranked(rows, ["doc_id", "text_crc32", "size"], "size", "shards").withColumn(
        "shard",
        F.least(F.lit(shards - 1), F.expr(f"((2 * before + size) * {shards}) div (2 * total)")).cast("int"),
    )
    # one row a shard: a broadcast of `shards` rows
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), "before"
    )


def op5_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
