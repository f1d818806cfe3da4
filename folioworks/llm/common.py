"""What the operators of this subpackage share: tables, scratch folder, ordered parts."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import discard, scratch_folder, scratch_path, written  # noqa: F401 - the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores after it until no taken one is alike."""
    used = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The columns of one row for each value of the keys (nulls are equal): always the same
    one, that with the least digest of all columns. Map tasks keep a row a key first, so
    that no task gets a group of equal rows."""
    order = F.sha2(F.to_json(F.struct(*map(column, columns))).cast("binary"), 256)
    (own,) = free_names([*keys, *columns], "row")
    picked = rows.groupBy(*map(column, keys)).agg(F.min_by(F.struct(*map(column, columns)), order).alias(own))
    return picked.select(*[column(own).getField(c).alias(c) for c in columns])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo divisor; null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor))


def ranked(rows: DataFrame, keys: list[str], weight: str, tag: str) -> DataFrame:
    """rows in ascending order of keys (nulls first), with `rank` (from 0), `before` (the
    weights of all rows before) and `total` (all weights).

    The rows are range-partitioned on the keys and written once, so that the parts are
    the same whenever they are read; a running sum inside each part is added to the prefix
    sum over the parts' totals. The totals have one row a part, which bounds the broadcast
    and the one window that isn't partitioned."""
    spark = rows.sparkSession
    parts = written(
        rows.repartitionByRange(partitions(spark), *[F.col(k).asc_nulls_first() for k in keys]).withColumn("part", F.spark_partition_id()), tag
    )
    totals = parts.groupBy("part").agg(F.sum(weight).alias("part_weight"), F.count(F.lit(1)).alias("part_rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_weight").over(ahead), F.lit(0)).alias("weight_ahead"),
        F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.sum("part_weight").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    running = parts.select(
        "*",
        (F.row_number().over(inside) - 1).cast("long").alias("part_rank"),
        (F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)).alias("part_before"),
    )
    return (
        running.join(F.broadcast(offsets), "part")
        .withColumn("rank", F.col("part_rank") + F.col("rows_ahead"))
        .withColumn("before", F.col("part_before") + F.col("weight_ahead"))
        .drop("part", "part_rank", "part_before", "rows_ahead", "weight_ahead")
    )


def slices(batch: pa.RecordBatch, text_bytes: int, *columns: str) -> Iterator[pa.RecordBatch]:
    """batch in pieces of about text_bytes of these columns (text), a row at least."""
    lengths = [0] * batch.num_rows
    for name in columns or ("text",):
        lengths = [n + (x or 0) for n, x in zip(lengths, pa.compute.binary_length(batch.column(name)).to_pylist())]
    first = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > text_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield batch.slice(first)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine: FOLIO_TOKENIZERS, else the package's."""
    folder = os.environ.get("FOLIO_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
