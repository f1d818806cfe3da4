"""Token counts through a cache of counts by content digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, scratch_path, slices, table, tokenizer_path, written
from .tokens import BYTE_BPE, encoder

CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version, a row per digest; none where nothing is stored yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])


def content_digest() -> Column:
    """SHA-256 of a row's normalised content. The tokenizer has no normaliser, so the only
    normalisation that keeps its counts is null to empty."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def store_missing(docs: DataFrame, cache_path: str, tokenizer: str = BYTE_BPE) -> str:
    """Encode the contents of docs(text) that the cache lacks and append their counts; returns the tokenizer's version.

    A key is the digest of a text's content with that of the tokenizer's file. Keys are made
    distinct (each map task first sends one row a key, so a group of copies meets as a few
    rows); those that are stored aren't encoded."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path(tokenizer))
    distinct = docs.select(content_digest().alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text")).dropDuplicates(["digest"])
    misses = distinct.join(read_cache(spark, cache_path, version).select("digest").hint("merge"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            for part in slices(batch, 4_000_000):
                counts = [len(x) // 4 for x in enc.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    fresh = misses.mapInArrow(encode, "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    return version


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = BYTE_BPE, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs(doc_id, text).

    First store_missing() sees to it that the cache has all keys; then all rows join the
    counts of their keys. Both sides of that join are tables that were written out, so the
    adaptive join can split a hot key's rows, of 50 bytes each. Null and empty texts count 0
    tokens; equal rows stay; an empty table gives no rows and stores none; other columns are
    ignored. A very long text is encoded whole, at about 100 bytes a word."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    version = store_missing(docs, cache_path, tokenizer)
    rows = written(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest().alias("digest")), "digests")
    own = rows.select("digest").distinct()
    known = written(read_cache(spark, cache_path, version).join(own.hint("merge"), "digest", "left_semi"), "counts")
    return rows.join(known.hint("merge"), "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: The cache's folder; where it isn't set, the query makes one of its own.
CACHE_CONF = "folioworks.token_cache"


def op6_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. A cache that is new is primed by a first pass over the documents of a
    hash remainder, as an earlier delivery would have left it; then all documents are counted,
    of which those already stored aren't encoded again."""
    docs = table(spark, sf_dir, "documents")
    stored = spark.conf.get(CACHE_CONF, None)
    path = stored or scratch_path(spark, "token-cache")
    if not stored:
        store_missing(docs.where(crc_remainder("doc_id", 8) == 0), path)
    return count_tokens(docs, path)
