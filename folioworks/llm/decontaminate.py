"""Benchmark passages in documents: a prefix-filtered join on word shingles with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_names, slices, table, written
from .hashing import shingles, word_hashes

WINDOW, SHINGLE = 10, 3
#: Binary logarithms of the least and the largest number of bits of the filter over the benchmark's
#: shingles. Beyond about eight million shingles more positions pass it and go to the join.
LEAST_BITS, MOST_BITS = 16, 27
#: Hits of a text in one row of the written table.
ROW_HITS = 4096

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Each byte of a lower-cased text as itself if it belongs to a word, else as a space.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def word_column(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(WORD_PATTERN), F.lit(0))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, n, words) for each distinct window of each item of benchmark(item_id, text).

    Items with fewer words are one window of all; null and wordless texts have none."""
    items = benchmark.select("item_id", word_column(F.col("text")).alias("w")).where(F.size("w") > 0)
    return items.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.slice(F.col("w"), i, window))).alias("w"),
    ).select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("words")).distinct()


def filter_of(windows: DataFrame, window: int, shingle: int) -> tuple[np.ndarray, int, list[int]]:
    """The filter's bytes, the binary logarithm of its bits, and the short windows' lengths.

    It has a bit for each hash of a window's shingles (of a short window: of all its words),
    and sixteen bits a distinct hash, within bounds. Bitmaps are put together on the
    executors; the driver gets one of at most 2**MOST_BITS bits."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[int] = set()
            for x in batch.column("words").to_pylist():
                w = word_hashes().of(x.encode().split())
                found.update(shingles(w, shingle if len(w) == window else len(w)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["h"])

    known = written(windows.select("words").mapInArrow(hashes, "h long").distinct(), "window-hashes")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * known.count()).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    maps = known.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    mask = np.zeros(max(1, (1 << bits) // BUCKET_BITS) * (BUCKET_BITS // 8), np.uint8)
    for r in maps.collect():  # (1 << bits) / BUCKET_BITS rows at most
        at = (r["bucket"] - 1) * (BUCKET_BITS // 8)
        mask[at : at + BUCKET_BITS // 8] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    short = [r["n"] for r in windows.where(F.col("n") < window).select("n").distinct().collect()]  # lengths under the window's
    discard(known)
    return mask, bits, sorted(short)


#: Bits in each bitmap of bitmap_construct_agg.
BUCKET_BITS = 32768


def passes(mask: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    at = hashes >> np.uint64(64 - bits)
    return (mask[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


HITS = "row long, doc_id long, n_words long, is_first boolean, hits array<struct<place:int,size:int,shingle:string,ahead:int,context:string>>"
HITS_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("is_first", pa.bool_()),
    ("hits", pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32()), ("shingle", pa.string()), ("ahead", pa.int32()), ("context", pa.string())]))),
])


def shingle_hits(docs: DataFrame, mask: np.ndarray, bits: int, short: list[int], window: int, shingle: int) -> DataFrame:
    """Each row of docs with the shingles that may belong to a window lying wholly in the text; more
    rows of the same number where a text has many.

    A window's shingles lie side by side, so only those in a run of window - shingle + 1
    that all pass the filter stay (the positional bound). A hit carries the words around
    it, from `ahead` words before it, as far as a window could reach."""
    run = window - shingle + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def places(words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
            """(place, length, first word and end of the context) of each hit."""
            h, n = word_hashes().of(words), len(words)
            if n >= window:
                passed = passes(mask, bits, shingles(h, shingle))
                if passed.any():
                    total = np.concatenate(([0], np.cumsum(passed)))
                    starts = np.flatnonzero(total[run:] - total[:-run] == run)
                    edge = np.zeros(len(passed) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + run, -1)
                    for p in np.flatnonzero(np.cumsum(edge)[:-1]).tolist():
                        yield p, window, max(0, p - (window - shingle)), min(n, p + window)
            for k in short:
                if n >= k:
                    for p in np.flatnonzero(passes(mask, bits, shingles(h, k))).tolist():
                        yield p, k, p, p + k

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), HITS_ARROW)], schema=HITS_ARROW)

        for batch in batches:
            for some in slices(batch, 8_000_000):
                out, held = [], 0
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    words = words_of(text)
                    hits, is_first = [], True
                    for p, size, a, b in places(words):
                        own = words[p : p + (shingle if size == window else size)]
                        hits.append({"place": p, "size": size, "shingle": b" ".join(own).decode(), "ahead": p - a, "context": b" ".join(words[a:b]).decode()})
                        if len(hits) == ROW_HITS:
                            yield batch_of([(row, doc_id, len(words), is_first, hits)])
                            hits, is_first = [], False
                    if hits or is_first:
                        out.append((row, doc_id, len(words), is_first, hits))
                        held += len(hits)
                    row += 1
                    if held >= ROW_HITS:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    return docs.select("doc_id", "text").mapInArrow(work, HITS)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, places, windows): the input rows with a number and their words' count; where windows
    occur (row, place, n, words), each verified word by word; and the items' windows.

    A window is the set of its shingles. They are ordered by how many hits each has in the
    corpus, and as all of them must be there, the rarest one is the prefix that the join
    needs; a window one of whose shingles has no hit is nowhere. The length bound (a window lies inside the text) and the position of the shingle
    in the window give the only place where the window can be, whose words are compared."""
    windows = written(item_windows(benchmark, window), "windows")
    mask, bits, short = filter_of(windows, window, shingle)
    rows = written(shingle_hits(docs, mask, bits, short, window, shingle), "hits", compression="zstd")
    hits = rows.select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", "h.*")
    rarity = written(hits.groupBy("size", "shingle").agg(F.count(F.lit(1)).alias("hits")), "rarity")
    parts = windows.select("words", "n").distinct().withColumn("w", F.split("words", " "))
    full = F.col("n") == window
    size = F.when(full, F.lit(shingle)).otherwise(F.col("n"))
    parts = parts.select(
        "words", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))).alias("at", "shingle")
    )
    # windows are few beside the corpus; both sides of these joins can be large, so neither is broadcast
    prefix = (
        parts.join(rarity.hint("merge"), (parts.n == rarity["size"]) & (parts.shingle == rarity.shingle))
        .groupBy("words", "n")
        .agg(F.min(F.struct("hits", "at", rarity.shingle.alias("shingle"))).alias("p"), F.count(F.lit(1)).alias("parts"))
        .where(F.col("parts") == F.when(full, F.lit(window - shingle + 1)).otherwise(1))
        .select("words", "n", "p.at", "p.shingle")
    )
    prefix = written(prefix, "prefixes")
    found = hits.join(prefix.hint("merge"), (hits["size"] == prefix.n) & (hits.shingle == prefix.shingle)).where(
        (F.col("place") >= F.col("at"))
        & (F.col("place") - F.col("at") + F.col("n") <= F.col("n_words"))
        & (F.col("ahead") >= F.col("at"))
        & (F.array_join(F.slice(F.split("context", " "), F.col("ahead") - F.col("at") + 1, F.col("n")), " ") == F.col("words"))
    )
    return rows.where("is_first").drop("hits", "is_first"), found.select("row", (F.col("place") - F.col("at")).alias("place"), "n", "words"), windows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and items for each row of docs(doc_id, text).

    n_hit counts the words inside any occurrence of an item's window, items are the sorted
    ids (as text) of the items with one. Null, empty and wordless texts have 0 words; equal
    rows are counted each; an empty benchmark hits nothing; an empty table gives no rows;
    other columns are ignored. A very long text is taken whole (about 150 bytes a word) and
    its hits leave its task in parts. A window that a third of the rows hold is one join key; its
    rows are split by the adaptive join and everything after is keyed by row."""
    rows, found, windows = occurrences(docs, benchmark, window, shingle)
    found = written(found.distinct(), "places")
    covered = (
        found.select("row", F.explode(F.sequence("place", F.col("place") + F.col("n") - 1)).alias("word"))
        .distinct()
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        found.select("row", "words")
        .distinct()
        .join(windows.select("words", F.col("item_id").cast("string").alias("item")).hint("merge"), "words")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        rows.join(covered.hint("merge"), "row", "left")
        .join(named.hint("merge"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            "row",
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any window of an item, with all columns, whatever their names.

    Rows are known by a hash of doc_id and text; equal rows go or stay together. Null, empty
    and wordless texts stay; an empty table gives no rows."""
    key, gone_key = free_names(docs.columns, "row_key", "gone_key")
    digest = F.xxhash64("doc_id", "text")
    hit = contamination(docs.select(digest.alias("doc_id"), "text"), benchmark).where("n_hit > 0")
    # written out, so the join knows its size
    gone = written(hit.select(F.col("doc_id").alias(gone_key)).distinct(), "gone")
    marked = docs.withColumn(key, digest)
    return marked.join(gone, marked[key] == gone[gone_key], "left_anti").drop(key)


def op8_prefix_join_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
