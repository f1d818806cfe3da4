"""Token ids in shard files as wavelet matrices: bit planes with rank directories."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, scratch_path, slices, table, tokenizer_path
from .tokens import BYTE_BPE, encoder

#: Bits of a plane between two entries of its rank directory.
BLOCK = 512
#: Tokens after which a shard is closed (at the end of a document).
SHARD_TOKENS = 1 << 20

SHARDS = (
    "part int, seq int, part_start long, n_tokens long, bits int, doc_ids array<long>, lengths array<int>, "
    "planes array<binary>, ranks array<binary>, zeros array<long>"
)


class WaveletMatrix:
    """planes[0] holds the highest bit of each token in text order; below each plane the
    tokens lie with those of bit 0 first, in stable order. ranks[k][b] counts the ones of
    plane k before bit b * BLOCK."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def of(cls, tokens: np.ndarray, bits: int) -> "WaveletMatrix":
        a = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for k in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << k)) != 0
            packed = np.packbits(one)
            padded = np.zeros(-(-len(a) // BLOCK) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            counts = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            planes.append(padded)
            ranks.append(np.concatenate(([0], np.cumsum(counts, dtype=np.uint32))).astype("<u4"))
            low, high = a.take(np.flatnonzero(~one)), a.take(np.flatnonzero(one))
            zeros.append(len(low))
            a = np.concatenate((low, high))
        return cls(len(tokens), planes, ranks, zeros)

    @classmethod
    def stored(cls, row: dict) -> "WaveletMatrix":
        return cls(row["n_tokens"], [np.frombuffer(x, np.uint8) for x in row["planes"]], [np.frombuffer(x, "<u4") for x in row["ranks"]], row["zeros"])

    def tokens(self) -> np.ndarray:
        """All tokens in order, from the lowest plane up."""
        bits = len(self.planes)
        a = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for k, (plane, zero) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one = np.unpackbits(plane, count=self.n).view(bool) if self.n else np.zeros(0, bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~one)] = a[:zero]
            up[np.flatnonzero(one)] = a[zero:] | a.dtype.type(1 << k)
            a = up
        return a

    def ones(self, level: int, i: int) -> int:
        """Ones of a plane before bit i."""
        block, rest = divmod(i, BLOCK)
        at = block * (BLOCK // 8)
        n = int(self.ranks[level][block])
        n += int(np.bitwise_count(self.planes[level][at : at + rest // 8]).sum())
        if rest % 8:
            n += (int(self.planes[level][at + rest // 8]) >> (8 - rest % 8)).bit_count()
        return n

    def nth(self, level: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of that kind in a plane."""
        starts = np.arange(len(self.ranks[level]), dtype=np.int64) * BLOCK
        before = self.ranks[level].astype(np.int64) if bit else starts - self.ranks[level]
        block = int(np.searchsorted(before, j, side="right")) - 1
        at = block * (BLOCK // 8)
        found = np.flatnonzero(np.unpackbits(self.planes[level][at : at + BLOCK // 8]) == bit)
        return block * BLOCK + int(found[j - int(before[block])])

    def access(self, i: int) -> int:
        token = 0
        for level in range(len(self.planes)):
            bit = (int(self.planes[level][i >> 3]) >> (7 - i % 8)) & 1
            token = token << 1 | bit
            one = self.ones(level, i)
            i = self.zeros[level] + one if bit else i - one
        return token

    def span(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences before place i lie below the last plane."""
        low, high, bits = 0, i, len(self.planes)
        if token >> bits:
            return 0, 0
        for level in range(bits):
            a, b = self.ones(level, low), self.ones(level, high)
            if token >> (bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before place i."""
        low, high = self.span(token, i)
        return high - low

    def select(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of token; there must be one."""
        at = self.span(token, self.n)[0] + j
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self.nth(level, bit, at - self.zeros[level] if bit else at)
        return at


def write_shards(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the token ids of docs(doc_id, text), each followed by end_id, to shard files under path.

    One file a shard: a zstd-compressed Parquet file of one row with the wavelet matrix, its
    rank directories, and the documents' ids and lengths. Documents lie in ascending doc_id
    (null first; equal ids by a digest of the text), range-partitioned; a partition's shards are numbered and
    know the tokens before them in it, so the parts' totals give global places. A null or
    empty text is end_id alone, equal rows are stored each, an empty table writes no shard,
    and other columns are ignored. Texts are shuffled once. A document stays in one shard, so
    a very long text, which is taken whole, makes its shard as long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        bits = max(1, (max(len(enc.widths) - 1, end_id)).bit_length())
        end = np.asarray([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        names: list[int | None] = []
        chunks: list[bytes] = []
        seq = held = before = 0

        def shard() -> pa.RecordBatch:
            nonlocal names, chunks, seq, held, before
            w = WaveletMatrix.of(np.frombuffer(b"".join(chunks), "<u4"), bits)
            row = {
                "part": part, "seq": seq, "part_start": before, "n_tokens": held, "bits": bits, "doc_ids": names,
                "lengths": [len(x) // 4 for x in chunks], "planes": [x.tobytes() for x in w.planes],
                "ranks": [x.tobytes() for x in w.ranks], "zeros": w.zeros,
            }
            names, chunks, seq, before, held = [], [], seq + 1, before + held, 0
            return pa.RecordBatch.from_pylist([row], SHARD_ARROW)

        for batch in batches:
            for some in slices(batch, 4_000_000):
                texts = [x or "" for x in some.column("text").to_pylist()]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), enc.encode(texts)):
                    names.append(doc_id)
                    chunks.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= shard_tokens:
                        yield shard()
        if chunks:
            yield shard()

    # a hot id's rows are dealt by a digest of their texts; of rows alike in both the texts decide
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).repartitionByRange(partitions(docs.sparkSession), *order)
    shards = rows.sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select("doc_id", "text").mapInArrow(work, SHARDS)
    # bit planes hardly shrink further at a higher level
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path)


SHARD_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("bits", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary())),
    ("ranks", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64())),
])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `start`, the tokens of all shards before them. The join's small side has a row a part."""
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("ahead"))
    return shards.join(F.broadcast(offsets), "part").withColumn("start", F.col("ahead") + F.col("part_start")).drop("ahead")


def _decoded(spark: SparkSession, path: str, kinds: dict[str, pa.DataType], columns: Callable[[np.ndarray, list[int], list[int]], list[list]]) -> DataFrame:
    """doc_id, start and the columns that a function makes of a shard's ids and its documents' starts and ends in it."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids = WaveletMatrix.stored(row).tokens().astype("<u4")
                ends = np.cumsum(np.asarray(row["lengths"], np.int64))
                starts = ends - row["lengths"]
                made = columns(ids, starts.tolist(), ends.tolist())
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"], pa.int64()), *(pa.array(x, k) for x, k in zip(made, kinds.values()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", *kinds])

    kept = read_shards(spark, path).select("start", "n_tokens", "doc_ids", "lengths", "planes", "ranks", "zeros")
    return kept.mapInArrow(decode, ", ".join(["doc_id long, start long", *(f"{c} {'binary' if k == pa.binary() else 'long'}" for c, k in kinds.items())]))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit) of each document, decoded from the planes."""
    return _decoded(spark, path, {"ids": pa.binary()}, lambda ids, starts, ends: [[ids[a:b].tobytes() for a, b in zip(starts, ends)]])


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the planes; the ids stay in the tasks."""
    of = lambda ids, starts, ends: [[b - a for a, b in zip(starts, ends)], [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]]
    return _decoded(spark, path, {"n_tokens": pa.int64(), "ids_crc32": pa.int64()}, of)


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Global places of a token, by select on each shard's planes; no shard is decoded."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                w = WaveletMatrix.stored(row)
                places = [row["start"] + w.select(token, j) for j in range(w.rank(token, w.n))]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], ["place"])

    kept = read_shards(spark, path).select("start", "n_tokens", "planes", "ranks", "zeros")
    return kept.mapInArrow(look, "place long")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """(place, token) of the given global places, by access on the planes of the shards that hold them."""
    # which shards hold a place is known before their planes are read
    ends = read_shards(spark, path).select("part", "seq", "start", "n_tokens")
    wanted = F.exists(F.array(*[F.lit(int(p)).cast("long") for p in places]), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
    own = ends.where(wanted).select("part", "seq", "start").collect() if places else []  # a row a place at most
    # plain comparisons, which reach the files' statistics
    held_by = reduce(lambda a, b: a | b, [(F.col("part") == r["part"]) & (F.col("seq") == r["seq"]) for r in own], F.lit(False))
    starts = {(r["part"], r["seq"]): r["start"] for r in own}
    shards = spark.read.schema(SHARDS).parquet(path)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                w, start = WaveletMatrix.stored(row), starts[row["part"], row["seq"]]
                held = [p for p in places if start <= p < start + w.n]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([w.access(p - start) for p in held], pa.int64())], ["place", "token"])

    kept = shards.where(held_by).select("part", "seq", "n_tokens", "planes", "ranks", "zeros")
    return kept.mapInArrow(look, "place long, token long")


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), path)
    return document_digests(spark, path)
