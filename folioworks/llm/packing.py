"""Packing of documents into near-equal token windows by multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tokenizer_path
from .tokens import BYTE_BPE, encoder

CAPACITY = 1024
#: Windows' worth of remainders that are differenced at a time, and the longest piece of a remainder.
GROUP_WINDOWS, PIECE = 64, 256

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp for `windows` parts: the indexes of sizes in each part.

    Each item starts as a partition with one full part. The two partitions with the largest
    spreads are merged, the largest part of one with the smallest of the other, until one
    partition is left."""
    heap = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [(n, i, None)] + [(0, -1, None)] * (windows - 1)))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = [
            (x[0] + y[0], -2, (x, y)) if x[1] != -1 and y[1] != -1 else (x if y[1] == -1 else y)
            for x, y in zip(a, reversed(b))
        ]
        merged.sort(key=lambda part: -part[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], tie, merged))
        tie += 1
    parts = []
    for top in heap[0][2] if heap else []:
        items, stack = [], [top]
        while stack:
            _, i, below = stack.pop()
            if below:
                stack += below
            elif i >= 0:
                items.append(i)
        parts.append(items)
    return parts


def equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows; their count starts at the least possible and rises while one is over capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = [x for x in differenced(sizes, windows) if x]
        if all(sum(sizes[i] for i in x) <= capacity for x in parts):
            return parts
        windows += 1


def pack(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, end_id: int = 0, group_windows: int = GROUP_WINDOWS, piece: int = PIECE
) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of at most `capacity` tokens.

    A document is its token ids and end_id (a null or empty text: end_id alone). Its whole
    multiples of capacity are sequences of their own; its remainder is cut into pieces of
    at most `piece` tokens, and about group_windows windows' worth of pieces at a time are
    spread over near-equal windows. The work follows the input partitions, without any
    shuffle; a sequence's number holds the partition's. Equal rows are packed each; an empty
    table gives no rows; other columns are ignored. A very long text is encoded whole, at
    about 100 bytes a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        end = np.asarray([end_id], "<u4").tobytes()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        waiting: list[tuple] = []
        held = 0
        out: list[tuple] = []

        def settle() -> None:
            nonlocal sequence, held, waiting
            for part in equal_windows([x[2] for x in waiting], capacity):
                offset = 0
                for i in sorted(part):
                    doc_id, start, length, total, ids = waiting[i]
                    out.append((doc_id, start, length, total, sequence, offset, ids))
                    offset += length
                sequence += 1
            waiting, held = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in columns[:6]), pa.array(columns[6], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in batches:
            for some in slices(batch, 4_000_000):
                texts = [x or "" for x in some.column("text").to_pylist()]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), enc.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    full = total - total % capacity
                    for start in range(0, full, capacity):
                        out.append((doc_id, start, capacity, total, sequence, 0, ids[4 * start : 4 * (start + capacity)]))
                        sequence += 1
                    for start in range(full, total, piece):
                        length = min(piece, total - start)
                        waiting.append((doc_id, start, length, total, ids[4 * start : 4 * (start + length)]))
                        held += length
                    if held >= group_windows * capacity - capacity // 2:
                        settle()
                if out:
                    yield batch_of(out)
                    out = []
        if waiting:
            settle()
        if out:
            yield batch_of(out)

    return docs.select("doc_id", "text").mapInArrow(work, PIECES)


def op4_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def packed_digest(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
