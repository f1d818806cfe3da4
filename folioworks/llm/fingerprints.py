"""Threshold-scaled sketches of documents' word shingles."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, slices, table
from .hashing import shingles, word_hashes

SHINGLE, FRACTION = 5, 1 / 2
#: Blocks of rows to a partition.
BLOCKS = 4
TOP = (1 << 63) - 1


class Sketch:
    """The fingerprint: all distinct shingle hashes up to a fixed fraction of the range, whatever the
    text's length; of a text with none under it, its least hash, so that it isn't empty.

    The sketch of a union is made of the sketches alone, exactly. A likeness or containment
    p is estimated from the n hashes under the fraction that it is a share of, with a
    standard error of sqrt(p * (1 - p) / n): at most 0.16 for ten hashes, 0.05 for a hundred, 0.016 for a thousand."""

    def __init__(self, hashes: np.ndarray, limit: int):
        self.hashes, self.limit = hashes, limit

    @classmethod
    def cut(cls, every: np.ndarray, limit: int) -> "Sketch":
        """From ascending distinct hashes."""
        n = int(np.searchsorted(every, limit, side="right"))
        return cls(every[: max(1, n)], limit)

    @classmethod
    def of(cls, text: str, size: int = SHINGLE, fraction: float = FRACTION) -> "Sketch":
        every = np.unique(shingles(word_hashes().of(text.split()), size) >> np.uint64(1)).astype(np.int64)
        return cls.cut(every, int(fraction * TOP))

    @property
    def main(self) -> np.ndarray:
        """The hashes under the fraction."""
        return self.hashes[: np.searchsorted(self.hashes, self.limit, side="right")]

    def text(self) -> str:
        """The fraction's bound, a colon and the hashes."""
        return f"{self.limit:016x}:{base64.b64encode(self.hashes.astype('<i8').tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> "Sketch":
        limit, hashes = text.split(":")
        return cls(np.frombuffer(base64.b64decode(hashes), "<i8"), int(limit, 16))

    def merged(self, other: "Sketch") -> "Sketch":
        """The sketch of the union of the two texts' shingles; both have the same fraction."""
        return Sketch.cut(np.union1d(self.hashes, other.hashes), self.limit)

    def shared(self, other: "Sketch") -> tuple[int, int, int]:
        """Hashes under the fraction of this, of the other and of both; where neither has any, their least hashes count."""
        a, b = self.main, other.main
        if not len(a) and not len(b):
            a, b = self.hashes, other.hashes
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))

    def likeness(self, other: "Sketch") -> float:
        """Estimated Jaccard similarity; 1 for two texts without words."""
        a, b, both = self.shared(other)
        return both / (a + b - both) if a + b else 1.0

    def containment(self, other: "Sketch") -> float | None:
        """Estimated share of this text's shingles that the other holds; 1 for a text without
        words, None where this text has no hash under the fraction and the other has some."""
        a, _, both = self.shared(other)
        return both / a if a else None if len(self.hashes) else 1.0


def fingerprints(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs(doc_id, text), without a shuffle. A null text is an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prints = [Sketch.of(x or "", size, fraction).text() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fingerprint string")


@F.pandas_udf(T.DoubleType())
def containment(a: pd.Series, b: pd.Series) -> pd.Series:
    """Estimated share of the first fingerprint's shingles that the second holds; null where they don't tell."""
    return pd.Series([Sketch.parse(x).containment(Sketch.parse(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def merged(a: pd.Series, b: pd.Series) -> pd.Series:
    """Fingerprint of two documents' union from their fingerprints."""
    return pd.Series([Sketch.parse(x).merged(Sketch.parse(y)).text() for x, y in zip(a, b)], dtype="object")


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, its edited text's, and their likeness and that to the next row's.

    Rows lie in ascending doc_id (null first, equal ids by a digest of the text); after the
    last comes the first. The edited text has the last floor(n/2) code points replaced by the
    first as many of the next text. Rows go to blocks between quantiles of doc_id, an id that
    spans several blocks to parts of its digests' range; a pass without texts finds each
    block's first row, which goes to the block before as well, where it only serves as a
    next text. So each text is shuffled once, and a block streams through its task.

    A null text is an empty one, equal rows follow each other, a single row follows itself,
    an empty table gives no rows, and other columns are ignored. A very long text is taken
    whole; its task needs about 150 bytes a word."""
    n_parts = partitions(docs.sparkSession)
    blocks = BLOCKS * n_parts
    found = docs.agg(
        F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], max(10_000, 20 * blocks)).alias("cuts"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    # null ids come first: as many cuts among them as their share of the rows asks for
    null_blocks = -(-blocks * found["nulls"] // max(1, found["rows"]))
    ids = np.asarray(found["cuts"] or [], np.int64)
    if found["nulls"] and len(ids):
        ids = ids[:: max(1, blocks // max(1, blocks - null_blocks))]
    again = np.arange(len(ids)) - np.searchsorted(ids, ids, side="left")
    times = np.searchsorted(ids, ids, side="right") - np.searchsorted(ids, ids, side="left")
    # the k-th of n cuts at one id lies at k/n of the digests' range
    digests = np.array([-(1 << 63) + int(k) * ((1 << 64) // int(n)) for k, n in zip(again, times)], np.int64)
    null_cuts = np.array([-(1 << 63) + k * ((1 << 64) // max(1, null_blocks)) for k in range(1, null_blocks)], np.int64)
    ahead = len(null_cuts) + 1 if found["nulls"] else 0

    @F.pandas_udf("int")
    def block_of(doc_ids: pd.Series, texts: pd.Series) -> pd.Series:
        known = doc_ids.notna().to_numpy()
        values = doc_ids.fillna(0).astype("int64").to_numpy()
        digest = texts.to_numpy(np.int64)
        block = np.searchsorted(ids, values, side="left")
        for i in np.flatnonzero(np.append(ids, 0)[block] == values).tolist() if len(ids) else ():
            first = int(block[i])
            if first < len(ids):
                block[i] = first + np.searchsorted(digests[first : first + int(times[first])], digest[i], side="right")
        return pd.Series(np.where(known, block + ahead, np.searchsorted(null_cuts, digest, side="right")).astype("int32"))

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    keyed = keyed.withColumn("block", block_of("doc_id", "digest"))
    firsts = keyed.groupBy("block").agg(F.min(F.struct(F.col("doc_id"), F.col("digest"))).alias("key")).orderBy("block").collect()  # a row a block
    before = {(r["key"]["doc_id"], r["key"]["digest"]): firsts[i - 1]["block"] for i, r in enumerate(firsts)}

    @F.pandas_udf("int")
    def block_before(doc_ids: pd.Series, texts: pd.Series) -> pd.Series:
        keys = zip(doc_ids.astype(object).where(doc_ids.notna(), None), texts)
        return pd.Series([before.get((None if x is None else int(x), int(y)), -1) for x, y in keys], dtype="int32")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        at = None
        for batch in batches:
            for some in slices(batch, 8_000_000):
                rows: list[tuple] = []
                for block, guest, doc_id, text in zip(*(some.column(c).to_pylist() for c in ("block", "guest", "doc_id", "text"))):
                    if block != at:
                        at, last = block, None
                    elif guest and last is None:
                        continue
                    text = text or ""
                    own = Sketch.of(text)
                    if last is not None:
                        old_id, old, print_ = last
                        n = len(old)
                        edited = old[: n - n // 2] + text[: n // 2]
                        changed = Sketch.of(edited)
                        rows.append((
                            old_id, n, hashlib.sha256(edited.encode()).hexdigest(), print_.text(), changed.text(),
                            print_.likeness(changed), print_.likeness(own),
                        ))
                    last = None if guest else (doc_id, text, own)
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in COMPARED.split(", ")])

    own = F.struct(F.col("block"), F.lit(False).alias("guest"))
    also = F.struct(F.col("before").alias("block"), F.lit(True).alias("guest"))
    copies = keyed.withColumn("before", block_before("doc_id", "digest"))
    copies = copies.select("doc_id", "text", "digest", F.explode(F.when(F.col("before") >= 0, F.array(own, also)).otherwise(F.array(own))).alias("to"))
    copies = copies.select("to.block", "to.guest", "doc_id", "text", "digest")
    order = ["block", "guest", F.col("doc_id").asc_nulls_first(), "digest", F.col("text").asc_nulls_first()]
    whole = ahead + len(ids) + 1
    dealt = copies.repartitionById(n_parts, F.least(F.lit(n_parts - 1), (F.col("block") * n_parts / whole).cast("int")))
    return dealt.sortWithinPartitions(*order).mapInArrow(work, COMPARED)


def op1_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))
