"""Language by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, crc_remainder, slices, table
from .hashing import STEP, mixed, worker_memo

BUCKETS, WIDTH = 1 << 15, 16
#: At most about this many labelled texts of each language are learned from (chosen by a hash of the id).
TEXTS_PER_LANGUAGE = 500
#: More languages than this aren't learned; bytes of a worker's memo of words' gains.
MOST_LANGUAGES, MEMO_BYTES = 200, 16_000_000
UNKNOWN = "und"

NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(word: str) -> str:
    """The letters of a word in lower case."""
    low = word.lower()
    if not low.isalpha():
        low = NO_LETTERS.sub("", low)
        if low and not low.isalpha():
            low = "".join(c for c in low if c.isalpha())
    return low


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' subwords, word after word, and how many each word has.

    A word's letters with its ends marked give all their 2- to 4-grams and one subword for
    the whole; a word without letters has none."""
    marked = [f"<{x}>" if x else "" for x in map(letters_of, words)]
    sizes = np.array([len(x) for x in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)[owner]
    place = np.arange(len(codes))
    found, owners = [], []
    with np.errstate(over="ignore"):
        for k in (2, 3, 4):
            h = np.full(max(0, len(codes) - k + 1), k, np.uint64)
            for i in range(k):
                h = mixed(h * STEP + codes[i : len(codes) - k + 1 + i])
            fits = place[: len(h)] + k <= ends[: len(h)]
            found.append(h[fits])
            owners.append(owner[: len(h)][fits])
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            inside = (place - (ends - sizes[owner])).astype(np.uint64)
            found.append(mixed(np.add.reduceat(mixed(codes + inside * STEP), starts)))
            owners.append(some)
    all_owners = np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(all_owners, minlength=len(words))


@dataclass
class LanguageModel:
    languages: list[str]
    #: Each bucket's embedding times the softmax weights: what it adds to each language.
    gains: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over (language, buckets, counts); every fifth row calibrates.

    The temperature has the least log loss on the calibration rows, and reject_below is the
    first percentile of the scores of those that are right, 0.5 at most."""
    languages = sorted({x[0] for x in rows})
    place = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    inner = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    outer, bias = np.zeros((len(languages), WIDTH)), np.zeros(len(languages))
    order = rng.permutation(len(rows))
    checks = [rows[i] for i in order[::5]] if len(rows) >= 50 else rows
    learned = [rows[i] for j, i in enumerate(order) if j % 5 or len(rows) < 50]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(learned)):
            language, buckets, counts = learned[i]
            weights = counts / counts.sum()
            mean = weights @ inner[buckets]
            p = softmax(outer @ mean + bias)
            p[place[language]] -= 1
            back = p @ outer
            outer -= step * np.outer(p, mean)
            bias -= step * 0.1 * p
            inner[buckets] -= step * len(languages) * weights[:, None] * back
    z = np.array([outer @ ((c / c.sum()) @ inner[b]) + bias for _, b, c in checks]).reshape(len(checks), len(languages))
    truth = np.array([place[x[0]] for x in checks], int)
    losses = {t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in (0.1, 0.2, 0.35, 0.5, 0.7, 1, 1.4, 2)} if len(checks) else {1: 0}
    temperature = min(losses, key=losses.get)
    right = softmax(z / temperature).max(axis=1)[z.argmax(axis=1) == truth] if len(checks) else np.zeros(0)
    reject = min(0.5, float(np.quantile(right, 0.01))) if len(right) else 0.0
    return LanguageModel(languages, (inner @ outer.T).astype(np.float32), bias, float(temperature), reject)


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, buckets, counts) of each text with a letter."""
    for batch in batches:
        for some in slices(batch, 1_000_000):
            names, places, numbers = [], [], []
            for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                words = Counter((text or "").split())
                if not words:
                    continue
                buckets, sizes = subwords(list(words))
                counts = np.bincount(buckets, np.repeat(list(words.values()), sizes), BUCKETS)
                own = np.flatnonzero(counts)
                if len(own):
                    names.append(lang)
                    places.append(own.astype(np.int32))
                    numbers.append(counts[own].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, kind), pa.array(numbers, kind)], ["lang", "buckets", "counts"])


def learn(docs: DataFrame, usable: Column, per_language: int = TEXTS_PER_LANGUAGE) -> LanguageModel:
    """A model from the rows of docs(doc_id, text, lang) that are usable and have a language.

    Each language gives about per_language rows at most, those with the smallest hashes of
    doc_id and text, each distinct one once, which bounds what reaches the driver (a text
    has BUCKETS numbers at most); their subwords are counted on the executors. More than
    MOST_LANGUAGES languages are an error. Null texts and null languages teach nothing; an
    empty table gives a model without languages."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = {r["lang"]: r["n"] for r in found}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, -(-per_language * 1_000_000 // n)))])
    some = rows.where(draw < share[F.col("lang")]).dropDuplicates(["doc_id", "text", "lang"]).select("lang", "text")
    # as Arrow, so the driver holds numbers and no objects
    got = some.mapInArrow(bucket_counts, "lang string, buckets array<int>, counts array<int>").toArrow().combine_chunks()
    texts = []
    for part in got.to_batches():
        lists = [part.column(c) for c in ("buckets", "counts")]
        ends = lists[0].offsets.to_numpy()
        flat = [x.values.to_numpy() for x in lists]
        for lang, i, j in zip(part.column("lang").to_pylist(), ends[:-1], ends[1:]):
            texts.append((lang, *(x[i:j] for x in flat)))
    return train(sorted(texts, key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes())))


PREDICTED = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str, str] = PREDICTED) -> DataFrame:
    """docs' columns `keep` with lang_pred, score and rejected (under these `names`) for each whole text.

    score is the calibrated probability of lang_pred. A null text, one without a letter, or
    a model without languages gives `und`, 0.0 and rejected; a score under the model's
    calibrated bound is rejected as well. Equal texts get equal results; an empty table
    gives no rows. A very long text is taken whole; its words take about 100 bytes each. No
    shuffle."""
    inner = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[column(c).alias(x) for c, x in zip(keep, inner)], F.col("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.languages)
        most = max(1000, min(200_000, MEMO_BYTES // (8 * (n + 1))))
        places, rows = worker_memo(object(), lambda: ({}, np.zeros((most, n + 1))))
        for batch in batches:
            for some in slices(batch, 2_000_000):
                split = [(x or "").split() for x in some.column("text").to_pylist()]
                fresh = list(set().union(*split).difference(places))
                if len(places) + len(fresh) > len(rows):
                    places.clear()
                    fresh = list(set().union(*split))
                    if len(fresh) > len(rows):
                        rows = np.zeros((len(fresh), n + 1))
                if fresh:
                    buckets, sizes = subwords(fresh)
                    more = rows[len(places) : len(places) + len(fresh)]
                    more[:] = 0
                    own = np.flatnonzero(sizes)
                    if len(own):
                        more[own, :n] = np.add.reduceat(model.gains[buckets], (np.cumsum(sizes) - sizes)[own], axis=0)
                        more[own, n] = sizes[own]
                    places.update(zip(fresh, range(len(places), len(places) + len(fresh))))
                found, scores, rejected = [], [], []
                for words in split:
                    total = rows[np.fromiter(map(places.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    if total[n] and n:
                        p = softmax((total[:n] / total[n] + model.bias) / model.temperature)
                        found.append(model.languages[int(p.argmax())])
                        scores.append(float(p.max()))
                        rejected.append(bool(p.max() < model.reject_below))
                    else:
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        rejected.append(True)
                kept = [some.column(c) for c in inner]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*inner, *PREDICTED])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    fields = [T.StructField(x, docs.schema[c].dataType) for c, x in zip(keep, inner)] + [T.StructField(x, k) for x, k in zip(PREDICTED, kinds)]
    found = source.mapInArrow(work, T.StructType(fields))
    return found.select(*[F.col(x).alias(c) for c, x in zip(keep, inner)], *[F.col(x).alias(name) for x, name in zip(PREDICTED, names)])


def op9_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder("doc_id", 4) == 2
    model = learn(docs, ~held_out)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
