"""A hidden Markov language model: Baum-Welch over all partitions, scaled forward scores.

A token's class is its own for the most frequent words and a hash of its ending for the
rest; a state emits a class, and a class its words by their smoothed counts. The words'
part doesn't depend on the state, so what is trained and broadcast has a fixed size (states
times classes) while the words' counts stay a table that grows with the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, slices, table, written

STATES, ROUNDS = 6, 5
#: Class 0 is the end; then come the most frequent words, then endings by hash.
FREQUENT, ENDINGS = 511, 512
CLASSES = 1 + FREQUENT + ENDINGS
#: Bytes of text whose words share one local vocabulary.
BLOCK_BYTES = 16_000_000
#: Tokens of a chunk, of which a text is made for the recursions; steps between rescalings.
SEGMENT, RESCALE = 128, 8
BATCH = 2048

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, words array<binary>, counts array<int>"
BLOCKS_ARROW = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
    ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())),
])
TEXTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, words_score double, classes binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


class Places(dict):
    """A number for each new key, from 0."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, held_out) as blocks: one row with its texts as numbers of the block's
    own words (compressed), and these words with their counts in its training texts. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        places, ids, names, held, size = Places(), [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal places, ids, names, held, size, number
            counts = np.zeros(len(places), np.int64)
            for x, out in zip(ids, held):
                if not out:
                    np.add.at(counts, x, 1)
            row = {
                "block": number, "doc_ids": names, "held": held, "lengths": [len(x) for x in ids], "ids": zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in ids)),
                "words": list(places), "counts": counts.tolist(),
            }
            places, ids, names, held, size, number = Places(), [], [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], BLOCKS_ARROW)

        for batch in batches:
            for some in slices(batch, block_bytes):
                for doc_id, text, out in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))):
                    words = words_of(text)
                    ids.append(np.fromiter(map(places.__getitem__, words), "<i4", len(words)))
                    names.append(doc_id)
                    held.append(bool(out))
                    size += len(text or "")
                    if size >= block_bytes:
                        yield block()
        if names:
            yield block()

    return docs.select("doc_id", "text", "held_out").mapInArrow(work, BLOCKS)


@dataclass
class Counts:
    """What the scores need of the corpus besides the words' own counts; of a fixed size."""

    train_texts: int
    train_tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray


def word_counts(cut: DataFrame) -> tuple[DataFrame, DataFrame, Counts]:
    """(vocabulary, counts, totals): each block's words (block, id, word), and each word's count and class."""
    vocabulary = cut.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("id", "w")).select(
        "block", "id", F.col("w.words").alias("word"), F.col("w.counts").alias("n")
    )
    sums = written(vocabulary.groupBy("word").agg(F.sum("n").alias("c")), "words")
    spark = cut.sparkSession
    frequent = sums.where(F.col("c") > 0).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    # FREQUENT rows at most
    own = spark.createDataFrame([(bytes(r["word"]), i + 1) for i, r in enumerate(frequent)], "word binary, own int")
    ending = F.lit(1 + FREQUENT) + F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(ENDINGS))
    counts = sums.join(F.broadcast(own), "word", "left").select("word", "c", F.coalesce("own", ending).cast("int").alias("class"))
    texts = cut.select(F.sum(F.size(F.filter("held", lambda x: ~x))).alias("n")).first()["n"] or 0
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect():
        tokens[r["class"]], words[r["class"]] = r["c"], r["v"]
    tokens[0], words[0] = texts, texts > 0
    return vocabulary, counts, Counts(texts, int(tokens.sum()), int(words.sum()), tokens, words)


def classed_texts(cut: DataFrame, vocabulary: DataFrame, counts: DataFrame, totals: Counts) -> DataFrame:
    """Each text with its unigram score, the words' part of the model's score, and its tokens' classes.

    The counts come to each block once for each of its words, not once a token. Both sides
    of both joins grow with the corpus; a word is in a block's vocabulary once, so the most
    frequent word has one row a block."""
    found = vocabulary.join(counts.hint("merge"), "word").select(F.col("block").alias("in_block"), "id", "c", "class")
    whole = totals.train_tokens + 0.5 * (totals.distinct + 1)
    share = totals.class_tokens + 0.5 * (totals.class_words + 1)

    def work(block: pa.Table, words: pa.Table) -> pa.Table:
        count, kind = np.zeros(words.num_rows), np.zeros(words.num_rows, np.int64)
        at = words.column("id").to_numpy()
        count[at], kind[at] = words.column("c").to_numpy(), words.column("class").to_numpy()
        base = np.log10((count + 0.5) / whole)
        inside = np.where(kind > FREQUENT, np.log10((count + 0.5) / share[kind]), 0.0)
        end_base = float(np.log10((totals.train_texts + 0.5) / whole))
        rows = []
        for row in block.to_pylist():
            ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"]), "<i4")
            begin = 0
            for doc_id, out, n in zip(row["doc_ids"], row["held"], row["lengths"]):
                own = ids[begin : begin + n]
                begin += n
                rows.append((
                    doc_id, out, n + 1, int((count[own] > 0).sum()) + (totals.train_texts > 0), float(base[own].sum()) + end_base,
                    float(inside[own].sum()), np.append(kind[own], 0).astype("<u2").tobytes(),
                ))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=[x.split()[0] for x in TEXTS.split(", ")])

    by_block = cut.select("block", "doc_ids", "held", "lengths", "ids").groupBy("block")
    return by_block.cogroup(found.groupBy("in_block")).applyInArrow(work, TEXTS)


def lined_up(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts side by side, longest first: their order, the classes at each step, and how many parts reach it."""
    lengths = np.array([len(x) for x in parts])
    order = np.argsort(-lengths, kind="stable")
    kinds = np.zeros((int(lengths.max()), len(parts)), np.int64)
    for j, i in enumerate(order):
        kinds[: lengths[i], j] = parts[i]
    live = np.searchsorted(-lengths[order], -np.arange(len(kinds)), side="left")
    return order, kinds, live


@dataclass
class Chunks:
    """Texts of classes, cut after their first token into chunks: the chunks, each one's text and
    place in it, the log10 of each product's scale, and the products of their steps."""

    parts: list[np.ndarray]
    first: np.ndarray
    products: np.ndarray
    powers: np.ndarray

    def waves(self, backward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(texts, chunks): for each place in order the texts that have a chunk there, and these chunks."""
        n = np.diff(self.first)
        steps = range(int(n.max()) if len(n) else 0)
        for step in reversed(steps) if backward else steps:
            own = np.flatnonzero(n > step)
            yield own, self.first[own] + step


@dataclass
class Hmm:
    """start: of a text; move[i, j]; emit[i, class]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, class_tokens: np.ndarray, states: int, seed: int = 11) -> "Hmm":
        rng = np.random.default_rng(seed)
        emit = (class_tokens + 0.5) * np.exp(rng.normal(0, 0.7, (states, len(class_tokens))))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + (0.9 - 0.1 / max(1, states - 1)) * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def of(cls, sums: np.ndarray, states: int) -> "Hmm":
        """From expected counts, each smoothed by a small constant."""
        k, c = states, (len(sums) - states - states * states) // states
        start, move, emit = np.split(sums, np.cumsum([k, k * k]))
        start, move, emit = start + 0.5, move.reshape(k, k) + 0.5, emit.reshape(k, c) + 0.05
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def chunks(self, texts: list[np.ndarray]) -> Chunks:
        """Each chunk's product of steps is a states by states matrix; chunks run side by side."""
        k = len(self.start)
        emit = np.ascontiguousarray(self.emit.T)
        parts = [x[s : s + SEGMENT] for x in texts for s in range(1, len(x), SEGMENT)]
        first = np.concatenate(([0], np.cumsum([-(-(len(x) - 1) // SEGMENT) for x in texts], dtype=np.int64)))
        products, powers = np.zeros((len(parts), k, k)), np.zeros(len(parts))
        for low in range(0, len(parts), BATCH):
            order, kinds, live = lined_up(parts[low : low + BATCH])
            m = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
            power = np.zeros(len(order))
            for t, n in enumerate(live):
                m[:n] = (m[:n].reshape(-1, k) @ self.move).reshape(n, k, k) * emit[kinds[t, :n]][:, None, :]
                if t % RESCALE == RESCALE - 1 or t == len(live) - 1:
                    top = m.max(axis=(1, 2))
                    m /= top[:, None, None]
                    power += np.log10(top)
            products[low + order], powers[low + order] = m, power
        return Chunks(parts, first, products, powers)

    def expected(self, texts: list[np.ndarray]) -> np.ndarray:
        """Expected counts over whole texts of classes by scaled forward and backward recursion.

        The chunks' products carry the forward state into each chunk and the backward state
        out of it, so every count is that of its whole text; inside, the chunks of all texts
        run side by side."""
        k = len(self.start)
        cut = self.chunks(texts)
        emit = np.ascontiguousarray(self.emit.T)
        heads = np.array([x[0] for x in texts])
        into, out = np.zeros((len(cut.parts), k)), np.zeros((len(cut.parts), k))
        ahead = self.start * emit[heads]
        ahead /= ahead.sum(axis=1, keepdims=True)
        begun = ahead.copy()
        for own, at in cut.waves():
            into[at] = ahead[own]
            s = np.einsum("ni,nij->nj", ahead[own], cut.products[at])
            ahead[own] = s / s.sum(axis=1, keepdims=True)
        behind = np.ones((len(texts), k))
        for own, at in cut.waves(backward=True):
            out[at] = behind[own]
            s = np.einsum("nij,nj->ni", cut.products[at], behind[own])
            behind[own] = s / s.sum(axis=1, keepdims=True)
        gamma = begun * behind
        gamma /= gamma.sum(axis=1, keepdims=True)
        start, move = gamma.sum(axis=0), np.zeros((k, k))
        counts = np.stack([np.bincount(heads, gamma[:, i], self.emit.shape[1]) for i in range(k)])
        for low in range(0, len(cut.parts), BATCH):
            order, kinds, live = lined_up(cut.parts[low : low + BATCH])
            a = into[low + order]
            alphas = [a]
            for t, n in enumerate(live):
                a = (a[:n] @ self.move) * emit[kinds[t, :n]]
                a /= a.sum(axis=1, keepdims=True)
                alphas.append(a)
            ends = out[low + order]
            b = ends[:0]
            gammas = []
            for t in range(len(live) - 1, -1, -1):
                n = live[t]
                if len(b) < n:
                    b = np.concatenate((b, ends[len(b) : n]))
                g = alphas[t + 1] * b
                gammas.append(g / g.sum(axis=1, keepdims=True))
                e = emit[kinds[t, :n]] * b
                before, back = alphas[t][:n], e @ self.move.T
                move += (before / (before * back).sum(axis=1, keepdims=True)).T @ e
                b = back / back.sum(axis=1, keepdims=True)
            all_kinds = np.concatenate([kinds[t, : live[t]] for t in range(len(live) - 1, -1, -1)])
            all_gammas = np.concatenate(gammas)
            for i in range(k):
                counts[i] += np.bincount(all_kinds, all_gammas[:, i], counts.shape[1])
        return np.concatenate((start, (move * self.move).ravel(), counts.ravel()))

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's classes, exactly, by the scaled forward recursion: a
        text's chunk products are applied to its start in order."""
        cut = self.chunks(texts)
        state = self.start * self.emit.T[[x[0] for x in texts]]
        scale = state.sum(axis=1)
        logs = np.log10(scale)
        state = state / scale[:, None]
        for own, at in cut.waves():
            s = np.einsum("ni,nij->nj", state[own], cut.products[at])
            scale = s.sum(axis=1)
            state[own] = s / scale[:, None]
            logs[own] += np.log10(scale) + cut.powers[at]
        return logs


def baum_welch(texts: DataFrame, totals: Counts, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Expected counts of all training texts, each as a whole, summed over the partitions, in each round.

    A task sends its own sums, states times classes numbers; the driver gets as many in all."""
    model = Hmm.first(totals.class_tokens, states)
    train = texts.where(~F.col("held_out")).select("classes")
    for _ in range(rounds if totals.train_texts else 0):
        now = model

        def work(batches: Iterator[pa.RecordBatch], model: Hmm = now) -> Iterator[pa.RecordBatch]:
            sums, waiting, tokens = None, [], 0

            def settle() -> None:
                nonlocal sums, waiting, tokens
                got = model.expected(waiting)
                sums = got if sums is None else sums + got
                waiting, tokens = [], 0

            for batch in batches:
                for raw in batch.column("classes"):
                    waiting.append(np.frombuffer(raw.as_buffer(), "<u2"))
                    tokens += len(waiting[-1])
                    if tokens >= BATCH * SEGMENT:
                        settle()
            if waiting:
                settle()
            if sums is not None:
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["at", "n"])

        got = train.mapInArrow(work, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        sums = np.zeros(states + states * states + states * CLASSES)
        for r in got:
            sums[r["at"]] = r["n"]
        model = Hmm.of(sums, states)
    return model


def scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of
    docs(doc_id, text, held_out); rows that aren't held out train the model.

    score is the log10 probability of the text's words and its end. A word that no training
    text has gets its class's share for such words. Null and empty texts are the end alone;
    equal texts get equal scores; without training rows the model is the even start; an
    empty table gives no rows; other columns are ignored. A very long text is one sequence,
    taken whole, at about 150 bytes a token."""
    cut = written(blocks(docs, block_bytes), "blocks", compression="zstd")
    vocabulary, counts, totals = word_counts(cut)
    texts = written(classed_texts(cut, vocabulary, counts, totals), "classed", compression="zstd")
    model = baum_welch(texts, totals, states, rounds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1_000_000, "classes"):
                own = model.log10([np.frombuffer(x.as_buffer(), "<u2") for x in some.column("classes")])
                total = own + some.column("words_score").to_numpy()
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in SCORED), pa.array(total)], [*SCORED, "score"])

    plain = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return texts.select(*SCORED, "words_score", "classes").mapInArrow(work, plain).withColumn("train_tokens", F.lit(totals.train_tokens).cast("long"))


SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_remainder("doc_id", 5) == 1).alias("held_out"))
    return scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
