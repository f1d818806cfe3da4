"""Ranked lexical search over posting lists in geometric blocks with exact skipping.

Documents are dealt to shards of some thousand. In a shard each term's posting list is
clustered by the documents' similarity into blocks, and a block keeps, for each term of the
queries, the greatest weight that the term has in any of its documents, rounded up: its
summary. What a summary gives for a query is at least what any of the block's documents
can score, so a block is skipped if that is under the score that the k-th result has
already, and otherwise its documents are scored exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, partitions, ranked, slices, table, written

#: Bytes that belong to a term; A-Z count as their lower case.
TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents, and their postings, in a shard; documents in a block; directions that similarity is measured in.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, DIRECTIONS = 4096, 600_000, 64, 16
#: Terms of the queries that are searched for at once (an item with more is searched for alone).
QUERY_TERMS = 8192
#: A document's weight of a term is less than a million; summaries keep it in steps, rounded up.
STEP = 4000
#: One shard in so many is searched first, for scores that the others' blocks must reach.
SEED = 16

VECTORS = "doc_id {id}, n long, terms array<int>, tfs array<int>"
INDEX = "shard long, doc_ids array<{id}>, starts binary, terms binary, weights binary, lists binary, ends binary, blocks binary, summaries binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def term_column(text: Column) -> Column:
    """The distinct terms of a text; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0)))


def term_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of docs with at least one term: n counts them all, with repeats; terms
    and tfs are those in the vocabulary, by number."""
    numbers = {x.encode(): i for i, x in enumerate(vocabulary)}
    own_type = pa.list_(pa.int32())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                ids, ns, terms, tfs = [], [], [], []
                for doc_id, text in zip(part.column("doc_id"), part.column("text").to_pylist()):
                    words = terms_of(text)
                    if words:
                        found = Counter(map(numbers.get, words))
                        found.pop(None, None)
                        ids.append(doc_id)
                        ns.append(len(words))
                        terms.append(list(found))
                        tfs.append(list(found.values()))
                columns = [pa.array([x.as_py() for x in ids], batch.column("doc_id").type), pa.array(ns, pa.int64()), pa.array(terms, own_type), pa.array(tfs, own_type)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(work, VECTORS.format(id=dict(rows.dtypes)["doc_id"]))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of an Arrow array of lists."""
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.flatten().to_numpy(zero_copy_only=False)


def document_frequencies(vectors: DataFrame, size: int) -> list[int]:
    """How many rows of vectors hold each of the vocabulary's terms: summed in each task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_lists(batch.column("terms"))[1], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["term", "df"])

    counts = [0] * size
    for r in vectors.select("terms").mapInArrow(work, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term
        counts[r["term"]] = r["df"]
    return counts


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def representatives(own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """One document a block of a list: each the unlikest those before, of four times as many drawn from the list."""
    count = -(-len(own) // BLOCK)
    drawn = own[np.random.default_rng(len(own)).permutation(len(own))[: 4 * count]]
    near, chosen = seen[drawn] @ seen[drawn[0]], [0]
    while len(chosen) < count:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, seen[drawn] @ seen[drawn[chosen[-1]]])
    return drawn[chosen]


class Shard:
    """Some documents' vectors, their posting lists in blocks, and the blocks' summaries.

    starts, terms, weights: the vectors, a document after the other. ends: where each term's
    list ends in lists (places of documents); blocks: (first, end, term) of each block in
    lists; summaries: a row a block."""

    def __init__(self, size: int, doc_ids: pa.Array, starts, terms, weights, lists, ends, blocks, summaries):
        self.size, self.doc_ids = size, doc_ids
        self.starts, self.terms, self.weights = starts, terms, weights
        self.lists, self.ends, self.blocks, self.summaries = lists, ends, blocks, summaries

    @classmethod
    def of(cls, size: int, doc_ids: pa.Array, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> "Shard":
        n = len(lengths)
        rows = np.repeat(np.arange(n), lengths)
        levels = np.zeros((n, size), np.uint8)
        levels[rows, terms] = -(-weights // STEP)
        toward = np.random.default_rng(12).standard_normal((size, DIRECTIONS)).astype(np.float32)
        seen = np.zeros((n, DIRECTIONS), np.float32)
        for first in range(0, n, 256):
            seen[first : first + 256] = levels[first : first + 256].astype(np.float32) @ toward
        seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-9)
        by_term = np.argsort(terms, kind="stable")
        ends = np.cumsum(np.bincount(terms, minlength=size))
        lists = rows[by_term].astype(np.uint16)
        blocks, summaries, begin = [], [], 0
        for term, end in enumerate(ends.tolist()):
            own = lists[begin:end]
            if len(own) > BLOCK:
                # each joins the likest representative; a cluster over the block's size is cut
                chosen = representatives(own, seen)
                nearest = np.argmax(seen[own] @ seen[chosen].T, axis=1)
                order = np.argsort(nearest, kind="stable")
                own = lists[begin:end] = own[order]
                nearest = nearest[order]
                heads = np.flatnonzero(np.r_[True, nearest[1:] != nearest[:-1]])
                inside = np.arange(len(own)) - np.repeat(heads, np.diff(np.r_[heads, len(own)]))
                cuts = np.flatnonzero(inside % BLOCK == 0)
            else:
                cuts = np.zeros(min(1, len(own)), np.int64)
            if len(own):
                summaries.append(np.maximum.reduceat(levels[own], cuts, axis=0))
                blocks.append(np.stack([begin + cuts, begin + np.r_[cuts[1:], len(own)], np.full(len(cuts), term)], axis=1))
            begin = end
        starts = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        return cls(
            size, doc_ids, starts, terms.astype(np.int32), weights.astype(np.int32), lists, ends.astype(np.int64),
            np.concatenate(blocks).astype(np.int32) if blocks else np.zeros((0, 3), np.int32),
            np.concatenate(summaries) if summaries else np.zeros((0, size), np.uint8),
        )

    def row(self) -> list[bytes]:
        packed = lambda x: len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)
        return [packed(np.ascontiguousarray(x).tobytes()) for x in (self.starts, self.terms, self.weights, self.lists, self.ends, self.blocks, self.summaries)]

    @classmethod
    def parse(cls, size: int, doc_ids: pa.Array, row: list[bytes]) -> "Shard":
        kinds = (np.int64, np.int32, np.int32, np.uint16, np.int64, np.int32, np.uint8)
        raw = [np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), kind) for x, kind in zip(row, kinds)]
        return cls(size, doc_ids, *raw[:5], raw[5].reshape(-1, 3), raw[6].reshape(-1, size))

    def scores(self, places: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """The exact scores of the documents at these places; wide has a query's term weights, 0 for other terms."""
        lengths = self.starts[places + 1] - self.starts[places]
        at = ranges(self.starts[places], lengths)
        worth = np.r_[0, np.cumsum(wide[self.terms[at]] * self.weights[at])]
        ends = np.cumsum(lengths)
        return worth[ends] - worth[ends - lengths]


class Best:
    """The k best results of one query so far: greatest score, then least doc_id (null first)."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(1, floor)
        self.rows: list[tuple[int, bool, object]] = []

    def add(self, scores: np.ndarray, doc_ids: pa.Array, places: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.floor)
        if len(good):
            ids = doc_ids.take(pa.array(places[good])).to_pylist()
            self.rows += [(-s, x is not None, 0 if x is None else x) for s, x in zip(scores[good].tolist(), ids)]
            self.rows.sort()
            del self.rows[self.k :]
            if len(self.rows) == self.k:
                self.floor = max(self.floor, -self.rows[-1][0])


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best, seen: list[int] | None = None) -> None:
    """Put into best what the shard has for a query of distinct terms (numbers) and their weights.

    A document that reaches the bound holds one of the terms that are left when the least
    possible contributions are taken away as long as they stay under it; so only these
    terms' lists are gone through, the greatest first. seen counts blocks read and skipped."""
    first = np.searchsorted(shard.blocks[:, 2], terms)
    end = np.searchsorted(shard.blocks[:, 2], terms, "right")
    tops = np.array([shard.summaries[a:b, t].max() if b > a else 0 for a, b, t in zip(first, end, terms)], np.int64) * weights * STEP
    order = np.argsort(tops, kind="stable")
    reach = np.cumsum(tops[order])
    wide = np.zeros(shard.size, np.int64)
    wide[terms] = weights
    done = np.zeros(len(shard.starts) - 1, bool)
    read = met = 0
    for i in range(len(order) - 1, -1, -1):
        if reach[i] < best.floor:
            break  # all terms up to this one together don't reach it
        a, b = int(first[order[i]]), int(end[order[i]])
        if a == b:
            continue
        bounds = shard.summaries[a:b][:, terms].astype(np.int64) @ (weights * STEP)
        # the greatest bounds first, in steps that grow, as the score to reach rises with what is found
        likely, at, step = np.argsort(-bounds, kind="stable"), 0, 1
        while at < len(likely) and bounds[likely[at]] >= best.floor:
            some = likely[at : at + step]
            some = some[bounds[some] >= best.floor]
            at, step = at + step, 2 * step
            read += len(some)
            spans = shard.blocks[a + some].astype(np.int64)
            places = shard.lists[ranges(spans[:, 0], spans[:, 1] - spans[:, 0])].astype(np.int64)
            places = places[~done[places]]
            if len(places):
                done[places] = True
                best.add(shard.scores(places, wide), shard.doc_ids, places)
        met += b - a
    if seen is not None:
        seen[0] += read
        seen[1] += met - read


def build_index(vectors: DataFrame, size: int, n_docs: int, n_terms: int) -> DataFrame:
    """The shards of all rows of vectors, a row each; n_docs and n_terms are the corpus's."""
    id_type = dict(vectors.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held: list[tuple] = []

        def shard() -> pa.RecordBatch:
            nonlocal made
            ids = pa.concat_arrays([x[0] for x in held])
            lengths, terms, weights = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            row = Shard.of(size, ids, lengths, terms, weights).row()
            held.clear()
            made += 1
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            names = ["shard", "doc_ids", "starts", "terms", "weights", "lists", "ends", "blocks", "summaries"]
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), listed, *[pa.array([x], pa.binary()) for x in row]], names)

        docs = postings = 0
        for batch in batches:
            lengths, terms = _lists(batch.column("terms"))
            tfs = _lists(batch.column("tfs"))[1].astype(np.int64)
            m = 100 - 50 + np.array([50 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
            weights = 1_000_000_000 * tfs // (1000 * tfs + 20 * np.repeat(m, lengths))
            ends = np.cumsum(lengths)
            first = 0
            while first < len(lengths):
                base = ends[first - 1] if first else 0
                room = int(np.searchsorted(ends, base + SHARD_POSTINGS - postings, "right"))
                upto = min(len(lengths), first + SHARD_DOCS - docs, max(room, first if held else first + 1))
                if upto > first:
                    held.append((batch.column("doc_id").slice(first, upto - first), lengths[first:upto], terms[base : ends[upto - 1]], weights[base : ends[upto - 1]]))
                    docs, postings = docs + upto - first, postings + int(ends[upto - 1] - base)
                first = upto
                if docs >= SHARD_DOCS or first < len(lengths):
                    yield shard()
                    docs = postings = 0
        if held:
            yield shard()

    return vectors.mapInArrow(work, INDEX.format(id=id_type))


def search_index(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], size: int, k: int, floors: dict[int, int]) -> DataFrame:
    """(item_no, doc_id, score): each task's k best of the index's rows for each query (number, terms, weights) that reach its floor."""
    id_type = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {no: Best(k, floors.get(no, 1)) for no, _, _ in queries}
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids").slice(i, 1).flatten()
                shard = Shard.parse(size, ids, [batch.column(c)[i].as_py() for c in batch.schema.names[2:]])
                for no, terms, weights in queries:
                    search_shard(shard, terms, weights, found[no])
        if kind is not None:
            rows = [(no, x if held else None, -s) for no, best in found.items() for s, held, x in best.rows]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["item_no", "doc_id", "score"])

    return index.mapInArrow(work, f"item_no long, doc_id {id_type}, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple[int, list[str]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({x for _, terms in items for x in terms})
    numbers, size = {x: i for i, x in enumerate(vocabulary)}, len(vocabulary)
    vectors = written(term_vectors(docs, vocabulary), "term-vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(vectors, size)
    queries = []
    for no, terms in items:
        own = np.array([i for i in (numbers[x] for x in terms) if df[i]], np.int64)
        worth = np.array([term_weight(n_docs, df[i]) for i in own], np.int64)
        queries.append((no, own[worth > 0], worth[worth > 0]))
    holding = vectors.where(F.size("terms") > 0)
    # as many parts as shards, for the vectors are much smaller than the texts
    parts = max(partitions(spark), n_docs // SHARD_DOCS + 1)
    index = written(build_index(holding.repartition(parts), size, n_docs, n_terms), "blocked-index", compression="none")
    seeds = search_index(index.where(F.pmod(F.xxhash64("shard"), F.lit(SEED)) == 0), queries, size, k, {})
    # a row an item: the k-th score among the seeds' results is at most the k-th of all
    floors = {r["item_no"]: r["score"] for r in _best(seeds, k).where(F.col("rank") == k).select("item_no", "score").collect()}
    out = written(_best(search_index(index, queries, size, k, floors), k), "ranked")
    discard(vectors, index)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) its k best rows of docs(doc_id, text).

    Documents are numbered over all of docs; null, empty and termless texts aren't counted
    and never found; a termless item has no rows. Equal rows are documents (items) of
    their own; equal scores go by doc_id, null first. An empty table on either side gives
    no rows; other columns are ignored. A very long text counts like any other.

    Items are searched for in blocks of at most QUERY_TERMS terms; for each the texts are
    read once, for vectors over the block's terms, and the driver holds the block's terms,
    their frequencies and a score an item. A shard's results go through that score first,
    so about SEED * k rows an item are left to rank, however many shards there are."""
    asked = items.select("item_id", term_column(F.col("text")).alias("own")).where(F.size("own") > 0)
    asked = asked.withColumns({"key": F.xxhash64("own"), "weight": F.size("own").cast("long")})
    lined = written(ranked(asked, ["item_id", "key"], "weight", "items").select("item_id", "own", F.col("rank").alias("item_no"), F.expr(f"before div {QUERY_TERMS}").alias("block")), "items")
    out = None
    for block in sorted(r[0] for r in lined.select("block").distinct().collect()):  # a row a block
        own = [(r["item_no"], list(r["own"])) for r in lined.where(F.col("block") == block).select("item_no", "own").collect()]  # at most QUERY_TERMS terms and one item
        found = _search_block(docs, own, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        id_types = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
        return docs.sparkSession.createDataFrame([], f"item_id {id_types[0]}, rank int, doc_id {id_types[1]}, score long")
    return lined.select("item_no", "item_id").join(out.hint("merge"), "item_no").select("item_id", "rank", "doc_id", "score")


def op12_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


OP12_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM documents
),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, n_docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM benchmark
),
norms AS (SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM lengths, corpus),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS "rank", doc_id, score
FROM scored WHERE score > 0 QUALIFY "rank" <= 50
"""
