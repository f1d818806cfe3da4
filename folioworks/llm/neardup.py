"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_names, one_of_each, slices, table, written
from .decontaminate import words_of
from .hashing import STEP, mixed, shingles, word_hashes

SHINGLE, SIMILAR = 5, 0.8
#: 30 bands of 6: a pair at 0.8 is missed by all bands with probability 0.0001, one at 0.85 with 0.0000003.
BANDS, BAND_ROWS = 30, 6

def bag(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of a text, ascending, and how often each occurs."""
    return np.unique(shingles(word_hashes().of(words), size), return_counts=True)


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """The BagMinHash signature of each non-empty bag: m components as float32.

    A shingle of weight w owns the part below w of the weights' axis. The axis is cut at
    0, 1, 2, 4, 8, ...; each interval has a Poisson process of its own in time, seeded by
    the shingle and the interval, at a rate of the interval's length. A point falls on a
    uniform component at a uniform height in its interval; it counts if its height is below
    w, and a component keeps its earliest point. Two bags' components agree with the
    probability of their weighted Jaccard similarity. Points are made in rounds, one for
    each process that can still be earlier than some component of its bag."""
    n = len(bags)
    hashes = np.concatenate([h for h, _ in bags])
    weights = np.concatenate([w for _, w in bags])
    owner = np.repeat(np.arange(n), [len(h) for h, _ in bags])
    doc, seed, rate, part = [], [], [], []
    low, level = 0, 0
    while len(hashes):
        high = max(1, 2 * low)
        with np.errstate(over="ignore"):
            seed.append(mixed(hashes + np.uint64(level + 1) * STEP))
        doc.append(owner)
        rate.append(np.full(len(hashes), float(high - low)))
        part.append(np.minimum(1.0, (weights - low) / (high - low)))
        more = weights > high
        hashes, weights, owner = hashes[more], weights[more], owner[more]
        low, level = high, level + 1
    doc, seed, rate, part = np.concatenate(doc), np.concatenate(seed), np.concatenate(rate), np.concatenate(part)
    time = np.zeros(len(doc))
    out = np.full(n * m, np.inf)
    latest = np.full(n, np.inf)
    turn = 0
    while len(doc):
        turn += 1
        with np.errstate(over="ignore"):
            a = mixed(seed + np.uint64(2 * turn) * STEP)
            b = mixed(seed + np.uint64(2 * turn + 1) * STEP)
        time = time - np.log(((a >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate
        early = time < latest[doc]
        component = ((b >> np.uint64(40)) * np.uint64(m)) >> np.uint64(24)
        height = (b & np.uint64((1 << 32) - 1)).astype(float) / (1 << 32)
        put = early & (height < part)
        np.minimum.at(out, doc[put] * m + component[put].astype(np.int64), time[put])
        latest = out.reshape(n, m).max(axis=1)
        keep = early & (time < latest[doc])
        doc, seed, rate, part, time = doc[keep], seed[keep], rate[keep], part[keep], time[keep]
    return out.reshape(n, m).astype(np.float32)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Shingles that two bags share, each as often as in the one that has it less."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = overlap(a, b)
    every = int(a[1].sum() + b[1].sum()) - both
    return both / every if every else 1.0


SIGNED = "doc_id long, print long, node binary, size int, bands array<long>"


def signed(docs: DataFrame, bands: int = BANDS, band_rows: int = BAND_ROWS, size: int = SHINGLE) -> DataFrame:
    """Each row's node (a digest of its words; of the text itself where it has none), its number
    of shingles and its band keys (none where it has no words). No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(bands, dtype=np.uint64)[None, :]
        for batch in batches:
            for some in slices(batch, 4_000_000):
                nodes, sizes, bags, own = [], [], [], []
                for i, text in enumerate(some.column("text").to_pylist()):
                    words = words_of(text)
                    nodes.append(xxhash.xxh3_128_digest(b" ".join(words) if words else b"\0" + (text or "").encode()))
                    found = bag(words, size) if words else None
                    sizes.append(int(found[1].sum()) if words else 0)
                    if words:
                        bags.append(found)
                        own.append(i)
                keys: list[list[int]] = [[] for _ in nodes]
                if bags:
                    bits = bag_minhash(bags, bands * band_rows).view(np.uint32).reshape(len(bags), bands, band_rows).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        h = mixed(np.broadcast_to(place + np.uint64(1), bits.shape[:2]) * STEP)
                        for j in range(band_rows):
                            h = mixed(h * STEP + bits[:, :, j])
                    for i, row in zip(own, h.view(np.int64).tolist()):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("print"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "print", "node", "size", "bands"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(work, SIGNED)


MEASURED = "a binary, b binary, in_a binary, in_b binary, both long, similar boolean"


def held_bits(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Which of b's shingles a has, as 64-bit numbers: a shingle that occurs w times in b has
    w bits, of which as many are set as a has it, w at most."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    n = np.minimum(a[1][i], b[1][j])
    starts = (np.cumsum(b[1]) - b[1])[j]
    bits = np.zeros(-(-int(b[1].sum()) // 64) * 64, np.uint8)
    bits[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())] = 1
    return np.packbits(bits).view("<i8").tolist()


def measured(pairs: DataFrame, texts: DataFrame, least: float = SIMILAR, size: int = SHINGLE, with_bits: bool = False) -> DataFrame:
    """pairs (a, b) of nodes of the classes (in_a, in_b) with `both`, the overlap of their texts'
    bags, and whether they are similar; with_bits: also which of b's shingles a has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["a", "b", "in_a", "in_b"]
        for batch in batches:
            for some in slices(batch, 8_000_000, "text_a", "text_b"):
                both, similar, bits, name, last = [], [], [], None, None
                for b, ta, tb in zip(*(some.column(c).to_pylist() for c in ("b", "text_a", "text_b"))):
                    if last is None or b != name:
                        name, last = b, bag(words_of(tb), size)
                    first = bag(words_of(ta), size)
                    n = overlap(first, last)
                    both.append(n)
                    similar.append(n >= least * (int(first[1].sum() + last[1].sum()) - n))
                    if with_bits:
                        bits.append(held_bits(first, last))
                columns = [*(some.column(c) for c in kept), pa.array(both, pa.int64()), pa.array(similar, pa.bool_())]
                names = [*kept, "both", "similar"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(bits, pa.list_(pa.int64()))] * with_bits, names + ["bits"] * with_bits)

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")
    return joined.select("a", "b", "in_a", "in_b", "text_a", "text_b").mapInArrow(work, MEASURED + ", bits array<long>" * with_bits)


def reaches(most: Column, sizes: Column, least: float) -> Column:
    """Whether texts of these sizes together can be similar with an overlap of at most `most`; rounds as measured() does."""
    return most >= F.lit(least) * (sizes - most)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each node that has a link; nodes that links connect have the same label.

    Every node goes to the least of itself and its neighbours; what links are left between
    these is smaller by a factor, as nodes are random digests, and is contracted again until
    none is. Each round's table is written out, and a hub's rows can be split."""
    edges = written(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0), "labels")
    first = True
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "step")
        of_a = step.select(F.col("node").alias("a"), F.col("label").alias("to_a")).hint("merge")
        of_b = step.select(F.col("node").alias("b"), F.col("label").alias("to_b")).hint("merge")
        left = edges.join(of_a, "a").join(of_b, "b").where(F.col("to_a") != F.col("to_b"))
        fewer = written(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if first:
            further, first = step, False
        else:
            on = step.select(F.col("node").alias("label"), F.col("label").alias("further")).hint("merge")
            further = written(labels.join(on, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
            discard(step)
        discard(edges, labels)
        edges, labels = fewer, further
    discard(edges)
    return labels


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels(node, label) after its classes are joined by the similar ones of measured pairs."""
    links = found.where(F.col("similar") & (F.col("in_a") != F.col("in_b"))).select(F.col("in_a").alias("a"), F.col("in_b").alias("b"))
    joined = components(links)
    tops = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
    out = written(labels.join(tops.hint("merge"), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "classes")
    discard(joined, labels)
    return out


def shared_shingles(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, shared): how many of a text's shingles some other of these texts has as well; a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1_000_000):
                bags = [bag(words_of(text), size) for text in some.column("text").to_pylist()]
                owner = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
                yield pa.RecordBatch.from_arrays(
                    [some.column("node").take(pa.array(owner)), pa.array(np.concatenate([h for h, _ in bags]).view(np.int64)), pa.array(np.concatenate([n for _, n in bags]))], ["node", "h", "n"]
                )

    rows = written(texts.select("node", "text").mapInArrow(work, "node binary, h long, n long"), "shingles", compression="zstd")
    # written, so that the adaptive join can split a shingle that most texts have
    common = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > 1).select("h"), "common")
    out = written(rows.join(common.hint("merge"), "h").groupBy("node").agg(F.sum("n").alias("shared")), "bounds")
    discard(rows, common)
    return out


def common_bits(a: Column, b: Column) -> Column:
    """How many bits two arrays of 64-bit numbers share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda total, n: total + n)


def remaining_links(buckets: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """labels after all buckets(key, node, size) that hold several classes are settled exactly; labels is discarded.

    Every node of such a bucket is measured against the bucket's centre. For any two nodes a
    and b of one centre c, the sum of min(a, b) over all shingles is that of min(a, b, c),
    which the bits that held_bits() gave for a and b have in common, and what both have
    beyond c, which is the lesser of their `rest` at most: the shingles that they share with
    any other text less their overlap with c. If that doesn't reach what the two sizes need,
    they aren't similar. So of the pairs between classes only those come out of the join
    that are similar or nearly so."""
    own = buckets.join(labels.hint("merge"), "node")
    several = own.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y")).select("key")
    several = written(several, "several")
    if several.isEmpty():
        discard(several)
        return labels
    open_ = written(own.join(several.hint("merge"), "key", "left_semi"), "open")
    nodes = written(open_.select("node").distinct(), "open-nodes")
    bounds = shared_shingles(texts.join(nodes.hint("merge"), "node", "left_semi"))
    # a partner has at least `least` of the node's size, so less overlap than that rules a node out
    able = written(open_.join(bounds.hint("merge"), "node").where(F.col("shared") >= least * F.col("size")), "open")
    discard(several, open_, nodes, bounds)
    middle = F.max_by(F.struct("node", "label"), F.struct(F.col("shared") / F.col("size"), "node"))
    centres = written(able.groupBy("key").agg(middle.alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.label").alias("in_b")), "centres")
    around = written(able.join(centres.hint("merge"), "key").select("node", "size", "shared", "label", "centre", "in_b").distinct(), "around")
    discard(able, centres)
    pairs = around.select(F.col("node").alias("a"), F.col("centre").alias("b"), F.col("label").alias("in_a"), "in_b")
    spans = written(measured(pairs, texts, least, with_bits=True), "spans", compression="zstd")
    labels = relabelled(labels, spans)
    to_centre = spans.select(F.col("a").alias("node"), F.col("b").alias("centre"), "both", "bits")
    around_all = around.select("node", "size", "shared", "centre").join(to_centre.hint("merge"), ["node", "centre"]).join(labels.hint("merge"), "node")
    around_all = written(around_all.withColumn("rest", F.greatest(F.lit(0), F.col("shared") - F.col("both"))), "placed", compression="zstd")
    sizes = around_all.groupBy("centre", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("centre").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("classes")).where(F.col("classes") > 1)
    main = written(main.select("centre", "main"), "main")
    outside = written(around_all.join(main.hint("merge"), "centre").where(F.col("label") != F.col("main")).drop("main"), "outside", compression="zstd")
    other = around_all.select("centre", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "label", "both", "rest", "bits")])
    total, beyond = F.col("size") + F.col("size_b"), F.least("rest", "rest_b")
    can = (
        (F.col("label") != F.col("label_b"))
        & (F.least("size", "size_b") >= least * F.greatest("size", "size_b"))
        & reaches(F.least("both", "both_b") + beyond, total, least)
        & reaches(common_bits(F.col("bits"), F.col("bits_b")) + beyond, total, least)
    )
    found = outside.join(other.hint("merge"), "centre").where(can)
    found = found.select(
        F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"), F.least("label", "label_b").alias("in_a"), F.greatest("label", "label_b").alias("in_b")
    )
    labels = relabelled(labels, measured(written(found.distinct(), "pairs"), texts, least))
    discard(around, spans, around_all, main, outside)
    return labels


def classes(docs: DataFrame, least: float = SIMILAR, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, print (a hash of the text), class_id and is_kept of each row of docs(doc_id, text).

    Texts of the same words are one node. Nodes that share a band are candidates; texts are
    linked if their bags of five-word shingles have a weighted Jaccard similarity of at
    least `least`, and a class is what links connect. class_id is its least doc_id (null
    first), is_kept marks the rows with the class's least (doc_id, print).

    A bucket of many nodes isn't turned into pairs. First every node is checked against the
    least node of its buckets; what is left between classes of one bucket is settled by
    remaining_links(), exactly and without a cap.

    Null texts count as empty. Wordless texts are copies only of the same text. Ties and
    equal rows share a class; an empty table gives no rows; other columns are ignored. A
    very long text is taken whole; its task needs about 150 bytes a word."""
    rows = written(signed(docs, bands, band_rows), "signed", compression="zstd")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "print")).alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes", compression="zstd")
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    leader = F.min(F.struct("node", "size")).alias("leader")
    shared = keyed.groupBy("key").agg(leader, F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key", "leader")
    # written, so that the adaptive join can split a band key that many nodes have
    shared = written(shared, "shared", compression="zstd")
    buckets = written(keyed.join(shared.hint("merge"), "key"), "buckets", compression="zstd")

    wanted = nodes.join(buckets.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "least.*")
    source = docs.select("doc_id", F.xxhash64("text").alias("print"), F.col("text"))
    texts = source.join(wanted.hint("merge"), source["doc_id"].eqNullSafe(wanted["doc_id"]) & (source["print"] == wanted["print"]))
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), "texts", compression="zstd")

    # two texts whose sizes differ by more can't be similar
    alike = F.least("size", "leader.size") >= least * F.greatest("size", "leader.size")
    star = buckets.where((F.col("node") != F.col("leader.node")) & alike).groupBy("node").agg(F.min("leader.node").alias("b")).withColumnRenamed("node", "a")
    star = star.withColumns({"in_a": F.col("a"), "in_b": F.col("b")})
    labels = relabelled(written(texts.select("node", F.col("node").alias("label")), "classes"), measured(star, texts, least))
    labels = remaining_links(buckets.select("key", "node", "size"), labels, texts, least)
    of_node = nodes.select("node", "least").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_node = written(of_node, "of-node", compression="zstd")
    of_class = written(of_node.groupBy("label").agg(F.min("least").alias("kept")), "of-class", compression="zstd")
    of_node_kept = written(of_node.join(of_class.hint("merge"), "label").select("node", "kept"), "kept", compression="zstd")
    discard(nodes, shared, buckets, texts, labels, of_node, of_class)
    return rows.select("doc_id", "print", "node").join(of_node_kept.hint("merge"), "node").select(
        "doc_id",
        "print",
        F.col("kept.doc_id").alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("print") == F.col("kept.print"))).alias("is_kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that with the least (doc_id, hash of the text); all
    columns stay, whatever their names.

    Of rows with the same doc_id and text one stays, always the same. Null and empty texts
    are copies of each other; an empty table gives no rows."""
    kept = written(classes(docs).where("is_kept").select(F.col("doc_id").alias("kept_id"), F.col("print").alias("kept_print")).distinct(), "kept")
    (print_,) = free_names(docs.columns, "print")
    marked = docs.withColumn(print_, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(kept["kept_id"]) & (marked[print_] == kept["kept_print"])
    found = marked.join(kept.hint("merge"), same, "left_semi")
    return one_of_each(found, ["doc_id", print_], docs.columns)


def op7_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")
