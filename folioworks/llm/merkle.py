"""A Merkle manifest of a table: digests by source, and proofs of all rows by octopus multiproofs.

Leaves lie in blocks of consecutive rows. A block's multiproof is the least set of node
coordinates that its rows' proofs need and its own leaves don't give: at each level the
rest of the runs at the block's two ends, for all that lies between is derived. These
nodes are fetched by one join a block; then the block derives the interiors that its
proofs share and expands each row's proof by itself."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import crc_remainder, discard, table, written

#: Nodes hashed into one, and rows in a block.
ARITY, BLOCK = 16, 4096
#: The tree over the sources' roots; a source's own tree has the source's number.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(inputs: Column) -> Column:
    return F.unhex(F.sha2(inputs.cast("binary"), 256))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields in order: a null is a hyphen, any other value its UTF-8 bytes' number, a colon and itself."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*map(part, FIELDS)))


def _run_digest(nodes: Column) -> Column:
    """The digest of a run, an array of struct(idx, node) in any order."""
    return digest(F.array_join(F.transform(F.array_sort(nodes), lambda x: F.lower(F.hex(x["node"]))), ""))


def widths(size: int) -> list[int]:
    """Nodes at each level of a tree with so many leaves, from the leaves to the root."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def _levels(leaves: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(interior nodes, a table a level; roots, a table a level) over leaves(tree, size, idx, node).

    A level's runs are grouped by tree and place, so a tree with most leaves spreads. A
    tree of one node at a level has its root there and takes no part in the next."""
    inner, roots = [], []
    now, width = leaves, F.col("size")
    for level in range(len(widths(most))):
        roots.append(now.where(width == 1).select("tree", "node"))
        if level < len(widths(most)) - 1:
            runs = now.where(width > 1).groupBy("tree", "size", F.expr(f"idx div {ARITY}").alias("idx"))
            now = written(runs.agg(_run_digest(F.collect_list(F.struct("idx", "node"))).alias("node")), "merkle-level")
            inner.append(now.withColumn("level", F.lit(level + 1)))
            width = F.ceil(width / ARITY)
    return inner, roots


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def missing_nodes(spans: DataFrame, most: int) -> DataFrame:
    """(block, tree, level, idx): what the blocks of spans(block, tree, size, first, last) lack.

    At a level a block's own nodes are those over first..last. The rest of the runs that
    these lie in is missing, and with it all nodes over them can be derived: up to 15 at
    either side of either end, whatever a block holds."""
    depth = len(widths(most))
    kinds = F.array(*[F.lit(ARITY**level).cast("long") for level in range(depth)])
    rows = spans.select("block", "tree", "size", "first", "last", F.posexplode(kinds).alias("level", "wide"))
    rows = rows.select("block", "tree", "level", F.ceil(F.col("size") / F.col("wide")).alias("n"), F.expr("first div wide").alias("a"), F.expr("last div wide").alias("b")).where("n > 1")
    low, high = F.expr(f"a div {ARITY} * {ARITY}"), F.least(F.expr(f"b div {ARITY} * {ARITY} + {ARITY - 1}"), F.col("n") - 1)
    none = F.array().cast("array<bigint>")
    ends = F.concat(F.when(low < F.col("a"), F.sequence(low, F.col("a") - 1)).otherwise(none), F.when(F.col("b") < high, F.sequence(F.col("b") + 1, high)).otherwise(none))
    return rows.select("block", "tree", "level", F.explode(ends).alias("idx"))


class Segment:
    """The part of a tree that a block sees: all nodes of the runs that its leaves lie in."""

    def __init__(self, size: int, first: int, own: list[bytes], fetched: dict[tuple[int, int], bytes]):
        self.widths, self.first = widths(size), first
        self.nodes: list[dict[int, bytes]] = []
        now, a, b = dict(zip(range(first, first + len(own)), own)), first, first + len(own) - 1
        for level, n in enumerate(self.widths):
            if n > 1:
                low, high = a // ARITY * ARITY, min(b // ARITY * ARITY + ARITY - 1, n - 1)
                for i in (*range(low, a), *range(b + 1, high + 1)):
                    now[i] = fetched[level, i]
                self.nodes.append(now)
                now = {p: run_digest([now[i] for i in range(p * ARITY, min(p * ARITY + ARITY, n))]) for p in range(a // ARITY, b // ARITY + 1)}
                a, b = a // ARITY, b // ARITY
        self.root = now[0]

    def siblings(self, place: int) -> list[bytes]:
        """The others of each run from a leaf to the root, left to right."""
        out, i = [], place
        for n, nodes in zip(self.widths, self.nodes):
            low = i // ARITY * ARITY
            out += [nodes[j] for j in range(low, min(low + ARITY, n)) if j != i]
            i //= ARITY
        return out


def run_digest(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def fold(leaf: bytes, proof: bytes, positions: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its proof give: siblings of 32 bytes each, left to right, through
    trees in which the node lies at (place, leaves)."""
    at = 0
    for place, size in positions:
        for n in widths(size)[:-1]:
            low = place // ARITY * ARITY
            own, others = place - low, min(ARITY, n - low) - 1
            run = proof[at : at + 32 * others]
            leaf = hashlib.sha256((run[: 32 * own] + leaf + run[32 * own :]).hex().encode()).digest()
            at += 32 * others
            place //= ARITY
    if at != len(proof):
        raise ValueError("a proof of another tree")
    return leaf


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, source_no, place, size, leaf, subroot, root, proof, folded) of docs(doc_id, source, lang, n_chars, text).

    A source's rows ascend by doc_id (null first), equal ids by leaf; sources ascend bytewise,
    null first. proof is the siblings, 32 bytes each, of a row's way through its source's
    tree and the tree of sources; folded is the root that they give with the leaf, or,
    where `tampered` (a text column) isn't null, with the leaf of that text. A null or
    empty text is a field like any other, a very long one is only ever hashed; equal rows are leaves of
    their own; an empty table gives no rows; other columns don't count.

    Texts aren't shuffled: leaves are. Sources of any size spread over all tasks."""
    other = F.when(tampered.isNotNull(), leaf(text=tampered)) if tampered is not None else F.lit(None).cast("binary")
    hashed = docs.select("doc_id", "source", leaf().alias("leaf"), other.alias("other"))
    lined = numbered(hashed, ["source"], ["doc_id", "leaf"], "merkle-rows")
    leaves = written(
        lined.select("doc_id", "leaf", "other", F.col("group_no").alias("tree"), F.col("group_size").alias("size"), F.col("place").alias("idx"), F.expr(f"rank div {BLOCK}").alias("block"), F.expr(f"rank % {BLOCK}").alias("at")),
        "merkle-leaves",
    )
    most, trees = leaves.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    inner, roots = _levels(leaves.select("tree", "size", "idx", F.col("leaf").alias("node")), most)
    subroots = written(_union(roots).select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), F.col("tree").alias("idx"), "node"), "merkle-subroots")
    top, whole = _levels(subroots, trees)
    root = (_union(whole).first() or {"node": None})["node"]  # one row

    # leaves that another block may want: those of the runs at a block's ends
    edges = leaves.where((F.col("at") < ARITY - 1) | (F.col("at") > BLOCK - ARITY)).select("tree", "idx", F.col("leaf").alias("node")).withColumn("level", F.lit(0))
    names = ("tree", "level", "idx", "node")
    nodes = _union([x.select(*names) for x in (edges, *inner, subroots.withColumn("level", F.lit(0)), *top)])
    spans = leaves.groupBy("block", "tree", "size").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    above = spans.groupBy("block").agg(F.min("tree").alias("first"), F.max("tree").alias("last"))
    above = above.select("block", F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), "first", "last")
    wanted = missing_nodes(spans.unionByName(above), max(most, trees))
    fetched = wanted.join(nodes.hint("merge"), ["tree", "level", "idx"]).select(F.col("block").alias("home"), *[F.col(c).alias(f"got_{c}") for c in names])

    id_type = dict(docs.dtypes)["doc_id"]
    out = f"doc_id {id_type}, source_no long, place long, size long, leaf binary, subroot binary, root binary, proof binary, folded binary"
    schema = pa.schema([("source_no", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), *[(c, pa.binary()) for c in ("leaf", "subroot", "root", "proof", "folded")]])

    def expand(own: pa.Table, more: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        cells = zip(*(more.column(f"got_{c}").to_pylist() for c in names))
        known: dict[int, dict[tuple[int, int], bytes]] = {}
        for tree, level, idx, node in cells:
            known.setdefault(tree, {})[level, idx] = node
        rows = list(zip(*(own.column(c).to_pylist() for c in ("tree", "size", "idx", "leaf", "other"))))
        segments: dict[int, Segment] = {}
        begin = 0
        while begin < len(rows):
            tree, size, first = rows[begin][:3]
            end = begin
            while end < len(rows) and rows[end][0] == tree:
                end += 1
            segments[tree] = Segment(size, first, [r[3] for r in rows[begin:end]], known.get(tree, {}))
            begin = end
        over = Segment(trees, min(segments), [segments[x].root for x in sorted(segments)], known.get(TOP, {}))
        ways = {tree: over.siblings(tree) for tree in segments}
        made = []
        for tree, size, place, own_leaf, changed in rows:
            segment = segments[tree]
            proof = b"".join(segment.siblings(place) + ways[tree])
            folded = fold(own_leaf if changed is None else changed, proof, [(place, size), (tree, trees)])
            made.append((tree, place, size, own_leaf, segment.root, root, proof, folded))
        columns = [pa.array(x, f.type) for x, f in zip(zip(*made), schema)]
        return pa.Table.from_arrays([own.column("doc_id"), *columns], ["doc_id", *schema.names])

    return leaves.groupBy("block").cogroup(fetched.groupBy("home")).applyInArrow(expand, out)


def op13_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.when(crc_remainder("doc_id", 5) == 0, F.translate("text", UPPER, UPPER.lower()))
    text = lambda c: F.lower(F.hex(c))
    return proofs(docs, lowered).select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        F.col("folded").eqNullSafe(F.col("root")).alias("verified"),
    )
