"""The manifest against a plain tree over each source's rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from folioworks.llm import merkle as M
from folioworks.llm.common import table
from folioworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, i):
    for nodes in tree[:-1]:
        low = i // 16 * 16
        yield [nodes[j] for j in range(low, min(low + 16, len(nodes))) if j != i], i - low
        i //= 16


def brute(rows):
    lowered = lambda s: s and "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[1] for x in sorted(by[k], key=lambda x: x[:2])]) for k in names]
    top = levels([t[-1][0] for t in trees])
    for n, k in enumerate(names):
        for i, (_, h, r) in enumerate(sorted(by[k], key=lambda x: x[:2])):
            steps = [*way(trees[n], i), *way(top, n)]
            node = leaf((*r[:4], lowered(r[4]))) if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0 else h
            for others, at in steps:
                node = digest(*others[:at], node, *others[at:])
            yield r[0], h, trees[n][-1][0], top[-1][0], digest(*(x for others, _ in steps for x in others)), node, node == top[-1][0]


def settled(rows):
    return sorted(map(tuple, rows), key=str)


def manifest(spark, rows, tmp_path, name):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    frame.selectExpr("*", "'x' AS tree", "1 AS place", "true AS leaf").repartition(4).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return QUERIES["op13_octopus_manifest"](spark, f"{tmp_path}/{name}")


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_manifest(spark, monkeypatch, tmp_path, block):
    """A hot source, many of one row, null and odd ones; null ids, repeated ids and rows."""
    monkeypatch.setattr(M, "BLOCK", block)
    rows = [(i, "hot", "en", i, f"Text {i} ÄÖ É") for i in range(300)]
    rows += [(1000 + i, f"s{i:03}", None, None, None if i % 3 else "Ä B") for i in range(40)]
    rows += [(5, None, "x", 1, ""), (6, None, None, None, None), (None, "", "y", 2, "A" * 70_000), (None, "", "y", 3, "b"), (7, "é", "z", 1, "Q"), (7, "é", "z", 1, "Q"), (7, "é", "z", 2, "Q"), (8, "z\x00", "", -1, "x:1")]
    rows += [(2000 + i, "even", "en", 0, "t") for i in range(32)]
    got = manifest(spark, rows, tmp_path, f"b{block}").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert settled(got) == settled(brute(rows))


def test_single_rows_and_none(spark, tmp_path):
    one = [(3, "s", "en", 1, "a")]
    assert settled(manifest(spark, one, tmp_path, "one").collect()) == settled(brute(one))
    assert manifest(spark, [], tmp_path, "none").count() == 0


def test_multiproof_is_least(spark):
    """A block lacks the rest of the runs at its ends only, and nothing over what it has whole."""
    spans = spark.createDataFrame([(0, 0, 1000, 0, 255), (1, 0, 1000, 250, 301), (2, 1, 3, 0, 2), (3, 2, 1, 0, 0), (4, 3, 17, 16, 16)], "block long, tree long, size long, first long, last long")
    got = {}
    for r in M.missing_nodes(spans, 1000).collect():
        got.setdefault(r.block, set()).add((r.level, r.idx))
    assert got[0] == {(2, 1), (2, 2), (2, 3)}
    assert got[1] == {*((0, i) for i in range(240, 250)), (0, 302), (0, 303), *((1, i) for i in (*range(0, 15), *range(19, 32))), (2, 2), (2, 3)}
    assert 2 not in got and 3 not in got and got[4] == {(1, 0)}


def test_fold_refuses_and_notices(spark):
    docs = table(spark, SF, "documents").where("source = 'src0'")
    rows = M.proofs(docs).limit(5).collect()
    trees = docs.select("source").distinct().count()
    for r in rows:
        way_up = [(r.place, r["size"]), (r.source_no, trees)]
        assert M.fold(bytes(r.leaf), bytes(r.proof), way_up) == r.root
        changed = bytearray(r.proof)
        changed[-1] ^= 1
        assert M.fold(bytes(r.leaf), bytes(changed), way_up) != r.root
        with pytest.raises(ValueError):
            M.fold(bytes(r.leaf), bytes(r.proof) + b"\0" * 32, way_up)


def test_query(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    got = QUERIES["op13_octopus_manifest"](spark, SF)
    assert settled(got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == settled(brute(rows))
    assert got.where(~F.col("verified")).count() > 0
