"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from folioworks.llm import ranked as R
from folioworks.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(R.TERM_PATTERN, lowered)


def brute(docs, items, k):
    """{item row: [(rank, doc_id, score)]} of docs [(doc_id, text)] and items [text]."""
    bags = [(i, Counter(terms(x))) for i, x in docs if terms(x)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for text in items:
        rows = []
        for doc_id, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag)
            if score > 0:
                rows.append((-score, doc_id is not None, doc_id or 0))
        out.append([(i + 1, d if held else None, -s) for i, (s, held, d) in enumerate(sorted(rows)[:k])])
    return out


def corpus(rng, n):
    words = ["the", "of", "Straße", "don't", "日本", "x1", *(f"w{i}" for i in range(60))]
    weights = [50, 40, *([3] * 20), *([1] * 44)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 120])))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(40)] + [(None, docs[7][1]), (3, docs[3][1]), (n + 99, None), (n + 98, ""), (n + 97, " .;\n"), (n + 96, "THE the The" * 3)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,k,shard,block", [(1, 5, 4096, 64), (2, 50, 20, 4), (3, 3, 33, 2)])
def test_search(spark, monkeypatch, seed, k, shard, block):
    monkeypatch.setattr(R, "SHARD_DOCS", shard)
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "SEED", 2)
    monkeypatch.setattr(R, "QUERY_TERMS", 12)
    rng = random.Random(seed)
    docs = corpus(rng, 150)
    items = ["the of", "w1 w2 w3 straße", "日本 x1 DON'T the", docs[0][1], docs[5][1], "", None, "unknown words", "unknown the", "w7"]
    frame = spark.createDataFrame([(d, x, 1, "t") for d, x in docs], "doc_id long, text string, rank int, terms string").repartition(5)
    asked = spark.createDataFrame([(i, x, "s") for i, x in enumerate(items)], "item_id long, text string, score string")
    got = {}
    for r in R.search(frame, asked, k).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    want = {i: x for i, x in enumerate(brute(docs, items, k)) if x}
    assert {i: sorted(x) for i, x in got.items()} == want


def test_empty_tables_and_repeated_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a"), (None, "a"), (5, "zzz")], "item_id long, text string")
    assert [tuple(r)[:3] for r in R.search(docs, items).collect()] == [(None, 1, 1), (None, 1, 1)]
    assert R.search(docs.where("doc_id < 0"), items).count() == 0
    assert R.search(docs, items.where("item_id < 0")).columns == ["item_id", "rank", "doc_id", "score"]


def vectors(rng, n, size):
    """Documents of some subjects, as lengths, terms and weights."""
    out = []
    for i in range(n):
        subject = rng.integers(0, 8) * (size // 8)
        own = np.unique(np.r_[subject + rng.integers(0, size // 8, 12), rng.integers(0, size, 3)])
        out.append((own, rng.integers(1, 1_000_000, len(own))))
    return np.array([len(x) for x, _ in out]), np.concatenate([x for x, _ in out]), np.concatenate([w for _, w in out]), out


def test_bounds_hold_and_blocks_are_skipped():
    rng = np.random.default_rng(5)
    lengths, terms_, weights, rows = vectors(rng, 3000, 160)
    made = R.Shard.of(160, pa.array(range(3000), pa.int64()), lengths, terms_, weights)
    shard = R.Shard.parse(160, made.doc_ids, made.row())
    for first, end, term in shard.blocks.tolist():
        assert end - first <= R.BLOCK
        for place in shard.lists[first:end].tolist():
            own, worth = rows[place]
            assert term in own and (shard.summaries[(shard.blocks[:, 0] == first)][0][own].astype(int) * R.STEP >= worth).all()
    seen = [0, 0]
    for q in range(40):
        asked = np.unique(rng.integers(0, 20, 6) + 20 * (q % 8))
        worth = rng.integers(1, 9000, len(asked))
        best = R.Best(10, 1)
        R.search_shard(shard, asked, worth, best, seen)
        wide = dict(zip(asked.tolist(), worth.tolist()))
        scores = sorted((-sum(wide.get(t, 0) * w for t, w in zip(own.tolist(), ws.tolist())), i) for i, (own, ws) in enumerate(rows))
        assert [(s, d) for s, _, d in best.rows] == [x for x in scores if x[0] < 0][:10]
    assert seen[0] > 0


def test_clusters_hold_like_documents():
    """Blocks of a term that all subjects share hold mostly one subject each."""
    lengths = np.full(1024, 9)
    own = np.array([[0, *(1 + 8 * (i % 16) + np.arange(8))] for i in range(1024)])
    shard = R.Shard.of(129, pa.array(range(1024), pa.int64()), lengths, own.ravel(), np.full(own.size, 500_000))
    blocks = [shard.lists[a:b] for a, b, t in shard.blocks.tolist() if t == 0]
    assert sum(len(set((x % 16).tolist())) == 1 for x in blocks) >= 0.9 * len(blocks) > 0
    # a query of one subject reads its blocks only, also in the list of the term that all share
    seen, best = [0, 0], R.Best(5, 1)
    R.search_shard(shard, np.array([0, 9, 10]), np.array([5000, 3000, 3000]), best, seen)
    assert [d for _, _, d in best.rows] == [1, 17, 33, 49, 65] and seen[1] > 4 * seen[0]


def test_query_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.sql(f'SELECT item_id, "rank", doc_id, score FROM ({ORACLE_SQL["op12_geometric_blocks"]})').fetchall())
    assert sorted(tuple(r) for r in QUERIES["op12_geometric_blocks"](spark, SF).select("item_id", "rank", "doc_id", "score").collect()) == want
