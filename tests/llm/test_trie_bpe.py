"""The trie's encodings against the tokenizers library, and merges against a plain merge loop."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioworks.llm import trie_bpe as T
from folioworks.llm.common import table, tokenizer_path
from folioworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t", "don't I'll x's 'S 'LL ''s's", "a\x1c b\x85c　d e", "<|endoftext|>x<|startoftext|><|endoftext|> <|endoftext", "ΑΣ ΟΔΟΣ", "İstanbul ŉ",
    "é àx́ é", "中文字符。日本語 한국어 각", "q" * 3000, "aaaa" * 50, "😀😃 👩‍👩‍👧", "x" + "́" * 5, " ́a", "½ ² ① ٣", "ª º µ ß ẞ ſ", "hahahahahaha",
    "\x00\x01", "naïve façade ×÷", "</w> a</w>", "word " * 4000, "TEXT, text. Text",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(T.WORD_BPE))


@pytest.fixture(scope="module")
def enc():
    return T.TrieEncoder(tokenizer_path(T.WORD_BPE))


def test_ids_and_texts_are_the_librarys(enc, library, spark):
    texts = [x or "" for x in ODD] + [r["text"] or "" for r in table(spark, SF, "documents").collect()]
    for text, got in zip(texts, enc.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want
        assert enc.decode(got) == library.decode(want, skip_special_tokens=False)


def test_a_small_memo_changes_nothing(enc, library, spark):
    small = T.TrieEncoder(tokenizer_path(T.WORD_BPE), memo_entries=30)
    texts = [r["text"] or "" for r in table(spark, SF, "documents").limit(40).collect()]
    for _ in range(2):
        for i in range(0, 40, 7):
            assert small.encode(texts[i : i + 7]) == enc.encode(texts[i : i + 7])
    assert max(len(small.chunks.old), len(small.words.old)) > 0


def test_random_letters_by_a_plain_merge_loop(enc):
    merges = enc.merges
    symbols = {s: i for s, i in merges.tails.items() if i >= 0}
    made = {pair: next(t for t, (r, *_) in merges.parts.items() if r == rank) for pair, rank in list(merges.rank.items())[:3000]}
    rng = random.Random(11)
    words = {"".join(rng.choice("aeinrthl") for _ in range(rng.randint(1, 14))) for _ in range(300)}
    trie = T.Trie()
    for x in words:
        trie.insert(x[:-1] + chr(ord(x[-1]) + T.END))
    got = dict(trie.encodings(merges))
    assert len(got) == len(words)
    checked = 0
    for word, ids in got.items():
        now = [symbols[c] for c in word]
        while True:
            ranked = [(merges.rank[p], i) for i, p in enumerate(zip(now, now[1:])) if p in merges.rank]
            if not ranked:
                break
            _, i = min(ranked)
            if (now[i], now[i + 1]) not in made:
                now = None
                break
            now[i : i + 2] = [made[now[i], now[i + 1]]]
        if now is not None:
            checked += 1
            assert now == ids
    assert checked > 50


def test_shared_prefixes_are_walked_once(enc):
    """Words of one long common prefix: the trie has its symbols once."""
    trie = T.Trie()
    for end in "abcde":
        trie.insert("thermodynamic" * 3 + end + chr(ord("s") + T.END))

    def held(node):
        return len(node.label) + sum(map(held, node.below.values()))

    assert held(trie) == 13 * 3 + 5 * 2


def test_operator_on_odd_rows(spark, library):
    rows = spark.createDataFrame([(i, x, "ids", 7) for i, x in enumerate(ODD)] + [(None, "a b", "x", None), (4, ODD[4], "ids", 7)], "doc_id long, text string, ids string, decoded int").repartition(3)
    got = T.encoded(rows).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        want = library.encode((("a b" if r.doc_id is None else ODD[r.doc_id]) or ""), add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want, skip_special_tokens=False)
    again = {(r.doc_id, r.decoded) for r in T.decoded(T.encoded(rows, decoded=False)).collect()}
    assert again == {(r.doc_id, r.decoded) for r in got}
    assert T.encoded(rows.where("doc_id < 0")).count() == 0


def test_a_very_long_text(enc, library):
    text = "".join(random.Random(3).choices("etaoin shrdlu", k=2_000_000)) + "x" * 300_000
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op11_trie_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
