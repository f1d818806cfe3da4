"""Byte-pair encoding with word ends by a walk over a trie of distinct words, and its decoding.

The last token of a prefix's encoding is the one token that ends there, is its own encoding,
and stays apart from the last token of what is before it. So the encoding of a prefix is a
state per place, each found from the states before, and words with a common prefix share
those states: the distinct words of a batch go into a trie, a depth-first walk gives every
place its last token once, and a word's ids are read back from its leaf."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tokenizer_path
from .hashing import worker_memo

WORD_BPE = "word_bpe_49k.json"
#: Entries in each of two generations of a memo, and the longest key, in bytes, that stays in one.
MEMO_ENTRIES, LONGEST_KEY = 400_000, 64
#: Pairs of tokens whose verdict is kept.
MEMO_PAIRS = 500_000
NEVER = 1 << 60
#: A symbol that ends a word is its byte plus this.
END = 256
#: Letters that are composed already and have a lower case of one letter each, beside ASCII.
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
#: What the classes of the file's pattern mean among such text in lower case.
PLAIN_CLASSES = {r"\p{L}": "a-zß-öø-ÿ", r"\p{N}": "0-9", r"\s": " \t-\r"}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the files of byte-level tokenizers, with that byte:
    printable ones stand for themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Merges:
    """Tokens as strings of symbols, and which tokens stay apart side by side.

    Needs what the argument above needs: each token but the symbols is the result of one
    merge, of tokens that are symbols or results of earlier merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()
        form = {c: chr(b) for c, b in letters.items()}
        form.update({c + suffix: chr(b + END) for c, b in letters.items()})
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for i, (a, b) in enumerate(merges):
            if a not in form or b not in form or a + b in form:
                raise ValueError(f"merge {i} isn't of earlier tokens to a new one")
            form[a + b] = form[a] + form[b]
            self.rank[vocab[a], vocab[b]] = i
            parts[vocab[a + b]] = (i, vocab[a], vocab[b])
        self.parts = parts
        self.rights: dict[int, list[tuple[int, int]]] = {}
        self.lefts: dict[int, list[tuple[int, int]]] = {}
        own = {vocab[c] for c in form if vocab[c] not in parts}
        for t, (_, left, right) in parts.items():  # in the order of the merges
            if left in own and right in own and self.undisturbed(left, right):
                own.add(t)
        tokens = {s: vocab[c] for c, s in form.items() if vocab[c] in own}
        #: Ends of the tokens that are their own encoding, by symbols; with the token's id where the end is one itself, else -1.
        self.tails = {**{s[i:]: -1 for s in tokens for i in range(len(s))}, **tokens}
        self.apart_memo: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one end of a token (1: left, 2: right) while its merges are applied:
        (token, rank of the merge that takes it up), the whole last."""
        memo = self.lefts if side == 1 else self.rights
        found = memo.get(token)
        if found is None:
            found, until = [(token, NEVER)], token
            while until in self.parts:
                taken = self.parts[until][0]
                until = self.parts[until][side]
                found.append((until, taken))
            found.reverse()
            memo[token] = found
        return found

    def undisturbed(self, left: int, right: int) -> bool:
        """Whether both tokens come to be, side by side, before any merge across their border."""
        a, b, i, j = self.edge(left, 2), self.edge(right, 1), 0, 0
        while i < len(a) - 1 or j < len(b) - 1:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.rank.get((x, y), NEVER)
            # of equal merges that overlap, the one further left goes first
            if across < x_until and across <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        return True

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are an encoding; kept in apart_memo at left << 32 | right."""
        if len(self.apart_memo) >= MEMO_PAIRS:
            self.apart_memo.clear()
        found = self.apart_memo[left << 32 | right] = (left, right) not in self.rank and self.undisturbed(left, right)
        return found


class Trie:
    """Words by common prefixes; an edge holds all symbols up to the next branching."""

    __slots__ = ("label", "below")

    def __init__(self, label: str = "", below: dict[str, "Trie"] | None = None):
        self.label, self.below = label, {} if below is None else below

    def insert(self, word: str) -> None:
        node, at = self, 0
        while at < len(word):
            child = node.below.get(word[at])
            if child is None:
                node.below[word[at]] = Trie(word[at:])
                return
            if word.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = 1
            while child.label[n] == word[at + n]:  # ends before a word does, as no word is another's prefix
                n += 1
            head = Trie(child.label[:n], {child.label[n]: child})
            child.label = child.label[n:]
            node.below[word[at]] = head
            node, at = head, at + n

    def encodings(self, merges: Merges) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of all words: each place of the trie gets its last token once."""
        tail_token, known, apart = merges.tails.get, merges.apart_memo.get, merges.apart
        last = [-1]  # of the walk's path, by its length; sizes likewise
        sizes = [0]
        todo = [("", x) for x in self.below.values()]
        while todo:
            before, node = todo.pop()
            path = before + node.label
            del last[len(before) + 1 :], sizes[len(before) + 1 :]
            for end in range(len(before) + 1, len(path) + 1):
                first, found = end - 1, []
                while first >= 0 and (token := tail_token(path[first:end])) is not None:
                    if token >= 0:
                        found.append((first, token))
                    first -= 1
                while found:
                    first, token = found.pop()
                    if not first:
                        break
                    left = last[first]
                    fits = known(left << 32 | token)
                    if fits or fits is None and apart(left, token):
                        break
                else:
                    raise ValueError("a prefix without an encoding")
                last.append(token)
                sizes.append(end - first)
            if node.below:
                todo += [(path, x) for x in node.below.values()]
            else:
                ids, end = [], len(path)
                while end:
                    ids.append(last[end])
                    end -= sizes[end]
                ids.reverse()
                yield path, ids


class Memo:
    """Key to ids as bytes, in two generations, so that what is in use stays and its size is bounded."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: Iterable) -> list:
        """Those keys that neither generation holds; the others are young from now on."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for x in keys:
            if x not in young:
                if x in old:
                    young[x] = old[x]
                else:
                    out.append(x)
        return out

    def forget(self, keys: Iterable) -> None:
        for x in keys:
            if len(x) > LONGEST_KEY:
                self.young.pop(x, None)


class TrieEncoder:
    """ids and back, as the tokenizers library has them for the same file.

    Of the library's work only the normalizer and the splitting into words are called, for
    pieces with letters beyond Latin-1. A text is cut at ASCII white space, which neither
    the normalizer nor a word crosses."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        model, added = settings["model"], settings["added_tokens"]
        steps = [x["type"] for x in (settings["normalizer"] or {}).get("normalizers", [])]
        cuts = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        as_is = not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added)
        if not plain or not as_is or steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or settings["post_processor"] or settings["decoder"]:
            raise ValueError(f"{path} has steps that this encoder doesn't know")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = Merges(model["vocab"], [tuple(x) for x in model["merges"]], model["end_of_word_suffix"])
        pattern = cuts[0]["pattern"]["Regex"]
        for name, letters in PLAIN_CLASSES.items():
            pattern = pattern.replace(name, letters)
        self.plain_words = re.compile(pattern)
        self.bytes_of = str.maketrans({c: chr(b) for c, b in byte_letters().items()})
        self.special = {x["content"]: np.uint32(x["id"]).tobytes() for x in added}
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        named = self.library.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(named.values()) + 1)
        for name, i in named.items():
            self.names[i] = name
        self.chunks, self.words = Memo(memo_entries), Memo(memo_entries)

    def words_of(self, text: str) -> list[str]:
        """The words of a text without special tokens, as symbols."""
        if PLAIN.fullmatch(text):
            found = [x.encode().decode("latin-1") for x in self.plain_words.findall(text.lower())]
        else:
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            found = [x.translate(self.bytes_of) for x, _ in cut]
        return [x[:-1] + chr(ord(x[-1]) + END) for x in found]

    def learn(self, chunks: list[bytes]) -> None:
        """Put the ids of these pieces of text into the memo."""
        parts: list[list[str]] = []
        rare: dict[bytes, list[str | bytes]] = {}
        wanted: set[str] = set()
        for chunk in chunks:
            text = chunk.decode()
            if self.specials and self.specials.search(text):
                cut = [[self.special[x]] if x in self.special else self.words_of(x) for x in self.specials.split(text)]
                rare[chunk] = [x for some in cut for x in some]
                own = [x for x in rare[chunk] if isinstance(x, str)]
            else:
                own = self.words_of(text)
            parts.append(own)
            wanted.update(own)
        fresh = self.words.missing(wanted)
        trie = Trie()
        for x in fresh:
            trie.insert(x)
        ids, known = self.words.young, self.chunks.young
        for x, found in trie.encodings(self.merges):
            ids[x] = array("I", found).tobytes()
        for chunk, own in zip(chunks, parts):
            known[chunk] = ids[own[0]] if len(own) == 1 else b"".join([ids[x] for x in own])
        for chunk, own in rare.items():
            known[chunk] = b"".join([ids[x] if isinstance(x, str) else x for x in own])
        self.words.forget(fresh)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [x.encode().split() for x in texts]
        fresh = self.chunks.missing(set().union(*split))
        self.learn(fresh)
        get = self.chunks.young.__getitem__
        out = [b"".join(map(get, x)) for x in split]
        self.chunks.forget(fresh)
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens' names with a space between each two: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> TrieEncoder:
    """One encoder per Python worker and file, as long as the worker does nothing else."""
    return worker_memo(("trie", path), lambda: TrieEncoder(path))


def encoded(docs: DataFrame, tokenizer: str = WORD_BPE, decoded: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of docs(doc_id, text): ids are little-endian unsigned 32-bit
    integers; decoded, where wanted, is made from them.

    No shuffle; texts go through a task in pieces of some megabytes, a longer text as a
    whole. A null or empty text, and one of white space, has no ids and decodes to the empty
    text; equal rows stay; an empty table gives no rows; other columns are ignored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            for part in slices(batch, 4_000_000):
                ids = enc.encode([x or "" for x in part.column("text").to_pylist()])
                texts = [enc.decode(x) for x in ids] if decoded else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary, decoded string")


def decoded(rows: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """(doc_id, decoded) of rows(doc_id, ids); null ids give null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    some = rows.select("doc_id", "ids")
    return some.mapInArrow(work, f"doc_id {dict(some.dtypes)['doc_id']}, decoded string")


def op11_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
