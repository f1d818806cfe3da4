"""Token ids of whole texts by the tokenizers library, with a bounded memo of pieces.

A byte-level BPE splits a text before each white space that follows another character, so
a text may be cut before every single space whose left neighbour isn't white space, and
each piece has the ids that it has inside the text. Pieces repeat; each is encoded once
per Python worker as long as the memo holds it. Texts in which a piece ends in white space
go to the library whole."""

from __future__ import annotations

import os
import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import worker_memo

BYTE_BPE = "byte_bpe_50k.json"
#: Pieces in each of the two generations of the memo, about 200 bytes a piece, and the longest piece that stays.
MEMO_PIECES, LONGEST_PIECE = 300_000, 64

#: Letters up to an ASCII character that is none: a border for the library.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[\x00-\x7f])")


def encoder(path: str, memo_pieces: int = MEMO_PIECES) -> "PieceEncoder":
    """One encoder per Python worker and file, as long as the worker does nothing else."""
    return worker_memo(("pieces", path, memo_pieces), lambda: PieceEncoder(path, memo_pieces))


class PieceEncoder:
    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        lengths = self.library.get_vocab()
        self.widths = np.zeros(max(lengths.values()) + 1, np.int64)
        for token, i in lengths.items():
            self.widths[i] = len(token)
        self.memo_pieces = memo_pieces
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.rests: dict[str, bytes] = {}

    def wholes(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, by its call that leaves offsets out."""
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each after a space, encoded side by side and cut by their bytes."""
        out: list[bytes] = []
        for first in range(0, len(pieces), 2000):
            some = pieces[first : first + 2000]
            joined = " " + " ".join(some)
            ids = np.frombuffer(self.wholes([joined])[0], "<u4")
            ends = np.cumsum(self.widths[ids])
            data = np.frombuffer(joined.encode(), np.uint8)
            due = np.append(np.flatnonzero(data == 32)[1:], len(data))
            cuts = np.searchsorted(ends, due)
            if len(ids) and len(due) == len(some) and ends[-1] == due[-1] and np.array_equal(ends[cuts], due):
                raw, begin = ids.tobytes(), 0
                for cut in (4 * (cuts + 1)).tolist():
                    out.append(raw[begin:cut])
                    begin = cut
            else:
                out += self.wholes([f" {x}" for x in some])
        return out

    def learn(self, pieces: list[str]) -> set[str]:
        """Put each piece (a space and the piece, that is) into the memo; None where it can't stand alone.

        A piece of letters and then others is split at that border as the library does it,
        except where an apostrophe may decide; the letters are a piece of their own.
        Returns these fronts."""
        memo, old = self.young, self.old
        wanted = set(filter(str.isalpha, pieces))
        split: list[tuple[str, str, str]] = []
        for x in filterfalse(str.isalpha, pieces):
            if not x or x[-1].isspace():
                memo[x] = None
                continue
            match = LETTERS.match(x) if "'" not in x else None
            if match:
                front = match[0]
                split.append((x, front, x[match.end() :]))
                if front not in memo:
                    if front in old:
                        memo[front] = old[front]
                    else:
                        wanted.add(front)
            else:
                wanted.add(x)
        if len(self.rests) > self.memo_pieces:
            self.rests = {}
        rests = self.rests
        order = list(wanted)
        memo.update(zip(order, self.batch(order)))
        missing = list({rest for _, _, rest in split}.difference(rests))
        rests.update(zip(missing, self.wholes(missing)))
        for x, front, rest in split:
            memo[x] = memo[front] + rests[rest]
        for rest in missing:
            if len(rest) > LONGEST_PIECE:
                del rests[rest]
        return {front for _, front, _ in split}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, places, starts = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
        if len(self.young) > self.memo_pieces:
            self.old, self.young = self.young, {}
        young, old, fresh = self.young, self.old, []
        for x in words:
            if x not in young:
                if x in old:
                    young[x] = old[x]
                else:
                    fresh.append(x)
        fronts = self.learn(fresh)
        known = list(map(young.__getitem__, words))
        firsts = [words[i] for i in places[starts[:-1]].tolist()]
        # each distinct piece's ids lie in one array, the texts' first pieces after them; the texts are gathered from it
        lone = np.fromiter((x is None for x in known), bool, len(known))[places]
        lone[starts[:-1]] = [x == "" or x[-1].isspace() for x in firsts] & (np.diff(starts) > 1)
        places[starts[:-1]] = np.arange(len(known), len(known) + len(texts))
        parts = [x or b"" for x in known] + self.wholes(firsts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begins, held = np.cumsum(sizes) - sizes, sizes[places]
        ends = np.cumsum(held)
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(begins[places] - ends + held, held) + np.arange(ends[-1])]
        raw, cuts = ids.tobytes(), (4 * np.append(0, ends)[starts]).tolist()
        out = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(np.diff(np.append(0, np.cumsum(lone))[starts])).tolist():
            out[i] = self.wholes([texts[i]])[0]
        for x in (*fresh, *fronts):
            if len(x) > LONGEST_PIECE:
                young.pop(x, None)
        return out
