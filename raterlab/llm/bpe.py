"""Byte-pair encoding and decoding with a public vocabulary.

A word is held as one string with its part boundaries and, in an array beside them, the
merge rank of each adjacent pair. The smallest rank is found by scanning, its boundary is
deleted and the ranks of the two neighbours are looked up again, until no pair can merge.
Words beyond SHORT symbols would scan too long; they take the same merges from a heap.

Results equal the tokenizers library's ``encode(text, add_special_tokens=False)`` and
``decode(ids, skip_special_tokens=False)``: special strings inside a text become their ids.
Defined results: a null or empty text has no ids and decodes to the empty string; texts are
encoded whole, whatever their length; repeated rows give repeated results; an empty table
gives an empty one; a kept column named like a result column is replaced.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame

from raterlab.llm.bpe_model import Model
from raterlab.llm.common import kept_by_worker, map_texts

SHORT = 256
#: Pieces of text remembered per worker; the memory is emptied when full.
REMEMBERED = 600_000
#: information separators
CONTROLS = re.compile("[\x1c-\x1f]")
NEVER = 1 << 60


class Merges:
    """Merge ranks by a pair of symbol ids (left << 32 | right), and the id that each rank makes."""

    def __init__(self, model: Model) -> None:
        vocab = model.vocab
        self.rank = {vocab[a] << 32 | vocab[b]: r for (a, b), r in model.ranks.items()}
        self.made = [vocab[a + b] for a, b in model.ranks]


def merge_short(ids: list[int], merges: Merges) -> tuple[list[int], list[int]]:
    """Part ids and part boundaries of a word after all merges, by scanning the array of adjacent ranks."""
    get, made = merges.rank.get, merges.made
    cut = list(range(len(ids) + 1))
    rank = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
    while rank:
        low = min(rank)
        if low == NEVER:
            break
        i = rank.index(low)
        part = ids[i] = made[low]
        del cut[i + 1], ids[i + 1], rank[i]
        if i:
            rank[i - 1] = get(ids[i - 1] << 32 | part, NEVER)
        if i < len(rank):
            rank[i] = get(part << 32 | ids[i + 1], NEVER)
    return ids, cut


def merge_long(ids: list[int], merges: Merges) -> list[int]:
    """The same part ids for long words: candidates in a heap by (rank, place), neighbours as links."""
    get, made = merges.rank.get, merges.made
    end = len(ids)
    right, left = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [(r, i) for i in range(end - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i]
        if ids[i] < 0 or j >= end or get(ids[i] << 32 | ids[j]) != rank:
            continue
        ids[i], ids[j] = made[rank], -1
        right[i] = right[j]
        if right[i] < end:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < end and (r := get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, (r, a))
    return [p for p in ids if p >= 0]


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit integers)."""

    def __init__(self, source: str) -> None:
        self.model = Model(source)
        self.special = {s: i.to_bytes(4, "little") for s, i in self.model.special.items()}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.merges = Merges(self.model)
        vocab, letters, suffix = self.model.vocab, self.model.letters, self.model.suffix
        self.inner = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + suffix, -1) for c in letters]

    def learn(self, word: str) -> bytes:
        data, inner = word.encode("utf-8"), self.inner
        ids = [inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        if -1 in ids:
            ids = [i for i in ids if i >= 0]
        parts = merge_short(ids, self.merges)[0] if len(ids) <= SHORT else merge_long(ids, self.merges)
        return b"".join([i.to_bytes(4, "little") for i in parts])

    def encode(self, text: str) -> bytes:
        model, out = self.model, []
        for piece, special in model.pieces(text):
            if special:
                out.append(self.special[piece])
                continue
            normal = model.normal(piece)
            # words never hold white space, so what lies between it is remembered whole;
            # str.split() also splits at four controls that are no white space here
            if normal is None or model.spaced or CONTROLS.search(normal):
                out += [self.learn(w) for w in model.words(piece)]
                continue
            chunks = normal.split()
            new = set(chunks).difference(self.known)
            if new:
                if len(self.known) + len(new) > REMEMBERED:
                    self.known.clear()
                    self.words.clear()
                    new = set(chunks)
                words = self.words
                for c in new:
                    split = model.split(c)
                    for w in split:
                        if w not in words:
                            words[w] = self.learn(w)
                    self.known[c] = words[c] if len(split) == 1 and split[0] == c else b"".join(map(words.__getitem__, split))
            out += map(self.known.__getitem__, chunks)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return self.model.decode(np.frombuffer(packed, "<u4").tolist())


def unpack(packed: bytes) -> list[int]:
    """Packed ids as a list."""
    return np.frombuffer(packed, "<u4").tolist()


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens and ids (packed). ``vocabulary``: the content of a vocabulary
    file (a MB or two), which travels with the job, so executors need no copy of the file."""
    def worker():
        coder = kept_by_worker("encoder" + vocabulary, lambda: Encoder(vocabulary))

        def compute(texts):
            packed = [coder.encode(t) for t in texts]
            return [[len(p) // 4 for p in packed], packed]
        return compute
    return map_texts(docs, text_col, keep, "n_tokens long, ids binary", worker)


def encode_decode(docs: DataFrame, vocabulary: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, ids (packed) and decoded, the text that the ids decode to."""
    def worker():
        coder = kept_by_worker("encoder" + vocabulary, lambda: Encoder(vocabulary))

        def compute(texts):
            packed = [coder.encode(t) for t in texts]
            return [[len(p) // 4 for p in packed], packed, [coder.decode(p) for p in packed]]
        return compute
    return map_texts(docs, text_col, keep, "n_tokens long, ids binary, decoded string", worker)
