"""Token counts by rank-synchronous merging of numpy arrays.

The distinct pre-tokens of a slice of texts are laid out as one ragged array of symbol ids.
In each round every sequence finds the lowest merge rank among its adjacent pairs and
applies that merge at all its places at once; sequences without a mergeable pair leave.
The symbols that survive are the tokens. Merging all places of a sequence's lowest rank at
once equals merging one after another because a merge never makes a pair of lower rank
(checked when a vocabulary is loaded).

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a
text count as one token, as in the tokenizers library; whole texts count, whatever their
length; an empty table gives an empty result; a kept column named like a result is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlab.llm.bpe_model import Model
from raterlab.llm.common import kept_by_worker, map_texts

#: Pre-tokens whose counts are remembered per worker; emptied when full.
REMEMBERED = 400_000
NEVER = np.int32(2**31 - 1)


class Merger:
    """The merge table as an open-addressing hash of (left, right) ids in numpy arrays."""

    def __init__(self, model: Model) -> None:
        vocab = model.vocab
        left, right, made = (np.array(x, np.int64) for x in zip(*[
            (vocab[a], vocab[b], vocab[a + b]) for a, b in model.ranks]))
        rank_of = np.full(max(vocab.values()) + 1, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        if (rank_of[left] >= np.arange(len(left))).any() or (rank_of[right] >= np.arange(len(right))).any():
            raise ValueError("a merge comes before the merge that makes one of its parts")
        self.made = made
        self.size = 1 << (4 * len(left)).bit_length()
        keys = left << 32 | right
        self.keys = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, NEVER, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]  # of several that want a slot, the last has it
            won = free[self.keys[slot[free]] == keys[free]]
            self.rank[slot[won]] = won
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
            self.probes += 1
        self.units = np.array([vocab.get(c, -1) for c in model.letters], np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - (self.size.bit_length() - 1))).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.rank[slot], NEVER)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (self.size - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return found

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (its UTF-8 bytes)."""
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.units[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        known = ids >= 0
        ids, owner = ids[known], owner[known]
        while len(ids):
            same = owner[1:] == owner[:-1]
            rank = np.full(len(ids), NEVER, np.int32)
            at = np.flatnonzero(same)
            rank[at] = self.ranks(ids[at], ids[at + 1])
            first = np.flatnonzero(np.r_[True, ~same])
            low = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(ids)])
            low_here = np.repeat(low, sizes)
            still = low_here != NEVER
            done = low == NEVER
            out[owner[first[done]]] = sizes[done]
            ids, owner, rank, low_here = ids[still], owner[still], rank[still], low_here[still]
            hit = rank == low_here
            # overlapping places (as in "aaa") merge from the left: every second of a run
            places = np.flatnonzero(hit)
            if not len(places):
                break
            run = np.r_[True, np.diff(places) != 1]
            start = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - start) % 2 == 0]
            ids[places] = self.made[rank[places]]
            stays = np.ones(len(ids), bool)
            stays[places + 1] = False
            ids, owner = ids[stays], owner[stays]
        return out


class Counter:
    def __init__(self, source: str) -> None:
        self.model = Model(source)
        if self.model.suffix:
            raise ValueError("vocabularies with word ends are not supported here")
        self.merger = Merger(self.model)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text of a slice."""
        known = self.known
        split, extra = [], []
        for t in texts:
            words, n = [], 0
            for piece, special in self.model.pieces(t):
                if special:
                    n += 1
                else:
                    words += self.model.words(piece)
            split.append(words)
            extra.append(n)
        new = set().union(*split).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set().union(*split)
        new = list(new)
        known.update(zip(new, self.merger.counts([w.encode("utf-8") for w in new]).tolist()))
        return [sum(map(known.__getitem__, words)) + n for words, n in zip(split, extra)]


def token_counts(docs: DataFrame, vocabulary: str, keep: list[str], text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit. ``vocabulary``: the content of a vocabulary file."""
    def worker():
        counter = kept_by_worker("counter" + vocabulary, lambda: Counter(vocabulary))

        def compute(texts):
            return [[len(t.encode("utf-8")) for t in texts], counter.count(texts)]
        return compute
    out = map_texts(docs, text_col, keep, "n_bytes long, n_tokens long", worker)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
