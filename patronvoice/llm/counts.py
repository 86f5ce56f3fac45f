"""Token counts of a byte-level BPE by merging whole batches of pre-tokens at once.

The symbols of many pre-tokens lie in one flat array with the pre-token of each
symbol beside it. A step looks up the rank of every adjacent pair, takes the
lowest rank within each pre-token, and applies that pair wherever it occurs in
that pre-token; among overlapping occurrences the left one wins. Pre-tokens
without a pair left are counted and leave the arrays. A merge only ever makes
pairs of higher rank than its own (checked when the tokenizer is loaded), so
this gives what merging one pair at a time gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from patronvoice.llm.common import other_columns, register, table
from patronvoice.llm.tokens import CACHE_WORDS, byte_tokenizer

LIMIT = 1024
_NONE = np.iinfo(np.int32).max


class PairRanks:
    """Rank and result of a pair of symbols, in an open-addressed table of numpy arrays."""

    def __init__(self, merges: Sequence[tuple[int, int, int]]):
        self.bits = max(4, (8 * max(1, len(merges))).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1, dtype=np.int64)
        self.rank = np.full(size, _NONE, dtype=np.int32)
        self.made = np.array([m for _, _, m in merges], dtype=np.int64)
        keys = np.array([a << 32 | b for a, b, _ in merges], dtype=np.int64)
        self.longest = 0
        left = np.arange(len(merges))
        while len(left):  # each round places the first merge that asks for a free slot
            slot = (self._slot(keys[left]) + self.longest) & (size - 1)
            free = self.key[slot] == -1
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(left), dtype=bool)
            take[first] = True
            take &= free
            self.key[slot[take]] = keys[left[take]]
            self.rank[slot[take]] = left[take]
            left = left[~take]
            self.longest += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = self._slot(key)
        found = np.where(self.key[slot] == key, self.rank[slot], _NONE)
        open_ = np.flatnonzero((found == _NONE) & (self.key[slot] != -1))
        for step in range(1, self.longest):
            if not len(open_):
                break
            at = (slot[open_] + step) & (len(self.key) - 1)
            hit = self.key[at] == key[open_]
            found[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit & (self.key[at] != -1)]
        return found


def count_merged(symbols: np.ndarray, sizes: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """How many symbols each sequence has left when no pair can be merged.

    ``symbols`` are the sequences one after the other, ``sizes`` their lengths.
    """
    x = symbols.astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    count = np.asarray(sizes, dtype=np.int64).copy()
    rank = np.full(len(x), _NONE, dtype=np.int32)  # of the pair that starts here
    if len(x) > 1:
        inside = owner[1:] == owner[:-1]
        rank[:-1][inside] = ranks.of(x[:-1][inside], x[1:][inside])
    while len(x):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(rank, first)
        length = np.diff(np.append(first, len(x)))
        alive = np.repeat(best != _NONE, length)
        if not alive.all():
            x, owner, rank, best, length = x[alive], owner[alive], rank[alive], best[best != _NONE], length[best != _NONE]
            if not len(x):
                break
        hit = rank == np.repeat(best, length)
        # of a run of overlapping hits every other one counts, from the left
        place = np.arange(len(x))
        run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
        hit &= (place - run) % 2 == 0
        at = np.flatnonzero(hit)
        x[at] = ranks.made[rank[at]]
        np.subtract.at(count, owner[at], 1)
        keep = np.ones(len(x), dtype=bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        x, owner, rank = x[keep], owner[keep], rank[keep]
        # only pairs beside a new symbol have changed
        at = moved[at]
        stale = np.union1d(at, np.maximum(at - 1, 0))
        rank[stale] = _NONE
        stale = stale[stale + 1 < len(x)]
        stale = stale[owner[stale] == owner[stale + 1]]
        rank[stale] = ranks.of(x[stale], x[stale + 1])
    return count


_LOOSE = re.compile(r" (?=\s|$)")
_UNIT = re.compile(r" (?=\S)")


class TokenCounter:
    """Counts the tokens of whole texts for a byte-level BPE file.

    A space followed by anything but white space starts a new pre-token whatever
    stands before it, so a text is cut there and the counts of the parts are kept
    in a bounded table. The library itself finds the pre-tokens of a part. Special
    strings inside a text are one token each, as the library does by default.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = spec.get("normalizer") is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a plain byte-level BPE is needed")
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special strings must be taken as they are")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        vocab = model["vocab"]
        merges, born = [], {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if born.setdefault(a + b, rank) != rank or born.get(a, -1) >= rank or born.get(b, -1) >= rank:
                raise ValueError("merges must follow the merges that make their parts")
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.ranks = PairRanks(merges)
        self.symbol = np.zeros(1 << 10, dtype=np.int64)
        for text, number in vocab.items():
            if len(text) == 1:
                self.symbol[ord(text)] = number
        self.cache_words = cache_words
        self.head: dict[str, int] = {}  # parts at the start of a text
        self.tail: dict[str, int] = {}  # parts behind a space

    def count(self, texts: Sequence[str]) -> list[int]:
        out, cut = [], []
        for text in texts:
            pieces = [text]
            special = 0
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                special = len(pieces) - 1
            out.append(special)
            cut.append([(_UNIT if _LOOSE.search(p) else _SPACE).split(p) if p else [] for p in pieces])
        for i in range(0, len(cut), 256):
            part = cut[i : i + 256]
            self._learn(self.head, "", {p[0] for pieces in part for p in pieces if p})
            self._learn(self.tail, " ", {u for pieces in part for p in pieces for u in p[1:]})
            for k, pieces in enumerate(part, i):
                for p in pieces:
                    if p:
                        out[k] += self.head[p[0]] + sum(map(self.tail.__getitem__, p[1:]))
            if len(self.head) + len(self.tail) > self.cache_words:
                self.head, self.tail = {}, {}
        return out

    def _learn(self, known: dict[str, int], lead: str, parts: set[str]) -> None:
        new = list(parts.difference(known))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            found = [self.pre.pre_tokenize_str(lead + p) for p in some]
            words = [w for f in found for w, _ in f]
            codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
            counts = count_merged(self.symbol[codes], np.array([len(w) for w in words], dtype=np.int64), self.ranks)
            ends = np.cumsum([len(f) for f in found])
            sums = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])]
            known.update(zip(some, np.diff(sums).tolist()))


class _SPACE:
    """Splitting at every space, for texts in which each one precedes a word."""

    @staticmethod
    def split(text: str) -> list[str]:
        return text.split(" ")


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) in place of the text.

    A null text counts as the empty text, with no token. Rows are independent:
    repeated rows give repeated results, an empty table gives none, and columns
    that would clash with the three new ones are replaced.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    keep = other_columns(docs, text_col, *new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                tokens = np.array(count(texts), dtype=np.int64)
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                columns = [batch.column(i) for i in range(len(keep))]
                columns += [pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in keep), *new])

    schema = T.StructType(list(keep)).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text_col)).mapInArrow(run, schema)


@register("op2_rank_synchronous_counts")
def op2(spark, folder):
    return count_tokens(table(spark, folder, "documents").select("doc_id", "text"), byte_tokenizer())
