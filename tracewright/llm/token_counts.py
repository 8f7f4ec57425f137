"""Token counts by rank-synchronous merging of ragged arrays of symbols."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import by_place, named, without

#: Distinct pre-tokens merged at a time, and their characters at most.
BATCH_WORDS, BATCH_SYMBOLS = 1 << 16, 1 << 20
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
#: Characters of a text that are split into pre-tokens at a time.
BLOCK = 1 << 20


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizers file; counts what that library's encode would give."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or not splits[0]["invert"] or not model["end_of_word_suffix"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a word-end BPE of the kind that is counted here")
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs))
        self.size = max(vocab.values()) + 1
        # a merge is safe to apply to all its places at once if what it makes takes part in later merges only
        soonest = np.full(self.size, len(pairs), dtype=np.int64)
        np.minimum.at(soonest, left, rank)
        np.minimum.at(soonest, right, rank)
        self.safe, self.made = soonest[made] > rank, made
        key = left * self.size + right
        self.bits = int(np.ceil(np.log2(4 * len(key))))
        self.table_key, self.table_rank = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        self.none = len(pairs)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):  # open addressing, all keys a step at a time
            free = self.table_key[slot[todo]] == -1
            first = todo[free][np.unique(slot[todo[free]], return_index=True)[1]]
            self.table_key[slot[first]], self.table_rank[slot[first]] = key[first], rank[first]
            todo = np.setdiff1d(todo, first)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.seen: dict[str, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair of symbols, or ``none``."""
        key = left * self.size + right
        slot = self._slot(key)
        out = np.full(len(key), self.none, dtype=np.int64)
        todo = np.arange(len(key))
        while len(todo):
            there = self.table_key[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.table_rank[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def merged_lengths(self, words: list[str]) -> np.ndarray:
        """How many symbols survive of each word (not empty): in each round every word applies its lowest-rank pair."""
        coded = [w.encode() for w in words]
        length = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        symbol = self.inner[raw]
        ends = np.cumsum(length) - 1
        symbol[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(coded)), length)
        final = length.copy()
        pair = np.full(len(symbol), self.none, dtype=np.int64)
        if len(symbol) > 1:
            pair[:-1] = np.where(word[1:] == word[:-1], self.ranks(symbol[:-1], symbol[1:]), self.none)
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(pair, begin)
            size = np.diff(np.concatenate([begin, [len(word)]]))
            going = least < self.none
            final[word[begin[~going]]] = size[~going]
            keep = np.repeat(going, size)
            symbol, word, pair = symbol[keep], word[keep], pair[keep]
            if not len(symbol):
                break
            least, size = least[going], size[going]
            begin = np.cumsum(size) - size
            hit = pair == np.repeat(least, size)
            at = np.flatnonzero(hit)
            # of places in a row (a pair of equal symbols) every other one; of a pair that is not safe the first only
            new_run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run_start = at[new_run][np.cumsum(new_run) - 1]
            chosen = (at - run_start) % 2 == 0
            of = np.searchsorted(begin, at, side="right") - 1
            first = np.concatenate([[True], of[1:] != of[:-1]])
            at = at[chosen & (self.safe[least[of]] | first)]
            symbol[at] = self.made[pair[at]]
            alive = np.ones(len(symbol), dtype=bool)
            alive[at + 1] = False
            touched = np.zeros(len(symbol), dtype=bool)
            touched[at] = True
            symbol, word, pair, touched = symbol[alive], word[alive], pair[alive], touched[alive]
            renew = touched.copy()
            renew[:-1] |= touched[1:]
            where = np.flatnonzero(renew)
            pair[where] = self.none
            inner = where[where + 1 < len(symbol)]
            inner = inner[word[inner + 1] == word[inner]]
            pair[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        return final

    def pieces(self, text: str) -> tuple[int, Iterator[str]]:
        """Special strings in the text, and the text between them, in blocks that end between words."""
        parts = self.special.split(text) if self.special else [text]

        def blocks() -> Iterator[str]:
            for part in parts:
                at = 0
                while at < len(part):
                    end = min(len(part), at + BLOCK)
                    while end < len(part) and not part[end].isspace():
                        end += 1
                    yield part[at:end]
                    at = end

        return len(parts) - 1, blocks()

    def pretokens(self, text: str) -> list[str]:
        import unicodedata

        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter by itself: no final sigma
        return self.pattern.findall(text)

    def counts(self, texts: Iterator[str | None]) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        waiting: dict[str, int] = {}
        held: list[tuple[int, list[str]]] = []
        load = 0

        def settle() -> None:
            nonlocal load
            names = list(waiting)
            for at in range(0, len(names), BATCH_WORDS):
                some = names[at : at + BATCH_WORDS]
                for w, n in zip(some, self.merged_lengths(some).tolist(), strict=True):
                    waiting[w] = n
            get, new = self.seen.get, waiting
            for row, words in held:
                out[row] += sum(n if (n := get(w)) is not None else new[w] for w in words)
            if len(self.seen) + len(waiting) > REMEMBERED:  # only now that no text waits for what it holds
                self.seen.clear()
            if len(waiting) <= REMEMBERED:
                self.seen.update(waiting)
            waiting.clear()
            held.clear()
            load = 0

        for text in texts:
            special, blocks = self.pieces(text or "")
            out.append(special)
            for block in blocks:
                words = self.pretokens(block)
                fresh = [w for w in set(words) if w not in self.seen and w not in waiting]
                waiting.update(dict.fromkeys(fresh, 0))
                load += sum(map(len, fresh)) + len(words) // 8
                held.append((len(out) - 1, words))
                if load >= BATCH_SYMBOLS:
                    settle()
        settle()
        return out


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit) of each whole text.

    Null and empty texts count as 0. Special strings within a text count as one
    token each. Rows that repeat are counted each; columns of these names (in any
    case) are replaced, all others stay, whatever their names. No rows, no result.
    """
    out = ("n_bytes", "n_tokens", "over_limit")
    kept, fields = without(docs, out)
    text = named(text_col).cast("string")
    size = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    names = [f.name for f in fields] + ["n_bytes", "n_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            n = bpe.counts(t.as_py() for t in batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=names)

    rows = by_place(docs.select(*kept, size, text))
    counted = rows.mapInArrow(count, T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
