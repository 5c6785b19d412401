"""BPE encoding and decoding by a pair occurrence index.

Each task keeps the distinct words of its partition. Their symbols lie in flat
arrays linked left and right; an index maps every adjacent pair (by merge rank)
to all its positions. Active ranks are taken in ascending order: one rank is
applied at all its positions at once, and only the lists of the pairs next to
them are updated. Merge lists order a merged symbol before the merges that use
it, so ascending order over a whole partition equals the order within each word.

Defined results: null text counts as empty; an empty text has no ids, and its
decoded text is empty; special tokens written in a text become their own id;
the tokenizer file has no decoder, so decoding joins token strings with one
space, as the library does. Rows, repeated or not, are encoded one by one; texts
of any length are encoded whole. Extra columns are kept, except that a column
named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framelight.llm.text import append_columns

#: Distinct words that a task remembers from one group to the next; with more it starts anew.
WORD_CACHE = 250_000
_NONE = np.int32(2**31 - 1)
#: Positions whose pairs are looked up at once.
_AT_ONCE = 1 << 17

# The normaliser's white space and the word pattern of the format.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = f"[{_SPACES}]"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACES}\p{{L}}\p{{N}}]+"


class Vocabulary(NamedTuple):
    """What a tokenizer file holds, as arrays."""

    tokens: list[str]
    special: dict[str, int]
    first_ids: np.ndarray  # by byte: symbol inside a word
    last_ids: np.ndarray  # by byte: symbol at a word's end
    pair_keys: np.ndarray  # sorted left * n + right
    pair_ranks: np.ndarray
    merged: np.ndarray  # by rank
    doubles: frozenset[int]  # ranks whose pair repeats one symbol


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where visible, else the next code point from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read a tokenizer file of the word-end BPE kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in [*ids.items(), *special.items()]:
        tokens[i] = token
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
    right = np.array([ids[b] for _, b in merges], dtype=np.int64)
    keys = left * len(tokens) + right
    order = np.argsort(keys)
    chars = _byte_characters()
    return Vocabulary(
        tokens,
        special,
        np.array([ids[c] for c in chars], dtype=np.int32),
        np.array([ids[c + end] for c in chars], dtype=np.int32),
        keys[order],
        order.astype(np.int32),
        np.array([ids[a + b] for a, b in merges], dtype=np.int32),
        frozenset(np.flatnonzero(left == right).tolist()),
    )


def apply_merges(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each word."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(data)
    ends = np.cumsum(lengths)
    last = np.zeros(n, dtype=bool)
    last[ends - 1] = True
    symbol = np.where(last, vocab.last_ids[data], vocab.first_ids[data])
    following = np.arange(1, n + 1, dtype=np.int32)
    following[last] = -1
    preceding = np.arange(-1, n - 1, dtype=np.int32)
    preceding[ends[:-1]] = -1
    alive = np.ones(n, dtype=bool)
    size = len(vocab.tokens)

    def ranks_at(at: np.ndarray) -> np.ndarray:
        after = following[at]
        keys = symbol[at].astype(np.int64) * size + symbol[np.maximum(after, 0)]
        slot = np.minimum(np.searchsorted(vocab.pair_keys, keys), len(vocab.pair_keys) - 1)
        return np.where((after >= 0) & (vocab.pair_keys[slot] == keys), vocab.pair_ranks[slot], _NONE)

    every = np.arange(n, dtype=np.int32)
    rank = np.concatenate([ranks_at(every[low : low + _AT_ONCE]) for low in range(0, max(n, 1), _AT_ONCE)])
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray, ranks: np.ndarray) -> None:
        """Add positions to the lists of their pairs."""
        known = ranks != _NONE
        at, ranks = at[known], ranks[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(active, r)

    enter(every, rank)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[alive[at] & (rank[at] == r)]
        if len(lists) > 1:
            at = np.unique(at)
        if r in vocab.doubles:  # in a run of one symbol, pairs are taken from the left
            chosen, used = [], -1
            for p in np.sort(at).tolist():
                if p != used:
                    chosen.append(p)
                    used = int(following[p])
            at = np.array(chosen, dtype=np.int64)
        if not len(at):
            continue
        gone = following[at]
        beyond = following[gone]
        symbol[at] = vocab.merged[r]
        following[at] = beyond
        alive[gone] = False
        rank[gone] = _NONE
        has = beyond >= 0
        preceding[beyond[has]] = at[has]
        before = preceding[at]
        touched = np.unique(np.concatenate([at, before[before >= 0]]))
        rank[touched] = fresh = ranks_at(touched)
        enter(touched, fresh)
    return symbol[alive], np.add.reduceat(alive, ends - lengths, dtype=np.int64) if len(words) else lengths


class _Numbers(dict):
    """Words numbered in the order in which they were first asked for; ``fresh`` lists those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts; remembers the words it has met by number, and their ids in flat arrays."""

    def __init__(self, path: str):
        self.vocab = load(path)
        self._white, self._pattern = regex.compile(_WHITE + "+"), regex.compile(_WORDS)
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.vocab.special)) + ")") if self.vocab.special else None
        self._forget()

    def _forget(self) -> None:
        self._numbers = _Numbers()
        self._ids = np.zeros(0, dtype=np.int32)
        self._starts = np.zeros(1, dtype=np.int32)  # by number where the word's ids begin, one more than words

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand as words of their own."""
        parts = self._special.split(text) if self._special else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part:
                part = self._white.sub(" ", unicodedata.normalize("NFC", part))
                part = part.replace("Σ", "σ").lower()  # lower-cased character by character: no final sigma
                out += self._pattern.findall(part)
        return out

    def _learn(self) -> None:
        """Encode the words not met before."""
        fresh, self._numbers.fresh = self._numbers.fresh, []
        special = [self.vocab.special.get(w, -1) for w in fresh]
        plain = np.array(special, dtype=np.int32) < 0
        counts = np.ones(len(fresh), dtype=np.int64)
        ids, counts[plain] = apply_merges([w.encode() for w, s in zip(fresh, special, strict=True) if s < 0], self.vocab)
        out = np.empty(counts.sum(), dtype=np.int32)
        from_merges = np.repeat(plain, counts)
        out[from_merges], out[~from_merges] = ids, [s for s in special if s >= 0]
        self._starts = np.concatenate([self._starts, (len(self._ids) + np.cumsum(counts)).astype(np.int32)])
        self._ids = np.concatenate([self._ids, out])

    def number_words(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text by number, all of them encoded; numbers hold until the next call.

        A text's words are strings only while it is being split, so a group's memory
        goes with its distinct words.
        """
        if len(self._numbers) > WORD_CACHE:
            self._forget()
        number, out = self._numbers.__getitem__, []
        for t in texts:
            words = self.split(t)
            out.append(np.fromiter(map(number, words), np.int32, len(words)))
        if self._numbers.fresh:
            self._learn()
        return out

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words one after another."""
        starts = self._starts[numbers]
        counts = self._starts[numbers + 1] - starts
        ends = np.cumsum(counts)
        return self._ids[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def count_ids(self, numbers: np.ndarray) -> int:
        return int((self._starts[numbers + 1] - self._starts[numbers]).sum())

    def spellings(self, numbered: list[np.ndarray]) -> tuple[dict[int, str], dict[int, str]]:
        """The ids of every word that occurs in decimals, and its decoded text, by number."""
        here = np.unique(np.concatenate(numbered))
        ids, stops = self.ids_of(here).tolist(), np.cumsum(self._starts[here + 1] - self._starts[here]).tolist()
        written, decoded, start = {}, {}, 0
        for w, stop in zip(here.tolist(), stops, strict=True):
            own = ids[start:stop]
            written[w], decoded[w] = " ".join(map(str, own)), self.decode(own)
            start = stop
        return written, decoded

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [self.ids_of(n).tolist() for n in self.number_words(texts)]

    def encode_lists(self, texts: list[str]) -> pa.Array:
        """The ids of each text as a list array."""
        ids = [self.ids_of(n) for n in self.number_words(texts)]
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([self._ids[:0], *ids]), pa.int32()))

    def decode(self, ids: list[int]) -> str:
        """Token strings joined with one space; unknown ids are skipped."""
        tokens = self.vocab.tokens
        return " ".join([tokens[i] for i in ids if 0 <= i < len(tokens)])


def _groups(texts: list[str], most: int = 8 << 20):
    """Runs of texts of bounded total length, so that one run's words fit in memory."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[start:k]
            start, size = k, 0
        size += len(t)
    if texts:
        yield texts[start:]


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` with the ids of each text as ``array<int>``; without ``keep_text`` texts don't come back from the tasks."""

    def make():
        encoder = Encoder(tokenizer)

        def batch(column: pa.Array) -> list:
            texts = [t or "" for t in column.to_pylist()]
            parts = [encoder.encode_lists(group) for group in _groups(texts)]
            return [pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))]

        return batch

    return append_columns(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make, keep_text)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids decode to; null ids decode to the empty text."""

    def make():
        encoder = Encoder(tokenizer)
        return lambda column: [pa.array([encoder.decode(x or []) for x in column.to_pylist()], pa.string())]

    return append_columns(df, ids_col, [T.StructField(out_col, T.StringType())], make)


def round_trip(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` and digests of the ids and of the decoded text.

    Both ways run in one pass, word by word, so ids need not leave the task.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make():
        encoder = Encoder(tokenizer)

        def batch(column: pa.Array) -> list:
            counts, ids_digest, text_digest = [], [], []
            for group in _groups([t or "" for t in column.to_pylist()]):
                numbered = encoder.number_words(group)
                written, decoded = encoder.spellings(numbered)
                for numbers in numbered:
                    counts.append(encoder.count_ids(numbers))
                    ws = numbers.tolist()
                    ids_digest.append(hashlib.sha256(" ".join([written[w] for w in ws]).encode()).hexdigest())
                    text_digest.append(hashlib.sha256(" ".join([decoded[w] for w in ws]).encode()).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]

        return batch

    return append_columns(df, text_col, fields, make)
