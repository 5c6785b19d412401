"""Quality rules by divergence from language references.

A reference of each language holds the histogram of its character classes and
of its common words, counted over all documents of that language. A document's
histograms are compared with each reference by Jensen-Shannon distance; its
divergence is the smallest mean over languages. Short texts lack evidence: below
``MIN_CHARS`` code points classes aren't judged, below ``MIN_WORDS`` words
common words aren't, and a text judged by neither is kept.

Common words are those with at least ``COMMON`` of a language's words. Each task
proposes the words with ``COMMON / 2`` of its own words, so no common word can
be missed, and a second pass counts the candidates exactly.

Defined results: null text counts as empty, with zeros and ``base_failed``;
rows without a language count towards no reference, but are compared with all;
with no references nothing diverges; repeated rows are judged one by one;
columns beyond those used are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.llm.text import PIECE, SPACE, append_columns, buffers, mix, span_hashes, sum_by_row, words

#: A common word has at least this share of its language's words, so there can't be more of them than this.
COMMON = 1e-3
MOST_COMMON = round(1 / COMMON)
#: Guards of length, and the largest divergence that is kept.
MIN_CHARS = 200
MIN_WORDS = 100
MAX_DIVERGENCE = 0.32

SYMBOLS = b"#*$%&|<>"
#: Character classes by byte: lower, upper, digit, white, sentence mark, symbol, other ASCII, beyond ASCII; 8 marks continuation bytes.
CLASSES = 8
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[SPACE] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 8


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x classes."""
    kinds = _CLASS[data]
    return np.stack([sum_by_row(kinds == k, offsets) for k in range(CLASSES)], axis=1)


def repeated_words(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each row, words inside three-word windows that occur twice or more in it."""
    n, rows = len(hashes), len(begins) - 1
    if n < 3:
        return np.zeros(rows, dtype=np.int64)
    owner = np.repeat(np.arange(rows), np.diff(begins))
    window = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:]) ^ mix(owner[:-2].astype(np.uint64) + np.uint64(1))
    whole = np.flatnonzero(owner[:-2] == owner[2:])
    order = whole[np.argsort(window[whole])]
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(owner[covered], minlength=rows)


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, lines with a word that equal an earlier line of it."""
    rows = len(offsets) - 1
    out = np.zeros(rows, dtype=np.int64)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        part, inner = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if last == first + 1 and len(part) > PIECE:  # one very long text: its lines one by one
            lines = [x for x in part.tobytes().split(b"\n") if x.split()]
            out[first] = len(lines) - len(set(lines))
        elif len(part):
            breaks = np.flatnonzero(part == 10)
            starts = np.union1d(breaks + 1, inner[:-1])
            starts = starts[starts < len(part)]
            stops = np.append(starts[1:], len(part))
            ends = np.where((stops > starts) & (part[np.maximum(stops - 1, 0)] == 10), stops - 1, stops)
            inside = np.zeros(len(part) + 1, dtype=np.int32)
            np.cumsum(~SPACE[part], out=inside[1:])
            full = inside[ends] > inside[starts]
            starts, ends = starts[full], ends[full]
            row = np.searchsorted(inner, starts, side="right") - 1
            keys = span_hashes(part, starts, ends) ^ mix(row.astype(np.uint64) + np.uint64(1))
            order = np.argsort(keys)
            again = order[1:][keys[order][1:] == keys[order][:-1]]
            out[first:last] += np.bincount(row[again], minlength=last - first)
        first = last
    return out


def _tally(lang: np.ndarray, names: list[str], kind: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i in lang.tolist()], pa.string()), pa.array([kind] * len(lang), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
        names=["lang", "kind", "key", "n"],
    )


_TALLY = "lang string, kind string, key long, n long"


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, dict]:
    """For each language, its class shares and its common words with their shares."""
    spark = docs.sparkSession
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def by_language(batch: pa.RecordBatch):
        data, offsets, _ = buffers(batch.column(1))
        names, lang = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        hashes, begins = words(data, offsets, lower=True)
        return data, offsets, names.tolist(), lang, hashes.astype(np.int64), np.repeat(lang, np.diff(begins))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, _, names, _, hashes, owner = by_language(batch)
            for k in range(len(names)):
                own = hashes[owner == k]
                keys, n = np.unique(own, return_counts=True)
                often = n >= len(own) * COMMON / 2
                yield _tally(np.full(often.sum(), k), names, "w", keys[often], n[often])
                yield _tally(np.array([k]), names, "t", np.array([0]), np.array([len(own)]))

    proposed = known.mapInArrow(propose, _TALLY).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # what a word lacks in these sums is under half of COMMON, so common words reach the other half
    totals = proposed.filter("kind = 't'").select("lang", F.col("n").alias("total"))
    candidates: dict[str, list[int]] = {}
    for r in proposed.filter("kind = 'w'").join(totals, "lang").filter(F.col("n") >= F.col("total") * (COMMON / 2)).select("lang", "key").collect():
        candidates.setdefault(r["lang"], []).append(r["key"])
    shared = spark.sparkContext.broadcast({k: np.sort(np.array(v, dtype=np.int64)) for k, v in candidates.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets, names, lang, hashes, owner = by_language(batch)
            classes = class_counts(data, offsets)
            for k, name in enumerate(names):
                own, wanted = hashes[owner == k], shared.value.get(name, np.zeros(0, np.int64))
                yield _tally(np.full(CLASSES, k), names, "c", np.arange(CLASSES), classes[lang == k].sum(0))
                yield _tally(np.array([k]), names, "t", np.array([0]), np.array([len(own)]))
                if len(wanted):
                    at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    yield _tally(np.full(len(wanted), k), names, "w", wanted, np.bincount(at[wanted[at] == own], minlength=len(wanted)))

    counted = known.mapInArrow(count, _TALLY).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    out: dict[str, dict] = {}
    for r in counted.orderBy("lang", "kind", "key").collect():  # some numbers for each language
        out.setdefault(r["lang"], {"c": np.zeros(CLASSES), "w": [], "t": 0})
        if r["kind"] == "c":
            out[r["lang"]]["c"][r["key"]] = r["n"]
        elif r["kind"] == "t":
            out[r["lang"]]["t"] = r["n"]
        else:
            out[r["lang"]]["w"].append((r["n"], r["key"]))
    for ref in out.values():
        often = sorted((x for x in ref["w"] if x[0] >= COMMON * ref["t"]), reverse=True)
        often.sort(key=lambda x: x[1])
        ref["keys"] = np.array([k for _, k in often], dtype=np.int64)
        ref["words"] = np.array([n for n, _ in often] + [ref["t"] - sum(n for n, _ in often)], dtype=float) / max(ref["t"], 1)
        ref["classes"] = ref["c"] / max(ref["c"].sum(), 1)
    return {k: {x: ref[x] for x in ("keys", "words", "classes")} for k, ref in out.items()}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def divergence(classes: np.ndarray, hashes: np.ndarray, begins: np.ndarray, refs: dict[str, dict]) -> np.ndarray:
    """The smallest mean distance of each row from a reference; 0 where a text is too short to judge."""
    rows, n_words = len(classes), np.diff(begins)
    chars = classes.sum(1)
    by_class, by_word = (chars >= MIN_CHARS), (n_words >= MIN_WORDS)
    best = np.full(rows, np.inf)
    owner = np.repeat(np.arange(rows), n_words)
    for ref in refs.values():
        d_class = js_distance(classes / np.maximum(chars, 1)[:, None], ref["classes"])
        k = len(ref["keys"])
        at = np.minimum(np.searchsorted(ref["keys"], hashes), max(k - 1, 0)) if k else np.zeros(len(hashes), np.int64)
        at = np.where(ref["keys"][at] == hashes, at, k) if k else at
        share = np.bincount(owner * (k + 1) + at, minlength=rows * (k + 1)).reshape(rows, k + 1) / np.maximum(n_words, 1)[:, None]
        d_word = js_distance(share, ref["words"])
        best = np.minimum(best, (d_class * by_class + d_word * by_word) / np.maximum(by_class.astype(int) + by_word, 1))
    return np.where(np.isfinite(best), best, 0.0)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_divergence: float = MAX_DIVERGENCE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and divergence of every row."""
    refs = references(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [*(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("divergence", T.DoubleType())]

    def make():
        def batch(column: pa.Array) -> list:
            data, offsets, _ = buffers(column)
            classes = class_counts(data, offsets)
            raw, begins = words(data, offsets)
            n_words = np.diff(begins)
            repeats = repeated_words(raw, begins)
            failed = (n_words < 50) | (100 * repeats > 50 * n_words)
            lower, _ = words(data, offsets, lower=True)
            apart = divergence(classes, lower.astype(np.int64), begins, shared.value)
            counts = [n_words, classes.sum(1) - classes[:, 3], classes[:, 5], repeated_lines(data, offsets), repeats]
            return [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & (apart <= max_divergence)), pa.array(apart)]

        return batch

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return append_columns(slim, "_text", fields, make).drop("_text")
