"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 0 to 3, with the frozen counts of
a sample. In a context that a language knows, a symbol seen there has
probability ``count / (n + d)`` and the rest, ``d / (n + d)``, escapes to the
shorter context with full exclusion of the symbols seen (``n`` events, ``d``
distinct symbols); a context that it doesn't know passes to the shorter one at
no cost; below order 0, unseen bytes share the escape evenly. The trees of all
languages share one set of nodes, so one walk per byte gives the exact code
lengths of all languages.

Training takes a bounded sample of documents with a known language outside the
held-out fold; scoring reads every text whole.

Defined results: ``und`` and score 0 where the text is null, has no letter, or
nothing was learned; ties go to the language first in code-point order; repeated
rows are scored alike; a null id counts as not held out, and isn't trained on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.llm.text import PIECE, append_columns, buffers

#: Bounds of the training sample and of the model.
DOCS_PER_LANGUAGE = 400
LONGEST_SAMPLED = 20_000
MAX_CONTEXTS = 12_000
MIN_COUNT = 12
#: Languages whose code lengths are worked out together, for memory.
TOGETHER = 8
_PAD = 10  # the byte that stands before a text


class Counts(NamedTuple):
    """Frozen statistics: how often each four-byte string ends at a position, by language."""

    key: str
    languages: list[str]
    grams: np.ndarray
    counts: np.ndarray  # grams x languages


class Model(NamedTuple):
    languages: list[str]
    symbol: np.ndarray  # code of each byte, 0 for unseen
    first: np.ndarray  # node by the last byte
    second: np.ndarray  # node by node and the byte before
    third: np.ndarray
    bits: np.ndarray  # (node * symbols + symbol) x languages


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _before(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The byte before each position; the pad at the start of a row."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = _PAD
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = buffers(pc.utf8_lower(batch.column(1)))
        if not len(data):
            continue
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        a1 = _before(data, starts)
        a2 = _before(a1, starts)
        a3 = _before(a2, starts)
        gram = (a3.astype(np.int64) << 24) | (a2.astype(np.int64) << 16) | (a1.astype(np.int64) << 8) | data
        names, lang = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        keys, n = np.unique((np.repeat(lang, np.diff(offsets)).astype(np.int64) << 32) | gram, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[keys >> 32].tolist(), pa.string()), pa.array(keys & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
        )


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, longest: int | None) -> DataFrame:
    """(label, text) of at most ``per_label`` rows of every label, chosen by a hash of the id.

    Rows are thinned by rate before they are ranked, so no label gathers many.
    Rates count only rows that can be chosen, a repeated id once, so a label
    with such rows is never thinned away.
    """
    fits = F.col(text_col).isNotNull() if longest is None else F.length(text_col) <= longest
    named = F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit(17))
    usable = docs.filter(~held_out(F.col(id_col)) & named & fits).select(F.col(label_col).cast("string").alias("_label"), F.col(text_col).alias("_text"), draw.alias("_draw"))
    rates = usable.groupBy("_label").agg((1_500_000 * per_label / F.approx_count_distinct("_draw")).alias("_rate"))
    thinned = usable.join(F.broadcast(rates), "_label").filter(F.pmod("_draw", F.lit(1_000_000)) < F.col("_rate")).drop("_rate")
    ranked = thinned.withColumn("_rank", F.row_number().over(Window.partitionBy("_label").orderBy("_draw", "_text")))
    return ranked.filter(F.col("_rank") <= per_label).select("_label", "_text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Counts:
    """Count the four-byte strings of the sample, by language."""
    sample = training_sample(docs, id_col, text_col, lang_col, DOCS_PER_LANGUAGE, LONGEST_SAMPLED)
    counted = sample.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.toArrow().to_pandas()
    languages = sorted(found["lang"].unique(), key=lambda s: s.encode())
    grams, at = np.unique(found["gram"].to_numpy(dtype=np.int64), return_inverse=True)
    counts = np.zeros((len(grams), len(languages)), dtype=np.int32)
    counts[at, found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return Counts(uuid.uuid4().hex, languages, grams, counts)


def compile_model(stats: Counts) -> Model:
    """Walk tables and code lengths of every node, from the frozen counts."""
    symbols_seen = np.unique(stats.grams & 255)
    symbol = np.zeros(256, dtype=np.int64)
    symbol[symbols_seen] = np.arange(1, len(symbols_seen) + 1)
    n_symbols = len(symbols_seen) + 1
    last = symbol[stats.grams & 255]

    def tally(order: int, chosen: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Counts of each symbol after each chosen context of this order."""
        n_lang = counts.shape[1]
        context = (stats.grams >> 8) & ((1 << 8 * order) - 1)
        if not len(chosen):
            return np.zeros((0, n_symbols, n_lang))
        slot = np.minimum(np.searchsorted(chosen, context), len(chosen) - 1)
        known = chosen[slot] == context
        out = np.zeros((len(chosen) * n_symbols, n_lang))
        np.add.at(out, slot[known] * n_symbols + last[known], counts[known])
        return out.reshape(len(chosen), n_symbols, n_lang)

    def contexts(order: int, least: int, most: int) -> np.ndarray:
        values, at = np.unique((stats.grams >> 8) & ((1 << 8 * order) - 1), return_inverse=True)
        total = np.bincount(at, weights=stats.counts.sum(1))
        order_by = np.argsort(-total, kind="stable")[:most]
        return np.sort(values[order_by[total[order_by] >= least]])

    def blend(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        n, d, seen = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True), count > 0
        rest = 1 - np.where(seen, shorter, 0).sum(1, keepdims=True)
        total = np.maximum(np.where(rest > 1e-12, n + d, n), 1)  # all symbols seen: nothing escapes
        escape = np.where(rest > 1e-12, d / np.maximum(n + d, 1) / np.maximum(rest, 1e-12), 0)
        return np.where(n > 0, np.where(seen, count / total, escape * shorter), shorter)

    one = contexts(1, 1, 256)
    two = contexts(2, MIN_COUNT, MAX_CONTEXTS // 3)
    three = contexts(3, MIN_COUNT, MAX_CONTEXTS)
    three = three[np.isin(three & 0xFFFF, two)]
    node_one = {c: 1 + i for i, c in enumerate(one.tolist())}
    at_one = np.array([node_one[c & 255] for c in two.tolist()], dtype=np.int64)
    node_two = {c: 1 + len(one) + i for i, c in enumerate(two.tolist())}
    at_two = np.array([node_two[c & 0xFFFF] for c in three.tolist()], dtype=np.int64)

    def node_bits(counts: np.ndarray) -> np.ndarray:
        # Order 0 blends with the uniform distribution over 256 bytes; code 0 stands for any one unseen byte.
        root = blend(tally(0, np.zeros(1, np.int64), counts), np.full((1, n_symbols, counts.shape[1]), 1 / 256))
        p_one = blend(tally(1, one, counts), np.repeat(root, len(one), 0))
        p_two = blend(tally(2, two, counts), p_one[at_one - 1])
        p_three = blend(tally(3, three, counts), p_two[at_two - 1 - len(one)])
        bits = -np.log2(np.maximum(np.concatenate([root, p_one, p_two, p_three]), 1e-30))
        return bits.reshape(-1, counts.shape[1]).astype(np.float32)

    bits = np.concatenate([node_bits(stats.counts[:, low : low + TOGETHER]) for low in range(0, len(stats.languages), TOGETHER)], axis=1)

    first = np.zeros(n_symbols, dtype=np.int64)
    first[symbol[one]] = np.arange(1, len(one) + 1)
    second = np.repeat(np.arange(1 + len(one))[:, None], n_symbols, 1)
    second[at_one, symbol[two >> 8]] = np.arange(len(two)) + 1 + len(one)
    third = np.repeat(np.arange(1 + len(one) + len(two))[:, None], n_symbols, 1)
    third[at_two, symbol[three >> 16]] = np.arange(len(three)) + 1 + len(one) + len(two)
    return Model(
        stats.languages, symbol.astype(np.int32), first.astype(np.int32), second.astype(np.int32).ravel(), third.astype(np.int32).ravel(), bits
    )


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each language's tree needs for each row (rows x languages)."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    owner = np.flatnonzero(offsets[1:] > offsets[:-1])
    n_symbols = len(model.first)
    step = max(1, PIECE * TOGETHER // max(TOGETHER, len(model.languages)))
    for low in range(0, len(data), step):
        high, lead = min(low + step, len(data)), max(0, low - 3)
        part = data[lead:high]
        inner = starts[np.searchsorted(starts, lead) : np.searchsorted(starts, high)] - lead
        a1 = _before(part, inner)
        a2 = _before(a1, inner)
        a3 = _before(a2, inner)
        node = model.first[model.symbol[a1]]
        node = model.second[node * n_symbols + model.symbol[a2]]
        node = model.third[node * n_symbols + model.symbol[a3]]
        bits = model.bits[(node * n_symbols + model.symbol[part])[low - lead :]]
        row = np.searchsorted(starts, low, side="right") - 1  # the row that the piece begins in
        cuts = np.concatenate([[0], starts[row + 1 : np.searchsorted(starts, high)] - low])
        total[owner[row : row + len(cuts)]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
    return total


_models: dict[str, Model] = {}


def predict(docs: DataFrame, stats: Counts, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (posterior under equal priors) and bits_per_byte."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(stats)

    def make():
        key = shared.value.key
        if key not in _models:
            _models.clear()
            _models[key] = compile_model(shared.value) if shared.value.languages else None
        model = _models[key]

        def batch(column: pa.Array) -> list:
            lower = pc.utf8_lower(column)
            data, offsets, _ = buffers(lower)
            letters = pc.fill_null(pc.match_substring_regex(lower, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(letters)
            if model is None:
                return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64())]
            bits = code_lengths(model, data, offsets)
            best = bits.argmin(1)
            margin = (bits[np.arange(n), best][:, None] - bits) * np.log(2)
            score = np.where(letters, 1 / np.exp(np.maximum(margin, -700)).sum(1), 0.0)
            rate = bits[np.arange(n), best] / np.maximum(np.diff(offsets), 1)
            names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            return [pa.array(names, pa.string()), pa.array(score), pa.array(rate, mask=~letters)]

        return batch

    return append_columns(docs, text_col, fields, make)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every row."""
    stats = fit(docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found = predict(slim, stats, "_text")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, with the columns they came with."""
    stats = fit(docs, id_col, text_col, lang_col)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("_text"))
    return predict(packed, stats, "_text").filter("lang_pred <> 'und'").select("row.*")
