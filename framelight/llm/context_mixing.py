"""Language-model scores by online logistic mixing of hashed contexts.

A text is read as its tokens: lower-cased words, one space between two, a line
feed as the end. Every byte is coded by binary decisions on a Huffman tree that
belongs to the byte before it. Predictors, each a table of bit counts by a hash
of (context, node), guess each decision from the three, four and six bytes before
it. Their logits are added under weights that a gate picks by which of the longer
contexts were ever seen, then refined by an adaptive probability map. Weights and the map's scale and shift go
on learning within a document: they move after every stretch of it, by the errors
made there, and each document starts anew, so a score depends on nothing but the
text and the model. What is predicted is never used before it is predicted, so the
probabilities of all texts add up to one.

All training documents are counted: words, pairs of bytes, and bits by context.
The bit tables have a fixed number of slots (``SLOT_BITS``) whatever the input;
a task counts into its own and sends the slots it touched, block by block, and a
block is summed as a stream. The gate's weights and the map are fitted on every
training document, too: documents are halved by a hash of the id, and each
half's decisions are guessed from the bit tables of the other half, so that the weights
see counts as an unseen text does. Decisions with the same gate, bit and logits
(rounded to ``LEVELS`` levels each) are counted together, so a task sends a table of
fixed size, and the weights and the map are those that fit the counts of all best.

The base is a unigram model with one added to every count. Words that make up
1/262144 of all tokens or more, of which there are at most 262144, are looked up
where the text lies; the others are joined by word, and none of them is frequent.

Defined results: null text is empty and holds one token, its end; a null id is
not held out, and nothing is learned from its row; every repeated row counts and
is scored; without a training document the base is 0 and the bits are even;
an empty table gives an empty result. Columns beyond those used are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.llm import text as tx
from framelight.llm.storage import materialize

FOLDS, HELD_OUT = 7, 2
SLOT_BITS = 22
#: Bytes that each predictor sees; the gate asks of all but the first whether what it sees was ever seen.
ORDERS = (3, 4, 6)
CONTEXTS = len(ORDERS)
GATES = 1 << (CONTEXTS - 1)
#: Slots of a context that lie side by side, as many bytes as a processor fetches at once.
LINE = np.uint32(64)
#: Slots of a table that are sent and summed together.
BLOCK = 4096
#: Levels of a logit, half a unit apart, by which decisions are counted together.
LEVELS = 33
SITUATIONS = GATES * LEVELS**CONTEXTS
#: A word is looked up on the spot if it is at least one token in so many.
FREQUENT = 1 << 18
#: Logits are kept in steps of 1/16.
STEP = 16.0
#: Cells of the probability map over logits from -8 to 8.
CELLS = 33
#: Bytes between two updates within a document; the stretch doubles after every eighth.
STRETCH = 256
RATE = 0.02
#: Text bytes that are scored together, and that are counted together.
SLICE = 1 << 20
COUNTED = 2 << 20
#: Text bytes whose decisions are guessed together while the weights are fitted.
GUESSED = 1 << 18
#: Distinct words a task holds before it sends their counts.
HELD_WORDS = 1 << 20

END, GAP = 10, 32
_FOLDED = np.where(tx.SPACE, np.uint8(GAP), tx.LOWER)
_SLOT = np.uint32(0x85EBCA6B)
_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
#: The hash that stands for the end token.
END_WORD = np.uint64(0)


class Model(NamedTuple):
    tables: np.ndarray  # logits by (context, slot), in steps
    offsets: np.ndarray  # of codes by byte before and byte
    lengths: np.ndarray
    codes: np.ndarray  # node * 2 + bit
    weights: np.ndarray  # (gates, contexts)
    refined: np.ndarray  # (gates, cells)
    frequent: np.ndarray  # sorted word hashes
    frequent_counts: np.ndarray
    train_tokens: int
    train_words: int


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Stream(NamedTuple):
    """Texts as tokens: bytes, where each text begins, the words' places, hashes and beginnings by text."""

    data: np.ndarray
    offsets: np.ndarray
    word_starts: np.ndarray
    word_ends: np.ndarray
    words: np.ndarray
    begins: np.ndarray


def read(texts: pa.Array) -> Stream:
    """The token bytes of texts: the first space after each word stays, and the last byte of a text is its end."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    raw, offsets, _ = tx.buffers(texts)
    space = tx.SPACE[raw]
    kept = np.ones(len(raw), dtype=bool)
    kept[1:] = ~(space[1:] & space[:-1])
    kept[offsets[:-1]] = ~space[offsets[:-1]]
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])
    empty = upto[offsets[1:]] == upto[offsets[:-1]]
    if empty.any():  # only white space: the end alone
        kept[offsets[:-1][empty]] = True
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])
    data, places = _FOLDED[raw[kept]], upto[offsets]
    data[places[1:] - 1] = END
    ends = np.flatnonzero(tx.SPACE[data])
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(ends)]
    real = ends > starts
    starts, ends = starts[real], ends[real]
    return Stream(data, places, starts, ends, _word_hashes(data, starts, ends), np.searchsorted(starts, places))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, some piece of the bytes at a time."""
    out, low = [np.zeros(0, np.uint64)], 0
    while low < len(starts):
        high = int(np.searchsorted(starts, starts[low] + tx.PIECE))
        first = starts[low]
        out.append(tx.span_hashes(data[first : ends[high - 1]], starts[low:high] - first, ends[low:high] - first))
        low = high
    return np.concatenate(out)


def contexts(s: Stream) -> list[np.ndarray]:
    """32-bit hashes of the bytes before every byte, by predictor."""
    n = len(s.data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[8:] = s.data
    before = np.ndarray(n, dtype="<u8", buffer=padded, strides=(1,)).copy()  # the eight bytes before, the last one on top
    for k in range(max(ORDERS)):  # what lies before a text isn't seen
        at = s.offsets[:-1] + k
        at = at[at < s.offsets[1:]]
        before[at] &= np.uint64(((1 << 8 * k) - 1) << (64 - 8 * k) if k else 0)
    return [(((before >> np.uint64(64 - 8 * order)) * m) >> np.uint64(32)).astype(np.uint32) for order, m in zip(ORDERS, _SPREAD, strict=True)]


def pairs_of(s: Stream) -> np.ndarray:
    """Each byte with the one before it, which for the first of a text is the end."""
    out = s.data.astype(np.int32)
    out[1:] |= s.data[:-1].astype(np.int32) << 8
    out[:1] |= END << 8
    return out


def _pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]`` of places that all lie inside, which numpy finds faster if it needn't raise."""
    return values.take(at, mode="clip")


def spots(context: np.ndarray) -> np.ndarray:
    """Where a context's slots lie: a line of ``LINE`` of them, and what their order in it is turned by."""
    return (context * _SLOT) >> np.uint32(32 - SLOT_BITS)


def turns(nodes: np.ndarray) -> np.ndarray:
    """A node's place in the lines; those near the root, which come first, have places of their own."""
    return (nodes ^ (nodes // LINE * (LINE - 1))) & (LINE - 1)


def slots(context: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """All decisions of a byte look into one line for each context."""
    return spots(context) ^ turns(nodes)


def code_tables(pair_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman code of all bytes after each byte: offsets and lengths by pair, and node * 2 + bit in a row."""
    after = pair_counts.reshape(256, 256).astype(np.float64)
    share = after.sum(0) + 1.0
    share /= share.sum()
    offsets, lengths, steps, at = np.zeros(65536, np.int32), np.zeros(65536, np.int32), [], 0
    unseen = None
    for first in range(256):
        if after[first].any() or unseen is None:
            codes = huffman(after[first] + 0.5 * share)
        else:
            codes = unseen
        if not after[first].any():
            unseen = codes
        for second, code in enumerate(codes):
            offsets[first * 256 + second], lengths[first * 256 + second] = at, len(code)
            steps += [2 * x + b for x, b in code]
            at += len(code)
    return offsets, lengths, np.array(steps, dtype=np.uint16)


def huffman(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each symbol its (node, bit) from the root, which is node 0."""
    heap = [(float(w), k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    n = len(weights)
    above, inner = {}, n
    while len(heap) > 1:
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a], above[b] = (inner, 0), (inner, 1)
        heapq.heappush(heap, (wa + wb, inner))
        inner += 1
    root, out = inner - 1, []
    for symbol in range(n):
        code, at = [], symbol
        while at != root:
            at, bit = above[at]
            code.append((root - at, bit))
        out.append(code[::-1])
    return out


def decisions(pairs: np.ndarray, places: np.ndarray, codes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every decision of bytes in order: the byte's place, the node, the bit; and how many each byte takes."""
    offsets, lengths, steps = codes
    n = _pick(lengths, pairs)
    ends = np.cumsum(n)
    at = np.repeat((_pick(offsets, pairs) - ends + n).astype(np.int64), n)
    at += np.arange(len(at))
    step = _pick(steps, at)
    return np.repeat(places, n), (step >> 1).astype(np.uint32), (step & 1).astype(bool), n


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, key, n): hashes of a task's words, and its pairs of bytes; words go out whenever many are held."""
    held, counts, pairs, docs = [], [], np.zeros(65536, dtype=np.int64), 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        return words, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    def rows(pair: bool, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), pair)), pa.array(keys.view(np.int64)), pa.array(n)], names=["pair", "key", "n"])

    for whole in batches:
        for batch in tx.slices(whole, 0, COUNTED):
            s = read(batch.column(0))
            for x, y in zip(np.unique(s.words, return_counts=True), (held, counts), strict=True):
                y.append(x)
            pairs += np.bincount(pairs_of(s), minlength=65536)
            docs += batch.num_rows
            if sum(map(len, held)) > 2 * HELD_WORDS:
                words, n = together()
                if len(words) > HELD_WORDS:
                    yield rows(False, words, n)
                    words, n = words[:0], n[:0]
                held, counts = [words], [n]
    if docs:
        yield rows(False, *together())
        yield rows(False, np.array([END_WORD]), np.array([docs]))
        yield rows(True, np.flatnonzero(pairs), pairs[pairs > 0])


def _context_counts(codes: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(context, block, slots, zeros, ones) of the slots that the task's texts touch."""
        counts = np.zeros((CONTEXTS, 2 << SLOT_BITS), dtype=np.uint32)
        for whole in batches:
            for batch in tx.slices(whole, 0, COUNTED):
                s = read(batch.column(0))
                pairs = pairs_of(s).astype(np.uint64)
                for k, context in enumerate(contexts(s)):
                    # equal (context, byte) are counted together before their decisions are spelled out, in the order of their slots
                    keys = (context * _SLOT).astype(np.uint64) << np.uint64(16)
                    keys |= pairs
                    keys.sort()
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                    n = np.diff(np.append(first, len(keys))).astype(np.uint32)
                    keys = keys[first]
                    place, nodes, bits, _ = decisions((keys & np.uint64(0xFFFF)).astype(np.int32), np.arange(len(keys)), codes)
                    at = _pick((keys >> np.uint64(48 - SLOT_BITS)).astype(np.int64), place)
                    at ^= turns(nodes).astype(np.int64)
                    at += at
                    at += bits
                    np.add.at(counts[k], at, _pick(n, place))
        for k in range(CONTEXTS):
            blocks = counts[k].reshape(-1, BLOCK, 2)
            touched = counts[k].view(np.uint64).reshape(-1, BLOCK) != 0  # either count
            rows = [(int(b), np.flatnonzero(touched[b])) for b in np.flatnonzero(touched.any(axis=1))]
            for low in range(0, len(rows), 256):
                part = rows[low : low + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), k, np.int32)),
                        pa.array([b for b, _ in part], type=pa.int32()),
                        pa.array([x.astype(np.uint16).tobytes() for _, x in part], type=pa.binary()),
                        pa.array([blocks[b, x, 0].tobytes() for b, x in part], type=pa.binary()),
                        pa.array([blocks[b, x, 1].tobytes() for b, x in part], type=pa.binary()),
                    ],
                    names=["context", "block", "slots", "zeros", "ones"],
                )

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a (context, block) with its logits, and those of each half where a column tells them apart; rows come sorted, so one block is open at a time."""
    open_key, sums, halved = None, np.zeros((2, 2, BLOCK), dtype=np.int64), False

    def closed() -> pa.RecordBatch:
        packed = lambda zeros, ones: pa.array([logits(zeros, ones).tobytes()], type=pa.binary())
        columns = [pa.array([open_key[0]], type=pa.int32()), pa.array([open_key[1]], type=pa.int32()), packed(*sums.sum(0)), *((packed(*x) for x in sums) if halved else ())]
        return pa.RecordBatch.from_arrays(columns, names=["context", "block", "logits", *(("first", "second") if halved else ())])

    for batch in batches:
        halved = "half" in batch.schema.names
        halves = batch.column("half").to_pylist() if halved else [0] * batch.num_rows
        for context, block, at, zeros, ones, half in zip(*(batch.column(c).to_pylist() for c in ("context", "block", "slots", "zeros", "ones")), halves, strict=True):
            if (context, block) != open_key:
                if open_key is not None:
                    yield closed()
                open_key = (context, block)
                sums[:] = 0
            places = np.frombuffer(at, dtype=np.uint16)
            sums[half, 0, places] += np.frombuffer(zeros, dtype=np.uint32)
            sums[half, 1, places] += np.frombuffer(ones, dtype=np.uint32)
    if open_key is not None:
        yield closed()


def logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts as logits in steps; 0 stands for a slot never seen."""
    x = np.clip(np.rint(STEP * np.log((ones + 0.3) / (zeros + 0.3))), -127, 127).astype(np.int8)
    x[(x == 0) & (zeros + ones > 0)] = 1
    return x


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of the training rows, and their words' counts (key, n)."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tallied = materialize(rows.select("text").mapInArrow(_tally, "pair boolean, key long, n long").groupBy("pair", "key").agg(F.sum("n").alias("n")), "mixing-words")
    words = tallied.filter("not pair").select("key", "n")
    total = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("words"), F.max(F.when(F.col("key") == 0, F.col("n"))).alias("docs")).collect()[0]
    tokens, n_words, n_docs = total["tokens"] or 0, total["words"], total["docs"] or 0
    pair_counts = np.zeros(65536, dtype=np.int64)
    for r in tallied.filter("pair").collect():  # at most 65536
        pair_counts[r["key"]] = r["n"]
    codes = code_tables(pair_counts)
    # by this bound there are at most FREQUENT such words
    often = words.filter(F.col("n") * FREQUENT >= tokens).orderBy("key").toArrow()
    frequent, frequent_counts = often["key"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(frequent)

    shared = spark.sparkContext.broadcast(codes)
    halved = rows.select(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(2)).cast("int").alias("half"), "text")
    count = lambda half: halved.filter(F.col("half") == half).select("text").mapInArrow(lambda b: _context_counts(shared.value)(b), _COUNTS).withColumn("half", F.lit(half))
    blocks = count(0).unionAll(count(1)).repartition("context", "block").sortWithinPartitions("context", "block").mapInArrow(_sum_blocks, "context int, block int, logits binary, first binary, second binary")
    tables = {name: np.zeros((CONTEXTS, 1 << SLOT_BITS), dtype=np.int8) for name in ("logits", "first", "second")}
    for r in blocks.toLocalIterator():  # tables of fixed size
        for name, table in tables.items():
            table[r["context"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r[name], dtype=np.int8)
    rest = (*codes, *untrained(), frequent[order], frequent_counts[order], tokens, n_words)
    # a half is guessed by what the other half counted
    others = spark.sparkContext.broadcast([Model(tables[name], *rest) for name in ("second", "first")])
    found = halved.mapInArrow(lambda b: _situations(others.value)(b), "at int, n long, ones long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()  # a table of fixed size
    n, ones = np.zeros(SITUATIONS), np.zeros(SITUATIONS)
    n[found["at"].to_numpy()], ones[found["at"].to_numpy()] = found["n"].to_numpy(), found["ones"].to_numpy()
    others.destroy()
    return settled(Model(tables["logits"], *rest), n, ones), words


_COUNTS = "context int, block int, slots binary, zeros binary, ones binary"


def untrained() -> tuple[np.ndarray, np.ndarray]:
    weights = np.full((GATES, CONTEXTS), 0.4, dtype=np.float32)
    refined = np.tile(np.linspace(-8, 8, CELLS, dtype=np.float32), (GATES, 1))
    return weights, refined


def inputs(model: Model, spot: list[np.ndarray], place: np.ndarray, nodes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The predictors' logits and the gate of each decision; ``spot`` holds the places of the contexts of every byte."""
    turned = turns(nodes)
    x, gate = [], np.zeros(len(place), dtype=np.uint8)
    for k in range(CONTEXTS):
        found = _pick(model.tables[k], _pick(spot[k], place) ^ turned)
        if k:
            gate |= (found != 0).view(np.uint8) << (k - 1)
        x.append(found * np.float32(1 / STEP))
    return x, gate.astype(np.int64)


def refine(model: Model, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The probability map's logit, between its two nearest cells, averaged with what was mixed."""
    at = (np.clip(mixed, -7.999, 7.999) + np.float32(8)) * np.float32((CELLS - 1) / 16)
    low = at.astype(np.int64)
    part = at - low.astype(np.float32)
    cells = model.refined.ravel()
    low += gate * CELLS
    out = _pick(np.diff(cells, append=cells[-1:]), low)
    out *= part
    out += _pick(cells, low)
    out += mixed
    out *= np.float32(0.5)
    return out


def situations(model: Model, s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """How many decisions have each gate and rounded logits, and how many of them are ones."""
    place, nodes, bits, _ = decisions(pairs_of(s), np.arange(len(s.data)), model[1:4])
    x, at = inputs(model, [spots(c) for c in contexts(s)], place, nodes)
    for found in x:
        at *= LEVELS
        at += np.rint(found * np.float32(2)).astype(np.int64)
        at += LEVELS // 2
    return np.bincount(at, minlength=SITUATIONS), np.bincount(at[bits], minlength=SITUATIONS)


def _situations(models: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(at, n, ones) of the task's decisions; ``models`` guess the first half and the second."""
        n, ones = np.zeros(SITUATIONS, dtype=np.int64), np.zeros(SITUATIONS, dtype=np.int64)
        for whole in batches:
            for batch in tx.slices(whole, 1, GUESSED):
                for half, model in enumerate(models):
                    texts = batch.column(1).filter(pc.equal(batch.column(0), half))
                    if len(texts):
                        for total, found in zip((n, ones), situations(model, read(texts)), strict=True):
                            total += found
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(ones[at])], names=["at", "n", "ones"])

    return run


def settled(model: Model, n: np.ndarray, ones: np.ndarray) -> Model:
    """The gate's weights that fit the counted situations best, then the map from what they give."""
    at = np.flatnonzero(n)
    if not len(at):
        return model
    n, ones = n[at].astype(np.float64), ones[at].astype(np.float64)
    x = np.array([at // LEVELS ** (CONTEXTS - 1 - k) % LEVELS - LEVELS // 2 for k in range(CONTEXTS)]) / 2
    gate, w = at // LEVELS**CONTEXTS, model.weights.astype(np.float64)
    for g in range(GATES):
        w[g] = _newton(x[:, gate == g], n[gate == g], ones[gate == g], w[g])
    model = model._replace(weights=w.astype(np.float32))
    mixed = np.clip((w[gate].T * x).sum(0), -7.999, 7.999)
    cell = gate * CELLS + np.rint((mixed + 8) * (CELLS - 1) / 16).astype(np.int64)
    start = np.tile(np.linspace(-8, 8, CELLS), GATES)
    ones, n = np.bincount(cell, ones, GATES * CELLS), np.bincount(cell, n, GATES * CELLS)
    prior = 8 / (1 + np.exp(-start))  # eight imagined decisions as the mix has them
    refined = np.log(ones + prior) - np.log(n - ones + 8 - prior)
    return model._replace(refined=refined.reshape(GATES, CELLS).astype(np.float32))


def _newton(x: np.ndarray, n: np.ndarray, ones: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of a logistic mix by Newton's steps, halved until they gain; few decisions leave them near the start."""

    def loss(w: np.ndarray) -> float:
        z = w @ x
        return float((n * np.logaddexp(0, z) - ones * z).sum() + 0.5 * ((w - start) ** 2).sum())

    w, least = start, loss(start)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + np.eye(len(w)), x @ (n * p - ones) + w - start)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) >= least:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
        gain, least = least - loss(w), loss(w)
        if gain < 1e-9 * abs(least):
            break
    return w


def train(model: Model, texts: pa.Array) -> Model:
    """The weights and the map that texts in memory give, which the tables haven't counted."""
    return settled(model, *situations(model, read(texts))) if len(texts) else model


def stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(round, text, start) of the stretches of texts of these sizes, by round."""
    rounds, texts, starts = [], [], []
    at, size, k = 0, STRETCH, 0
    alive = np.flatnonzero(sizes > 0)
    while len(alive):
        rounds.append(np.full(len(alive), k))
        texts.append(alive)
        starts.append(np.full(len(alive), at))
        at, k = at + size, k + 1
        size *= 2 if k % 8 == 0 else 1
        alive = alive[sizes[alive] > at]
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rounds, texts, starts))


def log_probabilities(model: Model, s: Stream) -> np.ndarray:
    """The natural logarithm of each text's probability."""
    n_docs = len(s.offsets) - 1
    sizes = np.diff(s.offsets)
    total = np.zeros(n_docs)
    own = np.zeros((n_docs, CONTEXTS), dtype=np.float32)  # what a text has added to the weights
    by_context = np.ascontiguousarray(model.weights.T)
    bend = np.tile(np.array([1, 0], dtype=np.float32), (n_docs, 1))  # scale and shift of the refined logit
    rounds, texts, starts = stretches(sizes)
    lengths = np.minimum(np.where(rounds < 0, 0, STRETCH << (rounds // 8)), sizes[texts] - starts)
    borders = np.flatnonzero(np.diff(rounds, prepend=-1))
    spot, pairs = [spots(c) for c in contexts(s)], pairs_of(s)
    for low, high in zip(borders, np.append(borders[1:], len(rounds)), strict=True):
        docs, n = texts[low:high], lengths[low:high]
        first = s.offsets[docs] + starts[low:high]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
        place, nodes, bits, each = decisions(pairs[at], at, model[1:4])
        x, gate = inputs(model, spot, place, nodes)
        many = np.add.reduceat(each, ends - n)
        begins = np.cumsum(many) - many
        mixed = np.zeros(len(place), dtype=np.float32)
        for k in range(CONTEXTS):
            weight = np.repeat(own[docs, k], many)
            weight += _pick(by_context[k], gate)
            weight *= x[k]
            mixed += weight
        better = refine(model, mixed, gate)
        final = np.repeat(bend[docs, 0], many)
        final *= better
        final += np.repeat(bend[docs, 1], many)
        np.clip(final, -16, 16, out=final)
        sign = bits * np.float32(2) - np.float32(1)
        e = np.exp(-sign * final)
        up = e + np.float32(1)
        total[docs] -= np.add.reduceat(np.log(up), begins, dtype=np.float64)
        sign *= e
        sign /= up  # now the error
        step = (np.float32(RATE) / np.sqrt(many + np.float32(16))).astype(np.float32)
        for k in range(CONTEXTS):
            own[docs, k] += step * np.add.reduceat(sign * x[k], begins)
        bend[docs, 1] += step * np.float32(0.25) * np.add.reduceat(sign, begins)
        sign *= better
        bend[docs, 0] += step * np.float32(0.25) * np.add.reduceat(sign, begins)
    return total


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row, doc_id, n_tokens, known and logs of its frequent words, its other words, bits and bytes of the model."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, done = shared.value, TaskContext.get().partitionId() << 33
        of_count = np.log10(model.frequent_counts + 1.0)
        for whole in batches:
            for batch in tx.slices(whole, 1, SLICE):
                s = read(batch.column(1))
                n = batch.num_rows
                row = np.repeat(np.arange(n), np.diff(s.begins))
                at = np.minimum(np.searchsorted(model.frequent, s.words), max(len(model.frequent) - 1, 0))
                hit = model.frequent[at] == s.words if len(model.frequent) else np.zeros(len(s.words), bool)
                known, logs = np.bincount(row[hit], minlength=n), np.bincount(row[hit], of_count[at[hit]], n).astype(np.float64)
                rare_row, rare = row[~hit], s.words[~hit].view(np.int64)
                cuts = np.searchsorted(rare_row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(done, done + n)),
                        batch.column(0),
                        pa.array(np.diff(s.begins) + 1),
                        pa.array(known),
                        pa.array(logs),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare)),
                        pa.array(log_probabilities(model, s)),
                        pa.array(np.diff(s.offsets)),
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "logs", "rare", "nats", "n_bytes"],
                )
                done += n

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, logs double, rare array<long>, nats double, n_bytes long")


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    model, words = fit(docs, id_col, text_col)
    scored = materialize(score(docs, model, id_col, text_col), "mixing-scored")
    counts = words.filter(F.col("n") * FREQUENT < model.train_tokens)
    rare = scored.select("row", F.explode("rare").alias("key"))
    met = rare.join(counts.hint("merge"), "key").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_logs"))
    # the end token is frequent wherever a document was learned from, or not known at all
    end = dict(zip(model.frequent.tolist(), model.frequent_counts.tolist(), strict=True)).get(int(END_WORD))
    rare_end = 0 if end is not None or not model.train_tokens else words.filter("key = 0").collect()[0]["n"]
    ends = end or rare_end
    zero = F.lit(0).cast("long")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0)))
    space = float(np.log10(model.train_tokens + model.train_words + 1.0))
    return scored.join(met, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", zero) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        (F.col("nats") / F.lit(float(np.log(10)))).alias("score"),
        (-F.col("nats") / F.lit(float(np.log(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
