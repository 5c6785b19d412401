"""Exact near-duplicate classes by a Jaccard metric-space join over word shingles.

Jaccard distance is a metric, so distances to pivots bound distances between
documents. Nearly all distances are 1, hence distances that matter are found
through shared shingles instead of being computed for all pivots:

1. Equal shingle sets become one row.
2. A set can only link if enough of its shingles occur in another set. Shingles
   are counted in hash ranges, and the rest of the sets (nearly all of clean
   text) leave exactly.
3. Pivots: documents that share a minimum of a random order meet at the one of
   them that comes first by a hash. Each document joins the Voronoi region of the
   nearest such pivot within the link radius; it's linked to it, so a group of
   thousands of copies costs one distance a document. Others are pivots of
   regions of their own.
4. Regions meet only where members share a shingle of their rare-first prefixes
   (any linked pair does). Two regions are settled by their pivots' distance: a
   link, or apart by more than the radius and both regions' extents.
5. Regions that stay open go on with the windows that the triangle inequality
   leaves: members whose distance to the other pivot is within radius plus
   extent. One level of windows is all there is: a prefix join within each pair
   of windows, with exact verification, stands in for deeper recursion.

Links are exact up to collisions of 64-bit shingle hashes. The classes are the
connected components of the links.

Defined results: null, empty and wordless texts have 0 shingles and are classes
of their own; texts with fewer words than a shingle have one, the whole sequence;
repeated rows with one id give one result row each, and if their texts differ,
every text seeks links and the id joins the classes of all of them; a null id stays
a row of its own, with a null class. :func:`keep_one` keeps all columns and one row
of each class, that with the smallest id and, among texts with that id, the
smallest text hash; there rows that share an id but whose texts aren't linked are
different documents; rows with a null id are kept, texts without words are kept
once for each id and text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.llm.bits import bit_set, maybe_in
from framelight.llm.components import components
from framelight.llm.storage import materialize
from framelight.llm.text import buffers, mix, slices, words

#: Random orders whose minima choose pivots, and how many of them a round takes.
ORDERS = 8
ORDERS_A_ROUND = 4
#: Hash classes in which shingles are counted to order them by rarity; a fixed size, so it may be broadcast.
RARITY_CLASSES = 1 << 18
#: Sets of up to so many shingles carry a parity mask of so many 64-bit words, and up to so many earlier tokens.
MASKED = 512
MASK_WORDS = 8
EARLIER = 32
#: Bytes of shingle hashes that one hash range holds at most, and how many such bytes a byte of text gives at most, by rule of thumb.
RANGE_BYTES = 12 << 20
BYTES_A_BYTE = 0.7
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets, _ = buffers(column)
    hashes, begins = words(data, offsets, lower=True)
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        rolled[: n - j] = mix(rolled[: n - j] + hashes[j:] + _SEEDS[j])
    out = []
    for low, high in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if high - low >= k:
            own = np.sort(rolled[low : high - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif high > low:
            whole = np.array([high - low], dtype=np.uint64)
            for at in range(low, high):
                whole = mix(whole + hashes[at : at + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _fingerprint(own: np.ndarray) -> int:
    return int(mix(np.array([mix(own).sum() ^ np.uint64(len(own))], dtype=np.uint64))[0].astype(np.int64)) if len(own) else 0


def _survey(docs: DataFrame, k: int, ranges: int) -> DataFrame:
    """Rows of two kinds: for each document its id, key, size and fingerprint (range -1); for each batch and hash range the hashes of its documents."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = shingle_sets(batch.column(1), k)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            prints = np.array([_fingerprint(s) for s in sets], dtype=np.int64)
            n = len(sets)
            ids, keys = batch.column(0), batch.column(2)
            blank = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), ids, keys, pa.array(sizes), pa.array(prints), blank, blank], names=names)
            _, firsts = np.unique(prints, return_index=True)
            firsts = firsts[sizes[firsts] > 0]
            if not len(firsts):
                continue
            flat = np.concatenate([sets[i] for i in firsts])
            owner = np.repeat(np.arange(len(firsts)), sizes[firsts])
            part = ((flat >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, low, owner = part[order], flat[order].astype(np.uint32), owner[order]
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                run_owner, run_n = np.unique(owner[a:b], return_counts=True)
                rows.append((int(part[a]), prints[firsts[run_owner]].tobytes() + run_n.astype(np.uint32).tobytes(), low[a:b].tobytes()))
            m = len(rows)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.nulls(m, ids.type), none, none, none, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=names
            )

    names = ["part", "id", "key", "n", "print", "owners", "hashes"]
    return docs.select("id", "text", "key").mapInArrow(run, f"part int, id {id_type}, key long, n long, print long, owners binary, hashes binary")


def _shared_in_range(rows: pd.DataFrame) -> pd.DataFrame:
    """How many hashes of each set in this range occur in another set."""
    lists = [(np.frombuffer(x, np.int64, len(x) // 12), np.frombuffer(x, np.uint32, offset=len(x) // 12 * 8)) for x in rows["owners"]]
    prints, sizes = (np.concatenate(x) for x in zip(*lists, strict=True))
    _, firsts = np.unique(prints, return_index=True)  # copies in other batches count once
    own = np.zeros(len(prints), dtype=bool)
    own[firsts] = True
    hashes = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows["hashes"]])
    # hash and owner in one number that is sorted in place, as a range may hold many millions
    both = np.repeat(np.arange(len(prints), dtype=np.uint32), sizes).astype(np.uint64)
    both |= hashes.astype(np.uint64) << np.uint64(32)
    del hashes
    both = both[np.repeat(own, sizes)]
    both.sort()
    words = both.view(np.uint32)
    owner, high = (words[0::2], words[1::2]) if sys.byteorder == "little" else (words[1::2], words[0::2])
    same = high[1:] == high[:-1]
    shared = np.zeros(len(both), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    count = np.bincount(owner[shared], minlength=len(prints))
    some = np.flatnonzero(count)
    return pd.DataFrame({"print": prints[some], "shared": count[some]})


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (id, key) of ``wanted``; a bit set of fixed size spares most other rows the shuffle."""
    row = F.xxhash64("id", "key")
    bits = bit_set(wanted.select(row.alias("row")), "row")
    some = docs.withColumn("row", row).filter(maybe_in(bits, "row")).drop("row")
    return some.join(wanted.select("id", "key"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, shingles, minima) of each text, with its set's fingerprint as id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            sets = shingle_sets(batch.column(0), k)
            minima = [[int(mix(s ^ seed).min().astype(np.int64)) for seed in _SEEDS[-ORDERS:]] if len(s) else [] for s in sets]
            columns = [[_fingerprint(s) for s in sets], [len(s) for s in sets]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(minima, pa.list_(pa.int64()))],
                names=["id", "n", "shingles", "minima"],
            )

    return docs.select("text").mapInArrow(run, "id long, n long, shingles array<long>, minima array<long>")


def _prefixes(regions: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """(token, rest, id, region, n): the rare-first prefix of each set, which any two linked sets share a part of; rest counts the tokens after.

    Small sets carry a parity mask of all their shingles (two masks differ in no
    more bits than the sets differ in shingles) and the prefix tokens before each
    one, so that a pair can be told apart, and taken at its first common token only.
    """
    shared = regions.sparkSession.sparkContext.broadcast(rarity)
    id_type = regions.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rests, sizes, masks, before = [], [], [], [], []
            for s in batch.column(3):
                own = np.array(s.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                length = len(own) - -(-percent * len(own) // 100) + 1
                order = np.lexsort((own, shared.value[own & (RARITY_CLASSES - 1)]))[:length]
                tokens.append(own[order])
                rests.append(len(own) - 1 - np.arange(len(order)))
                sizes.append(len(order))
                small = len(own) <= MASKED
                odd = np.bincount(own & (64 * MASK_WORDS - 1), minlength=64 * MASK_WORDS).astype(np.uint8) & 1
                masks += [np.packbits(odd).view(np.int64).tolist() if small else None] * len(order)
                before += [own[order[:j]] if small and j <= EARLIER else None for j in range(len(order))]
            at = pa.array(np.repeat(np.arange(batch.num_rows), np.array(sizes, dtype=np.int64)))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (tokens, rests)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (masks, before)]
            yield pa.RecordBatch.from_arrays([*flat, *lists, *(batch.column(i).take(at) for i in (0, 1, 2, 4))], names=["token", "rest", "mask", "before", "id", "region", "n", "alone"])

    columns = f"token long, rest long, mask array<long>, before array<long>, id {id_type}, region {id_type}, n long, alone boolean"
    return regions.select("id", "region", "n", "shingles", "alone").mapInArrow(run, columns)


def _masks(regions: DataFrame) -> DataFrame:
    """(id, mask) of all sets: parities of their shingles by class, null for large sets."""

    def run(batches):
        for batch in batches:
            masks = []
            for s in batch.column(1):
                own = np.array(s.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                odd = np.bincount(own & (64 * MASK_WORDS - 1), minlength=64 * MASK_WORDS).astype(np.uint8) & 1
                masks.append(np.packbits(odd).view(np.int64).tolist() if len(own) <= MASKED else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masks, pa.list_(pa.int64()))], names=["id", "mask"])

    return regions.select("id", "shingles").mapInArrow(run, f"id {regions.schema['id'].dataType.simpleString()}, mask array<long>")


def _overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def links(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The regions (id, region) of sets (id, n, shingles, minima), and edges (a, b) between regions.

    A member is linked to its region's pivot, so a link of two members is kept as
    an edge of their regions: classes are the components of regions.
    """
    linked = F.expr(f"100 * common >= {percent} * (n_a + n_b - common)")
    distance = F.expr("1 - common / (n_a + n_b - common)")
    radius = 1 - percent / 100
    bare = sets.select("id", "n", "shingles")
    a_side = bare.select(*(F.col(c).alias(f"{c}_a") for c in bare.columns))
    b_side = bare.select(*(F.col(c).alias(f"{c}_b") for c in bare.columns))

    def measured(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with sizes and common shingles."""
        near = pairs.join(a_side, pairs["a"] == F.col("id_a")).drop("id_a").join(b_side, F.col("b") == F.col("id_b")).drop("id_b")
        return near.withColumn("common", _overlap("shingles_a", "shingles_b")).drop("shingles_a", "shingles_b")

    # 3. pivots and regions: whoever has no pivot yet looks for one again in other orders, among those in the same position
    minima = materialize(sets.select("id", F.posexplode("minima").alias("order", "least")), "minima")
    offers, left = [], sets.select("id")
    for turn in range(ORDERS // ORDERS_A_ROUND):
        own = F.floor(F.col("order") / ORDERS_A_ROUND) == turn
        met = minima.filter(own).join(left, "id", "left_semi").withColumn("turn", F.xxhash64("id", F.lit(turn)))
        leaders = met.groupBy("order", "least").agg(F.min(F.struct("turn", "id")).alias("first"), F.max("id").alias("other"), F.min("id").alias("one")).filter("one <> other")
        offered = met.join(leaders, ["order", "least"]).filter(F.col("first.id") != F.col("id")).select(F.col("id").alias("a"), F.col("first.id").alias("b")).distinct()
        offers.append(materialize(measured(offered).filter(linked).select("a", "b", distance.alias("apart")), "offers"))
        left = materialize(left.join(offers[-1].select(F.col("a").alias("id")), "id", "left_anti"), "without-pivot")
    joined = reduce(DataFrame.unionAll, offers)
    parents = joined.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select(F.col("a").alias("id"), F.col("best.b").alias("pivot"), F.col("best.apart").alias("apart"))
    pivots = parents.select(F.col("pivot").alias("id")).distinct().withColumn("is_pivot", F.lit(True))
    regions = bare.join(parents, "id", "left").join(pivots, "id", "left")
    own = F.col("is_pivot").isNotNull() | F.col("pivot").isNull()
    regions = materialize(regions.select("id", "n", "shingles", F.when(own, F.col("id")).otherwise(F.col("pivot")).alias("region"), F.when(own, 0.0).otherwise(F.col("apart")).alias("apart"), (F.col("pivot").isNull() & F.col("is_pivot").isNull()).alias("alone")), "regions")

    # 4. regions that share a prefix shingle
    rarity = np.zeros(RARITY_CLASSES, dtype=np.int64)
    for r in regions.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(RARITY_CLASSES - 1)).alias("c")).count().toLocalIterator():
        rarity[r["c"]] = r["count"]
    prefixes = materialize(_prefixes(regions, rarity, percent), "prefixes")
    meeting = prefixes.groupBy("token").agg(F.min("region").alias("low"), F.max("region").alias("high")).filter("low <> high").select("token")
    shared = prefixes.join(meeting, "token")
    span = ["token", "region", "least", "most", "rest", "mask", "before"]
    none = F.lit(None).cast("array<long>")
    lone = shared.filter("alone").select("token", "region", F.col("n").alias("least"), F.col("n").alias("most"), "rest", "mask", "before")
    wide = shared.filter("not alone").groupBy("token", "region").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    spans = materialize(lone.unionByName(wide.withColumns({"mask": none, "before": none}).select(*span)), "spans")
    left, right = (spans.select("token", *(F.col(c).alias(f"{c}_{s}") for c in span[1:])) for s in "ab")
    by_length = f"{percent} * least_a <= 100 * most_b and {percent} * least_b <= 100 * most_a"
    # at the first token that linked sets share, what follows must suffice for the rest of their overlap
    by_position = f"{100 + percent} * (1 + least(rest_a, rest_b)) >= {percent} * (least_a + least_b)"
    apart_bits = " + ".join(f"bit_count(mask_a[{w}] ^ mask_b[{w}])" for w in range(MASK_WORDS))
    by_mask = f"coalesce({100 + percent} * ({apart_bits}) <= {100 - percent} * (most_a + most_b), true)"
    at_first = "not coalesce(arrays_overlap(before_a, before_b), false)"
    fits = F.expr(f"region_a < region_b and {by_length} and {by_position} and {by_mask} and {at_first}")
    pairs = left.join(right, "token").filter(fits).select(F.col("region_a").alias("a"), F.col("region_b").alias("b")).distinct()
    extents = regions.groupBy(F.col("region").alias("id")).agg(F.max("apart").alias("extent"))
    compared = measured(pairs).withColumn("is_link", linked).withColumn("apart", distance)
    for side in "ab":
        compared = compared.join(extents.select(F.col("id").alias(side), F.col("extent").alias(f"extent_{side}")), side)
    compared = materialize(compared.filter(F.col("is_link") | (F.col("apart") <= radius + F.col("extent_a") + F.col("extent_b") + 1e-9)), "compared")
    at_a, at_b = (regions.select(F.col("id").alias(s), F.col("region").alias(f"region_{s}")) for s in "ab")
    offered = joined.select("a", "b").join(at_a, "a").join(at_b, "b").select(F.col("region_a").alias("a"), F.col("region_b").alias("b")).filter("a <> b").distinct()
    found = materialize(offered.union(compared.filter("is_link").select("a", "b")), "region-edges")
    homes = regions.select("id", "region")

    # 5. open regions: members within the windows
    open_pairs = compared.filter(~F.col("is_link") & ((F.col("extent_a") > 0) | (F.col("extent_b") > 0)))
    if open_pairs.isEmpty():
        return homes, found
    labels = materialize(components(found), "settled")
    for side in "ab":
        named = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        open_pairs = open_pairs.join(named, side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
    open_pairs = open_pairs.filter("label_a <> label_b").select("a", "b", "n_a", "n_b", "extent_a", "extent_b", F.col("apart").alias("pivots_apart"))
    masks = materialize(_masks(regions), "masks")
    members = materialize(regions.select("region", "id", "apart", F.col("n").alias("n_own")).join(masks, "id"), "members")
    for side in "ab":
        open_pairs = open_pairs.join(masks.select(F.col("id").alias(side), F.col("mask").alias(f"mask_{side}")), side, "left")
    open_pairs = materialize(open_pairs, "open-pairs")

    def window(mine: str, other: str) -> DataFrame:
        """Members of one side's region with their distance to the other side's pivot, where it leaves a link possible."""
        within = radius + F.col(f"extent_{other}") + 1e-9
        # the other pivot is at least as far as the pivots lie apart less the way to the own one, and as far as
        # the classes that hold an odd number of shingles on one side alone say: who can't be near isn't measured
        odd = F.expr(" + ".join(f"bit_count(mask[{w}] ^ mask_{other}[{w}])" for w in range(MASK_WORDS)))
        near = (F.col("pivots_apart") - F.col("apart") <= within) & F.coalesce(2 * odd <= within * (F.col("n_own") + F.col(f"n_{other}") + odd), F.lit(True))
        met = open_pairs.join(members, (open_pairs[mine] == members["region"]) & near).withColumnRenamed("apart", "to_own")
        met = met.select(F.col(mine).alias("mine"), F.col(other).alias("other"), F.col(f"extent_{other}").alias("extent"), F.col("id").alias("a"), F.col(other).alias("b"), "to_own", "pivots_apart")
        columns = ["mine", "other", "extent", "a", "b", "to_own", "to_other", "is_link"]
        pivot = met.filter("a = mine").withColumns({"to_other": F.col("pivots_apart"), "is_link": F.lit(False)}).select(*columns)
        rest = measured(met.filter("a <> mine")).withColumns({"to_other": distance, "is_link": linked}).select(*columns)
        kept = pivot.union(rest).filter(F.col("to_other") <= radius + F.col("extent") + 1e-9)
        return materialize(kept.drop("extent"), "window")

    side_a, side_b = window("a", "b"), window("b", "a")
    joined_pairs = materialize(side_a.filter("is_link").select(F.col("mine").alias("p"), F.col("other").alias("q")).union(side_b.filter("is_link").select("other", "mine")).distinct(), "joined-pairs")
    tokens = prefixes.join(meeting, "token", "left_semi").select(F.col("id").alias("member"), "token")
    in_a = side_a.select(F.col("mine").alias("p"), F.col("other").alias("q"), F.col("a").alias("x"), F.col("to_own").alias("xp"), F.col("to_other").alias("xq")).join(joined_pairs, ["p", "q"], "left_anti").join(tokens.withColumnRenamed("member", "x"), "x")
    in_b = side_b.select(F.col("other").alias("p"), F.col("mine").alias("q"), F.col("a").alias("y"), F.col("to_own").alias("yq"), F.col("to_other").alias("yp")).join(joined_pairs, ["p", "q"], "left_anti").join(tokens.withColumnRenamed("member", "y"), "y")
    near = F.expr(f"abs(xp - yp) <= {radius + 1e-9} and abs(xq - yq) <= {radius + 1e-9}")
    candidates = in_a.join(in_b, ["p", "q", "token"]).filter(near).select("p", "q", F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    verified = measured(candidates).filter(linked).select("p", "q")
    return homes, found.union(joined_pairs).union(verified).distinct()


def _classes(docs: DataFrame, k: int, percent: int, one_by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Each row of ``docs`` (id, text, key) as (id, key, n, print), and the class (print, label) of every set that has a row with an id.

    With ``one_by_id`` the sets of rows that share an id are one class.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, -(-size * BYTES_A_BYTE // RANGE_BYTES))
    surveyed = materialize(_survey(docs, k, int(ranges)), "shingles")
    each = surveyed.filter("part < 0").select("id", "key", "n", "print")
    with_id = each.filter("n > 0 and id is not null")
    sets = materialize(with_id.groupBy("print", "n").agg(F.min(F.struct("id", "key")).alias("first")), "distinct-sets")
    shared = surveyed.filter("part >= 0").select("part", "owners", "hashes").groupBy("part").applyInPandas(_shared_in_range, "print long, shared long").groupBy("print").agg(F.sum("shared").alias("shared"))
    able = materialize(sets.join(shared, "print").filter(f"100 * shared >= {percent} * n").select("first.id", "first.key"), "able")
    homes, edges = links(materialize(_sets(_only(docs, able), k), "sets"), percent)
    nodes = sets.select("print").join(homes.withColumnRenamed("id", "print"), "print", "left").select("print", F.coalesce("region", "print").alias("node"))
    if one_by_id:
        spread = with_id.groupBy("id").agg(F.min("print").alias("one"), F.max("print").alias("other")).filter("one <> other")
        same_id = with_id.join(spread, "id").select(F.col("one").alias("x"), F.col("print").alias("y")).distinct()
        ends = [nodes.select(F.col("print").alias(c), F.col("node").alias(e)) for c, e in (("x", "a"), ("y", "b"))]
        edges = edges.union(same_id.join(ends[0], "x").join(ends[1], "y").select("a", "b"))
    labels = components(edges)
    return each, nodes.join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("label"))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    each, classes = _classes(_slim(docs, id_col, text_col), k, percent, one_by_id=True)
    labelled = materialize(each.join(classes, "print", "left"), "labelled")
    # written, so that the rows of a large class may be dealt over several tasks of the join
    first = materialize(labelled.filter("label is not null").groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "class-ids")
    with_class = labelled.join(first, "label", "left")
    return with_class.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates."""
    each, classes = _classes(_slim(docs, id_col, text_col), k, percent, one_by_id=False)
    known = each.filter("id is not null").join(classes, "print", "left")
    place = F.struct("id", "key")
    # a set without words is linked with nothing
    chosen = known.filter("label is not null").groupBy("label").agg(F.min(place).alias("place")).select("place.*").union(known.filter("label is null").select("id", "key").distinct())
    chosen = materialize(chosen, "kept-rows")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    packed = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"))
    with_id = packed.filter("id is not null").join(chosen, ["id", "key"], "left_semi")
    repeated = packed.filter("id is not null").groupBy("id", "key").count().filter("count > 1").select("id", "key")
    first = F.row_number().over(Window.partitionBy("id", "key").orderBy(*(F.col("row")[c].cast("string") for c in docs.columns)))
    several = with_id.join(repeated, ["id", "key"], "left_semi").withColumn("turn", first).filter("turn = 1").select("row")
    kept = with_id.join(repeated, ["id", "key"], "left_anti").select("row").union(several).union(packed.filter("id is null").select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
