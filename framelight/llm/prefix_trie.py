"""The trie of all conversations' prefixes, merged family by family.

Conversations whose ids share their hundreds form a family; each is rebuilt
from the first turns of the family's base and its own later turns. A family's
conversations and the base's first turns are cogrouped by base id, rebuilt and
combined into the family's small trie, and only these combined nodes are
shuffled and merged by key. Sums over subtrees need no tree as a whole: every
merged node belongs to the family of its smallest member, each family adds up
its own nodes over its own trie, and the families' sums are merged by key.

A node's key is its depth and two 64-bit sums of salted turn checksums, so the
key at any depth can be had from partial sums. Conversations are therefore cut
into segments of ``SEGMENT`` turns, and a family's trie is built a segment at a
time: no group holds more than a family's conversations times a segment,
however long one conversation is. Turns are numbered over sorted ranges, a
list of ids is joined and hashed in pieces, and no text is shuffled.

Defined results: null role or text is empty; turns go in the order of ``turn``,
null first, equal ones in the order of a checksum of role and text; repeated
rows are turns of their own; rows with a null conv_id take no part; ``%`` has
the sign of its left side, so ids -99 to 99 are one family; an empty table has
no root and gives an empty result. Columns beyond those used are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.llm.sharding import number_rows
from framelight.llm.storage import materialize
from framelight.llm.text import mix

FAMILY = 100
#: A conversation takes fewer turns of its base than this.
MOST_SHARED = 6
SEGMENT = 1024
#: Ids joined before they are hashed.
IDS_IN_PIECE = 4096

_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
KEY = ["depth", "y", "z"]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = []
        for role, text in zip(batch.column(2), batch.column(3), strict=True):
            who, said = role.as_buffer() or b"", text.as_buffer() or b""
            h = hashlib.blake2b(len(who).to_bytes(8, "little"), digest_size=16)
            h.update(who)
            h.update(said)
            each.append(h.digest())
        pair = np.frombuffer(b"".join(each), dtype=np.int64).reshape(-1, 2)
        points = pc.utf8_length(batch.column(3)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), points], names=["conv_id", "turn", "a", "b", "n"])


def salted(checksums: np.ndarray, depth: np.ndarray, which: int) -> np.ndarray:
    """What a turn at a depth adds to the keys of all prefixes that hold it."""
    return mix(checksums.astype(np.int64).view(np.uint64) + depth.astype(np.uint64) * _SALT[which])


def _base(conv: Column) -> Column:
    return conv - conv % FAMILY


def _segment(depth: Column, size: int) -> Column:
    return F.floor(F.greatest(depth - 1, F.lit(0)) / size).cast("long")


def _halves(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(conv_id, segment) and the salted checksums of turns, halved so that they can be summed."""
    low = np.uint64(0xFFFFFFFF)
    for batch in batches:
        depth = batch.column(1).to_numpy()
        out = []
        for which in range(2):
            s = salted(batch.column(2 + which).to_numpy(), depth, which)
            out += [pa.array((s & low).astype(np.int64)), pa.array((s >> np.uint64(32)).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((depth - 1) // size), *out], names=["conv_id", "segment", "y0", "y1", "z0", "z1"])


def _whole(low: str, high: str) -> Column:
    """The 64 bits of low + high * 2**32, without overflow."""
    carried = F.col(high) + F.shiftright(low, 32)
    return F.shiftleft(carried.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(F.col(low).bitwiseAND(F.lit(0xFFFFFFFF)))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


_FAMILY_NODES = "base long, segment long, depth long, y long, z long, py long, pz long, conv_id long, n_convs long, n_more long, n long, ends boolean"


def family_trie(heads: pa.Table, rows: pa.Table) -> pa.Table:
    """Nodes of one segment of a family, and where its conversations end.

    ``heads`` are the base's first turns (pos, a, b, n), only for the first
    segment; ``rows`` are own turns (depth from 1) and for each conversation a
    row with ``header``: the key before the segment in a and b, its length in n,
    the number of shared turns in depth.
    """
    header, conv, depth, a, b, n = _columns(rows, "header", "conv_id", "depth", "a", "b", "n")
    first = np.flatnonzero(header)
    first = first[np.argsort(conv[first])]
    convs, shared, length = conv[first], depth[first], n[first]
    base, segment = rows.column("base")[0].as_py(), rows.column("segment")[0].as_py()
    own = np.flatnonzero(~header)
    parts = [(np.searchsorted(convs, conv[own]), depth[own], a[own], b[own], n[own])]
    if heads.num_rows:
        pos, ha, hb, hn = _columns(heads, "pos", "a", "b", "n")
        who, which = np.nonzero(pos[None, :] < shared[:, None])
        parts.append((who, pos[which] + 1, ha[which], hb[which], hn[which]))
    who, depth, a, b, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((depth, who))
    who, depth, n = who[order], depth[order], n[order]
    opens = np.searchsorted(who, np.arange(len(convs)))
    keys = []
    for which, (turns, before) in enumerate(((a[order], rows.column("a").to_numpy()[first]), (b[order], rows.column("b").to_numpy()[first]))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted(turns, depth, which), dtype=np.uint64)])
        entry = before.astype(np.int64).view(np.uint64)
        keys.append(((sums[1:] - sums[opens[who]] + entry[who]).view(np.int64), entry.view(np.int64)))
    (y, y_in), (z, z_in) = keys
    # the key before each turn: that of the turn before, or the one the conversation came with
    is_first = np.zeros(len(who), dtype=bool)
    is_first[opens[opens < len(who)]] = True
    is_first &= np.diff(who, prepend=-1) != 0
    py, pz = np.where(is_first, y_in[who], np.roll(y, 1)), np.where(is_first, z_in[who], np.roll(z, 1))
    more = depth < length[who]
    if segment == 0:  # the root, which every conversation of the family passes
        who, depth, n, more = np.concatenate([np.arange(len(convs)), who]), np.concatenate([np.zeros(len(convs), np.int64), depth]), np.concatenate([np.zeros(len(convs), np.int64), n]), np.concatenate([length > 0, more])
        y, z, py, pz = (np.concatenate([np.zeros(len(convs), np.int64), x]) for x in (y, z, py, pz))
    by = np.lexsort((who, z, y, depth))
    d, ky, kz = depth[by], y[by], z[by]
    at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (ky[1:] != ky[:-1]) | (kz[1:] != kz[:-1])])) if len(by) else np.zeros(0, np.int64)
    one = by[at]
    ends = np.flatnonzero(depth == length[who])
    out = {
        "depth": np.concatenate([depth[one], depth[ends]]),
        "y": np.concatenate([y[one], y[ends]]),
        "z": np.concatenate([z[one], z[ends]]),
        "py": np.concatenate([py[one], py[ends]]),
        "pz": np.concatenate([pz[one], pz[ends]]),
        "conv_id": convs[who[np.concatenate([one, ends])]],  # rows of a node go by conversation, so its first is the smallest
        "n_convs": np.concatenate([np.diff(np.append(at, len(by))), np.ones(len(ends), np.int64)]),
        "n_more": np.concatenate([np.add.reduceat(more[by].astype(np.int64), at) if len(at) else np.zeros(0, np.int64), np.zeros(len(ends), np.int64)]),
        "n": np.concatenate([n[one], n[ends]]),
        "ends": np.concatenate([np.zeros(len(one), bool), np.ones(len(ends), bool)]),
    }
    rows_out = len(one) + len(ends)
    return pa.table({"base": np.full(rows_out, base), "segment": np.full(rows_out, segment), **out})


_SUMS = "depth long, y long, z long, saved long, leaves long, children long"


def family_sums(nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """What one segment of a family adds to its nodes, from the merged nodes that belong to it.

    ``owned`` has (depth, y, z, saved, leaves, is_node); rows that aren't nodes
    bring in what lies beyond the segment.
    """
    depth, y, z, py, pz = _columns(nodes, *KEY, "py", "pz")
    if not len(depth):
        return pa.table({c: np.zeros(0, np.int64) for c in (*KEY, "saved", "leaves", "children")})
    order = np.lexsort((z, y, depth))
    depth, y, z, py, pz = (x[order] for x in (depth, y, z, py, pz))
    # places of keys among the nodes: both sides are numbered together
    asked_d, asked_y, asked_z, saved, leaves, is_node = _columns(owned, *KEY, "saved", "leaves", "is_node")

    def places(d: np.ndarray, ky: np.ndarray, kz: np.ndarray) -> np.ndarray:
        both = np.lexsort((np.repeat([0, 1], [len(depth), len(d)]), np.concatenate([z, kz]), np.concatenate([y, ky]), np.concatenate([depth, d])))
        found = np.maximum.accumulate(np.where(both < len(depth), both, -1))
        out = np.empty(len(d), dtype=np.int64)
        asks = both >= len(depth)
        out[both[asks] - len(depth)] = found[asks]
        hit = np.maximum(out, 0)
        return np.where((out >= 0) & (depth[hit] == d) & (y[hit] == ky) & (z[hit] == kz), out, -1)

    parent = places(depth - 1, py, pz)
    at = places(asked_d, asked_y, asked_z)
    total = np.zeros((len(depth), 2), dtype=np.int64)
    np.add.at(total, at[at >= 0], np.stack([saved, leaves], axis=1)[at >= 0])
    children = np.zeros(len(depth), dtype=np.int64)
    mine = at[(at >= 0) & is_node]
    np.add.at(children, parent[mine][parent[mine] >= 0], 1)
    for low, high in reversed(list(zip(*_runs(depth), strict=True))):
        inner = np.arange(low, high)
        inner = inner[parent[inner] >= 0]
        np.add.at(total, parent[inner], total[inner])
    # children whose parent lies in the segment before
    over = mine[(parent[mine] < 0) & (depth[mine] > 0)]
    none = np.zeros(len(over), np.int64)
    out = {
        "depth": np.concatenate([depth, depth[over] - 1]), "y": np.concatenate([y, py[over]]), "z": np.concatenate([z, pz[over]]),
        "saved": np.concatenate([total[:, 0], none]), "leaves": np.concatenate([total[:, 1], none]), "children": np.concatenate([children, none + 1]),
    }
    return pa.table(out)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(sorted_values, prepend=sorted_values[0] - 1))
    return starts, np.append(starts[1:], len(sorted_values))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (depth, y, z, conv_id) as texts of ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        *key, conv = (c.to_numpy() for c in batch.columns)
        cut = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])])
        starts = np.flatnonzero(cut)
        starts = np.concatenate([np.arange(s, e, IDS_IN_PIECE) for s, e in zip(starts, np.append(starts[1:], len(conv)), strict=True)])
        ids = conv.astype(str).tolist()
        joined = [",".join(ids[s:e]) for s, e in zip(starts, np.append(starts[1:], len(conv)), strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in key), pa.array(conv[starts]), pa.array(joined)], names=[*KEY, "first", "ids"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a key from its pieces in order; the hash goes on over batches."""
    open_key, h = None, None
    for batch in batches:
        done: list[tuple] = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != open_key:
                if h is not None:
                    done.append((*open_key, h.hexdigest()))
                open_key, h = key, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield _hashes(done)
    if h is not None:
        yield _hashes([(*open_key, h.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*KEY, "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, y, z, ends_sha256) of (depth, y, z, conv_id): ids are joined in sorted ranges, then only the pieces of a node meet."""
    spread = [*KEY, "conv_id"]
    pieces = ends.repartitionByRange(*spread).sortWithinPartitions(*spread).mapInArrow(_join_ids, "depth long, y long, z long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hash_pieces, "depth long, y long, z long, ends_sha256 string")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per conversation (base, conv_id, shared, length); own turns (base, conv_id, depth, a, b, n); the bases' first turns (base, pos, a, b, n)."""
    kind = turns.schema["turn"].dataType.simpleString()
    slim = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    read = materialize(slim.mapInArrow(_digest, f"conv_id long, turn {kind}, a long, b long, n long"), "trie-turns")
    # equal rows get an order too, so that a range border may fall between them
    numbered, _ = number_rows(read.withColumn("tie", F.monotonically_increasing_id()), ["conv_id", "turn", "a", "b", "tie"])
    numbered = numbered.drop("turn", "tie")
    sizes = numbered.groupBy("conv_id").agg(F.min("row_number").alias("start"), F.count("*").alias("size")).withColumn("base", _base(F.col("conv_id")))
    sizes = materialize(sizes, "trie-sizes")
    bases = sizes.filter(F.col("conv_id") == F.col("base")).select("base", F.col("size").alias("base_size"))
    asked = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    shared = F.least("asked", F.coalesce("base_size", F.lit(0)))
    convs = sizes.withColumn("asked", asked).join(bases, "base", "left").withColumn("shared", shared)
    convs = materialize(convs.select("base", "conv_id", "start", "asked", "shared", (F.col("shared") + F.greatest(F.col("size") - F.col("asked"), F.lit(0))).alias("length")), "trie-convs")
    placed = materialize(numbered.join(convs.drop("length"), "conv_id").withColumn("pos", F.col("row_number") - F.col("start")), "trie-placed")
    own = placed.filter("pos >= asked").select("base", "conv_id", (F.col("pos") - F.col("asked") + F.col("shared") + 1).alias("depth"), "a", "b", "n")
    heads = placed.filter((F.col("conv_id") == F.col("base")) & (F.col("pos") < MOST_SHARED - 1)).select("base", "pos", "a", "b", "n")
    return convs.drop("start", "asked"), own, heads


def segment_starts(convs: DataFrame, own: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """(base, conv_id, segment, y, z): the key of each long conversation before each of its segments but the first."""
    long = convs.filter(F.col("length") > size)
    taken = heads.join(long, "base").filter("pos < shared").select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b")
    rows = own.join(long.select("conv_id"), "conv_id", "left_semi").select("conv_id", "depth", "a", "b").union(taken)
    halves = ["y0", "y1", "z0", "z1"]
    sums = rows.mapInArrow(lambda batches: _halves(batches, size), "conv_id long, segment long, y0 long, y1 long, z0 long, z1 long").groupBy("conv_id", "segment").agg(*(F.sum(c).alias(c) for c in halves))
    upto = Window.partitionBy("conv_id").orderBy("segment")
    keys = sums.select("conv_id", (F.col("segment") + 1).alias("segment"), *(F.sum(c).over(upto).alias(c) for c in halves))
    starts = keys.join(long, "conv_id").filter(F.col("segment") * size < F.col("length"))
    return materialize(starts.select("base", "conv_id", "segment", _whole("y0", "y1").alias("y"), _whole("z0", "z1").alias("z"), "length"), "trie-starts")


def prefix_trie(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Every node of the trie of a table (conv_id, turn, role, text); a segment holds all turns that are shared."""
    if segment < MOST_SHARED - 1:
        raise ValueError(f"a segment has {MOST_SHARED - 1} turns at least")
    convs, own, heads = rebuild(turns)
    starts = segment_starts(convs, own, heads, segment)
    zero, no, yes = F.lit(0).cast("long"), F.lit(False), F.lit(True)
    headers = convs.select("base", zero.alias("segment"), "conv_id", F.col("shared").cast("long").alias("depth"), zero.alias("a"), zero.alias("b"), F.col("length").alias("n"), yes.alias("header")).union(
        starts.select("base", "segment", "conv_id", zero.alias("depth"), F.col("y").alias("a"), F.col("z").alias("b"), F.col("length").alias("n"), yes.alias("header"))
    )
    rows = own.select("base", _segment(F.col("depth"), segment).alias("segment"), "conv_id", "depth", "a", "b", "n", no.alias("header")).union(headers)
    tries = heads.withColumn("segment", zero).groupBy("base", "segment").cogroup(rows.groupBy("base", "segment")).applyInArrow(lambda h, r: family_trie(h, r), _FAMILY_NODES)
    families = materialize(tries, "trie-families")

    # first merge: whose each node is, and how many share it
    own_nodes = families.filter("not ends")
    nodes = materialize(
        own_nodes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_more").alias("n_more"), F.min("py").alias("py"), F.min("pz").alias("pz"), F.min("n").alias("n")), "trie-nodes"
    )
    weights = nodes.select("conv_id", *KEY, ((F.col("n_convs") - 1) * F.col("n")).alias("saved"), (F.col("n_more") == 0).cast("long").alias("leaves"))
    # what the later segments of a long conversation hold of nodes that are its own
    later = Window.partitionBy("conv_id").orderBy(F.desc("segment"))
    beyond = weights.filter(F.col("depth") > segment).groupBy("conv_id", _segment(F.col("depth"), segment).alias("segment")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    carried = starts.join(beyond, ["conv_id", "segment"], "left").select("base", "conv_id", "segment", "y", "z", *(F.sum(F.coalesce(c, zero)).over(later).alias(c) for c in ("saved", "leaves")))
    owned = weights.select(_base(F.col("conv_id")).alias("base"), _segment(F.col("depth"), segment).alias("segment"), *KEY, "saved", "leaves", yes.alias("is_node")).union(
        carried.select("base", (F.col("segment") - 1).alias("segment"), (F.col("segment") * segment).alias("depth"), "y", "z", "saved", "leaves", no.alias("is_node"))
    )
    # second merge: what the families' subtrees hold
    sums = own_nodes.select("base", "segment", *KEY, "py", "pz").groupBy("base", "segment").cogroup(owned.groupBy("base", "segment")).applyInArrow(lambda f, o: family_sums(f, o), _SUMS)
    sums = sums.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("conv_id").alias("parent_conv_id"))
    ended = end_hashes(families.filter("ends").select(*KEY, "conv_id"))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(above, ["depth", "py", "pz"], "left").join(sums, KEY).join(ended, KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
