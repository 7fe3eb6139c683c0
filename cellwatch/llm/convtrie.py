"""Prefix trie of conversations, by range minima over sorted common prefixes.

Conversations become sequences of turn digests.  Distinct sequences are sorted over
the whole cluster; a node of the trie is then an interval of sorted rows.  A task takes
its rows in blocks, builds a sparse table over the lengths of common prefixes of
neighbours, and for every prefix of every row searches the left and the right end of
its interval by halving, each prefix on its own and all of a block as one vector.  What
a node counts is a difference of running sums or one more range minimum, so no stack and
no walk over a tree is needed.

A node whose interval goes on beyond its block is *open*: each block gives its part
under a digest of the prefix, and parts are added up.  All counts are written as sums
over members or over the places where nodes begin, which makes parts add up exactly.

A conversation is cut into segments of ``SEGMENT_TURNS`` turns, so no row grows with its
length, and no task holds one conversation.  A segment is sorted under its *anchor*, a
128-bit hash of all turns before it; rows of equal anchors form a trie of their own that
hangs below the anchor's node.  Words and leaves of deeper tries are credited to the
smallest conversation that passes through them, whose segments carry the sums upwards.

What reaches the driver is two keys per partition of the sorted rows.

Defined results: rows without a conv_id take no part; a null role or text is empty;
turns are ordered by turn, null first, and rows of the same turn by the digest of role
and text; repeated rows are turns of their own; an empty table has no nodes, not even a
root.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellwatch.llm.shared import stored
from cellwatch.operators.timeline import Timeline

#: Turns of a segment.
SEGMENT_TURNS = 64
#: Conversation ids that are joined to one text before they are hashed.
IDS_JOINED = 512
#: Bytes of a turn's digest and of an anchor.
WIDTH = 16
#: Conversations whose ids agree but for the remainder by this share a head.
HEAD_GROUP = 20
MOST_HEAD = 3
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, words)``: turns in order from 1, without their text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit("/"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    sizes = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"))
    ordered = Timeline(narrow, "conv_id", ["turn", "digest"], sizes=sizes).row_number("pos").table()
    return ordered.select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "words")


def head_length(conv_id: str = "conv_id") -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % (MOST_HEAD + 1)


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Each conversation's first turns replaced by those of its group's first conversation.

    A row with ``pos`` 0 stands for each conversation, so that one without turns is kept.
    """
    base = (F.col("conv_id") - F.col("conv_id") % HEAD_GROUP).alias("base")
    heads = turns.where((F.col("conv_id") % HEAD_GROUP == 0) & (F.col("pos") <= MOST_HEAD))
    lengths = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("pos").alias("there"))
    convs = turns.select("conv_id").distinct().select("conv_id", base, head_length().alias("head"))
    taken = convs.join(heads.select(F.col("conv_id").alias("base"), "pos", "digest", "words"), "base").where("pos <= head")
    own = turns.withColumn("head", head_length()).where("pos > head").withColumn("base", base).join(lengths, "base", "left")
    moved = F.col("pos") - F.col("head") + F.least("head", F.coalesce("there", F.lit(0)))
    columns = ["conv_id", "pos", "digest", "words"]
    return (
        taken.select(columns).unionByName(own.select("conv_id", moved.alias("pos"), "digest", "words"))
        .unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                                  F.lit(0).cast("long").alias("words")))
    )


def _both(a: Column, b: Column) -> Column:
    """Two longs as 16 bytes."""
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _segments(turns: DataFrame, length: int) -> DataFrame:
    """A row for each conversation and segment, with hashes of all turns before and up to its end."""
    there = F.col("pos") > 0
    rows = turns.withColumn("seg", F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / length))
    rows = rows.groupBy("conv_id", "seg").agg(
        F.array_sort(F.collect_list(F.when(there, F.struct("pos", "digest", "words")))).alias("turns"),
        F.coalesce(F.bit_xor(F.when(there, F.xxhash64(F.lit(1), "pos", "digest"))), F.lit(0)).alias("a"),
        F.coalesce(F.bit_xor(F.when(there, F.xxhash64(F.lit(2), "pos", "digest"))), F.lit(0)).alias("b"),
        F.sum("words").alias("own"))
    order = Window.partitionBy("conv_id").orderBy("seg")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)) for c in ("a", "b")]
    return rows.select(
        "conv_id", "seg",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
        _both(*before).alias("anchor"),
        _both(*[x.bitwiseXOR(F.col(c)) for x, c in zip(before, ("a", "b"))]).alias("end"),
        F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"),
        F.sum("own").over(Window.partitionBy("conv_id")).alias("total"),
        F.lead("seg").over(order).isNull().alias("last"))


def _digests_of_ends(ends: DataFrame) -> DataFrame:
    """``(end, ends)``: SHA-256 of each end's conversation ids in order, comma-joined.

    Ids are joined to short texts by tasks that each see a range of them; the digest of an
    end then runs over its texts, a batch at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()
            out: list[tuple] = []
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or i - start == IDS_JOINED:
                    out.append((keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], ["end", "first_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
                if key != at:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], ["end", "ends"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["end", "ends"])

    sorted_ids = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    joined = sorted_ids.mapInArrow(join, "end binary, first_id long, ids string")
    return joined.repartition("end").sortWithinPartitions("end", "first_id").mapInArrow(digest, "end binary, ends string")


class Minima:
    """Sparse table: minima of all runs of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of the values from ``first`` to ``last``."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.log2(last - first + 1).astype(np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            low = self.levels[k]
            out[at] = np.minimum(low[first[at]], low[last[at] + 1 - (1 << int(k))])
        return out

    def left_end(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest ``l`` for each ``at`` such that all values from ``l + 1`` to ``at`` are at least ``least``."""
        l = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step, low = 1 << k, self.levels[k]
            ok = l - step >= 0
            ok &= low[np.where(ok, l - step + 1, 0)] >= least
            l = np.where(ok, l - step, l)
        return l

    def right_end(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest ``r`` for each ``at`` such that all values from ``at + 1`` to ``r`` are at least ``least``."""
        r, last = at.copy(), len(self.levels[0]) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            step, low = 1 << k, self.levels[k]
            ok = r + step <= last
            ok &= low[np.where(ok, r + 1, 0)] >= least
            r = np.where(ok, r + step, r)
        return r


def common_prefix(a: bytes, b: bytes) -> int:
    """Turns that two rows share below their anchor; -1 if their anchors differ."""
    n = 0
    while (n + 1) * WIDTH <= min(len(a), len(b)) and a[n * WIDTH:(n + 1) * WIDTH] == b[n * WIDTH:(n + 1) * WIDTH]:
        n += 1
    return n - 1


class Block:
    """Consecutive sorted rows, and what they share with the row before and the row after (-1: nothing)."""

    def __init__(self, batch: pa.RecordBatch, left: int, right: int):
        self.keys = batch.column("sorted").to_pylist()
        n = len(self.keys)
        self.size, self.left, self.right = n, left, right
        sizes = np.array([len(k) for k in self.keys], np.int64)
        self.length = sizes // WIDTH - 1
        width = int(sizes.max()) // WIDTH
        cells = np.frombuffer(b"".join(k.ljust(width * WIDTH, b"\0") for k in self.keys), np.uint64).reshape(n, width, 2)
        same = (cells[1:] == cells[:-1]).all(axis=2)
        same &= np.arange(width) <= np.minimum(self.length[1:], self.length[:-1])[:, None]
        self.shared = np.full(n, left, np.int64)
        self.shared[1:] = np.logical_and.accumulate(same, axis=1).sum(axis=1) - 1
        self.next_shared = np.append(self.shared[1:], right)
        # Prefixes of all rows, from 0 turns on: the j-th of row i is at start[i] + j.
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)])
        self.row = np.repeat(np.arange(n), self.length + 1)
        self.depth = np.arange(len(self.row)) - self.start[self.row]
        words = batch.column("words")
        flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(flat)])
        starts = np.cumsum(self.length) - self.length
        self.prefix_words = before[starts[self.row] + self.depth] - before[starts[self.row]]
        self.numbers = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                        for c in ("seg", "n", "first", "total", "before", "goes_on", "kids", "below_words", "below_leaves")}
        fresh_from = np.minimum(np.maximum(self.shared, 0), self.length)
        self.fresh = self.prefix_words[self.start[1:] - 1] - self.prefix_words[self.start[:-1] + fresh_from]
        self.fresh += self.numbers["below_words"]
        self.leaf = (self.numbers["goes_on"] == 0) & (self.next_shared < self.length)


NODES = pa.schema([
    ("node_key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.string())])


def _nodes_of(block: Block, batch: pa.RecordBatch, segment: int) -> pa.RecordBatch:
    """The block's nodes; those that go on beyond it as parts, with a key."""
    row, depth, start, num = block.row, block.depth, block.start, block.numbers
    table = Minima(np.where(np.arange(block.size) > 0, block.shared, -2))
    left, right = table.left_end(row, depth), table.right_end(row, depth)
    is_open = ((left == 0) & (depth <= block.left)) | ((right == block.size - 1) & (depth <= block.right)) | (depth == 0)
    mine = left == row  # a node is reported by the first row of its interval
    begins = mine & ~((row == 0) & (depth <= block.left))
    above = np.maximum(np.arange(len(row)) - 1, 0)  # the same row's prefix of one turn less
    parent = start[left[above]] + np.maximum(depth - 1, 0)
    children = np.bincount(parent[begins & (depth > 0)], minlength=len(row))
    at = np.flatnonzero(mine & ((depth > 0) | (num["seg"][row] == 0)))
    i, j, l, r = row[at], depth[at], left[at], right[at]

    def within(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[r + 1] - sums[l]

    smallest = Minima(num["first"])
    lowest = smallest.between(left, right)
    n = within(num["n"])
    earlier = block.prefix_words[np.where(j > 0, at - 1, at)]
    known = block.prefix_words[start[i] + np.minimum(np.maximum(block.shared[i], 0), block.length[i])]
    distinct = within(block.fresh) - np.where(j > 0, np.maximum(earlier - known, 0), 0)
    saved = within(num["total"]) - n * np.where(j > 0, num["before"][i] + earlier, 0) - distinct
    leaves = within(block.leaf + num["below_leaves"])
    ends_here = j == block.length[i]
    kids = children[at] + np.where(ends_here, num["kids"][i], 0)
    keys: dict[int, bytes] = {}

    def key(place: int) -> bytes | None:
        if not is_open[place]:
            return None
        if place not in keys:
            whole = block.keys[row[place]]
            keys[place] = hashlib.md5(whole[:(int(depth[place]) + 1) * WIDTH]).digest()
        return keys[place]

    up = parent[at]
    top = (j == 1) & (num["seg"][i] > 0)
    parent_conv = pa.array(np.where(top, batch.column("anchor_first").fill_null(0).to_numpy(zero_copy_only=False)[i], lowest[up]),
                           mask=(j == 0) | (~top & is_open[up]))
    ends = batch.column("ends").take(pa.array(i))
    return pa.RecordBatch.from_arrays([
        pa.array([key(p) if o else None for p, o in zip(at.tolist(), is_open[at].tolist())], pa.binary()),
        pa.array([key(p) if o else None for p, o in zip(up.tolist(), (is_open[up] & (j > 0) & ~top).tolist())], pa.binary()),
        pa.array(lowest[at]), pa.array(num["seg"][i] * segment + j), parent_conv, pa.array(n), pa.array(kids),
        pa.array(leaves), pa.array(saved),
        pa.array([e if here else None for e, here in zip(ends.to_pylist(), ends_here.tolist())], pa.string())], schema=NODES)


GROUPS = pa.schema([("anchor", pa.binary()), ("kids", pa.int64()), ("leaves", pa.int64()), ("words", pa.int64()),
                    ("owner", pa.int64())])


def _groups_of(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each anchor its children, leaves, words of distinct turns, and smallest conversation, as far as they are in the block."""
    first = np.flatnonzero(np.append(True, block.shared[1:] < 0))
    sums = [np.add.reduceat(v.astype(np.int64), first) for v in (block.shared < 1, block.leaf, block.fresh)]
    owner = np.minimum.reduceat(block.numbers["first"], first)
    deep = block.numbers["seg"][first] > 0
    return pa.RecordBatch.from_arrays([
        pa.array([block.keys[i][:WIDTH] for i in first[deep]], pa.binary()), *[pa.array(s[deep]) for s in sums],
        pa.array(owner[deep])], schema=GROUPS)


def _by_blocks(work, borders: dict[int, tuple[int, int]]):
    """Arrow map of sorted rows: ``work`` on each batch, knowing what its ends share with their neighbours."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield int(parts[lo]), batch.slice(lo, hi - lo)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, -1
        for part, piece in pieces(batches):
            keys = piece.column("sorted")
            if held is not None and held[0] == part:
                shared = common_prefix(held[1].column("sorted")[-1].as_py(), keys[0].as_py())
                yield work(Block(held[1], left, shared), held[1])
                left = shared
            else:
                if held is not None:
                    yield work(Block(held[1], left, borders[held[0]][1]), held[1])
                left = borders[part][0]
            held = part, piece
        if held is not None:
            yield work(Block(held[1], left, borders[held[0]][1]), held[1])

    return apply


def _borders(rows: DataFrame) -> tuple[dict[int, tuple[int, int]], bool]:
    """What each part of the sorted rows shares with the one before and after, and whether any segment is not a first one."""
    ends = rows.groupBy("part").agg(F.min("sorted").alias("low"), F.max("sorted").alias("high"), F.max("seg").alias("deepest"))
    found = sorted((r["part"], bytes(r["low"]), bytes(r["high"]), r["deepest"]) for r in ends.collect())
    between = [common_prefix(a[2], b[1]) for a, b in zip(found, found[1:])]
    return ({f[0]: (l, r) for f, l, r in zip(found, [-1, *between], [*between, -1])}, any(f[3] for f in found))


def _below(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """``(end, below_words, below_leaves)``: what the tries below each segment's end hold in all.

    Each anchor's sums go to its smallest conversation, whose segments add up those of deeper ones.
    """
    longest = F.max("seg").over(Window.partitionBy("conv_id"))
    long = segments.select("conv_id", "seg", "anchor", "end").withColumn("longest", longest).where("longest > 0")
    owned = long.join(groups.select("anchor", F.col("owner").alias("conv_id"), "words", "leaves"), ["anchor", "conv_id"], "left")
    deeper = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(1, Window.unboundedFollowing)
    summed = owned.select("end", F.sum("words").over(deeper).alias("words"), F.sum("leaves").over(deeper).alias("leaves"))
    return summed.groupBy("end").agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("below_words"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("below_leaves"))


def prefix_trie(turns: DataFrame, segment: int = SEGMENT_TURNS) -> DataFrame:
    """The nodes of ``turns`` (``conv_id, pos, digest, words``; ``pos`` 0 stands for the conversation itself)."""
    segments = stored(_segments(turns, segment), "segments")
    rows = segments.groupBy("end").agg(
        F.first("anchor").alias("anchor"), F.first("key").alias("key"), F.first("words").alias("words"),
        F.first("seg").alias("seg"), F.first("before").alias("before"), F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("first"), F.sum("total").alias("total"), F.max(~F.col("last")).cast("int").alias("goes_on"))
    rows = rows.join(_digests_of_ends(segments.where("last").select("end", "conv_id")), "end", "left")
    rows = rows.withColumn("sorted", F.concat("anchor", "key")).drop("key")
    rows = stored(rows.repartitionByRange("sorted").withColumn("part", F.spark_partition_id()), "rows")
    borders, deep = _borders(rows)
    nothing = [F.lit(0).cast("long").alias(c) for c in ("kids", "below_words", "below_leaves")]
    plain = rows.select("*", *nothing, F.lit(None).cast("long").alias("anchor_first"))

    def mapped(frame: DataFrame, work, schema: str) -> DataFrame:
        together = frame.repartition("part").sortWithinPartitions("part", "sorted")
        return together.mapInArrow(_by_blocks(work, borders), schema)

    if deep:
        groups = mapped(plain, _groups_of, "anchor binary, kids long, leaves long, words long, owner long")
        groups = stored(groups.groupBy("anchor").agg(
            *[F.sum(c).alias(c) for c in ("kids", "leaves", "words")], F.min("owner").alias("owner")), "anchors")
        below = _below(segments, groups)
        above = rows.join(groups.select("anchor"), rows["end"] == groups["anchor"], "left_semi").select(
            F.col("end").alias("anchor"), F.col("first").alias("anchor_first"))
        plain = (
            rows.join(below, "end", "left").join(groups.select(F.col("anchor").alias("end"), "kids"), "end", "left")
            .join(above, "anchor", "left").fillna(0, ["kids", "below_words", "below_leaves"]))
    fields = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'string' if f.type == pa.string() else 'long'}" for f in NODES)
    nodes = stored(mapped(plain, partial(_nodes_of, segment=segment), fields), "nodes")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    opened = stored(nodes.where("node_key is not null").groupBy("node_key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.max("parent_conv_id").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends")), "open-nodes")
    parents = opened.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_found"))
    whole = nodes.where("node_key is null").unionByName(opened).join(parents, "parent_key", "left")
    return whole.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "parent_found").alias("parent_conv_id"), *sums,
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def trie_of_conversations(conversations: DataFrame) -> DataFrame:
    """Nodes of the conversations with shared heads."""
    return prefix_trie(with_shared_heads(stored(numbered_turns(conversations), "turns")))


def oracle_sql() -> str:
    """All prefixes of all rebuilt conversations, grouped; sums over subtrees by joining each node with its ancestors."""
    return rf"""
    with ordered as (
      select conv_id, row_number() over (partition by conv_id order by turn nulls first,
          md5(length(coalesce(role, ''))::varchar || '/' || coalesce(role, '') || coalesce(text, ''))) as pos,
        md5(length(coalesce(role, ''))::varchar || '/' || coalesce(role, '') || coalesce(text, '')) as digest,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
      from conversations where conv_id is not null),
    crc_table as (select i, list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as v from range(256) t(i)),
    crcs as (select list(v order by i) as vs from crc_table),
    convs as (
      select conv_id, conv_id - conv_id % {HEAD_GROUP} as base,
        xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::ubigint)),
          lambda c, b: xor(c >> 8, vs[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint) % {MOST_HEAD + 1} as head
      from (select distinct conv_id from ordered), crcs),
    rebuilt as (
      select c.conv_id, 0 as half, o.pos, digest, words from convs c join ordered o on o.conv_id = c.base and o.pos <= c.head
      union all select c.conv_id, 1, o.pos, digest, words from convs c join ordered o on o.conv_id = c.conv_id and o.pos > c.head),
    sequences as (
      select c.conv_id, coalesce(list(digest order by half, pos) filter (where digest is not null), []) as digests,
        coalesce(list(words order by half, pos) filter (where digest is not null), []) as counts
      from convs c left join rebuilt using (conv_id) group by 1),
    prefixes as (
      select conv_id, unnest(range(0, len(digests) + 1)) as depth, digests, counts from sequences),
    nodes as (
      select digests[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs,
        any_value(case when depth > 0 then counts[depth] else 0 end) as words,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(digests) = depth), '')) as ends_sha256
      from prefixes group by 1, 2),
    children as (select node[1:depth - 1] as node, count(*) as n from nodes where depth > 0 group by 1),
    counted as (select nodes.*, coalesce(n, 0) as n_children from nodes left join children using (node)),
    ancestors as (
      select node[1:d] as node, n_children, (n_convs - 1) * words as saved
      from (select *, unnest(range(0, depth + 1)) as d from counted)),
    subtrees as (select node, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from ancestors group by 1)
    select c.conv_id, c.depth::bigint as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
    from counted c join subtrees s on s.node = c.node left join nodes p on c.depth > 0 and p.node = c.node[1:c.depth - 1]
    """
