"""Prefix trie of conversations: balanced parentheses per shard, spines merged.

Every conversation is a path of turns.  Equal paths become one path with a number of members.  The paths are
sorted and dealt by range to shards, so a shard holds one stretch of the trie in depth-first order, whatever share
of the conversations begins alike.  A shard writes its nodes as balanced parentheses, one open and one close
each, with the least excess of blocks of ``BLOCK`` parentheses and of ever larger runs of blocks above them.
``find_close`` gives the end of a node's subtree; members, leaves (pairs ``()``) and savings of a subtree are
differences of cumulative arrays between its two parentheses.

A node can be in several shards only if it lies on the first or the last path of a shard: its spine.  Spine
nodes go out as partial rows with what hangs off them inside the shard.  ``merge_spines`` adds the parts of a
node up and sums them over the tree of all spines.  All other nodes are final in their shard.

Bounds: a path is one row (about 50 bytes a turn; texts are never carried, a turn is the MD5 of role and
text), a shard is one sort partition, and the spines of all shards, two paths a shard, meet in one task.  The hash of
the members that end in a node is a stream over sorted ids, so a node where a third of all conversations
end takes no memory, but one task.

Rows without a conv_id belong to no conversation and are left out.  Null role or text reads as empty, null turns
come first, equal turns go by the MD5 of role and text.  Repeated rows are repeated turns.  An empty table has no
nodes, not even a root.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import stored

BLOCK = 64
NONE = np.iinfo(np.int64).max
WORD = r"[^\x20\x09-\x0D]+"
PART = ("node string, parent string, spine boolean, depth long, words long, n_convs long, conv_id long, parent_conv long, "
        "n_children long, n_leaves long, saved long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of every conversation in order, each the MD5 of role and text and a number of words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("mark"),
                    F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"))
    found = conversations.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t.mark.alias("mark"), t.words.alias("words"))).alias("turns"))


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, turns`` where the first h turns are those of the conversation c - c % ``every`` (fewer or none if it has
    fewer or is absent), h = crc32(c) % ``most``."""
    conv = F.col("conv_id")
    heads = turns.filter(conv % every == 0).select(conv.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(conv.cast("string").cast("binary")) % most).cast("int")
    none = F.slice("turns", 1, 0)
    joined = turns.join(heads, F.col("base") == conv - conv % every, "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h),
                                             F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def node_of(turns: str) -> Column:
    """Name of the node at the end of a path: the MD5 of its turns' marks."""
    return F.md5(F.array_join(F.transform(turns, lambda t: t.mark), ""))


class Parens:
    """Balanced parentheses (1 opens, 0 closes) with a range min-max tree over blocks."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK) -> None:
        self.bits, self.block = bits, block
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        padded = np.full(-(-len(bits) // block) * block, NONE)
        padded[:len(bits)] = self.excess
        self.least = [padded.reshape(-1, block).min(1)]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            if len(low) % 2:
                low = self.least[-1] = np.append(low, NONE)
            self.least.append(np.minimum(low[::2], low[1::2]))
        self.padded = padded

    def scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``at`` to the end of its block where the excess is at most ``target``; -1 if none."""
        at, found, live = at.copy(), np.full(len(at), -1), np.arange(len(at))
        for _ in range(self.block):
            hit = self.padded[at[live]] <= target[live]
            found[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] % self.block != 0]
            if not len(live):
                break
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The matching close of every open parenthesis: the first later place whose excess is one lower."""
        target = self.excess[opens] - 1
        inside = (opens + 1) % self.block != 0
        found = np.full(len(opens), -1)
        found[inside] = self.scan(opens[inside] + 1, target[inside])
        live = np.flatnonzero(found < 0)
        node, hits = opens[live] // self.block + 1, []
        for level, least in enumerate(self.least):
            for step in (0, 1):
                ask = (node < len(least)) & ((step == 0) | (node % 2 == 0))
                hit = ask.copy()
                hit[ask] = least[node[ask] + step] <= target[live[ask]]
                hits.append((level, live[hit], node[hit] + step))
                live, node = live[~hit], node[~hit]
            node = node // 2 + 1
        for level, which, node in hits:
            for low in range(level - 1, -1, -1):
                node = node * 2
                node = np.where(self.least[low][node] <= target[which], node, node + 1)
            if len(which):
                found[which] = self.scan(node * self.block, target[which])
        return found


class Shard:
    """A stretch of sorted paths as a trie in depth-first order."""

    def __init__(self) -> None:
        self.bits, self.keys, self.up, self.depth, self.words = [1], [hashlib.md5().hexdigest()], [-1], [0], [0]
        self.weight, self.first = [0], [NONE]
        self.path: list[tuple] = []
        self.marks: list[str] = []
        self.root = hashlib.md5()
        self.head: list[int] | None = None

    def add(self, marks: list[str], words: list[int], n: int, conv_id: int) -> None:
        same, most = 0, min(len(marks), len(self.marks))
        while same < most and marks[same] == self.marks[same]:
            same += 1
        self.bits += [0] * (len(self.path) - same)
        del self.path[same:]
        for mark, count in zip(marks[same:], words[same:]):
            node, state = (self.path[-1][1], self.path[-1][2]) if self.path else (0, self.root)
            state = state.copy()
            state.update(mark.encode())
            self.bits.append(1)
            self.keys.append(state.hexdigest())
            self.up.append(node)
            self.depth.append(len(self.path) + 1)
            self.words.append(count)
            self.weight.append(0)
            self.first.append(NONE)
            self.path.append((mark, len(self.keys) - 1, state))
        self.marks = marks
        end = self.path[-1][1] if self.path else 0
        self.weight[end] += n
        self.first[end] = min(self.first[end], conv_id)
        if self.head is None:
            self.head = [0] + [x[1] for x in self.path]

    def nodes(self) -> pa.RecordBatch:
        """All nodes; those of the two spines hold what is not on a spine below them."""
        tail = [0] + [x[1] for x in self.path]
        bits = np.array(self.bits + [0] * len(tail), np.uint8)
        opens = np.flatnonzero(bits)
        closes = Parens(bits).find_close(opens)
        before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        start, stop = before[opens], before[closes]
        up, words = np.array(self.up), np.array(self.words, np.int64)

        def below(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[stop] - sums[start]

        spine = np.zeros(len(opens), bool)
        spine[self.head or [0]] = spine[tail] = True
        convs = below(np.array(self.weight, np.int64))
        leaf = (bits[opens + 1] == 0) & ~spine
        saved = np.where(spine, 0, (convs - 1) * words)
        leaves, savings = below(leaf.astype(np.int64)), below(saved)
        children = np.bincount(up[1:][~spine[1:]], minlength=len(opens))
        inner = np.flatnonzero(spine[1:]) + 1
        for values in (leaves, savings):
            whole = values.copy()
            np.subtract.at(values, up[inner], whole[inner])
        least = list(self.first)
        for i in range(len(least) - 1, 0, -1):
            if least[i] < least[self.up[i]]:
                least[self.up[i]] = least[i]
        least = np.array(least, np.int64)
        unknown = spine[np.maximum(up, 0)]
        keys = pa.array(self.keys)
        parent = keys.take(pa.array(np.maximum(up, 0), mask=up < 0))
        return pa.RecordBatch.from_arrays(
            [keys, parent, pa.array(spine), pa.array(self.depth, pa.int64()), pa.array(words), pa.array(convs), pa.array(least),
             pa.array(least[np.maximum(up, 0)], mask=unknown), pa.array(children.astype(np.int64)), pa.array(leaves), pa.array(savings)],
            names=[c.split()[0] for c in PART.split(", ")])


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard of sorted paths."""
    shard, some = Shard(), False
    for batch in batches:
        some = some or batch.num_rows > 0
        for turns, n, conv_id in zip(batch.column("turns"), batch.column("n").to_pylist(), batch.column("conv_id").to_pylist()):
            pairs = turns.values
            shard.add(pairs.field("mark").to_pylist(), pairs.field("words").to_pylist(), n, conv_id)
    if some:
        rows = shard.nodes()
        for at in range(0, rows.num_rows, 50_000):
            yield rows.slice(at, 50_000)


def merge_spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the tree of all spine nodes, whose parts are added up already."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    place = {k: i for i, k in enumerate(rows["node"].to_pylist())}
    up = np.array([place.get(k, -1) for k in rows["parent"].to_pylist()])
    depth, convs, words, children, leaves, saved = (rows[c].to_numpy().copy() for c in ("depth", "n_convs", "words", "n_children", "n_leaves", "saved"))
    children += np.bincount(up[up >= 0], minlength=len(up))
    leaves += children == 0
    saved += (convs - 1) * words
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[up[level] >= 0]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    conv = rows["conv_id"].to_numpy()
    new = {"n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved": pa.array(saved),
           "parent_conv": pa.array(conv[np.maximum(up, 0)], mask=up < 0)}
    yield pa.RecordBatch.from_arrays([new[c] if c in new else rows[c].combine_chunks() for c in rows.column_names], names=rows.column_names)


def hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of every node, over rows sorted by node and id."""
    node, state, out = None, None, []
    for batch in batches:
        for key, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if key == node:
                state.update(b",%d" % conv_id)
                continue
            if node is not None:
                out.append((node, state.hexdigest()))
            node, state = key, hashlib.sha256(b"%d" % conv_id)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "ends_sha256"])
            out = []
    if node is not None:
        out.append((node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "ends_sha256"])


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for every node of the trie of ``conv_id, turns``: ``node, parent`` (names), ``conv_id`` (smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.  Without ``shards`` Spark sets
    their number by size."""
    spark = paths.sparkSession
    paths = stored(paths.select("conv_id", "turns"), "paths")
    distinct = stored(paths.groupBy("turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "distinct-paths")
    dealt = distinct.repartitionByRange(shards, "turns") if shards else distinct.repartitionByRange("turns")
    parts = stored(dealt.sortWithinPartitions("turns").mapInArrow(encode, PART), "trie-parts")
    spines = (parts.filter("spine").groupBy("node", "parent", "spine", "depth")
              .agg(F.max("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("parent_conv").alias("parent_conv"),
                   *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")]))
    spines = stored(spines.repartition(1).mapInArrow(merge_spines, PART), "spines")
    top = spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("spine_conv"))
    ends = (paths.select(node_of("turns").alias("node"), "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
            .mapInArrow(hash_members, "node string, ends_sha256 string"))
    nodes = parts.filter("not spine").unionByName(spines).join(top, "parent", "left").join(ends, "node", "left")
    return nodes.select("node", "parent", "conv_id", "depth", F.coalesce("parent_conv", "spine_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with shared heads, without the names of nodes."""
    return trie(with_shared_heads(turns_of(conversations))).drop("node", "parent")
