"""Prefix trie of conversations: which of them begin alike, and what sharing their beginnings saves.

A turn is a key of 20 bytes (hash of role and text, code points of the text), a conversation the keys of its turns, so
texts are read once and never gathered. Distinct conversations are dealt in ranges of their order. Each range is a shard:
its turn keys become numbers by a dictionary, its conversations go into a ternary search tree, the middle one first, and
one pass from the last node to the first adds up members, leaves and savings. A shard knows the last conversation before
and the first one after it, so it counts a node only if no earlier shard holds it; what shards know of the nodes that lie
on their borders then adds up by the node's key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import small_enough, stage

KEY = 20  # bytes of a turn
SHARD_TURNS = 100_000  # turns of a shard, on average
RUN = 50_000  # conversation ids written in one piece
FEW_BORDERS = 200_000  # border nodes up to which their ids are sent to every task
SALTS = 64
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """40 hex digits; null role and text count as empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.md5(told.cast("binary")), F.lpad(F.lower(F.hex(F.length(text))), 8, "0"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): the turn keys of each conversation, by turn (null first), equal turns by their key."""
    turns = conversations.filter("conv_id is not null").select(
        "conv_id", F.struct(F.col("turn").alias("turn"), turn_key(F.col("role"), F.col("text")).alias("key")).alias("at")
    )
    keys = F.transform(F.sort_array(F.collect_list("at")), lambda a: a["key"])
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(keys, "")).alias("seq"))


def rebuild(seqs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, seq) with the first h turns of conversation c - c % block before what follows the first h own turns.

    h is crc32(c as text) % `most`; all turns of that conversation if it has fewer, none if it is absent.
    """
    seqs = stage(seqs, "sequences")
    nothing = F.lit(b"")
    heads = seqs.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("_base"), F.substring("seq", 1, KEY * (most - 1)).alias("_head")
    )
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most * KEY).cast("int")
    joined = seqs.join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("_base"), "left")
    head = F.substring(F.coalesce("_head", nothing), F.lit(1), taken)
    return joined.select("conv_id", F.concat(head, F.substring("seq", taken + 1, F.octet_length("seq"))).alias("seq"))


RUNS = pa.schema([("seq", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
DISTINCT = pa.schema([("seq", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (seq, conv_id) into pieces of the id list of each sequence."""
    seq, ids, rows = None, [], []

    def close() -> None:
        if ids:
            rows.append((seq, ids[0], len(ids), ",".join(map(str, ids))))

    for batch in batches:
        for new, conv_id in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if new != seq or len(ids) >= RUN:
                close()
                seq, ids = new, []
            ids.append(conv_id)
        if rows:
            yield _table(rows, RUNS)
            rows = []
    close()
    if rows:
        yield _table(rows, RUNS)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (seq, first) into one row for each sequence; the id list passes through the hash as a stream."""
    seq, first, n, digest, rows = None, None, 0, None, []

    def close() -> None:
        if digest:
            rows.append((seq, first, n, digest.hexdigest()))

    for batch in batches:
        for r in batch.to_pylist():
            if r["seq"] != seq:
                close()
                seq, first, n, digest = r["seq"], r["first"], 0, hashlib.sha256()
            digest.update((("," if n else "") + r["ids"]).encode())
            n += r["n"]
        if rows:
            yield _table(rows, DISTINCT)
            rows = []
    close()
    if rows:
        yield _table(rows, DISTINCT)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """(seq, first, n, ends_sha256): every distinct sequence with its smallest and number of conversations and their hash."""
    dealt = rebuilt.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    runs = dealt.select("seq", "conv_id").mapInArrow(_runs, "seq binary, first long, n long, ids string")
    together = runs.repartition("seq").sortWithinPartitions("seq", "first")
    return together.mapInArrow(_members, "seq binary, first long, n long, ends_sha256 string")


class Tree:
    """A ternary search tree over numbered turns; node 0 is the root, and a node's number is above its parent's."""

    def __init__(self) -> None:
        self.turn, self.up, self.depth = [-1], [0], [0]
        self.low, self.equal, self.high = [0], [0], [0]

    def _new(self, turn: int, parent: int) -> int:
        self.turn.append(turn)
        self.up.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for side in (self.low, self.equal, self.high):
            side.append(0)
        return len(self.turn) - 1

    def insert(self, turns: list[int]) -> int:
        """The node at which a sequence ends."""
        parent = 0
        for t in turns:
            at = self.equal[parent]
            if not at:
                at = self.equal[parent] = self._new(t, parent)
            while self.turn[at] != t:
                side = self.low if t < self.turn[at] else self.high
                if not side[at]:
                    side[at] = self._new(t, parent)
                at = side[at]
            parent = at
        return parent

    def path(self, node: int) -> list[int]:
        """The nodes from the root to `node`."""
        found = [node]
        while node:
            node = self.up[node]
            found.append(node)
        return found[::-1]


def middle_first(n: int) -> Iterator[int]:
    """The numbers below n, the middle one of each part before its halves."""
    parts = [(0, n)]
    while parts:
        low, high = parts.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            parts += [(middle + 1, high), (low, middle)]


def shared_turns(one: bytes, two: bytes) -> int:
    """How many turns two sequences share at the beginning."""
    n = min(len(one), len(two))
    differ = np.flatnonzero(np.frombuffer(one, np.uint8, n) != np.frombuffer(two, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // KEY


NODE_DDL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, node_key binary, parent_key binary"
)
OWN, BEFORE, AFTER = 0, 1, 2


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard. Those on its borders have a `node_key` and count what this shard adds to them."""
    outer = {side: rows.loc[rows["side"] == side, "seq"].tolist() for side in (BEFORE, AFTER)}
    own = rows[rows["side"] == OWN].sort_values("seq", ignore_index=True)
    seqs = own["seq"].tolist()
    keys, numbers = np.unique(np.frombuffer(b"".join(seqs), dtype=f"S{KEY}"), return_inverse=True)
    raw = keys.astype(f"S{KEY}").view(np.uint8).reshape(-1, KEY)[:, 16:].astype(np.int64)
    lengths = (raw @ np.array([1 << 24, 1 << 16, 1 << 8, 1])).tolist()  # code points of each turn's text
    cuts = np.cumsum([0, *(len(s) // KEY for s in seqs)])
    tree, ends = Tree(), [0] * len(seqs)
    for k in middle_first(len(seqs)):
        ends[k] = tree.insert(numbers[cuts[k] : cuts[k + 1]].tolist())

    before = shared_turns(outer[BEFORE][0], seqs[0]) if outer[BEFORE] else -1
    after = shared_turns(seqs[-1], outer[AFTER][0]) if outer[AFTER] else -1
    first, last = tree.path(ends[0]), tree.path(ends[-1])
    elsewhere = set(first[: before + 1])  # counted by an earlier shard
    node_keys, digest = {}, hashlib.md5()
    for path, shared in ((first, before), (last, max(after, 0))):
        digest = hashlib.md5()
        seq = seqs[0] if path is first else seqs[-1]
        for depth, node in enumerate(path[: shared + 1]):
            digest.update(seq[KEY * (depth - 1) : KEY * depth] if depth else b"")
            node_keys[node] = depth.to_bytes(8, "big") + digest.digest()
    goes_on = ends[-1] if after >= 0 and after * KEY == len(seqs[-1]) else -1  # has its children in a later shard

    n = len(tree.turn)
    members, least, sha = [0] * n, [None] * n, [None] * n
    for node, count, conv_id, ids in zip(ends, own["n"].tolist(), own["first"].tolist(), own["ends_sha256"].tolist(), strict=True):
        members[node], least[node], sha[node] = count, conv_id, ids
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for node in range(n - 1, -1, -1):
        if not tree.equal[node] and node != goes_on:
            leaves[node] = 1
        size = lengths[tree.turn[node]] if node else 0
        saved[node] += (members[node] - (node not in elsewhere)) * size
        if node:
            up = tree.up[node]
            members[up] += members[node]
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            children[up] += node not in elsewhere
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
    parents = [None if not node or up in node_keys else least[up] for node, up in enumerate(tree.up)]
    return pd.DataFrame(
        {
            "conv_id": least, "depth": tree.depth, "parent_conv_id": pd.array(parents, dtype="Int64"), "n_convs": members,
            "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha,
            "node_key": [node_keys.get(node) for node in range(n)],
            "parent_key": [node_keys.get(up) if node else None for node, up in enumerate(tree.up)],
        }
    )


def _shards(distinct: DataFrame, shard_turns: int) -> DataFrame:
    """Distinct sequences by shard, with the last one before and the first one after each shard."""
    turns = distinct.agg(F.sum(F.octet_length("seq") / KEY + 1)).first()[0] or 0
    dealt = distinct.repartitionByRange(int(turns // shard_turns) + 1, "seq")
    own = stage(dealt.withColumns({"shard": F.spark_partition_id(), "side": F.lit(OWN)}), "shards")
    # One row for each shard that has any: the order of shards is that of their sequences.
    ends = stage(own.groupBy("shard").agg(F.min("seq").alias("low"), F.max("seq").alias("high")), "shard-ends")
    order = Window.orderBy("shard")
    beside = ends.select("shard", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))

    def outer(column: str, side: int) -> DataFrame:
        blank = {c: F.lit(None).cast(own.schema[c].dataType) for c in ("first", "n", "ends_sha256")}
        named = beside.select("shard", F.col(column).alias("seq"), F.lit(side).alias("side")).filter("seq is not null")
        return named.withColumns(blank).select(own.columns)

    return own.unionByName(outer("before", BEFORE)).unionByName(outer("after", AFTER))


def _with_parents(rows: DataFrame, borders: DataFrame) -> DataFrame:
    """Rows whose parent lies on a border, with its conversation: sent along if few, else joined over salted copies."""
    named = borders.select(F.col("node_key").alias("_key"), F.col("conv_id").alias("_conv"))
    if small_enough(borders, FEW_BORDERS):
        joined = rows.join(F.broadcast(named), F.col("parent_key") == F.col("_key"), "left")
    else:
        copies = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_of", F.pmod(F.xxhash64("conv_id", "n_convs"), F.lit(SALTS)).cast("int"))
        joined = salted.join(copies, (F.col("parent_key") == F.col("_key")) & (F.col("_of") == F.col("_salt")), "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv"))


def prefix_trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Every node of the trie of `seqs` (conv_id, seq), one row each, from the textless root.

    conv_id: the smallest of the conversations that begin with it; depth; parent_conv_id: the same of its parent, null for
    the root; n_convs, n_children; n_leaves: nodes without children in its subtree; saved_tokens: code points that need
    not be kept twice in its subtree; ends_sha256: hash of the ids, ascending and parted by commas, of the conversations
    that end there. No conversations give no rows, not even a root.
    """
    distinct = stage(distinct_sequences(seqs), "distinct")
    nodes = stage(_shards(distinct, shard_turns).groupBy("shard").applyInPandas(_grow, NODE_DDL), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    borders = nodes.filter("node_key is not null").groupBy("node_key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        *sums, F.max("ends_sha256").alias("ends_sha256"), F.min("parent_key").alias("parent_key"),
    )
    borders = stage(borders.select(nodes.columns), "borders")
    inside = nodes.filter("node_key is null")
    rows = inside.filter("parent_key is null").unionByName(
        _with_parents(inside.filter("parent_key is not null").unionByName(borders), borders).select(nodes.columns)
    )
    return rows.drop("node_key", "parent_key").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of `conversations` (conv_id, turn, role, text).

    Rows without a conv_id belong to no conversation and are left out. A null role or text counts as empty, a null turn
    comes first; rows with equal turns stand by hash, repeated rows are turns of their own. Other columns are not read.
    The turns of one conversation travel as one value, 20 bytes for each.
    """
    return prefix_trie(rebuild(sequences(conversations)))
