"""The conversation trie against tuples of turns in a dictionary, over shards of any size."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from feedloom.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest() + f"{len(text):08x}"


def rebuilt(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, key(role, text), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    found = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if convs[c] == p)
        found.append(
            (
                min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
                sum(not any(r[:-1] == q for r in nodes if r) for q in below),
                sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(found, key=repr)


def rows_of(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def chats(seed, n=120):
    """Conversations with few different turns, so that many share a beginning, are copies, or begin another one."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv_id = rng.choice([c, 100 * c, 100 * (c % 4) + c])
        rows += [(conv_id, t, rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "", None, "ok 😀"])) for t in range(rng.randint(1, 7))]
    return rows


@pytest.mark.parametrize("shard_turns", [3, 40, 100_000])
def test_trie_over_shards(spark, shard_turns):
    rows = chats(shard_turns)
    seqs = prefix_trie.rebuild(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)))
    assert rows_of(prefix_trie.prefix_trie(seqs, shard_turns)) == brute(rows)


def test_a_node_on_the_border_of_many_shards(spark):
    """One long conversation that hundreds continue, and copies of it: its turns lie on the borders of all shards."""
    trunk = [(t, "user", f"turn {t}") for t in range(12)]
    rows = [(1 + c, *t) for c in range(5) for t in trunk]
    rows += [(1000 + c, *t) for c in range(300) for t in [*trunk, (20, "user", f"end {c % 250}")]]
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, TURNS))
    found = {(r["depth"], r["conv_id"]): r for r in prefix_trie.prefix_trie(seqs, 30).collect()}
    assert len(found) == 13 + 250
    for d in range(13):
        r = found[d, 1]
        assert (r["n_convs"], r["n_children"], r["n_leaves"], r["parent_conv_id"]) == (305, 250 if d == 12 else 1, 250, 1 if d else None)
    assert found[12, 1]["ends_sha256"] == hashlib.sha256(b"1,2,3,4,5").hexdigest()
    assert found[0, 1]["saved_tokens"] == sum(304 * len(t[2]) for t in trunk) + sum(len(f"end {c}") for c in range(50))


def test_borders_joined_over_salted_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FEW_BORDERS", 0)
    rows = chats(7, 40)
    seqs = prefix_trie.rebuild(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)))
    assert rows_of(prefix_trie.prefix_trie(seqs, 5)) == brute(rows)


def test_id_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(c, 0, "user", "same") for c in [*range(-20, 30), 10**15]]
    found = prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)).repartition(7)).collect()
    ends = {r["depth"]: r["ends_sha256"] for r in found}
    assert ends[1] == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()


def test_trie_edges(spark):
    rows = [
        (None, 0, "user", "nobody's"), (7, None, None, None), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, 1, "user", "b"),
        (8, 3, "user", "x" * 300_000), (100, 0, "user", "first"), (103, 0, "user", "only"), (-105, 0, "a", "b"), (-100, 0, "c", "d"),
        (12, 0, "us", "erx"), (13, 0, "user", "x"),
    ]
    docs = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(0) for c in ("seq", "shard", "side", "first", "n", "_base")})
    assert rows_of(prefix_trie.conversation_trie(docs)) == brute(rows)
    none = prefix_trie.conversation_trie(docs.limit(0))
    assert none.columns == list(FIELDS) and none.collect() == []


def test_only_turnless_conversations(spark):
    """Conversations whose own turns are all replaced, by those of a conversation that does not exist."""
    short = [c for c in range(101, 300) if c % 100 and zlib.crc32(str(c).encode()) % 6]
    rows = [(c, 0, "user", "gone") for c in short]
    (root,) = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    ids = ",".join(map(str, short)).encode()
    assert (root["depth"], root["conv_id"], root["n_convs"], root["n_leaves"]) == (0, short[0], len(short), 1)
    assert root["ends_sha256"] == hashlib.sha256(ids).hexdigest() and root["saved_tokens"] == 0


def test_middle_first():
    for n in range(20):
        assert sorted(prefix_trie.middle_first(n)) == list(range(n))
    tree = prefix_trie.Tree()
    for k in prefix_trie.middle_first(1023):
        tree.insert([k])
    deep, level = 0, [tree.equal[0]]
    while level:
        deep, level = deep + 1, [x for n in level for x in (tree.low[n], tree.high[n]) if x]
    assert deep == 10  # balanced
