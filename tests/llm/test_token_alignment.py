"""Alignment against both libraries over whole texts, links and counts in a loop."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from feedloom.llm import token_alignment as ta
from feedloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tool():
    return ta.Aligner(*FILES)


def whole(tool, text):
    """(ids of A, ids of B, groups, links) of a text in one piece; None if the bytes differ."""
    if not text:
        return None
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    a_bytes, b_bytes = [tool.a_bytes[i] for i in a], [tool.b_bytes[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    ends_a, ends_b = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
    links = [(a[i], b[ends_b.index(e)]) for i, e in enumerate(ends_a) if e in set(ends_b)]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        to_i, to_j = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
        i, j = to_i, to_j
    return a, b, groups, links


def brute(tool, rows):
    found = [(doc_id, whole(tool, text)) for doc_id, text in rows]
    counts = Counter(link for _, x in found if x for link in x[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    for doc_id, x in found:
        if x is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
        else:
            a, b, groups, links = x
            best = sum(counts[link] == highest[link[1]] for link in links)
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            yield (doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[link] for link in links), digest)


def rows_of(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def test_op13(spark, tool):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    assert rows_of(QUERIES["op13_token_alignment"](spark, FOLDER)) == sorted(brute(tool, rows), key=repr)


ODD = [
    "<|endoftext|> is plain", "<s> x</s> <unk> <0x0A>  <pad>", "a▁b", "▁", "fine ▁ not", "  x  y", " \n\t", " ", "x ", " x", " a b ", "a\n b c", "a  b",
    "a b\n", "\x85 a \x1c b", "a\xa0b c d", "日本 語 😀", "é<0x41>\x00 z", "x" * 5000, "it's 'll we've  I'm", "é ü", "\r\n \r\n", "1234567 89 0",
]


@pytest.mark.parametrize("stretch", [20, 1 << 20])
def test_odd_texts(tool, stretch, monkeypatch):
    monkeypatch.setattr(ta, "STRETCH", stretch)
    texts = [*ODD, " ".join(ODD[:2] + ODD[5:]), "\n".join(ODD[5:])]
    for text, found in zip(texts, tool.align_all(texts), strict=True):
        expected = whole(tool, text)
        if expected is None:
            assert found is None, text
        else:
            a, b, groups, links = expected
            assert (found[0].n_a, found[0].n_b, found[0].n_groups) == (len(a), len(b), len(groups)), text
            assert found[0].groups == ";".join(groups), text
            assert dict(zip(found[1].tolist(), found[2].tolist(), strict=True)) == Counter(x * tool.n_b + y for x, y in links)


def test_pieces_forgotten_and_met_again(tool, monkeypatch):
    monkeypatch.setattr(ta, "CACHED_PIECES", 40)
    texts = [f"word{k % 70} again and again {k}x" for k in range(300)] * 2
    fresh = ta.Aligner(*FILES)
    for at in range(0, len(texts), 50):
        for text, found in zip(texts[at : at + 50], fresh.align_all(texts[at : at + 50]), strict=True):
            assert found[0].groups == ";".join(whole(tool, text)[2])


def test_edges(spark, tool):
    rows = [(1, "one two"), (1, "one two"), (None, "one three"), (2, None), (3, ""), (4, " "), (5, "broken ▁ text"), (6, "one two " * 200_000)]
    rows += [(10 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.withColumns({c: F.lit(0) for c in ("pair", "n", "pairs", "times", "groups", "link", "n_best")})
    found = rows_of(ta.alignment_digest(clashing.filter("doc_id is null or doc_id <> 6"), *FILES))
    assert found == sorted(brute(tool, [r for r in rows if r[0] != 6]), key=repr)
    long = {r["doc_id"]: r for r in ta.alignment_digest(clashing, *FILES).collect()}[6]
    assert long["n_groups"] == long["n_links"] and long["n_a"] == len(tool.a.encode(" " + rows[7][1], add_special_tokens=False).ids)
    assert ta.alignment_digest(clashing.limit(0), *FILES).collect() == []


def test_groups_are_returned(spark):
    docs = spark.createDataFrame([(1, "日本 語")], "doc_id long, text string")
    (row,) = ta.align_texts(docs, *FILES).collect()
    assert row["groups"].count("|") == row["n_groups"] == sum(row["times"]) and len(row["pairs"]) == len(row["times"])


def test_the_table_of_counts_is_bounded_by_the_vocabularies(spark, tool):
    most = ta.most_pairs(*FILES)
    assert most < 500_000
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = ta.pair_counts(ta.align_texts(docs, *FILES)).collect()
    assert 1_000 < len(counts) < most
    for r in counts:
        a, b = tool.a_bytes[r["pair"] // tool.n_b], tool.b_bytes[r["pair"] % tool.n_b]
        assert a.endswith(b) or b.endswith(a)
