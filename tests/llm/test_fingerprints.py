"""Fingerprints against whole sets of 5-grams, and the query against a loop over the documents."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from feedloom.llm import fingerprints as fp
from feedloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = [a + b for a in "ba de fi go lu ma ne po ri su".split() for b in "n r s t lk mp ing er".split()]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(n))


def grams(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def of(text):
    return fp.sketch(fp.shingles(text))


def brute(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited fingerprint, near_edited, near_next) of (doc_id, text) in order."""
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + following[:cut]
        yield (
            doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), of(text), of(new),
            fp.likeness(of(text), of(new)), fp.likeness(of(text), of(following)),
        )


def rows_of(df):
    return [
        (r["doc_id"], r["n_chars"], r["edited_sha256"], fp.decode(r["fingerprint"]), fp.decode(r["edited_fingerprint"]), r["near_edited"], r["near_next"])
        for r in df.collect()
    ]


def test_op12(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    expected = list(brute(rows))
    found = rows_of(QUERIES["op12_fingerprints"](spark, FOLDER))
    assert sorted(found) == sorted(expected)
    assert all(0 <= x <= 1 for r in found for x in r[5:])
    long = [r for r in found if r[1] > 1000]
    assert sum(r[5] > 0.55 for r in long) >= 0.95 * len(long)


def test_every_hash_below_the_fraction_is_kept():
    for n in (1, 4, 5, 18, 30, 300, 20_000):
        hashes = fp.shingles(prose(n, n))
        assert len(hashes) == len(grams(prose(n, n)))
        bound, kept = fp.unpack(fp.sketch(hashes))
        assert set(kept.tolist()) == {h for h in hashes.tolist() if h <= bound} and len(kept) >= min(len(hashes), fp.LEAST)
        assert {h for h in hashes.tolist() if h < fp.FULL // fp.FRACTION} <= set(kept.tolist())
    n = len(fp.shingles(prose(1, 40_000)))
    assert abs(len(fp.unpack(of(prose(1, 40_000)))[1]) * fp.FRACTION / n - 1) < 0.1


def test_short_texts_are_compared_exactly():
    one, two = prose(1, 12), prose(1, 12) + " and two words"
    a, b = grams(one), grams(two)
    assert fp.compare(of(one), of(two)) == (len(a & b) / len(a), len(a & b) / len(b), len(a & b) / len(a | b))
    assert fp.likeness(of("one"), of("two")) == 0 and fp.likeness(of(""), of("")) == 1 == fp.likeness(of(None), of(" \n"))
    assert fp.likeness(of(""), of("one")) == 0


def test_containment_between_unequal_documents():
    short = prose(2, 600)
    parts = [prose(k, 12_000) for k in (3, 4)]
    in_short, in_long, jaccard = fp.compare(of(short), of(f"{parts[0]} {short} {parts[1]}"))
    assert in_short > 0.97 and abs(in_long - 600 / 24_600) < 0.01 and abs(jaccard - 600 / 24_600) < 0.01
    assert fp.likeness(of(short), of(" ".join(parts))) < 0.02
    errors = []
    for k in range(40):
        a, b = prose(k, 800), prose(k, 400) + " " + prose(k + 1000, 400)
        x, y = grams(a), grams(b)
        errors.append(fp.compare(of(a), of(b))[2] - len(x & y) / len(x | y))
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.03


def test_merge_is_the_fingerprint_of_both():
    texts = [prose(k, n) for k, n in enumerate((3, 40, 900, 5000))]
    whole = np.unique(np.concatenate([fp.shingles(t) for t in texts]))
    merged = fp.merge(map(of, texts))
    bound, kept = fp.unpack(merged)
    assert kept.tolist() == [h for h in whole.tolist() if h <= bound]
    assert fp.merge([fp.merge(map(of, texts[:2])), fp.merge(map(of, texts[2:]))]) == merged
    assert fp.compare(of(texts[1]), merged)[0] == 1


def test_edges(spark):
    long = prose(9, 60_000)
    rows = [
        (None, None), (None, "null id"), (1, ""), (1, ""), (2, " \n\t"), (3, long), (3, long), (4, "😀é word " * 50), (5, "abc"), (6, None), (7, prose(9, 500)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("part", "first", "last", "_of", "_from")})
    hashes = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashes, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or ""))
    expected = sorted(brute([(r["doc_id"], r["text"]) for r in order]), key=repr)
    for n in (1, 6):
        assert sorted(rows_of(fp.fingerprint_digest(docs.repartition(n))), key=repr) == expected
    assert fp.fingerprint_digest(docs.limit(0)).collect() == []
    (only,) = rows_of(fp.fingerprint_digest(docs.filter("doc_id = 7")))
    assert only[1] == len(prose(9, 500)) and only[6] == 1.0
    plain = {r["doc_id"]: bytes(r["fingerprint"]) for r in fp.fingerprint_texts(docs).collect()}
    assert plain[7] == of(prose(9, 500)) and plain[6] == of("")
