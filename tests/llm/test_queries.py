"""Registered training-data queries against their SQL statements or brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import corpus_pipeline
from check import TABLES, rows_of
from feedloom.llm import decontamination, jaccard_join, language_id
from feedloom.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    return {doc_id: (text, lang) for doc_id, text, lang in rows}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    )


def test_op1(spark, texts):
    rows = QUERIES["op1_quality_rules"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        own = measures(texts[r["doc_id"]][0])
        assert own == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (r["kept"] and r["base_failed"])
    good = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/labels.parquet' WHERE quality = 1").fetchall()}
    lost = [r["doc_id"] for r in rows if r["doc_id"] in good and not r["base_failed"] and not r["kept"]]
    junk = [r for r in rows if not r["base_failed"] and r["n_symbols"] > 0.3 * r["n_words"]]
    assert len(lost) <= 0.05 * len(good)
    assert sum(r["kept"] for r in junk) <= 0.3 * len(junk)


def test_op3_leaves_no_value_and_changes_nothing_else(spark, texts):
    planted = re.compile(r"[a-z]+\.\d+@mail\d+\.example\.com|(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\d)|\+\d \(\d{3}\) \d{3}-\d{4}")
    linked = {}
    for r in QUERIES["op3_pii"](spark, FOLDER).collect():
        before, after = texts[r["doc_id"]][0], r["text"]
        old, new = planted.findall(before), planted.findall(after)
        assert len(old) == len(new) and not set(old) & set(new)
        for a, b in zip(old, new, strict=True):
            assert linked.setdefault(a, b) == b
        if r["n_pii"] == 0:
            assert before == after
        else:
            assert re.sub(r"[a-z0-9]", "", before) == re.sub(r"[a-z0-9]", "", after)
    assert len(set(linked.values())) == len(linked) > 5


def test_op4(spark, texts):
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in QUERIES["op4_piece_encoding"](spark, FOLDER).collect():
        text = texts[r["doc_id"]][0]
        assert r["ids"] == library.encode(text) and r["text"] == text and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_op5(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op5_token_output"](spark, FOLDER).collect()}
    start = 0
    for doc_id, (text, _) in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        r = rows[doc_id]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_op6_on_held_out_documents(spark, texts):
    rows = QUERIES["op6_language_id"](spark, FOLDER).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == texts[r["doc_id"]][1] for r in held) >= 0.97 * len(held)


BASE = {
    "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def test_op7(spark, texts):
    kinds = list(BASE)
    for r in QUERIES["op7_secret_scans"](spark, FOLDER).collect():
        spans = []
        for kind, (pattern, group, least) in BASE.items():
            found = [m.span() for m in pattern.finditer(texts[r["doc_id"]][0]) if len(m[group]) >= least]
            assert len(found) == r[f"n_{kind}"]
            spans += [(s, kinds.index(kind), f"{kind}:{s}:{e}") for s, e in found]
        base = [x[2] for x in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


def jaccard_classes(documents):
    """{doc_id: smallest id of its class} by comparing all pairs."""
    sets = {}
    for doc_id, text in documents.items():
        words = WORD.findall(text or "")
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 10 * len(x & y) >= 8 * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return label


def test_pipeline(spark, texts):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {i: t for i, (t, _) in texts.items() if re.search(r"[^\W\d_]", t)}
    classes = jaccard_classes(kept)
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    leaks = duckdb.connect()
    leaks.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    leaks.executemany("INSERT INTO documents VALUES (?, ?)", list(kept.items()))
    leaks.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{FOLDER}/benchmark.parquet'")
    bad = {i for i, c, _ in leaks.execute(ORACLE["op8_decontamination"]).fetchall() if c}
    assert {r["doc_id"] for r in rows} == set(kept) - bad
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows:
        assert r["round_trip"] and r["ids"] == library.encode(r["text"])
        assert re.sub(r"[a-z0-9]", "", r["text"]) == re.sub(r"[a-z0-9]", "", kept[r["doc_id"]])


def test_every_stage_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name


def test_language_model_is_bounded(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.fit(docs, documents=20)
    assert len(model.words[0]) <= 4 * language_id.KNOWN_WORDS and set(model.languages) <= {"en", "de", "fr", "es"}


def test_parameters():
    assert jaccard_join.choose_bands() == (20, 5)
    assert all(len(m) == 6 and m[-1] < decontamination.SPAN for m in decontamination.MASKS)
