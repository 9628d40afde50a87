"""Document fingerprints: every hash of a word 5-gram below a fixed fraction of all hashes.

Two fingerprints hold the same hashes of what two texts share, whatever their lengths, so the shares of a short text in a
very long one can be estimated, and the fingerprint of several texts together is the union of theirs. So that short
texts do not come out empty, the least hashes of a text are kept in any case, up to a fixed number; a fingerprint states
the bound up to which it is complete, and two of them are compared below the lower bound of both.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stage, text_batches
from feedloom.llm.substring_dedup import split_words, window_hashes, word_hashes

SHINGLE = 5
FRACTION = 8  # one hash in so many is kept
LEAST = 16  # hashes kept of any text, if it has as many
BASE = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1
HEAD = 8  # bytes of a fingerprint before its hashes: the bound


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the word 5-grams of a text, spread evenly; of all its words together if they are fewer."""
    words = split_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    found = window_hashes(word_hashes(words), min(SHINGLE, len(words)), BASE)
    found ^= found >> np.uint64(33)  # the window hash is a sum, whose low bits say little about its high ones
    found *= np.uint64(0xFF51AFD7ED558CCD)
    found ^= found >> np.uint64(29)
    return np.unique(found)


def sketch(hashes: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> bytes:
    """Bound and kept hashes as little-endian 64-bit integers; all of at most `least` hashes, and then no bound."""
    if len(hashes) <= least:
        bound, kept = FULL, hashes
    else:
        bound = max(FULL // fraction, int(hashes[least - 1]))
        kept = hashes[: np.searchsorted(hashes, np.uint64(bound), side="right")]
    return np.array([bound], dtype="<u8").tobytes() + kept.astype("<u8").tobytes()


def unpack(found: bytes) -> tuple[int, np.ndarray]:
    numbers = np.frombuffer(found, dtype="<u8")
    return int(numbers[0]), numbers[1:]


def merge(found: Iterable[bytes]) -> bytes:
    """The fingerprint of several texts together: what theirs hold up to the lowest bound of all."""
    bounds, hashes = zip(*map(unpack, found), strict=True)
    bound = min(bounds)
    union = np.unique(np.concatenate(hashes))
    return np.array([bound], dtype="<u8").tobytes() + union[: np.searchsorted(union, np.uint64(bound), side="right")].tobytes()


def compare(one: bytes, two: bytes) -> tuple[float, float, float]:
    """(share of one in two, share of two in one, Jaccard similarity), each estimated below the bound both have.

    Equal fingerprints give 1 throughout, an empty one against another 0.
    """
    if one == two:
        return 1.0, 1.0, 1.0
    (bound_a, a), (bound_b, b) = unpack(one), unpack(two)
    bound = np.uint64(min(bound_a, bound_b))
    a, b = (x[: np.searchsorted(x, bound, side="right")] for x in (a, b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a), 1), both / max(len(b), 1), both / max(len(a) + len(b) - both, 1)


def likeness(one: bytes, two: bytes) -> float:
    """How much of the smaller text is in the larger one, 0 to 1."""
    return max(compare(one, two)[:2])


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following text, or all of them."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_texts(docs: DataFrame, fraction: int = FRACTION, least: int = LEAST) -> DataFrame:
    """(doc_id, fingerprint binary) of every row; a null, empty or blank text has a bound and no hashes."""
    text_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(shingles(t.as_py()), fraction, least) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, fingerprint binary")


SCORES = ("near_edited", "near_next", "jaccard_edited", "jaccard_next")
ROW = pa.schema(
    [
        ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
        *((s, pa.float64()) for s in SCORES), ("text", pa.string()),
    ]
)
ROW_DDL = (
    "part int, first boolean, last boolean, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double, jaccard_edited double, jaccard_next double, text string"
)
BATCH = 500


def _judge(text: str, own: bytes, following: str, other: bytes, fraction: int, least: int) -> tuple:
    """(edited_sha256, edited_fingerprint, scores) of a text and the one that follows it."""
    changed = edited(text, following)
    new = sketch(shingles(changed), fraction, least)
    near = [compare(own, x) for x in (new, other)]
    return (hashlib.sha256(changed.encode()).hexdigest(), new, *(max(c[:2]) for c in near), *(c[2] for c in near))


def compare_edits(docs: DataFrame, fraction: int = FRACTION, least: int = LEAST) -> DataFrame:
    """Every row of `docs` (doc_id, text) with its fingerprint, that of its edited text, and their likeness.

    The document that follows is the next one by ascending doc_id (a null id first; equal ids by hash of the
    text), the first one after the last. Rows are dealt by ranges of that order and read as a stream; each task keeps one
    row until the next arrives. What the last row of a task needs from the next task comes in a second, small pass over
    the first and the last row of every task. A null text counts as an empty one; a single row follows itself; repeated
    rows follow each other; other columns are not read; no documents give no rows.
    """
    text_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held, first = TaskContext.get().partitionId(), [], None, True
        unpress = zstandard.ZstdDecompressor()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)

        def row(item: tuple, *judged, last: bool = False) -> tuple:
            doc_id, text, own, is_first = item
            judged = judged or (None,) * 6
            return (part, is_first, last, doc_id, len(text), judged[0], own, *judged[1:], text if is_first or last else None)

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("_packed"), strict=True):
                text = unpress.decompress(raw.as_py()).decode()
                item = (doc_id, text, sketch(shingles(text), fraction, least), first)
                if held:
                    rows.append(row(held, *_judge(held[1], held[2], text, item[2], fraction, least)))
                held, first = item, False
                if len(rows) >= BATCH:
                    yield flush()
                    rows = []
        if held:
            rows.append(row(held, last=True))
        if rows:
            yield flush()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [press.compress((t.as_py() or "").encode()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("_hash"), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_hash", "_packed"])

    named = docs.select("doc_id", F.xxhash64("text").alias("_hash"), "text")
    packed = named.mapInArrow(squeeze, "doc_id long, _hash long, _packed binary")  # texts travel compressed
    dealt = packed.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "_packed")
    stored = stage(dealt.mapInArrow(read, ROW_DDL), "fingerprints")

    # One row of two numbers for each task that had rows: which task's first row follows its last one.
    order = Window.orderBy("part")
    tasks = stored.filter("first").select("part", F.lead("part").over(order).alias("_lead"), F.first("part").over(order).alias("_zero"))
    follows = stage(tasks.select(F.col("part").alias("_of"), F.coalesce("_lead", "_zero").alias("_from")), "follows")
    heads = stored.filter("first").select(
        F.col("part").alias("_from"), F.col("text").alias("_text"), F.col("fingerprint").alias("_print")
    )
    open_rows = stored.filter("last").join(follows, F.col("part") == F.col("_of")).join(heads, "_from")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                judged = _judge(r["text"], r["fingerprint"], r["_text"], r["_print"], fraction, least)
                values = [r["doc_id"], r["n_chars"], judged[0], r["fingerprint"], *judged[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([v], ROW.field(c).type) for v, c in zip(values, names, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *SCORES]
    done = stored.filter("not last").select(*names)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in done.schema)
    last = open_rows.select("doc_id", "n_chars", "fingerprint", "text", "_text", "_print").mapInArrow(finish, ddl)
    return done.unionByName(last)


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """`compare_edits` with the fingerprints as base64 strings."""
    found = compare_edits(docs)
    return found.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})


def decode(written: str) -> bytes:
    """The fingerprint that a string of `fingerprint_digest` stands for."""
    return base64.b64decode(written)
