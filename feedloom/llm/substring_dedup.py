"""Substring dedup: words that lie in a window of 50 words which a document with a smaller id has as well.

Anchors are hashed at the places of a difference cover only: whatever the shift between two documents, any
stretch of 50 equal words holds an anchor of 20 words at a place both of them look at. Anchors that two
documents share mark the windows worth looking at; only those are hashed whole (128 bits) and compared.

A key can be in a third of all documents. So every task first settles what its own documents share, and sends
one row per key for the rest; the receiving tasks read their rows sorted, as a stream, and never hold a group.
Texts travel compressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage, text_batches

WINDOW = 50
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])  # every shift modulo 31 is the difference of two of these
ANCHOR = WINDOW - PERIOD + 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have an inverse modulo 2^64
HELD_ROWS = 800_000  # keys a task holds before it settles and sends them


@cache
def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64; n is a power of two, so few lengths are ever built."""
    if n == 1:
        return np.ones(1, dtype=np.uint64)
    half = _powers(base, n // 2)
    return np.concatenate([half, half * np.uint64(pow(base, n // 2, 1 << 64))])


def _at_least(n: int) -> int:
    return 1 << max(n, 1).bit_length()


def split_words(text: str | None) -> list[bytes]:
    """The words of a text: bytes.split() parts at x20 and x09 to x0D, and at nothing else."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """One hash for each run of `width` words, by differences of prefix sums modulo 2^64."""
    n = len(hashes)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    size = _at_least(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(base, size)[:n], out=sums[1:])
    inverse = _powers(pow(base, -1, 1 << 64), size)[: n - width + 1]
    return (sums[width:] - sums[:-width]) * inverse


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a document long enough for a window."""
    if len(hashes) < WINDOW:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    found = window_hashes(hashes, ANCHOR, BASES[0])
    places = (np.arange(0, len(found), PERIOD)[:, None] + COVER).ravel()
    places = places[places < len(found)]
    return places, found[places]


def candidate_windows(places: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at `places` in the first 31 of their places for anchors."""
    starts = n_words - WINDOW + 1
    marks = np.zeros(starts + 1, dtype=np.int32)
    np.add.at(marks, np.clip(places - PERIOD + 1, 0, starts), 1)
    np.add.at(marks, np.clip(places + 1, 0, starts), -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


def removed_words(starts: np.ndarray, n_words: int) -> np.ndarray:
    """Whether each word lies in a window that starts at one of `starts`."""
    marks = np.zeros(n_words + 1, dtype=np.int32)
    starts = np.unique(starts)
    marks[starts] += 1
    np.add.at(marks, starts + WINDOW, -1)
    return np.cumsum(marks[:-1]) > 0


# Rows travel packed: of what a task settles at once, one row for each bucket of keys holds the columns, compressed.
PACKED = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("n", pa.int32()), ("packed", pa.binary())])
PACKED_DDL = "bucket int, settled boolean, n int, packed binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("places", pa.list_(pa.int32()))])
FOUND_DDL = "doc_id long, crc long, places array<int>"
SHARED = -1  # place of a row which says that its key is shared
BUCKETS_PER_TASK = 8  # buckets a receiving task reads one after the other


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all lowest ones first: high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(raw: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(raw[at : at + n * width], dtype=np.uint8).reshape(width, n)
    return np.ascontiguousarray(flat.T).view(kind).reshape(n), at + n * width


def pack(h1, h2, doc, crc, place) -> bytes:
    """Columns of rows sorted by h1; documents are listed once. h1 and h2 are None for settled places."""
    names, which = np.unique(np.stack([doc, crc]), axis=1, return_inverse=True)
    parts = [np.int64(names.shape[1]).tobytes(), _planes(names.ravel()), _planes(which.ravel().astype(np.uint32)),
             _planes(place.astype(np.int32))]
    if h1 is not None:
        parts += [_planes(np.diff(h1, prepend=np.uint64(0))), _planes(h2)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes, n: int, keyed: bool):
    """(h1, h2, doc, crc, place) of `pack`; without the hashes for settled places."""
    raw = memoryview(zstandard.ZstdDecompressor().decompress(raw))
    listed = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    names, at = _from_planes(raw, 8, 2 * listed, "<i8")
    which, at = _from_planes(raw, at, n, "<u4")
    place, at = _from_planes(raw, at, n, "<i4")
    doc, crc = names[:listed][which], names[listed:][which]
    if not keyed:
        return doc, crc, place
    h1, at = _from_planes(raw, at, n, "<u8")
    h2, at = _from_planes(raw, at, n, "<u4")
    return np.cumsum(h1, dtype=np.uint64), h2, doc, crc, place


def _lists(doc: np.ndarray, crc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One list of places per document."""
    order = np.lexsort((crc, doc))
    doc, crc, place = doc[order], crc[order], place[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]) if len(doc) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(doc)].astype(np.int32)), pa.array(place.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(crc[new]), lists], schema=FOUND)


def _rows(buckets, settled: bool, counts, packed) -> pa.RecordBatch:
    columns = (buckets, [settled] * len(buckets), counts, packed)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKED, strict=True)], schema=PACKED)


def _keyed(bits: int, h1, h2, doc, crc, place) -> pa.RecordBatch:
    """One row for each bucket: the leading `bits` of the first hash."""
    order = np.argsort(h1, kind="stable")
    columns = [c[order] for c in (h1, h2, doc, crc, place)]
    bucket = (columns[0] >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)]
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True))
    packed = [pack(*(c[low:high] for c in columns)) for low, high in cuts]
    return _rows(bucket[first].tolist(), False, [high - low for low, high in cuts], packed)


def _settled(bits: int, doc, crc, place) -> pa.RecordBatch:
    """A row for all settled places, in a bucket drawn from the first document."""
    bucket = int(((int(doc[0]) * BASES[0]) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits))
    return _rows([bucket], True, [len(doc)], [pack(None, None, doc, crc, place)])


def _sorted_groups(h1, h2, doc):
    """(order, group of each row, smallest and largest document of each group)."""
    order = np.lexsort((doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    first = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, d[first], d[np.r_[first[1:], len(d)] - 1], first


def settle_anchors(bits: int, h1, h2, doc, crc, place) -> Iterator[pa.RecordBatch]:
    """Anchors that two documents at hand share are settled; others go on, and one row for each shared key."""
    order, group, least, most, first = _sorted_groups(h1, h2, doc)
    shared = least < most
    inside = shared[group]
    place = place.copy()
    marks, alone = order[first[shared]], order[~inside]
    if len(marks):
        told = order[inside]
        yield _settled(bits, doc[told], crc[told], place[told])
        place[marks] = SHARED
    sent = np.concatenate([alone, marks])
    yield _keyed(bits, h1[sent], h2[sent], doc[sent], crc[sent], place[sent])


def settle_windows(bits: int, h1, h2, doc, crc, place) -> Iterator[pa.RecordBatch]:
    """Windows that a smaller document at hand has are settled; those of each key's smallest document go on."""
    order, group, least, _, _ = _sorted_groups(h1, h2, doc)
    late = doc[order] > least[group]
    kept, told = order[~late], order[late]
    yield _keyed(bits, h1[kept], h2[kept], doc[kept], crc[kept], place[kept])
    if len(told):
        yield _settled(bits, doc[told], crc[told], place[told])


def shared_anchors(h1, h2, doc, crc, place) -> np.ndarray:
    """Which rows of a bucket belong to a key that two documents have."""
    order, group, least, most, first = _sorted_groups(h1, h2, doc)
    shared = (least < most) | (np.minimum.reduceat(place[order], first) == SHARED)
    found = np.zeros(len(h1), dtype=bool)
    found[order] = shared[group]
    return found & (place != SHARED)


def late_windows(h1, h2, doc, crc, place) -> np.ndarray:
    """Which rows of a bucket have a key that a smaller document has."""
    order, group, least, _, _ = _sorted_groups(h1, h2, doc)
    found = np.zeros(len(h1), dtype=bool)
    found[order] = doc[order] > least[group]
    return found


class _Held:
    """Rows of several documents, settled together once there are enough."""

    def __init__(self, settle, bits: int):
        self.settle, self.bits, self.parts, self.rows = settle, bits, [], 0

    def add(self, doc_id: int, crc: int, h1, h2, places) -> Iterator[pa.RecordBatch]:
        if len(places):
            n = len(places)
            self.parts.append((h1, h2, np.full(n, doc_id, np.int64), np.full(n, crc, np.int64), places))
            self.rows += n
            if self.rows >= HELD_ROWS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.rows = [], 0
            yield from self.settle(self.bits, *columns)


def _anchor_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = _Held(settle_anchors, bits)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_py()
            places, found = anchors(word_hashes(split_words(raw)))
            yield from held.add(doc_id, zlib.crc32(raw.encode()), found, np.zeros(len(found), dtype=np.uint32), places)
    yield from held.flush()


def _window_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = _Held(settle_windows, bits)
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for doc_id, crc, packed, places in zip(*(batch.column(c) for c in ("doc_id", "crc", "packed", "places")), strict=True):
            hashes = word_hashes(unzip.decompress(packed.as_py()).split())
            starts = candidate_windows(places.values.to_numpy(), len(hashes))
            one, two = (window_hashes(hashes, WINDOW, b)[starts] for b in BASES)
            yield from held.add(doc_id.as_py(), crc.as_py(), one, (two >> np.uint64(32)).astype(np.uint32), starts)
    yield from held.flush()


def _read_buckets(batches: Iterator[pa.RecordBatch], choose) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: each bucket is unpacked, chosen from, and let go before the next one."""

    def close(parts):
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            told = choose(*columns)
            if told.any():
                yield _lists(*(c[told] for c in columns[2:]))

    bucket, parts = None, []
    for batch in batches:
        for at, settled, n, packed in zip(*(batch.column(c).to_pylist() for c in PACKED.names), strict=True):
            if settled:
                yield _lists(*unpack(packed, n, keyed=False))
                continue
            if at != bucket:
                yield from close(parts)
                bucket, parts = at, []
            parts.append(unpack(packed, n, keyed=True))
    yield from close(parts)


def _chosen_places(rows: DataFrame, make, choose) -> DataFrame:
    """(doc_id, crc, places): keys made from documents, one shuffle by bucket, and one list per document."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(31, (tasks * BUCKETS_PER_TASK).bit_length())
    sent = rows.mapInArrow(lambda batches: make(batches, bits), PACKED_DDL)
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(lambda batches: _read_buckets(batches, choose), FOUND_DDL)
    return found.groupBy("doc_id", "crc").agg(F.flatten(F.collect_list("places")).alias("places"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as its words joined by single spaces, compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        rows = [split_words(t) for t in texts]
        joined = [b" ".join(w) for w in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([zlib.crc32((t or "").encode()) for t in texts], pa.int64()),
             pa.array([len(w) for w in rows], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
             pa.array([press.compress(j) for j in joined], pa.binary())], names=["doc_id", "crc", "n_words", "kept_sha256", "packed"],
        )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed and the kept words of documents with settled windows."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        ids, counts, texts = [], [], []
        for packed, places in zip(batch.column("packed"), batch.column("places"), strict=True):
            words = unpack.decompress(packed.as_py()).split()
            gone = removed_words(places.values.to_numpy(), len(words))
            counts.append(int(gone.sum()))
            texts.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(counts, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )


def drop_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeats, clean): documents that lose words, with their kept words, and digests of those that lose none.

    repeats: doc_id, n_words, n_removed, kept_text (kept words joined by one space). clean: doc_id, n_words,
    kept_sha256. Together they hold one row for each row of `docs` (doc_id, text).

    Ids order documents; of rows with equal ids none is smaller, so they take nothing from one another. A null id
    is neither smaller nor larger than any: its row stays whole. A null text has no word. Other columns are not
    read; no documents give no rows.
    """
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    told = docs.filter("doc_id is not null and text is not null")
    shared = _chosen_places(told, _anchor_rows, shared_anchors)
    packed = docs.mapInArrow(_pack, "doc_id long, crc long, n_words long, kept_sha256 string, packed binary")
    work = packed.join(shared, ["doc_id", "crc"], "left")
    keep = F.when(F.col("places").isNotNull(), F.col("packed")).alias("packed")
    work = stage(work.select("doc_id", "crc", "n_words", "kept_sha256", keep, "places"), "repeats")

    marked = work.filter("places is not null")
    candidates = marked.select("doc_id", "crc", "packed", "places")
    settled = stage(_chosen_places(candidates, _window_rows, late_windows), "windows")
    late = marked.drop("places").join(settled, ["doc_id", "crc"])
    repeats = late.select("doc_id", "n_words", "packed", "places").mapInArrow(
        _remove, "doc_id long, n_words long, n_removed long, kept_text string"
    )
    whole = marked.join(settled.select("doc_id", "crc"), ["doc_id", "crc"], "left_anti")
    digest = ["doc_id", "n_words", "kept_sha256"]
    return repeats, work.filter("places is null").select(*digest).unionByName(whole.select(*digest))


def substring_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and a hash of the kept words."""
    repeats, clean = drop_repeats(docs)
    hashed = repeats.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
    return hashed.unionByName(clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))
