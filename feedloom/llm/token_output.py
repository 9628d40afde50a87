"""Token ids as binary files: every document compressed on its own under one shared zstandard dictionary.

A file set holds the dictionary (with its hash) and blocks. A block is a row of Parquet: the payload with one
zstandard frame per document, and its index: document ids, frame offsets and token counts. A reader of a few
short documents fetches the index, then single frames; every block names the dictionary it needs by hash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END_ID = 0
BLOCK_BYTES = 2 << 20  # compressed bytes after which a block is closed
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 2_000, 8 << 20  # bounds of what the dictionary is trained on
CACHED_PIECES = 800_000  # encoded pieces after which a worker begins a new memory beside the last one
GROUP = 500  # rows encoded together
EDGE = 40  # characters of a first word up to which it is kept
LEVEL = 3

PIECE_BORDER = re.compile(r"(?<=\S) (?=\S)")
BLOCK = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()), ("part_start", pa.int64()),
        ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)
BLOCK_DDL = (
    "part int, block int, dictionary string, part_start long, n_tokens long, doc_ids array<bigint>, "
    "offsets array<bigint>, counts array<bigint>, payload binary"
)


class Encoder:
    """A byte-level tokenizer of the tokenizers library with a bounded memory of encoded pieces.

    The pre-tokenizer always cuts before a single space between two visible characters, so the text may be cut
    there and each piece, with its space, encoded for itself; equal pieces are encoded once. New pieces go to the
    library in one string and come back as runs of ids, cut by the bytes that each id stands for. Texts that
    contain an added token as characters go to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()  # a character of a byte-level token stands for one byte
        self.widths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, at in vocabulary.items():
            self.widths[at] = len(token)
        self.pieces: dict[str, bytes] = {}  # pieces that follow a space
        self.older: dict[str, bytes] = {}  # those met before them; what is met again moves over
        self.edges: dict[str, bytes] = {}  # first words and white space at the end of texts

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, pieces: set[str]) -> None:
        """Have all of `pieces` in memory."""
        new = pieces.difference(self.pieces)
        again = new.intersection(self.older)
        self.pieces.update((p, self.older[p]) for p in again)
        rest = [p for p in new.difference(again) if p and not p[-1].isspace()]
        for at in range(0, len(rest), 2_000):
            part = [" " + p for p in rest[at : at + 2_000]]
            raw = self._whole(["".join(part)])[0]
            ends = np.cumsum([len(p.encode()) for p in part])
            places = np.cumsum(self.widths[np.frombuffer(raw, dtype="<u4")])
            cuts = np.searchsorted(places, ends)
            if cuts[-1] >= len(places) or (places[cuts] != ends).any():
                raise ValueError("a token crosses the border of two pieces")
            starts = np.r_[0, cuts[:-1] + 1]
            self.pieces.update(
                (p[1:], raw[4 * low : 4 * high + 4]) for p, low, high in zip(part, starts.tolist(), cuts.tolist(), strict=True)
            )

    def _joined(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without the end id; none for null.

        A text is cut at every space first. Where a piece is empty or ends in white space, white space adjoins the
        next cut, which then is none of the pre-tokenizer's: such pieces are never learnt, and their texts are cut
        between visible characters only.
        """
        out, plain = [b""] * len(texts), []
        for at, text in enumerate(texts):
            if text and any(a in text for a in self.added):
                out[at] = self._whole([text])[0]
            elif text:
                body = text.rstrip()
                head, *rest = body.split(" ")
                plain.append((at, head, rest, body, text[len(body) :]))
        if len(self.pieces) > CACHED_PIECES:
            self.pieces, self.older = {}, self.pieces
        self._learn(set(chain.from_iterable(rest for _, _, rest, _, _ in plain)))
        if len(self.edges) > CACHED_PIECES:
            self.edges = {}
        edges = {head for _, head, _, _, _ in plain if len(head) <= EDGE}.union(tail for *_, tail in plain)
        edges = list(edges.difference(self.edges))
        self.edges.update(zip(edges, self._whole(edges), strict=True))
        for at, head, rest, body, tail in plain:
            try:
                if rest and (not head or head[-1].isspace()):
                    raise KeyError(head)
                out[at] = self._edge(head) + self._joined(rest) + self._edge(tail)
            except KeyError:
                head, *rest = PIECE_BORDER.split(body)
                self._learn(set(rest))
                out[at] = self._edge(head) + self._joined(rest) + self._edge(tail)
        return out

    def _edge(self, text: str) -> bytes:
        found = self.edges.get(text)
        return self._whole([text])[0] if found is None else found


@cache
def encoder(tokenizer_file: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(tokenizer_file)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer_file: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids with the end id) of each row, some hundred rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            found = encoder(tokenizer_file).encode(part.column("text").to_pylist())
            for doc_id, raw in zip(part.column("doc_id").to_pylist(), found, strict=True):
                yield doc_id, raw + END


END = np.array([END_ID], dtype="<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_file: str, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most `size` bytes, trained in one task on a bounded sample of documents.

    At most SAMPLE_DOCUMENTS rows by hash of id and text, a repeated row once, are encoded where they lie; their ids, up
    to SAMPLE_BYTES, go to the training task. Empty where the sample is too small to train on; documents are then
    compressed without one.
    """
    longest = SAMPLE_BYTES // 16
    rows = docs.filter(F.octet_length("text") <= longest // 2).select("doc_id", F.xxhash64("text").alias("_text"), "text")
    keys = rows.select("doc_id", "_text", F.xxhash64(F.col("doc_id").cast("string"), "_text").alias("_at"))
    chosen = keys.distinct().orderBy("_at", "doc_id", "_text").limit(SAMPLE_DOCUMENTS).select("doc_id", "_text")
    same = rows.doc_id.eqNullSafe(chosen.doc_id) & (rows["_text"] == chosen["_text"])
    sample = rows.join(F.broadcast(chosen), same, "left_semi").groupBy("doc_id", "_text").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for doc_id, raw in _encoded(batches, tokenizer_file):
            if held < SAMPLE_BYTES and len(raw) <= longest:
                held += len(raw)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "raw": pa.array([raw], pa.binary())})
            elif held >= SAMPLE_BYTES:
                return

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], 0
        for raw in chain.from_iterable(batch.column("raw").to_pylist() for batch in batches):
            if held >= SAMPLE_BYTES:
                break
            samples.append(raw)
            held += len(raw)
        try:
            found = zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
        except zstandard.ZstdError:
            found = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([found], pa.binary())})

    encoded = sample.select("doc_id", "text").mapInArrow(encode, "doc_id long, raw binary")
    one = encoded.repartition(1).sortWithinPartitions("doc_id", "raw")
    found = one.mapInArrow(learn, "dictionary binary").collect()
    return bytes(found[0]["dictionary"]) if found else b""


def _hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str) -> None:
    """Encode every text, add the end id, and write dictionary and blocks below `folder` in ascending doc_id order.

    Rows are dealt by ranges of (doc_id, hash of the text), so that one id with many rows spreads; equal ids stand
    in the order of hash and text, a null id first. A null or empty text is the end id alone. Other columns are
    not read; no documents give no blocks.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer_file)
    name = _hash(dictionary)
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary string, content binary").coalesce(1).write.parquet(
        f"{folder}/dictionary"
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        part, block, started, total = TaskContext.get().partitionId(), 0, 0, 0
        ids, offsets, counts, frames = [], [0], [], []

        def close() -> pa.RecordBatch:
            row = (part, block, name, started, sum(counts), ids, offsets, counts, b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

        for doc_id, raw in _encoded(batches, tokenizer_file):
            frames.append(press.compress(raw))
            ids.append(doc_id)
            counts.append(len(raw) // 4)
            offsets.append(offsets[-1] + len(frames[-1]))
            if offsets[-1] >= BLOCK_BYTES:
                total += sum(counts)
                yield close()
                block, started = block + 1, total
                ids, offsets, counts, frames = [], [0], [], []
        if ids:
            yield close()

    dealt = docs.repartitionByRange("doc_id", F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(pack, BLOCK_DDL).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _dictionaries(spark: SparkSession, folder: str) -> dict[str, bytes]:
    return {r["dictionary"]: bytes(r["content"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}


def _unpacker(dictionary: bytes, name: str) -> zstandard.ZstdDecompressor:
    if _hash(dictionary) != name:
        raise ValueError(f"dictionary {name} does not match its hash")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


DOC = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
)


def _unpack(blocks: DataFrame, dictionaries: dict[str, bytes], wanted: frozenset[int] | None = None) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: dict[str, zstandard.ZstdDecompressor] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                payload = memoryview(row.column("payload")[0].as_buffer())
                name, part, place, doc_ids, offsets, counts = (
                    row.column(c)[0].as_py() for c in ("dictionary", "part", "part_start", "doc_ids", "offsets", "counts")
                )
                tool = tools.get(name) or tools.setdefault(name, _unpacker(dictionaries[name], name))
                rows, held = [], 0
                for doc_id, low, high, n in zip(doc_ids, offsets, offsets[1:], counts, strict=False):
                    if wanted is None or doc_id in wanted:
                        rows.append((doc_id, part, place, n, tool.decompress(payload[low:high])))
                        held += 4 * n
                    place += n
                    if held > 8 << 20:
                        yield _docs(rows)
                        rows, held = [], 0
                if rows:
                    yield _docs(rows)

    return blocks.mapInArrow(read, "doc_id long, part int, place long, n_tokens long, ids binary")


def _docs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DOC, strict=True)], schema=DOC
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a file set: doc_id, start (ids of all documents before it), n_tokens, ids.

    `ids` are little-endian unsigned 32-bit integers, the end id included. A writing task is a part; the starts of
    parts, one number for each, are summed up from the blocks' index alone.
    """
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{folder}/blocks")
    ends = blocks.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    docs = _unpack(blocks, _dictionaries(spark, folder)).join(F.broadcast(starts), "part")
    return docs.select("doc_id", (F.col("_before") + F.col("place")).alias("start"), "n_tokens", "ids")


def read_some(spark: SparkSession, folder: str, doc_ids: Iterable[int]) -> DataFrame:
    """doc_id, n_tokens and ids of a few documents: blocks are chosen by their index, single frames unpacked."""
    wanted = frozenset(doc_ids)
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{folder}/blocks")
    hit = blocks.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in sorted(wanted)])))
    return _unpack(hit, _dictionaries(spark, folder), wanted).select("doc_id", "n_tokens", "ids")


def token_digest(docs: DataFrame, folder: str, tokenizer_file: str) -> DataFrame:
    """Write the file set, read it back, and describe each document as read."""
    write_tokens(docs, folder, tokenizer_file)
    found = read_tokens(docs.sparkSession, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
