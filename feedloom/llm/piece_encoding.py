"""SentencePiece encoding and decoding of texts of any length, by a max-plus scan over chunks.

A model of the BPE kind merges pieces; the sequence it ends with is the only one in which any two neighbours, taken
alone, stay as they are. Encoding is therefore a best path through the lattice of pieces, where a step between two
neighbours weighs 0 if they stay and minus infinity if they would merge otherwise.

A giant text is cut into chunks anywhere. The state at a border is the piece that covers or ends at it. Each chunk
yields a matrix of weights from the states at its left border to those at its right one; matrices are combined
associatively in the max-plus sense, first within blocks of chunks and then over the blocks of a text; and with its
two border states settled, every chunk is traced back on its own. Between words the state is trivial, as no piece of
the model spans the start of a word: there, equal words are encoded once, and only words that a border cuts need the
lattice. The result is the same sequence of ids that the sentencepiece library gives for the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage, text_batches

CHUNK = 1 << 14  # characters of a chunk; a text of fewer than two chunks is not cut
BLOCK = 64  # chunks whose matrices are combined by one task
CACHED_WORDS = 250_000  # encoded words kept per Python worker
GROUP = 300  # rows encoded together

SPACE = "▁"  # how the model writes a space
RUN = re.compile(f"{SPACE}+[^{SPACE}]+|{SPACE}+$")
NEVER = -np.inf


class Pieces:
    """The vocabulary of a sentencepiece BPE model, and the rules of its merges."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        self.ids, self.scores, self.bytes = {}, {}, {}
        self.spelled = [b""] * size  # what each id stands for
        for at in range(size):
            piece = self.library.id_to_piece(at)
            if self.library.is_byte(at):
                self.bytes[int(piece[3:5], 16)] = at
                self.spelled[at] = bytes([int(piece[3:5], 16)])
            elif not (self.library.is_control(at) or self.library.is_unknown(at) or self.library.is_unused(at)):
                self.ids[piece], self.scores[piece] = at, self.library.get_score(at)
                self.spelled[at] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces across the start of a word")
        self.words: dict[str, bytes] = {}
        self.stays = lru_cache(maxsize=200_000)(self._stays)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string: the best-scored pair of neighbours is merged first, the left one of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stays(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def ids_of(self, piece: str) -> list[int]:
        """One id, or those of the bytes of a character that the model does not know."""
        at = self.ids.get(piece)
        return [at] if at is not None else [self.bytes[b] for b in piece.encode()]

    # Whole words, by the library

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        if new:
            found = self.library.encode(new, num_threads=1)
            self.words.update((w, np.array(ids, dtype="<i4").tobytes()) for w, ids in zip(new, found, strict=True))

    def _split(self, run: str) -> list[str]:
        """Words as the library takes them: without the first of their spaces, which it adds."""
        words = run[1:].split(SPACE)
        if "" in words:
            words = [w[1:].replace(SPACE, " ") for w in RUN.findall(run)]
        return words

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of stretches of text that start with a space and end before the next word or at the end."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        lone = np.array([self.ids[SPACE]], dtype="<i4").tobytes()
        split = [self._split(run) if run else [] for run in runs]
        self._learn({w for words in split for w in words})
        self.words[""] = lone  # a single space at the end of a text
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """The text of a sequence of ids; control ids say nothing, and bytes that are no text become U+FFFD.

        The chunks of a text can be decoded apart, as a character is spelled in one chunk; `first` is the one that
        starts with the space the model adds.
        """
        raw = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode(errors="replace")
        return raw[1:] if first and raw.startswith(" ") else raw

    # Parts of words, by the lattice

    def lattice(self, text: str, begin: dict[tuple[int | None, int], int], stop: int) -> dict[int, dict[int | None, int]]:
        """Pieces reached from those in `begin`: end -> start -> bits of the begins that reach it.

        A start of None is free: what follows is not bound to it. Pieces start before `stop` and may end after it.
        """
        ends: dict[int, dict[int | None, int]] = {}
        for (start, end), bits in begin.items():
            ends.setdefault(end, {})[start] = ends.get(end, {}).get(start, 0) | bits
        for at in range(min(ends), stop):
            for size in range(1, min(self.longest, len(text) - at) + 1) if at in ends else ():
                piece = text[at : at + size]
                if size > 1 and piece not in self.ids:
                    continue
                bits = 0
                for start, b in ends[at].items():
                    if start is None or self.stays(text[start:at], piece):
                        bits |= b
                if bits:
                    ends.setdefault(at + size, {})[at] = bits
        return ends

    def trace(self, text: str, ends: dict[int, dict[int | None, int]], begin: tuple[int | None, int], last: tuple[int, int]) -> list[int]:
        """Ids of the pieces behind `begin` up to and including `last`."""
        found = []
        at: tuple[int | None, int] = last
        while at != begin:
            start, end = at
            found.append(text[start:end])
            at = next(
                (s, start) for s in ends[start] if s is None or self.stays(text[s:start], text[start:end])
            )
        return [i for piece in reversed(found) for i in self.ids_of(piece)]


@cache
def pieces(model_file: str) -> Pieces:
    """One for each Python worker, which serves many tasks."""
    return Pieces(model_file)


def written(text: str | None) -> str:
    """A text as the model reads it: spaces as marks, and one before the first word; nothing for no text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Chunk:
    """A chunk with as many characters of its neighbours as the longest piece has; empty at the ends of a text."""

    def __init__(self, model: Pieces, left: str, body: str, right: str):
        self.model, self.text = model, left + body + right
        self.low, self.high = len(left), len(left) + len(body)
        self.first, self.last = self._word_starts()

    def _free(self, at: int) -> bool:
        """Whether nothing spans this place: an end of the text, or the start of a word."""
        t = self.text
        return at in (0, len(t)) or (t[at] == SPACE and t[at - 1] != SPACE)

    def _word_starts(self) -> tuple[int | None, int | None]:
        """The first and last free place of the chunk, its borders included."""
        first = self.low
        while first <= self.high and not self._free(first):
            first += 1
        if first > self.high:
            return None, None
        last = self.high
        while not self._free(last):
            last -= 1
        return first, last

    def states(self, at: int) -> list[tuple[int | None, int]]:
        """Pieces that may cover or end at a border, in an order that both of its chunks see."""
        if self._free(at):
            return [(None, at)]
        t, longest = self.text, self.model.longest
        return [
            (start, end)
            for start in range(max(0, at - longest), at)
            for end in range(at, min(len(t), start + longest) + 1)
            if end - start == 1 or t[start:end] in self.model.ids
        ]

    def _reach(self, begin: list[tuple[int | None, int]], stop: int, goals: list[tuple[int | None, int]]) -> np.ndarray:
        ends = self.model.lattice(self.text, {b: 1 << i for i, b in enumerate(begin)}, stop)
        out = np.full((len(begin), len(goals)), NEVER, dtype=np.float32)
        for j, (start, end) in enumerate(goals):
            found = ends.get(end, {})
            bits = found.get(start, 0)
            if start is None:  # whatever ends here
                for b in found.values():
                    bits |= b
            for i in range(len(begin)):
                if bits >> i & 1:
                    out[i, j] = 0.0
        return out

    def matrix(self) -> np.ndarray:
        """Weights from the states at the left border to those at the right one."""
        into, out = self.states(self.low), self.states(self.high)
        if self.first is None:
            return self._reach(into, self.high, out)
        return plus(
            self._reach(into, self.first, [(None, self.first)]), self._reach([(None, self.last)], self.high, out)
        )

    def _path(self, begin: tuple[int | None, int], stop: int, goal: tuple[int | None, int]) -> list[int]:
        if begin == goal:
            return []
        ends = self.model.lattice(self.text, {begin: 1}, stop)
        if goal[0] is None:
            goal = next((s, goal[1]) for s in ends[goal[1]] if s is not None)
        return self.model.trace(self.text, ends, begin, goal)

    def encode(self, into: int, out: int) -> bytes:
        """Ids of the pieces that start in this chunk, given its states (by number) at both borders."""
        begin, goal = self.states(self.low)[into], self.states(self.high)[out]
        if self.first is None:
            return np.array(self._path(begin, self.high, goal), dtype="<i4").tobytes()
        head = [] if self.first == self.low else self._path(begin, self.first, (None, self.first))
        tail = [] if self.last == self.high else self._path((None, self.last), self.high, goal)
        middle = self.model.encode_runs([self.text[self.first : self.last]])[0]
        return np.array(head, dtype="<i4").tobytes() + middle + np.array(tail, dtype="<i4").tobytes()


def cut(text: str, chunk: int, halo: int) -> list[tuple[str, str, str]]:
    """(left, body, right) of the chunks of a written text; the last one takes what remains."""
    n = max(1, len(text) // chunk)
    borders = [i * chunk for i in range(n)] + [len(text)]
    return [
        (text[max(0, low - halo) : low], text[low:high], text[high : high + halo])
        for low, high in zip(borders, borders[1:], strict=False)
    ]


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def settle(matrices: list[np.ndarray], into: int, out: int) -> list[int]:
    """The states at all borders of a row of chunks, `into` and `out` at the ends included: forward, then back."""
    ahead = [np.where(np.arange(matrices[0].shape[0]) == into, 0.0, NEVER)]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    found = [out]
    for m, weights in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        here = weights + m[:, found[-1]]
        if here.max() == NEVER:
            raise ValueError("no path through the chunks")
        found.append(int(here.argmax()))
    return found[::-1]


def _packed(m: np.ndarray) -> bytes:
    return np.array(m.shape, dtype="<i4").tobytes() + m.astype("<f4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f4", offset=8).reshape(tuple(np.frombuffer(raw, dtype="<i4", count=2)))


def _product(rows: pd.DataFrame) -> pd.DataFrame:
    """The matrix of a block: those of its chunks combined in pairs."""
    rows = rows.sort_values("chunk")
    found = [_unpacked(m) for m in rows["matrix"]]
    while len(found) > 1:
        found = [plus(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return pd.DataFrame({"row": rows["row"].iloc[:1], "block": rows["block"].iloc[:1], "matrix": [_packed(found[0])]})


def _settle_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("block")
    states = settle([_unpacked(m) for m in rows["matrix"]], 0, 0)
    return pd.DataFrame({"row": rows["row"], "block": rows["block"], "into": states[:-1], "out": states[1:]})


def _settle_chunks(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("chunk")
    states = settle([_unpacked(m) for m in rows["matrix"]], int(rows["into"].iloc[0]), int(rows["out"].iloc[0]))
    return pd.DataFrame({"row": rows["row"], "chunk": rows["chunk"], "into": states[:-1], "out": states[1:]})


def _ids_array(raw: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))


def _decoded(model: Pieces, found: list[bytes], first: list[bool]) -> pa.Array:
    texts = [model.decode(np.frombuffer(raw, dtype="<i4"), one) for raw, one in zip(found, first, strict=True)]
    return pa.array(texts, pa.string())


def _encode_large(docs: DataFrame, model_file: str, chunk: int) -> DataFrame:
    """(doc_id, source_sha256, ids, text) of texts that are cut."""

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = pieces(model_file).longest
        for batch in batches:
            for at in range(batch.num_rows):
                text = written(batch.column("text")[at].as_py())
                left, body, right = zip(*cut(text, chunk, halo), strict=True)
                n = len(body)
                same = [pa.array([batch.column(c)[at].as_py()] * n, t) for c, t in
                        (("row", pa.int64()), ("doc_id", pa.int64()), ("source_sha256", pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(range(n), pa.int32()), pa.array(left), pa.array(body), pa.array(right)],
                    names=["row", "doc_id", "source_sha256", "chunk", "before", "body", "after"],
                )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for batch in batches:
            parts = zip(*(batch.column(c).to_pylist() for c in ("before", "body", "after")), strict=True)
            found = [_packed(Chunk(model, *p).matrix()) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), pa.array(found, pa.binary())], names=["row", "chunk", "matrix"]
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, 50):
                batch = whole.slice(at, 50)
                parts = zip(*(batch.column(c).to_pylist() for c in ("before", "body", "after", "into", "out")), strict=True)
                found = [Chunk(model, *p[:3]).encode(*p[3:]) for p in parts]
                text = _decoded(model, found, [c == 0 for c in batch.column("chunk").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row", "doc_id", "source_sha256", "chunk")), _ids_array(found), text],
                    names=["row", "doc_id", "source_sha256", "chunk", "ids", "text"],
                )

    numbered = docs.withColumn("row", F.monotonically_increasing_id())  # fixed once the chunks are written
    chunks = numbered.mapInArrow(
        cut_rows, "row long, doc_id long, source_sha256 string, chunk int, before string, body string, after string"
    )
    chunks = stage(chunks.repartition("row", "chunk"), "chunks")
    weights = chunks.select("row", "chunk", "before", "body", "after").mapInArrow(matrices, "row long, chunk int, matrix binary")
    weights = stage(weights.withColumn("block", F.call_function("div", "chunk", F.lit(BLOCK)).cast("int")), "matrices")
    blocks = weights.groupBy("row", "block").applyInPandas(_product, "row long, block int, matrix binary")
    borders = blocks.groupBy("row").applyInPandas(_settle_blocks, "row long, block int, into int, out int")
    settled = weights.join(borders, ["row", "block"]).groupBy("row", "block")
    states = stage(settled.applyInPandas(_settle_chunks, "row long, chunk int, into int, out int"), "states")
    encoded = chunks.join(states, ["row", "chunk"]).mapInArrow(
        encode, "row long, doc_id long, source_sha256 string, chunk int, ids array<int>, text string"
    )
    whole = encoded.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("source_sha256").alias("source_sha256"),
        F.sort_array(F.collect_list(F.struct("chunk", "ids", "text"))).alias("parts"),
    )
    return whole.select(
        "doc_id", "source_sha256", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )


def _encode_small(docs: DataFrame, model_file: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP):
                batch = whole.slice(at, GROUP)
                found = model.encode_runs([written(t) for t in batch.column("text").to_pylist()])
                text = _decoded(model, found, [True] * len(found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("source_sha256"), _ids_array(found), text],
                    names=["doc_id", "source_sha256", "ids", "text"],
                )

    return docs.mapInArrow(encode, "doc_id long, source_sha256 string, ids array<int>, text string")


def encode_texts(docs: DataFrame, model_file: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source_sha256, ids, text) for every row of `docs` (doc_id, text).

    `text` is decoded from the ids, in the same pass so that one Python worker serves a task. ids are those of the sentencepiece library for the whole text; source_sha256 is the hash of the text that decoding
    has to give back. A null or empty text has no id. Rows are encoded one by one: repeated rows alike, a null id is
    kept. Texts of two chunks and more are cut. Other columns are not read; no documents give no rows.
    """
    if chunk < 64:
        raise ValueError("a chunk has to be longer than two pieces")
    text_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    source = F.sha2(F.replace(text, F.lit(SPACE), F.lit(" ")).cast("binary"), 256)
    rows = docs.select("doc_id", "text", source.alias("source_sha256"))
    large = F.length(text) >= 2 * chunk
    small = _encode_small(rows.filter(~large), model_file)
    return small.unionByName(_encode_large(rows.filter(large), model_file, chunk))


def decode_ids(encoded: DataFrame, model_file: str) -> DataFrame:
    """`encoded` with `text` (in place of a column of that name): what its `ids` stand for; nothing for null ids."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(model_file)
        for batch in batches:
            yield pd.Series([model.decode(np.asarray(ids)) if ids is not None and len(ids) else "" for ids in batch])

    spell = F.pandas_udf(decode, "string")
    return encoded.withColumn("text", spell("ids"))


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids, text (decoded), and whether it is the text there was.

    A character U+2581 is a space to the model, and is compared as one.
    """
    encoded = encode_texts(docs, model_file)
    same = F.sha2(F.col("text").cast("binary"), 256) == F.col("source_sha256")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text", same.alias("round_trip"))
