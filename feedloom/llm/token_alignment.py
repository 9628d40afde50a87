"""Alignment of two tokenizers' ids over the same texts, by the byte offsets at which tokens of both end.

A is a byte-level tokenizer of the tokenizers library, B a SentencePiece model. Both restart at a single space
between two visible characters, so a text is cut there and pieces are encoded and aligned once, many in one string. Dictionaries lead
from each cumulative end of a token to its place; the sorted common ends slice both id lists into groups, and the link of
a group is taken from its slice: tokens have at least one byte, so the last ones of a slice alone end together.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage, text_batches

BORDER = re.compile(r"(?<=\S) (?=\S)")
CACHED_PIECES = 250_000  # aligned pieces after which a worker begins a new memory beside the last one; changes the time only
STRETCH = 1 << 20  # characters of one text looked at at once
SPACE = "▁"


class Aligned(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    groups: str  # `a1,a2|b1;a3|b2,b3`
    links: bytes  # a * n + b for each link, as 64-bit integers, n being the size of vocabulary B


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ends_of(tokens: Iterable[bytes]) -> dict[int, int]:
    """For each cumulative end the number of tokens up to it. No token is empty, so one token ends at each."""
    return {end: at for at, end in enumerate(accumulate(map(len, tokens)), 1)}


def align_ids(a: list[int], b: list[int], a_bytes: Iterable[bytes], b_bytes: Iterable[bytes]) -> list[tuple[int, int, int]]:
    """(end, tokens of A, tokens of B up to it) of each group of two id lists whose joined bytes are equal."""
    ends_a, ends_b = ends_of(a_bytes), ends_of(b_bytes)
    return [(end, ends_a[end], ends_b[end]) for end in sorted(ends_a.keys() & ends_b.keys())]


class Aligner:
    def __init__(self, tokenizer_file: str, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer_file)
        self.a.encode_special_tokens = True  # their strings in a text are then plain text
        self.b = SentencePieceProcessor(model_file=model_file)
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in token) for token, i in self.a.get_vocab().items()}
        self.n_b = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [
            bytes([int(name[1:-1], 16)]) if self.b.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)
        ]
        if not (all(self.a_bytes.values()) and all(self.b_bytes)):
            raise ValueError("a vocabulary has an empty token")
        # A piece with a space behind a visible character would reach over the border of two words.
        self.cuts = not any(SPACE in name.lstrip(SPACE) for name in names)
        self.known: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def _align(self, pieces: list[str]) -> list[Aligned | None]:
        """Pieces in one string, each after its space: both libraries restart at each of them."""
        text = " ".join(pieces)
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if not b"".join(a_bytes) == whole == b"".join(b_bytes):
            if len(pieces) == 1:
                return [None]
            half = len(pieces) // 2
            return self._align(pieces[:half]) + self._align(pieces[half:])
        found, groups, links = [], [], []
        stops = accumulate(len(p.encode()) + 1 for p in pieces)
        stop, at_a, at_b, first_a, first_b = next(stops), 0, 0, 0, 0
        for end, to_a, to_b in align_ids(a, b, a_bytes, b_bytes):
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            links.append(a[to_a - 1] * self.n_b + b[to_b - 1])
            at_a, at_b = to_a, to_b
            if end == stop:
                written = struct.pack(f"<{len(links)}q", *links)
                found.append(Aligned(at_a - first_a, at_b - first_b, len(groups), ";".join(groups), written))
                stop, first_a, first_b, groups, links = next(stops, None), at_a, at_b, [], []
            elif end > stop:
                raise ValueError("a token crosses the border of two pieces")
        return found

    def learn(self, pieces: set[str]) -> None:
        """Have all of `pieces` in memory, by turns: pieces not met for long are dropped and may be aligned anew."""
        if len(self.known) > CACHED_PIECES:
            self.known, self.older = {}, self.known
        new = pieces.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        rest = [p for p in new.difference(again) if not self.cuts or p and not p[0].isspace() and not p[-1].isspace()]
        rest, odd = [p for p in rest if SPACE not in p], [p for p in rest if SPACE in p]
        self.known.update(dict.fromkeys(odd))  # its tokens stand for spaces instead
        for at in range(0, len(rest), 1_000 if self.cuts else 1):
            part = rest[at : at + 1_000] if self.cuts else [rest[at]]
            self.known.update(zip(part, self._align(part), strict=True))

    def stretches(self, text: str) -> Iterator[str]:
        """The text in stretches cut at borders, so that a very long one is not held piece by piece."""
        at = 0
        while self.cuts and len(text) - at > STRETCH:
            border = BORDER.search(text, at + STRETCH)
            if not border:
                break
            yield text[at : border.start()]
            at = border.end()
        yield text[at:] if at else text

    def _lookup(self, pieces: list[str]) -> list[Aligned | None] | None:
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            return None

    def align(self, text: str) -> tuple[Aligned, np.ndarray, np.ndarray] | None:
        """(counts and groups, distinct links, how often each) of a text; None where the text has no tokens.

        A text is cut at every space first. A piece that is empty or has white space at an end is never learnt; its text
        is then cut between visible characters only, the first and the last piece with the white space they have.
        """
        n_a = n_b = n_groups = 0
        written, codes, times = [], [], []
        for stretch in self.stretches(text):
            found = self._lookup(stretch.split(" ")) if self.cuts else None
            if found is None:
                pieces = BORDER.split(stretch) if self.cuts else [stretch]
                inner = {*pieces[1:-1]} if self.cuts else set()
                self.learn(inner)
                edges = [self._edge(p) for p in ([pieces[0], pieces[-1]] if len(pieces) > 1 else pieces)]
                found = [edges[0], *map(self.known.__getitem__, pieces[1:-1]), *edges[1:]]
            if None in found:
                return None
            a, b, n, groups, links = zip(*found, strict=True)
            n_a, n_b, n_groups = n_a + sum(a), n_b + sum(b), n_groups + sum(n)
            written += groups
            here, often = np.unique(np.frombuffer(b"".join(links), dtype="<i8"), return_counts=True)
            codes.append(here)
            times.append(often)
        if len(codes) > 1:
            all_codes, back = np.unique(np.concatenate(codes), return_inverse=True)
            sums = np.zeros(len(all_codes), dtype=np.int64)
            np.add.at(sums, back, np.concatenate(times))
            codes, times = [all_codes], [sums]
        return Aligned(n_a, n_b, n_groups, ";".join(written), b""), codes[0], times[0]

    def _edge(self, piece: str) -> Aligned | None:
        """The first or last piece of a stretch, which may begin or end with white space."""
        return self.known[piece] if piece in self.known else None if SPACE in piece else self._align([piece])[0]

    def align_all(self, texts: list[str | None]) -> list[tuple[Aligned, np.ndarray, np.ndarray] | None]:
        """The same of many texts; their new pieces are aligned together."""
        if self.cuts:
            self.learn(set(chain.from_iterable(t.split(" ") for t in texts if t and len(t) <= STRETCH)))
        return [self.align(t) if t else None for t in texts]


@cache
def aligner(tokenizer_file: str, model_file: str) -> Aligner:
    """One for each Python worker, which serves many tasks."""
    return Aligner(tokenizer_file, model_file)


ALIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()),
        ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
    ]
)
ALIGNED_DDL = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<bigint>, times array<bigint>"
GROUP = 200  # rows aligned together


def align_texts(docs: DataFrame, tokenizer_file: str, model_file: str) -> DataFrame:
    """Every row of `docs` (doc_id, text) with its groups, and its distinct links with how often each occurs.

    `groups` writes each group as the ids of A, `|`, the ids of B, parted by `;`. `pairs` holds a * n + b for a link of
    ids a and b, n being the size of vocabulary B. A null or empty text, and one whose tokens do not stand for a space
    and the text, has no tokens: zeros, an empty string and empty lists. Rows are read one by one, repeated rows and
    null ids alike; a text of any length is read in stretches; other columns are not read.
    """
    text_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(tokenizer_file, model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                found = tool.align_all(part.column("text").to_pylist())
                counts = [x[0] if x else Aligned(0, 0, 0, "", b"") for x in found]
                pairs, times = ([x[k] if x else np.empty(0, np.int64) for x in found] for k in (1, 2))
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                columns = [
                    part.column("doc_id"), *(pa.array([getattr(c, f) for c in counts], ALIGNED.field(f).type) for f in ALIGNED.names[1:5]),
                    *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, ALIGNED, strict=True)], schema=ALIGNED)

    return docs.select("doc_id", "text").mapInArrow(read, ALIGNED_DDL)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the whole corpus hold each pair of ids."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    return links.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("n"))


def most_pairs(tokenizer_file: str, model_file: str) -> int:
    """How many pairs of ids can be linked at most, whatever the corpus.

    Of two tokens that end together the bytes of one end with the bytes of the other, so every pair is a token of one
    vocabulary and a tail of it in the other.
    """
    tool = aligner(tokenizer_file, model_file)
    total = 0
    for longer, other in ((tool.a_bytes.values(), tool.b_bytes), (tool.b_bytes, tool.a_bytes.values())):
        tails: dict[bytes, int] = {}
        for token in other:
            tails[token] = tails.get(token, 0) + 1
        total += sum(tails.get(token[at:], 0) for token in longer for at in range(len(token) + 1))
    return total


def score_links(aligned: DataFrame, counts: DataFrame, tokenizer_file: str, model_file: str) -> DataFrame:
    """`aligned` with n_links, n_best and count_sum.

    n_best: links whose pair is as frequent as any of its B id in the corpus; count_sum: the sum of the counts of all links.
    The table of counts goes to every task; its size is bounded by the vocabularies (`most_pairs`), not by the corpus.
    """
    table = counts.toArrow()
    if table.num_rows > most_pairs(tokenizer_file, model_file):
        raise ValueError("more pairs than the vocabularies allow")
    n_b = aligner(tokenizer_file, model_file).n_b
    pair, n = (table.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    highest = np.zeros(n_b, dtype=np.int64)
    np.maximum.at(highest, pair % n_b, n)
    best = n == highest[pair % n_b]
    kept = [c for c in aligned.columns if c not in ("pairs", "times", "n_links", "n_best", "count_sum")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            times = batch.column("times").flatten().to_numpy()
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            sums = []
            for values in (times, times * best[at], times * n[at]):
                out = np.zeros(batch.num_rows, dtype=np.int64)
                np.add.at(out, owner, values)
                sums.append(pa.array(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], names=[*kept, "n_links", "n_best", "count_sum"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*kept).schema)
    return aligned.select(*kept, "pairs", "times").mapInArrow(score, f"{fields}, n_links long, n_best long, count_sum long")


def alignment_digest(docs: DataFrame, tokenizer_file: str, model_file: str) -> DataFrame:
    """One row for each row of `docs`: sizes of its alignment, the hash of its groups, and its links against the corpus."""
    aligned = align_texts(docs, tokenizer_file, model_file)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    stored = stage(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    scored = score_links(stored, pair_counts(stored), tokenizer_file, model_file)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
