"""Join of documents by the Jaccard similarity of their word 5-grams, with MinHash banding.

Band and row counts follow from the recall asked for at the threshold. Documents with the same set of 5-grams are
one node from the start. Buckets of equal band hashes name their smallest node, which joins the nodes that can be
similar into groups; inside a group, pairs are verified on the full sets. Large groups are cut into blocks and each
pair of blocks is a task of its own, which reports one row per node and no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stage, text_batches, unused
from feedloom.llm.components import connected_components
from feedloom.llm.substring_dedup import split_words, window_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9995  # chance that two documents just at the threshold share a bucket
MOST_HASHES = 128
BLOCK_NODES, BLOCK_SHINGLES = 512, 400_000  # what a block of a large group holds at most, on average
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
STEP = 4096  # 5-grams hashed at once


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest chance meetings, that reach `recall` with `most` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the word 5-grams of a text; of all its words together if they are fewer than five."""
    words = split_words(text)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(SHINGLE, len(words)), BASES[0])) if words else hashes


def set_key(found: np.ndarray) -> bytes:
    """128 bits that name a set of 5-grams."""
    mixed = (found ^ (found >> np.uint64(29))) * np.uint64(BASES[1])
    mixed ^= mixed >> np.uint64(32)
    one, two = mixed.sum(dtype=np.uint64), ((mixed * np.uint64(BASES[0])) ^ found).sum(dtype=np.uint64)
    return np.array([one, two + np.uint64(len(found))], dtype="<u8").tobytes()


class Bander:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.offset = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """One hash per band of a set's MinHash signature; a band's number is part of its hash."""
        low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(low), STEP):
            hashed = low[None, at : at + STEP] * self.factor[:, None]
            hashed += self.offset[:, None]
            np.minimum(least, hashed.min(axis=1), out=least)
        mixed = (least.reshape(self.bands, self.rows).astype(np.uint64) + np.uint64(1)) * self.mix
        out = np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(31)), axis=1) * np.uint64(BASES[0])
        return ((out ^ (out >> np.uint64(33))) + np.arange(self.bands, dtype=np.uint64) * np.uint64(BASES[1])).view(np.int64)


def mark(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, node, n_shingles, bands) of every row; node and bands are null for a text without words."""
    bands, rows = choose_bands()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bander = Bander(bands, rows)
        for batch in batches:
            nodes, sizes, hashes = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py())
                nodes.append(set_key(found) if len(found) else None)
                sizes.append(len(found))
                hashes.append(bander(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_text_hash"), pa.array(nodes, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "_text_hash", "node", "n_shingles", "bands"],
            )

    rows_in = docs.select("doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    return rows_in.mapInArrow(read, "doc_id long, _text_hash long, node binary, n_shingles long, bands array<bigint>")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, component) of nodes that share a bucket with another: each bucket ties its nodes to the smallest one."""
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    least = stage(least.select("bucket", "first"), "buckets")  # a plain table: a hot bucket can be split in the join
    ties = buckets.join(least, "bucket").filter("node <> first").select("node", "first").distinct()
    return connected_components(ties, "node", "first")


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets in `one` with those in `two`."""
    keys, columns = np.unique(np.concatenate(one + two), return_inverse=True)
    often = np.bincount(columns, minlength=len(keys)) > 1
    place = np.cumsum(often) - 1
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    ends = np.cumsum([len(s) for s in one + two])
    row = np.repeat(np.arange(len(one) + len(two)), np.diff(np.r_[0, ends]))
    keep = often[columns]
    row, column = row[keep], place[columns[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    for low in range(0, int(often.sum()), width):
        part = slice(*np.searchsorted(column, (low, low + width)))
        dense = np.zeros((len(one) + len(two), width), dtype=np.float32)
        dense[row[part], column[part] - low] = 1
        out += dense[: len(one)] @ dense[len(one) :].T
    return out


def linked(one: list[np.ndarray], two: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which sets of `one` and `two` reach the similarity, decided in whole numbers."""
    both = np.rint(shared_counts(one, two)).astype(np.int64)
    union = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in two])[None, :] - both
    return both * 1_000_000 >= round(similarity * 1_000_000) * union


def first_reached(links: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the smallest node connected with it."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


VERIFIED = "node binary, first binary, links long"


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    """One task: the nodes of a block with each other, or those of one block with those of another."""
    rows = rows.sort_values("node", ignore_index=True)
    sets = [np.frombuffer(s, dtype="<u8") for s in rows["shingles"]]
    low, high = rows["low"].iloc[0], rows["high"].iloc[0]
    n = len(rows)
    links = np.zeros((n, n), dtype=bool)
    if low == high:
        links = linked(sets, sets)
        np.fill_diagonal(links, False)
    else:
        left, right = np.flatnonzero(rows["block"] == low), np.flatnonzero(rows["block"] == high)
        if len(left) and len(right):
            found = linked([sets[i] for i in left], [sets[i] for i in right])
            links[np.ix_(left, right)] = found
            links[np.ix_(right, left)] = found.T
    partners = links @ rows["members"].to_numpy().astype(np.int64)
    first = first_reached(links)
    hit = np.flatnonzero(partners > 0)
    nodes = rows["node"].to_numpy()
    return pd.DataFrame({"node": nodes[hit], "first": nodes[first[hit]], "links": partners[hit]})


def verified_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, first, links) from every task that met a link: the smallest node reached, and linked rows of documents.

    `nodes`: node, members, doc_id and _text_hash of one of its rows, n_shingles. The number of blocks of a group
    follows from its nodes and 5-grams; a node is sent once for each block of its group.
    """
    inside = nodes.join(groups, "node")
    sizes = inside.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    cut = sizes.select(
        "component", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = inside.join(stage(cut, "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = stage(placed.select("node", "members", "doc_id", "_text_hash", "component", "blocks", "block"), "placed")

    # The share of documents with a partner is the same at any size, so the plan is too: texts move once.
    named = placed.withColumnsRenamed({"doc_id": "_doc", "_text_hash": "_hash"}).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    texts = docs.select("doc_id", "text").join(named, same)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).astype("<u8").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "members", "component", "blocks", "block")), pa.array(sets, pa.binary())],
                names=["node", "members", "component", "blocks", "block", "shingles"],
            )

    one_each = texts.select("node", "members", "component", "blocks", "block", "text").mapInArrow(
        shingles, "node binary, members long, component binary, blocks int, block int, shingles binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = one_each.withColumn("_other", other).select(
        "node", "members", "component", "block", "shingles",
        F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
    )
    return sent.groupBy("component", "low", "high").applyInPandas(_verify, VERIFIED)


def join_similar(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, class_id, n_links) for every row of `docs` (doc_id, text).

    n_links: other rows whose 5-gram sets are equal or similar by at least 0.8. class_id: the smallest id among the
    rows that links connect. A text without words (null, empty, blank) has no link and is a class of its own; a text of
    one to four words is one 5-gram. Rows are told apart by id and text: repeated rows count as copies. A null id is
    never the smallest unless its class has no other. Other columns are not read; no documents give no rows.
    """
    text_batches(docs.sparkSession)
    marks = stage(mark(docs), "marks")
    with_words = marks.filter("node is not null")
    pick = F.min(F.struct("doc_id", "_text_hash"))
    nodes = with_words.groupBy("node").agg(
        F.count("*").alias("members"), pick.alias("_row"), F.min("doc_id").alias("least"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
    )
    nodes = stage(nodes.select("node", "members", "least", "_row.doc_id", "_row._text_hash", "n_shingles", "bands"), "nodes")
    groups = stage(candidate_groups(nodes), "groups")
    links = stage(verified_links(docs, nodes, groups), "links")
    classes = connected_components(links, "node", "first")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "members", "least").join(counted, "node", "left").join(classes, "node", "left")
    joined = stage(joined.withColumn("component", F.coalesce("component", "node")), "classes")
    named = stage(joined.groupBy("component").agg(F.min("least").alias("class_id")), "class-ids")
    per_node = joined.join(named, "component").select(
        "node", "class_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = with_words.select("doc_id", "_text_hash", "node").join(per_node, "node")
    wordless = marks.filter("node is null").select(
        "doc_id", "_text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return out.select("doc_id", "_text_hash", "class_id", "n_links").unionByName(wordless)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest id, with all its columns.

    Texts without words are classes of their own; rows repeated with id and text stay once.
    """
    doc, text_hash = unused(docs, "_doc", "_hash")
    found = join_similar(docs).withColumnsRenamed({"doc_id": doc, "_text_hash": text_hash})
    kept = stage(found.filter(F.col(doc).eqNullSafe(F.col("class_id"))).select(doc, text_hash).distinct(), "kept")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(text_hash))
    joined = docs.join(kept, same)
    return joined.dropDuplicates([doc, text_hash]).drop(doc, text_hash)
