"""Language identification by word-first backoff.

A word the model knows is scored by its log frequency in each language. An unseen word falls back to its
character n-grams, longest first: the first length at which any n-gram is known decides. The language with
the largest sum over all words of the whole text wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import text_batches

TRAIN_DOCUMENTS = 20_000  # labelled documents the model is fitted on, by smallest hash of their id
KNOWN_WORDS = 60_000  # words of the sample kept per language, most frequent first
KNOWN_GRAMS = 20_000  # n-grams of the sample kept per language
LONGEST = 5  # n-grams of a word with its borders marked: 5, 4, 3, 2 and 1 characters
UNKNOWN = "und"
CACHED_WORDS = 50_000  # scores of unseen words kept per Python worker

LETTERS = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no decimal digits


def word_counts(text: str) -> Counter:
    """Lower-case runs of letters (Unicode category L) of a text, with how often each occurs."""
    found = Counter(LETTERS.findall(text.lower()))
    for mixed in [w for w in found if not w.isalpha()]:
        n = found.pop(mixed)
        for word in "".join(c if c.isalpha() else " " for c in mixed).split():
            found[word] += n
    return found


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Per-language log frequencies of the known words and n-grams; its size is bounded by the parameters of `fit`."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        """rows: (lang, kind `w` or `g`, key, count)."""
        self.languages = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.languages)}
        self.words, self.grams = self._table(rows, "w", at), self._table(rows, "g", at)
        self._unseen: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def _table(rows, kind, at) -> tuple[dict[str, int], np.ndarray]:
        keys: dict[str, int] = {}
        for _, k, key, _ in rows:
            if k == kind:
                keys.setdefault(key, len(keys))
        counts = np.zeros((len(keys), len(at)))
        for lang, k, key, n in rows:
            if k == kind:
                counts[keys[key], at[lang]] += n
        total = counts.sum(axis=0, keepdims=True) + 0.5 * max(len(keys), 1)
        return keys, np.log((counts + 0.5) / total)

    def __getstate__(self):
        return {**self.__dict__, "_unseen": {}}

    def unseen(self, word: str) -> tuple[float, ...]:
        """Mean log frequency of the longest n-grams of which any is known; zeros if none is."""
        found = self._unseen.get(word)
        if found is None:
            index, table = self.grams
            found = (0.0,) * len(self.languages)
            for n in range(LONGEST, 0, -1):
                known = [at for g in grams(word, n) if (at := index.get(g)) is not None]
                if known:
                    found = tuple((np.add.reduce(table[known]) / len(known)).tolist())
                    break
            if len(self._unseen) >= CACHED_WORDS:
                self._unseen.clear()
            self._unseen[word] = found
        return found

    def forget(self) -> None:
        """Give back what the last task remembered; the worker goes on to other work."""
        self._unseen.clear()

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = word_counts(text) if text else None
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        index, table = self.words
        known, times, backed, often = [], [], [], []
        for word, n in counts.items():
            at = index.get(word)
            if at is None:
                backed.append(self.unseen(word))
                often.append(n)
            else:
                known.append(at)
                times.append(n)
        total = np.zeros(len(self.languages))
        if known:
            total += np.asarray(times, dtype=float) @ table[known]
        if backed:
            total += np.asarray(often, dtype=float) @ np.asarray(backed)
        best = int(total.argmax())  # the first in the order of names among equals
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of each input batch: (lang, kind, key, n)."""
    for batch in batches:
        by_lang: dict[str, tuple[Counter, Counter]] = {}
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            words, pieces = by_lang.setdefault(lang, (Counter(), Counter()))
            words.update(word_counts(text))
        for words, pieces in by_lang.values():
            for word, n in words.items():
                for size in range(1, LONGEST + 1):
                    for gram in grams(word, size):
                        pieces[gram] += n
        rows = [
            (lang, kind, key, n)
            for lang, both in by_lang.items()
            for kind, counter in zip("wg", both, strict=True)
            for key, n in counter.items()
        ]
        yield pd.DataFrame(rows, columns=["lang", "kind", "key", "n"]).astype({"n": "int64"})


def fit(
    labelled: DataFrame, documents: int = TRAIN_DOCUMENTS, known_words: int = KNOWN_WORDS, known_grams: int = KNOWN_GRAMS
) -> Model:
    """A model of at most `documents` rows of `labelled` (doc_id, text, lang); null texts and langs teach nothing.

    Only the ids of the sample and its `known_words` most frequent words and `known_grams` n-grams of each language reach
    the driver. Rarer ones are scored as unseen, whatever the size of the corpus.
    """
    text_batches(labelled.sparkSession)
    labelled = labelled.filter("text is not null and lang is not null and doc_id is not null")
    chosen = labelled.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("_at")).distinct()
    chosen = chosen.orderBy("_at", "doc_id").limit(documents)
    sample = labelled.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("text", "lang")
    counts = sample.mapInPandas(_count_batches, "lang string, kind string, key string, n long")
    counts = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    kept = counts.withColumn("_place", place).filter(
        F.col("_place") <= F.when(F.col("kind") == "w", known_words).otherwise(known_grams)
    )
    found = kept.select("lang", "kind", "key", "n").toArrow()  # columns: rows of Python objects take the driver several times more
    return Model(sorted(zip(*(found[c].to_pylist() for c in found.column_names), strict=True)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score added (in place of columns of these names); only `text` is looked at.

    A null text, one without a letter, and any text under a model without languages get `und` and 0. Rows are
    judged one by one: repeated rows alike, none dropped, whole texts of any length.
    """
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "struct<lang_pred:string,score:double>"

    @F.pandas_udf(schema)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([held.value.predict(t) for t in batch], columns=["lang_pred", "score"])
        held.value.forget()

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*kept, predict("text").alias("_predicted"))
    return out.select(*kept, "_predicted.lang_pred", "_predicted.score")


def held_out() -> Column:
    """Documents kept from the model: crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and predict every document: doc_id, held_out, lang_pred, score."""
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
