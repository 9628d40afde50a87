"""Quality rules: fixed text measures, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed words and word pairs are estimated: one from trusted documents, one from the raw
corpus. A document's score is its mean log ratio of the two; documents below a fixed threshold go. Only
DataFrame functions run, in one pass over the corpus for the counts and one for the scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import SPACES, let, words

BUCKETS = 1 << 14
TRUSTED_DOCUMENTS = 20_000  # trusted documents the target is estimated from, by smallest hash of the id
SMOOTHING = 0.5
UNIT = 1_000_000  # log ratios are kept as whole millionths, so that sums do not depend on their order
THRESHOLD = -0.05

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
REPEAT_WINDOW = 5
MOST_REPEATED_PERCENT = 20


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column) -> Column:
    """Buckets of all words and all pairs of neighbours of a document."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pairs = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(single, F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))))


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the document, the first time included."""
    n = F.size(hashes)
    starts = F.when(n >= REPEAT_WINDOW, F.sequence(F.lit(0), n - REPEAT_WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(REPEAT_WINDOW)]))

    def places(v: Column) -> Column:
        ordered = F.sort_array(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            def again(e: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(
                    F.get(s, k + 1)["h"] == e["h"], F.lit(False)
                )

            return F.sort_array(F.transform(F.filter(s, again), lambda e: e["p"]))

        return let(ordered, twice)

    def covered(p: Column) -> Column:
        widths = F.transform(p, lambda x, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(REPEAT_WINDOW))))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    return let(
        windows,
        lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(let(places(v), covered)),
    ).cast("long")


def base_measures(text: Column, hashes: Column) -> dict[str, Column]:
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": F.length(F.translate(full, SPACES, "")).cast("long"),
        "n_symbols": (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(hashes),
    }


def log_ratios(docs: DataFrame, trusted: DataFrame, documents: int = TRUSTED_DOCUMENTS) -> list[int]:
    """Log ratio of target and raw probability of each bucket, in millionths; zeros without a trusted document.

    Counts of the raw corpus cover every document. `trusted` (doc_id) is cut to `documents` ids, a bound on what
    is broadcast; what reaches the driver is one row per bucket.
    """
    ids = trusted.filter("doc_id is not null").select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(documents)
    marked = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("_trusted", F.lit(1))), "doc_id", "left")
    hashed = marked.select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), word_hashes(F.col("text")).alias("_hashes"))
    exploded = hashed.select("_trusted", F.explode(ngram_buckets(F.col("_hashes"))).alias("_bucket"))
    rows = exploded.groupBy("_bucket").agg(F.count("*").alias("raw"), F.sum("_trusted").alias("target")).collect()
    raw = sum(r["raw"] for r in rows) + SMOOTHING * BUCKETS
    target = sum(r["target"] for r in rows)
    ratios = [0] * BUCKETS
    if target == 0:
        return ratios
    found = {r["_bucket"]: r for r in rows}
    for bucket in range(BUCKETS):
        row = found.get(bucket)
        in_target, in_raw = (row["target"], row["raw"]) if row else (0, 0)
        ratio = math.log((in_target + SMOOTHING) / (target + SMOOTHING * BUCKETS)) - math.log((in_raw + SMOOTHING) / raw)
        ratios[bucket] = round(ratio * UNIT)
    return ratios


def judge_quality(docs: DataFrame, ratios: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the measures, `base_failed`, `score` and `kept` added (in place of columns of these names).

    A null text has no word, no symbol and no line: it fails, like every text of fewer than ten words. The score of
    a text without words is 0. Rows are judged one by one: repeated rows alike, whole texts of any length, no rows
    for no documents.
    """
    table = F.expr(f"cast(split('{','.join(map(str, ratios))}', ',') as array<int>)")
    kept = [c for c in docs.columns if c not in (*MEASURES, "base_failed", "score", "kept")]
    hashed = docs.select(*kept, word_hashes(F.col("text")).alias("_llm_hashes"))
    hashes = F.col("_llm_hashes")
    total = let(
        ngram_buckets(hashes),
        lambda b: F.when(F.size(b) == 0, F.lit(0.0)).otherwise(
            F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + F.get(table, x)) / F.size(b) / F.lit(UNIT)
        ),
    )
    measured = hashed.select(
        *kept, *[c.alias(name) for name, c in base_measures(F.col("text"), hashes).items()], total.alias("score")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures and verdict of every document; documents labelled as of good quality are the trusted ones."""
    docs = docs.select("doc_id", "text")
    ratios = log_ratios(docs, labels.filter("quality = 1"))
    return judge_quality(docs, ratios).select("doc_id", *MEASURES, "base_failed", "kept", "score")
