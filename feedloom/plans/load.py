"""Validate feeds and load them into the catalog store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.apply import (
    batch_ledger,
    block_offsets,
    changes_json,
    field_changes,
    hot_keys,
    merged_catalog,
    replay,
    resume_rows,
    with_batch_size,
)
from feedloom.operators.diff import dry_run, dry_run_counts, last_wins
from feedloom.operators.mapping import map_columns
from feedloom.functions.csvtext import is_blank_record
from feedloom.operators.groups import spread_join
from feedloom.operators.validate import (
    data_row_numbers,
    has_mapping,
    import_outcomes,
    row_cap,
    row_report,
    valid_rows,
    validate_rows,
    validation_totals,
    within_cap,
)
from feedloom.rules import BATCH_SIZE, Rules
from feedloom.session import stage
from feedloom.sources import store
from feedloom.sources.files import changed_files, file_integrity


JUDGED = ("import_id", "row_number", "sku", "findings", "valid", "has_replacement")  # what report and totals are made of
DRY_RUN = ("catalog_id", "row_hash")  # and what a dry run takes besides


@dataclass(frozen=True)
class Validation:
    validated: DataFrame
    report: DataFrame
    totals: DataFrame
    counts: DataFrame | None
    outcomes: DataFrame


def header_rows(records: DataFrame) -> DataFrame:
    """(import_id, header_row): the first record of each feed that is not blank is its header."""
    filled = records.filter(~is_blank_record(F.col("cells")))
    return filled.groupBy("import_id").agg(F.min("row_number").alias("header_row"))


def data_records(records: DataFrame) -> DataFrame:
    """The records behind the header; detection and preview name the same header."""
    named = spread_join(records, stage(header_rows(records), "headers"), "import_id", F.col("row_number"))
    return named.filter("row_number > header_row").drop("header_row")


def validate_feeds(
    records: DataFrame, imports: DataFrame, products: DataFrame | None, rules: Rules, cap: int | None = None, load: bool = True
) -> Validation:
    """Parse every record once into a staged table; report, totals, dry run and outcomes read it from there.

    `records` are read once for the headers, once for a cap and once to be parsed: pass stored ones, or read ones.
    Every import gets an outcome, also one that has no mapping or more rows than a given cap. Where `imports` has a
    `file_sha256`, an import whose file is gone or no longer has that hash fails, and none of its rows goes on. Without
    `products` there is no dry run, and its numbers are null. Where nothing is to be loaded (`load`), values and hashes of the rows,
    which only a load or dry run takes, are neither worked out nor stored.
    """
    data = data_records(records)
    broken = None
    if "file_sha256" in imports.columns:
        broken = stage(changed_files(imports), "broken")
        data = spread_join(data, broken.select("import_id").distinct(), "import_id", F.col("row_number"), "left_anti")
    capped = stage(row_cap(data, rules, cap), "capped") if cap is not None else None
    kept = data_row_numbers(within_cap(data, rules, cap, capped), rules)
    rows = validate_rows(map_columns(kept, has_mapping(imports)), rules)
    validated = stage(rows if load else rows.select(*JUDGED, *(DRY_RUN if products is not None else ())), "validated")
    counts = None if products is None else dry_run_counts(dry_run(last_wins(valid_rows(validated)), products))
    totals = validation_totals(validated)
    outcomes = import_outcomes(imports, totals, counts, capped, broken)
    return Validation(validated, row_report(validated, rules), totals, counts, outcomes)


def intact(validated: DataFrame, recorded: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Rows of the imports whose file is still there with the recorded hash, by a listing or by a look at the files."""
    found = changed_files(recorded) if listing is None else file_integrity(recorded, listing)
    broken = stage(found.select("import_id").distinct(), "broken")
    return spread_join(validated, broken, "import_id", F.col("row_number"), "left_anti")


def load_feeds(
    spark: SparkSession,
    root: str,
    validated: DataFrame,
    rules: Rules,
    batch_size: int = BATCH_SIZE,
    applied_at: Column | None = None,
    imports: DataFrame | None = None,
    recorded: DataFrame | None = None,
    bucket_rows: int = store.BUCKET_ROWS,
) -> int:
    """Apply the valid rows of `validated` that no batch of the ledger covers, and publish the result.

    Batches are told by the rows they cover, so a load may go on with another size: `imports` (import_id,
    batch_size) gives each import its own, else `batch_size` holds for all. Loading the same rows again
    publishes nothing new; a load that was cut off before its commit is repeated from the start. Only the buckets
    of products that the rows touch are read and written. With `recorded` (import_id, path, file_sha256), imports whose
    file has changed since are left out. Returns the newest version.
    """
    last = store.last_version(spark, root)
    valid = valid_rows(validated if recorded is None else intact(validated, recorded))
    sized = valid if imports is None else with_batch_size(valid, imports, batch_size)
    size = batch_size if imports is None else F.col("batch_size")
    todo = stage(resume_rows(sized, store.read_ledger(spark, root), size).drop("batch_size"), "open-rows")
    incoming = todo.groupBy("catalog_id").agg(F.approx_count_distinct("sku").alias("n")).collect()  # a row per catalog
    if not incoming:
        return last
    laid_out = store.layout(spark, root, {r.catalog_id: r.n for r in incoming}, bucket_rows)
    touched = _touched(spark, root, todo, laid_out)
    hot = hot_keys(todo)
    actions = stage(replay(todo, touched, hot, None if hot is None else block_offsets(todo)), "actions")
    when = applied_at if applied_at is not None else F.current_timestamp()
    store.publish(
        root,
        last + 1,
        merged_catalog(actions, touched, when),
        changes_json(field_changes(actions, touched)),
        batch_ledger(actions),
        laid_out,
    )
    return last + 1


def _touched(spark: SparkSession, root: str, todo: DataFrame, laid_out: dict[int, store.Layout]) -> DataFrame:
    """Stored products of the buckets that get rows, and all of a catalog that is laid out anew."""
    anew = [c for c, at in laid_out.items() if at.anew]
    rest = {c: at for c, at in laid_out.items() if not at.anew}
    whole = store.read_products(spark, root, anew)
    if not rest:
        return whole
    hit = stage(store.with_bucket(todo, rest).select("catalog_id", "bucket").distinct(), "touched")
    return whole.unionByName(store.read_products(spark, root, list(rest), hit))
