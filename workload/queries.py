"""The registered queries: each takes (spark, folder of test tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import csvtext, encoding, hashing, numbers, text, urls
from feedloom.operators import apply as load
from feedloom.operators import detect, diff, mapping, validate, views
from feedloom.operators.groups import BLOCK_ROWS, block_of
from feedloom.plans.load import data_records, intact, load_feeds, validate_feeds
from feedloom.rules import CODED, CONTRACT, FIELDS, OPTIONAL_FIELDS
from feedloom.session import new_folder, stage
from feedloom.sources import feed, files, pages, report, search, store
from feedloom.streaming.jobs import stream_loads, stream_reports
from workload.derive import APPLIED_AT, BATCH, FILES_PER_IMPORT, HEADERS, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


col, lit = F.col, F.lit
CELL_MARK = "\u241f"  # joins cells in outputs that show a whole record


# --- sources ---------------------------------------------------------------------------------


@query
def feed_listing(t):
    _, found = t.feed_files()
    return found.select("import_id", "size", "sha256")


@query
def feed_admission(t):
    size = F.octet_length("text").cast("bigint")
    return t.read("documents").select("doc_id", size.alias("size"), files.admission(size, cap=4000).alias("code"))


@query
def feed_scan(t):
    folder, found = t.feed_files()
    records = feed.read_feed(t.spark, folder, found)
    return records.select(
        col("import_id").alias("file_id"), "row_number", F.size("cells").cast("bigint").alias("n_cells"),
        F.array_join("cells", CELL_MARK).alias("record"),
    )


@query
def feed_scan_encodings(t):
    """Files in four encodings, those read by ranges in many of them."""
    folder, found = t.encoded_files()
    records = feed.read_feed(t.spark, folder, found, range_bytes=1 << 16)
    return records.select(
        col("import_id").alias("file_id"), "row_number", F.size("cells").cast("bigint").alias("n_cells"),
        F.array_join("cells", CELL_MARK).alias("record"),
    )


@query
def feed_admission_files(t):
    """The code of every file of a listing, at a cap that some are over."""
    folder, _ = t.feed_files()
    listed = files.admit(files.listing(t.spark, folder), cap=50_000)
    return listed.select(F.regexp_extract("path", "file_id=([0-9]+)", 1).cast("bigint").alias("import_id"), "size", "code")


@query
def feed_preview_files(t):
    """The first records of every file, of which no more is read."""
    _, found = t.feed_files()
    shown = feed.preview_files(found)
    return shown.select("import_id", "row_number", F.array_join("cells", CELL_MARK).alias("record"))


@query
def decode_lenient(t):
    found = t.documents.withColumn("encoding", encoding.detect_encoding(encoding.sample_of(col("content"))))
    decoded = found.select("doc_id", "encoding", encoding.decode_lenient(col("content"), col("encoding")).alias("x"))
    return decoded.select(
        "doc_id", "encoding", F.length("x").cast("bigint").alias("n_chars"), F.sha2("x", 256).alias("text_sha256")
    )


@query
def blank_filter(t):
    return t.data.select("import_id", "row_number", F.size("cells").cast("bigint").alias("n_cells"))


@query
def feed_preview(t):
    return feed.preview(t.headed).select("import_id", "row_number", F.array_join("cells", CELL_MARK).alias("record"))


@query
def report_csv(t):
    return report.report_lines(validate.row_report(t.staged, CONTRACT), CONTRACT)


@query
def report_csv_coded(t):
    return report.report_lines(validate.row_report(t.coded, CODED), CODED)


@query
def header_rule(t):
    """Every third feed starts with a blank record: what is shown and what is read behind the same header."""
    late = F.when(col("import_id") % 3 == 0, 1).otherwise(0)
    moved = t.headed.withColumn("row_number", col("row_number") + late)
    first = t.imports.filter("import_id % 3 = 0").select(
        "import_id", lit(1).cast("bigint").alias("row_number"), F.array(lit("")).alias("cells")
    )
    records = stage(moved.unionByName(first), "records")
    data = data_records(records).select("import_id", "row_number", lit("data").alias("kind"))
    return data.unionByName(feed.preview(records).select("import_id", "row_number", lit("preview").alias("kind")))


@query
def report_files(t):
    """The report as CSV folders, read back; every import has its header line."""
    out = new_folder(t.spark, "report")
    report.write_report(validate.row_report(t.staged, CONTRACT), CONTRACT, out, t.imports)
    return t.spark.read.text(out).select(col("import_id").cast("bigint").alias("import_id"), col("value").alias("line"))


@query
def report_store(t):
    """Stored findings after a third of the imports was validated again and came out clean."""
    out = new_folder(t.spark, "findings")
    found = validate.row_report(t.staged, CONTRACT)
    report.write_findings(found, out, CONTRACT, t.imports)
    report.write_findings(found.limit(0), out, CONTRACT, t.imports.filter("import_id % 3 = 0"))
    stored = report.read_findings(t.spark, out).withColumn("import_id", col("import_id").cast("bigint"))
    return stored.select(*validate.REPORT_COLUMNS)


@query
def csv_escape(t):
    sign = F.element_at(F.array(*map(lit, ("=", "+", "", "@", "-"))), (col("doc_id") % 5 + 1).cast("int"))
    value = F.concat(sign, "text", F.when(col("doc_id") % 3 == 0, lit('"')).otherwise(lit("")))
    cells = t.read("documents").select("doc_id", value.alias("value"))
    return cells.select(
        "doc_id",
        csvtext.escape_cell(col("value"), CODED).alias("coded"),
        csvtext.escape_cell(col("value"), CONTRACT).alias("contract"),
    )


@query
def json_columns(t):
    stored = F.when(col("event_id") % 10 == 0, F.concat(lit("#"), "props")).otherwise(col("props"))
    rows = t.read("events").select("event_id", stored.alias("stored"))
    parsed = views.parse_json(col("stored"), "map<string,bigint>", F.create_map(lit("k"), lit(-1).cast("bigint")))
    return rows.select("event_id", parsed.alias("m")).select(
        "event_id", F.try_element_at("m", lit("k")).alias("k"), F.to_json("m").alias("written")
    )


# --- detection -------------------------------------------------------------------------------


@query
def detect_encoding(t):
    sample = encoding.sample_of(col("content"))
    return t.documents.select("doc_id", encoding.detect_encoding(sample).alias("encoding"))


@query
def detect_encoding_cut(t):
    sample = encoding.sample_of(col("content"), 1000)
    cut = t.documents.select("doc_id", sample.alias("s")).withColumn("encoding", encoding.detect_encoding(col("s")))
    kept = F.octet_length(encoding.trim_partial_utf8(col("s"))).cast("bigint")
    return cut.select("doc_id", "encoding", F.when(col("encoding") == "utf-8", kept).alias("kept_bytes"))


def _counted(t):
    """At most fifty counts per file and delimiter, written once: exploding them straight away would
    have the samples cut again for every output column."""
    return stage(detect.candidate_counts(detect.sampled(t.documents)).select("doc_id", "candidates"), "counts")


@query
def delimiter_histogram(t):
    found = detect.delimiter_histogram(_counted(t), "doc_id")
    return found.select(
        "doc_id", "delimiter", col("n_columns").cast("bigint").alias("n_columns"),
        col("n_records").cast("bigint").alias("n_records"),
    )


@query
def delimiter_score(t):
    scored = detect.delimiter_scores(_counted(t))
    return scored.select("doc_id", F.explode("scores").alias("s")).select(
        "doc_id", "s.delimiter", col("s.score").cast("bigint").alias("score"),
        col("s.n_columns").cast("bigint").alias("n_columns"),
    )


@query
def detect_delimiter(t):
    return detect.detect_feeds(t.documents).select("doc_id", "delimiter", "delimiter_uncertain")


@query
def read_headers(t):
    return detect.detect_feeds(t.documents).select(
        "doc_id", F.size("headers").cast("bigint").alias("n_headers"), F.array_join("headers", "|").alias("headers")
    )


@query
def detect_feeds(t):
    found = detect.detect_feeds(t.documents)
    return found.select(
        "doc_id", "encoding", "delimiter", "delimiter_uncertain", F.array_join("headers", "|").alias("headers")
    )


@query
def feed_options(t):
    i = col("import_id")
    given = t.imports.withColumns(
        {
            "delimiter_override": F.when(i % 5 == 0, lit("|")).when(i % 5 == 1, lit("x")).when(i % 5 == 2, lit("")),
            "encoding_override": F.when(i % 3 == 0, lit("windows-1252")).when(i % 3 == 1, lit("latin9")),
        }
    )
    return views.feed_options(given)


# --- mapping ---------------------------------------------------------------------------------


@query
def mapping_errors(t):
    i = col("import_id")
    pairs = F.map_entries("mapping")
    add = lambda f, h: F.array(F.struct(lit(f).alias("key"), lit(h).alias("value")))
    broken = (
        F.when(i % 6 == 0, F.filter(pairs, lambda p: p["key"] != "price"))
        .when(i % 6 == 1, F.concat(F.filter(pairs, lambda p: p["key"] != "name"), add("name", "Bogus")))
        .when(i % 6 == 2, F.concat(pairs, add("color", "Group")))
        .when(i % 6 == 3, F.concat(F.filter(pairs, lambda p: p["key"] != "sku"), add("sku", "")))
        .otherwise(pairs)
    )
    return mapping.mapping_errors(t.imports.withColumn("mapping", F.map_from_entries(broken)))


@query
def mapping_invert(t):
    i = col("import_id")
    swapped = F.transform(
        F.map_entries("mapping"), lambda p: F.struct(p["value"].alias("key"), p["key"].alias("value"))
    )
    extra = F.array(F.struct(lit("Alt").alias("key"), lit("sku").alias("value")))
    contract = t.imports.withColumn(
        "mapping", F.map_from_entries(F.when(i % 9 == 0, F.concat(swapped, extra)).otherwise(swapped))
    )
    inverted = contract.select("import_id", F.explode(mapping.invert_mapping(col("mapping"))).alias("field", "header"))
    twice = mapping.duplicate_fields(contract)
    return inverted.join(twice, ["import_id", "field"], "left").select(
        "import_id", "field", "header", F.coalesce("times", lit(1).cast("bigint")).alias("times")
    )


@query
def map_columns(t):
    raw = [f"{f}_raw" for f in ("sku", "name", "price", "stock", "category", "description", "image_url")]
    return t.mapped.select("import_id", "row_number", "catalog_id", *raw, "has_replacement")


@query
def header_signature(t):
    return t.imports.select(
        "import_id",
        hashing.header_signature(col("headers"), CODED).alias("coded"),
        hashing.header_signature(col("headers"), CONTRACT).alias("contract"),
    )


@query
def template_match(t):
    return mapping.match_templates(t.imports, t.templates, CONTRACT)


@query
def template_upsert(t):
    saved = t.imports.filter("import_id % 2 = 0").select(
        col("source_label").alias("name"),
        F.concat(lit('{"sku":"new-'), col("import_id"), lit('"}')).alias("mapping_json"),
        lit("new").alias("header_signature"),
        lit(1769904000).cast("bigint").alias("saved_at"),
    )
    return mapping.upsert_templates(t.templates, saved)


@query
def template_delete(t):
    gone = t.imports.filter("import_id % 2 = 0").select(col("source_label").alias("name"))
    return mapping.delete_templates(t.templates, gone)


@query
def import_summary(t):
    totals = validate.validation_totals(t.staged)
    counts = diff.dry_run_counts(diff.dry_run(diff.last_wins(t.valid), t.staged_products))
    done = load.apply_totals(t.ledger)
    i = col("import_id")
    rows = (
        t.imports.join(totals, "import_id", "left")
        .join(counts, "import_id", "left")
        .join(done, "import_id", "left")
        .fillna(0, ["created_count", "updated_count", "skipped_count"])
        .withColumn("header_json", F.when(i % 11 == 0, lit("[broken")).otherwise(F.to_json("headers")))
        .withColumn("mapping_json", F.when(i % 7 == 0, lit(None)).otherwise(F.to_json("mapping")))
    )
    shown = views.import_summary(rows)
    return shown.select(
        "import_id", "catalog_id", "source_label", "original_filename", "delimiter", "encoding", "state",
        "total_rows", "error_rows", "warning_rows", F.to_json("dry_run").alias("dry_run"),
        F.to_json("result").alias("result"), "batch_size", F.array_join("headers", "|").alias("headers"),
        F.try_element_at("mapping", lit("image_url")).alias("image_header"),
    )


@query
def safe_filename(t):
    p = col("page_id")
    raw = F.concat(lit(" \t"), F.when(p % 9 != 0, F.concat("url", lit("\u0007\\x"), F.repeat("url", 8))).otherwise(lit("")))
    return t.read("pages").select("page_id", text.safe_filename(raw).alias("filename"))


# --- scalar functions ------------------------------------------------------------------------


@query
def js_trim(t):
    pads = (" \t", "\ufeff\u00a0\u3000", "\u2028\r\n", "\u200b")
    pad = F.element_at(F.array(*map(lit, pads)), (col("doc_id") % 4 + 1).cast("int"))
    trimmed = text.js_trim(F.concat(pad, "text", pad))
    return t.read("documents").select("doc_id", F.length(trimmed).cast("bigint").alias("n"), F.sha2(trimmed, 256).alias("sha"))


@query
def normalize_text(t):
    apart = F.when(col("doc_id") % 3 == 0, F.replace("text", lit("e"), lit("e\u0301"))).otherwise(col("text"))
    shown = t.read("documents").select("doc_id", text.normalize_text(apart).alias("x"))
    return shown.select("doc_id", F.length("x").cast("bigint").alias("n"), F.sha2("x", 256).alias("sha"))


@query
def excerpt(t):
    return t.read("documents").select("doc_id", text.excerpt(col("text")).alias("shown"))


@query
def strip_currency(t):
    s = numbers.strip_currency(col("price_raw"))
    return t.raw.select("import_id", "row_number", s.alias("s")).select("import_id", "row_number", "s.value", "s.stripped")


@query
def parse_decimal(t):
    parts = t.raw.select("import_id", "row_number", numbers.parse_decimal(col("price_raw")).alias("d"))
    return parts.select("import_id", "row_number", "d.negative", "d.integer", "d.fraction")


@query
def parse_price(t):
    parsed = t.raw.select("import_id", "row_number", numbers.parse_price(col("price_raw")).alias("p"))
    return parsed.select("import_id", "row_number", "p.value", "p.error")


@query
def parse_stock(t):
    parsed = t.raw.select("import_id", "row_number", numbers.parse_stock(col("stock_raw")).alias("p"))
    return parsed.select("import_id", "row_number", "p.value", "p.error")


@query
def normalize_url(t):
    p = col("page_id")
    raw = (
        F.when(p % 5 == 0, F.concat(lit(" "), "url", lit("\n")))
        .when(p % 5 == 1, F.regexp_replace("url", "^https?://", "/"))
        .when(p % 5 == 2, F.upper("url"))
        .otherwise(col("url"))
    )
    found = t.read("pages").select("page_id", urls.normalize_url(raw).alias("u"))
    return found.select("page_id", "u.value", "u.error")


@query
def row_hash(t):
    values = {c: col(c) for c in ("sku", "name", "price_cents", "stock", "category", "description", "image_url")}
    sets = {f: col(f"sets_{f}") for f in OPTIONAL_FIELDS}
    return t.validated.filter("valid").select(
        "import_id", "row_number", hashing.row_hash(values, sets, CODED).alias("all_fields"),
        col("row_hash").alias("mapped_fields"),
    )


@query
def price_display(t):
    return t.imports.select("import_id", "balance_cents", numbers.price_display(col("balance_cents")).alias("shown"))


# --- validation ------------------------------------------------------------------------------


def _findings(t, test):
    return validate.row_findings(t.validated).filter(test)


@query
def v_columns_mismatch(t):
    return _findings(t, col("code") == "columns_mismatch")


@query
def v_missing_required(t):
    return _findings(t, col("code") == "missing_required")


@query
def v_price(t):
    return _findings(t, col("code").startswith("price_"))


@query
def v_stock(t):
    return _findings(t, col("code").startswith("stock_"))


@query
def v_field_too_long(t):
    return _findings(t, col("code") == "field_too_long")


@query
def v_url(t):
    return _findings(t, col("code") == "url_invalid")


@query
def v_replacement(t):
    return _findings(t, col("code") == "encoding_replacement")


@query
def duplicate_sku(t):
    return validate.duplicate_findings(validate.duplicate_skus(t.staged), CONTRACT)


@query
def normalized_rows(t):
    return validate.normalized_rows(t.validated)


@query
def row_report(t):
    return validate.row_report(t.staged, CONTRACT)


@query
def row_report_coded(t):
    return validate.row_report(t.coded, CODED)


@query
def import_outcomes(t):
    """Every ninth import has no mapping, and a cap is asked for; all imports still get their outcome."""
    imports = t.imports.withColumn("mapping", F.when(col("import_id") % 9 != 0, col("mapping")))
    return validate_feeds(stage(t.headed, "records"), imports, t.staged_products, CONTRACT, cap=600).outcomes


@query
def row_cap(t):
    return validate.row_cap(t.records, CONTRACT, cap=600)


@query
def report_replace(t):
    again = t.imports.filter("import_id % 3 = 0")
    found = validate.row_report(t.staged, CONTRACT)
    phase = F.when(col("row_number") % 10 == 0, lit("apply")).otherwise(lit("validate"))
    old = found.withColumn("phase", phase).withColumn("message", lit("old"))
    new = found.filter("import_id % 3 = 0")
    return validate.replace_report(old, new, again, CONTRACT)


@query
def row_numbers(t):
    from feedloom.operators.groups import BLOCK_ROWS, block_of, number_rows

    kept = t.data.select("import_id", "row_number")
    return number_rows(kept, ["import_id"], block_of("row_number", BLOCK_ROWS), ["row_number"], "data_row")


@query
def report_page(t):
    found = validate.row_report(t.staged, CONTRACT).filter("import_id = 1")
    return validate.page_of_report(found, CONTRACT, page=2, per_page=20, severity="error")


@query
def report_page_stored(t):
    """The same page out of a stored list: looked up in its counts."""
    path, order = new_folder(t.spark, "pages"), ("row_number", "code", "column_name", "phase", "severity", "message")
    rows = validate.row_report(t.staged, CONTRACT)
    pages.write_pages(rows, path, "import_id", block_of("row_number", BLOCK_ROWS), order, ("severity", "code"))
    return pages.read_page(t.spark, path, "import_id", 1, page=2, per_page=20, severity="error")


# --- joins and aggregates --------------------------------------------------------------------


@query
def last_wins(t):
    return diff.last_wins(validate.valid_rows(t.validated))


def _last(t):
    return diff.last_wins(t.valid)


@query
def dry_run_rows(t):
    return diff.dry_run(_last(t), t.staged_products)


@query
def would_create(t):
    return diff.would_create(_last(t), t.staged_products).select("import_id", "sku", "row_number")


@query
def would_skip(t):
    return diff.would_skip(_last(t), t.staged_products).select("import_id", "sku", "row_number")


@query
def would_update(t):
    return diff.would_update(_last(t), t.staged_products).select("import_id", "sku", "row_number")


@query
def import_history(t):
    return views.import_history(t.imports, t.catalogs)


@query
def catalog_counts(t):
    return views.catalog_counts(t.catalogs, t.products)


@query
def product_last_import(t):
    linked = views.products_with_import(t.products, t.imports)
    return linked.select("catalog_id", "sku", "price_cents", "last_import_id", "last_import_file")


@query
def unknown_catalog(t):
    i = col("import_id")
    some = t.imports.withColumn("catalog_id", F.when(i % 10 == 0, lit(9999).cast("bigint")).otherwise(col("catalog_id")))
    return views.unknown_catalogs(some, t.catalogs).select("import_id", "catalog_id")


@query
def validation_totals(t):
    return validate.validation_totals(t.staged)


@query
def dry_run_counts(t):
    return diff.dry_run_counts(diff.dry_run(_last(t), t.staged_products))


@query
def batch_plan(t):
    return load.batch_plan(t.batched)


@query
def batch_ledger(t):
    return t.full_ledger


@query
def apply_totals(t):
    return load.apply_totals(t.full_ledger)


# --- pages -----------------------------------------------------------------------------------


@query
def import_page(t):
    page = views.page_of_imports(t.imports, CONTRACT, page=2, per_page=3, catalog_id=1)
    return page.select("import_id", "catalog_id", "source_label", "state", "total")


@query
def template_list(t):
    return views.template_list(t.templates)


@query
def change_page(t):
    found = load.changes_json(load.field_changes(t.played, t.staged_products)).filter("import_id = 2")
    return views.page_of_changes(found, CONTRACT, page=2, per_page=20, action="update")


@query
def change_page_stored(t):
    path, block = new_folder(t.spark, "pages"), block_of("row_number", BLOCK_ROWS)
    rows = load.changes_json(load.field_changes(t.played, t.staged_products))
    pages.write_pages(rows, path, "import_id", block, ("row_number",), ("action",))
    return pages.read_page(t.spark, path, "import_id", 2, page=2, per_page=20, action="update")


@query
def product_search_indexed(t):
    path = new_folder(t.spark, "trigrams")
    search.write_index(t.staged_products, path)
    found = search.search_indexed(t.staged_products, path, "RING", catalog_id=2)
    return found.select("catalog_id", "sku", "name", "price_cents", "stock", "last_import_id", "total")


@query
def product_search(t):
    found = views.search_products(t.products, query="RING", catalog_id=2, page=1, per_page=50)
    return found.select("catalog_id", "sku", "name", "price_cents", "stock", "last_import_id", "total")


# --- load ------------------------------------------------------------------------------------


@query
def apply_actions(t):
    return t.actions.select("import_id", "row_number", "batch_number", "catalog_id", "sku", "action")


@query
def apply_changes(t):
    return load.changes_json(load.field_changes(t.played, t.staged_products))


@query
def apply_hot(t):
    """One SKU holds a third of all rows, and imports are longer than a block: actions and audit of those rows."""
    rows = stage(t.batched.withColumn("sku", F.when(col("row_number") % 3 == 0, lit("HOT")).otherwise(col("sku"))), "hot")
    played = load.replay(rows, t.staged_products, load.hot_keys(rows, 50), load.block_offsets(rows, 50), 50)
    return load.changes_json(load.field_changes(played, t.staged_products))


def _merged(t):
    """As in a load: rows are replayed in one layout by key, and what each of them writes is folded."""
    return load.merged_catalog(t.played, t.staged_products, lit(APPLIED_AT).cast("timestamp"))


def _dated(products):
    return products.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query
def merged_catalog(t):
    return _dated(_merged(t))


@query
def ledger_dedupe(t):
    return load.not_applied(t.batched, t.ledger).select("import_id", "row_number", "batch_number")


@query
def resume_rows(t):
    return load.resume_rows(t.valid, t.ledger, BATCH).select("import_id", "row_number", "batch_number")


@query
def reimport_noop(t):
    """Every row once more against the loaded catalog: rows that write what is stored change nothing."""
    hot, offsets = t.hot
    loaded = _merged(t) if hot is None else stage(_merged(t).select(*load.KEY, "row_hash"), "loaded")  # read twice then
    return load.apply_actions(t.batched, loaded, hot, offsets).select("import_id", "row_number", "sku", "action")


@query
def file_integrity(t):
    _, found = t.feed_files()
    tampered = F.when(col("import_id") % 10 == 0, F.reverse("sha256")).otherwise(col("sha256"))
    gone = F.when(col("import_id") % 15 == 0, F.concat("path", lit(".gone"))).otherwise(col("path"))
    recorded = found.select("import_id", gone.alias("path"), tampered.alias("file_sha256"))
    return files.file_integrity(recorded, found).select("import_id", "state", "pause_reason")


@query
def apply_progress(t):
    return load.progress(t.imports, t.batched, t.ledger)


@query
def ledger_gaps(t):
    return load.ledger_gaps(t.full_ledger.filter("(import_id + batch_number) % 3 <> 0"))


@query
def reconcile(t):
    counts = diff.dry_run_counts(diff.dry_run(_last(t), t.staged_products))
    return load.reconcile(counts, load.apply_totals(t.full_ledger))


# --- streams ---------------------------------------------------------------------------------


def _arriving(t):
    folder, found = t.feed_files()
    headers = (*HEADERS, "Image")
    pairs = [lit(x) for pair in zip(FIELDS, headers) for x in pair]
    named = found.select(
        "path", "import_id", "encoding", "delimiter",
        F.array(*map(lit, headers)).alias("headers"), F.create_map(*pairs).alias("mapping"),
        F.call_function("div", col("import_id"), lit(FILES_PER_IMPORT).cast("bigint")).alias("own"),
    )
    catalog = t.imports.select(col("import_id").alias("own"), "catalog_id")
    return folder, stage(named.join(catalog, "own").drop("own"), "arriving")


@query
def stream_report(t):
    folder, imports = _arriving(t)
    out = new_folder(t.spark, "stream-report")
    stream_reports(t.spark, folder, imports, CONTRACT, out, new_folder(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@query
def stream_apply(t):
    folder, imports = _arriving(t)
    root, state = new_folder(t.spark, "store"), new_folder(t.spark, "stream-state")
    stream_loads(t.spark, folder, imports, CONTRACT, root, state, BATCH).awaitTermination()
    return store.read_products(t.spark, root).drop("updated_at")


def _loaded(t) -> str:
    """Validate and load from feed files, then once more: the second load must change nothing."""
    folder, imports = _arriving(t)
    root = new_folder(t.spark, "store")
    records = feed.read_feed(t.spark, folder, imports)
    done = validate_feeds(records, imports, store.read_products(t.spark, root), CONTRACT)
    recorded = imports.join(files.list_feeds(t.spark, folder).select("path", col("sha256").alias("file_sha256")), "path")
    whole = intact(done.validated, recorded, files.list_feeds(t.spark, folder))
    for _ in range(2):
        load_feeds(t.spark, root, whole, CONTRACT, BATCH, lit(APPLIED_AT).cast("timestamp"))
    return root


@query
def load_job(t):
    return store.read_ledger(t.spark, _loaded(t))


@query
def load_audit(t):
    return store.read_changes(t.spark, _loaded(t))


@query
def load_resume(t):
    """A load cut off after row 300 of each import, gone on with other batch sizes, then repeated."""
    root, at = new_folder(t.spark, "store"), lit(APPLIED_AT).cast("timestamp")
    size = F.when(col("import_id") % 2 == 0, 50).otherwise(100).cast("bigint")
    first = t.imports.select("import_id", size.alias("batch_size"))
    second = t.imports.select("import_id", lit(70).cast("bigint").alias("batch_size"))
    load_feeds(t.spark, root, t.staged.filter("row_number <= 300"), CONTRACT, applied_at=at, imports=first)
    for sizes in (second, first):
        load_feeds(t.spark, root, t.staged, CONTRACT, applied_at=at, imports=sizes)
    return store.read_ledger(t.spark, root)


def _bucketed(t) -> str:
    """Loads of some imports each, into buckets so small that catalogs are laid out anew as they grow."""
    root, at = new_folder(t.spark, "store"), lit(APPLIED_AT).cast("timestamp")
    for low, high in ((0, 2), (2, 5), (5, None)):
        rows = t.staged.filter(col("import_id") > low)
        load_feeds(t.spark, root, rows if high is None else rows.filter(col("import_id") <= high), CONTRACT, applied_at=at, bucket_rows=20)
    return root


@query
def store_buckets(t):
    return store.read_products(t.spark, _bucketed(t)).select("catalog_id", "sku", "row_hash", "last_import_id")


@query
def store_counts(t):
    return store.product_counts(t.spark, _bucketed(t))
