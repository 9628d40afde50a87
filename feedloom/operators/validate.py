"""Row validation: findings, normalized values and content hashes in one pass without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.csvtext import is_blank_record
from feedloom.functions.hashing import row_hash
from feedloom.functions.numbers import decimal_parts, number_body, price_result, stock_result
from feedloom.functions.text import excerpt, is_blank, js_trim, longer_than, normalize_text
from feedloom.functions.urls import url_result
from feedloom.operators.groups import BLOCK_ROWS, block_of, number_rows, previous_value, spread_join
from feedloom.rules import LENGTH_CAPS, OPTIONAL_FIELDS, ROW_CAP, Rules
from feedloom.session import stage

FINDING = "struct<column_name:string,code:string,severity:string,message:string>"
REPORT_COLUMNS = ("import_id", "phase", "row_number", "column_name", "code", "severity", "message")


def _finding(column: Column, code: Column | str, message: Column | str, severity: str = "error") -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        column.alias("column_name"),
        as_column(code).alias("code"),
        F.lit(severity).alias("severity"),
        as_column(message).alias("message"),
    ).cast(FINDING)


def _clean(mapped: DataFrame, rules: Rules) -> DataFrame:
    """Normalized text, and the number cells reduced to sign, digits and separators."""
    url = normalize_text if rules.url_text_rules else js_trim
    return mapped.select(
        "import_id",
        "catalog_id",
        "row_number",
        "n_cells",
        "n_headers",
        "has_replacement",
        *[c for c in mapped.columns if c.startswith("col_")],
        *[normalize_text(F.col(f"{f}_raw")).alias(f) for f in ("sku", "name", "category", "description")],
        url(F.col("image_url_raw")).alias("url_text"),
        is_blank(F.col("price_raw")).alias("price_blank"),
        is_blank(F.col("stock_raw")).alias("stock_blank"),
        number_body(F.col("price_raw")).alias("price_body"),
        number_body(F.col("stock_raw")).alias("stock_body"),
    )


def _parse(clean: DataFrame) -> DataFrame:
    parts = clean.select(
        "*",
        decimal_parts(F.col("price_body")).alias("price_parts"),
        decimal_parts(F.col("stock_body")).alias("stock_parts"),
        url_result(F.col("url_text")).alias("url"),
    ).drop("price_body", "stock_body", "url_text")
    return parts.select(
        "*",
        price_result(F.col("price_parts")).alias("price"),
        stock_result(F.col("stock_parts")).alias("stock_count"),
    ).drop("price_parts", "stock_parts")


def _checks(rules: Rules) -> list[tuple[Column, Column]]:
    """(test, finding) in the order sku, name, price, stock, lengths, URL; a test is never null."""
    column = lambda f: F.coalesce(f"col_{f}", F.lit(f))
    required = lambda f, label: _finding(column(f), "missing_required", f"{label} is required")

    def number(field: str, error: Column) -> Column:
        code = F.concat(F.lit(f"{field}_"), error)
        return _finding(column(field), code, F.concat(F.lit(f"Invalid {field}: "), error))

    price, stock = F.col("price.error"), F.col("stock_count.error")
    checks = [
        (F.col("sku") == "", required("sku", "SKU")),
        (F.col("name") == "", required("name", "Name")),
        (F.col("price_blank"), required("price", "Price")),
        (~F.col("price_blank") & price.isNotNull(), number("price", price)),
        (~F.col("stock_blank") & stock.isNotNull(), number("stock", stock)),
    ]
    if rules.length_caps:
        for field, cap in LENGTH_CAPS.items():
            value = F.coalesce("url.value", F.lit("")) if field == "image_url" else F.col(field)
            message = f"{field} is longer than {cap} characters"
            checks.append((longer_than(value, cap), _finding(column(field), "field_too_long", message)))
    if rules.bad_url_is_error:
        message = "Image URL is not an absolute http or https URL"
        checks.append((F.col("url.error").isNotNull(), _finding(column("image_url"), "url_invalid", message)))
    return checks


def _judge(parsed: DataFrame, rules: Rules) -> DataFrame:
    """Add `valid` and `findings`. Rows without a fault, nearly all, never build the finding list."""
    checks = _checks(rules)
    wrong = checks[0][0]
    for test, _ in checks[1:]:
        wrong = wrong | test
    tested = parsed.withColumns({"mismatch": F.col("n_cells") != F.col("n_headers"), "wrong": wrong})
    shape = _finding(
        F.lit(None).cast("string"),
        "columns_mismatch",
        F.concat(F.lit("Expected "), F.col("n_headers"), F.lit(" columns, got "), F.col("n_cells")),
    )
    nothing = F.array().cast(f"array<{FINDING}>")
    # Lists joined, because a filter over one list is not compiled.
    found = (
        F.when(F.col("mismatch"), F.array(shape))
        .when(F.col("wrong"), F.concat(*[F.when(test, F.array(what)).otherwise(nothing) for test, what in checks]))
        .otherwise(nothing)
    )
    if rules.replacement_warning:
        warning = _finding(
            F.lit(None).cast("string"),
            "encoding_replacement",
            "Row contains bytes that could not be decoded",
            severity="warning",
        )
        found = F.when(F.col("has_replacement"), F.concat(found, F.array(warning))).otherwise(found)
    return tested.withColumns({"findings": found, "valid": ~(F.col("mismatch") | F.col("wrong"))})


def validate_rows(mapped: DataFrame, rules: Rules) -> DataFrame:
    """One row per data record: product values, hash, findings, validity, and which optional fields a
    valid row sets (`sets_*`)."""
    rows = _judge(_parse(_clean(mapped, rules)), rules)
    is_mapped = {f: F.col(f"col_{f}").isNotNull() for f in OPTIONAL_FIELDS}
    stock = F.col("stock_count.value")
    blank_stock = F.lit(None).cast("bigint") if rules.blank_stock_is_null else F.lit(0).cast("bigint")
    values = rows.select(
        "import_id",
        "catalog_id",
        "row_number",
        "sku",
        "name",
        F.col("price.value").alias("price_cents"),
        F.when(F.col("stock_blank"), blank_stock).otherwise(stock).alias("stock"),
        F.nullif("category", F.lit("")).alias("category"),
        F.nullif("description", F.lit("")).alias("description"),
        F.nullif("url.value", F.lit("")).alias("image_url"),
        "findings",
        "valid",
        (F.col("has_replacement") & F.lit(rules.replacement_warning)).alias("has_replacement"),
        *[test.alias(f"sets_{f}") for f, test in is_mapped.items()],
    )
    columns = ("sku", "name", "price_cents", "stock", "category", "description", "image_url")
    hashed = row_hash({c: F.col(c) for c in columns}, {f: F.col(f"sets_{f}") for f in OPTIONAL_FIELDS}, rules)
    values = values.withColumn("row_hash", F.when(F.col("valid"), hashed))
    if rules.blank_stock_is_null:
        values = values.withColumn("sets_stock", F.col("sets_stock") & F.col("stock").isNotNull())
    return values


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("valid").drop("findings", "valid", "has_replacement")


def normalized_rows(validated: DataFrame) -> DataFrame:
    """The typed product record of every valid row."""
    return valid_rows(validated).select(
        "import_id",
        "row_number",
        "sku",
        "name",
        "price_cents",
        F.coalesce("stock", F.lit(0)).alias("stock"),
        "category",
        "description",
        "image_url",
        "row_hash",
    )


def duplicate_skus(validated: DataFrame) -> DataFrame:
    """Valid rows whose SKU an earlier valid row of the same import has; `seen_at` is the latest such row.

    Row numbers are looked at first, whether any import is longer than a block; pass stored rows.
    """
    slim = validated.filter("valid").select("import_id", "row_number", "sku", "has_replacement")
    if slim.filter(F.col("row_number") >= BLOCK_ROWS).isEmpty():  # nearly always: no block has one before it
        earlier = F.lag("row_number").over(Window.partitionBy("import_id", "sku").orderBy("row_number"))
        return slim.withColumn("seen_at", earlier).filter("seen_at is not null")
    return previous_value(
        slim, ["import_id", "sku"], block_of("row_number", BLOCK_ROWS), ["row_number"], "row_number", "seen_at"
    ).filter("seen_at is not null")


def duplicate_findings(duplicates: DataFrame, rules: Rules) -> DataFrame:
    shown = excerpt(F.col("sku")) if rules.message_excerpts else F.col("sku")
    message = F.concat(
        F.lit('SKU "'), shown, F.lit('" seen at row '), F.col("seen_at"), F.lit("; last occurrence wins")
    )
    return duplicates.select(
        "import_id",
        F.lit("validate").alias("phase"),
        "row_number",
        F.lit("sku").alias("column_name"),
        F.lit("duplicate_sku").alias("code"),
        F.lit("warning").alias("severity"),
        message.alias("message"),
    )


def row_findings(validated: DataFrame) -> DataFrame:
    """One row per finding. The outer form, because for the other one the optimizer puts a filter on the size of the list
    below the whole validation, with the whole of it written out once more for every use."""
    return validated.select("import_id", "row_number", F.explode_outer("findings").alias("f")).filter("f is not null").select(
        "import_id",
        F.lit("validate").alias("phase"),
        "row_number",
        "f.column_name",
        "f.code",
        "f.severity",
        "f.message",
    )


def row_report(validated: DataFrame, rules: Rules) -> DataFrame:
    """Every finding of every row, one row each."""
    return row_findings(validated).unionByName(duplicate_findings(duplicate_skus(validated), rules))


def validation_totals(validated: DataFrame) -> DataFrame:
    """Rows (not findings) per import: all, with an error, with a warning."""
    base = validated.groupBy("import_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(~F.col("valid")).alias("error_rows"),
        F.count_if("has_replacement").alias("replaced"),
    )
    repeated = (
        duplicate_skus(validated)
        .filter("not has_replacement")  # those rows are counted above already
        .groupBy("import_id")
        .agg(F.count("*").alias("repeated"))
    )
    return base.join(repeated, "import_id", "left").select(
        "import_id",
        "total_rows",
        "error_rows",
        (F.col("replaced") + F.coalesce("repeated", F.lit(0))).alias("warning_rows"),
    )


def row_cap(records: DataFrame, rules: Rules, cap: int = ROW_CAP) -> DataFrame:
    """Per import: data rows and, above the cap, the failure it ends with.

    `records` holds all data records, blank ones included. The coded rules also fail a feed in which
    any record, even a blank one, follows the last allowed row.
    """
    blank = is_blank_record(F.col("cells"))
    counted = records.groupBy("import_id").agg(
        F.count_if(~blank).alias("total_rows"),
        F.max(F.when(~blank, F.col("row_number"))).alias("last_data"),
        F.max("row_number").alias("last_any"),
    )
    over = F.col("total_rows") > cap
    if rules.dense_row_numbers:
        over = over | ((F.col("total_rows") == cap) & (F.col("last_any") > F.col("last_data")))
    return counted.select(
        "import_id",
        "total_rows",
        F.when(over, F.lit("failed")).otherwise(F.lit("validating")).alias("state"),
        F.when(over, F.lit("row_limit_exceeded")).alias("pause_reason"),
    )


def within_cap(records: DataFrame, rules: Rules, cap: int | None = None, capped: DataFrame | None = None) -> DataFrame:
    """Data records, by default all of them. With a cap, imports over it are left out as a whole; their
    outcome (see `import_outcomes`) says so. `capped` is what `row_cap` found, where that is stored already."""
    data = records.filter(~is_blank_record(F.col("cells")))
    if cap is None:
        return data
    found = row_cap(records, rules, cap) if capped is None else capped
    failed = stage(found.filter("state = 'failed'").select("import_id"), "over-cap")
    return spread_join(data, failed, "import_id", F.col("row_number"), "left_anti")


def data_row_numbers(data: DataFrame, rules: Rules) -> DataFrame:
    """Under the coded rules, number the data rows of an import from 1 without gaps; else keep record numbers."""
    if not rules.dense_row_numbers:
        return data
    dense = number_rows(data, ["import_id"], block_of("row_number", BLOCK_ROWS), ["row_number"], "_data_row")
    return dense.withColumn("row_number", F.col("_data_row").cast("bigint")).drop("_data_row")


def has_mapping(imports: DataFrame) -> DataFrame:
    return imports.filter(F.coalesce(F.size("mapping"), F.lit(0)) > 0)


def import_outcomes(
    imports: DataFrame, totals: DataFrame, counts: DataFrame | None, capped: DataFrame | None = None, broken: DataFrame | None = None
) -> DataFrame:
    """One row for every import: how its validation ended, why, and what it found.

    An import without a mapping, over the cap it was given, or with a file that has changed (`broken`) is `failed` with
    its reason and without numbers; any other is `validated`, with zeros where it has no rows. Without a dry run
    (`counts`) its numbers are null.
    """
    nothing = F.lit(None).cast("string")
    ended = imports.select("import_id", (F.coalesce(F.size("mapping"), F.lit(0)) <= 0).alias("_unmapped"))
    if capped is not None:
        over = capped.filter("state = 'failed'").select("import_id", F.col("pause_reason").alias("_over"))
        ended = ended.join(over, "import_id", "left")
    if broken is not None:
        gone = broken.select("import_id", F.col("pause_reason").alias("_gone")).distinct()
        ended = ended.join(gone, "import_id", "left")
    reasons = [F.col("_gone") if broken is not None else nothing, F.when(F.col("_unmapped"), F.lit("no_mapping"))]
    ended = ended.withColumn("reason", F.coalesce(*reasons, F.col("_over") if capped is not None else nothing))
    joined = ended.join(totals, "import_id", "left")
    if counts is not None:
        joined = joined.join(counts, "import_id", "left")
    number = lambda c: F.when(F.col("reason").isNull(), F.coalesce(c, F.lit(0).cast("bigint"))).alias(c)
    dry = ("would_create", "would_update", "would_skip")
    return joined.select(
        "import_id",
        F.when(F.col("reason").isNull(), F.lit("validated")).otherwise(F.lit("failed")).alias("state"),
        "reason",
        *[number(c) for c in ("total_rows", "error_rows", "warning_rows")],
        *[F.lit(None).cast("bigint").alias(c) if counts is None else number(c) for c in dry],
    )


def replace_report(old: DataFrame, new: DataFrame, imports: DataFrame, rules: Rules) -> DataFrame:
    """The report after validating `imports` again: their earlier findings give way to `new`."""
    again = imports.select("import_id").distinct()
    on = ["import_id"]
    if not rules.replace_all_phases:
        again, on = again.withColumn("phase", F.lit("validate")), ["import_id", "phase"]
    kept = spread_join(old, again, on, F.col("row_number"), "left_anti")
    return kept.unionByName(new)


def page_of_report(
    report: DataFrame, rules: Rules, page: int = 1, per_page: int | None = None,
    severity: str | None = None, code: str | None = None,
) -> DataFrame:
    """One page of findings in row order, with the number of all of them as `total`; narrow `report` to one
    import first."""
    size = min(rules.page_max, max(1, per_page or rules.page_size))
    if severity:
        report = report.filter(F.col("severity") == severity)
    if code:
        report = report.filter(F.col("code") == code)
    ordered = report.orderBy("row_number", "code", "column_name", "phase", "severity", "message")
    shown = ordered.offset((max(1, page) - 1) * size).limit(size)
    return shown.withColumn("total", F.lit(report.count()).cast("bigint"))


