"""Pages, searches and summaries over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.groups import heavy_join
from feedloom.rules import CONTRACT, DELIMITERS, ENCODINGS, Rules
from feedloom.session import stage

HISTORY_ROWS = 50


def _page(df: DataFrame, order: list, rules: Rules, page: int, per_page: int) -> DataFrame:
    """One page of the rows in order, and how many rows there are as `total`; `rules` bound a page's size."""
    size = min(rules.page_max, max(1, per_page))
    shown = df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)
    return shown.withColumn("total", F.lit(df.count()).cast("bigint"))


def page_of_imports(
    imports: DataFrame, rules: Rules, page: int = 1, per_page: int = 50,
    catalog_id: int | None = None, state: str | None = None,
) -> DataFrame:
    if catalog_id is not None:
        imports = imports.filter(F.col("catalog_id") == catalog_id)
    if state:
        imports = imports.filter(F.col("state") == state)
    return _page(imports, [F.desc("import_id")], rules, page, per_page)


def import_history(imports: DataFrame, catalogs: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The newest imports with their catalog's name; the join sees only those rows."""
    newest = imports.orderBy(F.desc("import_id")).limit(rows)
    return newest.join(catalogs, "catalog_id").select("import_id", "catalog_id", "catalog_name", "source_label", "state")


def catalog_counts(catalogs: DataFrame, products: DataFrame) -> DataFrame:
    """Products per catalog, counted before the join; catalogs without any keep a zero."""
    counts = products.groupBy("catalog_id").agg(F.count("*").alias("_n"))
    return catalogs.join(counts, "catalog_id", "left").select(
        "catalog_id", "catalog_name", F.coalesce("_n", F.lit(0).cast("bigint")).alias("product_count")
    )


def products_with_import(products: DataFrame, imports: DataFrame) -> DataFrame:
    links = imports.select(
        F.col("import_id").alias("last_import_id"), F.col("original_filename").alias("last_import_file")
    )
    return heavy_join(products, stage(links, "links"), "last_import_id")  # one import may have written most products


def unknown_catalogs(imports: DataFrame, catalogs: DataFrame) -> DataFrame:
    return imports.join(catalogs, "catalog_id", "left_anti")


def page_of_changes(changes: DataFrame, rules: Rules, page: int = 1, per_page: int = 50, action: str | None = None):
    """One page of an import's audit, in the order the rows were applied."""
    if action:
        changes = changes.filter(F.col("action") == action)
    return _page(changes, ["row_number"], rules, page, per_page)


def search_products(
    products: DataFrame, query: str | None = None, catalog_id: int | None = None, page: int = 1, per_page: int = 50,
    rules: Rules = CONTRACT,
) -> DataFrame:
    """Case-insensitive substring of SKU or name; the text is taken literally."""
    if catalog_id is not None:
        products = products.filter(F.col("catalog_id") == catalog_id)
    if query:
        needle = F.lower(F.lit(query))
        products = products.filter(
            F.contains(F.lower("sku"), needle) | F.contains(F.lower("name"), needle)
        )
    return _page(products, ["catalog_id", "sku"], rules, page, per_page)


def template_list(templates: DataFrame) -> DataFrame:
    return templates.orderBy(F.desc_nulls_last("last_used_at"), "name")


def parse_json(text: Column, schema: str, fallback: Column) -> Column:
    return F.coalesce(F.from_json(text, schema), fallback)


def import_summary(imports: DataFrame) -> DataFrame:
    """The nested shape of an import, headers and mapping included."""
    return imports.select(
        "import_id",
        "catalog_id",
        "source_label",
        "original_filename",
        "delimiter",
        "encoding",
        "state",
        "total_rows",
        "error_rows",
        "warning_rows",
        F.struct("would_create", "would_update", "would_skip").alias("dry_run"),
        F.struct(
            F.col("created_count").alias("created"),
            F.col("updated_count").alias("updated"),
            F.col("skipped_count").alias("skipped"),
        ).alias("result"),
        "batch_size",
        parse_json(F.col("header_json"), "array<string>", F.array().cast("array<string>")).alias("headers"),
        parse_json(F.col("mapping_json"), "map<string,string>", F.lit(None)).alias("mapping"),
    )


def feed_options(imports: DataFrame) -> DataFrame:
    """Delimiter and encoding a feed is read with: the operator's override, else the detected value;
    anything outside the known sets falls back to comma and UTF-8."""

    def choice(name: str, known: tuple[str, ...], default: str) -> Column:
        picked = F.coalesce(F.expr(f"nullif({name}_override, '')"), F.col(name))
        return F.when(picked.isin(*known), picked).otherwise(F.lit(default)).alias(name)

    return imports.select(
        "import_id", choice("delimiter", DELIMITERS, ","), choice("encoding", ENCODINGS, "utf-8")
    )
