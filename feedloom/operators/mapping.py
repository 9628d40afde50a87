"""From cells to named product fields, and the mapping templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.hashing import header_signature
from feedloom.functions.text import REPLACEMENT, js_trim, nfc
from feedloom.operators.groups import heavy_join, spread_join
from feedloom.rules import FIELDS, REQUIRED_FIELDS, Rules
from feedloom.session import stage


def read_headers(cells: Column) -> Column:
    return F.transform(cells, lambda cell: js_trim(nfc(cell)))


def invert_mapping(mapping: Column) -> Column:
    """header -> field becomes field -> header. A field mapped twice is reported by
    `duplicate_fields`; here the first of its headers is kept."""
    pairs = F.map_entries(mapping)
    first = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, F.lit(1), i), lambda earlier: earlier["value"] == p["value"]
        ),
    )
    return F.map_from_entries(
        F.transform(first, lambda p: F.struct(p["value"].alias("key"), p["key"].alias("value")))
    )


def duplicate_fields(imports: DataFrame, mapping: str = "mapping") -> DataFrame:
    """(import_id, field, times) for header -> field mappings that use a field more than once."""
    return (
        imports.select("import_id", F.explode(mapping).alias("header", "field"))
        .groupBy("import_id", "field")
        .agg(F.count("*").alias("times"))
        .filter("times > 1")
    )


def mapping_errors(imports: DataFrame) -> DataFrame:
    """(import_id, field, message) for field -> header mappings that cannot be used."""
    entries = imports.select("import_id", "headers", F.explode("mapping").alias("field", "header"))
    has_header = F.coalesce(F.col("header") != "", F.lit(False))
    unknown = ~F.col("field").isin(*FIELDS)
    missing = has_header & ~F.array_contains("headers", F.col("header"))
    unusable = entries.select(
        "import_id",
        "field",
        F.when(unknown, F.concat(F.lit("Unknown field: "), F.col("field")))
        .when(missing, F.concat(F.lit('Header "'), F.col("header"), F.lit('" not found in file')))
        .alias("message"),
    ).filter("message is not null")
    required = imports.select(
        "import_id", "mapping", F.explode(F.array(*map(F.lit, REQUIRED_FIELDS))).alias("field")
    ).filter(F.coalesce(F.try_element_at("mapping", F.col("field")), F.lit("")) == "")
    return unusable.unionByName(
        required.select(
            "import_id", "field", F.concat(F.col("field"), F.lit(" is required")).alias("message")
        )
    )


def import_layout(imports: DataFrame) -> DataFrame:
    """Per import: header count and, per field, mapped header (`col_*`) and its last 1-based position."""
    header = {f: F.expr(f"nullif(try_element_at(mapping, '{f}'), '')") for f in FIELDS}
    backwards = F.reverse("headers")
    position = {
        f: F.size("headers") + 1 - F.expr("nullif(array_position(backwards, col_%s), 0)" % f) for f in FIELDS
    }
    return (
        imports.select(
            "import_id",
            "catalog_id",
            "headers",
            F.size("headers").alias("n_headers"),
            backwards.alias("backwards"),
            *[header[f].alias(f"col_{f}") for f in FIELDS],
        )
        .select(
            "import_id",
            "catalog_id",
            "n_headers",
            *[f"col_{f}" for f in FIELDS],
            *[position[f].cast("int").alias(f"pos_{f}") for f in FIELDS],
        )
    )


def map_columns(records: DataFrame, imports: DataFrame) -> DataFrame:
    """records (import_id, row_number, cells) -> raw text per product field, '' where there is none."""
    rows = spread_join(records, import_layout(imports), "import_id", F.col("row_number"))
    raw = [
        F.coalesce(F.get("cells", F.col(f"pos_{f}") - 1), F.lit("")).alias(f"{f}_raw") for f in FIELDS
    ]
    return rows.select(
        "import_id",
        "catalog_id",
        "row_number",
        F.size("cells").alias("n_cells"),
        "n_headers",
        F.contains(F.array_join("cells", ""), F.lit(REPLACEMENT)).alias("has_replacement"),
        *[f"col_{f}" for f in FIELDS],
        *raw,
    )


def match_templates(imports: DataFrame, templates: DataFrame, rules: Rules) -> DataFrame:
    """The most recently used template with the import's header signature, if there is one.

    Feeds of one kind share a signature, so a signature may be that of nearly all imports.
    """
    signed = imports.withColumn("header_signature", header_signature(F.col("headers"), rules))
    newest = templates.groupBy("header_signature").agg(
        F.max(F.struct("last_used_at", F.col("name").alias("template_name"), "mapping_json")).alias("t")
    )
    return heavy_join(signed, stage(newest, "templates"), "header_signature").select(
        "import_id", "header_signature", "t.template_name", "t.mapping_json"
    )


def upsert_templates(templates: DataFrame, saved: DataFrame) -> DataFrame:
    """Save mappings by template name. An existing template keeps its signature, takes the new mapping
    and is stamped as used; a new one has never been used. `saved` has one row per name:
    (name, mapping_json, header_signature, saved_at)."""
    old, new = templates.alias("o"), saved.alias("n")
    both = F.col("o.name").isNotNull() & F.col("n.name").isNotNull()
    return old.join(new, "name", "full_outer").select(
        "name",
        F.coalesce("n.mapping_json", "o.mapping_json").alias("mapping_json"),
        F.coalesce("o.header_signature", "n.header_signature").alias("header_signature"),
        F.when(both, F.col("n.saved_at")).otherwise(F.col("o.last_used_at")).alias("last_used_at"),
    )


def delete_templates(templates: DataFrame, names: DataFrame) -> DataFrame:
    return templates.join(names, "name", "left_anti")
