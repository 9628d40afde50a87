"""Limits, codes and the two rule presets."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: limits -------------------------------------------------------------------
SAMPLE_BYTES = 65536
SAMPLE_RECORDS = 50
PREVIEW_ROWS = 20
ROW_CAP = 500_000
FILE_CAP_BYTES = 200 * 1024 * 1024
BATCH_SIZE = 1000
PRICE_MAX_CENTS = 9_999_999_999
STOCK_MAX = 1_000_000_000
EXCERPT_CHARS = 64
FILENAME_CHARS = 255
LENGTH_CAPS = {"sku": 64, "name": 256, "category": 128, "description": 8192, "image_url": 2048}

# --- fixed values: vocabularies -------------------------------------------------------------
FIELDS = ("sku", "name", "price", "stock", "category", "description", "image_url")
REQUIRED_FIELDS = ("sku", "name", "price")
OPTIONAL_FIELDS = ("stock", "category", "description", "image_url")
ENCODINGS = ("utf-8", "utf-16le", "utf-16be", "windows-1252")
DELIMITERS = (",", ";", "\t", "|")
STATES = (
    "uploaded",
    "validating",
    "validated",
    "applying",
    "completed",
    "paused",
    "cancelled",
    "failed",
)

# Values of a product row, and the value a create gives to a field the mapping leaves out.
PRODUCT_FIELDS = ("name", "price_cents", "stock", "category", "description", "image_url")


@dataclass(frozen=True)
class Rules:
    """One reading of the places where the shipped behaviour and the written contract differ."""

    name: str
    dense_row_numbers: bool  # count data rows from 1 instead of file records
    length_caps: bool  # report field_too_long
    bad_url_is_error: bool  # else a bad image URL silently becomes null
    url_text_rules: bool  # NFC and control stripping on the URL, not only a trim
    replacement_warning: bool  # report encoding_replacement
    hash_mapped_only: bool  # hash covers the mapped fields only
    hash_price_key: str
    blank_stock_is_null: bool  # blank stock hashes as null and is left out of updates
    escape_prefix_always: bool  # formula prefix also inside quoted report cells
    report_columns: tuple[str, ...]
    page_size: int
    page_max: int
    replace_all_phases: bool  # re-validation drops every phase of the old report
    message_excerpts: bool  # cell values inside messages are capped
    ordered_signature: bool  # sha256 over ordered headers, else sorted and joined by a bar


CODED = Rules(
    name="coded",
    dense_row_numbers=True,
    length_caps=False,
    bad_url_is_error=False,
    url_text_rules=False,
    replacement_warning=False,
    hash_mapped_only=False,
    hash_price_key="price_cents",
    blank_stock_is_null=False,
    escape_prefix_always=False,
    report_columns=("row_number", "phase", "column_name", "code", "severity", "message"),
    page_size=20,
    page_max=100,
    replace_all_phases=True,
    message_excerpts=False,
    ordered_signature=False,
)

CONTRACT = Rules(
    name="contract",
    dense_row_numbers=False,
    length_caps=True,
    bad_url_is_error=True,
    url_text_rules=True,
    replacement_warning=True,
    hash_mapped_only=True,
    hash_price_key="price",
    blank_stock_is_null=True,
    escape_prefix_always=True,
    report_columns=("row_number", "phase", "severity", "column_name", "code", "message"),
    page_size=50,
    page_max=200,
    replace_all_phases=False,
    message_excerpts=True,
    ordered_signature=True,
)
