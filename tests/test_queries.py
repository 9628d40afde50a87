"""Registered queries against their SQL statements on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = (
    "row_report", "dry_run_counts", "apply_actions", "apply_changes", "merged_catalog", "resume_rows", "detect_feeds",
    "map_columns", "parse_price", "validation_totals", "feed_scan", "stream_report", "feed_listing", "feed_preview",
    "header_rule", "report_csv_coded", "report_files", "report_store", "row_report_coded", "import_outcomes",
    "report_replace", "report_page", "import_page", "product_search", "reimport_noop", "load_resume", "load_audit",
    "apply_hot", "feed_scan_encodings", "feed_admission_files", "feed_preview_files", "store_buckets", "store_counts",
    "report_page_stored", "change_page_stored", "product_search_indexed",
)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = queries()[name](spark, FOLDER)
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
