"""What plans and stored tables must not do as inputs grow: work out rules twice, or write a file for each import."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators.validate import row_findings, validate_rows
from feedloom.rules import CODED, CONTRACT, FIELDS
from feedloom.sources import report


def patterns(df, phase: str) -> int:
    return getattr(df._jdf.queryExecution(), phase)().toString().count("RLIKE")


def test_findings_are_worked_out_once(spark):
    schema = "import_id bigint, catalog_id bigint, row_number bigint, n_cells int, n_headers int, has_replacement boolean"
    rows = spark.createDataFrame([(n, 1, 1, 7, 7, False) for n in range(3)], schema)
    cells = [F.concat(F.lit(f), F.col("import_id").cast("string")).alias(f"{f}_raw") for f in FIELDS]
    mapped = rows.select("*", *cells, *[F.lit(f).alias(f"col_{f}") for f in FIELDS])
    validated = validate_rows(mapped, CONTRACT)
    found = row_findings(validated).filter("code = 'url_invalid'")
    assert patterns(found, "optimizedPlan") <= patterns(validated, "optimizedPlan")
    assert found.count() == 3
    assert not row_findings(validated.withColumn("findings", F.filter("findings", lambda f: F.lit(False)))).count()


def test_findings_need_no_file_for_each_import(spark, tmp_path):
    found = spark.sql(
        "select nullif(id % 300, 299) import_id, 'validate' phase, id row_number, 'sku' column_name, 'c' code, 'error' severity, 'm' message from range(900)"
    )
    imports = spark.range(300).withColumnRenamed("id", "import_id")
    for rules in (CODED, CONTRACT):
        path = str(tmp_path / rules.name)
        report.write_findings(found, path, rules, imports)
        assert len(list((tmp_path / rules.name).rglob("*.parquet"))) <= 8
        report.write_findings(found.filter("import_id = 7").limit(1), path, rules, imports.filter("import_id % 3 = 1"))
        stored = report.read_findings(spark, path)
        assert stored.columns == ["import_id", "row_number", "column_name", "code", "severity", "message", "phase"]
        assert stored.filter("import_id is null").count() == 3 and stored.filter("import_id = 7").count() == 1
        assert stored.count() == 3 * 200 + 1


def test_rows_are_counted_once_for_a_cap(spark, monkeypatch):
    """What `row_cap` found is used as it is, not counted again by reading every record once more."""
    from feedloom.operators import validate
    from feedloom.rules import CONTRACT

    rows = [(1, 1, ["a"]), (1, 2, ["b"]), (2, 1, ["c"]), (2, 2, [" "]), (None, 1, ["d"])]
    records = spark.createDataFrame(rows, "import_id long, row_number long, cells array<string>")
    plain = sorted(map(str, validate.within_cap(records, CONTRACT, 1).collect()))
    capped = validate.row_cap(records, CONTRACT, 1)

    def refuse(*_):
        raise AssertionError("counted twice")

    monkeypatch.setattr(validate, "row_cap", refuse)
    assert sorted(map(str, validate.within_cap(records, CONTRACT, 1, capped).collect())) == plain
    assert len(plain) == 2


def test_cells_are_built_once_for_the_look_at_blank_ones(spark):
    from workload.derive import Tables

    raw = [(1, 1, "a"), (1, 2, "z"), (1, 3, " "), (1, 4, None), (None, 5, "b"), (1, 1, "a")]
    rows = spark.createDataFrame(raw, "import_id long, row_number long, x string")
    t = Tables(spark, "none")
    t.__dict__["records"] = rows.withColumn("cells", F.when(F.col("x").rlike("z"), F.array(F.lit("\t"))).otherwise(F.array("x", F.lit("y")))).drop("x")
    assert patterns(t.data, "optimizedPlan") == 1
    kept = sorted((r.import_id or 0, r.row_number, tuple(r.cells)) for r in t.data.collect())
    assert kept == [(0, 5, ("b", "y")), (1, 1, ("a", "y")), (1, 1, ("a", "y")), (1, 3, (" ", "y")), (1, 4, (None, "y"))]


def test_findings_are_compiled_and_in_order(spark):
    schema = "import_id bigint, catalog_id bigint, row_number bigint, n_cells int, n_headers int, has_replacement boolean"
    rows = spark.createDataFrame([(1, 1, 1, 7, 7, True), (1, 1, 2, 6, 7, False)], schema)
    given = {"sku": "", "name": " ", "price": "1,2,3", "stock": "x", "category": "c" * 200, "description": "", "image_url": "/a"}
    cells = [F.lit(v).alias(f"{f}_raw") for f, v in given.items()]
    validated = validate_rows(rows.select("*", *cells, *[F.lit(f).alias(f"col_{f}") for f in FIELDS]), CONTRACT)
    assert "lambdafunction" not in validated._jdf.queryExecution().optimizedPlan().toString()
    found = {r.row_number: [f.code for f in r.findings] for r in validated.collect()}
    assert found == {
        1: ["missing_required", "missing_required", "price_invalid", "stock_invalid", "field_too_long", "url_invalid", "encoding_replacement"],
        2: ["columns_mismatch"],
    }


def test_rows_are_derived_once_for_all_encodings(spark, tmp_path, monkeypatch):
    """Files in four encodings are four writes; the window and the join that make their rows are no part of them."""
    from workload import derive

    lines = [(s, k, 1, 7, 10.0 + k, 99.5, "x") for s in range(5) for k in range(3)] + [(0, 0, 1, 7, 10.0, 99.5, "x")]
    schema = "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate string"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("select 7L p_partkey, 'n' p_name, 'b' p_brand, 't' p_type").write.parquet(str(tmp_path / "part.parquet"))
    t = derive.Tables(spark, str(tmp_path))
    found = {}

    def keep(build):
        rows = build(t)
        found["plan"] = rows._jdf.queryExecution().optimizedPlan().toString()
        return rows

    plain = derive.Tables._feed_lines
    monkeypatch.setattr(derive.Tables, "_feed_lines", lambda self: keep(plain))
    _, files = t.encoded_files()
    assert "Window" not in found["plan"] and "Join" not in found["plan"]
    assert sorted(r.encoding for r in files.collect()) == sorted(["utf-8", "utf-16le", "utf-16be", "windows-1252", "windows-1252"])
