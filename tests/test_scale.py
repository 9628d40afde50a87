"""What moves, is stored and is worked out for a row, as tables grow."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from feedloom.functions.hashing import packed
from feedloom.operators import apply, validate
from feedloom.session import stage

ROW = "import_id bigint, row_number bigint, batch_number bigint, catalog_id bigint, sku string, row_hash string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def loads(spark):
    rows = [(i, n, 1, None if n % 17 == 0 else n % 2, f"s{n % 7}", f"{(i * n) % 5:02x}" * 32) for i in range(1, 200, 9) for n in range(1, 30)]
    products = spark.createDataFrame([(1, "s1", "01" * 32), (0, "s2", "odd hash"), (None, "s3", "00" * 32)], "catalog_id bigint, sku string, row_hash string")
    return stage(spark.createDataFrame(rows, ROW), "rows"), stage(products, "products")


def test_rows_move_once_for_their_actions(spark):
    rows, products = loads(spark)
    told = apply.apply_actions(rows, products)
    assert plan_of(told.drop("row_hash")).count("hashpartitioning") == 1
    shown = lambda df: sorted(map(str, df.select(*rows.columns, "action").collect()))
    hot = rows.select(*apply.KEY).filter("sku in ('s1', 's2')").distinct()
    assert shown(told) == shown(apply._actions_in_blocks(rows, products, None, 10**6)) == shown(apply.apply_actions(rows, products, hot))
    assert {r.action for r in told.collect()} == {"create", "update", "skip"}


def test_hot_keys_are_found_whatever_slot_they_share(spark, monkeypatch):
    rows, _ = loads(spark)
    want = sorted(map(str, rows.groupBy(*apply.KEY).count().filter("count > 45").select(*apply.KEY).collect()))
    assert want
    for slots in (1, 3, 1 << 16):
        monkeypatch.setattr(apply, "KEY_SLOTS", slots)
        assert sorted(map(str, apply.hot_keys(rows, 45).collect())) == want
        assert apply.hot_keys(rows, 10**6) is None


def test_packed_digests_are_told_apart_as_their_texts_are(spark):
    texts = ["", "0", "00", "00ff", "00FF", "\u0000", "g0", "ab" * 32, None, "\u0001\u0000"]
    found = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(packed(F.col("t")).alias("p")).collect()]
    assert len({None if p is None else bytes(p) for p in found}) == len(texts) and len(found[7]) == 33 and found[8] is None


def test_a_ledger_is_stored_and_rows_are_not(spark, monkeypatch):
    """Rows with their actions were written as a whole to be counted by batch."""
    from workload import derive

    staged = {}
    monkeypatch.setattr(derive, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    t = derive.Tables(spark, "/root/testdata/sf0.001")
    total = t.full_ledger.agg(F.sum(F.col("created_count") + F.col("updated_count") + F.col("skipped_count"))).first()[0]
    assert total == t.valid.count() and "actions" not in staged
    assert staged["ledger"].count() == t.full_ledger.count()


def test_audit_texts_are_json_and_compiled(spark):
    odd = ['a "b" \\ c', "\u0001\n\t", "café   \U0001f600", "", "plain ~", None]
    change = "array<struct<field:string,old:string,new:string>>"
    rows = [(1, n, 1, 1, "s", a, [("name", x, y), ("stock", "1", None)]) for n, (x, y) in enumerate(zip(odd, odd[::-1])) for a in ("create", "update")]
    rows += [(2, 1, 1, 1, "s", "update", []), (2, 2, 1, 1, "s", "update", [(f, "1", "2") for f in apply.PRODUCT_FIELDS])]
    changes = spark.createDataFrame(rows, f"import_id bigint, row_number bigint, batch_number bigint, catalog_id bigint, sku string, action string, changes {change}")
    shown = apply.changes_json(changes)
    assert "lambdafunction" not in shown._jdf.queryExecution().optimizedPlan().toString()
    for given, found in zip(rows, shown.collect(), strict=True):
        value = lambda f, v: v if v is None or f not in ("price_cents", "stock") else int(v)
        want = {f: value(f, new) if given[5] == "create" else [value(f, old), value(f, new)] for f, old, new in given[6]}
        assert json.loads(found.fields_json) == want and list(json.loads(found.fields_json)) == list(want)


def test_changed_fields_are_listed_compiled(spark):
    fields = ", ".join(f"w_{f} struct<v:string>, old_w_{f} struct<v:string>" for f in apply.PRODUCT_FIELDS)
    row = lambda action, *pairs: (1, 1, 1, 1, "s", action, *[v and (v,) if v != "null" else (None,) for p in pairs for v in p])
    update = row("update", ("n", "o"), ("1", "1"), (None, "2"), ("null", "c"), ("d", None), ("null", "null"))
    create = row("create", ("n", None), ("1", None), ("0", None), ("null", None), ("d", None), ("null", None))
    given = spark.createDataFrame([update, create], f"import_id bigint, row_number bigint, batch_number bigint, catalog_id bigint, sku string, action string, {fields}")
    found = apply.field_changes(given, given)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
    listed = {r.action: [tuple(c) for c in r.changes] for r in found.collect()}
    assert listed["update"] == [("name", "o", "n"), ("category", "c", None), ("description", None, "d")]
    assert listed["create"] == [("name", None, "n"), ("price_cents", None, "1"), ("stock", None, "0"), ("description", None, "d")]


def test_repeated_skus_are_found_in_one_move(spark, monkeypatch):
    rows = stage(spark.createDataFrame([(i, n, f"s{n % 3}", True, False) for i in (1, 2) for n in range(1, 20)], "import_id bigint, row_number bigint, sku string, valid boolean, has_replacement boolean"), "rows")
    short = validate.duplicate_skus(rows)
    assert plan_of(short).count("hashpartitioning") == 1
    found = sorted(map(str, short.collect()))
    monkeypatch.setattr(validate, "BLOCK_ROWS", 4)
    assert sorted(map(str, validate.duplicate_skus(rows).select(*short.columns).collect())) == found and len(found) == 32


def test_pages_take_no_file_for_each_list_and_rows_once(spark, tmp_path):
    from feedloom.sources import pages

    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    rows = [(i, n, "ab"[n % 2]) for i in range(300) for n in range(1, 12)]
    df = spark.createDataFrame(rows, "import_id bigint, row_number bigint, code string")
    once = df.withColumn("row_number", F.udf(count, "bigint")("row_number"))
    pages.write_pages(once, str(tmp_path / "pages"), "import_id", F.call_function("div", F.col("row_number"), F.lit(4)), ("row_number",), ("code",), 2)
    assert seen.value == len(rows)
    assert len(list((tmp_path / "pages" / "rows").rglob("*.parquet"))) <= 8
    for code, page, size in ((None, 2, 3), (None, 1, 50), ("a", 2, 2), ("b", 3, 2), (None, 9, 3)):
        own = [n for i, n, c in rows if i == 7 and code in (None, c)]
        found = pages.read_page(spark, str(tmp_path / "pages"), "import_id", 7, page, size, code=code).collect()
        assert [r.row_number for r in found] == own[(page - 1) * size : page * size]
        assert {(r.import_id, r.total) for r in found} <= {(7, len(own))}


def test_hashes_move_as_bytes_in_a_dry_run(spark):
    from feedloom.operators import diff

    rows, products = loads(spark)
    last = diff.last_wins(rows)
    want = {(r.import_id, r.catalog_id, r.sku): (r.row_number, r.row_hash) for r in rows.orderBy("import_id", "row_number").collect()}
    assert {(r.import_id, r.catalog_id, r.sku): (r.row_number, r.row_hash) for r in last.collect()} == want
    counts = diff.dry_run_counts(diff.dry_run(last, products))
    assert counts.agg(F.sum("would_create"), F.sum("would_update"), F.sum("would_skip")).first()[:] == tuple(
        map(sum, zip(*[((s := {(1, "s1"): "01" * 32, (0, "s2"): "odd hash"}.get(k[1:])) is None, s is not None and s != v[1], s == v[1]) for k, v in want.items()]))
    )
    moved = [line for line in plan_of(diff.dry_run(last, products).select("import_id", "action")).splitlines() if "Project" in line]
    assert moved and "_digest" in "".join(moved)


def test_feed_files_take_no_folder_each(spark, tmp_path):
    from workload import derive

    rows = [(i, n, f"{i};é́€\U0001f600{n}\nx") for i in (*range(600), None) for n in (2, 1, 3)]
    lines = spark.createDataFrame(rows, "file_id bigint, at int, value string").repartition(5, "file_id").sortWithinPartitions("file_id", "at")
    for name, codec in ((None, "utf-8"), *derive.ENCODINGS.items()):
        out = tmp_path / str(name)
        derive.write_lines(lines, f"file://{out}" if name else str(out), None if name is None else F.lit(name))
        files = {f.name: f for f in out.rglob("*.csv")}
        assert set(files) == {f"file_id={i}.csv" for i in (*range(600), "__HIVE_DEFAULT_PARTITION__")}
        assert not [f for f in out.rglob(".*")] and len({f.parent for f in files.values()}) <= derive.FOLDERS
        want = "".join(f"77;é́€\U0001f600{n}\nx\n" for n in (1, 2, 3))
        assert files["file_id=77.csv"].read_bytes() == want.encode(codec, "replace")
        assert all(name is None or f"encoding={name}" in f.parts for f in map(lambda p: p.relative_to(tmp_path), files.values()))


def test_a_listing_is_joined_only_for_empty_files(spark, tmp_path):
    from feedloom.sources import files

    for n in range(5):
        (tmp_path / f"{n}.csv").write_text("a" * (n + 1))
    listed = files.listing(spark, str(tmp_path))
    assert "Join" not in plan_of(listed) and sorted(r.size for r in listed.collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "none.csv").write_text("")
    assert sorted(r.size for r in files.listing(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4, 5]


def test_files_are_read_many_to_a_batch(spark, tmp_path):
    """A value for each file, null where one is gone, ids kept whole; rows went back to Spark one by one."""
    from feedloom.sources import files

    for n in range(150):
        (tmp_path / f"{n}.csv").write_bytes(b"x" * n)
    named = spark.createDataFrame([(f"file://{tmp_path}/{n}.csv", 2**60 + n) for n in range(160)], "path string, import_id bigint").coalesce(1)
    found = {r.import_id - 2**60: r.size for r in files.with_size(named).collect()}
    assert found == {n: n if n < 150 else None for n in range(160)}


def test_a_report_stores_no_values_of_rows(spark):
    from feedloom.plans.load import validate_feeds
    from feedloom.rules import CONTRACT, FIELDS

    rows = [(1, n, cells) for n, cells in enumerate((["sku", "name", "price"], ["a", "b", "1"], ["a", "b", "x"], ["a", "c", "2"], ["", "d�", "3"]), 1)]
    records = stage(spark.createDataFrame(rows, "import_id bigint, row_number bigint, cells array<string>"), "records")
    imports = spark.createDataFrame([(1, 1, list(FIELDS[:3]), {f: f for f in FIELDS[:3]})], "import_id bigint, catalog_id bigint, headers array<string>, mapping map<string,string>")
    whole, alone = (validate_feeds(records, imports, None, CONTRACT, load=load) for load in (True, False))
    assert "row_hash" in whole.validated.columns and not {"row_hash", "name"} & set(alone.validated.columns)
    for part in ("report", "totals", "outcomes"):
        shown = [sorted(map(str, getattr(done, part).collect())) for done in (whole, alone)]
        assert shown[0] == shown[1] and shown[0]
