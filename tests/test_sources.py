"""Real bytes through the readers, the report sink and the version store."""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedloom.operators import detect, groups, mapping, validate, views
from feedloom.operators.groups import block_of
from feedloom.plans.load import data_records, intact, load_feeds, validate_feeds
from feedloom.rules import CODED, CONTRACT, FIELDS
from feedloom.sources import feed, files, pages, ranges, report, search, store
from feedloom.streaming import jobs
from feedloom.streaming.jobs import stream_loads, stream_reports

TEXT = "sku;name;price\nA-1;Ançi \U0001f600;9,99\n\n\"B;2\";5\" bolt;1,50\nC;\"say \"\"x\"\"\";3\nshort;1"
FILES = {
    "plain.csv": (TEXT.encode(), "utf-8"),
    "bom.csv": (b"\xef\xbb\xbf" + TEXT.encode(), "utf-8"),
    "crlf.csv": (TEXT.replace("\n", "\r\n").encode(), "utf-8"),
    "le.csv": (b"\xff\xfe" + TEXT.encode("utf-16-le"), "utf-16le"),
    "be.csv": (b"\xfe\xff" + TEXT.encode("utf-16-be"), "utf-16be"),
    "old.csv": (TEXT.replace("\U0001f600", "€").encode("cp1252"), "windows-1252"),
    "multi.csv": (b'sku;name;price\n"A\n1";"x\r\n""y""";2\nlast;"open', "utf-8"),
    "bad.csv": (b"sku;name\n" + b"a;b\n" * 30000 + b"x;\xff\n", "utf-8"),
    "empty.csv": (b"", "utf-8"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("drop")
    for name, (content, _) in FILES.items():
        (path / name).write_bytes(content)
    return str(path)


def feeds_of(spark, folder):
    ids = spark.createDataFrame([(n, i, FILES[n][1], ";") for i, n in enumerate(FILES)], "name string, import_id bigint, encoding string, delimiter string")
    return files.list_feeds(spark, folder).withColumn("name", F.regexp_extract("path", "[^/]+$", 0)).join(ids, "name")


def test_listing_and_admission(spark, folder):
    rows = {r.name: r for r in feeds_of(spark, folder).withColumn("code", files.admission(F.col("size"), 100_000)).collect()}
    assert set(rows) == set(FILES)
    for name in rows:
        content = FILES[name][0]
        assert rows[name].size == len(content) and rows[name].sha256 == hashlib.sha256(content).hexdigest()
    assert {n: r.code for n, r in rows.items() if r.code} == {"bad.csv": "file_too_large", "empty.csv": "validation_failed"}
    admitted = files.admit(files.listing(spark, folder), 100_000).filter("code is null").count()
    assert admitted == len(FILES) - 2


def test_detection_of_files(spark, folder):
    found = detect.detect_feeds(files.feed_samples(spark, folder)).withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    rows = {r.name: r for r in found.collect()}
    for name in rows:
        assert rows[name].encoding == FILES[name][1], name
        if name not in ("bad.csv", "empty.csv"):
            assert (rows[name].delimiter, rows[name].headers) == (";", ["sku", "name", "price"]), name


def test_delimiters(spark):
    texts = [f"sku{d}name{d}price\nA{d}B{d}9\n" for d in ",;\t|"] + ["one column\nanother line\n", "a,b;c\nd,e;f\n", " sku , Príce \nA,1\n", ""]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "i int, content binary")
    rows = detect.detect_feeds(df).orderBy("i").collect()
    assert [r.delimiter for r in rows[:4]] == [",", ";", "\t", "|"]
    assert rows[4].delimiter_uncertain and rows[4].delimiter == "," and rows[5].delimiter == ","
    assert rows[6].headers == ["sku", "Príce"]
    assert rows[7].delimiter_uncertain and rows[7].headers == []


def test_read_feed(spark, folder):
    records = {}
    for r in feed.read_feed(spark, folder, feeds_of(spark, folder)).collect():
        records.setdefault(list(FILES)[r.import_id], {})[r.row_number] = r.cells
    want = [["sku", "name", "price"], ["A-1", "Ançi \U0001f600", "9,99"], [""], ["B;2", '5" bolt', "1,50"], ["C", 'say "x"', "3"], ["short", "1"]]
    for name in ("plain.csv", "bom.csv", "crlf.csv", "le.csv", "be.csv"):
        assert [records[name][i + 1] for i in range(6)] == want, name
    assert records["old.csv"][2][1] == "Ançi €"
    assert [records["multi.csv"][i] for i in (1, 2, 3)] == [["sku", "name", "price"], ["A\n1", 'x\r\n"y"', "2"], ["last", "open"]]
    assert len(records["bad.csv"]) == 30002 and records["bad.csv"][30002] == ["x", "�"]


def test_numbering_over_many_splits(spark, tmp_path):
    rng = random.Random(1)
    lines = [f"{i},{'v' * rng.randrange(40)}" for i in range(1, 20001)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        named = files.list_feeds(spark, str(tmp_path)).selectExpr("path", "7L import_id", "'utf-8' encoding", "',' delimiter")
        rows = feed.read_feed(spark, str(tmp_path), named)
        assert rows.filter("cast(cells[0] as bigint) <> row_number").count() == 0 and rows.count() == 20000
        assert feed.read_feed(spark, str(tmp_path), named, limit=21).count() == 21
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


ENCODED = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "windows-1252": "cp1252"}


def odd_csv(seed, n=400):
    """Records with line breaks, quotes and delimiters in any place; some cells are closed wrongly or never."""
    rng = random.Random(seed)
    pieces = ["a", "é", "\u0a0a" if seed % 2 else "ÿ", '"', '""', ";", "\n", "\r", "\r\n", " ", "word", '"x"', ';"', '";', '"\n', '"q\nr";']
    return "".join(rng.choice(pieces) for _ in range(n))


@pytest.mark.parametrize("encoding", sorted(ENCODED))
def test_ranges_cut_what_one_reader_cuts(tmp_path, encoding):
    for seed in range(60):
        text = odd_csv(seed)
        raw = text.encode(ENCODED[encoding], errors="replace")
        text = raw.decode(ENCODED[encoding])
        (tmp_path / "f.csv").write_bytes(raw)
        expected = list(feed.cut_records(io.StringIO(text, newline=""), ";"))
        system, name = ranges.locate(f"file://{tmp_path}/f.csv")
        for size in (2, 10, 64, 10_000):
            inside, found = False, []
            with system.open_input_file(name) as file:
                whole = ranges.RangedText(file, encoding)
                for start in range(0, whole.size, size):
                    first = whole.line_start(start, start + size)
                    if first is None:
                        continue
                    out, within, n_out, n_in = ranges.transition(whole.lines(first, start + size), ";")
                    rest = ranges.records_from(whole.lines(first), inside, ";")
                    found += itertools.islice(feed.cut_records(rest, ";"), n_in if inside else n_out)
                    inside = within if inside else out
            assert found == expected, (seed, size)


def test_lines_over_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK_BYTES", 8)
    for seed in range(20):
        text = odd_csv(seed, 120)
        (tmp_path / "f.csv").write_bytes(b"\xff\xfe" + text.encode("utf-16-le"))
        system, name = ranges.locate(f"file://{tmp_path}/f.csv")
        with system.open_input_file(name) as file:
            assert list(ranges.RangedText(file, "utf-16le").lines(0)) == list(io.StringIO(text, newline=""))


@pytest.mark.parametrize("encoding", sorted(ENCODED))
def test_one_file_over_many_ranges(spark, tmp_path, encoding):
    """A broken quote every few records: each record lands once, in its place, and many tasks read the file."""
    rows = [[str(i), "two\nlines" if i % 7 == 0 else 'a "b" é' if i % 5 == 0 else "plain", "x" * (i % 40)] for i in range(3000)]
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="\r\n").writerows(rows)
    (tmp_path / "big.csv").write_bytes(out.getvalue().encode(ENCODED[encoding]))
    (tmp_path / "open.csv").write_bytes(('1;2\n3;"never closed;\n' + "4;5\n" * 2000).encode(ENCODED[encoding]))
    named = files.listing(spark, str(tmp_path)).selectExpr(
        "path", "if(path like '%big.csv', 7L, 8L) import_id", f"'{encoding}' encoding", "';' delimiter"
    )
    found = feed.read_feed(spark, str(tmp_path), named, range_bytes=4096).withColumn("task", F.spark_partition_id()).collect()
    big = sorted((r for r in found if r.import_id == 7), key=lambda r: r.row_number)
    assert [r.row_number for r in big] == list(range(1, 3001)) and [r.cells for r in big] == rows
    assert len({r.task for r in big}) > 1
    odd = {r.row_number: r.cells for r in found if r.import_id == 8}
    assert odd == {1: ["1", "2"], 2: ["3", "never closed;\n" + "4;5\n" * 2000]}


def test_heads_of_a_file_of_any_size(spark, tmp_path):
    """A file of a terabyte, nearly all of it a hole: listing, samples and previews read its head only."""
    with open(tmp_path / "huge.csv", "wb") as f:
        f.write(b"\n \nsku,name\n" + b'A,"two\nlines"\n\n' * 30)
        f.truncate(1 << 40)
    named = files.listing(spark, str(tmp_path)).selectExpr("path", "size", "1L import_id", "'utf-8' encoding", "',' delimiter")
    assert [r.size for r in named.collect()] == [1 << 40]
    assert [len(r.content) for r in files.feed_samples(spark, str(tmp_path), 100).collect()] == [100]
    shown = feed.preview_files(named, 4).orderBy("row_number").collect()
    assert [(r.row_number, r.cells) for r in shown] == [(3, ["sku", "name"]), (4, ["A", "two\nlines"]), (6, ["A", "two\nlines"])]
    assert feed.read_feed(spark, str(tmp_path), named, limit=5).count() == 5


def test_file_over_the_cap_is_refused(spark, folder):
    with pytest.raises(PySparkException, match="admit feeds first"):
        feed.read_feed(spark, folder, feeds_of(spark, folder), cap=10).collect()


def test_cut_records_is_csv():
    rng = random.Random(5)
    rows = [["".join(rng.choice('ab",\n\r') for _ in range(rng.randrange(6))) for _ in range(3)] for _ in range(400)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    out.seek(0)
    assert list(feed.cut_records(io.StringIO(out.getvalue(), newline=""), ",")) == rows


CSV = ["SKU,Name,Price,Stock", "A,Anvil,9.99,5", "B,Bolt,x,1", "A,Anvil,10.99,", "C,Cog,1.5,2", ",No sku,1,1", "D,=evil,1,1,9", "E,Egg,2,-1"]


def load_inputs(spark, folder, lines, name="f.csv", import_id=1):
    (folder / name).write_text("\n".join(lines) + "\n")
    fields = dict(zip(FIELDS, ["SKU", "Name", "Price", "Stock"]))
    imports = files.list_feeds(spark, str(folder)).select(
        "path", F.lit(import_id).cast("bigint").alias("import_id"), F.lit(1).cast("bigint").alias("catalog_id"), F.lit("utf-8").alias("encoding"),
        F.lit(",").alias("delimiter"), F.array(*[F.lit(h) for h in fields.values()]).alias("headers"),
        F.create_map(*[F.lit(x) for pair in fields.items() for x in pair]).alias("mapping"),
    )
    return imports, feed.read_feed(spark, str(folder), imports)


def test_load_twice_and_after_a_lost_commit(spark, tmp_path):
    drop, root = tmp_path / "drop", str(tmp_path / "store")
    drop.mkdir()
    imports, records = load_inputs(spark, drop, CSV)
    done = validate_feeds(records, imports, store.read_products(spark, root), CONTRACT)
    assert {(r.row_number, r.code) for r in done.report.collect()} == {
        (3, "price_invalid"), (4, "duplicate_sku"), (6, "missing_required"), (7, "columns_mismatch"), (8, "stock_negative")}
    assert [tuple(r) for r in done.totals.collect()] == [(1, 7, 4, 1)]
    assert [tuple(r) for r in done.counts.collect()] == [(1, 2, 0, 0)]

    # A load that wrote its tables but died before the commit file stays invisible.
    nothing = store.read_products(spark, root)
    nothing.write.mode("overwrite").parquet(f"{root}/products/load=lost/catalog_id=1")
    assert store.read_products(spark, root).count() == 0 and store.last_version(spark, root) == 0

    assert load_feeds(spark, root, done.validated, CONTRACT, batch_size=2) == 1
    first = {r.sku: r for r in store.read_products(spark, root).collect()}
    assert set(first) == {"A", "C"} and (first["A"].price_cents, first["A"].stock) == (1099, 5)
    ledger = sorted(map(tuple, store.read_ledger(spark, root).collect()))
    assert ledger == [(1, 1, 2, 4, 1, 1, 0), (1, 2, 5, 5, 1, 0, 0)]
    changes = {(r.row_number, r.action): r.fields_json for r in store.read_changes(spark, root).collect()}
    assert changes[(4, "update")] == '{"price_cents":[999,1099]}'
    assert changes[(2, "create")] == '{"name":"Anvil","price_cents":999,"stock":5}'

    assert load_feeds(spark, root, done.validated, CONTRACT, batch_size=2) == 1  # ledger holds every batch
    assert {r.sku: r for r in store.read_products(spark, root).collect()} == first

    # The rows that were last to write their product change nothing in a new import.
    imports, records = load_inputs(spark, drop, [CSV[0], CSV[3], CSV[4]], import_id=2)
    again = validate_feeds(records, imports, store.read_products(spark, root), CONTRACT)
    assert [tuple(r) for r in again.counts.collect()] == [(2, 0, 0, 2)]


def test_stream_load_equals_batch(spark, tmp_path):
    drop, state = tmp_path / "drop", str(tmp_path / "state")
    drop.mkdir()
    imports, records = load_inputs(spark, drop, CSV)
    kept = data_records(records)
    validated = validate.validate_rows(mapping.map_columns(kept, imports), CONTRACT)
    roots = [str(tmp_path / r) for r in ("batch", "stream")]
    load_feeds(spark, roots[0], validated, CONTRACT)
    stream_loads(spark, str(drop), imports, CONTRACT, roots[1], state).awaitTermination()
    # A lost stream state replays every file; the ledger keeps that from doing anything.
    stream_loads(spark, str(drop), imports, CONTRACT, roots[1], state + "2").awaitTermination()
    shown = [sorted(map(str, store.read_products(spark, r).drop("updated_at").collect())) for r in roots]
    assert shown[0] == shown[1] and len(shown[0]) == 2
    assert store.last_version(spark, roots[1]) == 1


def test_report_sink(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    imports, records = load_inputs(spark, drop, CSV)
    validated = validate.validate_rows(mapping.map_columns(data_records(records), imports), CONTRACT)
    found = validate.row_report(validated, CONTRACT)
    both = imports.select("import_id").unionByName(spark.createDataFrame([(2,)], "import_id bigint"))
    report.write_report(found, CONTRACT, out, both)
    parts = sorted((tmp_path / "out" / "import_id=1").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == "row_number,phase,severity,column,code,message" and len(lines) == 6
    assert [int(line.split(",")[0]) for line in lines[1:]] == [3, 4, 6, 7, 8]
    clean = "".join(p.read_text() for p in (tmp_path / "out" / "import_id=2").glob("part-*"))
    assert clean == "row_number,phase,severity,column,code,message\n"  # an import without findings has its header
    for rules in (CODED, CONTRACT):
        stored = str(tmp_path / f"findings-{rules.name}")
        for _ in range(2):  # validating again replaces, never adds
            report.write_findings(found, stored, rules, imports)
        assert report.read_findings(spark, stored).count() == 5
        report.write_findings(found.limit(0), stored, rules, imports)  # and a clean import loses what it had
        assert report.read_findings(spark, stored).count() == 0


def test_every_import_has_an_outcome(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    imports, records = load_inputs(spark, drop, CSV)
    more = spark.createDataFrame([(2, None), (3, {"sku": "SKU"})], "import_id bigint, mapping map<string,string>")
    imports = imports.unionByName(more, allowMissingColumns=True)
    records = records.unionByName(records.withColumn("import_id", F.lit(2).cast("bigint")))
    nothing = store.read_products(spark, str(tmp_path / "store"))
    shown = lambda cap: {tuple(r) for r in validate_feeds(records, imports, nothing, CONTRACT, cap).outcomes.collect()}
    rest = {(2, "failed", "no_mapping") + (None,) * 6, (3, "validated", None) + (0,) * 6}
    assert shown(None) == {(1, "validated", None, 7, 4, 1, 2, 0, 0)} | rest
    assert shown(5) == {(1, "failed", "row_limit_exceeded") + (None,) * 6} | rest
    assert shown(7) == shown(None)


def test_header_behind_blank_records(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    imports, records = load_inputs(spark, drop, ["", " ", *CSV])
    assert [r.row_number for r in feed.preview(records).orderBy("row_number").collect()] == list(range(3, 11))
    done = validate_feeds(records, imports, store.read_products(spark, str(tmp_path / "store")), CONTRACT)
    assert sorted(r.row_number for r in done.report.collect()) == [5, 6, 8, 9, 10]
    coded = validate_feeds(records, imports, store.read_products(spark, str(tmp_path / "store")), CODED)
    assert {r.row_number for r in coded.report.filter("code = 'price_invalid'").collect()} == {2}


def numbered(spark, import_id, rows, price):
    return [(import_id, 1, n, f"S{n}", f"Name {n}", price) for n in rows]


def as_validated(spark, rows):
    lines = spark.createDataFrame(rows, "import_id bigint, catalog_id bigint, row_number bigint, sku string, name string, price_cents bigint")
    return lines.selectExpr(
        "*", "0L stock", "string(null) category", "string(null) description", "string(null) image_url",
        "true valid", "array() findings", "false has_replacement", "false sets_stock", "false sets_category",
        "false sets_description", "false sets_image_url", "sha2(concat(sku, price_cents), 256) row_hash",
    )


def test_loads_with_changing_batch_sizes(spark, tmp_path):
    one, two = (as_validated(spark, numbered(spark, i, range(1, 9), p)) for i, p in ((1, 100), (2, 200)))
    prices = lambda root: {r.sku: r.price_cents for r in store.read_products(spark, root).collect()}

    root = str(tmp_path / "newer")  # a repeat with another size must not bring older data back
    for rows, size in ((one, 4), (two, 4), (one, 2)):
        load_feeds(spark, root, rows, CONTRACT, batch_size=size)
    assert set(prices(root).values()) == {200} and store.last_version(spark, root) == 2

    root = str(tmp_path / "rest")  # nor must it leave rows out
    load_feeds(spark, root, one.filter("row_number <= 4"), CONTRACT, batch_size=2)
    load_feeds(spark, root, one, CONTRACT, batch_size=4)
    assert set(prices(root)) == {f"S{n}" for n in range(1, 9)}
    ledger = sorted((r.batch_number, r.first_row, r.last_row) for r in store.read_ledger(spark, root).collect())
    assert ledger == [(1, 1, 2), (2, 3, 4), (3, 5, 8)]


def test_own_batch_sizes_and_broken_files(spark, tmp_path):
    rows = as_validated(spark, numbered(spark, 1, range(1, 6), 100) + numbered(spark, 2, range(1, 6), 100))
    sizes = spark.createDataFrame([(1, 2), (2, None)], "import_id bigint, batch_size bigint")
    load_feeds(spark, str(tmp_path / "s"), rows, CONTRACT, imports=sizes)
    ledger = sorted((r.import_id, r.batch_number) for r in store.read_ledger(spark, str(tmp_path / "s")).collect())
    assert ledger == [(1, 1), (1, 2), (1, 3), (2, 1)]
    recorded = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "import_id bigint, path string, file_sha256 string")
    listing = spark.createDataFrame([("a", "x"), ("b", "other")], "path string, sha256 string")
    assert {r.import_id for r in intact(rows, recorded, listing).collect()} == {1}


def test_micro_batches_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    drop = tmp_path / "drop"
    drop.mkdir()
    imports, _ = load_inputs(spark, drop, CSV)
    (drop / "g.csv").write_text("\n".join(CSV) + "\n")
    for most, batches in ((1, 2), (1 << 20, 1)):
        monkeypatch.setattr(jobs, "BYTES_PER_BATCH", most)
        out, state = (str(tmp_path / f"{name}{most}") for name in ("out", "state"))
        stream_reports(spark, str(drop), imports, CONTRACT, out, state).awaitTermination()
        assert len(list(Path(out).glob("batch=*"))) == batches


def test_only_committed_folders_are_read(spark, tmp_path):
    root = str(tmp_path / "store")
    for n in range(5):
        load_feeds(spark, root, as_validated(spark, numbered(spark, n + 1, range(1, 4), 100 + n)), CONTRACT)
    scanned = {f.split("/products/")[1].rsplit("/", 1)[0] for f in store.read_products(spark, root).inputFiles()}
    newest = [r.load for r in spark.read.json(f"{root}/commits").orderBy("version").collect()][-1]
    assert scanned == {f"load={newest}/catalog_id=1/bucket=0"}


def test_a_load_writes_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path / "store")
    parts = lambda: {p.relative_to(root).parts[1] for p in (tmp_path / "store" / "products").glob("*/*/bucket=*")}
    first = as_validated(spark, numbered(spark, 1, range(1, 65), 100))
    load_feeds(spark, root, first, CONTRACT, bucket_rows=4)
    before = {(r.bucket, r.n_rows) for r in store._newest(spark, root).collect()}
    assert len(before) > 8 and sum(n for _, n in before) == 64
    old = parts()
    load_feeds(spark, root, as_validated(spark, numbered(spark, 2, [7], 200)), CONTRACT, bucket_rows=4)
    (load,) = parts() - old
    written = list((tmp_path / "store" / "products" / load).glob("*/bucket=*"))
    assert len(written) == 1  # of all the buckets
    prices = {r.sku: r.price_cents for r in store.read_products(spark, root).collect()}
    assert prices == {f"S{n}": 200 if n == 7 else 100 for n in range(1, 65)}
    # A catalog that outgrows its buckets is laid out anew, and nothing is lost or doubled.
    load_feeds(spark, root, as_validated(spark, numbered(spark, 3, range(60, 400), 300)), CONTRACT, bucket_rows=4)
    prices = {r.sku: r.price_cents for r in store.read_products(spark, root).collect()}
    assert prices == {f"S{n}": 300 if n >= 60 else 200 if n == 7 else 100 for n in range(1, 400)}
    assert store.read_products(spark, root).count() == 399
    assert [tuple(r) for r in store.product_counts(spark, root).collect()] == [(1, 399)]


def test_small_buckets_share_folders(spark, tmp_path):
    root = str(tmp_path / "store")
    load_feeds(spark, root, as_validated(spark, numbered(spark, 1, range(1, 65), 100)), CONTRACT, bucket_rows=4)
    assert store._newest(spark, root).count() > 8
    assert len(list((tmp_path / "store" / "products").glob("*/*/bucket=*"))) == 1
    load_feeds(spark, root, as_validated(spark, numbered(spark, 2, [7], 200)), CONTRACT, bucket_rows=4)
    kept = [(r.sku, r.price_cents) for r in store.read_products(spark, root).collect()]
    assert sorted(kept) == sorted((f"S{n}", 200 if n == 7 else 100) for n in range(1, 65))


def test_a_changed_file_fails_its_import_inside_the_job(spark, tmp_path):
    drop, root = tmp_path / "drop", str(tmp_path / "store")
    drop.mkdir()
    imports, records = load_inputs(spark, drop, CSV)
    hashed = imports.join(files.list_feeds(spark, str(drop)).selectExpr("path", "sha256 file_sha256"), "path")
    recorded = spark.createDataFrame(hashed.collect(), hashed.schema)
    done = validate_feeds(records, recorded, None, CONTRACT)
    done.validated.count()
    (row,) = done.outcomes.collect()
    assert tuple(row) == (1, "validated", None, 7, 4, 1, None, None, None)  # no catalog, no dry run
    (drop / "f.csv").write_text("SKU,Name,Price,Stock\nZ,Other,1,1\n")
    (row,) = validate_feeds(records, recorded, None, CONTRACT).outcomes.collect()
    assert (row.state, row.reason) == ("failed", "file_missing")
    load_feeds(spark, root, done.validated, CONTRACT, recorded=recorded)
    assert store.read_products(spark, root).count() == 0
    (drop / "f.csv").unlink()
    assert [r.import_id for r in files.changed_files(recorded).collect()] == [1]


def test_streams_take_each_import_s_batch_size(spark, tmp_path):
    drop, roots = tmp_path / "drop", [str(tmp_path / r) for r in ("batch", "stream")]
    drop.mkdir()
    imports, _ = load_inputs(spark, drop, CSV)
    (drop / "g.csv").write_text("\n".join(CSV) + "\n")
    listed = files.listing(spark, str(drop)).select("path", F.when(F.col("path").endswith("g.csv"), 2).otherwise(1).cast("bigint").alias("import_id"))
    sizes = F.when(F.col("import_id") == 2, 1).cast("bigint").alias("batch_size")
    both = listed.join(imports.drop("path", "import_id").limit(1), how="cross").select("*", sizes)
    both = spark.createDataFrame(both.collect(), both.schema)
    done = validate_feeds(feed.read_feed(spark, str(drop), both), both, None, CONTRACT)
    load_feeds(spark, roots[0], done.validated, CONTRACT, batch_size=2, imports=both)
    outcomes = str(tmp_path / "outcomes")
    stream_loads(spark, str(drop), both, CONTRACT, roots[1], str(tmp_path / "state"), 2, outcomes=outcomes).awaitTermination()
    ledgers = [sorted(map(tuple, store.read_ledger(spark, r).collect())) for r in roots]
    assert ledgers[0] == ledgers[1] and [r[1] for r in ledgers[0] if r[0] == 2] == [1, 2, 3]
    assert {r.import_id: r.would_create for r in spark.read.parquet(outcomes).collect()} == {1: 2, 2: 2}
    reports = str(tmp_path / "seen")
    stream_reports(spark, str(drop), both, CONTRACT, str(tmp_path / "out"), str(tmp_path / "s2"), outcomes=reports).awaitTermination()
    assert {(r.import_id, r.error_rows, r.would_create) for r in spark.read.parquet(reports).collect()} == {(1, 4, None), (2, 4, None)}


def test_pages_of_a_long_list(spark, tmp_path):
    rows = [(i, n, "abc"[n % 3] if i == 1 else "a") for i in (1, 2) for n in range(1, 2001)]
    df = spark.createDataFrame(rows, "import_id bigint, row_number bigint, code string")
    path = str(tmp_path / "pages")
    pages.write_pages(df, path, "import_id", block_of("row_number", 300), ("row_number",), ("code",), chunk_rows=50)
    for code, asked in ((None, ((2, 20), (80, 25), (9999, 20))), ("b", ((7, 60), (34, 20))), ("none", ((1, 20),))):
        own = [n for i, n, c in rows if i == 1 and code in (None, c)]
        for page, size in asked:
            shown = pages.read_page(spark, path, "import_id", 1, page, size, code=code)
            found = shown.orderBy("row_number").collect()
            assert [r.row_number for r in found] == own[(page - 1) * size : page * size]
            assert {r.total for r in found} <= {len(own)}
    late = pages.read_page(spark, path, "import_id", 1, 80, 25)
    scanned = late._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in scanned and "PartitionFilters" in scanned


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, f"P-{n}", "".join(rng.choice("abĀé r") for _ in range(rng.randrange(9)))) for c in (1, 2) for n in range(300)] + [(1, "x", None)]
    products = spark.createDataFrame(rows, "catalog_id bigint, sku string, name string").withColumn("price_cents", F.lit(1))
    path = str(tmp_path / "grams")
    search.write_index(products, path)
    for text, catalog in (("P-1", None), ("AB\u0101", 2), ("ra a", None), ("zzz", None), ("ab", 2)):
        found, scan = (
            sorted(map(str, df.collect()))
            for df in (search.search_indexed(products, path, text, catalog), views.search_products(products, text, catalog))
        )
        assert found == scan, text


def test_heavy_keys_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(groups, "BROADCAST_ROWS", 10)
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id")).cast("bigint").alias("k"), "id"
    )
    dimension = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(
        spark.createDataFrame([(7, 70)], "k bigint, v bigint")
    )
    heavy = groups.heavy_keys(rows, F.col("k"))
    assert heavy == [spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]]
    for how in ("left", "inner"):
        found = groups.heavy_join(rows, dimension, "k", how)
        assert sorted(map(str, found.collect())) == sorted(map(str, rows.join(dimension, "k", how).collect()))
    assert groups.heavy_keys(rows.limit(0), F.col("k")) == []


def test_row_cap(spark):
    rows = [(1, n, ["a", "b"]) for n in range(2, 7)] + [(1, 7, [""])] + [(2, n, ["a", "b"]) for n in range(2, 8)]
    records = spark.createDataFrame(rows, "import_id bigint, row_number bigint, cells array<string>")
    state = lambda rules, cap: {r.import_id: r.state for r in validate.row_cap(records, rules, cap).collect()}
    assert state(CONTRACT, 5) == {1: "validating", 2: "failed"} and state(CODED, 5) == {1: "failed", 2: "failed"}
    assert {r.import_id for r in validate.within_cap(records, CONTRACT, 5).collect()} == {1}
