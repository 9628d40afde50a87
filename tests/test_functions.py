"""Table tests of the scalar rules."""

from __future__ import annotations

import hashlib
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import csvtext, encoding, hashing, numbers, text, urls
from feedloom.rules import CODED, CONTRACT


def column(spark, values, build, schema="v string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


PRICES = [
    ("19.99", 1999), ("1,234.56", 123456), ("-10.00", "negative"), ("10.999", 1099900),
    ("$19.99", 1999), ("1,234", 123400), ("1234,567", 123456700), ("0.500", 50000),
    ("1,2,3.4", 12340), ("1.234,567", "precision"), ("1,234.5.6", "invalid"),
    ("1.234.567", 123456700), (".5", 50), ("5.", 500), (",123", "precision"),
    ("-$5", "negative"), ("$-5", "negative"), ("-0", 0), ("- $5 USD", "invalid"),
    ("1 234", "invalid"), ("1 234", 123400), ("1 234,50 EUR", 123450),
    ("-99999999999999", "out_of_range"), ("99999999.99", 9999999999),
    ("100000000", "out_of_range"), ("USD 5", 500), ("5 usd", 500), ("€ 5,5", 550),
    ("USDX5", "invalid"), ("5USD USD", "invalid"), ("$5$", "invalid"), ("--5", "invalid"),
    ("+5", "invalid"), ("- 5", "negative"), ("-USD5", "negative"), ("-5$", "negative"),
    ("", "invalid"), (".", "invalid"), ("USD", "invalid"), (",.5", 50), ("1.2.3", "invalid"),
    ("1,234,567.89", 123456789), ("1.234.567,89", 123456789), ("12,34,567", "invalid"),
    ("1  2", "invalid"), ("﻿ 7 　", 700), ("0000000000000000000001", 100),
    ("1e5", "invalid"), ("5\n", 500), ("١", "invalid"), ("1234.567.890", "invalid"),
    ("999,999,999,999", "out_of_range"), ("-0.00", 0), ("0.001", 100),
    ("$", "invalid"), ("12E", "invalid"), ("5 kg", "invalid"), ("abc", "invalid"),
]
STOCKS = [
    ("100", 100), ("50.00", 50), ("10.5", "invalid"), ("-5", "negative"), (",123", "invalid"),
    ("1000000000", 1000000000), ("1000000001", "out_of_range"), ("-99999999999999", "out_of_range"),
    ("1,234", 1234), ("5.", 5), (".0", 0), ("-0", 0), ("7.000", 7000), ("7.0000", 7), ("x", "invalid"),
]


@pytest.mark.parametrize("build,table", [(numbers.parse_price, PRICES), (numbers.parse_stock, STOCKS)])
def test_numbers(spark, build, table):
    got = column(spark, [raw for raw, _ in table], build)
    assert [(raw, r.value if r.error is None else r.error) for (raw, _), r in zip(table, got)] == table


def test_parse_decimal_parts(spark):
    got = column(spark, ["-1.234,5", "12,", "1.2.3", "$ 1,000"], numbers.parse_decimal)
    assert [tuple(r) if r else None for r in got] == [
        (True, "1234", "5"), (False, "12", ""), None, (False, "1000", "")]


def test_strip_currency(spark):
    cases = {
        "$5": ("5", True), "5 EUR": ("5", True), "EUR": ("EUR", False), "USD 5 EUR": ("5 EUR", True),
        "-$5": ("-$5", False), "12EURO": ("12E", True), "7": ("7", False), "5 €": ("5", True),
        "x \n5USD": ("x \n5", True),
    }
    got = column(spark, list(cases), numbers.strip_currency)
    assert [tuple(r) for r in got] == list(cases.values())


def test_price_display(spark):
    got = column(spark, [0, 5, 1099, 9999999999, -250], numbers.price_display, "v long")
    assert got == ["0.00", "0.05", "10.99", "99999999.99", "-2.50"]


def test_text(spark):
    raw = ["  hello  ", "hello\x00world", "é", "﻿a\tb　", "a\u0085b", "\u0007 x", "​"]
    assert column(spark, raw, text.normalize_text) == [
        "hello", "helloworld", "é", "a\tb", "ab", "x", "​"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_normalize_text_matches_statement(spark, values):
    values = [v.encode("utf-8", "replace").decode() for v in values]
    want = [
        "".join(c for c in unicodedata.normalize("NFC", v) if c not in text.CONTROLS).strip(text.WHITESPACE)
        for v in values
    ]
    assert column(spark, values, text.normalize_text) == want


def test_lengths_and_excerpts(spark):
    emoji = "\U0001f600"
    assert column(spark, ["a", emoji, "é" + emoji], text.utf16_length) == [1, 2, 3]
    assert column(spark, ["abc", "abcd", "ab" + emoji], lambda c: text.excerpt(c, 3)) == [
        "abc", "abc...", "ab�..."]
    assert column(spark, ["x" * 65, emoji * 33, emoji * 32], lambda c: text.longer_than(c, 64)) == [
        True, True, False]
    assert column(spark, ["a/b\\c\x00.csv", " \x01 ", "n" * 300], text.safe_filename) == [
        "a_b_c.csv", "upload.csv", "n" * 255]


def test_urls(spark):
    raw = ["http://example.com/image.png", "HTTPS://e", "/image.png", "", "  ", "http://", "ftp://x", "http://\nx"]
    got = column(spark, raw, urls.normalize_url)
    assert [r.error or r.value for r in got] == [
        raw[0], raw[1], "invalid", "", "", "invalid", "invalid", "invalid"]


def test_row_hash(spark):
    values = {
        "sku": F.lit("A"), "name": F.lit("N"), "price_cents": F.lit(5), "stock": F.lit(None).cast("long"),
        "category": F.lit(None).cast("string"), "description": F.lit("d"), "image_url": F.lit("u"),
    }
    mapped = {"stock": F.lit(True), "category": F.lit(False), "description": F.lit(True), "image_url": F.lit(False)}
    row = spark.range(1).select(
        hashing.row_hash(values, mapped, CODED).alias("a"), hashing.row_hash(values, mapped, CONTRACT).alias("b")
    ).first()
    sha = lambda parts: hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
    assert row.a == sha(["category=(null)", "description=d", "image_url=u", "name=N", "price_cents=5", "sku=A", "stock=(null)"])
    assert row.b == sha(["description=d", "name=N", "price=5", "sku=A", "stock=(null)"])


def test_detect_encoding(spark):
    full = "sku,name\nA-1,Ançi\n".encode()
    cases = [
        (b"\xef\xbb\xbfa", "utf-8"), (b"\xff\xfea\0", "utf-16le"), (b"\xfe\xff\0a", "utf-16be"), (full, "utf-8"),
        (b"sku,\xe9\n", "windows-1252"), (full[:-3], "utf-8"), (b"", "utf-8"), (b"\xe2\x82", "utf-8"),
        (b"\xf0\x9f\x98", "utf-8"), (b"a\x80", "windows-1252"), (b"\xe9", "utf-8"),
    ]
    got = column(spark, [bytearray(c) for c, _ in cases], encoding.detect_encoding, "v binary")
    assert got == [want for _, want in cases]


def test_decode_lenient(spark):
    cases = [
        (b"\xef\xbb\xbfa\xc3\xa9", "utf-8", "aé"), (b"a\xffb", "utf-8", "a�b"),
        (b"\x80\x81\x99\xe9", "windows-1252", "€\u0081™é"),
        ("﻿é\U0001f600".encode("utf-16-le"), "utf-16le", "é\U0001f600"),
        (b"\xfe\xff\x00a\xd8\x00", "utf-16be", "a�"),
    ]
    df = spark.createDataFrame([(i, bytearray(b), e) for i, (b, e, _) in enumerate(cases)], "i int, b binary, e string")
    got = df.orderBy("i").select(encoding.decode_lenient(F.col("b"), F.col("e"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_cp1252_table_is_the_codec():
    for byte, char in zip(encoding.CP1252_BYTES, encoding.CP1252_CHARS):
        assert bytes([ord(byte)]).decode("cp1252") == char


CSV_LINES = [
    ("a,b,c", ["a", "b", "c"]), ("", [""]), (",", ["", ""]), ('"a,b",c', ["a,b", "c"]),
    ('"a""b",c', ['a"b', "c"]), ('5" bolt,x', ['5" bolt', "x"]), ('"a" ,b', ["a", "b"]),
    ('"a"b,c",d', ['a"b,c', "d"]), ('x,""', ["x", ""]), ('"",""', ["", ""]), ('a"b"c', ['a"b"c']),
    ('x,"y', ["x", "y"]), ('"""q"""', ['"q"']),
]


def test_split_record(spark):
    got = column(spark, [line for line, _ in CSV_LINES], lambda c: csvtext.split_record(c, ","))
    assert got == [cells for _, cells in CSV_LINES]
    open_ = column(spark, [line for line, _ in CSV_LINES], lambda c: csvtext.ends_inside_quotes(c, F.lit(",")))
    assert [line for (line, _), o in zip(CSV_LINES, open_) if o] == ['x,"y']
    long = "x" * 50000 + '"' + ',"' + 'y""' * 20000 + '"'
    assert [len(c) for c in column(spark, [long], lambda c: csvtext.split_record(c, ","))[0]] == [50001, 40000]
    assert len(column(spark, ['"q"' + ",z" * 60000], lambda c: csvtext.split_record(c, ","))[0]) == 60001


def test_split_lines(spark):
    texts = ["a,b\nc,d\n", "a,b\r\n\r\nc", '"x\ny",1\nz,2\n', "", "one"]
    got = column(spark, texts, lambda c: csvtext.split_lines(c, ","))
    assert got == [["a,b", "c,d"], ["a,b", "", "c"], ['"x\ny",1', "z,2"], [""], ["one"]]


def test_escape_cell(spark):
    raw = ["a", "=1", 'say "x"', "-1,2", "x\ry", None, "@", "=a\nb"]
    assert column(spark, raw, lambda c: csvtext.escape_cell(c, CODED)) == [
        "a", "'=1", '"say ""x"""', '"-1,2"', "x\ry", "", "'@", '"=a\nb"']
    assert column(spark, raw, lambda c: csvtext.escape_cell(c, CONTRACT)) == [
        "a", "'=1", '"say ""x"""', "\"'-1,2\"", '"x\ry"', "", "'@", "\"'=a\nb\""]


def test_quick_patterns_read_as_the_whole_rule_does(spark):
    shapes = {
        "5": (False, "5", ""), "007": (False, "007", ""), "1.5": (False, "1", "5"), "1.": (False, "1", ""), "1.234": (False, "1234", ""),
        "1.2345": (False, "1", "2345"), "0.001": (False, "0001", ""), "1,5": (False, "1", "5"), "-1.5": (True, "1", "5"),
        ".5": (False, "", "5"), "　 7﻿": (False, "7", ""), "$ 5.25 ": (False, "5", "25"), "1.2.3": None, " ": None,
    }
    got = column(spark, list(shapes), numbers.parse_decimal)
    assert [r and tuple(r) for r in got] == list(shapes.values())
    blanks = {"": True, " \t　﻿": True, " x": False, "x ": False, "\u0007": False, "\n": True}
    assert column(spark, list(blanks), text.is_blank) == list(blanks.values())
    # Over text that is no blank, the first look at a character settles it: the class of white space is not tried.
    assert "(?![!-~])" in numbers._NUMBER
