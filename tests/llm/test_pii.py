"""Pseudonyms against the same rules in plain Python, over whole sets of dates and texts that are hard to match."""

from __future__ import annotations

import datetime
import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from feedloom.llm import pii
from feedloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def stream(tweak, step, other, key=pii.KEY):
    return hashlib.sha256(f"{key}|{tweak}|{step}|{other}".encode()).hexdigest()


def shift(half, digest):
    out = []
    for i, c in enumerate(half):
        by = int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16)
        for first, n in (("0", 10), ("a", 26), ("A", 26)):
            if ord(first) <= ord(c) < ord(first) + n:
                c = chr(ord(first) + (ord(c) - ord(first) + by) % n)
                break
        out.append(c)
    return "".join(out)


def permute_text(value, tweak):
    cut = len(value) // 2
    left, right = value[:cut], value[cut:]
    for step in range(pii.ROUNDS):
        if step % 2 == 0:
            left = shift(left, stream(f"{tweak}:{len(value)}", step, right))
        else:
            right = shift(right, stream(f"{tweak}:{len(value)}", step, left))
    return left + right


def refill(pattern, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def mod97(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def date_parts(value):
    parts = re.split("[-/.]", value)
    if len(parts[0]) == 4:
        return "ymd", parts[0], parts[1], parts[2]
    return ("mdy", parts[2], parts[0], parts[1]) if int(parts[1]) > 12 else ("dmy", parts[2], parts[1], parts[0])


def is_date(value):
    _, y, m, d = date_parts(value)
    try:
        return bool(datetime.date(int(y), int(m), int(d)))
    except ValueError:
        return False


def leap(year):
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


ALL_LEAPS = [y for y in range(1, 10_000) if leap(y)]


def pseudo_date(value):
    order, y, m, d = date_parts(value)
    shape = (9 if len(m) == 1 else 12, 13 if order == "mdy" else 1, 9 if len(d) == 1 else 31)
    days = pii.SHAPES[shape]
    year, day = int(y), 100 * int(m) + int(d)
    tweak = "date-" + "-".join(map(str, shape))
    for step in range(pii.ROUNDS):
        if step % 2 == 0:
            among = ALL_LEAPS if day == 229 else range(1, 10_000)
            by = int(stream(tweak, step, day)[:12], 16)
            year = among[(among.index(year) + by) % len(among)]
        else:
            among = [x for x in days if x != 229 or leap(year)]
            by = int(stream(tweak, step, year)[:12], 16)
            day = among[(among.index(day) + by) % len(among)]
    m2, d2 = (str(n).zfill(len(old)) for n, old in ((day // 100, m), (day % 100, d)))
    gap = re.search("[-/.]", value)[0]
    return gap.join({"ymd": (f"{year:04}", m2, d2), "mdy": (m2, d2, f"{year:04}"), "dmy": (d2, m2, f"{year:04}")}[order])


def pseudo_ip(value):
    a, b, c, d = map(int, value.split("."))
    pair = [256 * a + b, 256 * c + d]
    for step in range(pii.ROUNDS):
        mine = step % 2
        pair[mine] = (pair[mine] + int(stream("ipv4", step, pair[1 - mine])[:12], 16) % 65_536) % 65_536
    return ".".join(str(x) for p in pair for x in divmod(p, 256))


def pseudonym(value):
    """The pseudonym of a match; None if it only looks like a value."""
    digits = re.sub("[^0-9]", "", value)
    if re.fullmatch(pii.EMAIL, value):
        at = value.index("@")
        return permute_text(value[:at], "email") + value[at:]
    if re.fullmatch(pii.IBAN, value):
        if mod97(value) != 1:
            return None
        body = permute_text(value[4:], "iban")
        return f"{value[:2]}{98 - mod97(value[:2] + '00' + body):02}{body}"
    if re.fullmatch(pii.IPV4, value):
        return pseudo_ip(value) if all(int(o) <= 255 for o in value.split(".")) else None
    if re.fullmatch(pii.DATE_YMD, value) or re.fullmatch(pii.DATE_DMY, value):
        return pseudo_date(value) if is_date(value) else None
    if re.fullmatch(pii.PHONE, value):
        return refill(value, digits[0] + permute_text(digits[1:], "phone")) if 8 <= len(digits) <= 15 else None
    if re.fullmatch(pii.SOCIAL, value):
        bad = re.search("^(?:000|666|9)|^.{3}00|0000$", digits)
        return None if bad else refill(value, permute_text(digits, "social"))
    if luhn(digits):
        payload = permute_text(digits[:-1], "card")
        return refill(value, payload + next(c for c in "0123456789" if luhn(payload + c)))
    return None


def replaced(text):
    """(text, n_pii) of a document."""
    n = 0

    def one(match):
        nonlocal n
        new = pseudonym(match[0])
        n += new is not None
        return match[0] if new is None else new

    return re.sub(pii.ANY, one, text or "") if text is not None else None, n


SAMPLES = [
    "mail a.b-c_9@mail.example.com, call +49 (30) 1234-5678 or (206) 555-0142 or 206-555-0142",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and GB82WEST12345698765432 GB83WEST12345698765432",
    "10.0.255.1 300.1.2.3 1.2.3.4.5 255.255.255.255 0.0.0.0", "123-45-6789 000-45-6789 666-45-6789 123-45-0000",
    "1999-12-31 31.12.1999 2004/02/29 02/29/2004 2/29/2004 2004-2-9 9.2.2004 29.2.2004 1999-13-31 31.02.1999 0000-01-01 0001-01-01 9999-12-31",
    "04/13/2020 4/13/2020 13/04/2020 13/4/2020 3/4/2020 31/12/9999 12/31/9999 9999.12.10", "", None, "nothing here 2024 12345",
]


def test_samples(spark):
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id long, text string")
    found = {r["doc_id"]: (r["text"], r["n_pii"]) for r in pii.replace_pii(rows).collect()}
    assert found == {k: replaced(t) for k, t in enumerate(SAMPLES)}


def test_op3(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    found = {r["doc_id"]: (r["text"], r["n_pii"]) for r in QUERIES["op3_pii"](spark, FOLDER).collect()}
    assert found == {k: replaced(t) for k, t in texts.items()}
    assert sum(n for _, n in found.values()) > 10


PATTERNS = ["yyyy-MM-dd", "d/M/yyyy", "M.d.yyyy", "yyyy/M/d", "dd-M-yyyy"]


def test_dates_of_a_shape_come_back(spark):
    """Days of the years 0001 to 9999, written in many ways: no two alike, the same shape, and the way back."""
    days = spark.range(0, 3_652_059, numPartitions=16).select(F.expr("date_add(date'0001-01-01', cast(id as int))").alias("day"))
    ends = F.col("day").between("9700-01-01", "9703-03-01") | (F.year("day") < 3)
    some = days.filter((F.pmod(F.xxhash64("day"), F.lit(300)) == 0) | ends | (F.date_format("day", "MM-dd") == "02-29"))
    each = some.withColumn("pattern", F.explode(F.array(*map(F.lit, PATTERNS))))
    written = each.select("pattern", F.expr("date_format(day, pattern)").alias("v")).distinct().repartition(16)
    new = written.withColumn("p", pii.pseudonym(F.col("v"), F.lit("date"), "key"))
    shape = lambda c: F.regexp_replace(c, "[0-9]", "0")
    checked = new.select(
        "pattern", "p", (shape("v") == shape("p")).alias("shaped"), (pii.kind_of(F.col("p")) == "date").alias("dated"),
        (pii.pseudonym(F.col("p"), F.lit("date"), "key", back=True) == F.col("v")).alias("back"), (F.col("v") != F.col("p")).alias("moved"),
    )
    counts = checked.groupBy("pattern").agg(
        F.count("*"), F.countDistinct("p"), F.count_if("shaped"), F.count_if("dated"), F.count_if("back"), F.count_if("moved")
    )
    rows = counts.collect()
    assert {r["pattern"] for r in rows} == set(PATTERNS)
    for _, n, *same, moved in rows:
        assert set(same) == {n} and n > 10_000 and moved > 0.99 * n


HARD = {
    "labels": "a@b" + ".c" * 500_000, "dots": "a@b" + "." * 500_000, "local": "a" * 1_000_000 + "@", "mail": "x" * 200_000 + "@b.de",
    "digits": "1" * 1_000_000, "spaced": "1 " * 500_000, "dashes": "1-" * 500_000, "octets": "1." * 500_000, "plus": "+1" * 500_000,
    "brackets": "+1 (" * 250_000, "account": "GB82" * 250_000, "slashes": "1/1/" * 250_000, "ats": "@" * 1_000_000, "signs": "a@" * 500_000,
}


def test_long_hard_texts(spark):
    """No pattern runs out of stack or time on a megabyte made for it."""
    rows = spark.createDataFrame(list(HARD.items()), "doc_id string, text string").repartition(8)
    found = {r["doc_id"]: r for r in pii.replace_pii(rows).collect()}
    assert {k: len(r["text"]) for k, r in found.items()} == {k: len(t) for k, t in HARD.items()}
    assert found["mail"]["n_pii"] == found["labels"]["n_pii"] == 1 and found["mail"]["text"].endswith("@b.de")
