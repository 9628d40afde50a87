"""Personal data: validated numbers, dates and addresses replaced by format-preserving Feistel pseudonyms.

Each value is permuted under a key within its own format: a card number stays one that passes its check digit,
a date stays a date written the same way, an address of four octets stays one, and punctuation stays where it is. Equal
values get equal pseudonyms in all documents, and the holder of the key can turn them back. Only DataFrame functions
run, within each row. The key is a literal of the plan: whoever may read plans and event logs of the job can read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import let

ROUNDS = 8
KEY = "feedloom-demonstration-key"  # for tests and the registered query; callers give their own

# The formats that are looked for, first match first.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE_YMD = r"(?<![0-9])(?<![0-9][-/.])[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}(?![0-9]|[-/.][0-9])"
DATE_DMY = r"(?<![0-9])(?<![0-9][-/.])[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}(?![0-9]|[-/.][0-9])"
PHONE = (
    r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
    r"|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])"
)
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
ANY = "|".join((EMAIL, IBAN, IPV4, DATE_YMD, DATE_DMY, PHONE, SOCIAL, CARD))

YEARS, LEAP_YEARS = 9_999, 2_424  # 0001 to 9999
LEAPS = [y for y in range(1, 401) if y % 4 == 0 and (y % 100 or y % 400 == 0)]  # of 400 years
LEAP_DAY = 229


def days_of(months: int, first: int, last: int) -> list[int]:
    """month * 100 + day of the days `first` to `last` of the first months; 29 February, which not all years have, is last."""
    length = {m: 29 if m == 2 else 30 if m in (4, 6, 9, 11) else 31 for m in range(1, 13)}
    days = [100 * m + d for m in range(1, months + 1) for d in range(first, min(last, length[m]) + 1)]
    return sorted(days, key=lambda day: (day == LEAP_DAY, day))


# The days that a date as written can stand for, by the months and the days that its digits leave: a month of one
# digit, a day of one digit, and a day over 12, which alone tells that the month stands first.
SHAPES = {(months, first, last): days_of(months, first, last) for months in (9, 12) for first, last in ((1, 9), (1, 31), (13, 31))}


def _stream(key: str, tweak: Column, step: int, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, F.lit(str(step)), other).cast("binary"), 256)


def _number(digest: Column, at: Column | int, width: int) -> Column:
    """`width` hex digits of a digest as a number."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(digest, at, F.lit(width)), 16, 10).cast("long")


def _shift(half: Column, digest: Column, sign: int) -> Column:
    """Every digit moved among the digits, every ASCII letter among its case; other characters stay."""

    def moved(c: Column, i: Column, d: Column) -> Column:
        by = F.lit(sign) * _number(d, (i % 32) * 2 + 1, 2)

        def within(first: str, n: int) -> Column:
            low = ord(first)
            return F.chr(F.lit(low) + F.pmod(F.ascii(c) - low + by, F.lit(n)))

        return (
            F.when(c.between("0", "9"), within("0", 10))
            .when(c.between("a", "z"), within("a", 26))
            .when(c.between("A", "Z"), within("A", 26))
            .otherwise(c)
        )

    # The digest is worked out once, not for every character.
    chars = F.filter(F.split(half, ""), lambda c: c != "")
    return F.array_join(let(digest, lambda d: F.transform(chars, lambda c, i: moved(c, i, d))), "")


def permute_text(value: Column, key: str, tweak: str, back: bool = False) -> Column:
    """A keyed permutation of the strings with the same pattern of digits, lower and upper case letters."""
    n = F.length(value)
    cut = F.call_function("div", n, F.lit(2)).cast("int")
    state = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, n).alias("r"))
    tag = F.concat(F.lit(tweak + ":"), n.cast("string"))
    steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def turn(s: Column, step: int) -> Column:
        sign = -1 if back else 1
        if step % 2 == 0:
            return F.struct(_shift(s["l"], _stream(key, tag, step, s["r"]), sign).alias("l"), s["r"].alias("r"))
        return F.struct(s["l"].alias("l"), _shift(s["r"], _stream(key, tag, step, s["l"]), sign).alias("r"))

    done = _chain(state, turn, steps)
    return let(done, lambda s: F.concat(s["l"], s["r"]))


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, tweak: str, back: bool = False) -> Column:
    """A keyed permutation of the pairs below `sizes`, as a struct (l, r)."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def turn(s: Column, step: int) -> Column:
        mine, other = ("l", "r") if step % 2 == 0 else ("r", "l")
        by = _number(_stream(key, F.lit(tweak), step, s[other].cast("string")), 1, 12)
        size = F.lit(sizes[step % 2]).cast("long")
        new = F.pmod(s[mine] + (-1 if back else 1) * (by % size), size)
        return F.struct((new if mine == "l" else s["l"]).alias("l"), (new if mine == "r" else s["r"]).alias("r"))

    return _chain(state, turn, steps)


def _chain(state: Column, turn: Callable[[Column, int], Column], steps: Iterable[int]) -> Column:
    """Apply the turns of a Feistel network one after the other, each evaluated once."""
    return reduce(lambda s, step: let(s, lambda x: turn(x, step)), steps, state)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(pattern: Column, digits: Column) -> Column:
    """`pattern` with its digits replaced, in order, by `digits`."""

    def at(c: Column, i: Column) -> Column:
        place = F.length(_digits(F.substring(pattern, F.lit(1), i + 1)))
        return F.when(c.between("0", "9"), F.substring(digits, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(pattern, ""), lambda c: c != ""), at), "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _check_digit(payload: Column) -> Column:
    choices = F.array(*[F.lit(str(d)) for d in range(10)])
    return F.filter(choices, lambda c: _luhn(F.concat(payload, c)))[0]


def _card(value: Column, key: str, back: bool) -> Column:
    digits = _digits(value)
    payload = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", back)
    return let(payload, lambda p: _refill(value, F.concat(p, _check_digit(p))))


def _phone(value: Column, key: str, back: bool) -> Column:
    digits = _digits(value)
    rest = permute_text(F.substring(digits, F.lit(2), F.length(digits)), key, "phone", back)
    return let(rest, lambda r: _refill(value, F.concat(F.substring(digits, 1, 1), r)))


def _email(value: Column, key: str, back: bool) -> Column:
    at = F.instr(value, "@")
    return F.concat(
        permute_text(F.substring(value, F.lit(1), at - 1), key, "email", back), F.substring(value, at, F.length(value))
    )


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, "\\."), lambda o: o.cast("long"))


def _ipv4(value: Column, key: str, back: bool) -> Column:
    def pair(o: Column) -> Column:
        return permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65_536, 65_536), key, "ipv4", back)

    def write(s: Column) -> Column:
        parts = [F.call_function("div", s["l"], F.lit(256)), s["l"] % 256, F.call_function("div", s["r"], F.lit(256)), s["r"] % 256]
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    return let(let(_octets(value), pair), write)


def _mod97(code: Column) -> Column:
    """Remainder by 97 of an account number: letters count as 10 to 35, the first four characters stand last."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    values = F.transform(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, F.lit(100)).otherwise(F.lit(10)) + v) % 97)


def _iban(value: Column, key: str, back: bool) -> Column:
    country = F.substring(value, 1, 2)
    body = permute_text(F.substring(value, F.lit(5), F.length(value)), key, "iban", back)

    def write(b: Column) -> Column:
        check = 98 - _mod97(F.concat(country, F.lit("00"), b))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)

    return let(body, write)


def _date_parts(value: Column) -> tuple[Column, Column, Column, Column]:
    """(year first, month first, the three numbers of a date as written, the ISO form they stand for).

    Day before month unless the second number can only be a day.
    """
    parts = F.split(value, "[-/.]")
    year_first = F.length(parts[0]) == 4
    month_first = ~year_first & (parts[1].cast("int") > 12)
    year = F.when(year_first, parts[0]).otherwise(parts[2])
    month = F.when(year_first, parts[1]).when(month_first, parts[0]).otherwise(parts[1])
    day = F.when(year_first, parts[2]).when(month_first, parts[1]).otherwise(parts[0])
    return year_first, month_first, F.array(year, month, day), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _is_date(value: Column) -> Column:
    """A day of the years 0001 to 9999."""
    _, _, numbers, iso = _date_parts(value)
    return iso.try_cast("date").isNotNull() & (numbers[0] != "0000")


def _is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def permute_date(year: Column, day: Column, days: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of the dates whose day (month * 100 + day) is one of `days`, as a struct (y, d).

    Rounds move the year among the years that have the day, and the day among the days that the year has.
    """
    state = F.struct(year.cast("long").alias("y"), day.cast("long").alias("d"))
    steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    sign = -1 if back else 1
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))

    def moved(rank: Column, size: Column, step: int, other: Column) -> Column:
        by = _number(_stream(key, tweak, step, other.cast("string")), 1, 12)
        return F.pmod(rank + sign * (by % size), size)

    def turn(s: Column, step: int) -> Column:
        y, d = s["y"], s["d"]
        if step % 2 == 0:
            leap = d == LEAP_DAY
            rank = F.when(leap, div(y, 4) - div(y, 100) + div(y, 400)).otherwise(y) - 1
            size = F.when(leap, F.lit(LEAP_YEARS)).otherwise(F.lit(YEARS)).cast("long")

            def as_year(r: Column) -> Column:
                nth = F.element_at(_longs(LEAPS), (r % len(LEAPS) + 1).cast("int"))
                return F.when(leap, div(r, len(LEAPS)) * 400 + nth).otherwise(r + 1).cast("long")

            return let(moved(rank, size, step, d), lambda r: F.struct(as_year(r).alias("y"), d.alias("d")))
        missing = F.when((F.element_at(days, -1) == LEAP_DAY) & ~_is_leap(y), 1).otherwise(0)
        new = moved(F.array_position(days, d) - 1, (F.size(days) - missing).cast("long"), step, y)
        return let(new, lambda r: F.struct(y.alias("y"), F.element_at(days, (r + 1).cast("int")).alias("d")))

    return _chain(state, turn, steps)


def _longs(numbers: list[int]) -> Column:
    """Numbers as one literal of the plan, which is folded into an array."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _date(value: Column, key: str, back: bool) -> Column:
    """A date of the same shape: the same order, marks and digits, and read the same way again."""
    year_first, month_first, numbers, _ = _date_parts(value)
    gap = F.regexp_extract(value, "[-/.]", 0)
    read = F.struct(
        year_first.alias("year_first"), month_first.alias("month_first"), gap.alias("gap"), numbers.alias("n"),
        F.when(F.length(numbers[1]) == 1, 9).otherwise(12).alias("months"), F.when(month_first, 13).otherwise(1).alias("first"),
        F.when(F.length(numbers[2]) == 1, 9).otherwise(31).alias("last"),
    )

    def change(r: Column) -> Column:
        shape = F.concat_ws("-", *[r[c].cast("string") for c in ("months", "first", "last")])
        return let(shape, lambda named: let(among(named), lambda days: permuted(r, named, days)))

    def among(named: Column) -> Column:
        days = F.lit(None).cast("array<bigint>")
        for shape, listed in SHAPES.items():
            days = F.when(named == "-".join(map(str, shape)), _longs(listed)).otherwise(days)
        return days

    def permuted(r: Column, named: Column, days: Column) -> Column:
        day = r["n"][1].cast("long") * 100 + r["n"][2].cast("long")
        new = permute_date(r["n"][0], day, days, key, F.concat(F.lit("date-"), named), back)
        return let(new, lambda x: spell(r, x))

    def spell(r: Column, new: Column) -> Column:
        y = F.lpad(new["y"].cast("string"), 4, "0")
        m = F.lpad(F.call_function("div", new["d"], F.lit(100).cast("long")).cast("string"), F.length(r["n"][1]), F.lit("0"))
        d = F.lpad((new["d"] % 100).cast("string"), F.length(r["n"][2]), F.lit("0"))
        ordered = F.when(r["year_first"], F.array(y, m, d)).when(r["month_first"], F.array(m, d, y)).otherwise(F.array(d, m, y))
        return F.call_function("array_join", ordered, r["gap"])

    return let(read, change)


def kind_of(value: Column) -> Column:
    """What a match is once validated; null for one that only looks alike."""
    digits = _digits(value)

    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    return (
        F.when(whole(EMAIL), F.lit("email"))
        .when(whole(IBAN), F.when(_mod97(value) == 1, F.lit("iban")))
        .when(whole(IPV4), F.when(F.forall(_octets(value), lambda o: o <= 255), F.lit("ipv4")))
        .when(whole(DATE_YMD) | whole(DATE_DMY), F.when(_is_date(value), F.lit("date")))
        .when(whole(PHONE), F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .when(
            whole(SOCIAL),
            F.when(~digits.rlike("^(?:000|666|9)|^.{3}00|0000$"), F.lit("social")),
        )
        .when(whole(CARD), F.when(_luhn(digits), F.lit("card")))
    )


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The value's pseudonym by its kind; a value without a kind stays. `back` turns pseudonyms into values."""
    return (
        F.when(kind == "email", _email(value, key, back))
        .when(kind == "iban", _iban(value, key, back))
        .when(kind == "ipv4", _ipv4(value, key, back))
        .when(kind == "date", _date(value, key, back))
        .when(kind == "phone", _phone(value, key, back))
        .when(kind == "social", let(permute_text(_digits(value), key, "social", back), lambda d: _refill(value, d)))
        .when(kind == "card", _card(value, key, back))
        .otherwise(value)
    )


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` with `text` pseudonymised and `n_pii` added (in place of a column of that name).

    Values that fail validation (octets over 255, impossible dates, wrong check digits) stay as they are, as does
    every other character. Null and empty texts stay, with 0 values. Rows are treated one by one: repeated rows
    alike, whole texts of any length, no rows for no documents; other columns are kept unread.
    """
    text = F.col("text")
    searched = F.when(text.rlike("[0-9@]"), text)
    others = [c for c in docs.columns if c not in ("text", "n_pii")]
    found = docs.select(
        *others, "text",
        F.coalesce(F.regexp_extract_all(searched, F.lit(ANY), F.lit(0)), F.array().cast("array<string>")).alias("_llm_found"),
    )
    named = found.select(
        *others, "text",
        F.transform("_llm_found", lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind"))).alias("_llm_found"),
    )
    count = F.size(F.filter("_llm_found", lambda m: m["kind"].isNotNull())).cast("long")
    gaps = F.split(text, ANY, -1)
    new = let(
        F.transform("_llm_found", lambda m: pseudonym(m["value"], m["kind"], key)),
        lambda p: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(p, i), F.lit("")))), ""),
    )
    replaced = F.when(count > 0, new).otherwise(text).alias("text")
    order = [c for c in docs.columns if c != "n_pii"]
    return named.select(*others, replaced, count.alias("n_pii")).select(*order, "n_pii")
