"""Locale-free prices and stock counts as Columns.

A written number is read in two steps. `number_body` accepts the whole cell with one pattern (sign,
currency mark, digit groups split by no-break spaces) and leaves only sign, digits and separators.
`decimal_parts` then decides by shape alone whether those separators group thousands or start a
fraction. Keeping the steps as separate columns lets a plan compute each of them once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import ANY_SPACE, WHITESPACE, js_trim
from feedloom.rules import PRICE_MAX_CENTS, STOCK_MAX

_WS = ANY_SPACE
# fixed values: currency marks and the spaces that may group digits
_MARK = "(?:[$€£]|[A-Za-z]{3})"
_GROUP_SPACE = "[\u00a0\u202f]"

_BODY = f"(?:[0-9.,]|(?<=[0-9]){_GROUP_SPACE}(?=[0-9]))++"
_NUMBER = (
    "\\A(?=[^0-9]*[0-9])"
    f"{_WS}(?:{_MARK}{_WS}-?{_WS}{_BODY}|-{_WS}{_MARK}{_WS}{_BODY}|-?{_WS}{_BODY}{_WS}{_MARK}?)"
    f"{_WS}\\z"
)

# A separator groups thousands when it stands once before exactly three digits (with something in
# front), or repeats over groups of three; otherwise a separator unique of its kind and rightmost
# starts the fraction. Any other arrangement is no number.
_WHOLE = (
    "\\A-?(?:[0-9]+|[0-9]+[.,][0-9]{3}"
    "|[0-9]{1,3}(?:\\.[0-9]{3}){2,}|[0-9]{1,3}(?:,[0-9]{3}){2,})\\z"
)
_FRACTIONAL = "\\A-?(?:[0-9,]*\\.[0-9]*|[0-9.]*,[0-9]*)\\z"
# What nearly all bodies are: digits alone, or one point that groups no thousands.
_DIGITS = "\\A[0-9]++\\z"
_POINT = "\\A[0-9]++\\.(?![0-9]{3}\\z)[0-9]*+\\z"

_LEADING_MARK = f"\\A{_MARK}{_WS}(?=[\\s\\S]*[0-9])"
_TRAILING_MARK = f"(?s)\\A(.*[0-9](?:.*[^{WHITESPACE}])??){_WS}{_MARK}\\z"

_PARTS = "struct<negative:boolean,integer:string,fraction:string>"
_RESULT = "struct<value:bigint,error:string>"


def join_spaced_digits(value: Column) -> Column:
    return F.regexp_replace(value, f"(?<=[0-9]){_GROUP_SPACE}(?=[0-9])", "")


def strip_currency(value: Column) -> Column:
    """struct<value, stripped>: one mark taken off the front, or else the back, beside a digit."""
    leading = value.rlike(_LEADING_MARK)
    trailing = value.rlike(_TRAILING_MARK)
    rest = (
        F.when(leading, F.regexp_replace(value, _LEADING_MARK, ""))
        .when(trailing, F.regexp_replace(value, _TRAILING_MARK, "$1"))
        .otherwise(value)
    )
    return F.struct(
        F.when(leading | trailing, js_trim(rest)).otherwise(rest).alias("value"),
        (leading | trailing).alias("stripped"),
    )


_BARE = "\\A-?[0-9]++(?:[.,][0-9]++)?\\z"  # a number that is its own body


def number_body(raw: Column) -> Column:
    """Sign, digits and separators of a written number; null when the cell is not one."""
    return F.when(raw.rlike(_BARE), raw).when(raw.rlike(_NUMBER), F.regexp_replace(raw, "[^0-9.,\\-]+", ""))


def decimal_parts(body: Column) -> Column:
    """struct<negative, integer, fraction> of a number body; null when the separators clash."""
    negative = body.startswith("-")
    fraction = F.substring_index(F.translate(body, ",", "."), ".", -1)
    head = F.substring(body, F.lit(1), F.length(body) - F.length(fraction) - 1)
    whole = F.struct(
        negative.alias("negative"),
        F.translate(body, "-.,", "").alias("integer"),
        F.lit("").alias("fraction"),
    )
    split = F.struct(
        negative.alias("negative"),
        F.translate(head, "-.,", "").alias("integer"),
        fraction.alias("fraction"),
    )
    plain = lambda integer, fraction: F.struct(
        F.lit(False).alias("negative"), integer.alias("integer"), fraction.alias("fraction")
    )
    at_point = plain(F.substring_index(body, ".", 1), F.substring_index(body, ".", -1))
    quick = F.when(body.rlike(_DIGITS), plain(body, F.lit(""))).when(body.rlike(_POINT), at_point)
    return quick.when(body.rlike(_WHOLE), whole).when(body.rlike(_FRACTIONAL), split).cast(_PARTS)


def parse_decimal(raw: Column) -> Column:
    return decimal_parts(number_body(raw))


def _as_long(digits: Column) -> Column:
    # Callers have bounded the length already, so a failed cast can only mean "no digits".
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def _value(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(None).cast("string").alias("error")).cast(_RESULT)


def _error(code: str) -> Column:
    return F.struct(F.lit(None).cast("bigint").alias("value"), F.lit(code).alias("error")).cast(_RESULT)


def price_result(parts: Column) -> Column:
    digits = F.ltrim(F.concat(parts["integer"], F.rpad(parts["fraction"], 2, "0")), F.lit("0"))
    cents = _as_long(digits)
    return (
        F.when(parts.isNull(), _error("invalid"))
        .when(F.length(parts["fraction"]) > 2, _error("precision"))
        .when((F.length(digits) > len(str(PRICE_MAX_CENTS))) | (cents > PRICE_MAX_CENTS), _error("out_of_range"))
        .when(parts["negative"] & (cents > 0), _error("negative"))
        .otherwise(_value(cents))
    )


def stock_result(parts: Column) -> Column:
    digits = F.ltrim(parts["integer"], F.lit("0"))
    count = _as_long(digits)
    return (
        F.when(parts.isNull(), _error("invalid"))
        .when(F.ltrim(parts["fraction"], F.lit("0")) != "", _error("invalid"))
        .when((F.length(digits) > len(str(STOCK_MAX))) | (count > STOCK_MAX), _error("out_of_range"))
        .when(parts["negative"] & (count > 0), _error("negative"))
        .otherwise(_value(count))
    )


def parse_price(raw: Column) -> Column:
    return price_result(parse_decimal(raw))


def parse_stock(raw: Column) -> Column:
    return stock_result(parse_decimal(raw))


def price_display(cents: Column) -> Column:
    """1099 -> 10.99"""
    size = F.abs(cents)
    return F.concat(
        F.when(cents < 0, F.lit("-")).otherwise(F.lit("")),
        F.call_function("div", size, F.lit(100)).cast("string"),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )
