"""CSV text as Columns: cutting lines into cells, and writing cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.rules import DELIMITERS, Rules
from feedloom.functions.text import js_trim

# A quoted cell opens only at the cell's start and ends at a quote that is followed (after optional
# spaces) by the delimiter or the record's end; a doubled quote stands for one, and a quote anywhere
# else is text. Possessive loops keep the matcher from recursing on long cells.
_END = "(?:\\r\\n|\\n|\\r|\\z)"


def _quoted(delimiter: str, end: str = _END) -> str:
    close = f" *+(?:{re.escape(delimiter)}|{end})"
    return f'"[^"]*+(?:(?:""|"(?!{close}))[^"]*+)*+" *+(?={re.escape(delimiter)}|{end})'


def _unquoted(delimiter: str) -> str:
    return f'(?!")[^{re.escape(delimiter)}\\r\\n]*+'


def cell_pattern(delimiter: str, end: str = _END) -> str:
    """One closed cell; `end` matches where a record ends."""
    return f"(?:{_quoted(delimiter, end)}|{_unquoted(delimiter)})"


def _by_delimiter(delimiter: Column, build) -> Column:
    """`build(d)` for whichever of the four delimiters the row uses."""
    chosen = None
    for candidate in DELIMITERS:
        test = delimiter == candidate
        chosen = F.when(test, build(candidate)) if chosen is None else chosen.when(test, build(candidate))
    return chosen


def _cells(line: Column, delimiter: str) -> Column:
    plain = F.split(line, re.escape(delimiter), -1)
    d = re.escape(delimiter)
    token = f'{d}({_quoted(delimiter)}|{_unquoted(delimiter)}|"[\\s\\S]*+)'
    tokens = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(token), F.lit(1))
    bare = lambda cell: F.when(
        cell.startswith('"'),
        F.replace(F.regexp_replace(cell, '\\A"|" *+\\z', ""), F.lit('""'), F.lit('"')),
    ).otherwise(cell)
    return F.when(~F.contains(line, F.lit('"')), plain).otherwise(F.transform(tokens, bare))


def split_record(line: Column, delimiter: str | Column) -> Column:
    """Cells of one record. Lines without a quote, nearly all of them, take a plain split."""
    if isinstance(delimiter, str):
        return _cells(line, delimiter)
    return _by_delimiter(delimiter, lambda d: _cells(line, d))


def ends_inside_quotes(line: Column, delimiter: str | Column) -> Column:
    """True when a quoted cell opened on this line is not closed on it."""

    def test(d: str) -> Column:
        cell = cell_pattern(d)
        return ~line.rlike(f"\\A{cell}(?:{re.escape(d)}{cell})*+\\z")

    found = test(delimiter) if isinstance(delimiter, str) else _by_delimiter(delimiter, test)
    return F.contains(line, F.lit('"')) & found


_BREAK = "\\r\\n|\\n|\\r"


def _quoted_records(text: Column, delimiter: str) -> Column:
    d = re.escape(delimiter)
    cell = f'(?:{_quoted(delimiter)}|{_unquoted(delimiter)}|"[\\s\\S]*+)'
    # The match always takes at least one character, so no empty record appears after the last.
    record = f"(?=[\\s\\S])({cell}(?:{d}{cell})*+){_END}"
    return F.regexp_extract_all(text, F.lit(record), F.lit(1))


def split_lines(text: Column, delimiter: str) -> Column:
    """Records of a text held in one value (a bounded sample); quoted cells may span lines."""
    plain = F.split(F.regexp_replace(text, f"(?:{_BREAK})\\z", ""), _BREAK, -1)
    return F.when(~F.contains(text, F.lit('"')), plain).otherwise(_quoted_records(text, delimiter))


def first_lines(text: Column, delimiter: str, count: int) -> Column:
    """The first records of such a text; the rest is not cut up. An empty one may end the list."""
    plain = F.split(text, _BREAK, count + 1)
    lines = F.when(~F.contains(text, F.lit('"')), plain).otherwise(_quoted_records(text, delimiter))
    return F.slice(lines, 1, count)


def is_blank_record(cells: Column) -> Column:
    return (F.size(cells) <= 1) & (js_trim(F.coalesce(F.get(cells, F.lit(0)), F.lit(""))) == "")


def escape_cell(value: Column, rules: Rules) -> Column:
    """One report cell: formula characters are defused with a quote mark, separators quoted."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    special = '[,"\\n]' if not rules.escape_prefix_always else '[,"\\n\\r]'
    formula = text.rlike("\\A[@=+-]")
    prefixed = F.when(formula, F.concat(F.lit("'"), text)).otherwise(text)
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    body = prefixed if rules.escape_prefix_always else text
    return F.when(text.rlike(special), quote(body)).otherwise(prefixed)


def quote_cell(value: Column, delimiter: str) -> Column:
    """One feed cell as text, quoted only when it has to be."""
    needs = value.rlike(f'["\\r\\n{re.escape(delimiter)}]')
    return F.when(
        needs, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(value)
