"""Image URL rule as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import js_trim

# An absolute http(s) address with at least one more character on its first line.
_ABSOLUTE = "\\A(?i:https?)://[^\\n\\r\\u2028\\u2029]"


def url_result(trimmed: Column) -> Column:
    """struct<value, error> of an already trimmed URL; blank is fine."""
    ok = (trimmed == "") | trimmed.rlike(_ABSOLUTE)
    return F.struct(
        F.when(ok, trimmed).alias("value"),
        F.when(~ok, F.lit("invalid")).alias("error"),
    )


def normalize_url(raw: Column) -> Column:
    return url_result(js_trim(raw))
