"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.rules import Rules

UNIT_SEPARATOR = "\u001f"
NULL_TEXT = "(null)"


def row_hash(values: dict[str, Column], mapped: dict[str, Column], rules: Rules) -> Column:
    """sha256 over `field=value` texts in field-name order.

    `values` is keyed by sku, name, price_cents, stock, category, description and image_url;
    `mapped` says per optional field whether the feed's mapping provides it.
    """
    texts = []
    named = {(rules.hash_price_key if k == "price_cents" else k): k for k in values}
    for key in sorted(named):
        source = named[key]
        text = F.concat(
            F.lit(f"{key}="), F.coalesce(values[source].cast("string"), F.lit(NULL_TEXT))
        )
        if rules.hash_mapped_only and source in mapped:
            text = F.when(mapped[source], text)  # concat_ws leaves nulls out
        texts.append(text)
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *texts), 256)


def packed(digest: Column) -> Column:
    """A digest as bytes, to be moved and compared: two hex digits a byte, or any other text as it is, marked as such."""
    plain = digest.rlike("\\A(?:[0-9a-f]{2})++\\z")
    return F.when(plain, F.concat(F.unhex(F.lit("01")), F.unhex(digest))).otherwise(
        F.concat(F.unhex(F.lit("00")), F.encode(digest, "UTF-8"))
    )


def unpacked(moved: Column) -> Column:
    """The text that `packed` was given."""
    rest = F.substring(moved, 2, 1 << 30)
    return F.when(F.substring(moved, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def header_signature(headers: Column, rules: Rules) -> Column:
    if rules.ordered_signature:
        return F.sha2(F.array_join(headers, UNIT_SEPARATOR), 256)
    return F.array_join(F.array_sort(headers), "|")
