"""Replaying a load in one layout, in blocks, and both, against the rule in plain Python."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import apply, groups
from feedloom.operators.apply import batch_rows, block_offsets, field_changes, hot_keys, merged_catalog, replay
from feedloom.rules import OPTIONAL_FIELDS, PRODUCT_FIELDS
from feedloom.session import stage

ROW = (
    "import_id bigint, row_number bigint, catalog_id bigint, sku string, name string, price_cents bigint, stock bigint, "
    "category string, description string, image_url string, sets_stock boolean, sets_category boolean, "
    "sets_description boolean, sets_image_url boolean, row_hash string"
)
PRODUCT = (
    "catalog_id bigint, sku string, name string, price_cents bigint, stock bigint, category string, description string, "
    "image_url string, row_hash string, last_import_id bigint, updated_at timestamp"
)


def loads():
    """Rows of 150 imports; one SKU holds a third, hashes repeat, and what a row sets is no part of its hash."""
    rng = random.Random(5)
    rows = []
    for i in range(1, 151):
        for n in range(2, 2 + rng.randrange(1, 12)):
            sku = "HOT" if rng.random() < 0.33 else f"s{rng.randrange(40)}"
            sets = [rng.random() < 0.6 for _ in range(4)]
            name, cents, rest = rng.choice("ab"), rng.randrange(2), rng.choice([None, "x", "y"])
            stock = rng.choice([None, 0, 7]) if sets[0] else None
            rows.append((i, n, 1 + i % 2, sku, name, cents, stock, rest, rest, rest, *sets, f"{name}{cents}{rest}"))
    stored = [(c, f"s{k}", "old", 5, 3, None, "d", None, "a0None", 0, None) for c in (1, 2) for k in range(0, 40, 3)]
    return rows, stored


def by_rule(rows, stored, size):
    """(import_id, row_number) to batch, action and changed fields."""
    state = {(p[0], p[1]): (dict(zip(PRODUCT_FIELDS, p[2:8])), p[8]) for p in stored}
    found, place = {}, {}
    for r in sorted(rows):
        key, values, digest = (r[2], r[3]), dict(zip(PRODUCT_FIELDS, r[4:10])), r[14]
        sets = dict(zip(OPTIONAL_FIELDS, r[10:14]))
        place[r[0]] = place.get(r[0], 0) + 1
        held, seen = state.get(key, (None, None))
        if held is None:
            new = {f: v if sets.get(f, True) else (0 if f == "stock" else None) for f, v in values.items()}
            action, changes = "create", {f: (None, str(v)) for f, v in new.items() if v is not None}
        elif seen == digest:
            new, action, changes = held, "skip", {}
        else:
            new = {f: v if sets.get(f, True) else held[f] for f, v in values.items()}
            text_of = lambda v: None if v is None else str(v)
            action, changes = "update", {f: (text_of(held[f]), text_of(new[f])) for f in new if new[f] != held[f]}
        state[key] = (new, digest)
        found[r[0], r[1]] = ((place[r[0]] - 1) // size + 1, action, changes)
    return found, state


@pytest.mark.parametrize("key_rows, block_rows", [(10**9, 10**6), (20, 10**6), (20, 4), (0, 3)])
def test_replay(spark, key_rows, block_rows):
    rows, stored = loads()
    products = stage(spark.createDataFrame(stored, PRODUCT), "products")
    batched = stage(batch_rows(stage(spark.createDataFrame(rows, ROW), "rows"), 3), "batched")
    hot = hot_keys(batched, key_rows)
    assert (hot is None) == (key_rows == 10**9)
    played = stage(replay(batched, products, hot, block_offsets(batched, block_rows), block_rows), "played")
    want, state = by_rule(rows, stored, 3)
    got = {(r.import_id, r.row_number): (r.batch_number, r.action) for r in played.collect()}
    assert got == {at: (batch, action) for at, (batch, action, _) in want.items()} and played.count() == len(rows)
    listed = {
        (r.import_id, r.row_number): (r.batch_number, r.action, {c.field: (c.old, c.new) for c in r.changes})
        for r in field_changes(played, products).collect()
    }
    assert listed == {at: x for at, x in want.items() if x[1] != "skip"}
    merged = merged_catalog(played, products, F.current_timestamp()).collect()
    assert {(r.catalog_id, r.sku): ({f: r[f] for f in PRODUCT_FIELDS}, r.row_hash) for r in merged} == state


def test_replay_of_nothing(spark):
    empty = stage(spark.createDataFrame([], ROW), "rows")
    products = stage(spark.createDataFrame(loads()[1], PRODUCT), "products")
    batched = batch_rows(empty, 3)
    assert hot_keys(batched) is None and replay(batched, products).count() == 0


def test_rows_of_small_loads_do_not_move_to_be_numbered(spark):
    rows = stage(spark.createDataFrame(loads()[0], ROW), "rows")
    plan = batch_rows(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_rows_move_once_to_be_replayed(spark):
    rows, stored = loads()
    products = stage(spark.createDataFrame(stored, PRODUCT), "products")
    batched = stage(batch_rows(stage(spark.createDataFrame(rows, ROW), "rows"), 3), "batched")
    plan = field_changes(replay(batched, products), products)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def test_nfc_ranges_hold_what_composition_cannot_change():
    joined = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and final consonants
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joined.add(int(parts[1], 16))
    for low, high in text.NFC_RANGES:
        for c in range(low, high + 1):
            assert unicodedata.normalize("NFC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in joined


def test_nfc(spark):
    rng = random.Random(9)
    some = ["a", "e", "\u0301", "\u0308", "\u00e9", "\u1100", "\u1161", "\u11a8", "\uac00", "\u212b", "\u4e00", "\uf900",
            "\u304b", "\u3099", "\u03b1", "\u0345", "\u037e", "\u0438", "\u0306", "\U0001f600", "\n", ""]
    values = ["".join(rng.choices(some, k=rng.randrange(0, 7))) for _ in range(3000)] + [None, "\u4e00" * 100_000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = dict(df.select("i", text.nfc(F.col("v"))).collect())
    assert all(got[i] == (None if v is None else unicodedata.normalize("NFC", v)) for i, v in enumerate(values))


@pytest.mark.parametrize("small", (True, False))
def test_batches_across_blocks_of_row_numbers(spark, monkeypatch, small):
    monkeypatch.setattr(groups, "is_small", lambda dimension, *bounds: small)
    rows = [(i, n) for i in (1, 2) for n in range(1, 2600, i)]
    valid = spark.createDataFrame([*rows, (None, 1)], "import_id bigint, row_number bigint")
    found = {(r.import_id, r.row_number): r.batch_number for r in apply.batch_rows(valid, 700).collect()}
    assert found == {(i, n): (n - 1) // i // 700 + 1 for i, n in rows}
    ledger = spark.createDataFrame([(1, 1, 900, 1100), (1, 2, 1200, 1200), (None, 1, 1, 9)], "import_id bigint, batch_number bigint, first_row bigint, last_row bigint")
    kept = sorted((r.import_id or 0, r.row_number) for r in apply.not_applied(valid, ledger).collect())
    assert kept == sorted([(0, 1), *((i, n) for i, n in rows if i == 2 or not (900 <= n <= 1100 or n == 1200))])


def test_audit_page_and_merged_catalog_replay_rows_in_one_layout(spark, monkeypatch):
    """Both laid rows out by key for their actions first, and moved them again for what they write."""
    from workload import derive, queries

    def refuse(*_):
        raise AssertionError("rows are laid out twice")

    monkeypatch.setattr(derive, "apply_actions", refuse)
    assert queries.QUERIES["change_page"](spark, "/root/testdata/sf0.001") is not None
    assert queries.QUERIES["merged_catalog"](spark, "/root/testdata/sf0.001") is not None
