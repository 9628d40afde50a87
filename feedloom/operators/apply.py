"""Loading valid rows into catalogs: batches, actions, the merged catalog, its audit and the ledger.

Rows of one catalog key are replayed in (import_id, row_number) order after the key's stored product,
which joins the sequence as its first row. That makes the stored state an ordinary "earlier row": one
shuffle on the key serves create, update and skip alike, and untouched products pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.hashing import packed
from feedloom.operators.groups import (
    BLOCK_IMPORTS,
    BLOCK_ROWS,
    block_of,
    broadcast_if_small,
    number_rows,
    previous_value,
    previous_written,
    spread_join,
)
from feedloom.rules import BATCH_SIZE, OPTIONAL_FIELDS, PRODUCT_FIELDS
from feedloom.session import stage

KEY = ["catalog_id", "sku"]
ORDER = ["import_id", "row_number"]
KEY_ROWS = 100_000  # rows of one key that are sorted at once; keys with more are taken in blocks
KEY_SLOTS = 1 << 16  # of keys by hash, counted before keys are
LEDGER_BLOCK = 1000  # row numbers per block when rows are looked up in the ledger
STORED = 0  # import_id and row_number of a stored product inside a replay


# --- batches ---------------------------------------------------------------------------------


def batch_ranges(valid: DataFrame, batch_size: int | Column = BATCH_SIZE) -> DataFrame:
    """(import_id, batch_number, first_row, last_row): valid rows in file order, `batch_size` to a batch (a number or
    a column of `valid`). Only the row numbers are shuffled."""
    size = F.lit(batch_size) if isinstance(batch_size, int) else batch_size
    numbers = valid.select("import_id", "row_number", size.cast("bigint").alias("_size"))
    placed = number_rows(numbers, ["import_id"], block_of("row_number", BLOCK_ROWS), ["row_number"], "_place")
    number = F.call_function("div", F.col("_place") - 1, F.col("_size")) + 1
    return placed.groupBy("import_id", number.alias("batch_number")).agg(
        F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row")
    )


def batch_rows(valid: DataFrame, batch_size: int | Column = BATCH_SIZE) -> DataFrame:
    """Add `batch_number`. Row numbers are unique within an import.

    `valid` is read twice, its row numbers first: pass stored rows. Where the ranges of the batches are small enough to
    be sent along, the rows themselves do not move.
    """
    blocks = broadcast_if_small(stage(_range_blocks(batch_ranges(valid, batch_size), "batch_number"), "batches"))
    placed = valid.drop("batch_number").withColumn("_at", block_of("row_number", LEDGER_BLOCK))
    found = placed.join(blocks, _same_block()).withColumn("_range", F.explode_outer(F.filter("_ranges", _inside)))
    return found.filter("_range is not null").select("*", "_range.batch_number").drop("_at", "_import", "_block", "_ranges", "_range")


def _range_blocks(ranges: DataFrame, *columns: str) -> DataFrame:
    """For each block of row numbers of an import, the ranges that touch it, at most as many as the block has numbers."""
    first, last = block_of("first_row", LEDGER_BLOCK), block_of("last_row", LEDGER_BLOCK)
    touched = ranges.select("import_id", "first_row", "last_row", *columns, F.explode(F.sequence(first, last)).alias("_block"))
    listed = F.collect_list(F.struct("first_row", "last_row", *columns))
    return touched.groupBy(F.col("import_id").alias("_import"), "_block").agg(listed.alias("_ranges"))


def _same_block() -> Column:
    return (F.col("import_id") == F.col("_import")) & (F.col("_at") == F.col("_block"))


def _inside(found: Column) -> Column:
    return F.col("row_number").between(found["first_row"], found["last_row"])


def with_batch_size(valid: DataFrame, imports: DataFrame, default: int = BATCH_SIZE) -> DataFrame:
    """Add each import's own `batch_size`; the default where it names none."""
    sizes = imports.select("import_id", "batch_size")
    joined = spread_join(valid, sizes, "import_id", F.col("row_number"), "left")
    return joined.withColumn("batch_size", F.coalesce("batch_size", F.lit(default).cast("bigint")))


def batch_plan(batched: DataFrame) -> DataFrame:
    return batched.groupBy("import_id", "batch_number").agg(
        F.min("row_number").alias("first_row"),
        F.max("row_number").alias("last_row"),
        F.count("*").alias("n_rows"),
    )


def batch_ledger(actions: DataFrame) -> DataFrame:
    return actions.groupBy("import_id", "batch_number").agg(
        F.min("row_number").alias("first_row"),
        F.max("row_number").alias("last_row"),
        F.count_if(F.col("action") == "create").alias("created_count"),
        F.count_if(F.col("action") == "update").alias("updated_count"),
        F.count_if(F.col("action") == "skip").alias("skipped_count"),
    )


def apply_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("import_id").agg(
        *[F.sum(f"{c}_count").alias(f"{c}_count") for c in ("created", "updated", "skipped")]
    )


def ledger_gaps(ledger: DataFrame) -> DataFrame:
    """Ledger rows that do not follow on: the batch before is missing, or the number repeats."""
    before = F.lag("batch_number").over(Window.partitionBy("import_id").orderBy("batch_number"))
    return (
        ledger.select("import_id", "batch_number", F.coalesce(before, F.lit(0)).alias("previous_batch"))
        .filter("batch_number <> previous_batch + 1")
    )


def not_applied(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows outside the row ranges of the ledger's batches, whatever size the batches had.

    Ranges are looked up by blocks of row numbers, so that no import's rows meet in one task. The rows do not move where the
    ranges are small enough to be sent along.
    """
    blocks = broadcast_if_small(stage(_range_blocks(ledger), "ranges"))
    placed = rows.withColumn("_at", block_of("row_number", LEDGER_BLOCK))
    return placed.join(blocks, _same_block() & F.exists("_ranges", _inside), "left_anti").drop("_at")


def resume_rows(valid: DataFrame, ledger: DataFrame, batch_size: int | Column = BATCH_SIZE) -> DataFrame:
    """Rows that no committed batch covers, batched from the next batch number on."""
    reached = ledger.groupBy("import_id").agg(F.max("batch_number").alias("_batch"))
    batched = batch_rows(not_applied(valid, ledger), batch_size)
    return (
        spread_join(batched, reached, "import_id", F.col("row_number"), "left")
        .withColumn("batch_number", F.col("batch_number") + F.coalesce("_batch", F.lit(0)))
        .drop("_batch")
    )


# --- replay ----------------------------------------------------------------------------------


def block_offsets(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """(import_id, _offset): by how many blocks imports move up to make room for long ones before them.

    None, after one look at the row numbers, where no import is longer than a block; pass stored rows.
    """
    if rows.filter(F.col("row_number") >= block_rows).isEmpty():
        return None
    extra = rows.groupBy("import_id").agg(block_of(F.max("row_number"), block_rows).alias("_extra"))
    before = Window.orderBy("import_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per import
    return extra.select("import_id", F.coalesce(F.sum("_extra").over(before), F.lit(0)).alias("_offset"))


def _key_blocks(rows: DataFrame, offsets: DataFrame | None, block_rows: int) -> tuple[DataFrame, Column]:
    """Rows of a key in blocks that follow (import_id, row_number): a few imports, or part of a long one."""
    block = block_of("import_id", BLOCK_IMPORTS)
    if offsets is None:
        return rows, block
    moved = rows.join(broadcast_if_small(stage(offsets, "offsets")), "import_id", "left")
    return moved, block + F.coalesce("_offset", F.lit(0)) + block_of("row_number", block_rows)


def apply_actions(
    rows: DataFrame, products: DataFrame, hot: DataFrame | None = None, offsets: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add `action` to each row, given everything loaded before it.

    Rows move once, laid out by key; only those of `hot` keys (see `hot_keys`) are taken in blocks. What a row carries besides
    its key, place and hash moves with it: select what is wanted. `offsets`: see `block_offsets`.
    """
    if hot is None:
        return _actions_together(rows, products)
    (apart, rest), blocks = _by_heat(rows, products, hot), (offsets, block_rows)
    return _actions_together(*rest).unionByName(_actions_in_blocks(*apart, *blocks))


def _by_heat(rows: DataFrame, products: DataFrame, hot: DataFrame) -> list[list[DataFrame]]:
    """(rows, products) of hot keys, and of all others."""
    hot = broadcast_if_small(hot)
    return [[df.join(hot, KEY, how) for df in (rows, products)] for how in ("left_semi", "left_anti")]


def _actions_together(rows: DataFrame, products: DataFrame) -> DataFrame:
    both = _with_stored(rows, products).withColumn("_digest", packed(F.col("row_hash")))  # half as much to move
    # A row with no key is no row of a key: such rows only meet others of their block of imports.
    keyless = F.when(F.col("catalog_id").isNull() | F.col("sku").isNull(), block_of("import_id", BLOCK_IMPORTS))
    seen = F.lag("_digest").over(Window.partitionBy(*KEY, keyless).orderBy(*ORDER))
    acting = both.withColumn("_seen", seen).withColumn("action", _action("_digest")).filter(F.col("import_id") > STORED)
    return acting.drop("_seen", "_digest")


def _actions_in_blocks(rows: DataFrame, products: DataFrame, offsets: DataFrame | None, block_rows: int) -> DataFrame:
    both, block = _key_blocks(_with_stored(rows, products), offsets, block_rows)
    replay = previous_value(both, KEY, block, ORDER, "row_hash", "_seen").filter(F.col("import_id") > STORED).drop("_offset")
    return replay.withColumn("action", _action()).drop("_seen")


def _with_stored(rows: DataFrame, products: DataFrame) -> DataFrame:
    stored = F.lit(STORED).cast("bigint")
    first = products.select(*KEY, stored.alias("import_id"), stored.alias("row_number"), "row_hash")
    return rows.unionByName(first, allowMissingColumns=True)


def _action(digest: str = "row_hash") -> Column:
    """What a row does, told by the hash `_seen` on the row of its key before it."""
    return (
        F.when(F.col("_seen").isNull(), F.lit("create"))
        .when(F.col("_seen") == F.col(digest), F.lit("skip"))
        .otherwise(F.lit("update"))
    )


def _new_value(field: str) -> Column:
    """What a create writes: the row's value, or the field's default when the feed does not set it."""
    if field not in OPTIONAL_FIELDS:
        return F.col(field)
    default = F.lit(0).cast("bigint") if field == "stock" else F.lit(None).cast("string")
    return F.when(F.col(f"sets_{field}"), F.col(field)).otherwise(default)


def _writes(field: str) -> Column:
    """struct<v> when the row writes the field, else null; a stored product wrote all of them."""
    is_set = F.col(f"sets_{field}") if field in OPTIONAL_FIELDS else F.lit(True)
    create, update, stored = (F.col("action") == a for a in ("create", "update", "stored"))
    return F.when(create, F.struct(_new_value(field).alias("v"))).when(
        stored | (update & is_set), F.struct(F.col(field).alias("v"))
    )


WRITES = [f"w_{f}" for f in PRODUCT_FIELDS]
PLAYED = [*KEY, *ORDER, "batch_number", "action", "row_hash"]


def _with_writes(actions: DataFrame) -> DataFrame:
    """Writing rows with w_<field>, what each of them writes; rows that have been replayed carry it already."""
    writing = actions.filter("action <> 'skip'")
    if WRITES[0] in actions.columns:
        return writing
    return writing.select(*PLAYED, *[_writes(f).alias(f"w_{f}") for f in PRODUCT_FIELDS])


def _replay(actions: DataFrame, products: DataFrame) -> DataFrame:
    """Stored products and writing rows in one shape: w_<field> is what each of them writes."""
    stored = F.lit(STORED).cast("bigint")
    first = products.select(
        *KEY,
        stored.alias("import_id"),
        stored.alias("row_number"),
        stored.alias("batch_number"),
        F.lit("stored").alias("action"),
        "row_hash",
        "last_import_id",
        "updated_at",
        *[F.struct(F.col(f).alias("v")).alias(f"w_{f}") for f in PRODUCT_FIELDS],
    )
    rows = _with_writes(actions).select(*PLAYED, *WRITES)
    return first.unionByName(rows, allowMissingColumns=True)


def hot_keys(rows: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame | None:
    """Keys with more rows than one sort should take, or None where there are none.

    Slots of keys are counted first, which moves a row for each slot and task at most; keys themselves are counted only in
    slots with that many rows, so none is missed and nearly always none has to be. Pass stored rows.
    """
    more = F.col("_n") > key_rows
    placed = rows.select(*KEY, F.pmod(F.xxhash64(*KEY), F.lit(KEY_SLOTS)).alias("_slot"))
    full = stage(placed.groupBy("_slot").agg(F.count("*").alias("_n")).filter(more).select("_slot"), "hot-slots")
    if full.isEmpty():
        return None
    counted = placed.join(F.broadcast(full), "_slot", "left_semi").groupBy(*KEY).agg(F.count("*").alias("_n")).filter(more)
    found = stage(counted.select(*KEY), "hot-keys")
    return None if found.isEmpty() else found


def replay(
    rows: DataFrame, products: DataFrame, hot: DataFrame | None = None, offsets: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows with their `action`, what each writes (`w_<field>`) and what was there before (`old_w_<field>`), as struct<v>.

    Rows move once: one layout by key serves the action and the old values. Only rows of `hot` keys (see `hot_keys`) are
    taken in blocks, where actions come first and a summary of each block carries the values on. Every row gets one row;
    a row that is skipped writes nothing. Pass stored rows.
    """
    if hot is None:
        return _replay_together(rows, products)
    apart, rest = _by_heat(rows, products, hot)
    return _replay_together(*rest).unionByName(_replay_blocks(*apart, offsets, block_rows))


def _replay_together(rows: DataFrame, products: DataFrame) -> DataFrame:
    stored = F.lit(STORED).cast("bigint")
    first = products.select(*KEY, *PRODUCT_FIELDS, "row_hash", stored.alias("import_id"), stored.alias("row_number"))
    both = rows.unionByName(first, allowMissingColumns=True)
    by_key = Window.partitionBy(*KEY).orderBy(*ORDER)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_seen", F.lag("row_hash").over(by_key))
    acting = seen.withColumn("action", F.when(F.col("import_id") == STORED, F.lit("stored")).otherwise(_action()))
    writing = acting.select(*PLAYED, *[_writes(f).alias(f"w_{f}") for f in PRODUCT_FIELDS])
    return writing.select("*", *[F.last(w, ignorenulls=True).over(earlier).alias(f"old_{w}") for w in WRITES]).filter(
        F.col("import_id") > STORED
    )


def _replay_blocks(rows: DataFrame, products: DataFrame, offsets: DataFrame | None, block_rows: int) -> DataFrame:
    actions = stage(_actions_in_blocks(rows, products, offsets, block_rows), "actions")
    both, block = _key_blocks(_replay(actions, products), offsets, block_rows)
    writing = previous_written(both, KEY, block, ORDER, WRITES).filter(F.col("import_id") > STORED)
    idle = actions.filter("action = 'skip'").select(*PLAYED)
    return writing.select(*PLAYED, *WRITES, *[f"old_{w}" for w in WRITES]).unionByName(idle, allowMissingColumns=True)


def field_changes(
    actions: DataFrame, products: DataFrame, offsets: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The audit: per created or updated row, the fields it changed with old and new value as text.

    Rows that have been replayed are listed as they are, without a shuffle.
    """
    if f"old_{WRITES[0]}" in actions.columns:
        played = actions
    else:
        both, block = _key_blocks(_replay(actions, products), offsets, block_rows)
        played = previous_written(both, KEY, block, ORDER, WRITES)
    rows = played.filter(F.col("action").isin("create", "update"))
    change = "struct<field:string,old:string,new:string>"
    create = F.col("action") == "create"

    def entry(field: str) -> Column:
        old, new = F.col(f"old_w_{field}.v"), F.col(f"w_{field}.v")
        shown = F.struct(
            F.lit(field).alias("field"),
            F.when(~create, old.cast("string")).alias("old"),
            new.cast("string").alias("new"),
        ).cast(change)
        written = F.col(f"w_{field}").isNotNull()
        # A create lists what it stores; an update lists what differs from before.
        listed = F.when(create, new.isNotNull()).otherwise(written & ~new.eqNullSafe(old))
        return F.when(listed, F.array(shown)).otherwise(F.array().cast(f"array<{change}>"))

    return rows.select(
        *ORDER,
        "batch_number",
        *KEY,
        "action",
        F.concat(*[entry(f) for f in PRODUCT_FIELDS]).alias("changes"),  # lists joined: a filter over one is not compiled
    )


# Printable ASCII without a quote or backslash: what JSON writes between quotes as it is.
_QUOTED_AS_IT_IS = "\\A[ !#-\\[\\]-~]*+\\z"


def changes_json(changes: DataFrame) -> DataFrame:
    """The audit row as stored: create {field: value}, update {field: [old, new]}."""

    def text(field: Column, value: Column) -> Column:
        whole = F.to_json(F.struct(value.alias("v")))
        quoted = F.when(value.rlike(_QUOTED_AS_IT_IS), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(
            F.substring(whole, F.lit(len('{"v":') + 1), F.length(whole) - len('{"v":}'))
        )
        return F.when(value.isNull(), F.lit("null")).when(field.isin("price_cents", "stock"), value).otherwise(quoted)

    def member(c: Column) -> Column:
        new, old = text(c["field"], c["new"]), text(c["field"], c["old"])
        value = F.when(F.col("action") == "create", new).otherwise(F.concat(F.lit("["), old, F.lit(","), new, F.lit("]")))
        return F.when(c["field"].isin(*PRODUCT_FIELDS), F.concat(F.lit('"'), c["field"], F.lit('":'), value))

    # A row changes each field once at most; taken one by one, because a transformed list is not compiled.
    body = F.concat_ws(",", *[member(F.get("changes", F.lit(n))) for n in range(len(PRODUCT_FIELDS))])
    return changes.select(
        *ORDER, "batch_number", "sku", "action", F.concat(F.lit("{"), body, F.lit("}")).alias("fields_json")
    )


def merged_catalog(actions: DataFrame, products: DataFrame, applied_at: Column) -> DataFrame:
    """The catalog after the rows: per field the last written value, hash and import of the last
    writing row; products no row writes to keep everything, `updated_at` included."""
    at = F.struct(*ORDER)
    latest = lambda column: F.max(
        F.when(column.isNotNull(), F.struct(at.alias("at"), column.alias("v")))
    )
    folded = _replay(actions, products).groupBy(*KEY).agg(
        *[latest(F.col(f"w_{f}")).alias(f"_{f}") for f in PRODUCT_FIELDS],
        F.max(F.struct(*ORDER, "row_hash")).alias("_last"),
        F.max("last_import_id").alias("_import"),
        F.max("updated_at").alias("_at"),
    )
    touched = F.col("_last.import_id") > STORED
    return folded.select(
        *KEY,
        *[F.col(f"_{f}.v.v").alias(f) for f in PRODUCT_FIELDS],
        F.col("_last.row_hash").alias("row_hash"),
        F.when(touched, F.col("_last.import_id")).otherwise(F.col("_import")).alias("last_import_id"),
        F.when(touched, applied_at).otherwise(F.col("_at")).alias("updated_at"),
    )


# --- checks ----------------------------------------------------------------------------------


def progress(imports: DataFrame, batched: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per import: rows and batches done, and how many there are."""
    planned = batched.groupBy("import_id").agg(
        F.count("*").alias("valid_rows"), F.max("batch_number").alias("total_batches")
    )
    done = ledger.groupBy("import_id").agg(
        F.sum(F.col("created_count") + F.col("updated_count") + F.col("skipped_count")).alias("processed_rows"),
        F.max("batch_number").alias("last_committed_batch"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    last = F.coalesce("last_committed_batch", F.lit(0).cast("bigint"))
    return (
        imports.select("import_id", "state")
        .join(planned, "import_id", "left")
        .join(done, "import_id", "left")
        .select(
            "import_id",
            "state",
            zero("valid_rows"),
            zero("processed_rows"),
            F.when(F.col("state") == "applying", last + 1).otherwise(last).alias("current_batch"),
            zero("total_batches"),
        )
    )


def reconcile(dry_counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Dry run beside apply, and whether they agree (they do unless a feed repeats a SKU)."""
    joined = dry_counts.join(totals, "import_id", "full_outer")
    pairs = (("would_create", "created_count"), ("would_update", "updated_count"), ("would_skip", "skipped_count"))
    number = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    same = F.lit(True)
    for dry, done in pairs:
        same = same & (number(dry) == number(done))
    return joined.select(
        "import_id", *[number(c).alias(c) for pair in pairs for c in pair], same.alias("reconciled")
    )
