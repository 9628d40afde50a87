"""Derived inputs: supplier feeds out of lineitem, with the defects feeds have.

Every table is computed by Spark from the given ones and grows with them. `oracle.py` states the same
derivation in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.csvtext import quote_cell
from feedloom.functions.hashing import header_signature
from feedloom.operators.apply import apply_actions, batch_ledger, batch_rows, block_offsets, hot_keys, replay
from feedloom.operators.groups import block_of, number_rows
from feedloom.operators.mapping import map_columns
from feedloom.operators.validate import data_row_numbers, valid_rows, validate_rows
from feedloom.rules import CODED, CONTRACT, STATES, Rules
from feedloom.session import configure, new_folder, stage
from feedloom.sources.ranges import locate

BATCH = 100
ORDER_BLOCK = 4096  # order keys per numbering block
FILE_ROWS = 100_000  # rows per written feed file
FILES_PER_IMPORT = 1_000_000_000
ENCODINGS = {"utf-8": "utf-8", "windows-1252": "latin-1", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}  # by import
NO_FILE = "__HIVE_DEFAULT_PARTITION__"  # as Spark names a folder of rows without a value
FOLDERS = 256  # that files are dealt out to, however many there are
STORED_AT = "2026-01-01 00:00:00"
APPLIED_AT = "2026-02-01 00:00:00"
HEADERS = ("SKU", "Title", "Price", "Qty", "Group", "Text")
PRODUCT = ("name", "price_cents", "stock", "category", "description", "image_url")


def pick(number: Column, *cases: tuple[int, int, Column], otherwise: Column) -> Column:
    """First case (modulus, remainder, value) that `number` falls into."""
    chosen = None
    for modulus, remainder, value in cases:
        test = number % modulus == remainder
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen.otherwise(otherwise)


def write_lines(lines: DataFrame, folder: str, encoding: Column | None = None) -> None:
    """Write `lines` (file_id, value), those of a file next to each other and in order, as one file for each file_id.

    Tasks write the files themselves, a hidden one until it is whole: Spark's writer takes a folder for each, and its commit
    moves them one after the other. With an `encoding` for each file, files lie by encoding; else they are UTF-8.
    """
    encodings, encoding = encoding is not None, F.lit(None).cast("string") if encoding is None else encoding
    if not folder.startswith("file:") and "://" not in folder:
        folder = lines.sparkSession.conf.get("spark.hadoop.fs.defaultFS", "file://").rstrip("/") + folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = locate(folder)
        held, out, ready = None, None, set()

        def finish() -> None:
            if out is not None:
                out.close()
                system.move(f"{held[0]}/{hidden}", "/".join(held))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            starts = np.flatnonzero(np.diff(batch.column(0).fill_null(np.iinfo("int64").min).to_numpy())) + 1
            texts, names = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at, upto in pairwise((0, *starts.tolist(), len(ids))):
                number = NO_FILE if ids[at] is None else ids[at]
                place = (f"{root}/encoding={names[at]}" if encodings else root) + f"/part={(ids[at] or 0) % FOLDERS}", f"file_id={number}.csv"
                if place != held:
                    finish()
                    if place[0] not in ready:
                        system.create_dir(place[0])
                        ready.add(place[0])
                    held, hidden = place, f".{place[1]}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{place[0]}/{hidden}", compression=None)
                codec = ENCODINGS[names[at]] if encodings else "utf-8"
                out.write("".join([f"{text}\n" for text in texts[at:upto]]).encode(codec, "replace"))
        finish()
        yield from ()

    lines.select("file_id", "value", encoding).mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


PREPARED: dict[str, str] = {}  # folder of test data -> folder of its mapped feeds, written beforehand


def prepare(spark: SparkSession, folder: str) -> None:
    """Derive the feeds of a folder once, for runs that time what follows."""
    path = new_folder(spark, "mapped")
    Tables(spark, folder).mapped.write.parquet(path)
    PREPARED[folder] = path


class Tables:
    """Lazy derived tables over one folder of test data."""

    def __init__(self, spark: SparkSession, folder: str, rules: Rules = CONTRACT):
        self.spark, self.folder, self.rules = spark, folder, rules
        configure(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def numbered(self) -> DataFrame:
        """lineitem rows with their place `n` in their supplier's feed."""
        order = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
        lines = self.read("lineitem").select("l_suppkey", *order)
        return number_rows(lines, ["l_suppkey"], block_of("l_orderkey", ORDER_BLOCK), order, "n")

    @cached_property
    def parted(self) -> DataFrame:
        """Numbered rows with the part they name: all that the cells are made of."""
        part = self.read("part").select("p_partkey", "p_name", "p_brand", "p_type")
        rows = self.numbered.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return rows.select("l_suppkey", "n", "l_partkey", "l_quantity", cents.alias("cents"), "p_name", "p_brand", "p_type")

    @cached_property
    def raw(self) -> DataFrame:
        """The seven raw cells of every feed row."""
        rows = self.parted
        n, cents = F.col("n"), F.col("cents")
        whole = block_of(cents, 100).cast("string")
        decimals = F.lpad((cents % 100).cast("string"), 2, "0")
        grouped = lambda by: F.regexp_replace(whole, "([0-9]{3})\\z", F.lit(f"{by}$1"))
        text = F.concat
        q = F.col("l_quantity").cast("bigint").cast("string")
        price = pick(
            n % 12,
            (12, 0, text(whole, F.lit("."), decimals)),
            (12, 1, text(whole, F.lit(","), decimals)),
            (12, 2, text(grouped(","), F.lit("."), decimals)),
            (12, 3, text(grouped("."), F.lit(","), decimals)),
            (12, 4, text(F.lit("$"), whole, F.lit("."), decimals)),
            (12, 5, text(whole, F.lit("."), decimals, F.lit(" EUR"))),
            (12, 6, text(grouped("\u00a0"), F.lit(","), decimals)),
            (12, 7, text(F.when(n % 5 == 0, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."), decimals)),
            (12, 8, text(whole, F.lit("."), decimals, F.when(n % 7 == 0, F.lit("99")).otherwise(F.lit("")))),
            (12, 9, F.when(n % 4 == 1, F.lit("")).otherwise(whole)),
            (12, 10, F.when(n % 4 == 2, F.lit("n/a")).otherwise(text(whole, F.lit(".5")))),
            otherwise=text(F.lit("€ "), whole),
        )
        stock = pick(
            n % 13,
            (13, 1, text(q, F.lit(".00"))),
            (13, 2, text(q, F.lit(".5"))),
            (13, 3, text(F.lit("-"), q)),
            (13, 4, F.lit("")),
            (13, 5, F.when(n % 3 == 0, F.lit("x")).otherwise(q)),
            otherwise=q,
        )
        sku = text(F.lit("P-"), F.col("l_partkey").cast("string"))
        name = text(
            F.coalesce("p_name", F.lit("")),
            F.when(n % 7 == 0, F.lit(" cafe\u0301")).otherwise(F.lit("")),
            F.when(n % 11 == 0, F.lit("\u0001")).otherwise(F.lit("")),
        )
        description = text(
            F.coalesce("p_brand", F.lit("")),
            F.lit(" "),
            F.coalesce("p_type", F.lit("")),
            F.when(n % 31 == 0, F.lit(' 5" x 3, "wide"')).otherwise(F.lit("")),
            F.when(n % 103 == 0, F.lit("\ufffd")).otherwise(F.lit("")),
        )
        part_text = F.col("l_partkey").cast("string")
        image = pick(
            n,
            (19, 0, text(F.lit("ftp://cdn.example.com/"), part_text)),
            (23, 0, text(F.lit("/rel/"), part_text)),
            (29, 0, F.lit("")),
            otherwise=text(F.lit("https://cdn.example.com/"), part_text),
        )
        return rows.select(
            (F.col("l_suppkey") + 1).alias("import_id"),
            "n",
            (n + 1).alias("row_number"),
            pick(n, (97, 0, F.lit(" ")), (5, 0, text(F.lit("  "), sku, F.lit(" "))), otherwise=sku).alias("sku_raw"),
            pick(n, (89, 0, F.lit("")), (101, 0, F.repeat(name, 40)), otherwise=name).alias("name_raw"),
            price.alias("price_raw"),
            stock.alias("stock_raw"),
            pick(n, (17, 0, F.lit("")), otherwise=F.coalesce("p_type", F.lit(""))).alias("category_raw"),
            description.alias("description_raw"),
            image.alias("image_raw"),
            pick(n, (41, 0, F.lit(6)), (43, 0, F.lit(8)), otherwise=F.lit(7)).alias("n_cells"),
        )

    @cached_property
    def records(self) -> DataFrame:
        """(import_id, row_number, cells); row 1 would be the header. Some records are blank."""
        names = ("sku", "name", "price", "stock", "category", "description", "image")
        cells = F.slice(F.array(*[F.col(f"{c}_raw") for c in names], F.lit("extra")), F.lit(1), F.col("n_cells"))
        blank = F.col("n") % 211 == 0
        return self.raw.select(
            "import_id", "row_number", F.when(blank, F.array(F.lit("  "))).otherwise(cells).alias("cells")
        )

    @cached_property
    def headed(self) -> DataFrame:
        """The records with each feed's header as its first one."""
        headers = self.imports.select("import_id", F.lit(1).cast("bigint").alias("row_number"), F.col("headers").alias("cells"))
        return self.records.unionByName(headers)

    @cached_property
    def imports(self) -> DataFrame:
        """One import per supplier, stored like the table it stands for."""
        return stage(self._imports(), "imports")

    def _imports(self) -> DataFrame:
        nation = self.read("nation").select("n_nationkey", "n_regionkey")
        supplier = self.read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        import_id = (F.col("s_suppkey") + 1).cast("bigint")
        rows = supplier.select(
            import_id.alias("import_id"),
            (F.col("n_regionkey") + 1).cast("bigint").alias("catalog_id"),
            F.col("s_name").alias("source_label"),
            F.col("s_acctbal").alias("acctbal"),
        )
        i = F.col("import_id")
        image = F.when(i % 2 == 0, F.lit("Image")).otherwise(F.lit("Picture"))
        headers = F.array(*map(F.lit, HEADERS), image)
        pairs = {
            "sku": "SKU", "name": "Title", "price": "Price", "stock": "Qty", "category": "Group",
            "description": "Text",
        }
        left_out = {"category": 1, "stock": 2, "description": 3, "image_url": 3}
        entries = [
            F.when(i % 4 != left_out.get(f, -1), F.struct(F.lit(f).alias("key"), F.lit(h).alias("value")))
            for f, h in pairs.items()
        ]
        entries.append(F.when(i % 4 != 3, F.struct(F.lit("image_url").alias("key"), image.alias("value"))))
        state = F.element_at(F.array(*map(F.lit, STATES)), (i % 8 + 1).cast("int"))
        return rows.select(
            "import_id",
            "catalog_id",
            "source_label",
            F.concat(F.lit("feed-"), i, F.lit(".csv")).alias("original_filename"),
            F.element_at(F.array(*map(F.lit, (",", ";", "\t", "|"))), (i % 4 + 1).cast("int")).alias("delimiter"),
            F.lit("utf-8").alias("encoding"),
            headers.alias("headers"),
            F.map_from_entries(F.array_compact(F.array(*entries))).alias("mapping"),
            state.alias("state"),
            F.lit(BATCH).cast("bigint").alias("batch_size"),
            F.round(F.col("acctbal") * 100).cast("bigint").alias("balance_cents"),
        )

    @cached_property
    def catalogs(self) -> DataFrame:
        """One catalog per region, and one nothing is ever loaded into."""
        region = self.read("region").select(
            (F.col("r_regionkey") + 1).cast("bigint").alias("catalog_id"), F.col("r_name").alias("catalog_name")
        )
        spare = region.agg(
            (F.max("catalog_id") + 1).alias("catalog_id"), F.lit("spare").alias("catalog_name")
        )
        return region.unionByName(spare)

    @cached_property
    def data(self) -> DataFrame:
        """Records without blank ones. In the outer form, because a filter goes below the cells, which would then be built
        twice for every row, once to look whether they are blank."""
        from feedloom.functions.csvtext import is_blank_record

        cells = F.col("cells")
        filled = F.explode_outer(F.when(~is_blank_record(cells), F.array(cells))).alias("cells")
        return self.records.select("import_id", "row_number", filled).filter("cells is not null")

    @cached_property
    def mapped(self) -> DataFrame:
        if self.folder in PREPARED:
            return self.spark.read.parquet(PREPARED[self.folder])
        return map_columns(self.data, self.imports)

    @cached_property
    def validated(self) -> DataFrame:
        return validate_rows(self.mapped, self.rules)

    @cached_property
    def staged(self) -> DataFrame:
        """Validated rows parsed once, for queries that read them several times."""
        return stage(self.validated, "validated")

    @cached_property
    def coded(self) -> DataFrame:
        """Rows validated under the coded rules, which number data rows without gaps."""
        data = data_row_numbers(self.data, CODED)
        return stage(validate_rows(map_columns(data, self.imports), CODED), "coded")

    @cached_property
    def valid(self) -> DataFrame:
        return valid_rows(self.staged)

    @cached_property
    def products(self) -> DataFrame:
        """The catalog before the load: the last row per key of two thirds of the parts, as an earlier
        load would have left it; every second part has changed since."""
        part = F.col("sku").substr(F.lit(3), F.lit(20)).cast("bigint")
        earlier = self.valid.withColumn("part", part).filter("part % 3 <> 0")
        values = {
            "stock": F.when(F.col("sets_stock"), F.col("stock")).otherwise(F.lit(0)),
            "category": F.when(F.col("sets_category"), F.col("category")),
            "description": F.when(F.col("sets_description"), F.col("description")),
            "image_url": F.when(F.col("sets_image_url"), F.col("image_url")),
        }
        row = F.struct(
            "import_id", "row_number", "row_hash", *[values.get(c, F.col(c)).alias(c) for c in PRODUCT]
        )
        last = earlier.groupBy("catalog_id", "sku", "part").agg(F.max(row).alias("r"))
        changed = F.col("part") % 4 >= 2
        stale = F.sha2(F.concat(F.lit("old"), F.col("r.row_hash")), 256)
        value = {c: F.col(f"r.{c}") for c in PRODUCT}
        value["price_cents"] = F.when(changed, value["price_cents"] + 100).otherwise(value["price_cents"])
        return last.select(
            "catalog_id",
            "sku",
            *[value[c].alias(c) for c in PRODUCT],
            F.when(changed, stale).otherwise(F.col("r.row_hash")).alias("row_hash"),
            F.col("r.import_id").alias("last_import_id"),
            F.lit(STORED_AT).cast("timestamp").alias("updated_at"),
        )

    @cached_property
    def staged_products(self) -> DataFrame:
        return stage(self.products, "products")

    @cached_property
    def batched(self) -> DataFrame:
        return batch_rows(self.valid, BATCH)

    @cached_property
    def hot(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Keys of very many rows, and where blocks of imports begin for them."""
        found = hot_keys(self.valid)
        return found, None if found is None else block_offsets(self.valid)

    @cached_property
    def actions(self) -> DataFrame:
        """What each row does; of the rows only what tells it moves."""
        rows = self.batched.select("import_id", "row_number", "batch_number", "catalog_id", "sku", "row_hash")
        return apply_actions(rows, self.staged_products, *self.hot)

    @cached_property
    def played(self) -> DataFrame:
        """Rows with their action and the values before them."""
        return replay(self.batched, self.staged_products, *self.hot)

    @cached_property
    def full_ledger(self) -> DataFrame:
        """Stored, as a row for each batch is little and what it takes to count them is not."""
        return stage(batch_ledger(self.actions), "ledger")

    @cached_property
    def ledger(self) -> DataFrame:
        """What is committed so far: the first two batches of odd imports."""
        return self.full_ledger.filter("import_id % 2 = 1 and batch_number <= 2")

    @cached_property
    def templates(self) -> DataFrame:
        """Every third supplier has saved its mapping; some were never used again."""
        saved = self.imports.filter("import_id % 3 = 0")
        return saved.select(
            F.col("source_label").alias("name"),
            F.concat(F.lit('{"sku":"SKU","from":"'), F.col("import_id"), F.lit('"}')).alias("mapping_json"),
            header_signature(F.col("headers"), self.rules).alias("header_signature"),
            F.when(F.col("import_id") % 2 == 0, F.lit(1767225600) + F.col("import_id") * 60).alias("last_used_at"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        """(doc_id, content): documents as files in the encodings and shapes feeds come in."""
        text = F.replace("text", F.lit('"'), F.lit("'"))
        semicolons = F.replace(text, F.lit(" "), F.lit(";"))
        d = F.col("doc_id")
        bytes_of = lambda t, charset="UTF-8": F.encode(t, charset)
        content = pick(
            d % 6,
            (6, 0, bytes_of(text)),
            (6, 1, F.concat(F.unhex(F.lit("EFBBBF")), bytes_of(text))),
            (6, 2, F.concat(F.unhex(F.lit("E92C780A")), bytes_of(text))),
            (6, 3, F.concat(F.unhex(F.lit("FFFE")), bytes_of(text, "UTF-16LE"))),
            (6, 4, F.concat(F.unhex(F.lit("FEFF")), bytes_of(text, "UTF-16BE"))),
            otherwise=bytes_of(semicolons),
        )
        return self.read("documents").select("doc_id", content.alias("content"))

    def feed_files(self) -> tuple[str, DataFrame]:
        """Write the feeds as CSV files; returns their folder and one row per file.

        A file holds at most FILE_ROWS rows of one import, so no task ever writes more. Every seventh
        import has line breaks inside quoted cells, so its files are read by ranges.
        """
        from feedloom.sources.files import list_feeds

        folder = new_folder(self.spark, "feeds")
        write_lines(self._feed_lines(), folder)
        files = list_feeds(self.spark, folder)
        named = files.withColumn("import_id", F.regexp_extract("path", "file_id=([0-9]+)", 1).cast("bigint"))
        named = named.withColumn("encoding", F.lit("utf-8")).withColumn("delimiter", F.lit(","))
        return folder, stage(named, "listed")  # every file is hashed once

    def encoded_files(self) -> tuple[str, DataFrame]:
        """The same files, import by import in one of four encodings."""
        from feedloom.sources.files import listing

        folder = new_folder(self.spark, "encoded")
        self.parted = stage(self.parted, "parted")  # rows are numbered and joined once; what is made of them is wider
        own = block_of("file_id", FILES_PER_IMPORT) % len(ENCODINGS)
        named = F.get(F.array(*map(F.lit, ENCODINGS)), own.cast("int"))
        write_lines(self._feed_lines().filter(named.isNotNull()), folder, named)
        named = listing(self.spark, folder).select(
            "path", F.regexp_extract("path", "file_id=([0-9]+)", 1).cast("bigint").alias("import_id"),
            F.regexp_extract("path", "encoding=([^/]+)", 1).alias("encoding"), F.lit(",").alias("delimiter"),
        )
        return folder, stage(named, "listed")

    def _feed_lines(self) -> DataFrame:
        """(file_id, value) in files of FILE_ROWS rows, each in its order and behind its header."""
        file_id = F.col("import_id") * FILES_PER_IMPORT + block_of(F.col("n") - 1, FILE_ROWS)
        names = ("sku", "name", "price", "stock", "category", "description", "image")
        broken = (F.col("import_id") % 7 == 0) & (F.col("n") % 53 == 0)
        cells = {f"{c}_raw": F.col(f"{c}_raw") for c in names}
        cells["description_raw"] = F.when(
            broken, F.concat(F.lit("two\nlines "), cells["description_raw"])
        ).otherwise(cells["description_raw"])
        quoted = [quote_cell(c, ",") for c in cells.values()]
        line = F.concat_ws(",", F.array_join(F.slice(F.array(*quoted), F.lit(1), F.least("n_cells", F.lit(7))), ","))
        line = F.when(F.col("n_cells") == 8, F.concat(line, F.lit(",extra"))).otherwise(line)
        rows = self.raw.select(file_id.alias("file_id"), F.col("n").alias("at"), line.alias("value"))
        headers = rows.groupBy("file_id").agg(F.lit(0).cast("bigint").alias("at")).select(
            "file_id", "at", F.lit(",".join((*HEADERS, "Image"))).alias("value")
        )
        ordered = rows.unionByName(headers).repartition("file_id").sortWithinPartitions("file_id", "at")
        return ordered.select("file_id", "value")
