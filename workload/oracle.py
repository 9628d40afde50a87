"""The same results stated in DuckDB SQL, on the given tables alone.

Written independently of the library: numbers are read here by splitting and counting step by step, and
loads are replayed with plain windows. `CTES` holds the shared steps; `compose` puts in front of a query
the ones it mentions.
"""

from __future__ import annotations

import re

from workload.derive import APPLIED_AT, BATCH, FILE_ROWS, FILES_PER_IMPORT, STORED_AT

CTES: dict[str, str] = {}
ORACLE: dict[str, str] = {}

SPACE_POINTS = (9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279)
WS = "(" + " || ".join(f"chr({p})" for p in SPACE_POINTS) + ")"
WS_RE = "[" + "".join(f"\\x{{{p:x}}}" for p in SPACE_POINTS) + "]*"
CONTROL_RE = "[\\x00-\\x08\\x0a-\\x1f\\x7f-\\x{9f}]"
MARK = "chr(9247)"
US = "chr(31)"


def compose(sql: str) -> str:
    """Prefix `sql` with the shared steps it needs, in their order."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(CTES[name])
    steps = [f"{name} AS MATERIALIZED ({body})" for name, body in CTES.items() if name in needed]
    return f"WITH {', '.join(steps)}\n{sql}" if steps else sql


# --- derived feeds ---------------------------------------------------------------------------

CTES["numbered"] = """
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
    l_quantity, l_extendedprice, l_shipdate) AS n,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem"""

CTES["amounts"] = """
  SELECT *, CAST(cents // 100 AS VARCHAR) AS w, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS f,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS k
  FROM numbered LEFT JOIN part ON l_partkey = p_partkey"""

CTES["named"] = """
  SELECT *, coalesce(p_name, '') || CASE WHEN n % 7 = 0 THEN ' cafe' || chr(769) ELSE '' END
      || CASE WHEN n % 11 = 0 THEN chr(1) ELSE '' END AS base_name,
    CASE WHEN length(w) < 3 THEN w ELSE left(w, length(w) - 3) END AS w_head,
    CASE WHEN length(w) < 3 THEN '' ELSE right(w, 3) END AS w_tail
  FROM amounts"""

CTES["raw"] = """
  SELECT CAST(l_suppkey + 1 AS BIGINT) AS import_id, n, n + 1 AS row_number,
    CASE WHEN n % 97 = 0 THEN ' ' WHEN n % 5 = 0 THEN '  P-' || k || ' ' ELSE 'P-' || k END AS sku_raw,
    CASE WHEN n % 89 = 0 THEN '' WHEN n % 101 = 0 THEN repeat(base_name, 40) ELSE base_name END AS name_raw,
    CASE n % 12
      WHEN 0 THEN w || '.' || f
      WHEN 1 THEN w || ',' || f
      WHEN 2 THEN CASE WHEN w_tail = '' THEN w ELSE w_head || ',' || w_tail END || '.' || f
      WHEN 3 THEN CASE WHEN w_tail = '' THEN w ELSE w_head || '.' || w_tail END || ',' || f
      WHEN 4 THEN '$' || w || '.' || f
      WHEN 5 THEN w || '.' || f || ' EUR'
      WHEN 6 THEN CASE WHEN w_tail = '' THEN w ELSE w_head || chr(160) || w_tail END || ',' || f
      WHEN 7 THEN CASE WHEN n % 5 = 0 THEN '-' ELSE '' END || w || '.' || f
      WHEN 8 THEN w || '.' || f || CASE WHEN n % 7 = 0 THEN '99' ELSE '' END
      WHEN 9 THEN CASE WHEN n % 4 = 1 THEN '' ELSE w END
      WHEN 10 THEN CASE WHEN n % 4 = 2 THEN 'n/a' ELSE w || '.5' END
      ELSE chr(8364) || ' ' || w END AS price_raw,
    CASE n % 13 WHEN 1 THEN q || '.00' WHEN 2 THEN q || '.5' WHEN 3 THEN '-' || q WHEN 4 THEN ''
      WHEN 5 THEN CASE WHEN n % 3 = 0 THEN 'x' ELSE q END ELSE q END AS stock_raw,
    CASE WHEN n % 17 = 0 THEN '' ELSE coalesce(p_type, '') END AS category_raw,
    coalesce(p_brand, '') || ' ' || coalesce(p_type, '')
      || CASE WHEN n % 31 = 0 THEN ' 5" x 3, "wide"' ELSE '' END
      || CASE WHEN n % 103 = 0 THEN chr(65533) ELSE '' END AS description_raw,
    CASE WHEN n % 19 = 0 THEN 'ftp://cdn.example.com/' || k WHEN n % 23 = 0 THEN '/rel/' || k
      WHEN n % 29 = 0 THEN '' ELSE 'https://cdn.example.com/' || k END AS image_raw,
    CASE WHEN n % 41 = 0 THEN 6 WHEN n % 43 = 0 THEN 8 ELSE 7 END AS n_cells
  FROM named"""

CTES["imports"] = f"""
  SELECT CAST(s_suppkey + 1 AS BIGINT) AS import_id, CAST(n_regionkey + 1 AS BIGINT) AS catalog_id,
    s_name AS source_label, 'feed-' || (s_suppkey + 1) || '.csv' AS original_filename,
    CASE (s_suppkey + 1) % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter,
    'utf-8' AS encoding,
    CASE WHEN (s_suppkey + 1) % 2 = 0 THEN 'Image' ELSE 'Picture' END AS image_header,
    (s_suppkey + 1) % 4 <> 2 AS m_stock, (s_suppkey + 1) % 4 <> 1 AS m_category,
    (s_suppkey + 1) % 4 <> 3 AS m_description, (s_suppkey + 1) % 4 <> 3 AS m_image,
    CASE (s_suppkey + 1) % 8 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'validating' WHEN 2 THEN 'validated'
      WHEN 3 THEN 'applying' WHEN 4 THEN 'completed' WHEN 5 THEN 'paused' WHEN 6 THEN 'cancelled'
      ELSE 'failed' END AS state,
    CAST({BATCH} AS BIGINT) AS batch_size, CAST(round(s_acctbal * 100) AS BIGINT) AS balance_cents
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

CTES["import_headers"] = """
  SELECT import_id, ['SKU', 'Title', 'Price', 'Qty', 'Group', 'Text', image_header] AS headers FROM imports"""

CTES["import_fields"] = """
  SELECT import_id, field, header, pos FROM (
    SELECT import_id, 'sku' AS field, 'SKU' AS header, 1 AS pos FROM imports
    UNION ALL SELECT import_id, 'name', 'Title', 2 FROM imports
    UNION ALL SELECT import_id, 'price', 'Price', 3 FROM imports
    UNION ALL SELECT import_id, 'stock', 'Qty', 4 FROM imports WHERE m_stock
    UNION ALL SELECT import_id, 'category', 'Group', 5 FROM imports WHERE m_category
    UNION ALL SELECT import_id, 'description', 'Text', 6 FROM imports WHERE m_description
    UNION ALL SELECT import_id, 'image_url', image_header, 7 FROM imports WHERE m_image)"""

CTES["catalogs"] = """
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS catalog_id, r_name AS catalog_name FROM region
  UNION ALL SELECT CAST(max(r_regionkey) + 2 AS BIGINT), 'spare' FROM region"""

_DATA = """
  SELECT r.import_id, i.catalog_id, r.row_number, r.n_cells, m_stock, m_category, m_description, m_image,
    image_header, sku_raw, name_raw, price_raw, CASE WHEN m_stock THEN stock_raw ELSE '' END AS stock_raw,
    CASE WHEN m_category THEN category_raw ELSE '' END AS category_raw,
    CASE WHEN m_description THEN description_raw ELSE '' END AS description_raw,
    CASE WHEN m_image AND r.n_cells >= 7 THEN image_raw ELSE '' END AS image_raw,
    contains(description_raw, chr(65533)) AS has_replacement
  FROM raw r JOIN imports i ON r.import_id = i.import_id WHERE r.n % 211 <> 0"""

_FILES = f"""
  SELECT r.import_id * {FILES_PER_IMPORT} + (r.n - 1) // {FILE_ROWS} AS import_id, i.catalog_id,
    (r.n - 1) % {FILE_ROWS} + 2 AS row_number, r.n_cells, true AS m_stock, true AS m_category,
    true AS m_description, true AS m_image, 'Image' AS image_header, sku_raw, name_raw, price_raw, stock_raw,
    category_raw, CASE WHEN r.import_id % 7 = 0 AND r.n % 53 = 0 THEN 'two' || chr(10) || 'lines ' ELSE '' END
      || description_raw AS description_raw,
    CASE WHEN r.n_cells >= 7 THEN image_raw ELSE '' END AS image_raw,
    contains(description_raw, chr(65533)) AS has_replacement
  FROM raw r JOIN imports i ON r.import_id = i.import_id"""


def text_sql(column: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({column}), '{CONTROL_RE}', '', 'g'), {WS})"


def number_steps(prefix: str, source: str, column: str) -> None:
    """`<prefix>_parts`: import_id, row_number, stripped currency text and decimal parts of a column."""
    lead, trail = f"^(?:[$\\x{{20ac}}\\x{{a3}}]|[A-Za-z]{{3}}){WS_RE}", f"{WS_RE}(?:[$\\x{{20ac}}\\x{{a3}}]|[A-Za-z]{{3}})$"

    def strip(c: str) -> str:
        return (
            f"CASE WHEN regexp_matches({c}, '{lead}') AND regexp_matches(regexp_replace({c}, '{lead}', ''), '[0-9]') "
            f"THEN trim(regexp_replace({c}, '{lead}', ''), {WS}) "
            f"WHEN regexp_matches({c}, '{trail}') AND regexp_matches(regexp_replace({c}, '{trail}', ''), '[0-9]') "
            f"THEN trim(regexp_replace({c}, '{trail}', ''), {WS}) ELSE {c} END"
        )

    pair = "([0-9])[\\x{a0}\\x{202f}]([0-9])"
    CTES[f"{prefix}_first"] = f"""
      SELECT import_id, row_number, x, {strip("x")} AS s FROM (
        SELECT import_id, row_number, regexp_replace(regexp_replace(trim({column}, {WS}), '{pair}', '\\1\\2', 'g'),
          '{pair}', '\\1\\2', 'g') AS x FROM {source})"""
    CTES[f"{prefix}_second"] = f"""
      SELECT import_id, row_number, starts_with(s, '-') AS neg,
        CASE WHEN s = x THEN {strip("u")} ELSE u END AS v FROM (
        SELECT *, CASE WHEN starts_with(s, '-') THEN trim(substr(s, 2), {WS}) ELSE s END AS u FROM {prefix}_first)"""
    CTES[f"{prefix}_shape"] = f"""
      SELECT *, length(v) - length(replace(v, '.', '')) AS dots, length(v) - length(replace(v, ',', '')) AS commas,
        regexp_full_match(v, '[0-9.,]+') AND regexp_matches(v, '[0-9]') AS ok,
        CASE WHEN strpos(reverse(v), '.') < strpos(reverse(v), ',') THEN '.' ELSE ',' END AS last_mark,
        string_split(replace(v, ',', '.'), '.') AS groups
      FROM {prefix}_second"""
    CTES[f"{prefix}_parts"] = f"""
      SELECT import_id, row_number, neg,
        CASE WHEN NOT ok THEN NULL
          WHEN dots > 0 AND commas > 0 THEN
            CASE WHEN (CASE WHEN last_mark = '.' THEN dots ELSE commas END) > 1 THEN NULL
              ELSE array_to_string(list_slice(groups, 1, len(groups) - 1), '') END
          WHEN dots + commas = 0 THEN v
          WHEN dots + commas > 1 THEN
            CASE WHEN length(groups[1]) BETWEEN 1 AND 3
                AND len(list_filter(list_slice(groups, 2, len(groups)), lambda g: length(g) <> 3)) = 0
              THEN array_to_string(groups, '') END
          WHEN length(groups[1]) > 0 AND length(groups[2]) = 3 THEN array_to_string(groups, '')
          ELSE groups[1] END AS whole,
        CASE WHEN dots > 0 AND commas > 0 THEN groups[len(groups)]
          WHEN dots + commas = 1 AND NOT (length(groups[1]) > 0 AND length(groups[2]) = 3) THEN groups[2]
          ELSE '' END AS frac
      FROM {prefix}_shape"""


def price_case(value: str) -> str:
    cents = "CAST(coalesce(nullif(whole, ''), '0') AS HUGEINT) * 100 + CAST(rpad(frac, 2, '0') AS HUGEINT)"
    over = f"{cents} > 9999999999"
    if value == "error":
        return (
            f"CASE WHEN whole IS NULL THEN 'invalid' WHEN length(frac) > 2 THEN 'precision' WHEN {over} "
            f"THEN 'out_of_range' WHEN neg AND {cents} > 0 THEN 'negative' END"
        )
    return (
        f"CASE WHEN whole IS NULL OR length(frac) > 2 THEN NULL WHEN {over} OR (neg AND {cents} > 0) THEN NULL "
        f"ELSE CAST({cents} AS BIGINT) END"
    )


def stock_case(value: str) -> str:
    count = "CAST(coalesce(nullif(whole, ''), '0') AS HUGEINT)"
    bad = "whole IS NULL OR regexp_matches(frac, '[1-9]')"
    if value == "error":
        return (
            f"CASE WHEN {bad} THEN 'invalid' WHEN {count} > 1000000000 THEN 'out_of_range' "
            f"WHEN neg AND {count} > 0 THEN 'negative' END"
        )
    return f"CASE WHEN {bad} THEN NULL WHEN {count} > 1000000000 OR (neg AND {count} > 0) THEN NULL ELSE CAST({count} AS BIGINT) END"


number_steps("raw_price", "raw", "price_raw")
number_steps("raw_stock", "raw", "stock_raw")

URL_OK = "regexp_matches(url_text, '^(?i:https?)://[^\\n\\r\\x{2028}\\x{2029}]')"
PRODUCT = ("name", "price_cents", "stock", "category", "description", "image_url")


def validation_steps(p: str, data: str, coded: bool = False) -> None:
    """`<p>_checked`: one row per data record with values, hash, flags; `<p>_report`: all findings."""
    CTES[f"{p}_data"] = data
    number_steps(f"{p}_price", f"{p}_data", "price_raw")
    number_steps(f"{p}_stock", f"{p}_data", "stock_raw")
    url = f"trim(image_raw, {WS})" if coded else text_sql("image_raw")
    CTES[f"{p}_clean"] = f"""
      SELECT d.*, {text_sql("sku_raw")} AS sku, {text_sql("name_raw")} AS name,
        nullif({text_sql("category_raw")}, '') AS category, nullif({text_sql("description_raw")}, '') AS description,
        {url} AS url_text, trim(price_raw, {WS}) = '' AS no_price, trim(stock_raw, {WS}) = '' AS no_stock,
        a.price_cents, a.price_error, b.stock AS stock_value, b.stock_error
      FROM {p}_data d
      JOIN (SELECT import_id, row_number, {price_case("value")} AS price_cents, {price_case("error")} AS price_error
            FROM {p}_price_parts) a USING (import_id, row_number)
      JOIN (SELECT import_id, row_number, {stock_case("value")} AS stock, {stock_case("error")} AS stock_error
            FROM {p}_stock_parts) b USING (import_id, row_number)"""
    extra = "" if coded else f"""
          OR length(sku) > 64 OR length(name) > 256 OR length(category) > 128 OR length(description) > 8192
          OR length(url_text) > 2048 OR (url_text <> '' AND NOT {URL_OK})"""
    blank_stock = "0" if coded else "NULL"
    CTES[f"{p}_valued"] = f"""
      SELECT *, CASE WHEN no_stock THEN {blank_stock} ELSE stock_value END AS stock,
        CASE WHEN url_text <> '' AND {URL_OK} THEN url_text END AS image_url,
        m_stock {"" if coded else "AND NOT no_stock"} AS s_stock,
        n_cells = 7 AND NOT coalesce(sku = '' OR name = '' OR no_price OR price_error IS NOT NULL
          OR (NOT no_stock AND stock_error IS NOT NULL) {extra}, false) AS valid
      FROM {p}_clean"""
    member = lambda k, c: f"'{k}=' || coalesce(CAST({c} AS VARCHAR), '(null)')"
    price_key = "price_cents" if coded else "price"
    fields = (("category", "category", "m_category"), ("description", "description", "m_description"),
              ("image_url", "image_url", "m_image"), ("name", "name", None), (price_key, "price_cents", None),
              ("sku", "sku", None), ("stock", "stock", "m_stock"))
    every = ", ".join(member(k, c) for k, c, _ in fields)
    mapped = ", ".join(f"CASE WHEN {m} THEN {member(k, c)} END" if m else member(k, c) for k, c, m in fields)
    CTES[f"{p}_checked"] = f"""
      SELECT *, CASE WHEN valid THEN sha256(concat_ws({US}, {every if coded else mapped})) END AS row_hash
      FROM {p}_valued"""
    CTES[f"{p}_valid"] = f"SELECT * FROM {p}_checked WHERE valid"
    head = "SELECT import_id, 'validate' AS phase, row_number, "
    good = f"FROM {p}_checked WHERE n_cells = 7 AND "
    too_long = "" if coded else "".join(
        f"""
      UNION ALL {head} {h} AS column_name, 'field_too_long', 'error', '{c} is longer than {cap} characters'
        {good} length({v}) > {cap}"""
        for c, v, cap, h in (("sku", "sku", 64, "'SKU'"), ("name", "name", 256, "'Title'"),
                             ("category", "category", 128, "'Group'"), ("description", "description", 8192, "'Text'"),
                             ("image_url", "url_text", 2048, "image_header"))
    )
    contract = "" if coded else f"""{too_long}
      UNION ALL {head} CASE WHEN m_image THEN image_header ELSE 'image_url' END, 'url_invalid', 'error',
        'Image URL is not an absolute http or https URL' {good} url_text <> '' AND NOT {URL_OK}
      UNION ALL {head} NULL, 'encoding_replacement', 'warning', 'Row contains bytes that could not be decoded'
        FROM {p}_checked WHERE has_replacement"""
    CTES[f"{p}_found"] = f"""
      {head} CAST(NULL AS VARCHAR) AS column_name, 'columns_mismatch' AS code, 'error' AS severity,
        'Expected 7 columns, got ' || n_cells AS message FROM {p}_checked WHERE n_cells <> 7
      UNION ALL {head} 'SKU', 'missing_required', 'error', 'SKU is required' {good} sku = ''
      UNION ALL {head} 'Title', 'missing_required', 'error', 'Name is required' {good} name = ''
      UNION ALL {head} 'Price', 'missing_required', 'error', 'Price is required' {good} no_price
      UNION ALL {head} 'Price', 'price_' || price_error, 'error', 'Invalid price: ' || price_error
        {good} NOT no_price AND price_error IS NOT NULL
      UNION ALL {head} 'Qty', 'stock_' || stock_error, 'error', 'Invalid stock: ' || stock_error
        {good} NOT no_stock AND stock_error IS NOT NULL {contract}"""
    CTES[f"{p}_repeats"] = f"""
      SELECT * FROM (SELECT import_id, row_number, sku, has_replacement,
        lag(row_number) OVER (PARTITION BY import_id, sku ORDER BY row_number) AS seen_at FROM {p}_valid)
      WHERE seen_at IS NOT NULL"""
    CTES[f"{p}_repeat_found"] = f"""
      {head} 'sku' AS column_name, 'duplicate_sku' AS code, 'warning' AS severity,
        'SKU "' || sku || '" seen at row ' || seen_at || '; last occurrence wins' AS message FROM {p}_repeats"""
    CTES[f"{p}_report"] = f"SELECT * FROM {p}_found UNION ALL SELECT * FROM {p}_repeat_found"
    CTES[f"{p}_last"] = f"""
      SELECT * FROM {p}_valid QUALIFY row_number() OVER (PARTITION BY import_id, sku ORDER BY row_number DESC) = 1"""


def load_steps(p: str, stored: str | None) -> None:
    """`<p>_acts`, `<p>_book` (ledger), `<p>_audit`, `<p>_merged` for the valid rows of `<p>`."""
    CTES[f"{p}_batched"] = f"""
      SELECT *, (row_number() OVER (PARTITION BY import_id ORDER BY row_number) - 1) // {BATCH} + 1 AS batch_number
      FROM {p}_valid"""
    seed = f"UNION ALL SELECT catalog_id, sku, 0, 0, row_hash FROM {stored}" if stored else ""
    CTES[f"{p}_acts"] = f"""
      SELECT b.*, CASE WHEN seen IS NULL THEN 'create' WHEN seen = b.row_hash THEN 'skip' ELSE 'update' END AS action
      FROM {p}_batched b JOIN (
        SELECT import_id, row_number,
          lag(row_hash) OVER (PARTITION BY catalog_id, sku ORDER BY import_id, row_number) AS seen
        FROM (SELECT catalog_id, sku, import_id, row_number, row_hash FROM {p}_valid {seed})) USING (import_id, row_number)"""
    CTES[f"{p}_book"] = f"""
      SELECT import_id, batch_number, min(row_number) AS first_row, max(row_number) AS last_row,
        count(*) FILTER (action = 'create') AS created_count, count(*) FILTER (action = 'update') AS updated_count,
        count(*) FILTER (action = 'skip') AS skipped_count FROM {p}_acts GROUP BY ALL"""
    sets = {"name": "true", "price_cents": "true", "stock": "s_stock", "category": "m_category",
            "description": "m_description", "image_url": "m_image"}
    default = {"stock": "0"}
    writes = ", ".join(
        f"CASE WHEN {s} THEN {{'v': {f}}} WHEN action = 'create' THEN {{'v': {default.get(f, 'NULL')}}} END AS w_{f}"
        for f, s in sets.items()
    )
    first = ", ".join(f"{{'v': {f}}} AS w_{f}" for f in sets)
    rows = f"SELECT catalog_id, sku, import_id, row_number, batch_number, action, row_hash, {writes} FROM {p}_acts WHERE action <> 'skip'"
    seeded = f"UNION ALL SELECT catalog_id, sku, 0, 0, 0, 'stored', row_hash, {first} FROM {stored}" if stored else ""
    CTES[f"{p}_writes"] = f"{rows} {seeded}"
    window = "PARTITION BY catalog_id, sku ORDER BY import_id, row_number ROWS BETWEEN UNBOUNDED PRECEDING AND"
    olds = ", ".join(f"last_value(w_{f} IGNORE NULLS) OVER ({window} 1 PRECEDING) AS o_{f}" for f in sets)
    CTES[f"{p}_history"] = f"SELECT *, {olds} FROM {p}_writes"
    shown = lambda c, f: (
        f"coalesce(CAST({c} AS VARCHAR), 'null')" if f in ("price_cents", "stock")
        else f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
    )
    entry = ", ".join(
        f"CASE WHEN action = 'create' AND w_{f}.v IS NOT NULL THEN '\"{f}\":' || {shown(f'w_{f}.v', f)} "
        f"WHEN action = 'update' AND w_{f} IS NOT NULL AND w_{f}.v IS DISTINCT FROM o_{f}.v "
        f"THEN '\"{f}\":[' || {shown(f'o_{f}.v', f)} || ',' || {shown(f'w_{f}.v', f)} || ']' END"
        for f in sets
    )
    CTES[f"{p}_audit"] = f"""
      SELECT import_id, row_number, batch_number, sku, action, '{{' || concat_ws(',', {entry}) || '}}' AS fields_json
      FROM {p}_history WHERE action IN ('create', 'update')"""
    finals = ", ".join(f"last_value(w_{f} IGNORE NULLS) OVER ({window} UNBOUNDED FOLLOWING).v AS {f}" for f in sets)
    CTES[f"{p}_merged"] = f"""
      SELECT * FROM (SELECT catalog_id, sku, import_id, {finals}, last_value(row_hash) OVER ({window} UNBOUNDED FOLLOWING) AS row_hash,
        row_number() OVER (PARTITION BY catalog_id, sku ORDER BY import_id DESC, row_number DESC) AS back FROM {p}_writes)
      WHERE back = 1"""


validation_steps("feed", _DATA)
_DENSE = "row_number() OVER (PARTITION BY r.import_id ORDER BY r.row_number) AS row_number"
validation_steps("coded", _DATA.replace("r.row_number", _DENSE), coded=True)
validation_steps("file", _FILES)

CTES["products"] = f"""
  SELECT catalog_id, sku, name, price_cents + CASE WHEN part % 4 >= 2 THEN 100 ELSE 0 END AS price_cents,
    CASE WHEN s_stock THEN stock ELSE 0 END AS stock, category, description,
    image_url, CASE WHEN part % 4 >= 2 THEN sha256('old' || row_hash) ELSE row_hash END AS row_hash,
    import_id AS last_import_id, '{STORED_AT}' AS updated_at
  FROM (SELECT *, CAST(substr(sku, 3) AS BIGINT) AS part FROM feed_valid)
  WHERE part % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY catalog_id, sku ORDER BY import_id DESC, row_number DESC) = 1"""

load_steps("feed", "products")
load_steps("file", None)
CTES["hot_valid"] = "SELECT * REPLACE (CASE WHEN row_number % 3 = 0 THEN 'HOT' ELSE sku END AS sku) FROM feed_valid"
load_steps("hot", "products")

CTES["ledger"] = "SELECT * FROM feed_book WHERE import_id % 2 = 1 AND batch_number <= 2"
CTES["dry"] = """
  SELECT l.import_id, l.catalog_id, l.sku, l.row_number, l.row_hash, CASE WHEN p.sku IS NULL THEN 'create'
    WHEN p.row_hash = l.row_hash THEN 'skip' ELSE 'update' END AS action
  FROM feed_last l LEFT JOIN products p ON p.catalog_id = l.catalog_id AND p.sku = l.sku"""
CTES["dry_counts"] = """
  SELECT import_id, count(*) FILTER (action = 'create') AS would_create,
    count(*) FILTER (action = 'update') AS would_update, count(*) FILTER (action = 'skip') AS would_skip
  FROM dry GROUP BY import_id"""
CTES["totals"] = """
  SELECT import_id, count(*) AS total_rows, count(*) FILTER (NOT valid) AS error_rows,
    count(*) FILTER (has_replacement OR seen_at IS NOT NULL) AS warning_rows
  FROM feed_checked LEFT JOIN (SELECT import_id, row_number, seen_at FROM feed_repeats) USING (import_id, row_number)
  GROUP BY import_id"""
CTES["applied"] = """
  SELECT import_id, CAST(sum(created_count) AS BIGINT) AS created_count, CAST(sum(updated_count) AS BIGINT) AS
    updated_count, CAST(sum(skipped_count) AS BIGINT) AS skipped_count FROM feed_book GROUP BY import_id"""
CTES["signed"] = f"""
  SELECT import_id, array_to_string(list_sort(headers), '|') AS coded,
    sha256(array_to_string(headers, {US})) AS contract FROM import_headers"""
CTES["templates"] = """
  SELECT source_label AS name, '{"sku":"SKU","from":"' || i.import_id || '"}' AS mapping_json,
    contract AS header_signature, CASE WHEN i.import_id % 2 = 0 THEN 1767225600 + i.import_id * 60 END AS last_used_at
  FROM imports i JOIN signed s ON i.import_id = s.import_id WHERE i.import_id % 3 = 0"""

# --- documents as files ----------------------------------------------------------------------

CP_BYTES = (128, 130, 131, 132, 133, 134, 135, 136, 137, 138, 139, 140, 142, 145, 146, 147, 148, 149, 150, 151, 152,
            153, 154, 155, 156, 158, 159)
CP_CHARS = [ord(bytes([b]).decode("cp1252")) for b in CP_BYTES]
CTES["plain"] = """SELECT doc_id, replace(text, '"', '''') AS text FROM documents"""
CTES["bytes"] = f"""
  SELECT doc_id, text, CASE doc_id % 6
    WHEN 1 THEN unhex('EFBBBF') || encode(text) WHEN 2 THEN unhex('E92C780A') || encode(text)
    WHEN 5 THEN encode(replace(text, ' ', ';')) ELSE encode(text) END AS content,
    CASE doc_id % 6 WHEN 2 THEN 'windows-1252' WHEN 3 THEN 'utf-16le' WHEN 4 THEN 'utf-16be' ELSE 'utf-8' END AS encoding
  FROM plain"""
_as_1252 = (
    "array_to_string(list_transform(regexp_extract_all(hex({0}), '..'), lambda h: translate("
    f"chr(CAST('0x' || h AS INTEGER)), {' || '.join(f'chr({b})' for b in CP_BYTES)}, "
    f"{' || '.join(f'chr({c})' for c in CP_CHARS)})), '')"
)
CTES["decoded"] = f"""
  SELECT doc_id, encoding, CASE encoding WHEN 'windows-1252' THEN {_as_1252.format("content")}
    WHEN 'utf-8' THEN replace(decode(content), chr(65279), '') ELSE text END AS text FROM bytes"""


def _cut(n: int) -> str:
    return "coalesce(" + ", ".join(f"try(decode(array_slice(content, 1, {n - k})))" for k in range(4)) + ")"


CTES["heads"] = f"""
  SELECT doc_id, encoding, CASE encoding WHEN 'windows-1252' THEN {_as_1252.format("array_slice(content, 1, 65536)")}
    WHEN 'utf-8' THEN replace({_cut(65536)}, chr(65279), '') ELSE left(text, 32767) END AS head FROM bytes"""
CTES["samples"] = """
  SELECT doc_id, encoding, CASE WHEN contains(head, chr(10)) THEN
    left(head, length(head) - strpos(reverse(head), chr(10)) + 1) ELSE head END AS sample FROM heads"""
CTES["doc_lines"] = """
  SELECT doc_id, line_no, list_lines[line_no] AS line FROM (
    SELECT doc_id, list_lines, unnest(range(1, len(list_lines) + 1)) AS line_no FROM (
      SELECT doc_id, string_split_regex(regexp_replace(sample, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') AS list_lines
      FROM samples))"""
CTES["candidates"] = """
  SELECT * FROM (VALUES (1, ','), (2, ';'), (3, chr(9)), (4, '|')) AS c(rank, delimiter)"""
CTES["shapes"] = f"""
  SELECT doc_id, rank, delimiter, len(string_split(line, delimiter)) AS n_columns, count(*) AS n_records
  FROM doc_lines, candidates WHERE line_no <= 50 AND trim(replace(line, delimiter, ''), {WS}) <> '' GROUP BY ALL"""
CTES["scores"] = """
  SELECT d.doc_id, c.rank, c.delimiter, CASE WHEN n_columns >= 2 THEN n_records ELSE 0 END AS score, n_columns
  FROM documents d CROSS JOIN candidates c LEFT JOIN (
    SELECT * FROM shapes QUALIFY row_number() OVER (PARTITION BY doc_id, rank ORDER BY n_records DESC, n_columns DESC) = 1
  ) USING (doc_id, rank)"""
CTES["best"] = """
  SELECT doc_id, CASE WHEN score > 0 THEN delimiter ELSE ',' END AS delimiter, NOT score > 0 AS delimiter_uncertain
  FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1"""
CTES["tops"] = f"""
  SELECT doc_id, delimiter, delimiter_uncertain, list_transform(string_split(line, delimiter),
    lambda c: trim(nfc_normalize(c), {WS})) AS headers
  FROM best LEFT JOIN doc_lines USING (doc_id)
  WHERE trim(replace(line, delimiter, ''), {WS}) <> ''
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1"""
CTES["headed"] = """
  SELECT b.doc_id, encoding, b.delimiter, b.delimiter_uncertain, coalesce(headers, []) AS headers
  FROM best b JOIN bytes USING (doc_id) LEFT JOIN tops t ON t.doc_id = b.doc_id"""

# --- queries ---------------------------------------------------------------------------------

Q = ORACLE
REPORT = "import_id, phase, row_number, column_name, code, severity, message"
_cells = ("sku_raw", "name_raw", "price_raw", "stock_raw", "category_raw", "description_raw", "image_raw")


def record_sql(description: str = "description_raw") -> str:
    cells = ", ".join(description if c == "description_raw" else c for c in _cells)
    return f"array_to_string(list_slice([{cells}, 'extra'], 1, n_cells), {MARK})"


Q["feed_admission"] = """
  SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN strlen(text) = 0 THEN 'validation_failed'
    WHEN strlen(text) > 4000 THEN 'file_too_large' END AS code FROM documents"""
_broken = "CASE WHEN import_id % 7 = 0 AND n % 53 = 0 THEN 'two' || chr(10) || 'lines ' ELSE '' END || description_raw"
_file = f"import_id * {FILES_PER_IMPORT} + (n - 1) // {FILE_ROWS}"
Q["feed_scan"] = f"""
  SELECT {_file} AS file_id, (n - 1) % {FILE_ROWS} + 2 AS row_number, CAST(n_cells AS BIGINT) AS n_cells,
    {record_sql(_broken)} AS record FROM raw
  UNION ALL SELECT DISTINCT {_file}, 1, 7, array_to_string(['SKU','Title','Price','Qty','Group','Text','Image'], {MARK}) FROM raw"""
_as_written = f"""CASE WHEN ({_file}) // {FILES_PER_IMPORT} % 4 = 1
    THEN translate({{0}}, chr(65533) || chr(769) || chr(8364), '???') ELSE {{0}} END"""
Q["feed_scan_encodings"] = f"""
  SELECT {_file} AS file_id, (n - 1) % {FILE_ROWS} + 2 AS row_number, CAST(n_cells AS BIGINT) AS n_cells,
    {_as_written.format("(" + record_sql(_broken) + ")")} AS record FROM raw
  UNION ALL SELECT DISTINCT {_file}, 1, 7, array_to_string(['SKU','Title','Price','Qty','Group','Text','Image'], {MARK}) FROM raw"""
Q["decode_lenient"] = """
  SELECT doc_id, encoding, length(text) AS n_chars, sha256(text) AS text_sha256 FROM decoded"""
Q["blank_filter"] = "SELECT import_id, row_number, CAST(n_cells AS BIGINT) AS n_cells FROM raw WHERE n % 211 <> 0"
Q["feed_preview"] = f"""
  SELECT import_id, row_number, {record_sql()} AS record FROM raw WHERE row_number <= 21 AND n % 211 <> 0
  UNION ALL SELECT import_id, 1, array_to_string(headers, {MARK}) FROM import_headers"""
Q["header_rule"] = """
  SELECT import_id, row_number + late AS row_number, 'data' AS kind FROM (
    SELECT *, CASE WHEN import_id % 3 = 0 THEN 1 ELSE 0 END AS late FROM raw)
  UNION ALL SELECT import_id, row_number + late, 'preview' FROM (
    SELECT *, CASE WHEN import_id % 3 = 0 THEN 1 ELSE 0 END AS late FROM raw) WHERE row_number <= 21 AND n % 211 <> 0
  UNION ALL SELECT import_id, CASE WHEN import_id % 3 = 0 THEN 2 ELSE 1 END, 'preview' FROM imports"""


def feed_line_sql(description: str) -> str:
    def cell(c: str) -> str:
        special = f"(contains({c}, ',') OR contains({c}, '\"') OR contains({c}, chr(10)) OR contains({c}, chr(13)))"
        return f"CASE WHEN {special} THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"

    cells = ", ".join(cell(f"({description})" if c == "description_raw" else c) for c in _cells)
    return f"array_to_string(list_slice([{cells}], 1, least(n_cells, 7)), ',') || CASE WHEN n_cells = 8 THEN ',extra' ELSE '' END"


Q["feed_listing"] = f"""
  SELECT import_id, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256 FROM (
    SELECT {_file} AS import_id, 'SKU,Title,Price,Qty,Group,Text,Image' || chr(10)
      || string_agg({feed_line_sql(_broken)} || chr(10), '' ORDER BY n) AS content FROM raw GROUP BY {_file})"""

Q["feed_admission_files"] = f"""
  SELECT import_id, size, CASE WHEN size > 50000 THEN 'file_too_large' END AS code FROM ({Q["feed_listing"]})"""
Q["feed_preview_files"] = f"""
  SELECT file_id AS import_id, row_number, record FROM ({Q["feed_scan"]}) WHERE row_number <= 21
    AND trim(replace(record, {MARK}, '')) <> ''"""


def escaped(c: str, always: bool) -> str:
    quoted = "'\"' || replace({0}, '\"', '\"\"') || '\"'"
    pre = f"CASE WHEN regexp_matches({c}, '^[@=+-]') THEN '''' || {c} ELSE {c} END"
    special = f"(contains({c}, ',') OR contains({c}, '\"') OR contains({c}, chr(10))" + (f" OR contains({c}, chr(13)))" if always else ")")
    return f"CASE WHEN {special} THEN {quoted.format('(' + (pre if always else c) + ')')} ELSE {pre} END"


def line_sql(columns: tuple[str, ...], always: bool) -> str:
    return " || ',' || ".join("(" + escaped(f"coalesce(CAST({c} AS VARCHAR), '')", always) + ")" for c in columns)


Q["report_csv"] = f"""
  SELECT import_id, row_number, {line_sql(("row_number", "phase", "severity", "column_name", "code", "message"), True)} AS line
  FROM feed_report"""
Q["report_csv_coded"] = f"""
  SELECT import_id, row_number, {line_sql(("row_number", "phase", "column_name", "code", "severity", "message"), False)} AS line
  FROM coded_report"""
Q["report_files"] = f"""
  SELECT import_id, {line_sql(("row_number", "phase", "severity", "column_name", "code", "message"), True)} AS line
  FROM feed_report UNION ALL SELECT import_id, 'row_number,phase,severity,column,code,message' FROM imports"""
Q["csv_escape"] = f"""
  SELECT doc_id, {escaped("value", False)} AS coded, {escaped("value", True)} AS contract FROM (
    SELECT doc_id, ['=', '+', '', '@', '-'][doc_id % 5 + 1] || text
      || CASE WHEN doc_id % 3 = 0 THEN '"' ELSE '' END AS value FROM documents)"""
Q["json_columns"] = """
  SELECT event_id, k, '{"k":' || k || '}' AS written FROM (
    SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events)"""
Q["detect_encoding"] = "SELECT doc_id, encoding FROM bytes"
Q["detect_encoding_cut"] = f"""
  SELECT doc_id, encoding, CASE WHEN encoding = 'utf-8' THEN CAST(strlen({_cut(1000)}) AS BIGINT) END AS kept_bytes FROM bytes"""
Q["delimiter_histogram"] = "SELECT doc_id, delimiter, n_columns, n_records FROM shapes"
Q["delimiter_score"] = "SELECT doc_id, delimiter, CAST(score AS BIGINT) AS score, n_columns FROM scores"
Q["detect_delimiter"] = "SELECT doc_id, delimiter, delimiter_uncertain FROM best"
Q["read_headers"] = "SELECT doc_id, len(headers) AS n_headers, array_to_string(headers, '|') AS headers FROM headed"
Q["detect_feeds"] = """
  SELECT doc_id, encoding, delimiter, delimiter_uncertain, array_to_string(headers, '|') AS headers FROM headed"""
Q["feed_options"] = """
  SELECT import_id, CASE import_id % 5 WHEN 0 THEN '|' WHEN 1 THEN ',' ELSE delimiter END AS delimiter,
    CASE import_id % 3 WHEN 0 THEN 'windows-1252' ELSE 'utf-8' END AS encoding FROM imports"""
Q["mapping_errors"] = """
  SELECT import_id, 'price' AS field, 'price is required' AS message FROM imports WHERE import_id % 6 = 0
  UNION ALL SELECT import_id, 'name', 'Header "Bogus" not found in file' FROM imports WHERE import_id % 6 = 1
  UNION ALL SELECT import_id, 'color', 'Unknown field: color' FROM imports WHERE import_id % 6 = 2
  UNION ALL SELECT import_id, 'sku', 'sku is required' FROM imports WHERE import_id % 6 = 3"""
Q["mapping_invert"] = """
  SELECT import_id, field, header, CASE WHEN field = 'sku' AND import_id % 9 = 0 THEN 2 ELSE 1 END AS times FROM import_fields"""
Q["map_columns"] = """
  SELECT import_id, row_number, catalog_id, sku_raw, name_raw, price_raw, stock_raw, category_raw, description_raw,
    image_raw AS image_url_raw, has_replacement FROM feed_data"""
Q["header_signature"] = "SELECT * FROM signed"
Q["template_match"] = """
  SELECT s.import_id, s.contract AS header_signature, t.name AS template_name, t.mapping_json
  FROM signed s LEFT JOIN (SELECT * FROM templates QUALIFY row_number() OVER (PARTITION BY header_signature
    ORDER BY last_used_at DESC NULLS LAST, name DESC) = 1) t ON t.header_signature = s.contract"""
Q["template_upsert"] = """
  SELECT coalesce(t.name, n.name) AS name, coalesce(n.mapping_json, t.mapping_json) AS mapping_json,
    coalesce(t.header_signature, 'new') AS header_signature,
    CASE WHEN t.name IS NULL THEN NULL WHEN n.name IS NOT NULL THEN 1769904000 ELSE t.last_used_at END AS last_used_at
  FROM templates t FULL OUTER JOIN (SELECT source_label AS name, '{"sku":"new-' || import_id || '"}' AS mapping_json
    FROM imports WHERE import_id % 2 = 0) n ON t.name = n.name"""
Q["template_delete"] = """
  SELECT * FROM templates WHERE name NOT IN (SELECT source_label FROM imports WHERE import_id % 2 = 0)"""
Q["import_summary"] = """
  SELECT i.import_id, catalog_id, source_label, original_filename, delimiter, encoding, state, total_rows, error_rows,
    warning_rows, '{"would_create":' || would_create || ',"would_update":' || would_update || ',"would_skip":'
      || would_skip || '}' AS dry_run,
    '{"created":' || coalesce(c, 0) || ',"updated":' || coalesce(u, 0) || ',"skipped":' || coalesce(s, 0) || '}' AS result,
    batch_size, CASE WHEN i.import_id % 11 = 0 THEN '' ELSE array_to_string(headers, '|') END AS headers,
    CASE WHEN i.import_id % 7 <> 0 AND m_image THEN image_header END AS image_header
  FROM imports i JOIN import_headers h ON h.import_id = i.import_id
  LEFT JOIN totals t ON t.import_id = i.import_id LEFT JOIN dry_counts d ON d.import_id = i.import_id
  LEFT JOIN (SELECT import_id, sum(created_count) AS c, sum(updated_count) AS u, sum(skipped_count) AS s
    FROM ledger GROUP BY import_id) l ON l.import_id = i.import_id"""
Q["safe_filename"] = """
  SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'upload.csv'
    ELSE left(replace(replace(url || '\\x' || repeat(url, 8), '/', '_'), '\\', '_'), 255) END AS filename FROM pages"""
_pad = "[' ' || chr(9), chr(65279) || chr(160) || chr(12288), chr(8232) || chr(13) || chr(10), chr(8203)][doc_id % 4 + 1]"
Q["js_trim"] = f"""
  SELECT doc_id, length(x) AS n, sha256(x) AS sha FROM (SELECT doc_id, trim({_pad} || text || {_pad}, {WS}) AS x FROM documents)"""
Q["normalize_text"] = f"""
  SELECT doc_id, length(x) AS n, sha256(x) AS sha FROM (
    SELECT doc_id, {text_sql("CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'e' || chr(769)) ELSE text END")} AS x FROM documents)"""
Q["excerpt"] = """
  SELECT doc_id, CASE WHEN length(x) <= 64 THEN x ELSE left(x, 64) || '...' END AS shown FROM (
    SELECT doc_id, text AS x FROM documents)"""
CTES["unspaced"] = "SELECT import_id, row_number, price_raw AS x FROM raw"
Q["strip_currency"] = """
  SELECT import_id, row_number, CASE WHEN n % 12 = 4 THEN substr(price_raw, 2) WHEN n % 12 = 5 THEN
    left(price_raw, length(price_raw) - 4) WHEN n % 12 = 11 THEN substr(price_raw, 3) ELSE price_raw END AS value,
    n % 12 IN (4, 5, 11) AS stripped FROM raw"""
Q["parse_decimal"] = """
  SELECT import_id, row_number, CASE WHEN whole IS NOT NULL THEN neg END AS negative, whole AS integer,
    CASE WHEN whole IS NOT NULL THEN frac END AS fraction FROM raw_price_parts"""
Q["parse_price"] = f"SELECT import_id, row_number, {price_case('value')} AS value, {price_case('error')} AS error FROM raw_price_parts"
Q["parse_stock"] = f"SELECT import_id, row_number, {stock_case('value')} AS value, {stock_case('error')} AS error FROM raw_stock_parts"
Q["normalize_url"] = """
  SELECT page_id, CASE page_id % 5 WHEN 1 THEN NULL WHEN 2 THEN upper(url) ELSE url END AS value,
    CASE WHEN page_id % 5 = 1 THEN 'invalid' END AS error FROM pages"""
_all7 = ", ".join(
    f"'{k}=' || coalesce(CAST({k} AS VARCHAR), '(null)')"
    for k in ("category", "description", "image_url", "name", "price_cents", "sku", "stock")
)
Q["row_hash"] = f"""
  SELECT import_id, row_number, sha256(concat_ws({US}, {_all7})) AS all_fields, row_hash AS mapped_fields FROM feed_valid"""
Q["price_display"] = """
  SELECT import_id, balance_cents, CASE WHEN balance_cents < 0 THEN '-' ELSE '' END || (abs(balance_cents) // 100) || '.'
    || lpad(CAST(abs(balance_cents) % 100 AS VARCHAR), 2, '0') AS shown FROM imports"""
for _name, _test in {
    "v_columns_mismatch": "code = 'columns_mismatch'",
    "v_missing_required": "code = 'missing_required'",
    "v_price": "code LIKE 'price%'",
    "v_stock": "code LIKE 'stock%'",
    "v_field_too_long": "code = 'field_too_long'",
    "v_url": "code = 'url_invalid'",
    "v_replacement": "code = 'encoding_replacement'",
}.items():
    Q[_name] = f"SELECT * FROM feed_found WHERE {_test}"
Q["duplicate_sku"] = "SELECT * FROM feed_repeat_found"
Q["normalized_rows"] = """
  SELECT import_id, row_number, sku, name, price_cents, coalesce(stock, 0) AS stock, category, description, image_url,
    row_hash FROM feed_valid"""
Q["row_report"] = f"SELECT {REPORT} FROM feed_report"
Q["row_report_coded"] = f"SELECT {REPORT} FROM coded_report"
Q["row_cap"] = """
  SELECT import_id, total_rows, CASE WHEN total_rows > 600 THEN 'failed' ELSE 'validating' END AS state,
    CASE WHEN total_rows > 600 THEN 'row_limit_exceeded' END AS pause_reason
  FROM (SELECT import_id, count(*) FILTER (n % 211 <> 0) AS total_rows FROM raw GROUP BY import_id)"""
Q["report_replace"] = """
  SELECT import_id, CASE WHEN row_number % 10 = 0 THEN 'apply' ELSE 'validate' END AS phase, row_number, column_name, code,
    severity, 'old' AS message FROM feed_report WHERE import_id % 3 <> 0 OR row_number % 10 = 0
  UNION ALL SELECT * FROM feed_report WHERE import_id % 3 = 0"""
Q["report_store"] = f"SELECT {REPORT} FROM feed_report WHERE import_id % 3 <> 0"
CTES["outcomes"] = """
  SELECT i.import_id, CASE WHEN i.import_id % 9 = 0 THEN 'no_mapping' WHEN n_rows > 600 THEN 'row_limit_exceeded' END AS reason
  FROM imports i LEFT JOIN (SELECT import_id, count(*) FILTER (n % 211 <> 0) AS n_rows FROM raw GROUP BY import_id) r
    ON r.import_id = i.import_id"""
Q["import_outcomes"] = "SELECT o.import_id, CASE WHEN reason IS NULL THEN 'validated' ELSE 'failed' END AS state, reason, " + ", ".join(
    f"CASE WHEN reason IS NULL THEN coalesce({c}, 0) END AS {c}"
    for c in ("total_rows", "error_rows", "warning_rows", "would_create", "would_update", "would_skip")
) + " FROM outcomes o LEFT JOIN totals t ON t.import_id = o.import_id LEFT JOIN dry_counts d ON d.import_id = o.import_id"
Q["row_numbers"] = """
  SELECT import_id, row_number, row_number() OVER (PARTITION BY import_id ORDER BY row_number) AS data_row
  FROM raw WHERE n % 211 <> 0"""
Q["report_page"] = f"""
  SELECT {REPORT}, count(*) OVER () AS total FROM feed_report WHERE import_id = 1 AND severity = 'error'
  ORDER BY row_number, code, column_name NULLS FIRST, message LIMIT 20 OFFSET 20"""
Q["last_wins"] = "SELECT import_id, catalog_id, sku, row_number, row_hash FROM feed_last"
Q["dry_run_rows"] = "SELECT * FROM dry"
for _action in ("create", "skip", "update"):
    Q[f"would_{_action}"] = f"SELECT import_id, sku, row_number FROM dry WHERE action = '{_action}'"
Q["import_history"] = """
  SELECT import_id, catalog_id, catalog_name, source_label, state FROM imports JOIN catalogs USING (catalog_id)
  ORDER BY import_id DESC LIMIT 50"""
Q["catalog_counts"] = """
  SELECT catalog_id, catalog_name, count(sku) AS product_count FROM catalogs LEFT JOIN products USING (catalog_id) GROUP BY ALL"""
Q["product_last_import"] = """
  SELECT p.catalog_id, sku, price_cents, last_import_id, original_filename AS last_import_file
  FROM products p LEFT JOIN imports i ON i.import_id = p.last_import_id"""
Q["unknown_catalog"] = "SELECT import_id, CAST(9999 AS BIGINT) AS catalog_id FROM imports WHERE import_id % 10 = 0"
Q["validation_totals"] = "SELECT * FROM totals"
Q["dry_run_counts"] = "SELECT * FROM dry_counts"
Q["batch_plan"] = """
  SELECT import_id, batch_number, min(row_number) AS first_row, max(row_number) AS last_row, count(*) AS n_rows
  FROM feed_batched GROUP BY ALL"""
Q["batch_ledger"] = "SELECT * FROM feed_book"
Q["apply_totals"] = "SELECT * FROM applied"
Q["import_page"] = """
  SELECT import_id, catalog_id, source_label, state, count(*) OVER () AS total FROM imports WHERE catalog_id = 1 ORDER BY import_id DESC LIMIT 3 OFFSET 3"""
Q["template_list"] = "SELECT * FROM templates ORDER BY last_used_at DESC NULLS LAST, name"
Q["change_page"] = """
  SELECT *, count(*) OVER () AS total FROM feed_audit WHERE import_id = 2 AND action = 'update' ORDER BY row_number LIMIT 20 OFFSET 20"""
Q["product_search"] = """
  SELECT catalog_id, sku, name, price_cents, stock, last_import_id, count(*) OVER () AS total FROM products
  WHERE catalog_id = 2 AND (contains(lower(sku), 'ring') OR contains(lower(name), 'ring')) ORDER BY sku LIMIT 50"""
Q["apply_actions"] = "SELECT import_id, row_number, batch_number, catalog_id, sku, action FROM feed_acts"
Q["apply_changes"] = "SELECT * FROM feed_audit"
Q["apply_hot"] = "SELECT * FROM hot_audit"
Q["merged_catalog"] = f"""
  SELECT m.catalog_id, m.sku, m.name, m.price_cents, m.stock, m.category, m.description, m.image_url, m.row_hash,
    CASE WHEN import_id = 0 THEN last_import_id ELSE import_id END AS last_import_id,
    CASE WHEN import_id = 0 THEN updated_at ELSE '{APPLIED_AT}' END AS updated_at
  FROM feed_merged m LEFT JOIN products p ON p.catalog_id = m.catalog_id AND p.sku = m.sku"""
Q["ledger_dedupe"] = """
  SELECT import_id, row_number, batch_number FROM feed_batched
  WHERE NOT (import_id % 2 = 1 AND batch_number <= 2)"""
Q["resume_rows"] = Q["ledger_dedupe"]
Q["reimport_noop"] = """
  SELECT import_id, row_number, sku, CASE WHEN seen IS NULL THEN 'create' WHEN seen = row_hash THEN 'skip' ELSE 'update' END AS action
  FROM (SELECT *, lag(row_hash) OVER (PARTITION BY catalog_id, sku ORDER BY import_id, row_number) AS seen FROM (
    SELECT catalog_id, sku, import_id, row_number, row_hash FROM feed_valid
    UNION ALL SELECT catalog_id, sku, 0, 0, row_hash FROM feed_merged)) WHERE import_id > 0"""
Q["file_integrity"] = f"""
  SELECT DISTINCT {_file} AS import_id, 'failed' AS state, 'file_missing' AS pause_reason FROM raw
  WHERE ({_file}) % 10 = 0 OR ({_file}) % 15 = 0"""
Q["apply_progress"] = """
  SELECT i.import_id, state, coalesce(valid_rows, 0) AS valid_rows, CAST(coalesce(done, 0) AS BIGINT) AS processed_rows,
    coalesce(last, 0) + CASE WHEN state = 'applying' THEN 1 ELSE 0 END AS current_batch, coalesce(batches, 0) AS total_batches
  FROM imports i LEFT JOIN (SELECT import_id, count(*) AS valid_rows, max(batch_number) AS batches FROM feed_batched
    GROUP BY import_id) b ON b.import_id = i.import_id
  LEFT JOIN (SELECT import_id, sum(created_count + updated_count + skipped_count) AS done, max(batch_number) AS last
    FROM ledger GROUP BY import_id) l ON l.import_id = i.import_id"""
Q["ledger_gaps"] = """
  SELECT * FROM (SELECT import_id, batch_number,
    coalesce(lag(batch_number) OVER (PARTITION BY import_id ORDER BY batch_number), 0) AS previous_batch
    FROM feed_book WHERE (import_id + batch_number) % 3 <> 0) WHERE batch_number <> previous_batch + 1"""
Q["reconcile"] = """
  SELECT coalesce(d.import_id, a.import_id) AS import_id, coalesce(would_create, 0) AS would_create,
    coalesce(created_count, 0) AS created_count, coalesce(would_update, 0) AS would_update,
    coalesce(updated_count, 0) AS updated_count, coalesce(would_skip, 0) AS would_skip,
    coalesce(skipped_count, 0) AS skipped_count,
    coalesce(would_create, 0) = coalesce(created_count, 0) AND coalesce(would_update, 0) = coalesce(updated_count, 0)
      AND coalesce(would_skip, 0) = coalesce(skipped_count, 0) AS reconciled
  FROM dry_counts d FULL OUTER JOIN applied a ON a.import_id = d.import_id"""
Q["stream_report"] = f"SELECT {REPORT} FROM file_report"
Q["stream_apply"] = """
  SELECT catalog_id, sku, name, price_cents, stock, category, description, image_url, row_hash,
    import_id AS last_import_id FROM file_merged"""
Q["load_job"] = "SELECT * FROM file_book"
Q["load_audit"] = "SELECT * FROM file_audit"
CTES["parts"] = """
  SELECT *, row_number > 300 AS late, CASE WHEN row_number > 300 THEN 70 WHEN import_id % 2 = 0 THEN 50 ELSE 100 END AS size,
    lag(row_hash) OVER (PARTITION BY catalog_id, sku ORDER BY row_number > 300, import_id, row_number) AS seen FROM feed_valid"""
CTES["part_batches"] = """
  SELECT *, (row_number() OVER (PARTITION BY import_id, late ORDER BY row_number) - 1) // size + 1 AS own FROM parts"""
Q["load_resume"] = """
  SELECT import_id, own + CASE WHEN late THEN coalesce((SELECT max(own) FROM part_batches e
      WHERE e.import_id = p.import_id AND NOT e.late), 0) ELSE 0 END AS batch_number,
    min(row_number) AS first_row, max(row_number) AS last_row,
    count(*) FILTER (seen IS NULL) AS created_count,
    count(*) FILTER (seen IS NOT NULL AND seen <> row_hash) AS updated_count,
    count(*) FILTER (seen = row_hash) AS skipped_count
  FROM part_batches p GROUP BY ALL"""

Q["report_page_stored"] = Q["report_page"]
Q["change_page_stored"] = Q["change_page"]
Q["product_search_indexed"] = Q["product_search"]
CTES["writes"] = """
  SELECT * FROM (SELECT *, lag(row_hash) OVER (PARTITION BY catalog_id, sku ORDER BY import_id, row_number) AS seen FROM feed_valid)
  WHERE seen IS NULL OR seen <> row_hash"""
Q["store_buckets"] = """
  SELECT catalog_id, sku, row_hash, import_id AS last_import_id FROM writes
  QUALIFY row_number() OVER (PARTITION BY catalog_id, sku ORDER BY import_id DESC, row_number DESC) = 1"""
Q["store_counts"] = "SELECT catalog_id, count(DISTINCT sku) AS product_count FROM feed_valid GROUP BY ALL"

del CTES["unspaced"]
ORACLE = {name: compose(sql) for name, sql in ORACLE.items()}
