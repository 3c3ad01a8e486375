"""Input views derived from the driver tables, in SQL that Spark and DuckDB share.

Each view is one SELECT over ``{part}``-style placeholders (base tables) or over
other views.  ``view`` gives it as a Spark DataFrame, ``ctes`` as a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from labelscan.session import tasks

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["products_v"] = """
SELECT cast(k AS string) AS product_id,
  CASE WHEN k % 23 = 0 THEN NULL WHEN k % 29 = 0 THEN '7' ELSE p_name END AS product_name,
  CASE WHEN p_type = 'ECONOMY' THEN 'food' WHEN p_type = 'PROMO' THEN 'cosmetics' ELSE 'general' END AS product_type,
  CASE WHEN k % 7 = 0 THEN true WHEN k % 11 = 0 THEN NULL ELSE false END AS is_imported,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'MRP on pack' WHEN k % 5 = 0 THEN ('Rs. ' || price)
    WHEN k % 31 = 0 THEN ('₹' || price || ' (Rs 0.50/g) incl. of all taxes')
    ELSE ('MRP Rs. ' || price || ' (incl. of all taxes)') END AS mrp,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 37 = 0 THEN 'a few'
    ELSE (cast(p_size AS string) || ' ' || CASE k % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'ml' WHEN 2 THEN 'N'
      WHEN 3 THEN 'sq m' WHEN 4 THEN 'furlong' ELSE 'g' END) END AS net_quantity,
  CASE WHEN k % 41 = 0 THEN NULL ELSE s_name END AS manufacturer_name,
  CASE WHEN k % 14 = 0 THEN NULL WHEN k % 4 = 1 THEN 'Plot 4, Sector 63, Noida'
    ELSE 'Plot 4, Sector 63, Noida - 201301' END AS manufacturer_address,
  CASE WHEN k % 43 = 0 THEN s_name ELSE NULL END AS packer_name,
  CASE WHEN k % 3 = 0 THEN (s_name || ' Imports') ELSE NULL END AS importer_name,
  CASE WHEN k % 14 = 0 THEN NULL ELSE cast(k % 14 AS string) END AS month_of_packing,
  CASE WHEN k % 53 = 0 THEN NULL WHEN k % 2 = 0 THEN '26' ELSE '2026' END AS year_of_packing,
  CASE WHEN k % 15 = 0 THEN NULL WHEN k % 8 = 3 THEN 'write to us' WHEN k % 2 = 0 THEN 'care@brand.example'
    ELSE '1800-100-1000' END AS consumer_care,
  CASE WHEN k % 4 = 0 THEN 'India' ELSE NULL END AS country_of_origin,
  CASE WHEN k % 2 = 0 THEN NULL WHEN k % 9 = 1 THEN 'ask' ELSE 'Rs 0.50/g' END AS unit_sale_price,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 10 = 1 THEN 'soon' WHEN k % 2 = 0 THEN 'Best Before 12 Months'
    ELSE '12/2027' END AS expiry_date,
  CASE WHEN k % 5 = 0 THEN NULL ELSE (p_size % 30) / cast(10 AS double) END AS font_size_mm,
  CASE WHEN k % 5 = 0 THEN NULL ELSE (p_size % 60) / cast(10 AS double) END AS contrast_ratio,
  CASE WHEN k % 5 = 0 THEN 'Front panel' WHEN k % 5 = 1 THEN 'Side' ELSE NULL END AS declaration_placement,
  CASE WHEN k % 6 = 0 THEN true WHEN k % 6 = 1 THEN false ELSE NULL END AS is_pdp_placement_valid,
  CASE WHEN k % 7 = 0 THEN true WHEN k % 7 = 1 THEN false ELSE NULL END AS is_legible,
  k AS product_key
FROM (SELECT p_partkey AS k, p_name, p_type, p_size,
        cast(cast(p_retailprice AS decimal(10,2)) AS string) AS price FROM {part}) p
LEFT JOIN (SELECT s_suppkey, s_name FROM {supplier}) s
  ON s.s_suppkey = p.k % (SELECT count(*) FROM {supplier})
"""

VIEWS["products_big_v"] = """
SELECT p.*, l.l_orderkey AS order_key FROM {lineitem} l JOIN {products_v} p ON p.product_key = l.l_partkey
"""

# the first part and supplier of every order
VIEWS["order_heads_v"] = """
SELECT l_orderkey, min(l_partkey) AS head_part, min(l_suppkey) AS head_supplier
FROM {lineitem} GROUP BY l_orderkey
"""

VIEWS["scans_v"] = """
SELECT ('scan-' || cast(o.o_orderkey AS string)) AS scan_id, cast(o.o_custkey AS string) AS user_id,
  cast(o.o_orderdate AS timestamp) AS ts,
  CASE o.o_orderstatus WHEN 'O' THEN 'COMPLIANT' WHEN 'F' THEN 'NON_COMPLIANT' ELSE 'PARTIAL' END AS compliance_status,
  p.p_name AS product_name, s.s_name AS manufacturer,
  ('B' || cast(o.o_orderkey AS string)) AS batch_number, o.o_orderkey AS scan_key
FROM {orders} o
LEFT JOIN {order_heads_v} h ON h.l_orderkey = o.o_orderkey
LEFT JOIN {part} p ON p.p_partkey = h.head_part
LEFT JOIN {supplier} s ON s.s_suppkey = h.head_supplier
"""

VIEWS["scan_core_v"] = """
SELECT ('scan-' || cast(o_orderkey AS string)) AS scan_id, cast(o_custkey AS string) AS user_id,
  cast(o_orderdate AS timestamp) AS ts,
  CASE o_orderstatus WHEN 'O' THEN 'COMPLIANT' WHEN 'F' THEN 'NON_COMPLIANT' ELSE 'PARTIAL' END AS compliance_status,
  o_orderkey AS scan_key
FROM {orders}
"""

VIEWS["violations_v"] = """
SELECT ('scan-' || cast(l.l_orderkey AS string)) AS scan_id,
  CASE l.l_linenumber WHEN 1 THEN 'mrp' WHEN 2 THEN 'netQuantity' WHEN 3 THEN 'fontSizeMm' WHEN 4 THEN 'readability'
    WHEN 5 THEN 'unitSalePrice' WHEN 6 THEN 'consumerCare' ELSE 'net_quantity' END AS field,
  CASE l.l_linenumber WHEN 1 THEN 'Maximum Retail Price (MRP) Declaration Check' WHEN 2 THEN 'Net Quantity Declaration Check'
    WHEN 3 THEN 'Font Size & Readability Analysis Check' WHEN 4 THEN 'Physical Legibility & Color Contrast Check'
    WHEN 5 THEN 'Unit Sale Price (USP) Declaration Check' WHEN 6 THEN 'Consumer Care Details Declaration Check'
    ELSE 'Net Quantity Declaration Check' END AS rule,
  ('Check line ' || cast(l.l_linenumber AS string) || '.') AS description,
  l.l_linenumber AS line_number, l.l_partkey AS part_key, l.l_extendedprice AS price
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderstatus IN ('F', 'P')
"""

VIEWS["scan_violations_v"] = """
SELECT scan_id, count(*) AS n_violations FROM {violations_v} GROUP BY scan_id
"""

# scans with their number of violations (0 when there are none)
VIEWS["scored_scans_v"] = """
SELECT s.*, coalesce(v.n_violations, 0) AS n_violations
FROM {scans_v} s LEFT JOIN {scan_violations_v} v ON v.scan_id = s.scan_id
"""

VIEWS["users_v"] = """
SELECT cast(c_custkey AS string) AS user_id, c_name AS full_name, c_acctbal >= 0 AS is_active FROM {customer}
"""

VIEWS["metrics_v"] = """
SELECT event_id AS image_id, value AS blur_score, cast((event_id * 37) % 256 AS double) AS brightness FROM {events}
"""

# images 0..2 of every product
VIEWS["images_v"] = """
SELECT p.*, i.image_idx FROM {products_v} p
[[i(image_idx): (0), (1), (2)]]
"""

_SCALED = "(((product_key * 7 + image_idx * 29) % 60) + 40)"

# one row per (scan, image) with the merge inputs as columns
VIEWS["image_values_v"] = f"""
SELECT product_id AS scan_id, product_key AS scan_key, image_idx,
  ('img' || cast(image_idx AS string) || '.jpg') AS file_name,
  CASE WHEN product_key % 9 = 0 AND image_idx = 2 THEN NULL
    WHEN product_key % 10 = 0 AND image_idx = 1 THEN (mrp || ' X') ELSE mrp END AS mrp,
  CASE WHEN product_key % 8 = 0 AND image_idx = 2 THEN NULL
    WHEN product_key % 12 = 0 AND image_idx = 1 THEN (net_quantity || ' net') ELSE net_quantity END AS net_quantity,
  CASE WHEN product_key % 15 = 0 AND image_idx = 1 THEN (manufacturer_name || ' Ltd') ELSE upper(manufacturer_name) END AS manufacturer_name,
  CASE WHEN product_key % 21 = 0 AND image_idx = 1 THEN '12' ELSE month_of_packing END AS month_of_packing,
  year_of_packing, consumer_care, country_of_origin, unit_sale_price,
  CASE WHEN product_key % 6 = 0 AND image_idx = 0 THEN ('B' || product_id)
    WHEN product_key % 6 = 0 AND image_idx = 1 THEN ('C' || product_id) ELSE NULL END AS batch_number,
  CASE WHEN product_key % 18 = 0 AND image_idx = 1 THEN (product_name || ' tested') ELSE product_name END AS product_name,
  CASE WHEN product_key % 50 = 0 THEN 0.75 ELSE {_SCALED} / cast(100 AS double) END AS mean_conf,
  CASE WHEN (product_key + image_idx) % 2 = 0 THEN 'MRP Net Qty Mfd by Batch No Consumer Care Country of Origin'
    ELSE 'plain text of the label' END AS full_text
FROM {{images_v}}
"""

VIEWS["image_fields_v"] = """
SELECT scan_id, image_idx, file_name, mean_conf, full_text, f.field,
  CASE f.field WHEN 'mrp' THEN mrp WHEN 'netQuantity' THEN net_quantity WHEN 'manufacturerName' THEN manufacturer_name
    WHEN 'monthOfPacking' THEN month_of_packing WHEN 'yearOfPacking' THEN year_of_packing
    WHEN 'consumerCare' THEN consumer_care WHEN 'countryOfOrigin' THEN country_of_origin
    WHEN 'unitSalePrice' THEN unit_sale_price WHEN 'batchNumber' THEN batch_number
    WHEN 'productName' THEN product_name ELSE 'false' END AS value
FROM {image_values_v} [[f(field): ('mrp'), ('netQuantity'), ('manufacturerName'), ('monthOfPacking'), ('yearOfPacking'),
  ('consumerCare'), ('countryOfOrigin'), ('unitSalePrice'), ('batchNumber'), ('productName'), ('isImported')]]
"""

# template lines of a label: one row per block
VIEWS["ocr_blocks_v"] = """
SELECT scan_id, image_idx, block_idx, text,
  CASE WHEN (k + line) % 41 = 0 THEN 0.05
    ELSE ((k * 7 + image_idx * 29 + line) % 60 + 40) / cast(100 AS double) END AS confidence,
  b_left AS x_min, b_top AS y_min, b_right AS x_max, b_bottom AS y_max
FROM (
  SELECT product_id AS scan_id, product_key AS k, image_idx, b.block_idx, b.line,
    CASE b.block_idx
      WHEN 0 THEN CASE WHEN k3 = 0 THEN ('Generic Name: ' || product_name) WHEN k3 = 1 THEN product_name
        ELSE ('Gold ' || product_name) END
      WHEN 1 THEN CASE WHEN odd = 1 THEN 'Net Quantity' ELSE ('Net Qty: ' || qty) END
      WHEN 2 THEN CASE WHEN odd = 1 THEN qty ELSE NULL END
      WHEN 3 THEN CASE WHEN product_key % 25 = 0 THEN 'MRP' WHEN odd = 1 THEN 'Maximum Retail Price'
        ELSE ('MRP Rs. ' || price || ' (incl. of all taxes)') END
      WHEN 4 THEN CASE WHEN product_key % 25 = 0 THEN '250ml' WHEN odd = 1 THEN ('Rs. ' || price) ELSE NULL END
      WHEN 5 THEN ('Mfg by ' || coalesce(manufacturer_name, 'Unknown') || ' Foods Pvt Ltd')
      WHEN 6 THEN 'Plot 4, Sector 63, Noida - 201301'
      WHEN 7 THEN CASE WHEN odd = 1 THEN 'Mfg Date' ELSE ('DOM: ' || mm || '/2026') END
      WHEN 8 THEN CASE WHEN odd = 1 THEN (mm || '/2026') ELSE NULL END
      WHEN 9 THEN ('Best Before ' || mm || '/2027')
      WHEN 10 THEN CASE WHEN product_key % 4 = 0 THEN 'Batch No' ELSE ('Batch No: B' || product_id) END
      WHEN 11 THEN CASE WHEN product_key % 4 = 0 THEN ('B' || product_id || 'X') ELSE NULL END
      WHEN 12 THEN 'Consumer Care: 1800-100-1000, care@brand.example'
      WHEN 13 THEN CASE WHEN product_key % 3 = 0 THEN 'Country of Origin' ELSE 'Product of India' END
      WHEN 14 THEN CASE WHEN product_key % 3 = 0 THEN 'India' ELSE NULL END
      WHEN 15 THEN CASE WHEN product_key % 3 = 1 THEN ('Imported by ' || coalesce(manufacturer_name, 'Unknown') || ' Imports Ltd') ELSE NULL END
      WHEN 16 THEN CASE WHEN product_key % 4 = 1 THEN ('Unit Sale Price: Rs. ' || price || '/kg') ELSE NULL END
    END AS text,
    b.b_left, 30 * b.line AS b_top, b.b_right, 30 * b.line + 20 AS b_bottom
  FROM (
    SELECT i.*, product_key % 2 AS odd, product_key % 3 AS k3,
      (cast(cast(product_key % 500 + 20 AS int) AS string) || ' ' || CASE product_key % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'kg' END) AS qty,
      (cast(cast(product_key % 900 + 10 AS int) AS string) || '.50') AS price,
      CASE WHEN product_key % 12 + 1 < 10 THEN ('0' || cast(cast(product_key % 12 + 1 AS int) AS string))
        ELSE cast(cast(product_key % 12 + 1 AS int) AS string) END AS mm
    FROM {images_v} i
  ) t [[b(block_idx, line, b_left, b_right): (0, 0, 20, 220), (1, 1, 20, 160), (2, 1, 180, 260), (3, 2, 20, 160),
    (4, 2, 180, 260), (5, 3, 20, 320), (6, 4, 20, 320), (7, 5, 20, 160), (8, 5, 180, 260), (9, 6, 20, 220), (10, 7, 20, 120),
    (11, 7, 140, 260), (12, 8, 20, 360), (13, 9, 20, 160), (14, 9, 180, 260), (15, 10, 20, 320), (16, 11, 20, 320)]]
  WHERE b.line <> product_key % 13
) x
WHERE text IS NOT NULL
"""

# labels whose lines are out of level: every block has a height and a shift of its own
_TILT = "(cast(scan_id AS int) * 7 + block_idx * 13) % 19 - 9"
VIEWS["tilted_blocks_v"] = f"""
SELECT scan_id, image_idx, block_idx, text, confidence, x_min, cast(y_min + {_TILT} AS int) AS y_min, x_max,
  cast(y_max + {_TILT} + (cast(scan_id AS int) * 5 + block_idx * 3) % 12 AS int) AS y_max
FROM {{ocr_blocks_v}}
"""

# labels that name their maker in one of six ways, by scan: a header, a maker line, an address line, a company
# beside a mark, a company in two pieces, a line below the minimum confidence
VIEWS["maker_blocks_v"] = """
SELECT scan_id, image_idx, block_idx, text, CASE WHEN k % 6 = 5 AND block_idx = 1 THEN 0.05 ELSE 0.9 END AS confidence,
  b_left AS x_min, cast(26 * block_idx + (k + block_idx) % 4 AS int) AS y_min, b_right AS x_max, cast(26 * block_idx + 20 + (k + block_idx) % 4 AS int) AS y_max
FROM (
  SELECT product_id AS scan_id, product_key AS k, image_idx, b.block_idx, b.b_left, b.b_right,
    CASE product_key % 6
      WHEN 0 THEN CASE b.block_idx WHEN 1 THEN ('Packed by ' || maker || ' Foods Pvt Ltd') WHEN 2 THEN 'Plot 4' WHEN 3 THEN 'Sector 63' WHEN 4 THEN 'licence 9' END
      WHEN 1 THEN CASE b.block_idx WHEN 1 THEN ('Made by ' || maker) WHEN 2 THEN 'Foods Pvt Ltd' WHEN 3 THEN 'Plot 4, Sector 63, Noida - 201301' END
      WHEN 2 THEN CASE b.block_idx WHEN 1 THEN ('Corp. Office: ' || maker || ' Limited') WHEN 2 THEN 'Plot 4, Sector 63, Noida - 201301' END
      WHEN 3 THEN CASE b.block_idx WHEN 1 THEN 'in Bengal by' WHEN 2 THEN (maker || ' Foods Pvt Ltd') WHEN 3 THEN 'Plot 4' WHEN 4 THEN 'Sector 63' WHEN 5 THEN 'under licence 9' END
      WHEN 4 THEN CASE b.block_idx WHEN 1 THEN maker WHEN 2 THEN 'Foods' WHEN 4 THEN 'ofce' WHEN 5 THEN 'Plot 4' END
      ELSE CASE b.block_idx WHEN 1 THEN ('ofce ' || maker || ' Foods Pvt Ltd') WHEN 2 THEN 'Plot 4, Sector 63, Noida - 201301' END
    END AS text
  FROM (SELECT i.*, coalesce(manufacturer_name, 'Unknown') AS maker FROM {images_v} i) t
  [[b(block_idx, b_left, b_right): (1, 20, 320), (2, 20, 160), (3, 20, 200), (4, 20, 120), (5, 20, 220)]]
) x
WHERE text IS NOT NULL
"""

# ``[[name(cols): (..), (..)]]`` repeats every row once per tuple: a generator in
# Spark, a join with a VALUES list for the checker
_TIMES = re.compile(r"\[\[(\w+)\(([^)]*)\):\s*(.*?)\]\]", re.S)
_REF = re.compile(r"\{([a-z_]\w*)\}")


def _deps(sql: str, seen: list[str] | None = None) -> list[str]:
    """View names that ``sql`` needs, dependencies first."""
    seen = [] if seen is None else seen
    for name in _REF.findall(sql):
        if name in VIEWS and name not in seen:
            _deps(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The table whose rows the views multiply, and its key. Its file is small beside what is made of it.
SPREAD = {"part": "p_partkey"}
#: Bytes of its file that one task takes at most, about 20,000 parts: a task's memory stays what it is as tables grow.
SPREAD_BYTES = 1 << 17


def _source(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A base table in Spark SQL. A file gives no more tasks than it has row groups, so the rows of a table that is
    multiplied afterwards are dealt to all cores first, as long as they are few, and to more tasks as they grow."""
    read = f"parquet.`{sf_dir}/{name}.parquet`"
    if name not in SPREAD:
        return read
    size = int(str(table(spark, sf_dir, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return f"(SELECT /*+ REPARTITION({max(tasks(spark), -(-size // SPREAD_BYTES))}, {SPREAD[name]}) */ * FROM {read})"


def sql_on(spark: SparkSession, sf_dir: str, sql: str, instead: dict[str, str] | None = None) -> DataFrame:
    """Run SQL with ``{table}`` and ``{view}`` placeholders on a data directory.

    ``instead`` names a temporary view to read in place of a table (a stream, say).
    """
    instead = instead or {}
    parts = _deps(sql)

    def bind(text: str) -> str:
        text = _TIMES.sub(
            lambda m: f"LATERAL VIEW inline(array({re.sub(r'(^|,\s*)[(]', r'struct(', m[3]).replace(')struct', '), struct')})) {m[1]} AS {m[2]}",
            text,
        )
        return _REF.sub(
            lambda m: m.group(1) if m.group(1) in VIEWS
            else instead[m.group(1)] if m.group(1) in instead
            else _source(spark, sf_dir, m.group(1)),
            text,
        )

    head = ",\n".join(f"{n} AS ({bind(VIEWS[n])})" for n in parts)
    body = bind(sql)
    return spark.sql(f"WITH {head}\n{body}" if head else body)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql_on(spark, sf_dir, f"SELECT * FROM {{{name}}}")


def oracle(sql: str) -> str:
    """The same SQL as plain text for the checker, with the views as CTEs."""
    parts = _deps(sql)

    def bind(text: str) -> str:
        text = _TIMES.sub(lambda m: f"CROSS JOIN (VALUES {m[3]}) {m[1]}({m[2]})", text)
        return _REF.sub(lambda m: m.group(1), text)

    own = sql.strip()
    head = ",\n".join(f"{n} AS ({bind(VIEWS[n])})" for n in parts)
    if not head:
        return bind(own)
    for start in ("WITH RECURSIVE ", "WITH "):
        if own.upper().startswith(start):
            return f"{start}{head},\n{bind(own[len(start):])}"
    return f"WITH {head}\n{bind(own)}"
