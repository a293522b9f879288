"""Manufacturing frames derived from the star-schema test tables.

Each frame is one SQL text in the dialect shared by Spark and DuckDB. Spark runs
it over the parquet tables; the oracle inlines the same text as a CTE, so both
sides start from identical inputs.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import read_table

AS_OF = "2001-06-15"
TODAY = "2001-12-31"
HORIZON_DAYS = 90

_LOT_KEY = (
    "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || "
    "CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) || '-' || CAST(l_quantity AS INT) || '-' || "
    "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
)
_UNIT_COST = (
    "CAST(CAST(FLOOR(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * 100 / l_quantity) AS DECIMAL(12,0))"
    " * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(20,6))"
)

FRAMES: dict[str, str] = {
    "items": """
        SELECT p_partkey AS item_id, 'P' || p_partkey AS item_code, p_name AS item_name,
               CASE WHEN p_partkey < 30 THEN 'FG'
                    WHEN 3 * p_partkey + 1 <= (SELECT MAX(p_partkey) FROM {part}) THEN 'SEMI'
                    WHEN p_size = 50 THEN 'SVC' ELSE 'RAW' END AS item_type,
               p_type || '/' || p_brand AS category_id,
               CASE p_size % 3 WHEN 0 THEN 'UNIT' WHEN 1 THEN 'TON' ELSE 'YD' END AS base_uom,
               CAST(p_retailprice AS DECIMAL(20,6)) AS std_cost,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(1.5 AS DECIMAL(3,1)) AS DECIMAL(20,4)) AS list_price,
               CASE WHEN p_partkey < 30 OR 3 * p_partkey + 1 <= (SELECT MAX(p_partkey) FROM {part}) THEN 'STD'
                    WHEN p_size = 50 THEN 'NONE'
                    WHEN p_size % 2 = 0 THEN 'FIFO' ELSE 'AVG' END AS valuation_method,
               CASE WHEN p_partkey % 11 = 0 THEN NULL
                    ELSE p_partkey % (SELECT MAX(s_suppkey) + 1 FROM {supplier}) END AS preferred_supplier,
               CASE WHEN p_size = 49 THEN NULL ELSE p_size END AS lead_time_days,
               CAST(p_size * 2 AS DECIMAL(18,4)) AS safety_stock,
               CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 10 END AS DECIMAL(18,4)) AS reorder_point,
               CAST(p_size * 20 AS DECIMAL(18,4)) AS reorder_qty,
               CAST(NULL AS VARCHAR(1)) AS abc_class,
               CASE WHEN p_partkey >= 30 AND p_partkey % 7 = 0
                     AND 3 * p_partkey + 1 <= (SELECT MAX(p_partkey) FROM {part}) THEN 'Y' ELSE 'N' END AS is_phantom,
               CASE WHEN p_partkey % 50 = 49 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
               CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size AS DECIMAL(10,2)) END AS length_cm,
               CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size + 1 AS DECIMAL(10,2)) END AS width_cm,
               CASE WHEN p_size = 50 THEN NULL ELSE CAST(10 AS DECIMAL(10,2)) END AS height_cm,
               CASE WHEN p_size = 50 THEN NULL
                    ELSE CAST(CAST(p_size AS DECIMAL(6,0)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(10,3)) END AS weight_kg
          FROM {part}""",
    "categories": """
        SELECT 'ROOT' AS category_id, CAST(NULL AS VARCHAR(60)) AS parent_category_id,
               'ALL' AS category_code, 'All products' AS category_name
        UNION ALL
        SELECT DISTINCT p_type, 'ROOT', p_type, 'Type ' || p_type FROM {part}
        UNION ALL
        SELECT DISTINCT p_type || '/' || p_brand, p_type, p_brand, p_type || ' ' || p_brand FROM {part}
        UNION ALL
        SELECT DISTINCT 'X' || p_type, 'LOST', 'X' || p_type, 'Unattached ' || p_type FROM {part}""",
    "bom_headers": """
        SELECT p_partkey AS bom_id, p_partkey AS item_id, 'V1' AS bom_version,
               CAST(1 + p_partkey % 2 AS DECIMAL(18,6)) AS base_qty, 'ACTIVE' AS status, 'Y' AS is_default,
               DATE '1995-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to
          FROM {part} WHERE 3 * p_partkey + 1 <= (SELECT MAX(p_partkey) FROM {part})
        UNION ALL
        SELECT -1 - p_partkey, p_partkey, 'V2', CAST(1 AS DECIMAL(18,6)), 'DRAFT', 'N',
               DATE '2001-01-01', CAST(NULL AS DATE)
          FROM {part} WHERE 3 * p_partkey + 1 <= (SELECT MAX(p_partkey) FROM {part})
        UNION ALL
        SELECT -1000000000000 - p_partkey, p_partkey, 'V0', CAST(1 AS DECIMAL(18,6)), 'ACTIVE', 'Y',
               DATE '1990-01-01', DATE '1994-12-31'
          FROM {part} WHERE 3 * p_partkey + 1 <= (SELECT MAX(p_partkey) FROM {part}) AND p_partkey % 4 = 0""",
    "bom_lines": """
        SELECT p_partkey AS line_id, CAST(FLOOR((p_partkey - 1) / 3) AS BIGINT) AS bom_id,
               CAST(10 * (1 + (p_partkey - 1) % 3) AS INT) AS line_no, p_partkey AS component_item_id,
               CAST(1 + p_size % 3 AS DECIMAL(18,6)) AS qty_per,
               CASE p_size % 3 WHEN 0 THEN 'UNIT' WHEN 1 THEN 'TON' ELSE 'YD' END AS uom,
               CAST(CAST(p_size % 5 AS DECIMAL(6,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,4)) AS scrap_rate,
               'N' AS is_phantom
          FROM {part} WHERE p_partkey >= 1
        UNION ALL
        SELECT -1 - p_partkey, -1 - CAST(FLOOR((p_partkey - 1) / 3) AS BIGINT),
               CAST(10 * (1 + (p_partkey - 1) % 3) AS INT),
               CASE WHEN p_size % 10 = 9 THEN p_partkey + 1 ELSE p_partkey END,
               CAST(1 + p_size % 3 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,6)),
               CASE p_size % 3 WHEN 0 THEN 'UNIT' WHEN 1 THEN 'TON' ELSE 'YD' END,
               CAST(CAST(p_size % 5 AS DECIMAL(6,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,4)), 'N'
          FROM {part} WHERE p_partkey >= 1 AND NOT (p_partkey % 3 = 0 AND p_size % 4 = 1)""",
    "warehouses": """
        SELECT * FROM (VALUES (1, 'WH-RAW', 'Raw store'), (2, 'WH-FG', 'Finished store'), (3, 'WH-WIP', 'Line store'))
               AS w(warehouse_id, warehouse_code, warehouse_name)""",
    "lots": f"""
        SELECT {_LOT_KEY} AS lot_id, 'LOT-' || {_LOT_KEY} AS lot_no, l_partkey AS item_id,
               CAST(l_suppkey % 3 + 1 AS INT) AS warehouse_id, CAST(l_quantity AS DECIMAL(18,4)) AS qty_on_hand,
               CAST(CASE WHEN l_linenumber = 3 AND l_quantity > 5 THEN 2 ELSE 0 END AS DECIMAL(18,4)) AS qty_allocated,
               {_UNIT_COST} AS unit_cost, CAST(l_shipdate AS DATE) AS receipt_date,
               CASE l_linenumber WHEN 7 THEN 'QUARANTINE' WHEN 6 THEN 'EXPIRED' ELSE 'AVAILABLE' END AS status
          FROM {{lineitem}}""",
    "ledger": f"""
        SELECT {_LOT_KEY} AS txn_id, l_partkey AS item_id, CAST(l_suppkey % 3 + 1 AS INT) AS warehouse_id,
               CASE l_returnflag WHEN 'R' THEN 'RETURN' WHEN 'A' THEN 'ISSUE' ELSE 'PROD_OUT' END AS txn_type,
               CASE WHEN l_returnflag = 'R' THEN 'I' ELSE 'O' END AS direction,
               CAST(l_quantity AS DECIMAL(18,4)) AS quantity, {_UNIT_COST} AS unit_cost,
               CAST(CAST(l_quantity AS DECIMAL(6,0)) * CAST({_UNIT_COST} AS DECIMAL(14,4)) AS DECIMAL(20,4)) AS total_cost,
               CAST(l_shipdate AS DATE) AS txn_date
          FROM {{lineitem}}""",
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_name,
               CAST(CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE NULL END AS INT) AS price_list_id
          FROM {customer}""",
    "sales_orders": """
        SELECT o_orderkey AS so_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END AS required_date,
               CASE WHEN o_orderkey % 17 = 0 THEN 'CANCELLED' WHEN o_orderkey % 19 = 0 THEN 'DRAFT'
                    WHEN o_orderstatus = 'O' THEN 'CONFIRMED' WHEN o_orderstatus = 'P' THEN 'PARTIAL'
                    ELSE 'CLOSED' END AS status,
               CAST(o_totalprice AS DECIMAL(20,4)) AS total_amount
          FROM {orders}""",
    "so_lines": f"""
        SELECT {_LOT_KEY} AS so_line_id, l_orderkey AS so_id, l_partkey AS item_id,
               CAST(l_quantity AS DECIMAL(18,4)) AS qty_ordered,
               CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity WHEN l_quantity >= 40 THEN 5 ELSE 0 END AS DECIMAL(18,4)) AS qty_shipped,
               {_UNIT_COST} AS unit_price, CAST(l_discount AS DECIMAL(8,4)) AS discount_pct,
               CASE WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'CANCELLED' WHEN l_linestatus = 'F' THEN 'CLOSED'
                    WHEN l_quantity >= 40 THEN 'PARTIAL' ELSE 'OPEN' END AS line_status
          FROM {{lineitem}}""",
    "suppliers": """
        SELECT s_suppkey AS supplier_id, s_name AS supplier_name, CAST(1 + s_suppkey % 5 AS INT) AS rating,
               CASE WHEN s_suppkey % 13 = 5 THEN 'BLOCKED' ELSE 'ACTIVE' END AS status
          FROM {supplier}""",
    "purchase_orders": """
        SELECT l_suppkey || '-' || l_orderkey AS po_id, l_suppkey AS supplier_id,
               CASE l_orderkey % 20 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'PARTIAL' WHEN 4 THEN 'CANCELLED'
                    WHEN 5 THEN 'DRAFT' WHEN 7 THEN 'RECEIVED' WHEN 11 THEN 'RECEIVED' ELSE 'CLOSED' END AS status,
               CAST(l_suppkey % 3 + 1 AS INT) AS warehouse_id, MIN(CAST(l_shipdate AS DATE)) - 20 AS order_date,
               CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 8 = 0 THEN MIN(CAST(l_shipdate AS DATE)) - 25
                    ELSE MIN(CAST(l_shipdate AS DATE)) END AS expected_date
          FROM {lineitem} GROUP BY l_suppkey, l_orderkey""",
    "po_lines": f"""
        SELECT {_LOT_KEY} AS po_line_id, l_suppkey || '-' || l_orderkey AS po_id, l_partkey AS item_id,
               CAST(l_quantity AS DECIMAL(18,4)) AS qty_ordered,
               CAST(CASE WHEN l_orderkey % 20 IN (0, 1, 4, 5) THEN 0
                         WHEN l_orderkey % 20 = 2 THEN FLOOR(l_quantity / 2) ELSE l_quantity END AS DECIMAL(18,4)) AS qty_received,
               {_UNIT_COST} AS unit_price, CAST(l_shipdate AS DATE) AS need_date,
               CASE WHEN l_orderkey % 20 = 4 THEN 'CANCELLED' WHEN l_orderkey % 20 IN (0, 1, 5) THEN 'OPEN'
                    WHEN l_orderkey % 20 = 2 AND l_quantity >= 2 THEN 'PARTIAL' WHEN l_orderkey % 20 = 2 THEN 'OPEN'
                    ELSE 'CLOSED' END AS line_status
          FROM {{lineitem}}""",
    "monthly": """
        SELECT l_partkey AS item_id, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS period_date,
               CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS actual_qty
          FROM {lineitem} GROUP BY 1, 2""",
    "forecast": """
        SELECT item_id, CAST(1 AS INT) AS warehouse_id, period_date,
               COALESCE(LAG(actual_qty) OVER (PARTITION BY item_id ORDER BY period_date), actual_qty) AS forecast_qty,
               CASE WHEN period_date > DATE '2001-09-01' THEN NULL ELSE actual_qty END AS actual_qty,
               CASE WHEN item_id % 23 = 0 THEN 'MANUAL' ELSE 'MA3' END AS method
          FROM {monthly}""",
    "price_lists": """
        SELECT * FROM (VALUES (1, 'Y', 'Y', DATE '1990-01-01', CAST(NULL AS DATE)), (2, 'N', 'Y', DATE '1990-01-01', DATE '2010-12-31'),
               (3, 'N', 'N', DATE '1990-01-01', CAST(NULL AS DATE)), (4, 'Y', 'Y', DATE '2000-01-01', CAST(NULL AS DATE)))
               AS w(price_list_id, is_default, is_active, valid_from, valid_to)""",
    "price_rules": """
        SELECT 'a-' || p_partkey AS rule_id, CAST(1 AS INT) AS price_list_id, p_partkey AS item_id,
               CAST(NULL AS VARCHAR(60)) AS category_id, CAST(NULL AS BIGINT) AS customer_id,
               CAST(0 AS DECIMAL(18,4)) AS min_qty, CAST(NULL AS DECIMAL(18,4)) AS max_qty, 'LIST' AS rule_type,
               CAST(p_retailprice AS DECIMAL(20,6)) AS price_value, 10 AS priority,
               DATE '1995-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, 'Y' AS is_active
          FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL
        SELECT 'b-' || p_partkey, 1, p_partkey, CAST(NULL AS VARCHAR(60)), CAST(NULL AS BIGINT), CAST(20 AS DECIMAL(18,4)),
               CAST(45 AS DECIMAL(18,4)), 'DISCOUNT_PCT', CAST(0.05 AS DECIMAL(20,6)), 5, DATE '1995-01-01', CAST(NULL AS DATE), 'Y'
          FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL
        SELECT 'c-' || p_partkey, 1, p_partkey, CAST(NULL AS VARCHAR(60)), CAST(NULL AS BIGINT), CAST(40 AS DECIMAL(18,4)),
               CAST(NULL AS DECIMAL(18,4)), 'DISCOUNT_PCT', CAST(0.10 AS DECIMAL(20,6)), 4, DATE '1995-01-01',
               CASE WHEN p_partkey % 2 = 0 THEN DATE '2000-01-01' ELSE NULL END, 'Y'
          FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL
        SELECT DISTINCT 'd-' || p_type || '/' || p_brand, 1, CAST(NULL AS BIGINT), p_type || '/' || p_brand, CAST(NULL AS BIGINT),
               CAST(0 AS DECIMAL(18,4)), CAST(30 AS DECIMAL(18,4)), 'DISCOUNT_PCT', CAST(0.02 AS DECIMAL(20,6)), 50,
               DATE '1995-01-01', CAST(NULL AS DATE), 'Y' FROM {part}
        UNION ALL
        SELECT 'e-' || c_custkey, 2, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR(60)), c_custkey, CAST(5 AS DECIMAL(18,4)),
               CAST(NULL AS DECIMAL(18,4)), 'DISCOUNT_AMT', CAST(5 AS DECIMAL(20,6)), 20, DATE '1995-01-01', CAST(NULL AS DATE),
               CASE WHEN c_custkey % 12 = 0 THEN 'N' ELSE 'Y' END
          FROM {customer} WHERE c_custkey % 4 = 0
        UNION ALL
        SELECT 'f-' || p_partkey, 2, p_partkey, CAST(NULL AS VARCHAR(60)), CAST(NULL AS BIGINT), CAST(0 AS DECIMAL(18,4)),
               CAST(NULL AS DECIMAL(18,4)), 'OVERRIDE', CAST(p_retailprice AS DECIMAL(20,6)), 20, DATE '1995-01-01', CAST(NULL AS DATE), 'Y'
          FROM {part} WHERE p_partkey % 50 = 0
        UNION ALL
        SELECT 'g-all', 2, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR(60)), CAST(NULL AS BIGINT), CAST(10 AS DECIMAL(18,4)),
               CAST(NULL AS DECIMAL(18,4)), 'DISCOUNT_PCT', CAST(0.01 AS DECIMAL(20,6)), 99, DATE '1995-01-01', CAST(NULL AS DATE), 'Y'
          FROM {region} WHERE r_regionkey = 0""",
    "uoms": """
        SELECT * FROM (VALUES ('UNIT', 'COUNT', 0, 'Y'), ('PAIR', 'COUNT', 0, 'N'), ('CRATE', 'COUNT', 0, 'N'), ('PALLET', 'COUNT', 0, 'N'),
               ('TON', 'MASS', 3, 'Y'), ('LB', 'MASS', 3, 'N'), ('YD', 'DIST', 2, 'Y'), ('FT', 'DIST', 2, 'N'))
               AS w(uom_code, uom_category, decimal_digits, is_base)""",
    "uom_conversions": """
        SELECT from_uom, to_uom, CAST(factor AS DECIMAL(20,8)) AS factor FROM (VALUES ('TON', 'LB', 2204.5), ('YD', 'FT', 3.0),
               ('PAIR', 'UNIT', 2.0), ('CRATE', 'UNIT', 24.0), ('PALLET', 'UNIT', 960.0))
               AS w(from_uom, to_uom, factor)""",
    "nodes": """
        SELECT p_partkey AS node, CAST(FLOOR(p_partkey / 18) AS BIGINT) AS grp, p_size AS w FROM {part}""",
    "edges": """
        SELECT p_partkey AS src,
               CAST(FLOOR(p_partkey / 6) AS BIGINT) * 6 + ((p_partkey % 6) * 5 + p_size) % 6 AS dst
          FROM {part}
         WHERE CAST(FLOOR(p_partkey / 6) AS BIGINT) * 6 + ((p_partkey % 6) * 5 + p_size) % 6 <= (SELECT MAX(p_partkey) FROM {part})
           AND p_size % 5 <> 0
        UNION
        SELECT p_partkey, (CAST(FLOOR(p_partkey / 6) AS BIGINT) + 1) * 6 + p_size % 6
          FROM {part}
         WHERE p_size % 4 = 0 AND CAST(FLOOR(p_partkey / 6) AS BIGINT) % 3 <> 2
           AND (CAST(FLOOR(p_partkey / 6) AS BIGINT) + 1) * 6 + p_size % 6 <= (SELECT MAX(p_partkey) FROM {part})""",
}

_BALANCE = """
        SELECT item_id, warehouse_id,
               CAST(SUM(qty_on_hand) + CASE WHEN item_id % 13 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS qty_on_hand,
               CAST(SUM(qty_allocated) AS DECIMAL(18,4)) AS qty_allocated,
               CAST(FLOOR(SUM(CAST(unit_cost AS DECIMAL(14,4))) / COUNT(*)) AS DECIMAL(20,6)) AS avg_cost,
               MAX(receipt_date) AS last_txn_date, CAST(1 AS INT) AS version
          FROM {lots} WHERE status = 'AVAILABLE' AND item_id % 41 <> 0
         GROUP BY item_id, warehouse_id"""
FRAMES["balances"] = _BALANCE

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_REF = re.compile(r"\{(\w+)\}")


class Bridge:
    """Lazily derived frames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in FRAMES:
                text = FRAMES[name]
                refs = {ref: self.frame(ref) for ref in sorted(set(_REF.findall(text)))}
                self._cache[name] = self.spark.sql(text, **refs)
            else:
                self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in FRAMES or name in TABLES:
            return self.frame(name)
        raise AttributeError(name)

    @cached_property
    def items_dim(self) -> DataFrame:
        """Items with the dimensions folded into a struct column."""
        parts = ["length_cm", "width_cm", "height_cm", "weight_kg"]
        dim = F.when(F.col("length_cm").isNotNull(), F.struct(*parts))
        return self.items.withColumn("dim", dim).drop(*parts)


def cte(body: str) -> str:
    """Oracle SQL: ``body`` with every ``{frame}`` it mentions as a CTE.

    ``body`` may start with its own ``WITH`` list, which is appended.
    """
    needed: list[str] = []

    def visit(text: str) -> None:
        for ref in _REF.findall(text):
            if ref in FRAMES and ref not in needed:
                visit(FRAMES[ref])
                needed.append(ref)

    visit(body)
    plain = lambda text: _REF.sub(r"\1", text)
    frames = ", ".join(f"{n} AS ({plain(FRAMES[n])})" for n in needed)
    body = plain(body).strip()
    own = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if own:
        body = body[own.end():]
        return f"WITH RECURSIVE {frames}, {body}" if frames else f"WITH RECURSIVE {body}"
    return f"WITH {frames} {body}" if frames else body
