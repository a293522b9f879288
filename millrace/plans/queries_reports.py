"""Reports and costing over the bridged tables."""

import os
import uuid

from pyspark.sql import functions as F

from millrace.operators import costing, reports
from millrace.operators.common import error_rows, split_by_rules
from millrace.plans.bridge import AS_OF, TODAY
from millrace.plans.catalog import exact_div, huge, query
from millrace.session import scratch_root
from millrace.sources.files import append_batch

START, END = "1998-01-01", "2000-12-31"


@query(
    "inventory_by_warehouse",
    "item_id:l item_code:s item_name:s qty_wh_raw:d qty_wh_fg:d qty_wh_wip:d qty_total:d",
    """SELECT b.item_id, i.item_code, i.item_name,
              COALESCE(SUM(CASE WHEN warehouse_id = 1 THEN qty_on_hand END), 0) AS qty_wh_raw,
              COALESCE(SUM(CASE WHEN warehouse_id = 2 THEN qty_on_hand END), 0) AS qty_wh_fg,
              COALESCE(SUM(CASE WHEN warehouse_id = 3 THEN qty_on_hand END), 0) AS qty_wh_wip,
              SUM(qty_on_hand) AS qty_total
         FROM {balances} b JOIN {items} i ON i.item_id = b.item_id
        WHERE qty_on_hand > 0 GROUP BY 1, 2, 3""",
)
def _(b):
    return reports.inventory_by_warehouse(b.balances, b.items)


_SALES = """WITH base AS (
      SELECT i.category_id, c.category_name, o.customer_id, u.customer_name, o.so_id, l.qty_ordered, l.qty_shipped,
             l.qty_ordered * CAST(l.unit_price AS DECIMAL(14,4)) * (1 - CAST(l.discount_pct AS DECIMAL(4,2))) AS net
        FROM {so_lines} l JOIN {sales_orders} o ON o.so_id = l.so_id JOIN {items} i ON i.item_id = l.item_id
        LEFT JOIN {categories} c ON c.category_id = i.category_id JOIN {customers} u ON u.customer_id = o.customer_id
       WHERE o.order_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND o.status <> 'CANCELLED')
    SELECT category_id, %s AS category_name, customer_id, %s AS customer_name,
           GROUPING(category_id) AS g_category, GROUPING(customer_id) AS g_customer,
           GROUPING(category_id) * 2 + GROUPING(customer_id) AS gid, COUNT(DISTINCT so_id) AS order_count,
           SUM(qty_ordered) AS qty_ordered, SUM(qty_shipped) AS qty_shipped, SUM(net) AS amount
      FROM base GROUP BY %s(category_id, customer_id)%s"""
_SALES_COLS = ("category_id:s category_name:s customer_id:l customer_name:s g_category:l g_customer:l gid:l "
               "order_count:l qty_ordered:d qty_shipped:d amount:d")


def _sales(mode, names):
    def build(b):
        return reports.sales_summary(b.so_lines, b.sales_orders, b.items, b.categories, b.customers, START, END, mode, names)
    return build


_cat_attr = "CASE WHEN GROUPING(category_id) = 0 THEN MAX(category_name) END"
_cus_attr = "CASE WHEN GROUPING(customer_id) = 0 THEN MAX(customer_name) END"
for _mode in ("ROLLUP", "CUBE"):
    query(f"sales_summary_{_mode.lower()}", _SALES_COLS,
          _SALES % ("category_name", "customer_name", _mode, ", category_name, customer_name"))(_sales(_mode, "grouped"))
    query(f"sales_summary_{_mode.lower()}_true_subtotals", _SALES_COLS,
          _SALES % (_cat_attr, _cus_attr, _mode, ""))(_sales(_mode, "attributes"))


@query(
    "stock_aging",
    "lot_id:s item_code:s warehouse_id:l qty_on_hand:d receipt_date:s age_days:l age_bucket:s age_quartile:l qty_pct:d",
    f"""WITH held AS (
          SELECT l.lot_id, i.item_code, l.warehouse_id, l.qty_on_hand, l.receipt_date,
                 DATE '{TODAY}' - l.receipt_date AS age_days
            FROM {{lots}} l JOIN {{items}} i ON i.item_id = l.item_id WHERE l.status = 'AVAILABLE' AND l.qty_on_hand > 0)
        SELECT *, CASE WHEN age_days <= 30 THEN '0-30' WHEN age_days <= 60 THEN '31-60' WHEN age_days <= 90 THEN '61-90' ELSE '90+' END AS age_bucket,
               NTILE(4) OVER (ORDER BY age_days, lot_id) AS age_quartile,
               {exact_div(huge('qty_on_hand', 4) + ' * 100', huge('(SELECT SUM(qty_on_hand) FROM held)', 4), 2)} AS qty_pct
          FROM held""",
)
def _(b):
    return reports.stock_aging(b.lots, b.items, TODAY)


@query(
    "top_consumed_items",
    "item_id:l item_code:s item_name:s item_type:s consumed_qty:d consumed_cost:d txn_count:l rn:l rnk:l dense_rnk:l",
    """WITH c AS (
          SELECT item_id, SUM(quantity) AS consumed_qty, SUM(total_cost) AS consumed_cost, COUNT(*) AS txn_count
            FROM {ledger} WHERE direction = 'O' AND txn_type IN ('ISSUE', 'PROD_OUT')
             AND txn_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' GROUP BY item_id)
        SELECT c.*, i.item_code, i.item_name, i.item_type,
               ROW_NUMBER() OVER (ORDER BY consumed_qty DESC, c.item_id) AS rn,
               RANK() OVER (ORDER BY consumed_qty DESC) AS rnk, DENSE_RANK() OVER (ORDER BY consumed_qty DESC) AS dense_rnk
          FROM c JOIN {items} i ON i.item_id = c.item_id ORDER BY consumed_qty DESC, c.item_id LIMIT 10""",
)
def _(b):
    return reports.top_consumed_items(b.ledger, b.items, START, END, 10)


@query(
    "inventory_pareto",
    "item_id:l item_code:s item_name:s abc_class_current:s qty_on_hand:d stock_value:d value_pct:d cum_pct:d value_rank:l abc_class_calc:s",
    f"""WITH v AS (
          SELECT i.item_id, i.item_code, i.item_name, i.abc_class AS abc_class_current, SUM(b.qty_on_hand) AS qty_on_hand,
                 SUM(b.qty_on_hand * CAST(b.avg_cost AS DECIMAL(14,6))) AS stock_value
            FROM {{balances}} b JOIN {{items}} i ON i.item_id = b.item_id GROUP BY 1, 2, 3, 4
          HAVING SUM(b.qty_on_hand * CAST(b.avg_cost AS DECIMAL(14,6))) > 0),
        r AS (SELECT v.*, SUM(stock_value) OVER (ORDER BY stock_value DESC) AS cum, (SELECT SUM(stock_value) FROM v) AS total,
                     ROW_NUMBER() OVER (ORDER BY stock_value DESC, item_id) AS value_rank FROM v),
        p AS (SELECT r.*, {exact_div(huge('stock_value', 4) + ' * 100', huge('total', 4), 4)} AS value_pct,
                     {exact_div(huge('cum', 4) + ' * 100', huge('total', 4), 4)} AS cum_pct FROM r)
        SELECT *, CASE WHEN cum_pct <= 80 THEN 'A' WHEN cum_pct <= 95 THEN 'B' ELSE 'C' END AS abc_class_calc FROM p""",
)
def _(b):
    return reports.inventory_pareto(b.balances, b.items)


@query(
    "latest_run_per_job",
    "job_name:s last_run_start:s last_status:s last_error_code:l",
    """SELECT j.job_name, r.start AS last_run_start, r.event_type AS last_status, r.k AS last_error_code
         FROM (SELECT DISTINCT 'JOB_' || user_id || CASE WHEN user_id % 3 = 0 THEN '_ERR' ELSE '' END AS job_name FROM {events}) j
         LEFT JOIN (
              SELECT 'JOB_' || user_id AS job_name, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start,
                     CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                     ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) r
           ON r.job_name = j.job_name AND r.rn = 1
        WHERE j.job_name LIKE 'JOB\\_%' ESCAPE '\\'""",
)
def _(b):
    e = b.events
    suffix = F.when(F.col("user_id") % 3 == 0, "_ERR").otherwise("")
    jobs = e.select(F.concat(F.lit("JOB_"), F.col("user_id").cast("string"), suffix).alias("job_name")).distinct()
    runs = e.select(
        F.concat(F.lit("JOB_"), F.col("user_id").cast("string")).alias("job_name"), F.col("event_id").alias("log_id"),
        F.col("event_type").alias("status"), F.get_json_object("props", "$.k").cast("bigint").alias("error_code"),
        F.col("ts").alias("actual_start_date"), F.lit(None).cast("bigint").alias("run_duration"))
    out = reports.latest_run_per_job(jobs, runs, "JOB_")
    return out.withColumn("last_run_start", F.date_format("last_run_start", "yyyy-MM-dd HH:mm:ss"))


_AVAIL = "(qty_on_hand - qty_allocated)"


@query(
    "fifo_layers",
    "item_id:l warehouse_id:l lot_id:s lot_no:s receipt_date:s layer_no:l avail_qty:d unit_cost:d layer_amount:d cum_qty:d cum_amount:d is_covering:s",
    f"""WITH l AS (
          SELECT item_id, warehouse_id, lot_id, lot_no, receipt_date, {_AVAIL} AS avail_qty, unit_cost,
                 CAST({_AVAIL} * CAST(unit_cost AS DECIMAL(14,4)) AS DECIMAL(20,4)) AS layer_amount
            FROM {{lots}} WHERE status = 'AVAILABLE' AND {_AVAIL} > 0),
        w AS (SELECT l.*, ROW_NUMBER() OVER k AS layer_no, SUM(avail_qty) OVER k AS cum_qty, SUM(layer_amount) OVER k AS cum_amount
                FROM l WINDOW k AS (PARTITION BY item_id, warehouse_id ORDER BY receipt_date, lot_id))
        SELECT w.*, CASE WHEN cum_qty >= b.qty_on_hand - b.qty_allocated THEN 'Y' ELSE 'N' END AS is_covering
          FROM w LEFT JOIN {{balances}} b ON b.item_id = w.item_id AND b.warehouse_id = w.warehouse_id""",
)
def _(b):
    return costing.fifo_layers(b.lots, b.balances)


@query(
    "inventory_value",
    "warehouse_id:l warehouse_code:s item_id:l item_code:s valuation_method:s qty_on_hand:d val_unit_cost:d stock_value:d wh_total_value:d value_ratio:d",
    f"""WITH v AS (
          SELECT b.warehouse_id, w.warehouse_code, b.item_id, i.item_code, i.valuation_method, b.qty_on_hand,
                 CASE WHEN i.valuation_method = 'STD' THEN i.std_cost ELSE b.avg_cost END AS val_unit_cost
            FROM {{balances}} b JOIN {{items}} i ON i.item_id = b.item_id JOIN {{warehouses}} w ON w.warehouse_id = b.warehouse_id
           WHERE b.qty_on_hand > 0),
        s AS (SELECT v.*, CAST(qty_on_hand * CAST(val_unit_cost AS DECIMAL(14,4)) AS DECIMAL(24,4)) AS stock_value FROM v),
        t AS (SELECT s.*, SUM(stock_value) OVER (PARTITION BY warehouse_id) AS wh_total_value FROM s)
        SELECT t.*, {exact_div(huge('stock_value', 4), huge('wh_total_value', 4), 6)} AS value_ratio FROM t""",
)
def _(b):
    return costing.inventory_value(b.balances, b.items, b.warehouses)


_AVG = exact_div("CAST(SUM(qty_on_hand * CAST(unit_cost AS DECIMAL(14,4))) * 10000 AS HUGEINT)", "CAST(SUM(qty_on_hand) * 10000 AS HUGEINT)", 6)


@query(
    "recompute_avg_cost",
    "item_id:l warehouse_id:l avg_cost:d version:l error_code:s",
    f"""WITH a AS (SELECT item_id, warehouse_id, {_AVG} AS avg_cost FROM {{lots}} WHERE status = 'AVAILABLE' GROUP BY 1, 2)
        SELECT COALESCE(b.item_id, a.item_id) AS item_id, COALESCE(b.warehouse_id, a.warehouse_id) AS warehouse_id,
               CASE WHEN b.item_id IS NOT NULL THEN COALESCE(a.avg_cost, 0) END AS avg_cost, b.version + 1 AS version,
               CASE WHEN b.item_id IS NULL THEN 'M3004' END AS error_code
          FROM {{balances}} b FULL JOIN a ON a.item_id = b.item_id AND a.warehouse_id = b.warehouse_id""",
)
def _(b):
    updated, missing = costing.recompute_avg_cost(b.lots, b.balances)
    return updated.unionByName(missing, allowMissingColumns=True)


@query(
    "sync_balance",
    "item_id:l warehouse_id:l qty_on_hand:d qty_allocated:d avg_cost:d version:l",
    f"""WITH a AS (SELECT item_id, warehouse_id, SUM(qty_on_hand) AS q, SUM(qty_allocated) AS al, {_AVG} AS avg_cost
                    FROM {{lots}} WHERE status IN ('AVAILABLE', 'QUARANTINE') GROUP BY 1, 2),
        k AS (SELECT item_id, warehouse_id FROM {{balances}} UNION SELECT item_id, warehouse_id FROM {{lots}})
        SELECT k.item_id, k.warehouse_id, COALESCE(q, 0) AS qty_on_hand, COALESCE(al, 0) AS qty_allocated,
               COALESCE(a.avg_cost, 0) AS avg_cost, COALESCE(b.version + 1, 0) AS version
          FROM k LEFT JOIN a ON a.item_id = k.item_id AND a.warehouse_id = k.warehouse_id
          LEFT JOIN {{balances}} b ON b.item_id = k.item_id AND b.warehouse_id = k.warehouse_id""",
)
def _(b):
    return costing.sync_balance(b.lots, b.balances, AS_OF)


def _landed(basis):
    base = ("CAST(qty_ordered * CAST(unit_price AS DECIMAL(14,4)) AS DECIMAL(14,4))" if basis == "AMT"
            else "CAST(qty_ordered * COALESCE(i.weight_kg, 0) AS DECIMAL(14,4))")
    share = lambda c: f"COALESCE({exact_div(f'{c} * {huge(chr(98), 4)}', huge('s', 4), 4)}, 0)"
    return f"""WITH x AS (
          SELECT po_id, po_line_id, l.item_id, qty_ordered, CAST(qty_ordered * CAST(unit_price AS DECIMAL(14,4)) AS DECIMAL(20,4)) AS line_amount,
                 CAST(qty_ordered * COALESCE(i.weight_kg, 0) AS DECIMAL(20,4)) AS line_weight, {base} AS b
            FROM {{po_lines}} l JOIN {{items}} i ON i.item_id = l.item_id),
        y AS (SELECT x.*, NULLIF(SUM(b) OVER (PARTITION BY po_id), 0) AS s FROM x),
        z AS (SELECT y.*, {share(120)} AS freight_alloc, {share(45)} AS duty_alloc FROM y),
        t AS (SELECT z.*, line_amount + freight_alloc + duty_alloc AS landed_total FROM z)
        SELECT t.*, {exact_div(huge('landed_total', 4), huge('qty_ordered', 4), 6)} AS landed_unit_cost FROM t"""


for _basis in ("AMT", "WGT"):
    query(f"landed_cost_{_basis.lower()}",
          "po_id:s po_line_id:s item_id:l qty_ordered:d line_amount:d line_weight:d freight_alloc:d duty_alloc:d landed_total:d landed_unit_cost:d",
          _landed(_basis))(lambda b, basis=_basis: costing.landed_cost(b.po_lines, b.items_dim, "120", "45", basis))


@query("error_log", "batch_id:s error_code:s error_level:s module_name:s procedure_name:s error_msg:s biz_key:s",
       """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'customers' ELSE 'amounts' END AS batch_id, CASE WHEN o_custkey % 3 = 0 THEN 'M1001' ELSE 'M3001' END AS error_code,
                 'WARN' AS error_level, 'ORDERS' AS module_name, 'CHECK' AS procedure_name,
                 CASE WHEN o_custkey % 3 = 0 THEN 'customer blocked' ELSE repeat('over the limit ', 134)[1:2000] END AS error_msg, CAST(o_orderkey AS VARCHAR) AS biz_key
            FROM orders WHERE o_custkey % 3 = 0 OR o_totalprice >= 200000""")
def _(b):
    """Rejected orders in the error log; every batch is appended twice and is there once."""
    _, bad = split_by_rules(b.orders, [("M1001", F.col("o_custkey") % 3 != 0, "customer blocked"), ("M3001", F.col("o_totalprice") < 200000, "over the limit " * 134)])
    rows = error_rows(bad, "ORDERS", "CHECK", F.col("o_orderkey"))
    path = os.path.join(scratch_root(b.orders.sparkSession), "millrace", f"error-log-{uuid.uuid4().hex}")
    for batch_id, code in (("customers", "M1001"), ("amounts", "M3001"), ("customers", "M1001"), ("amounts", "M3001")):
        append_batch(rows.filter(F.col("error_code") == code), path, batch_id)
    return b.orders.sparkSession.read.parquet(path)
