"""Purchasing, planning and forecasting over the bridged tables."""

from pyspark.sql import functions as F

from millrace.functions.columns import period_index
from millrace.operators import forecast, mrp, procurement
from millrace.plans.bridge import AS_OF, HORIZON_DAYS, TODAY
from millrace.plans.catalog import exact_div, huge, query

_LIVE_LINES = """live AS (SELECT po_id, COUNT(*) FILTER (WHERE line_status IN ('OPEN', 'PARTIAL')) AS o, COUNT(*) FILTER (WHERE qty_received > 0) AS r
    FROM %s WHERE line_status <> 'CANCELLED' GROUP BY po_id)"""
_STATE = "CASE WHEN p.status IN ('CANCELLED', 'CLOSED') THEN p.status WHEN o > 0 AND r > 0 THEN 'PARTIAL' WHEN o > 0 THEN 'APPROVED' ELSE 'RECEIVED' END"


@query("po_header_status", "po_id:s status:s",
       f"WITH {_LIVE_LINES % '{po_lines}'} SELECT p.po_id, {_STATE} AS status FROM {{purchase_orders}} p LEFT JOIN live ON live.po_id = p.po_id")
def _(b):
    return procurement.po_header_status(b.purchase_orders, b.po_lines)


_RECEIPTS = """rc AS (
    SELECT po_line_id || '/1' AS receipt_id, po_line_id, po_id, FLOOR((qty_ordered - qty_received) / 2) AS qty, 1 AS k FROM {po_lines}
    UNION ALL
    SELECT po_line_id || '/2', po_line_id, CASE WHEN item_id % 31 = 0 THEN 'NONE' ELSE po_id END,
           CASE WHEN item_id % 3 = 0 THEN qty_ordered ELSE CEIL((qty_ordered - qty_received) / 2) END, 2 FROM {po_lines}),
  chk AS (SELECT rc.*, l.qty_ordered, l.qty_received, CASE WHEN qty <= 0 THEN 'M4002' WHEN p.po_id IS NULL THEN 'M4001'
             WHEN p.status NOT IN ('APPROVED', 'PARTIAL') THEN 'M4002' WHEN l.line_status IN ('CLOSED', 'CANCELLED') THEN 'M4002' END AS pre
        FROM rc JOIN {po_lines} l ON l.po_line_id = rc.po_line_id LEFT JOIN {purchase_orders} p ON p.po_id = rc.po_id),
  one AS (SELECT c.*, CASE WHEN pre IS NOT NULL THEN pre WHEN qty_received >= qty_ordered THEN 'M4002' WHEN qty_received + qty > qty_ordered THEN 'M4003' END AS code
            FROM chk c WHERE k = 1),
  two AS (SELECT c.*, c.qty_received + CASE WHEN o.code IS NULL THEN o.qty ELSE 0 END AS had FROM chk c JOIN one o ON o.po_line_id = c.po_line_id WHERE c.k = 2),
  out2 AS (SELECT two.*, CASE WHEN pre IS NOT NULL THEN pre WHEN had >= qty_ordered THEN 'M4002' WHEN had + qty > qty_ordered THEN 'M4003' END AS code FROM two),
  judged AS (SELECT receipt_id, po_line_id, po_id, qty, code FROM one UNION ALL SELECT receipt_id, po_line_id, po_id, qty, code FROM out2),
  got AS (SELECT po_line_id, SUM(qty) AS g FROM judged WHERE code IS NULL GROUP BY 1),
  nl AS (SELECT l.po_line_id, l.po_id, l.qty_received + COALESCE(g, 0) AS qty_received,
                CASE WHEN g IS NULL THEN l.line_status WHEN l.qty_received + g >= l.qty_ordered THEN 'CLOSED' ELSE 'PARTIAL' END AS line_status
           FROM {po_lines} l LEFT JOIN got ON got.po_line_id = l.po_line_id)"""


def _receive(b, post_stock=False):
    half = lambda f: f((F.col("qty_ordered") - F.col("qty_received")) / 2).cast("decimal(18,4)")
    ids = lambda n: F.concat("po_line_id", F.lit(f"/{n}")).alias("receipt_id")
    none = F.lit(None).cast("decimal(20,6)").alias("unit_cost")
    first = b.po_lines.select(ids(1), "po_line_id", "po_id", half(F.floor).alias("qty"), none)
    second = b.po_lines.select(
        ids(2), "po_line_id", F.when(F.col("item_id") % 31 == 0, "NONE").otherwise(F.col("po_id")).alias("po_id"),
        F.when(F.col("item_id") % 3 == 0, F.col("qty_ordered")).otherwise(half(F.ceil)).cast("decimal(18,4)").alias("qty"), none)
    return procurement.receive_po_lines(b.purchase_orders, b.po_lines, first.unionByName(second), b.balances, AS_OF, post_stock)


@query("receive_po_lines", "po_line_id:s qty_received:d line_status:s", f"WITH {_RECEIPTS} SELECT * FROM nl")
def _(b):
    return _receive(b)["lines"]


@query("receive_po_lines_rejects", "receipt_id:s error_code:s", f"WITH {_RECEIPTS} SELECT receipt_id, code AS error_code FROM judged WHERE code IS NOT NULL")
def _(b):
    return _receive(b)["rejects"]


@query("receive_po_lines_orders", "po_id:s status:s",
       f"""WITH {_RECEIPTS}, {_LIVE_LINES % 'nl'}, touched AS (SELECT DISTINCT po_id FROM judged WHERE code IS NULL)
           SELECT p.po_id, CASE WHEN t.po_id IS NULL THEN p.status ELSE {_STATE} END AS status
             FROM {{purchase_orders}} p LEFT JOIN live ON live.po_id = p.po_id LEFT JOIN touched t ON t.po_id = p.po_id""")
def _(b):
    return _receive(b)["orders"]


@query("receive_po_lines_stock", "item_id:l warehouse_id:l qty_on_hand:d version:l",
       f"""WITH {_RECEIPTS}, add AS (SELECT l.item_id, p.warehouse_id, SUM(j.qty) AS q, COUNT(*) AS n FROM judged j JOIN {{po_lines}} l ON l.po_line_id = j.po_line_id
              JOIN {{purchase_orders}} p ON p.po_id = j.po_id WHERE code IS NULL GROUP BY 1, 2)
           SELECT COALESCE(b.item_id, a.item_id) AS item_id, COALESCE(b.warehouse_id, a.warehouse_id) AS warehouse_id,
                  COALESCE(b.qty_on_hand, 0) + COALESCE(q, 0) AS qty_on_hand, CASE WHEN b.item_id IS NULL THEN n - 1 ELSE version + COALESCE(n, 0) END AS version
             FROM {{balances}} b FULL JOIN add a ON a.item_id = b.item_id AND a.warehouse_id = b.warehouse_id""")
def _(b):
    return _receive(b, True)["stock"]["balances"]


_LOAD = """h AS (SELECT p.po_id AS ref, CASE WHEN p.supplier_id % 29 = 0 THEN -1 ELSE p.supplier_id END AS sid, p.warehouse_id, p.expected_date FROM {purchase_orders} p),
  hj AS (SELECT h.*, CASE WHEN s.supplier_id IS NULL THEN 'M4001' WHEN s.status = 'BLOCKED' THEN 'M4004' END AS code FROM h LEFT JOIN {suppliers} s ON s.supplier_id = h.sid),
  lj AS (SELECT l.po_id AS ref, l.po_line_id AS line_ref, l.unit_price, CASE WHEN l.item_id % 19 = 0 THEN 0 ELSE l.qty_ordered END AS qty,
                CASE WHEN l.item_id % 23 = 0 THEN -l.item_id - 1 ELSE l.item_id END AS item_id, CASE WHEN l.item_id % 2 = 0 THEN NULL ELSE 'CRATE' END AS uom FROM {po_lines} l),
  lc AS (SELECT lj.*, i.base_uom, CASE WHEN qty <= 0 THEN 'M4002' WHEN hj.code IS NOT NULL THEN 'M4001' WHEN i.item_id IS NULL THEN 'M1001' END AS code
           FROM lj JOIN hj ON hj.ref = lj.ref LEFT JOIN {items} i ON i.item_id = lj.item_id),
  ln AS (SELECT lc.*, 10 * ROW_NUMBER() OVER (PARTITION BY ref ORDER BY line_ref) AS line_no FROM lc WHERE code IS NULL)"""


def _load(b):
    heads = b.purchase_orders.select(F.col("po_id").alias("ref"), F.when(F.col("supplier_id") % 29 == 0, -1).otherwise(F.col("supplier_id")).alias("supplier_id"),
                                     "warehouse_id", "expected_date")
    lines = b.po_lines.select(
        F.col("po_id").alias("ref"), F.col("po_line_id").alias("line_ref"), "unit_price", "need_date",
        F.when(F.col("item_id") % 19 == 0, 0).otherwise(F.col("qty_ordered")).cast("decimal(18,4)").alias("qty"),
        F.when(F.col("item_id") % 23 == 0, -F.col("item_id") - 1).otherwise(F.col("item_id")).alias("item_id"),
        F.when(F.col("item_id") % 2 == 1, "CRATE").alias("uom"))
    return procurement.load_purchase_orders(heads, lines, b.suppliers, b.items, AS_OF)


@query("load_purchase_orders", "ref:s po_id:l po_no:s supplier_id:l status:s total_amount:d",
       f"""WITH {_LOAD}, t AS (SELECT ref, SUM(CAST(qty * CAST(unit_price AS DECIMAL(14,4)) AS DECIMAL(20,4))) AS total FROM ln GROUP BY 1),
           n AS (SELECT hj.*, ROW_NUMBER() OVER (ORDER BY ref) AS po_id FROM hj WHERE code IS NULL)
           SELECT n.ref, po_id, 'PO' || strftime(DATE '{AS_OF}', '%Y%m%d') || lpad(CAST(po_id % 1000000 AS VARCHAR), 6, '0') AS po_no, sid AS supplier_id,
                  'DRAFT' AS status, COALESCE(total, 0) AS total_amount FROM n LEFT JOIN t ON t.ref = n.ref""")
def _(b):
    return _load(b)["orders"]


@query("load_purchase_order_lines", "ref:s line_ref:s line_no:l item_id:l qty_ordered:d uom:s",
       f"WITH {_LOAD} SELECT ref, line_ref, line_no, item_id, qty AS qty_ordered, COALESCE(uom, base_uom) AS uom FROM ln")
def _(b):
    return _load(b)["lines"]


@query("load_purchase_order_rejects", "ref:s line_ref:s error_code:s",
       f"WITH {_LOAD} SELECT ref, NULL AS line_ref, code AS error_code FROM hj WHERE code IS NOT NULL UNION ALL SELECT ref, line_ref, code FROM lc WHERE code IS NOT NULL")
def _(b):
    return _load(b)["rejects"]


_TRANS = """f AS (SELECT po_id, COUNT(*) FILTER (WHERE line_status <> 'CANCELLED') AS live, COUNT(*) FILTER (WHERE qty_received > 0) AS rec FROM {po_lines} GROUP BY 1),
  q AS (SELECT p.po_id, p.status, p.supplier_id % 2 = 0 AS approve, s.status AS sup, COALESCE(f.live, 0) AS live, COALESCE(f.rec, 0) AS rec
          FROM {purchase_orders} p LEFT JOIN f ON f.po_id = p.po_id LEFT JOIN {suppliers} s ON s.supplier_id = p.supplier_id),
  j AS (SELECT *, CASE WHEN approve AND status = 'APPROVED' THEN NULL WHEN approve AND status <> 'DRAFT' THEN 'M4002' WHEN approve AND live = 0 THEN 'M4002'
             WHEN approve AND sup = 'BLOCKED' THEN 'M4004' WHEN approve THEN NULL WHEN status = 'CANCELLED' THEN NULL WHEN status IN ('RECEIVED', 'CLOSED') THEN 'M4002'
             WHEN rec > 0 THEN 'M4002' END AS code FROM q)"""


def _transitions(b):
    req = b.purchase_orders.select("po_id", F.when(F.col("supplier_id") % 2 == 0, "APPROVE").otherwise("CANCEL").alias("action"))
    return procurement.po_transitions(b.purchase_orders, b.po_lines, b.suppliers, req)


@query("po_transitions", "po_id:s status:s error_code:s",
       f"WITH {_TRANS} SELECT po_id, CASE WHEN code IS NOT NULL THEN status WHEN approve THEN 'APPROVED' ELSE 'CANCELLED' END AS status, code AS error_code FROM j")
def _(b):
    out = _transitions(b)
    return out["orders"].join(out["rejects"].select("po_id", "error_code"), "po_id", "left")


@query("po_transitions_lines", "po_line_id:s line_status:s",
       f"WITH {_TRANS} SELECT l.po_line_id, CASE WHEN code IS NULL AND NOT approve THEN 'CANCELLED' ELSE l.line_status END AS line_status FROM {{po_lines}} l JOIN j ON j.po_id = l.po_id")
def _(b):
    return _transitions(b)["lines"]


@query("reorder_scan", "item_id:l item_code:s warehouse_id:l available:d reorder_point:d suggest_qty:d",
       """SELECT b.item_id, i.item_code, b.warehouse_id, qty_on_hand - qty_allocated AS available, i.reorder_point,
                 GREATEST(i.reorder_qty, i.reorder_point + i.safety_stock - (qty_on_hand - qty_allocated)) AS suggest_qty
            FROM {balances} b JOIN {items} i ON i.item_id = b.item_id
           WHERE i.status = 'ACTIVE' AND i.reorder_point > 0 AND qty_on_hand - qty_allocated < i.reorder_point""")
def _(b):
    return procurement.reorder_scan(b.balances, b.items)


@query("supplier_ranking", "supplier_id:l supplier_name:s rating:l total_amount:d po_count:l on_time_count:l on_time_rate:d amount_rank:l on_time_rank:l amount_share_pct:d",
       f"""WITH r AS (SELECT po.supplier_id, po.po_id, SUM(pl.qty_received * CAST(pl.unit_price AS DECIMAL(14,4))) AS amt,
              MAX(CASE WHEN po.status IN ('RECEIVED', 'CLOSED') AND (po.expected_date IS NULL OR po.expected_date >= po.order_date) THEN 1 ELSE 0 END) AS ok
              FROM {{purchase_orders}} po JOIN {{po_lines}} pl ON pl.po_id = po.po_id
             WHERE po.order_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND po.status <> 'CANCELLED' GROUP BY 1, 2),
           a AS (SELECT s.supplier_id, s.supplier_name, s.rating, COALESCE(SUM(amt), 0) AS total_amount, COUNT(po_id) AS po_count, COALESCE(SUM(ok), 0) AS on_time_count
                   FROM {{suppliers}} s LEFT JOIN r ON r.supplier_id = s.supplier_id GROUP BY 1, 2, 3),
           c AS (SELECT *, COALESCE({exact_div('CAST(on_time_count AS HUGEINT)', 'NULLIF(CAST(po_count AS HUGEINT), 0)', 4)}, 0) AS on_time_rate FROM a)
           SELECT *, RANK() OVER (ORDER BY total_amount DESC) AS amount_rank, DENSE_RANK() OVER (ORDER BY on_time_rate DESC) AS on_time_rank,
                  {exact_div(huge('total_amount', 4) + ' * 100', huge('(SELECT SUM(total_amount) FROM a)', 4), 2)} AS amount_share_pct FROM c""")
def _(b):
    return procurement.supplier_ranking(b.suppliers, b.purchase_orders, b.po_lines, "1998-01-01", "2000-12-31")


_CARTS = """cart AS (SELECT l_orderkey AS customer_id, 'C' || (l_orderkey % 50) AS coupon_code, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
       CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS is_deleted FROM lineitem),
  good AS (SELECT 'C' || s_suppkey AS code, CAST(s_suppkey % 30 AS DECIMAL(4,2)) AS rate FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0),
  ln AS (SELECT c.*, CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_size + 30 AS available FROM cart c JOIN part ON p_partkey = c.product_id WHERE is_deleted = 0),
  per AS (SELECT customer_id, SUM(quantity * price) AS subtotal, COUNT(*) AS n, BOOL_AND(available >= quantity) AS enough FROM ln GROUP BY 1),
  res AS (SELECT h.customer_id, h.coupon_code, COALESCE(n, 0) AS line_count, subtotal, rate AS discount_rate,
                 CASE WHEN rate IS NULL THEN 1001 WHEN n IS NULL THEN 1003 WHEN NOT enough THEN 1002 ELSE 0 END AS result_code
            FROM (SELECT customer_id, MIN(coupon_code) AS coupon_code FROM cart GROUP BY 1) h LEFT JOIN per ON per.customer_id = h.customer_id LEFT JOIN good ON good.code = h.coupon_code)"""


def _checkout(b):
    carts = b.lineitem.select(
        F.col("l_orderkey").alias("customer_id"), F.concat(F.lit("C"), (F.col("l_orderkey") % 50).cast("string")).alias("coupon_code"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(0).alias("is_deleted"))
    products = b.part.select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"))
    stock = b.part.select(F.col("p_partkey").alias("product_id"), (F.col("p_size") + 30).cast("bigint").alias("available_qty"), F.lit(0).cast("bigint").alias("locked_qty"))
    coupons = b.supplier.select(
        F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("code"), (F.col("s_suppkey") % 30).cast("decimal(4,2)").alias("discount_rate"),
        F.when(F.col("s_suppkey") % 7 == 0, "USED").otherwise("ACTIVE").alias("status"),
        F.when(F.col("s_suppkey") % 11 == 0, "2000-01-01").otherwise("2030-01-01").cast("timestamp_ntz").alias("expire_time"))
    return procurement.checkout_carts(carts, products, stock, coupons, "2001-06-15 12:00:00")


@query("checkout_carts", "customer_id:l coupon_code:s line_count:l subtotal:d discount_rate:d result_code:l total_amount:d",
       f"""WITH {_CARTS} SELECT *, CASE WHEN result_code = 0 THEN {exact_div('CAST(subtotal * 100 AS HUGEINT) * CAST((100 - discount_rate) * 100 AS HUGEINT)', 'CAST(1000000 AS HUGEINT)', 2)} END AS total_amount FROM res""")
def _(b):
    return _checkout(b)["orders"]


@query("checkout_carts_stock", "product_id:l available_qty:l locked_qty:l",
       f"""WITH {_CARTS}, sold AS (SELECT product_id, SUM(quantity) AS s FROM ln WHERE customer_id IN (SELECT customer_id FROM res WHERE result_code = 0) GROUP BY 1)
           SELECT p_partkey AS product_id, p_size + 30 - COALESCE(s, 0) AS available_qty, COALESCE(s, 0) AS locked_qty FROM part LEFT JOIN sold ON product_id = p_partkey""")
def _(b):
    return _checkout(b)["stock"]


@query("screen_transfers", "transfer_id:l source_id:l amount:d outcome:s",
       """WITH t AS (SELECT o_orderkey AS transfer_id, CASE WHEN o_orderkey % 23 = 0 THEN -1 - o_custkey ELSE o_custkey END AS source_id,
              CAST(CAST(ROUND(o_totalprice) AS BIGINT) % 3000 AS DECIMAL(18,2)) AS amount FROM orders),
          k AS (SELECT t.*, CAST(c_acctbal AS DECIMAL(18,2)) AS bal, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY transfer_id) AS rn
                  FROM t JOIN customer ON c_custkey = source_id),
          f AS (SELECT transfer_id, source_id, amount, rn, bal - amount < 100 AS no, CAST(CASE WHEN bal - amount < 100 THEN bal ELSE bal - amount END AS DECIMAL(18,2)) AS bal FROM k WHERE rn = 1
                UNION ALL
                SELECT k.transfer_id, k.source_id, k.amount, k.rn, f.bal - k.amount < 100, CAST(CASE WHEN f.bal - k.amount < 100 THEN f.bal ELSE f.bal - k.amount END AS DECIMAL(18,2))
                  FROM f JOIN k ON k.source_id = f.source_id AND k.rn = f.rn + 1)
          SELECT transfer_id, source_id, amount, CASE WHEN no THEN 'INSUFFICIENT' ELSE 'OK' END AS outcome FROM f
          UNION ALL SELECT transfer_id, source_id, amount, 'NOT_FOUND' FROM t WHERE source_id NOT IN (SELECT c_custkey FROM customer)""")
def _(b):
    accounts = b.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    amount = (F.round("o_totalprice").cast("bigint") % 3000).cast("decimal(18,2)")
    transfers = b.orders.select(
        F.col("o_orderkey").alias("transfer_id"), F.when(F.col("o_orderkey") % 23 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("source_id"),
        amount.alias("amount"))
    return procurement.screen_transfers(accounts, transfers, "100")


_END = f"(DATE '{AS_OF}' + {HORIZON_DAYS})"
_DEMAND = f"""dem AS (SELECT item_id, SUM(qty) AS qty FROM (
      SELECT item_id, forecast_qty AS qty FROM {{forecast}} WHERE period_date BETWEEN DATE '{AS_OF}' AND {_END} AND forecast_qty > 0
      UNION ALL
      SELECT l.item_id, l.qty_ordered - l.qty_shipped FROM {{so_lines}} l JOIN {{sales_orders}} o ON o.so_id = l.so_id
       WHERE l.line_status IN ('OPEN', 'PARTIAL') AND o.status IN ('CONFIRMED', 'PARTIAL') AND l.qty_ordered > l.qty_shipped
         AND COALESCE(o.required_date, DATE '{AS_OF}') <= {_END}) GROUP BY item_id)"""
_WH = """wh AS (SELECT * FROM (SELECT item_id, warehouse_id, qty_on_hand, qty_on_hand - qty_allocated AS available,
      ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY qty_on_hand DESC, warehouse_id) AS rn FROM {balances}) WHERE rn = 1)"""
_TRANSIT = f"""tr AS (SELECT l.item_id, SUM(l.qty_ordered - l.qty_received) AS in_transit FROM {{po_lines}} l JOIN {{purchase_orders}} p ON p.po_id = l.po_id
     WHERE l.line_status IN ('OPEN', 'PARTIAL') AND p.status IN ('APPROVED', 'PARTIAL') AND COALESCE(l.need_date, DATE '{AS_OF}') <= {_END} GROUP BY 1)"""


@query("independent_demand", "item_id:l qty:d", f"WITH {_DEMAND} SELECT * FROM dem")
def demand(b):
    return mrp.independent_demand(b.forecast, b.so_lines, b.sales_orders, AS_OF, HORIZON_DAYS)


@query("default_warehouse", "item_id:l warehouse_id:l available:d", f"WITH {_WH} SELECT * FROM wh")
def _(b):
    return mrp.default_warehouse(b.balances)


@query("in_transit", "item_id:l in_transit:d", f"WITH {_TRANSIT} SELECT * FROM tr")
def transit(b):
    return mrp.in_transit(b.po_lines, b.purchase_orders, AS_OF, HORIZON_DAYS)


# The bridged structure is a tree (one parent per item), so netting can run top
# down in one recursion without aggregating between levels.
_LIVE = f"h.status = 'ACTIVE' AND h.is_default = 'Y' AND h.effective_from <= DATE '{AS_OF}' AND (h.effective_to IS NULL OR h.effective_to >= DATE '{AS_OF}')"
_NEED = "(2 * r.net * e.q6 * 10000 + e.y4 * CAST(1000000 AS HUGEINT)) // (2 * e.y4 * CAST(1000000 AS HUGEINT))"


def mrp_sql(phantom_rule: str) -> str:
    return f"""{_DEMAND}, {_WH}, {_TRANSIT},
  e AS (SELECT h.item_id AS parent, l.component_item_id AS child, CAST(l.qty_per * 1000000 AS HUGEINT) AS q6, CAST((1 - l.scrap_rate) * 10000 AS HUGEINT) AS y4, i.is_phantom
          FROM {{bom_lines}} l JOIN {{bom_headers}} h ON h.bom_id = l.bom_id JOIN {{items}} i ON i.item_id = l.component_item_id WHERE {_LIVE}),
  s AS (SELECT i.item_id, i.lead_time_days, wh.warehouse_id, COALESCE(wh.available, 0) AS available, COALESCE(tr.in_transit, 0) AS in_transit,
               CAST(COALESCE(d.qty, 0) * 1000000 AS HUGEINT) AS own, CAST((COALESCE(wh.available, 0) + COALESCE(tr.in_transit, 0)) * 1000000 AS HUGEINT) AS have
          FROM {{items}} i LEFT JOIN wh ON wh.item_id = i.item_id LEFT JOIN tr ON tr.item_id = i.item_id LEFT JOIN dem d ON d.item_id = i.item_id),
  r AS (SELECT s.item_id, 0 AS lvl, s.own AS gross, CASE WHEN s.own > 0 THEN GREATEST(s.own - s.have, 0) ELSE 0 END AS net
          FROM s WHERE item_id NOT IN (SELECT child FROM e)
        UNION ALL
        SELECT g.item_id, g.lvl, {phantom_rule} FROM (
           SELECT s.item_id, r.lvl + 1 AS lvl, s.own, s.have, e.is_phantom, CASE WHEN r.net > 0 THEN {_NEED} ELSE 0 END AS passed
             FROM r JOIN e ON e.parent = r.item_id JOIN s ON s.item_id = e.child) g),
  mplan AS (SELECT r.item_id, s.warehouse_id, {_END} AS bucket_date, r.lvl AS level_no, ROUND(CAST(r.gross AS DECIMAL(28,0)) * CAST(0.000001 AS DECIMAL(7,6)), 4) AS gross_req,
                   s.in_transit AS scheduled_receipt, s.available AS proj_on_hand, ROUND(CAST(r.net AS DECIMAL(28,0)) * CAST(0.000001 AS DECIMAL(7,6)), 4) AS net_req,
                   CASE WHEN r.net > 0 THEN {_END} - COALESCE(s.lead_time_days, 0) END AS planned_order_date,
                   CASE WHEN r.net > 0 THEN '建议下单 提前期' || COALESCE(s.lead_time_days, 0) || '天' ELSE '需求已被在手/在途覆盖' END AS action_msg
              FROM r JOIN s ON s.item_id = r.item_id WHERE r.gross > 0)"""


_SKIP = """g.own + CASE WHEN g.is_phantom = 'Y' THEN 0 ELSE g.passed END,
   CASE WHEN g.own + CASE WHEN g.is_phantom = 'Y' THEN 0 ELSE g.passed END > 0 THEN GREATEST(g.own + CASE WHEN g.is_phantom = 'Y' THEN 0 ELSE g.passed END - g.have, 0) ELSE 0 END"""
_PLAN_COLS = "item_id:l warehouse_id:l bucket_date:s level_no:l gross_req:d scheduled_receipt:d proj_on_hand:d net_req:d planned_order_date:s action_msg:s"


def plan(b, phantom="skip"):
    return mrp.run_mrp(demand(b), b.balances, transit(b), b.items, b.bom_headers, b.bom_lines, AS_OF, HORIZON_DAYS, 1, phantom)


@query("run_mrp", _PLAN_COLS, f"WITH {mrp_sql(_SKIP)} SELECT * FROM mplan")
def _(b):
    return plan(b)[0]


@query("run_mrp_summary", "run_id:l status:s item_count:l plan_count:l max_level:l",
       f"WITH {mrp_sql(_SKIP)} SELECT 1 AS run_id, 'SUCCESS' AS status, COUNT(*) AS item_count, COUNT(*) AS plan_count, MAX(level_no) AS max_level FROM mplan")
def _(b):
    return plan(b)[1]


@query("run_mrp_rejects", "item_id:l level_no:l qty:d error_code:s",
       f"WITH {_DEMAND} SELECT item_id + 900000000 AS item_id, 0 AS level_no, qty, 'M1001' AS error_code FROM dem WHERE item_id % 7 = 0 AND qty > 0")
def _(b):
    """Every seventh item's demand once more under a number that no item has: all of it, and nothing else, is rejected."""
    known = demand(b)
    unknown = known.filter(F.col("item_id") % 7 == 0).withColumn("item_id", F.col("item_id") + 900000000)
    return mrp.run_mrp(known.unionByName(unknown), b.balances, transit(b), b.items, b.bom_headers, b.bom_lines, AS_OF, HORIZON_DAYS)[2]


@query("release_production_orders", "prod_id:l prod_no:s item_id:l bom_id:l qty_planned:d start_date:s due_date:s",
       f"""WITH {mrp_sql(_SKIP)},
           bom AS (SELECT h.item_id, h.bom_id FROM {{bom_headers}} h WHERE {_LIVE.replace(AS_OF, TODAY)}),
           n AS (SELECT p.*, b.bom_id, COALESCE(i.lead_time_days, 0) AS lead, ROW_NUMBER() OVER (ORDER BY level_no, p.item_id, bucket_date) AS seq
                   FROM mplan p JOIN {{items}} i ON i.item_id = p.item_id LEFT JOIN bom b ON b.item_id = p.item_id WHERE p.net_req > 0 AND i.item_type IN ('FG', 'SEMI'))
           SELECT seq AS prod_id, 'PRD' || strftime(planned_order_date, '%Y%m%d') || lpad(CAST(seq % 1000000 AS VARCHAR), 6, '0') AS prod_no, item_id, bom_id,
                  net_req AS qty_planned, planned_order_date - lead AS start_date, planned_order_date AS due_date FROM n""")
def _(b):
    return mrp.release_production_orders(plan(b)[0], b.items, b.bom_headers, TODAY)[0]


_BUY = f"""{mrp_sql(_SKIP)},
  w AS (SELECT p.*, i.preferred_supplier AS supplier_id, i.base_uom, i.std_cost, CASE WHEN s.supplier_id IS NULL THEN 'M4001' WHEN s.status = 'BLOCKED' THEN 'M4004' END AS code
          FROM mplan p JOIN {{items}} i ON i.item_id = p.item_id LEFT JOIN {{suppliers}} s ON s.supplier_id = i.preferred_supplier
         WHERE p.net_req > 0 AND i.item_type = 'RAW' AND i.preferred_supplier IS NOT NULL),
  ln AS (SELECT w.*, ROW_NUMBER() OVER (PARTITION BY supplier_id ORDER BY item_id, level_no) * 10 AS line_no FROM w WHERE code IS NULL),
  hd AS (SELECT supplier_id, MAX(CASE WHEN line_no = 10 THEN warehouse_id END) AS warehouse_id, MAX(CASE WHEN line_no = 10 THEN planned_order_date END) AS expected_date, COUNT(*) AS line_count,
                SUM({exact_div('CAST(net_req * 10000 AS HUGEINT) * CAST(std_cost * 1000000 AS HUGEINT)', 'CAST(10000000000 AS HUGEINT)', 4)}) AS total_amount FROM ln GROUP BY 1)"""


@query("po_from_mrp", "po_id:l po_no:s supplier_id:l warehouse_id:l expected_date:s total_amount:d line_count:l",
       f"""WITH {_BUY}, n AS (SELECT hd.*, ROW_NUMBER() OVER (ORDER BY supplier_id) AS po_id FROM hd)
           SELECT *, 'PO' || strftime(DATE '{AS_OF}', '%Y%m%d') || lpad(CAST(po_id % 1000000 AS VARCHAR), 6, '0') AS po_no FROM n""")
def _(b):
    return procurement.po_from_mrp(plan(b)[0], b.items, b.suppliers, AS_OF)["orders"]


@query("po_from_mrp_lines", "supplier_id:l line_no:l item_id:l qty_ordered:d unit_price:d uom:s need_date:s",
       f"WITH {_BUY} SELECT supplier_id, line_no, item_id, net_req AS qty_ordered, std_cost AS unit_price, base_uom AS uom, planned_order_date AS need_date FROM ln")
def _(b):
    return procurement.po_from_mrp(plan(b)[0], b.items, b.suppliers, AS_OF)["lines"]


@query("netting_detail", "item_id:l bucket_date:s opening_on_hand:d projected_balance:d",
       """SELECT item_id, period_date AS bucket_date, CAST(100 AS DECIMAL(18,4)) AS opening_on_hand,
                 100 + SUM(FLOOR(COALESCE(actual_qty, 0) / 2) + item_id % 7 - forecast_qty) OVER (PARTITION BY item_id ORDER BY period_date) AS projected_balance FROM {forecast}""")
def _(b):
    dec = lambda c: c.cast("decimal(18,4)")
    rows = b.forecast.select(
        F.lit(1).alias("run_id"), "item_id", F.col("period_date").alias("bucket_date"), F.lit(0).alias("level_no"), F.col("forecast_qty").alias("gross_req"),
        dec(F.floor(F.coalesce("actual_qty", F.lit(0)) / 2)).alias("scheduled_receipt"), dec(F.col("item_id") % 7).alias("planned_order_qty"),
        dec(F.lit(100)).alias("proj_on_hand"))
    return mrp.netting_detail(rows)


_HIST = """hist AS (SELECT item_id, warehouse_id, %s FROM (SELECT item_id, warehouse_id, (year(period_date) - 2000) * 12 + month(period_date) - 1 AS n,
      COALESCE(actual_qty, forecast_qty) AS qty FROM {forecast}) WHERE n <= 17 GROUP BY 1, 2)""" % ", ".join(
    f"CAST(COALESCE(SUM(CASE WHEN n = {17 - k} THEN qty END), 0) AS DOUBLE) AS h{k}" for k in range(6))


def _fc_sql(method):
    """Three periods, each from the previous ones (g1 g2 g3 are the new values)."""
    def nxt(prev):
        if method == "TREND":
            return f"GREATEST({prev[0]} + ({prev[0]} - {prev[3]}) / 3.0::DOUBLE, 0.0::DOUBLE)"
        w = 6 if method == "MA6" else 3
        return f"GREATEST(({' + '.join(prev[:w])}) / {w}.0::DOUBLE, 0.0::DOUBLE)"
    h = [f"h{k}" for k in range(6)]
    return f"""{_HIST}, g1 AS (SELECT *, {nxt(h)} AS g1 FROM hist), g2 AS (SELECT *, {nxt(['g1'] + h)} AS g2 FROM g1),
      g3 AS (SELECT *, {nxt(['g2', 'g1'] + h)} AS g3 FROM g2),
      fresh AS (SELECT item_id, warehouse_id, DATE '2001-07-01' AS period_date, CAST(ROUND(g1, 4) AS DECIMAL(18,4)) AS forecast_qty FROM g3
        UNION ALL SELECT item_id, warehouse_id, DATE '2001-08-01', CAST(ROUND(g2, 4) AS DECIMAL(18,4)) FROM g3
        UNION ALL SELECT item_id, warehouse_id, DATE '2001-09-01', CAST(ROUND(g3, 4) AS DECIMAL(18,4)) FROM g3)"""


for _m in ("MA3", "MA6", "TREND"):
    query(f"forecast_{_m.lower()}", "item_id:l warehouse_id:l period_date:s forecast_qty:d", f"WITH {_fc_sql(_m)} SELECT * FROM fresh")(
        lambda b, m=_m: forecast.forecast_periods(b.forecast, m, 3, AS_OF))


@query("generate_forecast", "item_id:l warehouse_id:l period_date:s method:s forecast_qty:d actual_qty:d",
       f"""WITH {_fc_sql('MA3')}, f AS (SELECT *, 'MA3' AS method FROM fresh)
           SELECT COALESCE(t.item_id, f.item_id) AS item_id, COALESCE(t.warehouse_id, f.warehouse_id) AS warehouse_id, COALESCE(t.period_date, f.period_date) AS period_date,
                  COALESCE(t.method, f.method) AS method, COALESCE(f.forecast_qty, t.forecast_qty) AS forecast_qty, t.actual_qty
             FROM {{forecast}} t FULL JOIN f ON f.item_id = t.item_id AND f.warehouse_id IS NOT DISTINCT FROM t.warehouse_id AND f.period_date = t.period_date AND f.method = t.method""")
def _(b):
    return forecast.generate_forecast(b.forecast, "MA3", 3, AS_OF)


_DIV4 = lambda n, d: exact_div(huge(n, 4), huge(f"NULLIF({d}, 0)", 4), 4)


@query("forecast_accuracy", "item_id:l period_date:s method:s forecast_qty:d actual_qty:d abs_pct_err:d bias:d prev_actual:d next_actual:d mom_growth:d mape_3m:d rolling_accuracy:d",
       f"""WITH b AS (SELECT *, {_DIV4('ABS(actual_qty - forecast_qty)', 'actual_qty')} AS abs_pct_err, forecast_qty - actual_qty AS bias
               FROM {{forecast}} WHERE actual_qty IS NOT NULL AND method <> 'MANUAL'),
           w AS (SELECT b.*, LAG(actual_qty) OVER k AS prev_actual, LEAD(actual_qty) OVER k AS next_actual, SUM(abs_pct_err) OVER m AS se, COUNT(abs_pct_err) OVER m AS ne
                   FROM b WINDOW k AS (PARTITION BY item_id ORDER BY period_date), m AS (PARTITION BY item_id ORDER BY period_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
           SELECT *, {_DIV4('actual_qty - prev_actual', 'prev_actual')} AS mom_growth, {exact_div(huge('se', 4), 'CAST(NULLIF(ne, 0) * 10000 AS HUGEINT)', 4)} AS mape_3m,
                  {exact_div('CAST((ne - se) * 10000 AS HUGEINT)', 'CAST(NULLIF(ne, 0) * 10000 AS HUGEINT)', 4)} AS rolling_accuracy FROM w""")
def _(b):
    return forecast.forecast_accuracy(b.forecast)


@query("pivot_demand", "item_id:l M_200101:d M_200102:d M_200103:d M_200104:d",
       "SELECT item_id, " + ", ".join(f"SUM(CASE WHEN strftime(period_date, '%Y%m') = '{m}' THEN COALESCE(actual_qty, forecast_qty) END) AS M_{m}" for m in ("200101", "200102", "200103", "200104"))
       + " FROM {forecast} WHERE period_date BETWEEN DATE '2001-01-01' AND DATE '2001-04-01' GROUP BY 1")
def _(b):
    return forecast.pivot_demand(b.forecast, "2001-01-15", "2001-04-20")


@query("period_index", "o_orderkey:l n:l", "SELECT o_orderkey, (year(o_orderdate) - 2000) * 12 + month(o_orderdate) - 1 AS n FROM orders")
def _(b):
    return b.orders.select("o_orderkey", period_index(F.col("o_orderdate")).alias("n"))
