"""Inventory movements and utilities over the bridged tables."""

import uuid

from pyspark.sql import functions as F

from millrace.operators import inventory, utility
from millrace.plans.bridge import AS_OF
from millrace.plans.catalog import exact_div, huge, query
from millrace.session import scratch_root
from millrace.sources.files import write_ledger

_K = "item_id, warehouse_id"
_OPEN = """open_lots AS MATERIALIZED (SELECT item_id, warehouse_id, lot_id, unit_cost, qty_on_hand - qty_allocated AS avail,
        SUM(qty_on_hand - qty_allocated) OVER (PARTITION BY item_id, warehouse_id ORDER BY receipt_date, lot_id) AS hi
   FROM {lots} WHERE status = 'AVAILABLE' AND qty_on_hand - qty_allocated > 0)"""


def _served(requests: str) -> str:
    """Greedy admission: one sum per key decides where all fits, a list fold per contended key elsewhere (no recursion)."""
    return f"""req AS MATERIALIZED ({requests}),
    num AS MATERIALIZED (SELECT r.*, COALESCE(b.qty_on_hand - b.qty_allocated, 0) AS avail0
              FROM req r LEFT JOIN {{balances}} b ON b.item_id = r.item_id AND b.warehouse_id = r.warehouse_id WHERE qty > 0),
    asked AS MATERIALIZED (SELECT item_id, warehouse_id, MAX(avail0) AS avail0, SUM(qty) AS asked FROM num GROUP BY 1, 2),
    calm AS MATERIALIZED (SELECT n.request_id, n.item_id, n.warehouse_id, n.qty,
                    CAST(n.avail0 - SUM(n.qty) OVER (PARTITION BY n.item_id, n.warehouse_id ORDER BY request_id) + n.qty AS DECIMAL(28,4)) AS before, TRUE AS ok
               FROM num n JOIN asked a ON a.item_id = n.item_id AND a.warehouse_id = n.warehouse_id WHERE a.asked <= a.avail0),
    lists AS MATERIALIZED (SELECT n.item_id, n.warehouse_id, list(n.request_id ORDER BY n.request_id) AS ids, list(n.qty ORDER BY n.request_id) AS qtys,
                     list(CAST(n.qty * 10000 AS BIGINT) ORDER BY n.request_id) AS want, CAST(MAX(n.avail0) * 10000 AS BIGINT) AS start
                FROM num n JOIN asked a ON a.item_id = n.item_id AND a.warehouse_id = n.warehouse_id WHERE NOT a.asked <= a.avail0 GROUP BY 1, 2),
    rests AS MATERIALIZED (SELECT *, list_reduce(list_prepend([start], list_transform(want, lambda w: [w])),
                     lambda acc, w: list_append(acc, CASE WHEN w[1] <= acc[-1] THEN acc[-1] - w[1] ELSE acc[-1] END)) AS rest FROM lists),
    tight AS MATERIALIZED (SELECT ids[i] AS request_id, item_id, warehouse_id, qtys[i] AS qty, CAST(CAST(rest[i] AS DECIMAL(24,0)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(28,4)) AS before, want[i] <= rest[i] AS ok
                FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM rests)),
    adm AS MATERIALIZED (SELECT * FROM calm UNION ALL SELECT * FROM tight),
    served AS MATERIALIZED (SELECT *, SUM(qty) OVER (PARTITION BY item_id, warehouse_id ORDER BY request_id) AS hi FROM adm WHERE ok),
    {_OPEN},
    alloc AS MATERIALIZED (SELECT s.request_id, s.item_id, s.warehouse_id, l.lot_id, l.unit_cost, s.before,
                     LEAST(l.hi, s.hi) - GREATEST(l.hi - l.avail, s.hi - s.qty) AS qty,
                     GREATEST(l.hi - l.avail, s.hi - s.qty) - (s.hi - s.qty) AS drawn
                FROM served s JOIN open_lots l ON l.item_id = s.item_id AND l.warehouse_id = s.warehouse_id
                 AND LEAST(l.hi, s.hi) > GREATEST(l.hi - l.avail, s.hi - s.qty))"""


_ISSUES = """SELECT so_line_id AS request_id, item_id, CAST(so_id % 3 + 1 AS INT) AS warehouse_id, qty_ordered AS qty FROM {so_lines}"""


def _issue_requests(b):
    return b.so_lines.select(F.col("so_line_id").alias("request_id"), "item_id",
                             (F.col("so_id") % 3 + 1).cast("int").alias("warehouse_id"), F.col("qty_ordered").alias("qty"))


def _issue(b):
    return inventory.fifo_allocate(b.lots, _issue_requests(b), b.balances, ["request_id"], AS_OF)


@query("fifo_allocate", "request_id:s item_id:l warehouse_id:l lot_id:s quantity:d unit_cost:d total_cost:d qty_before:d qty_after:d",
       f"""WITH {_served(_ISSUES)} SELECT request_id, item_id, warehouse_id, lot_id, qty AS quantity, unit_cost,
            CAST(qty * CAST(unit_cost AS DECIMAL(14,4)) AS DECIMAL(20,4)) AS total_cost, before - drawn AS qty_before, before - drawn - qty AS qty_after FROM alloc""")
def _(b):
    return _issue(b)["txns"].withColumnRenamed("ref_doc_id", "request_id")


@query("fifo_allocate_lots", "lot_id:s qty_on_hand:d status:s",
       f"""WITH {_served(_ISSUES)}, used AS (SELECT lot_id, SUM(qty) AS u FROM alloc GROUP BY lot_id)
           SELECT l.lot_id, l.qty_on_hand - COALESCE(u, 0) AS qty_on_hand,
                  CASE WHEN u IS NOT NULL AND l.qty_on_hand - u = 0 THEN 'CONSUMED' ELSE l.status END AS status
             FROM {{lots}} l LEFT JOIN used ON used.lot_id = l.lot_id""")
def _(b):
    return _issue(b)["lots"]


@query("fifo_allocate_exceptions", "request_id:s kind:s qty:d",
       f"""WITH {_served(_ISSUES)}, got AS (SELECT request_id, SUM(qty) AS g FROM alloc GROUP BY request_id)
           SELECT request_id, 'M3001' AS kind, qty FROM adm WHERE NOT ok
           UNION ALL SELECT s.request_id, 'SHORT', s.qty - COALESCE(g, 0) FROM served s LEFT JOIN got ON got.request_id = s.request_id
            WHERE s.qty - COALESCE(g, 0) > 0""")
def _(b):
    out = _issue(b)
    return out["rejects"].select("request_id", F.col("error_code").alias("kind"), "qty").unionByName(
        out["short"].select("request_id", F.lit("SHORT").alias("kind"), F.col("short_qty").alias("qty")))


def _folded(moves: str) -> str:
    """Moving average by a recursion over the movements of each key."""
    step = exact_div("(CAST(n.before * 10000 AS HUGEINT) * CAST(f.avg * 1000000 AS HUGEINT) + CAST(n.in_qty * 10000 AS HUGEINT) * CAST(n.in_cost * 1000000 AS HUGEINT))",
                     "(CAST((n.before + n.in_qty) * 10000 AS HUGEINT) * 1000000)", 6)
    return f"""mv AS ({moves}),
    n AS (SELECT m.*, ROW_NUMBER() OVER w AS rn, COALESCE(b.qty_on_hand, 0) + SUM(delta_qty) OVER w - delta_qty AS before,
                 b.avg_cost AS a0, b.version AS v0
            FROM mv m LEFT JOIN {{balances}} b ON b.item_id = m.item_id AND b.warehouse_id = m.warehouse_id
          WINDOW w AS (PARTITION BY m.item_id, m.warehouse_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    f AS (SELECT seq, item_id, warehouse_id, rn, before, delta_qty, v0,
                 CAST(CASE WHEN a0 IS NULL THEN COALESCE(in_cost, 0)
                      WHEN in_cost IS NOT NULL AND before + in_qty > 0 THEN {step.replace('f.avg', 'a0').replace('n.', '')}
                      ELSE a0 END AS DECIMAL(20,6)) AS avg FROM n WHERE rn = 1
          UNION ALL
          SELECT n.seq, n.item_id, n.warehouse_id, n.rn, n.before, n.delta_qty, n.v0,
                 CAST(CASE WHEN n.in_cost IS NOT NULL AND n.before + n.in_qty > 0 THEN {step} ELSE f.avg END AS DECIMAL(20,6))
            FROM f JOIN n ON n.item_id = f.item_id AND n.warehouse_id = f.warehouse_id AND n.rn = f.rn + 1),
    after AS (SELECT item_id, warehouse_id, arg_max(before + delta_qty, rn) AS qty, arg_max(avg, rn) AS avg, MAX(rn) AS moves FROM f GROUP BY 1, 2)"""


_NEXT = """SELECT COALESCE(b.item_id, a.item_id) AS item_id, COALESCE(b.warehouse_id, a.warehouse_id) AS warehouse_id,
      COALESCE(a.qty, b.qty_on_hand) AS qty_on_hand, COALESCE(a.avg, b.avg_cost) AS avg_cost,
      CASE WHEN b.item_id IS NULL THEN a.moves - 1 ELSE b.version + COALESCE(a.moves, 0) END AS version
 FROM {balances} b FULL JOIN after a ON a.item_id = b.item_id AND a.warehouse_id = b.warehouse_id"""

_MOVES = """SELECT CAST(txn_date AS VARCHAR(10)) || txn_id AS seq, item_id, warehouse_id,
      CAST(CASE WHEN direction = 'I' THEN quantity ELSE -quantity END AS DECIMAL(18,4)) AS delta_qty,
      CAST(CASE WHEN direction = 'I' THEN quantity ELSE 0 END AS DECIMAL(18,4)) AS in_qty,
      CASE WHEN direction = 'I' THEN unit_cost END AS in_cost FROM {ledger}"""


def movements(b):
    inbound = F.col("direction") == "I"
    return b.ledger.select(
        F.concat(F.col("txn_date").cast("string"), "txn_id").alias("seq"), "item_id", "warehouse_id",
        F.when(inbound, F.col("quantity")).otherwise(-F.col("quantity")).cast("decimal(18,4)").alias("delta_qty"),
        F.when(inbound, F.col("quantity")).otherwise(0).cast("decimal(18,4)").alias("in_qty"),
        F.when(inbound, F.col("unit_cost")).alias("in_cost"))


@query("apply_movements", "item_id:l warehouse_id:l qty_on_hand:d avg_cost:d version:l", f"WITH {_folded(_MOVES)} {_NEXT}")
def _(b):
    return inventory.apply_movements(b.balances, movements(b), ["seq"], AS_OF)[0]


@query("apply_movements_trail", "seq:s item_id:l warehouse_id:l qty_before:d qty_after:d avg_cost_after:d",
       f"""WITH {_folded(_MOVES)} SELECT seq, item_id, warehouse_id, before AS qty_before, before + delta_qty AS qty_after, avg AS avg_cost_after FROM f""")
def _(b):
    return inventory.apply_movements(b.balances, movements(b), ["seq"], AS_OF)[1]


@query("post_ledger", "txn_id:l txn_no:s so_line_id:s total_cost:d",
       f"""WITH n AS (SELECT l.*, ROW_NUMBER() OVER (ORDER BY so_line_id) AS seq FROM {{so_lines}} l)
           SELECT seq AS txn_id, 'IT' || strftime(DATE '{AS_OF}', '%Y%m%d') || lpad(CAST(seq % 1000000 AS VARCHAR), 6, '0') AS txn_no,
                  so_line_id, CAST(qty_ordered * CAST(unit_price AS DECIMAL(14,4)) AS DECIMAL(20,4)) AS total_cost FROM n""")
def _(b):
    mv = b.so_lines.select("so_line_id", F.col("qty_ordered").alias("quantity"), F.col("unit_price").alias("unit_cost"))
    return inventory.post_ledger(mv, AS_OF, ["so_line_id"])


_RECEIPTS = """SELECT po_line_id AS seq, l.item_id, o.warehouse_id, qty_received AS delta_qty, qty_received AS in_qty,
      CASE WHEN l.item_id % 5 = 0 THEN CAST(0 AS DECIMAL(20,6)) ELSE unit_price END AS in_cost
 FROM {po_lines} l JOIN {purchase_orders} o ON o.po_id = l.po_id WHERE qty_received > 0"""


def _receipts(b):
    return b.po_lines.join(b.purchase_orders.select("po_id", "warehouse_id"), "po_id").select(
        "po_line_id", "item_id", "warehouse_id", F.col("qty_received").alias("qty"),
        F.when(F.col("item_id") % 5 == 0, F.lit(None)).otherwise(F.col("unit_price")).alias("unit_cost"), F.lit(None).cast("string").alias("lot_no"))


@query("receive_stock", "item_id:l warehouse_id:l qty_on_hand:d avg_cost:d version:l", f"WITH {_folded(_RECEIPTS)} {_NEXT}")
def _(b):
    return inventory.receive_stock(_receipts(b), b.balances, ["po_line_id"], AS_OF)["balances"]


@query("receive_stock_txns", "txn_no:s lot_id:l item_id:l warehouse_id:l quantity:d unit_cost:d total_cost:d qty_before:d qty_after:d",
       f"""WITH {_folded(_RECEIPTS)}, k AS (SELECT mv.*, ROW_NUMBER() OVER (ORDER BY seq) AS lot FROM mv)
           SELECT 'IT' || strftime(DATE '{AS_OF}', '%Y%m%d') || lpad(CAST(lot % 1000000 AS VARCHAR), 6, '0') AS txn_no, lot AS lot_id,
                  k.item_id, k.warehouse_id, k.in_qty AS quantity, k.in_cost AS unit_cost,
                  CAST(k.in_qty * CAST(k.in_cost AS DECIMAL(14,4)) AS DECIMAL(20,4)) AS total_cost, f.before AS qty_before, f.before + f.delta_qty AS qty_after
             FROM k JOIN f ON f.seq = k.seq""")
def _(b):
    return inventory.receive_stock(_receipts(b), b.balances, ["po_line_id"], AS_OF)["txns"]


@query("receive_stock_rejects", "po_line_id:s error_code:s", "SELECT po_line_id, 'M3005' AS error_code FROM {po_lines} WHERE qty_received <= 0")
def _(b):
    return inventory.receive_stock(_receipts(b), b.balances, ["po_line_id"], AS_OF)["rejects"]


@query("receive_stock_by_code", "po_line_id:s item_id:l warehouse_id:l unit_cost:d error_code:s",
       """WITH r AS (SELECT po_line_id, CASE WHEN l.item_id % 19 = 0 THEN 'Z' ELSE 'P' END || l.item_id AS item_code,
              CASE o.warehouse_id WHEN 1 THEN 'WH-RAW' WHEN 2 THEN 'WH-FG' ELSE 'WH-OLD' END AS warehouse_code
              FROM {po_lines} l JOIN {purchase_orders} o ON o.po_id = l.po_id),
          j AS (SELECT r.po_line_id, i.item_id, w.warehouse_id, i.std_cost, CASE WHEN i.item_id IS NULL THEN 'M1001' WHEN w.warehouse_id IS NULL THEN 'M3004' END AS error_code
                  FROM r LEFT JOIN {items} i ON i.item_code = r.item_code LEFT JOIN {warehouses} w ON w.warehouse_code = r.warehouse_code)
          SELECT po_line_id, item_id, warehouse_id, CASE WHEN error_code IS NULL THEN std_cost END AS unit_cost, error_code FROM j""")
def _(b):
    src = b.po_lines.join(b.purchase_orders.select("po_id", "warehouse_id"), "po_id").select(
        "po_line_id", F.concat(F.when(F.col("item_id") % 19 == 0, "Z").otherwise("P"), F.col("item_id").cast("string")).alias("item_code"),
        F.expr("CASE warehouse_id WHEN 1 THEN 'WH-RAW' WHEN 2 THEN 'WH-FG' ELSE 'WH-OLD' END").alias("warehouse_code"))
    good, bad = inventory.receive_stock_by_code(src, b.items, b.warehouses)
    return good.unionByName(bad.drop("std_cost"), allowMissingColumns=True)


def _bulk(b):
    lines = b.po_lines.join(b.purchase_orders.select("po_id", "warehouse_id"), "po_id").select(
        "po_line_id", F.when(F.col("item_id") % 17 == 0, -F.col("item_id") - 1).otherwise(F.col("item_id")).alias("item_id"), "warehouse_id",
        F.col("qty_received").alias("qty"), F.col("unit_price").alias("unit_cost"), F.lit(None).cast("string").alias("lot_no"))
    return inventory.bulk_receive(lines, b.items, b.warehouses, b.balances, ["po_line_id"], AS_OF)


@query("bulk_receive_counts", "ok_count:l fail_count:l",
       """SELECT COUNT(*) FILTER (WHERE qty_received > 0 AND item_id % 17 <> 0) AS ok_count,
                 COUNT(*) FILTER (WHERE NOT (qty_received > 0 AND item_id % 17 <> 0)) AS fail_count FROM {po_lines}""")
def _(b):
    return _bulk(b)["counts"]


@query("bulk_receive_lots", "lot_id:l lot_no:s item_id:l warehouse_id:l qty_on_hand:d unit_cost:d",
       f"""WITH g AS (SELECT l.*, o.warehouse_id, ROW_NUMBER() OVER (ORDER BY po_line_id) AS lot FROM {{po_lines}} l JOIN {{purchase_orders}} o ON o.po_id = l.po_id
             WHERE qty_received > 0 AND l.item_id % 17 <> 0)
           SELECT lot AS lot_id, 'LOT' || strftime(DATE '{AS_OF}', '%Y%m%d') || lpad(CAST(lot % 1000000 AS VARCHAR), 6, '0') AS lot_no, item_id, warehouse_id,
                  qty_received AS qty_on_hand, unit_price AS unit_cost FROM g""")
def _(b):
    return _bulk(b)["lots"]


_WORTH = "CAST(SUM(q * CAST(c AS DECIMAL(14,4))) * 10000 AS HUGEINT)"
_COUNTS = """cnt AS (SELECT DISTINCT l.item_id, l.warehouse_id, COALESCE(b.qty_on_hand - b.qty_allocated, 0) AS available, COALESCE(b.avg_cost, 0) AS a,
        CASE WHEN l.item_id % 97 = 0 THEN -1 ELSE GREATEST(COALESCE(b.qty_on_hand - b.qty_allocated, 0) + l.item_id % 7 - 3, 0) END AS counted
   FROM {lots} l LEFT JOIN {balances} b ON b.item_id = l.item_id AND b.warehouse_id = l.warehouse_id),
   d AS (SELECT item_id, warehouse_id, a, counted - available AS diff FROM cnt WHERE counted >= 0 AND counted <> available)"""


@query("adjust_stock", "item_id:l warehouse_id:l qty_on_hand:d qty_allocated:d avg_cost:d version:l",
       f"""WITH {_COUNTS}, {_OPEN},
           used AS (SELECT lot_id, LEAST(hi, -diff) - (hi - avail) AS u FROM open_lots o JOIN d ON d.item_id = o.item_id AND d.warehouse_id = o.warehouse_id
                     WHERE diff < 0 AND LEAST(hi, -diff) > hi - avail),
           fresh AS (SELECT l.item_id, l.warehouse_id, l.qty_on_hand - COALESCE(u, 0) AS q, l.qty_allocated AS al, l.unit_cost AS c
                       FROM {{lots}} l LEFT JOIN used ON used.lot_id = l.lot_id
                      WHERE CASE WHEN u IS NOT NULL AND l.qty_on_hand - u = 0 THEN 'CONSUMED' ELSE l.status END IN ('AVAILABLE', 'QUARANTINE')
                     UNION ALL SELECT item_id, warehouse_id, diff, 0, a FROM d WHERE diff > 0),
           s AS (SELECT {_K}, SUM(q) AS q, SUM(al) AS al, {exact_div(_WORTH, "CAST(NULLIF(SUM(q), 0) * 10000 AS HUGEINT)", 6)} AS avg FROM fresh GROUP BY 1, 2)
           SELECT d.item_id, d.warehouse_id, COALESCE(q, 0) AS qty_on_hand, COALESCE(al, 0) AS qty_allocated, COALESCE(avg, 0) AS avg_cost, COALESCE(b.version + 1, 0) AS version
             FROM d LEFT JOIN s ON s.item_id = d.item_id AND s.warehouse_id = d.warehouse_id LEFT JOIN {{balances}} b ON b.item_id = d.item_id AND b.warehouse_id = d.warehouse_id
           UNION ALL SELECT b.item_id, b.warehouse_id, b.qty_on_hand, b.qty_allocated, b.avg_cost, b.version FROM {{balances}} b
            WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.item_id = b.item_id AND d.warehouse_id = b.warehouse_id)""")
def _(b):
    keys = inventory.available_qty(b.balances, b.lots.select("item_id", "warehouse_id").distinct())
    counts = keys.select("item_id", "warehouse_id", F.when(F.col("item_id") % 97 == 0, -1).otherwise(
        F.greatest(F.col("available") + F.col("item_id") % 7 - 3, F.lit(0))).cast("decimal(18,4)").alias("counted"))
    return inventory.adjust_stock(counts, b.lots, b.balances, AS_OF)["balances"]


_MOVE_REQ = """SELECT so_line_id AS request_id, item_id, CAST(so_id % 3 + 1 AS INT) AS warehouse_id, CAST((item_id + so_id) % 4 AS INT) AS to_wh, qty_ordered AS qty
   FROM {so_lines} WHERE CAST(so_id % 3 + 1 AS INT) <> CAST((item_id + so_id) % 4 AS INT)"""


def _transfer(b, **how):
    moves = b.so_lines.select(F.col("so_line_id").alias("move_id"), "item_id", (F.col("so_id") % 3 + 1).cast("int").alias("from_wh"),
                              ((F.col("item_id") + F.col("so_id")) % 4).cast("int").alias("to_wh"), F.col("qty_ordered").alias("qty"))
    return inventory.transfer_stock(moves, b.lots, b.balances, ["move_id"], AS_OF, **how)


@query("transfer_stock", "move_id:s warehouse_id:l qty:d unit_cost:d error_code:s",
       f"""WITH {_served(_MOVE_REQ)},
           c AS (SELECT request_id, SUM(qty) AS moved, SUM(CAST(qty * CAST(unit_cost AS DECIMAL(14,4)) AS DECIMAL(20,4))) AS cost FROM alloc GROUP BY request_id)
           SELECT s.request_id AS move_id, r.to_wh AS warehouse_id, c.moved AS qty, {exact_div('CAST(c.cost * 10000 AS HUGEINT)', huge('c.moved', 4), 6)} AS unit_cost, NULL AS error_code
             FROM served s JOIN req r ON r.request_id = s.request_id JOIN c ON c.request_id = s.request_id
           UNION ALL SELECT s.request_id, s.warehouse_id, s.qty - COALESCE(c.moved, 0), NULL, 'SHORT' FROM served s LEFT JOIN c ON c.request_id = s.request_id WHERE s.qty > COALESCE(c.moved, 0)
           UNION ALL SELECT request_id, NULL, NULL, NULL, 'M3001' FROM adm WHERE NOT ok
           UNION ALL SELECT so_line_id, NULL, NULL, NULL, 'M3004' FROM {{so_lines}} WHERE CAST(so_id % 3 + 1 AS INT) = CAST((item_id + so_id) % 4 AS INT)""")
def _(b):
    out = _transfer(b)
    short = out["short"].select("move_id", "warehouse_id", F.col("short_qty").alias("qty"), F.lit("SHORT").alias("error_code"))
    return out["inbound"].unionByName(out["rejects"], allowMissingColumns=True).unionByName(short, allowMissingColumns=True)


@query("transfer_stock_balances", "item_id:l qty:d",
       "SELECT item_id, SUM(qty_on_hand) AS qty FROM {balances} GROUP BY item_id")
def _(b):
    """A transfer changes no item's total quantity."""
    after = _transfer(b)["balances"]
    return after.groupBy("item_id").agg(F.sum("qty_on_hand").alias("qty"))


# Arrivals in move order: each is a lot and a ledger row of its own at the weighted cost of the lots drawn.
_ARRIVED = f"""WITH {_served(_MOVE_REQ)},
    c AS MATERIALIZED (SELECT request_id, SUM(qty) AS moved, SUM(CAST(qty * CAST(unit_cost AS DECIMAL(14,4)) AS DECIMAL(20,4))) AS cost FROM alloc GROUP BY request_id),
    arr AS MATERIALIZED (SELECT c.request_id, r.item_id, r.to_wh AS warehouse_id, c.moved AS qty, {exact_div('CAST(c.cost * 10000 AS HUGEINT)', huge('c.moved', 4), 6)} AS unit_cost,
                   ROW_NUMBER() OVER (ORDER BY c.request_id) AS lot FROM c JOIN req r ON r.request_id = c.request_id),
    drawn AS MATERIALIZED (SELECT item_id, warehouse_id, SUM(qty) AS u FROM alloc GROUP BY 1, 2)"""


@query("transfer_stock_lots", "lot_id:l lot_no:s item_id:l warehouse_id:l qty_on_hand:d unit_cost:d",
       f"""{_ARRIVED} SELECT 5000000 + lot AS lot_id, 'LOT' || strftime(DATE '{AS_OF}', '%Y%m%d') || lpad(CAST((5000000 + lot) % 1000000 AS VARCHAR), 6, '0') AS lot_no,
            item_id, warehouse_id, qty AS qty_on_hand, unit_cost FROM arr""")
def _(b):
    return _transfer(b, start_lot=5_000_000)["target_lots"]


@query("transfer_stock_txns", "ref_doc_id:s txn_type:s direction:s lot_id:s item_id:l warehouse_id:l quantity:d unit_cost:d qty_before:d qty_after:d",
       f"""{_ARRIVED},
           ins AS (SELECT a.*, COALESCE(b.qty_on_hand, 0) - COALESCE(d.u, 0) + SUM(a.qty) OVER (PARTITION BY a.item_id, a.warehouse_id ORDER BY a.lot) AS after
                     FROM arr a LEFT JOIN {{balances}} b ON b.item_id = a.item_id AND b.warehouse_id = a.warehouse_id
                     LEFT JOIN drawn d ON d.item_id = b.item_id AND d.warehouse_id = b.warehouse_id)
           SELECT request_id AS ref_doc_id, 'XFER_OUT' AS txn_type, 'O' AS direction, lot_id, item_id, warehouse_id, qty AS quantity, unit_cost, before - drawn AS qty_before,
                  before - drawn - qty AS qty_after FROM alloc
           UNION ALL SELECT request_id, 'XFER_IN', 'I', CAST(lot AS VARCHAR), item_id, warehouse_id, qty, unit_cost, after - qty, after FROM ins""")
def _(b):
    out = _transfer(b)
    return out["txns_out"].unionByName(out["txns_in"].withColumn("lot_id", F.col("lot_id").cast("string")))


@query("transfer_stock_full_balances", "item_id:l warehouse_id:l qty_on_hand:d",
       f"""WITH {_served(_MOVE_REQ)},
           m AS (SELECT item_id, warehouse_id, -qty AS d FROM served UNION ALL
                 SELECT s.item_id, r.to_wh, s.qty FROM served s JOIN req r ON r.request_id = s.request_id),
           k AS (SELECT item_id, warehouse_id, qty_on_hand AS d FROM {{balances}} UNION ALL SELECT * FROM m)
           SELECT item_id, warehouse_id, SUM(d) AS qty_on_hand FROM k GROUP BY 1, 2""")
def _(b):
    """The asked quantity leaves one side and reaches the other, whatever the lots gave."""
    return _transfer(b, full_quantity=True)["balances"]


@query("fifo_allocate_balances", "item_id:l warehouse_id:l qty_on_hand:d",
       f"""WITH {_served(_ISSUES)}, used AS (SELECT item_id, warehouse_id, SUM(qty) AS u FROM alloc GROUP BY 1, 2)
           SELECT b.item_id, b.warehouse_id, b.qty_on_hand - COALESCE(u, 0) AS qty_on_hand
             FROM {{balances}} b LEFT JOIN used ON used.item_id = b.item_id AND used.warehouse_id = b.warehouse_id""")
def _(b):
    return _issue(b)["balances"]


@query("available_qty", "item_id:l warehouse_id:l available:d",
       f"""SELECT k.item_id, k.warehouse_id, COALESCE(b.qty_on_hand - b.qty_allocated, 0) AS available
             FROM (SELECT DISTINCT {_K} FROM {{lots}}) k LEFT JOIN {{balances}} b ON b.item_id = k.item_id AND b.warehouse_id = k.warehouse_id""")
def _(b):
    return inventory.available_qty(b.balances, b.lots.select("item_id", "warehouse_id").distinct())


@query("archive_txns", "target:s month:s n:l quantity:d",
       """SELECT CASE WHEN txn_date < DATE '1999-07-01' THEN 't_inv_txn_arch_199907' ELSE 'ledger' END AS target,
                 strftime(txn_date, '%Y%m') AS month, COUNT(*) AS n, SUM(quantity) AS quantity FROM {ledger} GROUP BY 1, 2""")
def _(b):
    old, rest, name = inventory.archive_txns(b.ledger, "1999-07-01")
    both = old.withColumn("target", F.lit(name)).unionByName(rest.withColumn("target", F.lit("ledger")))
    return both.groupBy("target", F.date_format("txn_date", "yyyyMM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("archive_ledger", "target:s month:s n:l quantity:d",
       """SELECT CASE WHEN txn_date < DATE '1999-07-15' THEN 'archive' ELSE 'ledger' END AS target,
                 strftime(txn_date, '%Y%m') AS month, COUNT(*) AS n, SUM(quantity) AS quantity FROM {ledger} GROUP BY 1, 2""")
def _(b):
    """Written by month, archived twice in the middle of a month, and read back from both sides."""
    root = f"{scratch_root(b.spark)}/millrace/ledger-{uuid.uuid4().hex}"
    write_ledger(b.ledger, f"{root}/ledger", grain="month")
    for day in ("1999-07-04", "1999-07-15"):
        inventory.archive_ledger(b.spark, f"{root}/ledger", day, f"{root}/archive")
    read = lambda path, target: b.spark.read.parquet(f"{root}/{path}").select(F.lit(target).alias("target"), F.col("txn_month").cast("string").alias("month"), "quantity")
    both = read("archive/t_inv_txn_arch_199907", "archive").unionByName(read("ledger", "ledger"))
    return both.groupBy("target", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("reconcile_balances", "item_id:l warehouse_id:l ledger_qty:d lot_qty:d balance_qty:d lot_delta:d balance_delta:d",
       f"""WITH k AS (SELECT {_K}, SUM(CASE WHEN direction = 'I' THEN quantity ELSE -quantity END) AS lq FROM {{ledger}} GROUP BY 1, 2),
           l AS (SELECT {_K}, SUM(qty_on_hand) AS lot FROM {{lots}} WHERE status IN ('AVAILABLE', 'QUARANTINE') GROUP BY 1, 2),
           u AS (SELECT {_K} FROM k UNION SELECT {_K} FROM l UNION SELECT {_K} FROM {{balances}}),
           z AS (SELECT u.item_id, u.warehouse_id, COALESCE(lq, 0) AS ledger_qty, COALESCE(lot, 0) AS lot_qty, COALESCE(b.qty_on_hand, 0) AS balance_qty
                   FROM u LEFT JOIN k ON k.item_id = u.item_id AND k.warehouse_id = u.warehouse_id LEFT JOIN l ON l.item_id = u.item_id AND l.warehouse_id = u.warehouse_id
                   LEFT JOIN {{balances}} b ON b.item_id = u.item_id AND b.warehouse_id = u.warehouse_id)
           SELECT *, lot_qty - ledger_qty AS lot_delta, balance_qty - ledger_qty AS balance_delta FROM z""")
def _(b):
    return inventory.reconcile_balances(b.ledger, b.lots, b.balances)


_UOM_IN = """SELECT so_line_id, qty_ordered AS qty, CASE item_id % 5 WHEN 0 THEN 'CRATE' WHEN 1 THEN 'TON' WHEN 2 THEN 'YD' WHEN 3 THEN 'UNIT' ELSE 'XX' END AS from_uom,
     CASE so_id % 6 WHEN 0 THEN 'PAIR' WHEN 1 THEN 'LB' WHEN 2 THEN 'FT' WHEN 3 THEN 'CRATE' WHEN 4 THEN 'UNIT' ELSE 'PALLET' END AS to_uom FROM {so_lines}"""


@query("convert_uom", "so_line_id:s qty:d from_uom:s to_uom:s converted:d error_code:s",
       f"""WITH x AS ({_UOM_IN}),
           r AS (SELECT from_uom, to_uom, CAST(factor AS DECIMAL(19,10)) AS factor, 0 AS way, '' AS via FROM {{uom_conversions}}
                 UNION ALL SELECT f.from_uom, t.from_uom, {exact_div(huge('f.factor', 8), huge('t.factor', 8), 10)}, 1, f.to_uom FROM {{uom_conversions}} f JOIN {{uom_conversions}} t ON t.to_uom = f.to_uom AND t.from_uom <> f.from_uom
                 UNION ALL SELECT to_uom, from_uom, {exact_div('CAST(100000000 AS HUGEINT)', huge('factor', 8), 10)}, 2, '' FROM {{uom_conversions}}),
           b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY from_uom, to_uom ORDER BY way, via) AS rn FROM r) WHERE rn = 1),
           j AS (SELECT x.*, u.uom_category AS fc, v.uom_category AS tc, v.decimal_digits AS dg, b.factor,
                        CASE WHEN x.from_uom = x.to_uom THEN NULL WHEN u.uom_category IS NULL OR v.uom_category IS NULL THEN 'M1101'
                             WHEN u.uom_category <> v.uom_category THEN 'M1102' WHEN b.factor IS NULL THEN 'M1101' END AS error_code
                   FROM x LEFT JOIN {{uoms}} u ON u.uom_code = x.from_uom LEFT JOIN {{uoms}} v ON v.uom_code = x.to_uom
                   LEFT JOIN b ON b.from_uom = x.from_uom AND b.to_uom = x.to_uom)
           SELECT so_line_id, qty, from_uom, to_uom, error_code,
                  CASE WHEN error_code IS NOT NULL THEN NULL WHEN from_uom = to_uom THEN CAST(qty AS DOUBLE)
                       WHEN dg = 0 THEN CAST(ROUND(CAST(qty AS DECIMAL(12,4)) * factor, 0) AS DOUBLE) WHEN dg = 2 THEN CAST(ROUND(CAST(qty AS DECIMAL(12,4)) * factor, 2) AS DOUBLE)
                       ELSE CAST(ROUND(CAST(qty AS DECIMAL(12,4)) * factor, 3) AS DOUBLE) END AS converted FROM j""")
def _(b):
    src = b.so_lines.select(
        "so_line_id", F.col("qty_ordered").alias("qty"),
        F.expr("CASE item_id % 5 WHEN 0 THEN 'CRATE' WHEN 1 THEN 'TON' WHEN 2 THEN 'YD' WHEN 3 THEN 'UNIT' ELSE 'XX' END").alias("from_uom"),
        F.expr("CASE so_id % 6 WHEN 0 THEN 'PAIR' WHEN 1 THEN 'LB' WHEN 2 THEN 'FT' WHEN 3 THEN 'CRATE' WHEN 4 THEN 'UNIT' ELSE 'PALLET' END").alias("to_uom"))
    good, bad = utility.convert_uom(src, b.uoms, b.uom_conversions)
    return good.unionByName(bad, allowMissingColumns=True)


@query("round_and_format", "event_id:l uom:s rounded:d formatted:s",
       """WITH x AS (SELECT event_id, CAST(CAST(value AS DECIMAL(12,2)) * CAST(37.137 AS DECIMAL(8,3)) AS DECIMAL(20,5)) AS qty,
              CASE event_id % 4 WHEN 0 THEN 'UNIT' WHEN 1 THEN 'TON' WHEN 2 THEN 'YD' ELSE 'ZZ' END AS uom FROM events)
          SELECT event_id, x.uom, CASE u.decimal_digits WHEN 0 THEN ROUND(qty, 0) WHEN 2 THEN ROUND(qty, 2) WHEN 3 THEN ROUND(qty, 3) ELSE ROUND(qty, 4) END AS rounded,
                 CASE u.decimal_digits WHEN 0 THEN format('{:,}', CAST(ROUND(qty, 0) AS BIGINT))
                      WHEN 3 THEN format('{:,}', CAST(FLOOR(ROUND(qty, 3)) AS BIGINT)) || '.' || right(CAST(CAST(ROUND(qty, 3) AS DECIMAL(20,3)) AS VARCHAR), 3)
                      ELSE format('{:,}', CAST(FLOOR(ROUND(qty, 2)) AS BIGINT)) || '.' || right(CAST(CAST(ROUND(qty, 2) AS DECIMAL(20,2)) AS VARCHAR), 2) END || ' ' || x.uom AS formatted
            FROM x LEFT JOIN {uoms} u ON u.uom_code = x.uom""")
def _(b):
    src = b.events.select("event_id", (F.col("value").cast("decimal(12,2)") * F.lit("37.137").cast("decimal(8,3)")).cast("decimal(20,5)").alias("qty"),
                          F.expr("CASE event_id % 4 WHEN 0 THEN 'UNIT' WHEN 1 THEN 'TON' WHEN 2 THEN 'YD' ELSE 'ZZ' END").alias("uom"))
    return utility.round_and_format(src, b.uoms)


@query("typed_params", "param_key:s value_number:d value_date:s value_string:s warning:s",
       """WITH p AS (SELECT 'K' || event_id AS param_key, CASE event_type WHEN 'click' THEN 'NUMBER' WHEN 'view' THEN 'DATE' WHEN 'error' THEN 'NUMBER' ELSE 'STRING' END AS t,
              CASE event_type WHEN 'error' THEN 'x' || user_id WHEN 'view' THEN strftime(ts, '%Y-%m-%d') ELSE CAST(user_id AS VARCHAR) END AS v FROM events)
          SELECT param_key, CASE WHEN t = 'NUMBER' THEN COALESCE(TRY_CAST(v AS DECIMAL(30,6)), 7) END AS value_number,
                 CASE WHEN t = 'DATE' THEN v END AS value_date, CASE WHEN t = 'STRING' THEN v END AS value_string,
                 CASE WHEN t = 'NUMBER' AND TRY_CAST(v AS DECIMAL(30,6)) IS NULL THEN 'Y' ELSE 'N' END AS warning FROM p""")
def _(b):
    src = b.events.select(
        F.concat(F.lit("K"), F.col("event_id").cast("string")).alias("param_key"),
        F.expr("CASE event_type WHEN 'click' THEN 'NUMBER' WHEN 'view' THEN 'DATE' WHEN 'error' THEN 'NUMBER' ELSE 'STRING' END").alias("param_type"),
        F.expr("CASE event_type WHEN 'error' THEN 'x' || user_id WHEN 'view' THEN date_format(ts, 'yyyy-MM-dd') ELSE CAST(user_id AS STRING) END").alias("param_value"))
    return utility.typed_params(src, 7)


@query("business_dates", "sys_code:s curr_biz_date:s last_biz_date:s next_biz_date:s",
       """SELECT event_type AS sys_code, CAST(MAX(CAST(ts AS DATE)) AS VARCHAR) AS curr_biz_date, CAST(MAX(CAST(ts AS DATE)) - 1 AS VARCHAR) AS last_biz_date,
                 CAST(MAX(CAST(ts AS DATE)) + 1 AS VARCHAR) AS next_biz_date FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def _(b):
    day = F.max(F.to_date("ts"))
    table = b.events.groupBy(F.col("event_type").alias("sys_code")).agg(day.alias("curr_biz_date")).withColumns({
        "last_biz_date": F.date_sub("curr_biz_date", 1), "next_biz_date": F.date_add("curr_biz_date", 1)})
    return utility.business_dates(table, "purchase")


@query("validate", "so_line_id:s codes:s",
       """WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)
          SELECT l.so_line_id, NULLIF(concat_ws(',', CASE WHEN l.qty_ordered <= 2 THEN 'M3005' END, CASE WHEN l.discount_pct >= 0.1 THEN 'M6001' END,
                 CASE WHEN i.item_id IS NULL THEN 'M1001' END, CASE WHEN d.l_orderkey IS NOT NULL THEN 'M1004' END), '') AS codes
            FROM (SELECT x.*, CAST(split_part(so_line_id, '-', 2) AS INT) AS ln FROM {so_lines} x) l
            LEFT JOIN {items} i ON i.item_id = l.item_id AND i.status = 'ACTIVE'
            LEFT JOIN d ON d.l_orderkey = l.so_id AND d.l_linenumber = l.ln""")
def _(b):
    lines = b.so_lines.withColumn("ln", F.split("so_line_id", "-")[1].cast("int"))
    active = b.items.filter("status = 'ACTIVE'")
    good, bad = utility.validate(lines, [
        utility.Check("M3005", F.col("qty_ordered") > 2), utility.Check("M6001", F.col("discount_pct") < F.lit("0.1").cast("decimal(8,4)")),
        utility.ForeignKey("M1001", "item_id", active, "item_id"), utility.Unique("M1004", ("so_id", "ln"))])
    return bad.select("so_line_id", F.array_join("error_codes", ",").alias("codes")).unionByName(
        good.select("so_line_id", F.lit(None).cast("string").alias("codes")))


@query("map_error_codes", "event_id:l error_code:s numeric_code:l",
       """SELECT event_id, c AS error_code, CASE c WHEN 'M1001' THEN -20101 WHEN 'M3001' THEN -20301 WHEN 'M4003' THEN -20403 WHEN 'M6002' THEN -20602 ELSE -20999 END AS numeric_code
            FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'M1001' WHEN 'view' THEN 'M3001' WHEN 'error' THEN 'M4003' WHEN 'signup' THEN 'M6002' ELSE 'M0000' END AS c FROM events)""")
def _(b):
    return utility.map_error_codes(b.events.select("event_id", F.expr(
        "CASE event_type WHEN 'click' THEN 'M1001' WHEN 'view' THEN 'M3001' WHEN 'error' THEN 'M4003' WHEN 'signup' THEN 'M6002' ELSE 'M0000' END").alias("error_code")))


@query("sum_money", "o_custkey:l o_orderpriority:s amount:d currency_code:s n:l error_code:s",
       """WITH g AS (SELECT o_custkey, o_orderpriority, SUM(CAST(o_totalprice AS DECIMAL(20,4))) AS amount, MIN(c) AS lo, MAX(c) AS hi, COUNT(*) AS n, COUNT(c) AS named
                       FROM (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS c FROM orders) GROUP BY 1, 2),
               h AS (SELECT *, CASE WHEN named < n THEN 'MISSING_CURRENCY' WHEN lo <> hi THEN 'MIXED_CURRENCY' END AS error_code FROM g)
          SELECT o_custkey, o_orderpriority, CASE WHEN error_code IS NULL THEN amount END AS amount, CASE WHEN error_code IS NULL THEN lo END AS currency_code, n, error_code FROM h""")
def _(b):
    src = b.orders.select("o_custkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(20,4)").alias("amount"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("currency_code"))
    good, bad = utility.sum_money(src, ["o_custkey", "o_orderpriority"])
    return good.unionByName(bad, allowMissingColumns=True)


@query("audit_diff", "biz_key:s action_type:s old_value:s new_value:s",
       """WITH o AS (SELECT p_partkey, '{"name":"' || p_name || '","size":"' || p_size || '"}' AS j FROM part WHERE p_brand <> 'Brand#1'),
          n AS (SELECT p_partkey, '{"name":"' || p_name || '","size":"' || LEAST(p_size, 40) || '"}' AS j FROM part WHERE p_brand <> 'Brand#2')
          SELECT CAST(COALESCE(o.p_partkey, n.p_partkey) AS VARCHAR) AS biz_key, CASE WHEN o.j IS NULL THEN 'INSERT' WHEN n.j IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action_type,
                 o.j AS old_value, n.j AS new_value FROM o FULL JOIN n ON n.p_partkey = o.p_partkey WHERE o.j IS DISTINCT FROM n.j""")
def _(b):
    snap = lambda size: b.part.select("p_partkey", F.col("p_name").alias("name"), size.alias("size"), "p_brand")
    old = snap(F.col("p_size")).filter("p_brand <> 'Brand#1'").drop("p_brand")
    new = snap(F.least("p_size", F.lit(40))).filter("p_brand <> 'Brand#2'").drop("p_brand")
    return utility.audit_diff(old, new, ["p_partkey"], "part")
