"""Purchasing: order states, receipts, MRP conversion, reorder, suppliers, carts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import doc_no
from millrace.operators.common import first_failed, safe_ratio, split_by_rules
from millrace.operators.fold import ordered_fold
from millrace.operators.inventory import receive_stock, scaled
from millrace.operators.ordered import is_hot, peer_sums, row_numbers
from millrace.session import hot_group_rows, materialize, materialize_counted

AMOUNT = "decimal(20,4)"
QTY = "decimal(18,4)"


def po_header_status(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Header state projected from the live lines; CANCELLED/CLOSED untouched."""
    live = lines.filter(F.col("line_status") != "CANCELLED").groupBy("po_id").agg(
        F.count_if(F.col("line_status").isin("OPEN", "PARTIAL")).alias("__open"),
        F.count_if(F.col("qty_received") > 0).alias("__received"))
    state = (
        F.when(F.col("status").isin("CANCELLED", "CLOSED"), F.col("status"))
        .when((F.col("__open") > 0) & (F.col("__received") > 0), "PARTIAL")
        .when(F.col("__open") > 0, "APPROVED").otherwise("RECEIVED"))
    return orders.join(live, "po_id", "left").withColumn("status", state).drop("__open", "__received")


# Outcomes of one receipt against its line.
_TAKEN, _CLOSED, _OVER, _NO_LINE = 0, 1, 2, 3


def _receive_step(state, row):
    (received,), (qty, ordered, allowed) = state, row
    if not allowed:
        return state, (_NO_LINE,)
    if received >= ordered:
        return state, (_CLOSED,)
    if received + qty > ordered:
        return state, (_OVER,)
    return (received + qty,), (_TAKEN,)


def _repeats(df: DataFrame, key: str) -> DataFrame | None:
    """Keys met more than once, with their count in ``__n``; None without any. Only hashes are shuffled to find them."""
    keyed = df.select(key).filter(F.col(key).isNotNull())
    mark = F.xxhash64(key)
    some, n = materialize_counted(keyed.groupBy(mark.alias("__h")).count().filter("count > 1").select("__h"), "repeats")
    if not n:
        return None
    return materialize(keyed.join(some, mark == F.col("__h"), "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "repeats")


def _as_met(df: DataFrame, key: str, repeats: DataFrame | None) -> DataFrame:
    """``df`` as a left join with the frame of :func:`_repeats` would leave it: a row for each row of its key."""
    if repeats is None:
        return df
    times = F.coalesce("__n", F.lit(1)).cast("int")
    return df.join(repeats, key, "left").withColumn("__n", F.explode(F.array_repeat(F.lit(1), times))).drop("__n")


def receive_po_lines(orders: DataFrame, lines: DataFrame, receipts: DataFrame, balances: DataFrame, as_of, post_stock: bool = True) -> dict[str, DataFrame]:
    """Post receipts in ``receipt_id`` order against order lines.

    A refused receipt leaves the line as it was, so over-receipt is decided by an
    ordered fold per line. The rules are checked one after the other, and a receipt that
    fails one is not joined further; should orders or lines repeat an id, it is refused once
    for each row it would have met. Returns the new ``lines`` and ``orders``, the
    ``rejects``, and (unless ``post_stock`` is off) the stock posting of the
    accepted rows.
    """
    more_orders, more_lines = _repeats(orders, "po_id"), _repeats(lines, "po_line_id")
    given = receipts.select("receipt_id", "po_line_id", "po_id", "qty", "unit_cost")
    asked, bad_qty = split_by_rules(given, [("M4002", F.col("qty") > 0, "received quantity must be positive")])
    known = asked.join(orders.select("po_id", "status", "warehouse_id", F.lit(True).alias("__po")), "po_id", "left")
    code, _ = first_failed([
        ("M4001", F.col("__po"), "order not found"),
        ("M4002", F.col("status").isin("APPROVED", "PARTIAL"), "order state does not allow receipts"),
        ("M4001", F.col("po_line_id").isNotNull(), "order line not found")])
    # good and refused rows in one pass; of the refused ones no more than is needed
    known = materialize(known.select("receipt_id", "po_line_id", code.alias("error_code"), *[
        F.when(code.isNull(), F.col(c)).alias(c) for c in ("po_id", "qty", "unit_cost", "warehouse_id")]), "receipts-of-orders")
    good, bad_order = known.filter(F.col("error_code").isNull()).drop("error_code"), known.filter(F.col("error_code").isNotNull())
    # the fold by line finds the rows where this join left them
    rows = good.join(
        lines.select("po_line_id", "item_id", "unit_price", "qty_ordered", "qty_received", "line_status", F.lit(1).alias("__line")), "po_line_id", "left")
    live = F.coalesce(~F.col("line_status").isin("CLOSED", "CANCELLED"), F.lit(False))
    rows = rows.withColumns({
        "__q": scaled(F.col("qty"), 4), "__o": scaled(F.col("qty_ordered"), 4), "__r": scaled(F.col("qty_received"), 4),
        "__ok": (F.col("__line").isNotNull() & live).cast("bigint")})
    carried = ["receipt_id", "po_id", "qty", "unit_cost", "unit_price", "item_id", "warehouse_id", "__line"]
    folded = ordered_fold(rows, ["po_line_id"], [F.col("receipt_id")], ["__q", "__o", "__ok"], ["__r"], _receive_step,
                          [("__outcome", "bigint")], carried, additive=[True], hot=is_hot(good, ["po_line_id"]))
    folded = materialize(folded, "receipts")
    taken = folded.filter(F.col("__outcome") == _TAKEN)
    refused = folded.filter(F.col("__outcome") != _TAKEN).select(
        "receipt_id", F.when(F.col("__outcome") == _OVER, "M4003").when(F.col("__line").isNull(), "M4001").otherwise("M4002").alias("error_code"))
    bad = _as_met(bad_qty.select("receipt_id", "po_id", "po_line_id", "error_code"), "po_id", more_orders).drop("po_id").unionByName(
        bad_order.select("receipt_id", "po_line_id", "error_code"))
    bad = _as_met(bad, "po_line_id", more_lines)
    rejects = bad.select("receipt_id", "error_code").unionByName(refused)
    got = taken.groupBy("po_line_id").agg(F.sum("qty").cast(QTY).alias("__got"))
    total = (F.col("qty_received") + F.col("__got")).cast(QTY)
    hit = F.col("__got").isNotNull()
    new_lines = lines.join(got, "po_line_id", "left").withColumns({
        "qty_received": F.when(hit, total).otherwise(F.col("qty_received")),
        "line_status": F.when(hit & (total >= F.col("qty_ordered")), "CLOSED").when(hit, "PARTIAL").otherwise(F.col("line_status")),
    }).drop("__got")
    touched = taken.select("po_id").distinct()
    refreshed = po_header_status(orders.join(touched, "po_id", "left_semi"), new_lines.join(touched, "po_id", "left_semi"))
    new_orders = orders.join(touched, "po_id", "left_anti").unionByName(refreshed)
    stock_in = taken.select("receipt_id", "item_id", "warehouse_id", "qty", F.coalesce("unit_cost", "unit_price").alias("unit_cost"),
                            F.lit(None).cast("string").alias("lot_no"))
    out = {"lines": new_lines, "orders": new_orders, "rejects": rejects}
    if post_stock:
        out["stock"] = receive_stock(stock_in, balances, ["receipt_id"], as_of)
    return out


def load_purchase_orders(headers: DataFrame, lines: DataFrame, suppliers: DataFrame, items: DataFrame, as_of) -> dict[str, DataFrame]:
    """New draft orders with numbered lines and totals; bad headers/lines rejected.

    ``headers``: ref, supplier_id, warehouse_id, expected_date. ``lines``: ref,
    line_ref (unique, gives the order), item_id, qty, unit_price, uom, need_date.
    """
    known = headers.join(suppliers.select("supplier_id", F.col("status").alias("__sup")), "supplier_id", "left")
    good_heads, bad_heads = split_by_rules(known, [
        ("M4001", F.col("__sup").isNotNull(), "supplier not found"),
        ("M4004", F.col("__sup") != "BLOCKED", "supplier blocked")])
    full = lines.join(items.select("item_id", "base_uom"), "item_id", "left").join(
        good_heads.select("ref", F.lit(True).alias("__head")), "ref", "left")
    good, bad = split_by_rules(full, [
        ("M4002", F.col("qty") > 0, "quantity must be positive"),
        ("M4001", F.col("__head"), "order not created"),
        ("M1001", F.col("base_uom").isNotNull(), "item not found")])
    numbered = row_numbers(good, ["ref"], [F.col("line_ref")], "__n").select(
        "ref", "line_ref", (F.col("__n") * 10).alias("line_no"), "item_id", F.col("qty").alias("qty_ordered"),
        F.lit(0).cast(QTY).alias("qty_received"), "unit_price", F.coalesce("uom", "base_uom").alias("uom"), "need_date",
        F.lit("OPEN").alias("line_status"))
    totals = numbered.groupBy("ref").agg(F.sum(F.round(F.col("qty_ordered") * F.col("unit_price"), 4).cast(AMOUNT)).cast(AMOUNT).alias("__t"))
    day = F.lit(as_of).cast("date")
    orders = row_numbers(good_heads, [], [F.col("ref")], "po_id").join(totals, "ref", "left").select(
        "ref", "po_id", doc_no("PO", day, F.col("po_id")).alias("po_no"), "supplier_id", "warehouse_id", day.alias("order_date"),
        "expected_date", F.lit("DRAFT").alias("status"), F.coalesce("__t", F.lit(0)).cast(AMOUNT).alias("total_amount"))
    rejects = bad_heads.select("ref", F.lit(None).cast("string").alias("line_ref"), "error_code").unionByName(
        bad.select("ref", F.col("line_ref").cast("string").alias("line_ref"), "error_code"))
    return {"orders": orders, "lines": numbered, "rejects": rejects}


def po_transitions(orders: DataFrame, lines: DataFrame, suppliers: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Approve and cancel requests (po_id, action; one per order). Repeats are no-ops."""
    facts = lines.groupBy("po_id").agg(
        F.count_if(F.col("line_status") != "CANCELLED").alias("__live"), F.count_if(F.col("qty_received") > 0).alias("__received"))
    full = (
        requests.join(orders.select("po_id", "status", "supplier_id"), "po_id", "left").join(facts, "po_id", "left")
        .join(suppliers.select("supplier_id", F.col("status").alias("__sup")), "supplier_id", "left"))
    approve, status = F.col("action") == "APPROVE", F.col("status")
    zero = F.lit(0)
    code = (
        F.when(status.isNull(), "M4001")
        .when(approve & (status == "APPROVED"), None)
        .when(approve & (status != "DRAFT"), "M4002")
        .when(approve & (F.coalesce("__live", zero) == 0), "M4002")
        .when(approve & (F.col("__sup") == "BLOCKED"), "M4004")
        .when(approve, None)
        .when(status == "CANCELLED", None)
        .when(status.isin("RECEIVED", "CLOSED"), "M4002")
        .when(F.coalesce("__received", zero) > 0, "M4002"))
    judged = full.withColumns({
        "error_code": code, "new_status": F.when(code.isNull(), F.when(approve, "APPROVED").otherwise("CANCELLED"))})
    done = judged.filter("error_code IS NULL").select("po_id", "new_status")
    new_orders = orders.join(done, "po_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    gone = done.filter("new_status = 'CANCELLED'").select("po_id", F.lit(True).alias("__gone"))
    new_lines = lines.join(gone, "po_id", "left").withColumn(
        "line_status", F.when(F.col("__gone"), "CANCELLED").otherwise(F.col("line_status"))).drop("__gone")
    return {"orders": new_orders, "lines": new_lines, "rejects": judged.filter("error_code IS NOT NULL").select("po_id", "action", "error_code")}


def po_from_mrp(plans: DataFrame, items: DataFrame, suppliers: DataFrame, as_of, start_po: int = 0) -> dict[str, DataFrame]:
    """One draft order per preferred supplier for planned raw-material quantities."""
    wanted = plans.filter(F.col("planned_order_qty") > 0).join(
        items.filter((F.col("item_type") == "RAW") & F.col("preferred_supplier").isNotNull()).select(
            "item_id", F.col("preferred_supplier").alias("supplier_id"), "base_uom", F.coalesce("std_cost", F.lit(0)).alias("unit_price")),
        "item_id").join(suppliers.select("supplier_id", F.col("status").alias("__sup")), "supplier_id", "left")
    good, bad = split_by_rules(wanted, [
        ("M4001", F.col("__sup").isNotNull(), "supplier not found"), ("M4004", F.col("__sup") != "BLOCKED", "supplier blocked")])
    lines = row_numbers(good, ["supplier_id"], [F.col("item_id"), F.col("level_no")], "__n").select(
        "supplier_id", (F.col("__n") * 10).alias("line_no"), "item_id", F.col("planned_order_qty").alias("qty_ordered"),
        F.lit(0).cast(QTY).alias("qty_received"), "unit_price", F.col("base_uom").alias("uom"),
        F.col("planned_order_date").alias("need_date"), F.lit("OPEN").alias("line_status"), "warehouse_id")
    heads = lines.groupBy("supplier_id").agg(
        F.min_by(F.struct("warehouse_id", "need_date"), F.col("line_no")).alias("__first"),
        F.sum(F.round(F.col("qty_ordered") * F.col("unit_price"), 4).cast(AMOUNT)).cast(AMOUNT).alias("total_amount"),
        F.count(F.lit(1)).alias("line_count"))
    day = F.lit(as_of).cast("date")
    orders = row_numbers(heads, [], [F.col("supplier_id")], "__n").select(
        (F.col("__n") + start_po).alias("po_id"), doc_no("PO", day, F.col("__n") + start_po).alias("po_no"), "supplier_id",
        day.alias("order_date"), F.col("__first.need_date").alias("expected_date"), F.lit("DRAFT").alias("status"), "total_amount",
        F.col("__first.warehouse_id").alias("warehouse_id"), "line_count")
    numbered = lines.drop("warehouse_id").join(orders.select("supplier_id", "po_id"), "supplier_id")
    return {"orders": orders, "lines": numbered, "rejects": bad.select("item_id", "supplier_id", "error_code")}


def reorder_scan(balances: DataFrame, items: DataFrame, warehouse_id: int | None = None) -> DataFrame:
    """Items below their reorder point with the quantity to order."""
    held = balances if warehouse_id is None else balances.filter(F.col("warehouse_id") == warehouse_id)
    watched = items.filter((F.col("status") == "ACTIVE") & (F.col("reorder_point") > 0)).select(
        "item_id", "item_code", "reorder_point", "reorder_qty", "safety_stock")
    avail = F.col("qty_on_hand") - F.col("qty_allocated")
    low = held.join(watched, "item_id").filter(avail < F.col("reorder_point"))
    return low.select(
        "item_id", "item_code", "warehouse_id", avail.alias("available"), "reorder_point",
        F.greatest(F.col("reorder_qty"), F.col("reorder_point") + F.col("safety_stock") - avail).alias("suggest_qty"))


def supplier_ranking(suppliers: DataFrame, orders: DataFrame, lines: DataFrame, start, end) -> DataFrame:
    """Received amount, orders and on-time rate per supplier, with both rankings."""
    on_time = F.col("status").isin("RECEIVED", "CLOSED") & (
        F.col("expected_date").isNull() | (F.col("expected_date") >= F.col("order_date")))
    window = orders.filter(
        F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("status") != "CANCELLED"))
    received = lines.groupBy("po_id").agg(
        F.sum((F.col("qty_received") * F.col("unit_price")).cast("decimal(30,10)")).alias("__amount"))
    per = window.join(received, "po_id").groupBy("supplier_id").agg(
        F.sum("__amount").alias("__total"), F.count(F.lit(1)).alias("__n"), F.count_if(on_time).alias("__ok"))
    zero = F.lit(0)
    rate = F.when(F.col("po_count") > 0, F.round(F.col("on_time_count").cast("decimal(18,0)") / F.nullif(F.col("po_count"), zero).cast("decimal(18,0)"), 4))
    agg = suppliers.select("supplier_id", "supplier_name", "rating").join(per, "supplier_id", "left").select(
        "supplier_id", "supplier_name", "rating", F.coalesce("__total", zero).cast("decimal(28,6)").alias("total_amount"),
        F.coalesce("__n", zero).alias("po_count"), F.coalesce("__ok", zero).alias("on_time_count"))
    agg = agg.withColumn("on_time_rate", F.coalesce(rate, zero).cast("decimal(8,4)"))
    agg, count = materialize_counted(agg, "suppliers")
    hot = count > hot_group_rows(orders.sparkSession)
    total = agg.agg(F.sum("total_amount")).scalar().cast("decimal(28,4)")
    ranked = peer_sums(agg, [], "total_amount", {}, descending=True, rank="amount_rank", hot=hot)
    ranked = peer_sums(ranked, [], "on_time_rate", {}, descending=True, dense_rank="on_time_rank", hot=hot)
    share = F.round(safe_ratio(F.col("total_amount").cast("decimal(24,4)") * 100, total), 2)
    return ranked.withColumn("amount_share_pct", share.cast("decimal(8,2)"))


def checkout_carts(carts: DataFrame, products: DataFrame, stock: DataFrame, coupons: DataFrame, now) -> dict[str, DataFrame]:
    """Check out whole carts: result code, total after discount, stock moved to locked.

    ``carts``: customer_id, coupon_code, product_id, quantity, is_deleted. Codes:
    0 ok, 1001 coupon invalid, 1002 a line is short, 1003 empty cart. Each line is
    compared with the stock as it stood before the batch.
    """
    live = F.col("is_deleted") == 0
    valid = coupons.filter((F.col("status") == "ACTIVE") & (F.col("expire_time") > F.lit(now).cast("timestamp_ntz"))).groupBy("code").agg(
        F.max("discount_rate").alias("__rate"))
    lines = carts.filter(live).join(products.select("product_id", "price"), "product_id").join(
        stock.select("product_id", "available_qty"), "product_id", "left")
    worth = F.col("quantity") * F.col("price")
    per = lines.groupBy("customer_id").agg(
        F.sum(worth.cast("decimal(20,4)")).cast("decimal(26,4)").alias("subtotal"), F.count(F.lit(1)).alias("line_count"),
        F.bool_and(F.coalesce(F.col("available_qty") >= F.col("quantity"), F.lit(False))).alias("__enough"))
    heads = carts.groupBy("customer_id").agg(F.min("coupon_code").alias("coupon_code"))
    full = heads.join(per, "customer_id", "left").join(valid, F.col("coupon_code") == F.col("code"), "left").drop("code")
    code = (F.when(F.col("__rate").isNull(), 1001).when(F.col("line_count").isNull(), 1003)
            .when(~F.col("__enough"), 1002).otherwise(0))
    rest = F.lit(100).cast("decimal(5,2)") - F.col("__rate").cast("decimal(4,2)")
    total = F.round(F.col("subtotal") * rest / F.lit(100).cast("decimal(3,0)"), 2).cast("decimal(24,2)")
    result = full.select("customer_id", "coupon_code", F.coalesce("line_count", F.lit(0)).alias("line_count"), "subtotal",
                         F.col("__rate").alias("discount_rate"), code.alias("result_code"), F.when(code == 0, total).alias("total_amount"))
    sold = lines.join(result.filter("result_code = 0").select("customer_id"), "customer_id", "left_semi").groupBy("product_id").agg(
        F.sum("quantity").alias("__sold"))
    moved = F.coalesce("__sold", F.lit(0))
    new_stock = stock.join(sold, "product_id", "left").withColumns({
        "available_qty": F.col("available_qty") - moved, "locked_qty": F.col("locked_qty") + moved}).drop("__sold")
    return {"orders": result, "stock": new_stock}


def _transfer_step(state, row):
    (balance,), (amount, minimum) = state, row
    if balance - amount < minimum:
        return state, (1,)
    return (balance - amount,), (0,)


def screen_transfers(accounts: DataFrame, transfers: DataFrame, minimum: str = "0") -> DataFrame:
    """Outcome of transfers in ``transfer_id`` order against the source balance.

    OK, INSUFFICIENT when the balance would fall below the minimum, NOT_FOUND
    when the account is missing. Refused transfers leave the balance as it is.
    """
    full = transfers.join(accounts.select("account_id", "balance"), transfers["source_id"] == F.col("account_id"), "left")
    known = full.filter(F.col("account_id").isNotNull()).withColumns({
        "__a": scaled(F.col("amount"), 2), "__m": scaled(F.lit(minimum).cast("decimal(18,2)"), 2), "__b": scaled(F.col("balance"), 2)})
    folded = ordered_fold(known, ["source_id"], [F.col("transfer_id")], ["__a", "__m"], ["__b"], _transfer_step,
                          [("__no", "bigint")], ["transfer_id", "amount"], additive=[True], hot=is_hot(transfers, ["source_id"]))
    ok = folded.select("transfer_id", "source_id", "amount", F.when(F.col("__no") == 0, "OK").otherwise("INSUFFICIENT").alias("outcome"))
    lost = full.filter(F.col("account_id").isNull()).select("transfer_id", "source_id", "amount", F.lit("NOT_FOUND").alias("outcome"))
    return ok.unionByName(lost)
