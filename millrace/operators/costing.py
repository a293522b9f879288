"""Costing: FIFO layers, inventory value, average cost, landed cost, cost roll."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.bom import rolled_cost
from millrace.operators.common import next_snapshot, safe_ratio, with_totals
from millrace.operators.ordered import running_sums

KEY = ["item_id", "warehouse_id"]


def fifo_layers(lots: DataFrame, balances: DataFrame) -> DataFrame:
    """FIFO layers of every item and warehouse with running quantity and amount."""
    avail = (F.col("qty_on_hand") - F.col("qty_allocated")).cast("decimal(18,4)")
    layer = (
        lots.filter((F.col("status") == "AVAILABLE") & (avail > 0))
        .select(*KEY, "lot_id", "lot_no", "receipt_date", avail.alias("avail_qty"), "unit_cost")
        .withColumn("layer_amount", F.round(F.col("avail_qty") * F.col("unit_cost"), 4).cast("decimal(20,4)"))
    )
    run = running_sums(layer, KEY, [F.col("receipt_date"), F.col("lot_id")], {
        "layer_no": F.lit(1).cast("long"), "cum_qty": F.col("avail_qty"), "cum_amount": F.col("layer_amount"),
    })
    need = balances.select(*KEY, F.coalesce(F.col("qty_on_hand") - F.col("qty_allocated"), F.lit(0)).alias("__need"))
    covering = F.when(F.col("cum_qty") >= F.col("__need"), "Y").otherwise("N")
    return run.join(need, KEY, "left").withColumn("is_covering", covering).drop("__need")


def inventory_value(balances: DataFrame, items: DataFrame, warehouses: DataFrame, warehouse_id: int | None = None) -> DataFrame:
    """Stock value by the item's valuation method, warehouse total and share."""
    held = balances.filter(F.col("qty_on_hand") > 0)
    if warehouse_id is not None:
        held = held.filter(F.col("warehouse_id") == warehouse_id)
    unit = F.when(F.col("valuation_method") == "STD", F.col("std_cost")).otherwise(F.col("avg_cost"))
    valued = (
        held.join(items.select("item_id", "item_code", "item_name", "valuation_method", "std_cost"), "item_id")
        .join(warehouses.select("warehouse_id", "warehouse_code"), "warehouse_id")
        .withColumn("val_unit_cost", unit.cast("decimal(20,6)"))
        .withColumn("__raw", (F.col("qty_on_hand") * F.col("val_unit_cost")).cast("decimal(30,10)"))
        .withColumn("stock_value", F.round("__raw", 4).cast("decimal(24,4)"))
    )
    full = with_totals(valued, ["warehouse_id"], {"wh_total_value": F.col("stock_value"), "__whole": F.col("__raw")})
    ratio = F.round(safe_ratio(F.col("__raw").cast("decimal(22,6)"), F.col("__whole").cast("decimal(22,6)")), 6)
    return full.select(
        "warehouse_id", "warehouse_code", "item_id", "item_code", "item_name", "valuation_method", "qty_on_hand",
        "val_unit_cost", "stock_value", "wh_total_value", ratio.cast("decimal(10,6)").alias("value_ratio"))


def _lot_average(lots: DataFrame, states: list[str]) -> DataFrame:
    live = lots.filter(F.col("status").isin(states))
    worth = (F.col("qty_on_hand") * F.col("unit_cost")).cast("decimal(30,10)")
    agg = live.groupBy(*KEY).agg(
        F.sum("qty_on_hand").alias("qty"), F.sum("qty_allocated").alias("alloc"), F.sum(worth).alias("worth"))
    avg = F.round(F.col("worth").cast("decimal(28,10)") / F.nullif(F.col("qty").cast("decimal(18,4)"), F.lit(0)), 6)
    return agg.withColumn("avg", F.when(F.col("qty") > 0, avg).otherwise(0).cast("decimal(20,6)"))


def recompute_avg_cost(lots: DataFrame, balances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quantity-weighted cost of AVAILABLE lots written to the balances.

    Balances without such lots get zero; lots without a balance row are rejects.
    """
    avg = _lot_average(lots, ["AVAILABLE"]).select(*KEY, F.col("avg").alias("__avg"))
    updated = balances.join(avg, KEY, "left").withColumns({
        "avg_cost": F.coalesce("__avg", F.lit(0)).cast("decimal(20,6)"),
        "version": F.col("version") + 1,
    }).drop("__avg")
    missing = avg.join(balances.select(*KEY), KEY, "left_anti").select(
        *KEY, F.lit("M3004").alias("error_code"), F.lit("no balance row to update").alias("error_msg"))
    return updated, missing


def sync_balance(lots: DataFrame, balances: DataFrame, as_of) -> DataFrame:
    """Balances rebuilt from AVAILABLE and QUARANTINE lots."""
    agg = _lot_average(lots, ["AVAILABLE", "QUARANTINE"])
    keys = balances.select(*KEY).unionByName(lots.select(*KEY)).distinct()
    zero = F.lit(0)
    state = keys.join(agg, KEY, "left").join(
        balances.select(*KEY, F.col("version").alias("__v")), KEY, "left"
    ).select(
        *KEY, F.coalesce("qty", zero).cast("decimal(18,4)").alias("qty_on_hand"),
        F.coalesce("alloc", zero).cast("decimal(18,4)").alias("qty_allocated"),
        F.coalesce("avg", zero).cast("decimal(20,6)").alias("avg_cost"),
        F.lit(as_of).cast("date").alias("last_txn_date"),
        F.coalesce(F.col("__v") + 1, zero).cast("int").alias("version"))
    return state


def landed_cost(po_lines: DataFrame, items: DataFrame, freight: str, duty: str, basis: str = "AMT") -> DataFrame:
    """Freight and duty of every purchase order spread over its lines."""
    if basis not in ("AMT", "WGT"):
        raise ValueError("basis must be AMT or WGT")
    weight = items.select("item_id", "item_code", F.coalesce(F.col("dim.weight_kg"), F.lit(0)).cast("decimal(10,3)").alias("__kg"))
    line = po_lines.join(weight, "item_id").withColumns({
        "line_amount": F.round(F.col("qty_ordered") * F.col("unit_price"), 4).cast("decimal(20,4)"),
        "line_weight": F.round(F.col("qty_ordered") * F.col("__kg"), 4).cast("decimal(20,4)"),
    }).withColumn("__base", F.col("line_amount" if basis == "AMT" else "line_weight").cast("decimal(14,4)"))
    full = with_totals(line, ["po_id"], {"__sum": F.col("__base")})

    def share(charge: str):
        part = F.lit(charge).cast("decimal(10,2)") * F.col("__base") / F.nullif(F.col("__sum").cast("decimal(16,4)"), F.lit(0))
        return F.coalesce(F.round(part, 4), F.lit(0)).cast("decimal(20,4)")

    full = full.withColumns({"freight_alloc": share(freight), "duty_alloc": share(duty)})
    total = (F.col("line_amount") + F.col("freight_alloc") + F.col("duty_alloc")).cast("decimal(20,4)")
    unit = F.round(safe_ratio(total, F.col("qty_ordered").cast("decimal(16,4)")), 6)
    return full.select(
        "po_id", "po_line_id", "item_id", "item_code", "qty_ordered", "unit_price", "line_amount", "line_weight",
        "freight_alloc", "duty_alloc", total.alias("landed_total"), unit.cast("decimal(20,6)").alias("landed_unit_cost"))


def roll_standard_cost(items: DataFrame, headers: DataFrame, lines: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Rolled cost of ACTIVE FG/SEMI items written to std_cost; failures returned apart."""
    cost, failed = rolled_cost(headers, lines, items, as_of)
    target = items.filter(F.col("item_type").isin("FG", "SEMI") & (F.col("status") == "ACTIVE")).select("item_id")
    changes = cost.join(target, "item_id").select("item_id", F.round("rolled_cost", 6).cast("decimal(20,6)").alias("std_cost"))
    return next_snapshot(items, changes, ["item_id"], insert=False), failed.join(target, "item_id")
