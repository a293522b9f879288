"""A bicycle workshop: two products, a shared wheel, a phantom hub and a second version."""

from pyspark.sql import functions as F

#: id: (code, type, std_cost, list_price, category, lead days, phantom)
ITEMS = {
    1: ("BIKE", "FG", "0", "640", "city", 4, "N"), 2: ("TRIKE", "FG", "0", "870", "cargo", 6, "N"),
    3: ("WHEEL", "SEMI", "0", "0", "part", 3, "N"), 4: ("HUBSET", "SEMI", "0", "0", "part", 1, "Y"), 5: ("SADDLE", "SEMI", "0", "0", "part", 2, "N"),
    11: ("RIM", "RAW", "21.4", "0", "metal", 9, "N"), 12: ("SPOKE", "RAW", "0.17", "0", "metal", 5, "N"), 13: ("AXLE", "RAW", "6.25", "0", "metal", 12, "N"),
    14: ("GREASE", "RAW", "31", "0", "fluid", 8, "N"), 15: ("LEATHER", "RAW", "44.9", "0", "skin", 15, "N"),
}
#: bom: (item, version, status, default, [(component, qty, scrap, phantom)])
BOMS = {
    71: (1, "A", "ACTIVE", "Y", [(3, "2", "0", "N"), (4, "1", "0", "Y"), (5, "1", "0", "N")]),
    72: (2, "A", "ACTIVE", "Y", [(3, "3", "0", "N"), (5, "2", "0", "N"), (13, "4", "0.04", "N")]),
    73: (3, "A", "ACTIVE", "Y", [(11, "1", "0.02", "N"), (12, "32", "0.05", "N"), (13, "1", "0", "N")]),
    74: (4, "A", "ACTIVE", "Y", [(13, "2", "0", "N"), (14, "0.01", "0.1", "N")]),
    75: (5, "A", "ACTIVE", "Y", [(15, "0.3", "0.08", "N"), (14, "0.02", "0", "N")]),
    76: (1, "B", "DRAFT", "N", [(3, "2", "0", "N"), (4, "1", "0", "Y"), (5, "3", "0", "N")]),
}
#: lot: (item, warehouse, quantity, unit cost, received)
LOTS = {
    501: (13, 1, 40, "6", "2025-02-01"), 502: (13, 1, 25, "6.6", "2025-03-05"), 503: (11, 1, 90, "21", "2025-01-20"), 504: (12, 1, 4000, "0.16", "2025-01-22"),
    505: (14, 1, 3, "31", "2025-02-11"), 506: (15, 1, 12, "45", "2025-02-15"), 507: (1, 2, 7, "210", "2025-04-01"), 508: (5, 1, 20, "15", "2025-04-02"),
}
AS_OF = "2025-06-10"


def cast(df, **kinds):
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def items(spark, extra=()):
    rows = [(k, *v) for k, v in [*ITEMS.items(), *extra]]
    df = spark.createDataFrame(rows, "item_id long, item_code string, item_type string, std_cost string, list_price string, category_id string, lead_time_days int, is_phantom string")
    return cast(df, std_cost="decimal(20,6)", list_price="decimal(20,4)").withColumns({
        "item_name": F.lower("item_code"), "status": F.lit("ACTIVE"), "base_uom": F.lit("UNIT"), "abc_class": F.lit(None).cast("string"),
        "valuation_method": F.when(F.col("item_type") == "RAW", "FIFO").otherwise("STD"), "preferred_supplier": F.when(F.col("item_type") == "RAW", 1)})


def headers(spark, extra=()):
    rows = [(b, v[0], v[1], v[2], v[3]) for b, v in [*BOMS.items(), *extra]]
    df = spark.createDataFrame(rows, "bom_id long, item_id long, bom_version string, status string, is_default string")
    return df.withColumns({"effective_from": F.lit("2024-03-01").cast("date"), "effective_to": F.lit(None).cast("date"), "base_qty": F.lit(1).cast("decimal(18,6)")})


def lines(spark, extra=()):
    rows = [(b * 10 + i, b, i + 1, *line) for b, v in [*BOMS.items(), *extra] for i, line in enumerate(v[4])]
    df = spark.createDataFrame(rows, "line_id long, bom_id long, line_no int, component_item_id long, qty_per string, scrap_rate string, is_phantom string")
    return cast(df, qty_per="decimal(18,6)", scrap_rate="decimal(8,4)").withColumn("uom", F.lit("UNIT"))


def lots(spark):
    df = spark.createDataFrame([(k, *v) for k, v in LOTS.items()], "lot_id long, item_id long, warehouse_id int, qty_on_hand int, unit_cost string, receipt_date string")
    return cast(df, qty_on_hand="decimal(18,4)", unit_cost="decimal(20,6)", receipt_date="date").withColumns({
        "lot_no": F.concat(F.lit("L"), F.col("lot_id").cast("string")), "qty_allocated": F.lit(0).cast("decimal(18,4)"), "status": F.lit("AVAILABLE")})


def balances(spark):
    value = F.sum(F.col("qty_on_hand") * F.col("unit_cost")) / F.sum("qty_on_hand")
    held = lots(spark).groupBy("item_id", "warehouse_id").agg(F.sum("qty_on_hand").cast("decimal(18,4)").alias("qty_on_hand"), value.cast("decimal(20,6)").alias("avg_cost"))
    return held.withColumns({"qty_allocated": F.lit(0).cast("decimal(18,4)"), "last_txn_date": F.lit(None).cast("date"), "version": F.lit(0)})


def history(spark):
    """Monthly demand of the two products in 2024."""
    rows = [(item, 2, f"2024-{m:02d}-01", q) for item, start in ((1, 30), (2, 9)) for m, q in enumerate((start + (5 * k) % 7 + k for k in range(12)), 1)]
    df = spark.createDataFrame(rows, "item_id long, warehouse_id int, period_date string, q int")
    return df.select("item_id", "warehouse_id", F.col("period_date").cast("date"), F.col("q").cast("decimal(18,4)").alias("forecast_qty"),
                     F.col("q").cast("decimal(18,4)").alias("actual_qty"), F.lit("MA3").alias("method"))
