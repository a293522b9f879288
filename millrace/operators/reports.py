"""Stock and sales reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import abc_class
from millrace.operators.common import best_per_key, safe_ratio, with_totals
from millrace.operators.ordered import ntile, peer_sums, row_numbers
from millrace.session import hot_group_rows, materialize_counted

# Sales lines whose orders one task of a sales summary expands into its grouping sets.
SALES_LINES_IN_TASK = 500_000


def inventory_by_warehouse(balances: DataFrame, items: DataFrame) -> DataFrame:
    """Quantity per item in the three fixed warehouses, and the total."""
    held = balances.filter(F.col("qty_on_hand") > 0)
    zero = F.lit(0).cast("decimal(28,4)")
    wide = held.groupBy("item_id").pivot("warehouse_id", [1, 2, 3]).agg(F.sum("qty_on_hand"))
    cell = lambda n: F.coalesce(F.col(str(n)), zero)
    return wide.join(items.select("item_id", "item_code", "item_name"), "item_id").select(
        "item_id", "item_code", "item_name",
        cell(1).alias("qty_wh_raw"), cell(2).alias("qty_wh_fg"), cell(3).alias("qty_wh_wip"),
        (cell(1) + cell(2) + cell(3)).alias("qty_total"),
    )


def sales_summary(so_lines, orders, items, categories, customers, start, end,
                  mode: str = "ROLLUP", names: str = "grouped") -> DataFrame:
    """Category x customer subtotals of ordered, shipped and net amounts.

    ``names="grouped"`` keeps both names as grouping columns outside the
    ROLLUP/CUBE; ``names="attributes"`` reports them as attributes, which gives
    true subtotals. Lines are first combined per (category, customer, order), so
    the grouping-set expansion and the distinct count work on the smaller set. One task
    expands the orders of about ``SALES_LINES_IN_TASK`` lines, however many there are: the
    names are joined to items and orders before, so nothing is dealt anew in between.
    """
    if mode not in ("ROLLUP", "CUBE"):
        raise ValueError("mode must be ROLLUP or CUBE")
    sold = orders.filter(
        F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("status") != "CANCELLED")
    ).select("so_id", "customer_id").join(customers.select("customer_id", "customer_name"), "customer_id")
    named = items.select("item_id", "category_id").join(categories.select("category_id", "category_name"), "category_id", "left")
    tasks = max(so_lines.sparkSession.sparkContext.defaultParallelism, -(-so_lines.count() // SALES_LINES_IN_TASK))
    net = F.col("qty_ordered") * F.col("unit_price") * (F.lit(1).cast("decimal(1,0)") - F.col("discount_pct"))
    base = (
        so_lines.select("so_id", "item_id", "qty_ordered", "qty_shipped", net.cast("decimal(30,10)").alias("net"))
        .filter(F.col("so_id").isNotNull())
        .join(named, "item_id")
        .repartition(tasks, "so_id")
        .join(sold, "so_id")
        .groupBy("category_id", "category_name", "customer_id", "customer_name", "so_id")
        .agg(F.sum("qty_ordered").alias("q"), F.sum("qty_shipped").alias("s"), F.sum("net").alias("a"))
    )
    measures = (
        "CAST(grouping(category_id) AS INT) AS g_category, CAST(grouping(customer_id) AS INT) AS g_customer, "
        "CAST(grouping(category_id) * 2 + grouping(customer_id) AS INT) AS gid, "
        "COUNT(DISTINCT so_id) AS order_count, SUM(q) AS qty_ordered, SUM(s) AS qty_shipped, "
        "CAST(SUM(a) AS DECIMAL(38,10)) AS amount"
    )
    if names == "grouped":
        sql = (f"SELECT category_id, category_name, customer_id, customer_name, {measures} FROM {{base}} "
               f"GROUP BY category_name, customer_name, {mode}(category_id, customer_id)")
    else:
        sql = ("SELECT category_id, CASE WHEN grouping(category_id) = 0 THEN MAX(category_name) END AS category_name, "
               "customer_id, CASE WHEN grouping(customer_id) = 0 THEN MAX(customer_name) END AS customer_name, "
               f"{measures} FROM {{base}} GROUP BY {mode}(category_id, customer_id)")
    return base.sparkSession.sql(sql, base=base)


def stock_aging(lots: DataFrame, items: DataFrame, today) -> DataFrame:
    """Age of every available lot, its bucket, quartile and quantity share."""
    day = F.lit(today).cast("date")
    age = F.datediff(day, F.col("receipt_date"))
    held = (
        lots.filter((F.col("status") == "AVAILABLE") & (F.col("qty_on_hand") > 0))
        .join(items.select("item_id", "item_code", "item_name"), "item_id")
        .select("lot_id", "lot_no", "item_code", "item_name", "warehouse_id", "qty_on_hand",
                "receipt_date", age.alias("age_days"))
    )
    count, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("qty_on_hand"), F.lit(0)).cast("decimal(22,4)")).first()
    bucket = (F.when(F.col("age_days") <= 30, "0-30").when(F.col("age_days") <= 60, "31-60")
              .when(F.col("age_days") <= 90, "61-90").otherwise("90+"))
    tiled = ntile(held, [F.col("age_days"), F.col("lot_id")], 4, "age_quartile", count)
    pct = F.round(F.col("qty_on_hand").cast("decimal(18,4)") * 100 / F.nullif(F.lit(total).cast("decimal(22,4)"), F.lit(0)), 2)
    return tiled.withColumns({"age_bucket": bucket, "qty_pct": pct.cast("decimal(10,2)")})


def top_consumed_items(txns, items, start, end, n: int = 10) -> DataFrame:
    """Top ``n`` items by consumed quantity with the three rankings."""
    used = (
        txns.filter(
            (F.col("direction") == "O") & F.col("txn_type").isin("ISSUE", "PROD_OUT")
            & F.col("txn_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("item_id")
        .agg(F.sum("quantity").alias("consumed_qty"), F.sum("total_cost").alias("consumed_cost"),
             F.count(F.lit(1)).alias("txn_count"))
    )
    named = used.join(items.select("item_id", "item_code", "item_name", "item_type"), "item_id")
    # A rank depends only on the rows above, which are all among the first n,
    # so the windows run over those n rows.
    top = named.orderBy(F.col("consumed_qty").desc(), F.col("item_id")).limit(n)
    by_qty = Window.orderBy(F.col("consumed_qty").desc())
    unique = Window.orderBy(F.col("consumed_qty").desc(), F.col("item_id"))
    return top.select(
        "item_id", "item_code", "item_name", "item_type", "consumed_qty", "consumed_cost", "txn_count",
        F.row_number().over(unique).alias("rn"), F.rank().over(by_qty).alias("rnk"),
        F.dense_rank().over(by_qty).alias("dense_rnk"))


def inventory_pareto(balances: DataFrame, items: DataFrame) -> DataFrame:
    """Value share, cumulative share (ties share it), rank and ABC class per item."""
    value = (
        balances.groupBy("item_id")
        .agg(F.sum("qty_on_hand").alias("qty_on_hand"),
             F.sum((F.col("qty_on_hand") * F.col("avg_cost")).cast("decimal(30,10)"))
             .cast("decimal(28,10)").alias("stock_value"))
        .filter(F.col("stock_value") > 0)
        .join(items.select("item_id", "item_code", "item_name", F.col("abc_class").alias("abc_class_current")), "item_id")
    )
    # One row per item, needed by four passes: the stock is read once.
    value, count = materialize_counted(value, "value")
    hot = count > hot_group_rows(balances.sparkSession)
    valued = with_totals(value, [], {"__total": F.col("stock_value")})
    cum = peer_sums(valued, [], "stock_value", {"__cum": F.col("stock_value")}, descending=True, hot=hot)
    ranked = row_numbers(cum, [], [F.col("stock_value").desc(), F.col("item_id")], "value_rank", hot)
    total = F.col("__total").cast("decimal(24,4)")
    pct = lambda c: F.round(safe_ratio(F.col(c).cast("decimal(24,4)") * 100, total), 4).cast("decimal(10,4)")
    out = ranked.withColumns({"value_pct": pct("stock_value"), "cum_pct": pct("__cum")})
    return out.withColumn("abc_class_calc", abc_class(F.col("cum_pct"), 80, 95)).drop("__total", "__cum")


def latest_run_per_job(jobs: DataFrame, runs: DataFrame, prefix: str) -> DataFrame:
    """Jobs whose name starts with ``prefix``, with their newest run if any."""
    last = best_per_key(runs, ["job_name"], [F.col("actual_start_date"), F.col("log_id")])
    return jobs.filter(F.col("job_name").startswith(prefix)).join(
        last.select("job_name", F.col("status").alias("last_status"), F.col("error_code").alias("last_error_code"),
                    F.col("actual_start_date").alias("last_run_start"),
                    F.col("run_duration").alias("last_run_duration")),
        "job_name", "left")
