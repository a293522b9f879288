"""Material requirements planning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import doc_no
from millrace.operators.bom import active_bom, circular_items, low_level_codes_checked, structure_edges
from millrace.operators.common import best_per_key, sized_side, union_all
from millrace.operators.ordered import row_numbers, running_sums
from millrace.session import materialize, materialize_counted, scratch_root

NEED = "decimal(22,6)"
QTY = "decimal(18,4)"
# Plan action texts.
ORDER_TEXT, DAYS_TEXT, COVERED_TEXT, RELEASED_TEXT = "建议下单 提前期", "天", "需求已被在手/在途覆盖", "已转工单 "


def independent_demand(forecast, so_lines, orders, run_date, horizon: int, methods: list[str] | None = None) -> DataFrame:
    """Forecast in the window plus the open shortfall of due orders, per item."""
    start = F.lit(run_date).cast("date")
    end = F.date_add(start, horizon)
    planned = forecast.filter(F.col("period_date").between(start, end) & (F.col("forecast_qty") > 0))
    if methods:
        planned = planned.filter(F.col("method").isin(methods))
    due = orders.filter(F.col("status").isin("CONFIRMED", "PARTIAL") & (F.coalesce("required_date", start) <= end)).select("so_id")
    gap = so_lines.filter(F.col("line_status").isin("OPEN", "PARTIAL") & (F.col("qty_ordered") > F.col("qty_shipped")))
    short = gap.join(due, "so_id").select("item_id", (F.col("qty_ordered") - F.col("qty_shipped")).cast(NEED).alias("qty"))
    both = planned.select("item_id", F.col("forecast_qty").cast(NEED).alias("qty")).unionByName(short)
    return both.groupBy("item_id").agg(F.sum("qty").cast(NEED).alias("qty"))


def default_warehouse(balances: DataFrame) -> DataFrame:
    """Warehouse holding most of each item (lowest id on ties) and what is free there."""
    held = balances.select("item_id", "warehouse_id", "qty_on_hand", (F.col("qty_on_hand") - F.col("qty_allocated")).cast(QTY).alias("available"))
    return best_per_key(held, ["item_id"], [F.col("qty_on_hand"), -F.col("warehouse_id")])


def in_transit(po_lines: DataFrame, orders: DataFrame, run_date, horizon: int) -> DataFrame:
    """Unreceived quantity due by the horizon, per item."""
    start = F.lit(run_date).cast("date")
    live = orders.filter(F.col("status").isin("APPROVED", "PARTIAL")).select("po_id")
    due = po_lines.filter(F.col("line_status").isin("OPEN", "PARTIAL") & (F.coalesce("need_date", start) <= F.date_add(start, horizon)))
    return due.join(live, "po_id").groupBy("item_id").agg(F.sum(F.col("qty_ordered") - F.col("qty_received")).cast(QTY).alias("in_transit"))


def _uncoded_levels(edges: DataFrame, codes: DataFrame, circular: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(item_id, llc) of the components that no FG/SEMI root reaches, and their items on cycles; None where there are none.

    ``edges`` (parent, item_id) are all planning edges, whatever the items' type. Such a
    component lies one level below its deepest parent, so it is netted once; a parent
    without a code lies at level 0.
    """
    coded = codes.select("item_id", F.lit(True).alias("__coded"))
    open_ = edges.join(coded, "item_id", "left").filter("__coded IS NULL").drop("__coded").join(circular, "item_id", "left_anti")
    open_, count = materialize_counted(open_, "uncoded")
    if not count:
        return None, None
    within = open_.join(open_.select(F.col("item_id").alias("parent")).distinct(), "parent", "left_semi")
    loops = materialize(circular_items(within), "loops")
    open_ = materialize(open_.join(loops, "item_id", "left_anti").join(loops.withColumnRenamed("item_id", "parent"), "parent", "left_anti"), "uncoded")
    front = open_.join(codes.withColumnRenamed("item_id", "parent"), "parent", "left").groupBy("item_id").agg(F.max(F.coalesce("llc", F.lit(0)) + 1).alias("llc"))
    levels = []
    while True:  # no cycle is left, so the front dies out
        step, count = materialize_counted(front, "uncoded-level")
        if not count:
            break
        levels.append(step)
        front = step.withColumnRenamed("item_id", "parent").join(open_, "parent").groupBy("item_id").agg(F.max(F.col("llc") + 1).alias("llc"))
    found = union_all(levels).groupBy("item_id").agg(F.max("llc").cast("int").alias("llc")) if levels else None
    return found, loops


def run_mrp(demand: DataFrame, balances: DataFrame, transit: DataFrame, items: DataFrame, headers: DataFrame, lines: DataFrame,
            run_date, horizon: int = 90, run_id: int = 1, phantom: str = "skip") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan rows, run summary, rejects): netting level by level down the structure.

    All items of one low-level code are netted in one job, and their net need is
    passed to the next levels: one round per level. ``phantom="skip"`` drops phantom
    components; ``"pass_through"`` hands their need straight to their own components.
    ``rejects`` (item_id, level_no, qty, error_code) hold the need that cannot be planned:
    M1001 for unknown items, M2002 for items on a cycle, M2004 for need that comes from
    an uncoded parent to a level netted before. Need planned and rejected add up.
    """
    if phantom not in ("skip", "pass_through"):
        raise ValueError("phantom must be skip or pass_through")
    end = F.date_add(F.lit(run_date).cast("date"), horizon)
    spark = items.sparkSession
    codes, circular = low_level_codes_checked(headers, lines, items)
    codes, n_codes = materialize_counted(codes, "llc")
    circular = circular.select("item_id")
    edges, n_edges = materialize_counted(structure_edges(headers, lines, items, run_date).select(
        F.col("parent_item_id").alias("parent"), F.col("component_item_id").alias("item_id"), "qty_per",
        (F.lit(1).cast("decimal(1,0)") - F.coalesce("scrap_rate", F.lit(0).cast("decimal(8,4)"))).alias("yield_rate"), "is_phantom"), "edges")
    further, loops = _uncoded_levels(edges.select("parent", "item_id").distinct(), codes, circular)
    if further is not None:
        codes, n_codes = materialize_counted(codes.unionByName(further), "llc")
    circular = materialize(circular if loops is None else circular.union(loops).distinct(), "circular")
    supply, n_supply = materialize_counted(
        items.select("item_id", "lead_time_days", F.lit(True).alias("__known"))
        .join(default_warehouse(balances).select("item_id", "warehouse_id", "available"), "item_id", "left")
        .join(transit, "item_id", "left").join(circular, "item_id", "left_anti"), "supply")
    codes, edges, supply = sized_side(codes, n_codes), sized_side(edges, n_edges), sized_side(supply, n_supply)
    # one table of needs by level: a round appends what it hands down and reads its own level only
    needs = f"{scratch_root(spark)}/millrace/needs-{uuid.uuid4().hex}"

    def hand_on(need: DataFrame) -> None:
        need.select("item_id", F.col("qty").cast(NEED).alias("qty"), F.col("level_no").cast("int").alias("level_no")).write.partitionBy("level_no").mode("append").parquet(needs)

    item_type = items.schema["item_id"].dataType.simpleString()
    needed = lambda: spark.read.schema(f"item_id {item_type}, qty {NEED}, level_no int").parquet(needs)
    hand_on(demand.withColumn("item_id", F.col("item_id").cast(item_type)).join(codes, "item_id", "left").select("item_id", "qty", F.coalesce("llc", F.lit(0)).alias("level_no")))
    plans, rejects = [], []

    def dependents(net: DataFrame, level: int) -> DataFrame:
        need = F.round(F.col("net") * F.col("qty_per").cast("decimal(12,6)") / F.col("yield_rate").cast("decimal(9,4)"), 6).cast(NEED)
        step = net.withColumnRenamed("item_id", "parent").join(edges, "parent").select("item_id", need.alias("qty"), "is_phantom")
        real = [step.filter("is_phantom <> 'Y'")]
        hollow = step.filter("is_phantom = 'Y'")
        hollow = hollow.join(circular, "item_id", "left_anti")  # a phantom on a cycle has nothing to hand on
        while phantom == "pass_through" and not hollow.isEmpty():
            deeper = materialize(hollow.select(F.col("item_id").alias("parent"), F.col("qty").alias("net")).join(edges, "parent").select(
                "item_id", need.alias("qty"), "is_phantom"), "phantom")
            real.append(deeper.filter("is_phantom <> 'Y'"))
            hollow = deeper.filter("is_phantom = 'Y'").join(circular, "item_id", "left_anti")
        out = union_all(real).groupBy("item_id").agg(F.sum("qty").cast(NEED).alias("qty"))
        return out.join(codes, "item_id", "left").select("item_id", "qty", F.coalesce("llc", F.lit(level + 1)).alias("level_no"))

    # Every item that can be needed has a level, so the rounds end with the deepest one.
    deepest = codes.agg(F.coalesce(F.max("llc"), F.lit(0))).first()[0]
    for level in range(deepest + 1):
        here = needed().filter(F.col("level_no") == level).groupBy("item_id").agg(
            F.sum("qty").cast(NEED).alias("gross")).filter("gross > 0")
        zero = F.lit(0).cast(QTY)
        met = here.join(supply, "item_id", "left").withColumns({
            "available": F.coalesce("available", zero), "in_transit": F.coalesce("in_transit", zero), "level_no": F.lit(level)}).withColumn(
            "net", (F.col("gross") - F.col("available") - F.col("in_transit")).cast(NEED))
        met = materialize(met, "plan")
        lost = met.filter("__known IS NULL").select("item_id", "gross").join(circular.withColumn("__loop", F.lit(True)), "item_id", "left")
        rejects.append(lost.select("item_id", F.lit(level).alias("level_no"), F.col("gross").alias("qty"), F.when(F.col("__loop"), "M2002").otherwise("M1001").alias("error_code")))
        rows = met.filter("__known")
        plans.append(rows)
        below = materialize(dependents(rows.filter("net > 0").select("item_id", "net"), level), "need")
        rejects.append(below.filter(F.col("level_no") <= level).select("item_id", "level_no", "qty", F.lit("M2004").alias("error_code")))
        if level < deepest:
            hand_on(below.filter(F.col("level_no") > level))
    on_loop = below.filter(F.col("level_no") > deepest)  # a cycle has no level
    rejects.append(on_loop.select("item_id", "level_no", "qty", F.lit("M2002").alias("error_code")))
    lead = F.coalesce("lead_time_days", F.lit(0))
    ordered = F.col("net") > 0
    planned = F.when(ordered, F.round("net", 4)).otherwise(0).cast(QTY)
    plan = union_all(plans).select(
        F.lit(run_id).alias("run_id"), "item_id", "warehouse_id", end.alias("bucket_date"), "level_no",
        F.round("gross", 4).cast(QTY).alias("gross_req"), F.col("in_transit").alias("scheduled_receipt"),
        F.col("available").alias("proj_on_hand"), planned.alias("net_req"), planned.alias("planned_order_qty"),
        F.when(ordered, F.date_sub(end, lead)).alias("planned_order_date"),
        F.when(ordered, F.concat(F.lit(ORDER_TEXT), lead.cast("string"), F.lit(DAYS_TEXT))).otherwise(COVERED_TEXT).alias("action_msg"))
    summary = plan.agg(F.lit(run_id).alias("run_id"), F.lit("SUCCESS").alias("status"), F.count(F.lit(1)).alias("item_count"),
                       F.count(F.lit(1)).alias("plan_count"), F.coalesce(F.max("level_no"), F.lit(0)).alias("max_level"))
    return plan, summary, union_all(rejects)


def netting_detail(plan: DataFrame) -> DataFrame:
    """Projected balance of each (run, item) through its buckets."""
    change = F.col("scheduled_receipt") + F.col("planned_order_qty") - F.col("gross_req")
    run = running_sums(plan, ["run_id", "item_id"], [F.col("bucket_date"), F.col("level_no")], {"__move": change})
    return run.withColumnRenamed("proj_on_hand", "opening_on_hand").withColumn(
        "projected_balance", F.col("opening_on_hand") + F.col("__move")).drop("__move")


def release_production_orders(plan: DataFrame, items: DataFrame, headers: DataFrame, today, start_seq: int = 0) -> tuple[DataFrame, DataFrame]:
    """Production orders for planned FG/SEMI, and the plan marked as released."""
    bom = active_bom(headers, today).select("item_id", "bom_id")
    made = items.filter(F.col("item_type").isin("FG", "SEMI")).select("item_id", "lead_time_days")
    wanted = plan.filter(F.col("planned_order_qty") > 0).join(made, "item_id").join(bom, "item_id", "left")
    numbered = row_numbers(wanted, [], [F.col("level_no"), F.col("item_id"), F.col("bucket_date")], "__n")
    day = F.coalesce("planned_order_date", F.lit(today).cast("date"))
    seq = F.col("__n") + start_seq
    orders = numbered.select(
        seq.alias("prod_id"), doc_no("PRD", day, seq).alias("prod_no"), "item_id", "bom_id", F.col("planned_order_qty").alias("qty_planned"),
        F.lit("PLANNED").alias("status"), "warehouse_id", F.date_sub(day, F.coalesce("lead_time_days", F.lit(0))).alias("start_date"),
        F.col("planned_order_date").alias("due_date"), F.col("run_id").alias("source_mrp_id"), "bucket_date", "level_no")
    key = ["item_id", "bucket_date", "level_no"]
    marked = plan.join(orders.select(*key, "prod_no"), key, "left").withColumn(
        "action_msg", F.coalesce(F.concat(F.lit(RELEASED_TEXT), "prod_no"), F.col("action_msg"))).drop("prod_no")
    return orders.drop("bucket_date", "level_no"), marked
