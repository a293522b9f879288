"""Demand forecast, accuracy and the month pivot."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import period_index, period_start
from millrace.operators.common import next_snapshot

METHODS = {"MA3": 3, "MA6": 6, "TREND": 3}


def forecast_periods(history: DataFrame, method: str, ahead: int, run_date: str) -> DataFrame:
    """item_id, warehouse_id, period_date, forecast_qty for the coming periods.

    A recurrence over months: each new period uses the previous ones, including
    those just forecast. Only the last six months matter, so history becomes six
    conditional sums in one aggregation, and a fold extends that short array.
    """
    method = method.upper()
    if method not in METHODS:
        raise ValueError(f"unsupported method {method}")
    window = METHODS[method]
    day = date.fromisoformat(run_date)
    anchor = (day.year - 2000) * 12 + day.month - 1
    n = period_index(F.col("period_date"))
    qty = F.coalesce("actual_qty", "forecast_qty").cast("decimal(18,4)")
    recent = history.filter(n <= anchor).groupBy("item_id", "warehouse_id").agg(*[
        F.coalesce(F.sum(F.when(n == anchor - back, qty)), F.lit(0)).cast("double").alias(f"h{back}") for back in range(5, -1, -1)])
    last = lambda acc, back: F.element_at(acc, F.lit(-1 - back))

    def following(acc):
        if method == "TREND":
            value = last(acc, 0) + (last(acc, 0) - last(acc, window)) / F.lit(float(window))
        else:
            total = last(acc, 0)
            for back in range(1, window):
                total = total + last(acc, back)
            value = total / F.lit(float(window))
        return F.concat(acc, F.array(F.greatest(value, F.lit(0.0))))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(ahead)), F.array(*[F.col(f"h{b}") for b in range(5, -1, -1)]), lambda acc, _: following(acc))
    rows = recent.select("item_id", "warehouse_id", F.posexplode(F.slice(series, 7, ahead)).alias("step", "value"))
    return rows.select("item_id", "warehouse_id", period_start(F.lit(anchor + 1) + F.col("step")).alias("period_date"),
                       F.round("value", 4).cast("decimal(18,4)").alias("forecast_qty"))


def generate_forecast(history: DataFrame, method: str = "MA3", ahead: int = 3, run_date: str = "") -> DataFrame:
    """Forecast table after upserting the new periods (warehouse compared null-safe)."""
    fresh = forecast_periods(history, method, ahead, run_date).withColumn("method", F.lit(method.upper()))
    return next_snapshot(history, fresh, ["item_id", "warehouse_id", "period_date", "method"])


def forecast_accuracy(forecast: DataFrame, item_id: int | None = None) -> DataFrame:
    """Error, bias, neighbours and three-row accuracy per item, by period.

    One item's series has a row per (period, warehouse, method), so the window's
    group is bounded by that key and not by the size of the ledger behind it.
    """
    rows = forecast.filter(F.col("actual_qty").isNotNull() & (F.col("method") != "MANUAL"))
    if item_id is not None:
        rows = rows.filter(F.col("item_id") == item_id)
    a, f = F.col("actual_qty").cast("decimal(14,4)"), F.col("forecast_qty").cast("decimal(14,4)")
    zero = F.lit(0).cast("decimal(14,4)")
    base = rows.select(
        "item_id", "warehouse_id", "period_date", "method", f.alias("forecast_qty"), a.alias("actual_qty"),
        F.round(F.abs(a - f) / F.nullif(a, zero), 4).cast("decimal(14,4)").alias("abs_pct_err"),
        F.round(f - a, 4).cast("decimal(16,4)").alias("bias"))
    w = Window.partitionBy("item_id").orderBy("period_date", "warehouse_id", "method")
    near = w.rowsBetween(-2, 0)
    prev = F.lag("actual_qty").over(w)
    mean = F.sum("abs_pct_err").over(near) / F.nullif(F.count("abs_pct_err").over(near), F.lit(0)).cast("decimal(4,0)")
    return base.withColumns({
        "prev_actual": prev, "next_actual": F.lead("actual_qty").over(w),
        "mom_growth": F.round((F.col("actual_qty") - prev).cast("decimal(14,4)") / F.nullif(prev, zero), 4).cast("decimal(14,4)"),
        "mape_3m": F.round(mean, 4).cast("decimal(14,4)"),
        "rolling_accuracy": F.round(F.lit(1).cast("decimal(1,0)") - mean, 4).cast("decimal(14,4)")})


def pivot_demand(forecast: DataFrame, start: str, end: str) -> DataFrame:
    """One column ``M_yyyymm`` per month present in the range; none gives ``M_NONE``.

    Only the distinct month names come to the driver: one value per month.
    """
    first = lambda d: F.trunc(F.lit(d).cast("date"), "MM")
    rows = forecast.filter(F.col("period_date").between(first(start), first(end))).select(
        "item_id", F.date_format("period_date", "'M_'yyyyMM").alias("m"), F.coalesce("actual_qty", "forecast_qty").alias("qty"))
    months = sorted(r[0] for r in rows.select("m").distinct().collect())
    if not months:
        return rows.select("item_id").distinct().withColumn("M_NONE", F.lit(None).cast("decimal(28,4)"))
    return rows.groupBy("item_id").pivot("m", months).agg(F.sum("qty"))
