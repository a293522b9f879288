"""Spark against the SQL oracle at the smallest scale.

A spread of queries runs by default; FULL_ORACLE=1 runs all of them.
"""

import os
import re

import pytest

import __spark_entry__ as contract
from millrace.operators import reports
from millrace.plans import all_entries
from tests.oracle_check import compare

SPREAD = [
    "inventory_value", "sales_summary_cube", "sales_summary_rollup_true_subtotals", "top_consumed_items", "landed_cost_wgt", "recompute_avg_cost",
    "where_used", "item_profile", "load_items", "item_full_view", "price", "effective_rules", "receive_stock_txns", "reconcile_balances", "validate",
    "po_header_status", "po_transitions", "load_purchase_order_lines", "checkout_carts", "forecast_accuracy", "pivot_demand", "resolve_references",
    "apply_dup_rules", "phase_metrics", "quality_gates", "diff_tables", "stream_pair_calls", "stream_phase_metrics_session",
]
RANGE_SPLIT = ["stock_aging", "fifo_layers", "fifo_allocate", "supplier_ranking", "receive_po_lines", "screen_transfers", "apply_movements_trail"]


@pytest.mark.parametrize("name", list(all_entries()) if os.environ.get("FULL_ORACLE") else SPREAD)
def test_matches_oracle(spark, duck, sf, name):
    n, m, same, diff = compare(spark, duck, all_entries()[name], sf)
    assert n > 0 and n == m and same, diff


@pytest.mark.parametrize("name", RANGE_SPLIT)
def test_matches_oracle_with_range_split(spark, duck, sf, name, tiny_groups):
    n, m, same, diff = compare(spark, duck, all_entries()[name], sf)
    assert n > 0 and same, diff


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(all_entries()) <= set(contract.oracle_sql()) <= set(contract.queries())


def _tasks(df):
    return [int(n) for n in re.findall(r"RepartitionByExpression \[so_id#\d+L?\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())]


@pytest.mark.parametrize("name", ["sales_summary_rollup", "sales_summary_cube_true_subtotals"])
def test_sales_summary_deals_orders_by_the_number_of_lines(spark, duck, sf, name, monkeypatch):
    monkeypatch.setattr(reports, "SALES_LINES_IN_TASK", 300)
    assert _tasks(all_entries()[name].run(spark, sf)) == [-(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 300)]
    n, m, same, diff = compare(spark, duck, all_entries()[name], sf)
    assert n > 0 and n == m and same, diff


@pytest.mark.parametrize("name", ["price", "reprice_orders_held"])
def test_classes_of_few_tiers_alone_are_broadcast(spark, duck, sf, name):
    spark.conf.set("spark.millrace.broadcastRows", "20")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = all_entries()[name].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        n, m, same, diff = compare(spark, duck, all_entries()[name], sf)
    finally:
        spark.conf.unset("spark.millrace.broadcastRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("strategy=broadcast") == (2 if name == "reprice_orders_held" else 1)  # the one rule for all requests, per pricing in the plan
    assert n > 0 and n == m and same, diff
