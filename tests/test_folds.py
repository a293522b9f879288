"""Folds of a hot key: ranges as step functions of their start."""

import random
from datetime import date
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import inventory, ordered
from millrace.operators.fold import BAND, settled_starts
from millrace.operators.inventory import _average_near, _average_row
from millrace.operators.ordered import PART, is_hot, range_split


def test_near_averages_are_those_of_single_folds():
    rng = random.Random(4)
    for turn in range(300):
        big = 10 ** rng.choice([1, 4, 9, 17])
        state, offsets = (rng.randint(-10, 10 ** 9),), np.arange(-40, 41)
        start = state[0] + offsets
        for _ in range(6):
            row = (rng.randint(-big // 10, big), rng.randint(0, big), rng.randint(0, 10 ** 9), rng.randint(0, 4) > 0, int(rng.random() < 0.05))
            offsets, _slope = _average_near(state, offsets, row)
            state, _ = _average_row(state, row)
            start = [_average_row((int(x),), row)[0][0] for x in start]
            assert (state[0] + offsets).tolist() == start, (turn, row)


def check_rounds(spark, rows, quantity, before):
    """Rounds until all ranges of one key are settled, and the end of each against one pass."""
    df = spark.range(rows).select(
        F.lit(7).cast("bigint").alias("k"), F.col("id").alias("seq"), before.cast("bigint").alias("b"), quantity.cast("bigint").alias("q"),
        (F.pmod(F.xxhash64("id"), F.lit(900_000_000)) + 1).alias("c"), F.lit(1).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("f"),
        F.lit(5_000_000).cast("bigint").alias("a0"))
    split = range_split(df, ["k"], [F.col("seq")])
    columns = ["k", "b", "q", "c", "h", "f", "a0"]

    def arranged(parts=None):
        mine = split if parts is None else split.filter(F.col(PART).isin(parts))
        return mine.repartition(PART).sortWithinPartitions(PART, "k", "seq").select(PART, *columns)

    starts, rounds = settled_starts(arranged, [PART, "k"], ["b", "q", "c", "h", "f"], ["a0"], _average_row, [False], _average_near)
    state, part, want = (5_000_000,), None, {}
    for r in split.select(PART, "seq", "b", "q", "c").orderBy("seq").toLocalIterator():
        if part is not None and r[PART] != part:
            want[r[PART], (7,)] = state
        part = r[PART]
        state, _ = _average_row(state, (r.b, r.q, r.c, 1, 0))
    assert starts == want and len(want) >= 3
    return rounds


def test_growing_stock_of_a_million_rows_settles_in_three_rounds(spark):
    # stock only grows, so no range forgets its start: the average before it still counts at its end
    assert check_rounds(spark, 1_000_000, F.lit(10_000), (F.col("id") + 50) * 10_000) <= 3


def test_even_stock_settles_in_three_rounds(spark):
    assert check_rounds(spark, 60_000, F.lit(20_000), F.lit(400_000) + F.pmod("id", F.lit(7)) * 10_000) <= 3


def test_receipts_too_small_to_move_the_average(spark):
    # every start keeps its own end here: the ranges are the identity and rounding hides the receipts
    assert check_rounds(spark, 40_000, F.lit(1), F.lit(10 ** 13)) <= 3
    assert BAND >= 1


def test_issues_make_the_overlap_of_lots_and_requests_once(spark):
    """Every output is read from the written allocations; none computes the overlap anew."""
    lots = spark.createDataFrame(
        [(f"l{i}", f"no{i}", 1, 1, Decimal(10), Decimal(0), Decimal(i + 1), date(2024, 1, 1 + i), "AVAILABLE") for i in range(4)],
        "lot_id string, lot_no string, item_id long, warehouse_id int, qty_on_hand decimal(18,4), qty_allocated decimal(18,4), unit_cost decimal(20,6), receipt_date date, status string")
    balances = spark.createDataFrame([(1, 1, Decimal(50), Decimal(0))], "item_id long, warehouse_id int, qty_on_hand decimal(18,4), qty_allocated decimal(18,4)")
    requests = spark.createDataFrame([(1, 1, 1, Decimal(15)), (2, 1, 1, Decimal(30))], "request_id long, item_id long, warehouse_id int, qty decimal(18,4)")
    out = inventory.fifo_allocate(lots, requests, balances, ["request_id"], "2024-02-01")
    for name in ("allocations", "lots", "txns", "short", "balances"):
        assert "Window" not in out[name]._jdf.queryExecution().optimizedPlan().toString(), name
    assert [(r.request_id, r.lot_id, r.qty) for r in out["allocations"].orderBy("request_id", "lot_id").collect()] == [
        (1, "l0", 10), (1, "l1", 5), (2, "l1", 5), (2, "l2", 10), (2, "l3", 10)]
    assert [(r.request_id, r.short_qty) for r in out["short"].collect()] == [(2, 5)] and out["balances"].first().qty_on_hand == 10


def test_hot_keys_are_looked_for_in_full_buckets_only(spark, monkeypatch):
    """Where no bucket is full no key is counted; where one is, the largest group decides, null keys too."""
    rows = spark.createDataFrame([(k, f"t{k}") for k in [*range(50), 7, 7, None, None]], "k long, t string")
    with monkeypatch.context() as m:
        m.setattr(ordered, "largest_group", lambda *_: 1 / 0)
        assert not is_hot(rows, ["k"]) and not is_hot(rows, ["k", "t"])
    try:
        for bound, hot in (("2", True), ("3", False), ("1", True)):
            spark.conf.set("spark.millrace.hotGroupRows", bound)
            assert is_hot(rows, ["k"]) is hot and is_hot(rows, ["t"]) is hot
        spark.conf.set("spark.millrace.hotGroupRows", "1")
        assert is_hot(rows.filter("k IS NULL"), ["k"]) and not is_hot(rows.filter("k <> 7"), ["k"]) and is_hot(rows, [])
    finally:
        spark.conf.unset("spark.millrace.hotGroupRows")
