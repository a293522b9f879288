"""Operators on the small master data, against plain recursion and hand counts."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import bom, forecast, inventory, items, mrp, pricing, reports, utility
from tests import seed

LIVE = {v[0]: v[4] for v in seed.BOMS.values() if v[2] == "ACTIVE"}


def frames(spark, boms=(), extra_items=()):
    return seed.headers(spark, boms), seed.lines(spark, boms), seed.items(spark, extra_items)


def chain(n, first=1000):
    """Items and boms of a chain of ``n`` links below item ``first``."""
    made = [(first + i, (f"C{i}", "FG" if not i else "SEMI" if i < n else "RAW", "1.5" if i == n else "0", "0", "part", 1, "N")) for i in range(n + 1)]
    return [(first + i, (first + i, "A", "ACTIVE", "Y", [(first + i + 1, "1", "0", "N")])) for i in range(n)], made


def rounded(x, places):
    return Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def plain_cost(item):
    if item not in LIVE:
        return Decimal(seed.ITEMS[item][2])
    return rounded(sum(plain_cost(c) * rounded(Decimal(q) / (1 - Decimal(s)), 12) for c, q, s, _ in LIVE[item]), 6)


def plain_explosion(item, level=1, qty=1.0):
    for c, q, s, phantom in LIVE.get(item, []):
        part = qty * (float(q) / (1 - float(s)))
        yield level, item, c, round(part, 6), "Y" if phantom == "Y" or seed.ITEMS[c][6] == "Y" else "N"
        yield from plain_explosion(c, level + 1, part)


def test_rolled_cost(spark):
    done, failed = bom.rolled_cost(*frames(spark), seed.AS_OF)
    assert {r.item_id: r.rolled_cost for r in done.collect()} == {i: rounded(plain_cost(i), 6) for i in seed.ITEMS}
    assert failed.isEmpty()


def test_rounds_do_not_broadcast_large_sides(spark):
    """Beyond the bound no round of the cost roll or the planning joins by a broadcast, with the same costs and levels."""
    h, l, i = frames(spark)
    levels = {r.item_id: r.llc for r in bom.low_level_codes(h, l, i).collect()}
    spark.conf.set("spark.millrace.broadcastRows", "1")
    try:
        done, failed = bom.rolled_cost(h, l, i, seed.AS_OF)
        codes = bom.low_level_codes(h, l, i)
        assert "BroadcastHashJoin" not in failed._jdf.queryExecution().executedPlan().toString()
        assert {r.item_id: r.rolled_cost for r in done.collect()} == {k: rounded(plain_cost(k), 6) for k in seed.ITEMS}
        assert {r.item_id: r.llc for r in codes.collect()} == levels and failed.isEmpty()
    finally:
        spark.conf.unset("spark.millrace.broadcastRows")


def test_explosion(spark):
    root = spark.createDataFrame([(1,), (2,)], "item_id long")
    rows, bad = bom.explode_bom_checked(*frames(spark), root, 1, seed.AS_OF)
    got = sorted((r.root_item_id, r.lvl, r.parent_item_id, r.component_item_id, float(r.cum_qty), r.is_phantom) for r in rows.collect())
    assert got == sorted((i, *x) for i in (1, 2) for x in plain_explosion(i)) and bad.isEmpty()


def test_deep_chain_is_complete(spark):
    boms, made = chain(25)
    h, l, i = frames(spark, boms, made)
    root = spark.createDataFrame([(1000,)], "item_id long")
    rows, bad = bom.explode_bom_checked(h, l, i, root, 1, seed.AS_OF)
    assert rows.count() == 25 and bad.isEmpty()
    assert bom.explode_bom_checked(h, l, i, root, 1, seed.AS_OF, max_levels=4)[1].count() == 1
    done, failed = bom.rolled_cost(h, l, i, seed.AS_OF)
    assert {float(r.rolled_cost) for r in done.filter("item_id >= 1000").collect()} == {1.5} and done.filter("item_id >= 1000").count() == 26 and failed.isEmpty()
    codes, loops = bom.low_level_codes_checked(h, l, i)
    assert {r.item_id: r.llc for r in codes.filter("item_id >= 1000").collect()} == {1000 + k: k for k in range(1, 26)} and loops.isEmpty()


def test_cycles_and_missing_parts_are_told_apart(spark):
    boms = [(900, (900, "A", "ACTIVE", "Y", [(901, "1", "0", "N"), (11, "1", "0", "N")])), (901, (901, "A", "ACTIVE", "Y", [(900, "1", "0", "N")])),
            (902, (902, "A", "ACTIVE", "Y", [(999, "1", "0", "N")])), (903, (903, "A", "ACTIVE", "Y", [(901, "1", "0", "N"), (12, "2", "0", "N")]))]
    made = [(k, (f"Z{k}", "FG", "0", "0", "part", 1, "N")) for k in (900, 901, 902, 903)]
    h, l, i = frames(spark, boms, made)
    assert {r.item_id: r.error_code for r in bom.rolled_cost(h, l, i, seed.AS_OF)[1].collect()} == {900: "M2002", 901: "M2002", 902: "M1001", 903: "M2002"}
    codes, loops = bom.low_level_codes_checked(h, l, i)
    assert {r.item_id for r in loops.collect()} == {900, 901}
    assert {r.item_id for r in codes.collect()} >= {3, 5, 11, 12, 13, 14, 15, 999}
    rows, bad = bom.explode_bom_checked(h, l, i, spark.createDataFrame([(900,)], "item_id long"), 1, seed.AS_OF)
    assert [(r.component_item_id, r.error_code) for r in bad.collect()] == [(900, "M2002")] and rows.count() == 2


def test_version_compare(spark):
    h, l, i = frames(spark)
    comp = bom.bom_components(l, i)
    side = lambda b: comp.filter(F.col("bom_id") == b).withColumn("pair_id", F.lit(1))
    rows = bom.compare_bom_versions(side(71), side(76)).collect()
    assert [(r.change_type, r.component_item_id, int(r.old_qty_per), int(r.new_qty_per)) for r in rows] == [("QTY_CHANGED", 5, 1, 3)]


def test_low_level_codes(spark):
    deepest = {}
    for root in (k for k, v in seed.ITEMS.items() if v[1] in ("FG", "SEMI")):
        for level, _, c, _, _ in plain_explosion(root):
            deepest[c] = max(level, deepest.get(c, 0))
    assert {r.item_id: r.llc for r in bom.low_level_codes(*frames(spark)).collect()} == deepest


@pytest.mark.parametrize("method,n", [("MA3", 3), ("MA6", 6)])
def test_forecast(spark, method, n):
    rows = forecast.forecast_periods(seed.history(spark), method, 3, "2024-12-20").orderBy("item_id", "period_date").collect()
    want = []
    for item in (1, 2):
        series = [float(r.actual_qty) for r in seed.history(spark).filter(F.col("item_id") == item).orderBy("period_date").collect()]
        for _ in range(3):
            series.append(sum(series[-n:]) / n)
        want += series[-3:]
    assert all(abs(float(r.forecast_qty) - w) < 1e-3 for r, w in zip(rows, want, strict=True))


def plan(spark, wanted, phantom="skip", boms=(), made=()):
    h, l, i = frames(spark, boms, made)
    demand = seed.cast(spark.createDataFrame(list(wanted.items()), "item_id long, qty string"), qty="decimal(22,6)")
    transit = spark.createDataFrame([], "item_id long, in_transit decimal(18,4)")
    return mrp.run_mrp(demand, seed.balances(spark), transit, i, h, l, seed.AS_OF, 90, 7, phantom)


def plain_plan(wanted, pass_through):
    """Gross and net need per item, items taken from the top down."""
    have = {}
    for item, _, q, _, _ in seed.LOTS.values():
        have[item] = have.get(item, 0) + q
    gross = {k: float(v) for k, v in wanted.items()}

    def hand_down(item, net):
        for c, q, s, phantom in LIVE.get(item, []):
            need = net * float(q) / (1 - float(s))
            if phantom == "Y" or seed.ITEMS[c][6] == "Y":
                if pass_through:
                    hand_down(c, need)
            else:
                gross[c] = gross.get(c, 0) + need

    net = {}
    for item in (1, 2, 3, 5, 11, 12, 13, 14, 15):
        if gross.get(item, 0) > 0:
            net[item] = max(gross[item] - have.get(item, 0), 0)
            if net[item]:
                hand_down(item, net[item])
    return {k: (gross[k], net[k]) for k in net}


@pytest.mark.parametrize("phantom", ["skip", "pass_through"])
def test_planning_run(spark, phantom):
    wanted = {1: "50", 2: "20.5"}
    rows, summary, rejects = plan(spark, wanted, phantom)
    got = {r.item_id: (float(r.gross_req), float(r.net_req)) for r in rows.collect()}
    want = plain_plan(wanted, phantom == "pass_through")
    assert set(got) == set(want) and all(abs(a - b) < 2e-3 for k in got for a, b in zip(got[k], want[k]))
    assert summary.first().plan_count == len(want) and rejects.isEmpty()


def test_planning_keeps_what_it_cannot_plan(spark):
    boms, made = chain(25)
    loop = [(900, (900, "A", "ACTIVE", "Y", [(901, "1", "0", "N")])), (901, (901, "A", "ACTIVE", "Y", [(900, "1", "0", "N")]))]
    made += [(k, (f"Z{k}", "FG", "0", "0", "part", 1, "N")) for k in (900, 901)]
    rows, _, rejects = plan(spark, {1000: "3", 4711: "8", 900: "2"}, boms=boms + loop, made=made)
    assert {r.item_id: float(r.gross_req) for r in rows.collect()} == {1000 + k: 3.0 for k in range(26)}
    assert {(r.item_id, float(r.qty), r.error_code) for r in rejects.collect()} == {(4711, 8.0, "M1001"), (900, 2.0, "M2002")}


def raw(*numbers):
    return [(k, (f"R{k}", "RAW", "0", "0", "part", 1, "N")) for k in numbers]


def one_bom(item, *parts, phantom="N"):
    return item, (item, "A", "ACTIVE", "Y", [(p, "1", "0", phantom) for p in parts])


@pytest.mark.parametrize("phantom", ["skip", "pass_through"])
def test_planning_ends_on_cycles_of_raw_items(spark, phantom):
    """Cycles and shared parts that no finished product reaches: nothing hangs, every item is netted once, no need is lost."""
    boms = [one_bom(700, 701), one_bom(701, 700), one_bom(710, 711, 712), one_bom(711, 712), one_bom(720, 700, 712), one_bom(730, 730), one_bom(740, 700, phantom="Y")]
    wanted = {700: "5", 710: "2", 720: "1", 730: "4", 740: "6"}
    rows, _, rejects = plan(spark, wanted, phantom, boms=boms, made=raw(700, 701, 710, 711, 712, 720, 730, 740))
    planned = [(r.item_id, float(r.gross_req), r.level_no) for r in rows.collect()]
    assert sorted(planned) == [(710, 2.0, 0), (711, 2.0, 1), (712, 5.0, 2), (720, 1.0, 0), (740, 6.0, 0)]
    left = {}
    for r in rejects.collect():
        left[r.item_id, r.error_code] = left.get((r.item_id, r.error_code), 0) + float(r.qty)
    assert left == {(700, "M2002"): 6.0, (730, "M2002"): 4.0}


def test_admission_of_calm_and_contended_keys(spark):
    """Keys whose demand fits are decided by sums, the others by the fold; both as one pass in order would."""
    rng = random.Random(8)
    have = {(k, 1): rng.choice([0, 40, 100, 500]) for k in range(1, 30)}
    requests = [(n, rng.randint(1, 32), 1, rng.randint(1, 60)) for n in range(300)]
    rest, want = dict(have), {}
    for n, item, wh, qty in requests:
        before = rest.get((item, wh), 0)
        want[n] = (qty <= before, before)
        if qty <= before:
            rest[item, wh] = before - qty
    asked = seed.cast(spark.createDataFrame(requests, "request_id int, item_id long, warehouse_id int, qty int"), qty="decimal(18,4)")
    balances = seed.cast(spark.createDataFrame([(*k, q, 0) for k, q in have.items()], "item_id long, warehouse_id int, qty_on_hand int, qty_allocated int"), qty_on_hand="decimal(18,4)", qty_allocated="decimal(18,4)")
    got = inventory.admit_requests(asked, balances, ["request_id"])
    assert {r.request_id: (r.accepted, int(r.available_before)) for r in got.collect()} == want
    totals = {}
    for _, item, wh, qty in requests:
        totals[item, wh] = totals.get((item, wh), 0) + qty
    calm = [k for k, total in totals.items() if total <= have.get(k, 0)]
    assert 0 < len(calm) < len(totals)


def test_pareto(spark):
    value = {}
    for item, _, q, cost, _ in seed.LOTS.values():
        value[item] = value.get(item, 0) + q * float(cost)
    total, run, want = sum(value.values()), 0, {}
    for item, v in sorted(value.items(), key=lambda x: -x[1]):
        run += v
        want[item] = 100 * run / total
    got = {r.item_id: (float(r.cum_pct), r.abc_class_calc) for r in reports.inventory_pareto(seed.balances(spark), seed.items(spark)).collect()}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k]) < 0.01 for k in want)
    assert all(c == ("A" if w <= 80 else "B" if w <= 95 else "C") for (_, c), w in ((got[k], want[k]) for k in want))


def issue(spark, *rows):
    req = seed.cast(spark.createDataFrame(list(rows), "request_id int, item_id long, warehouse_id int, qty string"), qty="decimal(18,4)")
    return inventory.fifo_allocate(seed.lots(spark), req, seed.balances(spark), ["request_id"], seed.AS_OF)


def check_issue(spark):
    out = issue(spark, (1, 13, 1, "50"))
    assert {(r.lot_id, int(r.qty), float(r.unit_cost)) for r in out["allocations"].collect()} == {(501, 40, 6.0), (502, 10, 6.6)}
    assert float(out["allocations"].agg(F.sum("alloc_cost")).first()[0]) == 306.0
    left = {r.lot_id: (int(r.qty_on_hand), r.status) for r in out["lots"].filter("item_id = 13").collect()}
    assert left == {501: (0, "CONSUMED"), 502: (15, "AVAILABLE")}
    assert {r.lot_id: (int(r.qty_before), int(r.qty_after)) for r in out["txns"].collect()} == {501: (65, 25), 502: (25, 15)}
    assert float(out["balances"].filter("item_id = 13").first().qty_on_hand) == 15
    out = issue(spark, (1, 13, 1, "66"), (2, 13, 1, "45"), (3, 13, 1, "21"), (4, 13, 1, "20"), (5, 13, 1, "0"))
    assert {(r.request_id, r.error_code) for r in out["rejects"].collect()} == {(1, "M3001"), (3, "M3001"), (5, "M3005")}
    assert {(r.request_id, r.lot_id, int(r.qty)) for r in out["allocations"].collect()} == {(2, 501, 40), (2, 502, 5), (4, 502, 20)}


def test_fifo_issue(spark):
    check_issue(spark)


def test_fifo_issue_range_split(spark, tiny_groups):
    check_issue(spark)


def test_transfer_makes_no_stock(spark):
    moves = seed.cast(spark.createDataFrame([(1, 13, 1, 3, "30"), (2, 13, 1, 3, "30"), (3, 11, 2, 2, "1")], "move_id int, item_id long, from_wh int, to_wh int, qty string"), qty="decimal(18,4)")
    lots = seed.lots(spark).filter("lot_id <> 502")  # the balance knows of more than the lots hold
    out = inventory.transfer_stock(moves, lots, seed.balances(spark), ["move_id"], seed.AS_OF)
    assert {(r.move_id, float(r.qty)) for r in out["inbound"].collect()} == {(1, 30.0), (2, 10.0)}
    assert {(r.move_id, float(r.short_qty)) for r in out["short"].collect()} == {(2, 20.0)}
    assert {(r.warehouse_id, float(r.qty_on_hand)) for r in out["balances"].filter("item_id = 13").collect()} == {(1, 25.0), (3, 40.0)}
    assert {float(r.qty_on_hand) for r in out["target_lots"].collect()} == {30.0, 10.0}
    out = inventory.transfer_stock(moves, lots, seed.balances(spark), ["move_id"], seed.AS_OF, start_lot=900)
    assert {(r.ref_doc_id, r.lot_id, r.direction, float(r.qty_before), float(r.qty_after)) for r in out["txns_in"].collect()} == {(1, 901, "I", 0.0, 30.0), (2, 902, "I", 30.0, 40.0)}
    assert {(r.ref_doc_id, r.lot_id, float(r.quantity)) for r in out["txns_out"].collect()} == {(1, 501, 30.0), (2, 501, 10.0)}
    assert {r.lot_id: float(r.qty_on_hand) for r in out["target_lots"].collect()} == {901: 30.0, 902: 10.0}
    full = inventory.transfer_stock(moves, lots, seed.balances(spark), ["move_id"], seed.AS_OF, full_quantity=True)
    assert {(r.move_id, float(r.qty)) for r in full["inbound"].collect()} == {(1, 30.0), (2, 30.0)}
    assert {(r.warehouse_id, float(r.qty_on_hand)) for r in full["balances"].filter("item_id = 13").collect()} == {(1, 5.0), (3, 60.0)}


def test_units(spark):
    uoms = spark.createDataFrame([("HOUR", "TIME", 2), ("MIN", "TIME", 0), ("SHIFT", "TIME", 2), ("LITRE", "VOL", 3)], "uom_code string, uom_category string, decimal_digits int")
    conv = seed.cast(spark.createDataFrame([("HOUR", "MIN", "60"), ("SHIFT", "MIN", "450")], "from_uom string, to_uom string, factor string"), factor="decimal(20,8)")
    rows = seed.cast(spark.createDataFrame([(1, "1.5", "HOUR", "MIN"), (2, "3", "SHIFT", "HOUR"), (3, "90", "MIN", "HOUR"), (4, "1", "HOUR", "LITRE"), (5, "1", "DAY", "MIN"), (6, "7", "MIN", "MIN")],
                                           "id int, qty string, from_uom string, to_uom string"), qty="decimal(18,4)")
    good, bad = utility.convert_uom(rows, uoms, conv)
    assert {r.id: float(r.converted) for r in good.collect()} == {1: 90.0, 2: 22.5, 3: 1.5, 6: 7.0}
    assert {r.id: r.error_code for r in bad.collect()} == {4: "M1102", 5: "M1101"}


def price_frames(spark, default="Y"):
    lists = spark.createDataFrame([(8, default, "Y"), (9, "N", "Y"), (10, "Y", "N")], "price_list_id int, is_default string, is_active string").withColumns({
        "valid_from": F.lit("2024-01-01").cast("date"), "valid_to": F.lit(None).cast("date")})
    rules = spark.createDataFrame([
        (31, 8, 2, None, None, "0", "LIST", "815", 7), (32, 8, 2, None, None, "10", "DISCOUNT_AMT", "90", 3), (33, 8, None, "city", None, "5", "DISCOUNT_PCT", "0.125", 40),
        (34, 9, 1, None, 55, "0", "OVERRIDE", "599.5", 2), (35, 9, 1, None, None, "0", "LIST", "630", 2), (36, 8, None, None, None, "50", "DISCOUNT_PCT", "0.5", 90)],
        "rule_id int, price_list_id int, item_id long, category_id string, customer_id long, min_qty string, rule_type string, price_value string, priority int")
    rules = seed.cast(rules, min_qty="decimal(18,4)", price_value="decimal(20,6)").withColumns({
        "max_qty": F.lit(None).cast("decimal(18,4)"), "valid_from": F.lit("2024-01-01").cast("date"), "valid_to": F.lit(None).cast("date"), "is_active": F.lit("Y")})
    customers = spark.createDataFrame([(55, 9), (56, 9), (57, None)], "customer_id long, price_list_id int")
    return customers, lists, rules


def test_prices(spark):
    customers, lists, rules = price_frames(spark)
    req = spark.createDataFrame([(1, 1, None, 1), (2, 1, 57, 5), (3, 2, None, 3), (4, 2, None, 12), (5, 1, 55, 1), (6, 1, 56, 1), (7, 3, None, 60), (8, 2, 56, 4), (9, 77, None, 1)],
                                "request_id int, item_id long, customer_id long, qty int")
    out = pricing.price(req, seed.items(spark), customers, lists, rules, seed.AS_OF)
    assert {r.request_id: (float(r.final_price), r.rule_id) for r in out.collect()} == {
        1: (640.0, None), 2: (560.0, 33), 3: (815.0, 31), 4: (780.0, 32), 5: (599.5, 34), 6: (630.0, 35), 7: (0.0, 36), 8: (870.0, None)}
    assert [(r.request_id, r.error_code) for r in pricing.price_rejects(req, seed.items(spark), customers, lists, seed.AS_OF).collect()] == [(9, "M1001")]
    _, none, _ = price_frames(spark, default="N")
    assert {r.request_id: r.error_code for r in pricing.price_rejects(req, seed.items(spark), customers, none, seed.AS_OF).collect()} == {1: "M6002", 2: "M6002", 3: "M6002", 4: "M6002", 7: "M6002", 9: "M1001"}
    assert {r.request_id for r in pricing.price(req, seed.items(spark), customers, none, rules, seed.AS_OF).collect()} == {5, 6, 8}


@pytest.mark.parametrize("in_row", [0, 4096])
def test_tiers_in_rows_and_pairs_price_alike(spark, monkeypatch, in_row):
    """Many tiers of one key that overlap: the preferred tier that holds the quantity wins, however tiers are met."""
    monkeypatch.setattr(pricing, "TIERS_IN_ROW", in_row)
    tiers = [(100 + i, 8, 1 if i % 2 else None, None, 55 if i % 3 == 0 else None, str(i), str(i + 4) if i % 4 else None, "LIST", str(1000 + i), 60 - i % 7) for i in range(40)]
    rules = spark.createDataFrame(tiers, "rule_id int, price_list_id int, item_id long, category_id string, customer_id long, min_qty string, max_qty string, rule_type string, price_value string, priority int")
    rules = seed.cast(rules, min_qty="decimal(18,4)", max_qty="decimal(18,4)", price_value="decimal(20,6)").withColumns({
        "valid_from": F.lit("2024-01-01").cast("date"), "valid_to": F.lit(None).cast("date"), "is_active": F.lit("Y")})
    asked = [(q * 4 + k, 8, 1 if k % 2 else 2, "city", 55 if k // 2 else None, q) for q in range(45) for k in range(4)]
    req = seed.cast(spark.createDataFrame(asked, "request_id int, price_list_id int, item_id long, category_id string, customer_id long, qty int"), qty="decimal(18,4)")
    want = {}
    for rid, _, item, _, customer, q in asked:
        fits = [(t[9], t[2] is None, t[4] is None, t[0]) for t in tiers if t[2] in (None, item) and t[4] in (None, customer) and int(t[5]) <= q and (t[6] is None or int(t[6]) > q)]
        if fits:
            want[rid] = min(fits)[3]
    assert {r.request_id: r.rule_id for r in pricing.match_price_rules(req, rules, seed.AS_OF).collect()} == want
    assert pricing.match_price_rules(req, rules.filter("false"), seed.AS_OF).count() == 0


def test_sums_of_money(spark):
    rows = spark.createDataFrame([(1, "2.5", "EUR"), (1, "4", "EUR"), (2, "1", "EUR"), (2, "1", "USD"), (3, "1", None), (4, "1", None), (4, "1", "EUR")], "k int, amount string, currency_code string")
    good, bad = utility.sum_money(seed.cast(rows, amount="decimal(20,4)"), ["k"])
    assert [(r.k, float(r.amount), r.currency_code) for r in good.collect()] == [(1, 6.5, "EUR")]
    assert {r.k: r.error_code for r in bad.collect()} == {2: "MIXED_CURRENCY", 3: "MISSING_CURRENCY", 4: "MISSING_CURRENCY"}


def test_repeated_codes_and_parameters(spark):
    new = seed.cast(spark.createDataFrame([("NEW", "RAW", "1"), ("TWICE", "RAW", "2"), ("TWICE", "FG", "3"), ("RIM", "RAW", "4")], "item_code string, item_type string, std_cost string"), std_cost="decimal(20,6)")
    good, bad = items.load_items(new, seed.items(spark))
    assert [(r.item_code, r.item_id) for r in good.collect()] == [("NEW", 16)]
    assert sorted((r.item_code, r.error_code) for r in bad.collect()) == [("RIM", "M1004"), ("TWICE", "M1004"), ("TWICE", "M1004")]
    params = spark.createDataFrame([("a", "7", "NUMBER"), ("b", "x", "STRING"), ("b", "y", "STRING")], "param_key string, param_value string, param_type string")
    assert float(utility.read_params(params, ["a"])["a"]) == 7
    with pytest.raises(ValueError):
        utility.read_params(params, ["a", "b"])
