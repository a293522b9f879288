"""Large steps keep few bytes on disk: shuffles go with their step, and rows travel without columns nobody takes."""

import random
from collections import Counter
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import inventory, pricing, procurement
from millrace.operators.fold import ordered_fold
from millrace.operators.ordered import row_numbers
from millrace.session import materialize
from millrace.streaming.ledger import _BucketAverage

BALANCE = "item_id long, warehouse_id int, qty_on_hand decimal(18,4), qty_allocated decimal(18,4), avg_cost decimal(20,6), last_txn_date date, version int"
RECEIPT = "code string, item_id long, warehouse_id int, qty decimal(18,4), unit_cost decimal(20,6), lot_no string"


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def plan(df):
    return df._jdf.queryExecution().simpleString()


def test_shuffle_files_go_when_the_table_is_written(spark):
    before = shuffle_files(spark)
    table = materialize(spark.range(2000).select((F.col("id") % 7).alias("k"), "id").repartition(5, "k"), "test")
    assert not shuffle_files(spark) - before
    assert table.count() == 2000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_numbers_of_a_whole_frame_take_one_shuffle(spark):
    rng = random.Random(7)
    names = [None, *(f"n{rng.randrange(10 ** 6):07d}" for _ in range(500))]
    rng.shuffle(names)
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int").repartition(6)
    out = row_numbers(df, [], [F.col("name"), F.col("i")], "no")
    want = sorted(((n, i) for i, n in enumerate(names)), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r["name"], r["i"], r["no"]) for r in out.orderBy("no").collect()] == [(*r, k) for k, r in enumerate(want, 1)]
    assert "hashpartitioning(__range" not in plan(out) and "SortMergeJoin" not in plan(out)


def test_numbers_of_an_empty_frame(spark):
    assert row_numbers(spark.range(0), [], [F.col("id")], "no").collect() == []


def _receipts(spark):
    rng = random.Random(3)
    rows = [(f"r{i:04d}", rng.randrange(12), rng.randrange(2), Decimal(rng.randrange(-1, 30)), rng.choice([None, Decimal(rng.randrange(900)) / 7]), rng.choice([None, f"L{i}"]))
            for i in range(400)]
    rng.shuffle(rows)
    rows = [(*r[:4], r[4] and round(r[4], 6), r[5]) for r in rows]
    balances = [(i, 1, Decimal(i), Decimal(0), Decimal(i) / 4, None, 2) for i in range(15)]
    return rows, balances, spark.createDataFrame(rows, RECEIPT), spark.createDataFrame(balances, BALANCE)


def test_receipts_post_lots_ledger_and_balances(spark):
    rows, opening, receipts, balances = _receipts(spark)
    got = inventory.receive_stock(receipts, balances, ["code"], "2026-01-01", start_lot=100, ref="code")
    state = {(i, w): (q, int(a * 10 ** 6), True) for i, w, q, _, a, _, _ in opening}
    lots, ledger = {}, {}
    for no, (code, item, wh, qty, cost, lot_no) in enumerate(sorted(r for r in rows if r[3] > 0), 101):
        have, avg, known = state.get((item, wh), (Decimal(0), 0, False))
        price = int((cost or 0) * 10 ** 6)
        (avg, _), _ = inventory._average_step((avg, known), (int(have * 10 ** 4), int(qty * 10 ** 4), price, 1))
        state[item, wh] = (have + qty, avg, True)
        lots[no] = (lot_no or f"LOT20260101{no:06d}", item, wh, qty)
        ledger[no] = (code, item, wh, qty, have, have + qty)
    assert {r.lot_id: (r.lot_no, r.item_id, r.warehouse_id, r.qty_on_hand) for r in got["lots"].collect()} == lots
    assert {r.txn_id: (r.ref_doc_id, r.item_id, r.warehouse_id, r.quantity, r.qty_before, r.qty_after) for r in got["txns"].collect()} == ledger
    assert {(r.item_id, r.warehouse_id): (r.qty_on_hand, int(r.avg_cost * 10 ** 6)) for r in got["balances"].collect()} == {k: v[:2] for k, v in state.items()}
    assert got["rejects"].count() == sum(r[3] <= 0 for r in rows)


def test_ledger_rows_of_receipts_need_no_fold_and_balances_no_text(spark):
    _, _, receipts, balances = _receipts(spark)
    got = inventory.receive_stock(receipts, balances, ["code"], "2026-01-01", ref="code")
    assert "MapIn" not in plan(got["txns"]) and "MapIn" not in plan(got["lots"])
    assert "MapIn" in plan(got["balances"])
    scans = plan(got["balances"]).partition("Optimized Logical Plan")[2] or plan(got["balances"])
    assert "code#" not in scans and "lot_no#" not in scans


def test_a_fold_that_gives_last_rows_ends_like_the_whole_one(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, i long, v long").withColumn("s", F.lit(0).cast("long"))

    def step(state, row):
        new = ((state[0] * 3 + row[0]) % 1009,)
        return new, new

    fold = lambda **how: ordered_fold(df, ["k"], [F.col("i")], ["v"], ["s"], step, [("o", "bigint")], ["i"], **how)
    whole, last = fold(), fold(last_only=True)
    ends = lambda d: {r.k: (r.i, r.o) for r in d.groupBy("k").agg(F.max("i").alias("i"), F.max_by("o", "i").alias("o")).collect()}
    assert ends(whole) == ends(last)
    assert last.count() < 200 < whole.count()


def _po(spark, twice=False):
    orders = [("p1", "APPROVED", 1), ("p2", "PARTIAL", 2), ("p3", "CLOSED", 1), ("p4", "DRAFT", 2)]
    lines = [(f"{p}-{n}", p, n, Decimal(10 * n), Decimal(n % 3), Decimal(n), "CANCELLED" if n == 4 else "OPEN") for p, *_ in orders for n in range(1, 6)]
    receipts = [(f"{line}/{k}", line, p, Decimal(q), None) for line, p, *_ in lines for k, q in enumerate((4, 0, 40, 5, 3, -1))]
    receipts += [("x1", "p1-1", "none", Decimal(1), None), ("x2", "none", "p1", Decimal(1), None), ("x3", None, "p2", Decimal(1), None),
                 ("x4", "p1-1", None, Decimal(2), None), ("x5", "none", "none", Decimal(0), None), ("x6", "p2-1", "p2", None, None)]
    if twice:
        orders, lines, receipts = orders + orders[:3], lines + lines[:8], receipts + receipts[::2]
    as_rows = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    return (orders, lines, receipts), (
        as_rows(orders, "po_id string, status string, warehouse_id int"),
        as_rows(lines, "po_line_id string, po_id string, item_id long, qty_ordered decimal(18,4), qty_received decimal(18,4), unit_price decimal(20,6), line_status string"),
        as_rows(receipts, "receipt_id string, po_line_id string, po_id string, qty decimal(18,4), unit_cost decimal(20,6)"),
        spark.createDataFrame([], BALANCE))


def _refused(orders, lines, receipts):
    """Codes of refused receipts, one for each pair of order and line rows, by plain loops."""
    met, codes = [], Counter()
    for rid, line, po, qty, _ in receipts:
        for o in [o for o in orders if po is not None and o[0] == po] or [None]:
            for ln in [x for x in lines if line is not None and x[0] == line] or [None]:
                code = ("M4002" if qty is None or qty <= 0 else "M4001" if o is None else "M4002" if o[1] not in ("APPROVED", "PARTIAL")
                        else "M4001" if ln is None else "M4002" if ln[6] in ("CLOSED", "CANCELLED") else None)
                if code:
                    codes[rid, code] += 1
                else:
                    met.append((line, rid, qty, ln))
    had = {}
    for line, rid, qty, ln in sorted(met, key=lambda r: r[:2]):
        have = had.setdefault(line, ln[4])
        if have >= ln[3] or have + qty > ln[3]:
            codes[rid, "M4002" if have >= ln[3] else "M4003"] += 1
        else:
            had[line] = have + qty
    return codes, had


@pytest.mark.parametrize("twice", [False, True])
def test_receipts_are_refused_by_the_first_rule_that_fails(spark, twice):
    rows, frames = _po(spark, twice)
    out = procurement.receive_po_lines(*frames, "2026-01-01", post_stock=False)
    codes, had = _refused(*rows)
    assert Counter((r.receipt_id, r.error_code) for r in out["rejects"].collect()) == codes
    if not twice:
        assert {r.po_line_id: r.qty_received for r in out["lines"].collect()} == {ln[0]: had.get(ln[0], ln[4]) for ln in rows[1]}


def test_refused_receipts_meet_no_order_lines_again(spark):
    _, frames = _po(spark)
    out = procurement.receive_po_lines(*frames, "2026-01-01", post_stock=False)
    assert "Join" not in plan(out["rejects"]) and "hashpartitioning" not in plan(out["rejects"])


@pytest.fixture
def shuffled_sides(spark):
    """No side is small enough for a broadcast."""
    spark.conf.set("spark.millrace.broadcastRows", "0")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.millrace.broadcastRows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def _prices(spark):
    rng = random.Random(11)
    items = spark.createDataFrame([(i, f"c{i % 3}", Decimal(100 + i)) for i in range(30)], "item_id long, category_id string, list_price decimal(20,4)")
    customers = spark.createDataFrame([(c, c % 3 + 1 if c % 4 else None) for c in range(20)], "customer_id long, price_list_id int")
    lists = spark.createDataFrame([(1, "Y", "Y"), (2, "N", "Y"), (3, "N", "N")], "price_list_id int, is_default string, is_active string").withColumns(
        {"valid_from": F.to_date(F.lit("1990-01-01")), "valid_to": F.lit(None).cast("date")})
    rules = [(f"i{i}-{n}", 1 + i % 2, i, None, None, Decimal(n * 5), Decimal(n * 5 + 9) if n else None, "LIST", Decimal(50 + i - n), 10 - n) for i in range(0, 30, 2) for n in range(3)]
    rules += [(f"c{c}", 2, None, None, c, Decimal(0), None, "DISCOUNT_AMT", Decimal(7), 5) for c in range(0, 20, 3)]
    rules += [(f"k{k}", 1, None, f"c{k}", None, Decimal(2), None, "DISCOUNT_PCT", Decimal("0.1"), 50) for k in range(2)]
    rules = spark.createDataFrame(rules, "rule_id string, price_list_id int, item_id long, category_id string, customer_id long, min_qty decimal(18,4), max_qty decimal(18,4), "
                                  "rule_type string, price_value decimal(20,6), priority int").withColumns(
        {"valid_from": F.to_date(F.lit("1990-01-01")), "valid_to": F.lit(None).cast("date"), "is_active": F.lit("Y")})
    orders = spark.createDataFrame([(o, rng.randrange(20), rng.choice(["DRAFT", "CONFIRMED", "CLOSED"]), Decimal(o)) for o in range(80)],
                                   "so_id long, customer_id long, status string, total_amount decimal(20,4)")
    lines = spark.createDataFrame([(f"l{n % 290}", rng.randrange(80), rng.randrange(31), Decimal(rng.randrange(1, 20)), Decimal(3), Decimal("0.5"), rng.choice(["OPEN", "CANCELLED"]))
                                   for n in range(300)], "so_line_id string, so_id long, item_id long, qty_ordered decimal(18,4), unit_price decimal(20,6), discount_pct decimal(8,4), line_status string")
    return orders, lines, items, customers, lists, rules


def test_prices_by_steps_are_those_of_one_plan(spark, request):
    data = _prices(spark)
    orders, lines, *sides = data
    asked = lines.join(orders, "so_id").select(F.col("so_line_id").alias("request_id"), "item_id", "customer_id", F.col("qty_ordered").alias("qty"))
    rows = lambda *frames: [sorted(map(tuple, f.collect()), key=repr) for f in frames]
    run = lambda: rows(pricing.price(asked, *sides, "2026-01-01"), *pricing.reprice_orders(*data, "2026-01-01"))
    one = run()
    request.getfixturevalue("shuffled_sides")
    priced = pricing.price(asked, *sides, "2026-01-01")
    assert plan(priced).partition("== Physical Plan ==")[2].count("SortMergeJoin") == 1, "one large side a step"
    assert rows(priced) == one[:1]
    assert run() == one
    assert len({r[-1] for r in one[0]}) > 2


def test_repriced_lines_are_joined_once_and_rejects_price_nothing(spark, shuffled_sides, monkeypatch):
    data, calls = _prices(spark), []
    monkeypatch.setattr(pricing, "price", lambda *a, f=pricing.price: calls.append(1) or f(*a))
    out = pricing.reprice_orders(*data, "2026-01-01")
    assert out[2].count() and not calls
    assert "Join" not in plan(out[1]).partition("== Physical Plan ==")[2]
    assert out[0].count() == 80 and len(calls) == 1
    orders, lines, rejects = out
    assert lines is out[1] and rejects is out[2] and len(calls) == 1


class _State:
    """A list or value state that counts its elements."""

    def __init__(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[0] if self.single else iter(self.held)

    def update(self, value):
        self.held = [value]

    def put(self, values):
        self.held = list(values)

    def appendList(self, values):
        self.held += values

    def clear(self):
        self.held = []

    def registerTimer(self, at):
        self.timer = at


def test_rows_that_wait_in_a_stream_are_few_state_elements():
    bucket = _BucketAverage("string")
    bucket.settled, bucket.buffer, bucket.handle = _State(), _State(), _State()
    bucket.settled.single, bucket.buffer.single = True, False
    at = lambda ms: type("Timers", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    rows = [(f"k{i % 3}", 1000 * (i % 700 + 1), f"s{i:05d}", 10_000 * (i % 5 - 1), 10_000 * max(i % 5 - 1, 0), 1_000_000 * (i % 7), int(i % 5 > 1)) for i in range(25_000)]
    list(bucket.handleInputRows((1,), iter([pd.DataFrame(rows, columns=bucket.ROW)]), at(0)))
    assert len(bucket.buffer.held) == 3 and sorted(bucket._waiting()) == sorted(rows)
    list(bucket.handleExpiredTimer((1,), at(400), None))
    assert len(bucket.buffer.held) == 2 and sorted(bucket._waiting()) == sorted(r for r in rows if r[1] > 400_000)
    want = {k: bucket._folded((0, 0, 0), [r[1:] for r in rows if r[0] == k and r[1] <= 400_000]) for k in ("k0", "k1", "k2")}
    assert bucket._known().keys() == want.keys() and {k: tuple(v) for k, v in bucket._known().items()} == want
