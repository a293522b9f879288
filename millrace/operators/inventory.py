"""Inventory movements: FIFO allocation, balances, receipts, counts, transfers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import doc_no
from millrace.operators.common import split_by_rules
from millrace.operators.costing import sync_balance
from millrace.operators.fold import ordered_fold
from millrace.operators.ordered import is_hot, row_numbers, running_sums
from millrace.session import discard, materialize, materialize_counted

KEY = ["item_id", "warehouse_id"]
QTY = "decimal(18,4)"
COST = "decimal(20,6)"


def scaled(col: Column, digits: int) -> Column:
    """A decimal as a whole number with ``digits`` implied decimals, null as 0."""
    return F.coalesce((col * F.lit(10 ** digits)).cast("bigint"), F.lit(0).cast("bigint"))


def unscaled(name: str, digits: int, kind: str) -> Column:
    return (F.col(name).cast("decimal(20,0)") / F.lit(10 ** digits)).cast(kind)


def _half_away(num: int, den: int) -> int:
    if den < 0:
        num, den = -num, -den
    whole = (2 * abs(num) + den) // (2 * den)
    return whole if num >= 0 else -whole


def available_qty(balances: DataFrame, keys: DataFrame) -> DataFrame:
    """On hand minus allocated for each requested key; no balance row means 0."""
    have = balances.select(*KEY, (F.col("qty_on_hand") - F.col("qty_allocated")).cast(QTY).alias("__a"))
    return keys.join(have, KEY, "left").withColumn("available", F.coalesce("__a", F.lit(0)).cast(QTY)).drop("__a")


def _admit_step(state, row):
    """Greedy admission: a request is served only if the rest of the balance covers it."""
    (rest,), (qty,) = state, row
    if qty <= rest:
        return (rest - qty,), (1, rest)
    return (rest,), (0, rest)


def admit_requests(requests: DataFrame, balances: DataFrame, order: list[str], hot: bool | None = None) -> DataFrame:
    """Mark each request accepted or not, in order, against the running balance.

    A refused request takes nothing, so later smaller ones may still pass: the
    decision depends on every earlier decision for the same key. It is simple where the
    whole demand of a key fits its balance: all pass, and what is left before a request
    is a running sum. One aggregate tells these keys apart; only the rows of contended
    keys go through the ordered fold.
    """
    asked = requests.groupBy(*KEY).agg(F.sum("qty").alias("__asked"))
    keys = materialize(available_qty(balances, asked), "demand-of-keys")
    calm = keys.filter(F.col("__asked") <= F.col("available")).select(*KEY, "available")
    tight = keys.filter(~(F.col("__asked") <= F.col("available"))).select(*KEY, "available")
    hot = is_hot(requests, KEY) if hot is None else hot
    by = [F.col(c) for c in order]
    easy = running_sums(requests.join(calm, KEY), KEY, by, {"__run": F.col("qty").cast("decimal(28,4)")}, hot)
    easy = easy.select(
        *requests.columns, F.lit(True).alias("accepted"),
        (F.col("available") - F.col("__run") + F.col("qty")).cast(QTY).alias("available_before"))
    base = requests.join(tight, KEY).withColumns({
        "__qty": scaled(F.col("qty"), 4), "__avail": scaled(F.col("available"), 4)})
    carried = [c for c in requests.columns if c not in KEY]
    folded = ordered_fold(
        base, KEY, by, ["__qty"], ["__avail"], _admit_step,
        [("__ok", "bigint"), ("__before", "bigint")], carried, additive=[True], hot=hot)
    return easy.unionByName(folded.select(
        *requests.columns, (F.col("__ok") == 1).alias("accepted"),
        unscaled("__before", 4, QTY).alias("available_before")))


def _fill_segments(lot: DataFrame, dem: DataFrame) -> DataFrame:
    """Segments of ordinary-sized keys: from the far end of the axis backwards,
    every cut belongs to the last lot and the last demand seen. One shuffle."""
    pack = lambda df, size: F.struct(*[c for c in df.columns if c not in (*KEY, "__hi")], (F.col("__hi") - F.col(size)).alias("__lo"))
    lots = lot.select(*KEY, F.col("__hi").alias("__cut"), pack(lot, "avail").alias("__lot"))
    dems = dem.select(*KEY, F.col("__hi").alias("__cut"), pack(dem, "qty").alias("__dem"))
    back = Window.partitionBy(*KEY).orderBy(F.col("__cut").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seg = lots.unionByName(dems, allowMissingColumns=True).select(
        *KEY, "__cut", F.last("__lot", ignorenulls=True).over(back).alias("__lot"), F.last("__dem", ignorenulls=True).over(back).alias("__dem"))
    flat = seg.filter(F.col("__lot").isNotNull() & F.col("__dem").isNotNull()).select(
        *KEY, "__cut", "__lot.*", F.col("__lot.__lo").alias("__lot_lo"), F.col("__dem.__lo").alias("__dem_lo"),
        *[F.col(f"__dem.{c}").alias(c) for c in dem.columns if c not in (*KEY, "__hi")]).drop("__lo")
    take = (F.col("__cut") - F.greatest("__lot_lo", "__dem_lo")).cast(QTY)
    return flat.withColumn("taken", take).filter(F.col("taken") > 0)


def fifo_overlap(lots: DataFrame, demands: DataFrame, lot_order: list[str], demand_order: list[str]) -> DataFrame:
    """Pair lots with demands first-in first-out, linear in lots + demands.

    Both sides become consecutive intervals on the key's quantity axis. Cutting
    the axis at every interval end gives segments that each lie in exactly one
    lot and one demand; the ordinal of either is one plus the number of its
    ends before the segment, a running count. No lot x demand pairs are formed,
    however many rows one key has.
    """
    hot = is_hot(lots.select(*KEY).unionByName(demands.select(*KEY)), KEY)
    lot = running_sums(lots, KEY, [F.col(c) for c in lot_order],
                       {"__hi": F.col("avail").cast("decimal(28,4)"), "__lot_no": F.lit(1).cast("long")}, hot)
    dem = running_sums(demands, KEY, [F.col(c) for c in demand_order],
                       {"__hi": F.col("qty").cast("decimal(28,4)"), "__dem_no": F.lit(1).cast("long")}, hot)
    if not hot:
        return _fill_segments(lot, dem)
    side = lambda df, is_lot: df.groupBy(*KEY, "__hi").agg(F.count(F.lit(1)).alias("__n")).select(
        *KEY, F.col("__hi").alias("__cut"),
        (F.col("__n") if is_lot else F.lit(0).cast("long")).alias("__lots"),
        (F.lit(0).cast("long") if is_lot else F.col("__n")).alias("__dems"))
    cuts = side(lot, True).unionByName(side(dem, False)).groupBy(*KEY, "__cut").agg(
        F.sum("__lots").alias("__lots"), F.sum("__dems").alias("__dems"))
    run = running_sums(cuts, KEY, [F.col("__cut")], {"__cum_lots": F.col("__lots"), "__cum_dems": F.col("__dems")}, hot)
    seg = run.select(
        *KEY, F.col("__cut"),
        (F.col("__cum_lots") - F.col("__lots") + 1).alias("__lot_no"),
        (F.col("__cum_dems") - F.col("__dems") + 1).alias("__dem_no"))
    # A segment ends at its cut and starts at the later of the two interval starts.
    lot = lot.withColumn("__lot_lo", F.col("__hi") - F.col("avail")).drop("__hi")
    dem = dem.withColumn("__dem_lo", F.col("__hi") - F.col("qty")).drop("__hi")
    paired = seg.join(lot, [*KEY, "__lot_no"]).join(dem, [*KEY, "__dem_no"])
    take = (F.col("__cut") - F.greatest("__lot_lo", "__dem_lo")).cast(QTY)
    return paired.withColumn("taken", take).filter(F.col("taken") > 0)


def fifo_allocate(
    lots: DataFrame, requests: DataFrame, balances: DataFrame, order: list[str], as_of=None,
    txn_type: str = "ISSUE",
) -> dict[str, DataFrame]:
    """Issue stock first-in first-out for many requests.

    ``requests``: request_id, item_id, warehouse_id, qty and the ``order``
    columns. Returns ``allocations``, the ``lots`` and ``balances`` after them, the ledger
    ``txns`` and the ``rejects`` (M3005 quantity, M3001 not enough). Requests the
    balance allows but the lots cannot fill are in ``short`` with what is missing.
    """
    valid, bad = split_by_rules(requests, [("M3005", F.col("qty") > 0, "quantity must be positive")])
    admitted = materialize(admit_requests(valid, balances, order), "admitted")
    refused = admitted.filter(~F.col("accepted")).drop("accepted").withColumns({
        "error_code": F.lit("M3001"),
        "error_msg": F.concat(F.lit("available="), F.col("available_before").cast("string"),
                              F.lit(" need="), F.col("qty").cast("string"))})
    served = admitted.filter("accepted").drop("accepted")
    free = (F.col("qty_on_hand") - F.col("qty_allocated")).cast(QTY)
    open_lots = lots.filter((F.col("status") == "AVAILABLE") & (free > 0)).select(
        *KEY, "lot_id", "lot_no", "unit_cost", "receipt_date", free.alias("avail"))
    pairs = fifo_overlap(open_lots, served, ["receipt_date", "lot_id"], order)
    allocations = pairs.select(
        "request_id", *KEY, "lot_id", "lot_no", F.col("taken").alias("qty"), "unit_cost",
        F.round(F.col("taken") * F.col("unit_cost"), 4).cast("decimal(20,4)").alias("alloc_cost"),
        # Quantity before this lot is drawn: the balance seen by the request,
        # minus what the request already took from earlier lots.
        (F.col("available_before") - (F.greatest("__lot_lo", "__dem_lo") - F.col("__dem_lo"))).cast(QTY).alias("qty_before"),
    )
    # lots, balances, ledger rows and what is short all come from it: the overlap is made once
    allocations = materialize(allocations, "allocations")
    used = allocations.groupBy("lot_id").agg(F.sum("qty").cast(QTY).alias("__used"))
    left = (F.col("qty_on_hand") - F.coalesce("__used", F.lit(0))).cast(QTY)
    new_lots = lots.join(used, "lot_id", "left").withColumns({
        "qty_on_hand": left,
        "status": F.when(F.col("__used").isNotNull() & (left == 0), "CONSUMED").otherwise(F.col("status")),
    }).drop("__used")
    txns = allocations.select(
        *KEY, "lot_id", F.col("request_id").alias("ref_doc_id"), F.lit(txn_type).alias("txn_type"),
        F.lit("O").alias("direction"), F.col("qty").alias("quantity"), "unit_cost",
        F.round(F.col("qty") * F.coalesce("unit_cost", F.lit(0).cast(COST)), 4).cast("decimal(20,4)").alias("total_cost"),
        "qty_before", (F.col("qty_before") - F.col("qty")).cast(QTY).alias("qty_after"),
        F.lit(as_of).cast("date").alias("txn_date"))
    got = allocations.groupBy("request_id").agg(F.sum("qty").alias("__got"))
    short = served.join(got, "request_id", "left").withColumn(
        "short_qty", (F.col("qty") - F.coalesce("__got", F.lit(0))).cast(QTY)).filter("short_qty > 0").drop("__got")
    rejects = bad.unionByName(refused.drop("available_before"))
    drawn = allocations.groupBy(*KEY).agg(F.sum("qty").cast(QTY).alias("__drawn"))
    after = balances.join(drawn, KEY, "left").withColumn("qty_on_hand", (F.col("qty_on_hand") - F.coalesce("__drawn", F.lit(0))).cast(QTY)).drop("__drawn")
    return {"allocations": allocations, "lots": new_lots, "txns": txns, "rejects": rejects, "short": short, "balances": after.select(balances.columns)}


def post_ledger(movements: DataFrame, as_of, order: list[str], start_seq: int = 0) -> DataFrame:
    """Ledger rows with total cost and a document number IT + date + sequence."""
    numbered = row_numbers(movements, [], [F.col(c) for c in order], "__seq")
    day = F.lit(as_of).cast("date")
    cost = F.coalesce("unit_cost", F.lit(0).cast(COST))
    seq = F.col("__seq") + start_seq
    return numbered.withColumns({
        "txn_id": seq, "txn_no": doc_no("IT", day, seq), "txn_date": day,
        "total_cost": F.round(F.col("quantity") * cost, 4).cast("decimal(20,4)")}).drop("__seq")


def _average_step(state, row):
    """Moving average after one movement; whole numbers (4-digit qty, 6-digit cost)."""
    avg, exists = state
    before, in_qty, in_cost, has_cost = row
    if not exists:
        avg = in_cost if has_cost else 0
    elif has_cost and before + in_qty > 0:
        avg = _half_away(before * avg + in_qty * in_cost, before + in_qty)
    return (avg, 1), (avg,)


def _average_row(state, row):
    """:func:`_average_step` with the average as whole state; ``fresh`` marks the first row of a key without a balance."""
    *given, fresh = row
    (avg, _), out = _average_step((state[0], not fresh), given)
    return (avg,), out


def _average_near(state, offsets, row):
    """Averages that lie ``offsets`` from ``state``, after one movement, relative to the new one."""
    before, in_qty, in_cost, has_cost, fresh = row
    total = before + in_qty
    if fresh:
        return np.zeros_like(offsets), 0.0
    if not has_cost or total <= 0:
        return offsets, 1.0
    num, far = before * state[0] + in_qty * in_cost, int(max(abs(offsets[0]), abs(offsets[-1]), 1))
    if abs(num) < abs(before) * far:  # the value to be rounded may change its sign
        new = _half_away(num, total)
        return np.array([_half_away(num + before * d, total) - new for d in offsets.tolist()]), before / total
    sign = 1 if num >= 0 else -1
    rest = (2 * abs(num) + total) % (2 * total)
    wide = 2 * abs(before) * far + 2 * total >= 2 ** 62
    moved = (rest + sign * 2 * before * (offsets.astype(object) if wide else offsets)) // (2 * total)
    return (sign * moved).astype(np.int64), before / total


def _quantities(movements: DataFrame, start: DataFrame, order: list[str], hot: bool, delta: str = "delta_qty") -> DataFrame:
    """Movements with qty_before, qty_after and their number ``__n`` in their key."""
    moves = movements.join(start, KEY, "left")
    moves = running_sums(moves, KEY, [F.col(c) for c in order], {"__after": F.col(delta), "__n": F.lit(1).cast("long")}, hot)
    after = (F.coalesce("__q0", F.lit(0)) + F.col("__after")).cast(QTY)
    return moves.withColumns({"qty_after": after, "qty_before": (after - F.col(delta)).cast(QTY)})


def _averaged(moves: DataFrame, order: list[str], hot: bool, carried: list[str], in_qty: str = "in_qty", in_cost: str = "in_cost", last_only: bool = False) -> DataFrame:
    """``carried`` columns of each of :func:`_quantities` and the average after it; no other column passes the fold.
    ``last_only``: enough rows to find the last of each key."""
    has = F.coalesce("__has", F.lit(0).cast("bigint"))
    moves = moves.withColumns({
        "__b": scaled(F.col("qty_before"), 4), "__i": scaled(F.col(in_qty), 4), "__c": scaled(F.col(in_cost), 6),
        "__hc": F.when(F.col(in_cost).isNull(), 0).otherwise(1).cast("bigint"),
        "__avg0": scaled(F.col("__a0"), 6), "__fresh": ((has == 0) & (F.col("__n") == 1)).cast("bigint")})
    folded = ordered_fold(moves, KEY, [F.col(c) for c in order], ["__b", "__i", "__c", "__hc", "__fresh"], ["__avg0"],
                          _average_row, [("__avg", "bigint")], [*carried, "qty_before", "qty_after", "__n"], hot=hot, near=_average_near, last_only=last_only)
    return folded.withColumn("avg_cost_after", unscaled("__avg", 6, COST)).drop("__avg")


def _moved_balances(balances: DataFrame, trail: DataFrame, as_of) -> DataFrame:
    """Balances after the last movement of each key in ``trail`` (:func:`_averaged`)."""
    last = trail.groupBy(*KEY).agg(
        F.max_by(F.struct("qty_after", "avg_cost_after"), F.col("__n")).alias("__l"), F.max("__n").alias("__moves"))
    joined = balances.withColumn("__old", F.lit(True)).join(last, KEY, "full")
    fresh = F.col("__old").isNull()
    day = F.lit(as_of).cast("date")
    moved = F.col("__l").isNotNull()
    return joined.select(
        *KEY, F.when(moved, F.col("__l.qty_after")).otherwise(F.col("qty_on_hand")).cast(QTY).alias("qty_on_hand"),
        F.coalesce("qty_allocated", F.lit(0)).cast(QTY).alias("qty_allocated"),
        F.when(moved, F.col("__l.avg_cost_after")).otherwise(F.col("avg_cost")).cast(COST).alias("avg_cost"),
        F.when(moved, day).otherwise(F.col("last_txn_date")).alias("last_txn_date"),
        F.when(fresh, F.col("__moves") - 1).otherwise(F.col("version") + F.coalesce("__moves", F.lit(0))).cast("int").alias("version"))


def _opening(balances: DataFrame) -> DataFrame:
    return balances.select(
        *KEY, F.col("qty_on_hand").alias("__q0"), F.col("avg_cost").alias("__a0"), F.lit(1).cast("bigint").alias("__has"))


def apply_movements(balances: DataFrame, movements: DataFrame, order: list[str], as_of=None) -> tuple[DataFrame, DataFrame]:
    """Next balances, and every movement with quantity before/after and average.

    ``movements``: item_id, warehouse_id, delta_qty, in_qty, in_cost (nullable)
    and the unique ``order`` columns. Quantities are running sums; only the
    average, which is rounded to six places at every receipt, needs the fold. A hot
    key's ranges are composed as step functions of the average before them. The balances
    fold quantities and costs alone; the trail takes the other columns along.
    """
    hot = is_hot(movements, KEY)
    moves = _quantities(movements, _opening(balances), order, hot)
    trail = _averaged(moves, order, hot, [c for c in movements.columns if c not in KEY])
    narrow = trail if hot else _averaged(moves, order, hot, [], last_only=True)
    return _moved_balances(balances, narrow, as_of), trail.drop("__n")


def receive_stock(receipts: DataFrame, balances: DataFrame, order: list[str], as_of, *,
                  txn_type: str = "RECV", start_lot: int = 0, ref: str | None = None) -> dict[str, DataFrame]:
    """New lots, ledger rows and balances for receipts; bad quantities rejected.

    ``receipts``: item_id, warehouse_id, qty, unit_cost, lot_no (nullable) and
    the unique ``order`` columns. ``ref`` names a column that the ledger rows keep
    as their document. Receipts are put in order and numbered once; the number then
    stands for the order, so nothing by key carries the order columns. Ledger rows need
    running quantities, balances the folded average too.
    """
    good, bad = split_by_rules(receipts, [("M3005", F.col("qty") > 0, "received quantity must be positive")])
    day = F.lit(as_of).cast("date")
    wanted = [*KEY, "qty", "unit_cost", "lot_no", *order, *([ref] if ref else [])]
    numbered = row_numbers(good.select(*dict.fromkeys(wanted)), [], [F.col(c) for c in order], "__seq")
    posted = ["lot_no", *([ref] if ref else [])]
    numbered = numbered.select(
        *KEY, (F.col("__seq") + start_lot).alias("lot_id"), "qty", F.coalesce("unit_cost", F.lit(0)).cast(COST).alias("unit_cost"),
        *[c for c in posted if c not in KEY])
    hot = is_hot(numbered, KEY)
    moves = _quantities(numbered, _opening(balances), ["lot_id"], hot, "qty")
    trail = _averaged(moves, ["lot_id"], hot, [], "qty", "unit_cost", last_only=True)
    lots = numbered.select(
        "lot_id", F.coalesce("lot_no", doc_no("LOT", day, F.col("lot_id"))).alias("lot_no"), *KEY,
        F.col("qty").cast(QTY).alias("qty_on_hand"), F.lit(0).cast(QTY).alias("qty_allocated"), "unit_cost",
        day.alias("receipt_date"), F.lit("AVAILABLE").alias("status"))
    txns = moves.select(
        F.col("lot_id").alias("txn_id"), doc_no("IT", day, F.col("lot_id")).alias("txn_no"), *KEY, "lot_id",
        F.lit(txn_type).alias("txn_type"), F.lit("I").alias("direction"), F.col("qty").cast(QTY).alias("quantity"), "unit_cost",
        F.round(F.col("qty") * F.col("unit_cost"), 4).cast("decimal(20,4)").alias("total_cost"),
        "qty_before", "qty_after", day.alias("txn_date"), *([F.col(ref).alias("ref_doc_id")] if ref else []))
    return {"lots": lots, "txns": txns, "balances": _moved_balances(balances, trail, as_of), "rejects": bad}


def receive_stock_by_code(receipts: DataFrame, items: DataFrame, warehouses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve item and warehouse codes; cost defaults to the standard cost."""
    known = receipts.join(items.select("item_code", "item_id", "std_cost"), "item_code", "left").join(
        warehouses.select("warehouse_code", "warehouse_id"), "warehouse_code", "left")
    good, bad = split_by_rules(known, [
        ("M1001", F.col("item_id").isNotNull(), "item code not found"),
        ("M3004", F.col("warehouse_id").isNotNull(), "warehouse code not found")])
    return good.withColumnRenamed("std_cost", "unit_cost"), bad


def bulk_receive(lines: DataFrame, items: DataFrame, warehouses: DataFrame, balances: DataFrame, order: list[str], as_of) -> dict[str, DataFrame]:
    """Receive a batch in which bad rows do not stop the good ones; with counts."""
    marked = (
        lines.join(items.select("item_id", F.lit(True).alias("__item")), "item_id", "left")
        .join(warehouses.select("warehouse_id", F.lit(True).alias("__wh")), "warehouse_id", "left"))
    good, bad = split_by_rules(marked, [
        ("M3005", (F.col("qty") > 0) & F.col("__item") & F.col("__wh"), "row violates a lot constraint")])
    done = receive_stock(good.drop("__item", "__wh"), balances, order, as_of)
    counts = marked.agg(
        F.count_if((F.col("qty") > 0) & F.col("__item") & F.col("__wh")).alias("ok_count"),
        F.count(F.lit(1)).alias("total")).select("ok_count", (F.col("total") - F.col("ok_count")).alias("fail_count"))
    return {**done, "rejects": bad.drop("__item", "__wh"), "counts": counts}


def adjust_stock(counts: DataFrame, lots: DataFrame, balances: DataFrame, as_of, start_lot: int = 0) -> dict[str, DataFrame]:
    """Bring stock to the counted quantity (one count per key).

    A gain becomes a new lot at average cost, a loss is drawn first-in first-out;
    both are ADJ movements, and the touched balances are rebuilt from the lots.
    """
    good, bad = split_by_rules(counts, [("M3005", F.col("counted") >= 0, "counted quantity must not be negative")])
    diff = available_qty(balances, good).withColumn("diff", (F.col("counted") - F.col("available")).cast(QTY))
    diff = diff.filter(F.col("diff") != 0).join(balances.select(*KEY, F.col("avg_cost").alias("__avg")), KEY, "left")
    diff = materialize(diff, "counts")
    gains = diff.filter("diff > 0").select(
        *KEY, F.col("diff").alias("qty"), F.coalesce("__avg", F.lit(0)).cast(COST).alias("unit_cost"), F.lit(None).cast("string").alias("lot_no"))
    losses = diff.filter("diff < 0").select(
        F.concat_ws("/", *KEY).alias("request_id"), *KEY, (-F.col("diff")).cast(QTY).alias("qty"))
    got = receive_stock(gains, balances, KEY, as_of, txn_type="ADJ", start_lot=start_lot)
    drawn = fifo_allocate(lots, losses, balances, ["request_id"], as_of, txn_type="ADJ")
    new_lots = drawn["lots"].select("lot_id", "lot_no", *KEY, "qty_on_hand", "qty_allocated", "unit_cost", "receipt_date", "status")
    new_lots = new_lots.withColumn("lot_id", F.col("lot_id").cast("string")).unionByName(
        got["lots"].withColumn("lot_id", F.col("lot_id").cast("string")))
    touched = diff.select(*KEY)
    rebuilt = sync_balance(new_lots.join(touched, KEY, "left_semi"), balances.join(touched, KEY, "left_semi"), as_of)
    kept = balances.join(touched, KEY, "left_anti").select(rebuilt.columns)
    cols = [*KEY, "txn_type", "direction", "quantity", "unit_cost", "total_cost", "qty_before", "qty_after", "txn_date"]
    txns = got["txns"].select(cols).unionByName(drawn["txns"].select(cols))
    return {"lots": new_lots, "balances": kept.unionByName(rebuilt), "txns": txns, "rejects": bad, "short": drawn["short"]}


def transfer_stock(moves: DataFrame, lots: DataFrame, balances: DataFrame, order: list[str], as_of, full_quantity: bool = False, start_lot: int = 0) -> dict[str, DataFrame]:
    """Move stock between warehouses at the weighted cost of the lots drawn.

    ``moves``: move_id, item_id, from_wh, to_wh, qty and the ``order`` columns. What the
    lots gave arrives (``inbound``) and the rest is in ``short``, so no quantity is made;
    ``full_quantity=True`` lets the asked quantity arrive and leave the source balance,
    whatever the lots gave. Every arrival is a lot of its own in ``target_lots``, numbered
    in move order from ``start_lot`` + 1; ``txns_in`` names that lot and the quantity of
    its key before and after, as ``txns_out`` does for the lots drawn. ``balances`` holds
    both sides.
    """
    good, bad = split_by_rules(moves, [
        ("M3004", F.col("from_wh") != F.col("to_wh"), "warehouses must differ"),
        ("M3005", F.col("qty") > 0, "quantity must be positive")])
    requests = good.select(
        F.col("move_id").alias("request_id"), "item_id", F.col("from_wh").alias("warehouse_id"), "qty",
        *[c for c in order if c not in ("move_id", "item_id", "qty")])
    out = fifo_allocate(lots, requests, balances, ["request_id" if c == "move_id" else c for c in order], as_of, txn_type="XFER_OUT")
    cost = out["allocations"].groupBy("request_id").agg(F.sum("alloc_cost").cast("decimal(24,4)").alias("__cost"), F.sum("qty").cast(QTY).alias("__moved"))
    refused = out["rejects"].select(F.col("request_id").alias("move_id"))
    total = F.coalesce("__cost", F.lit(0).cast("decimal(24,4)"))
    moved = F.col("qty") if full_quantity else F.coalesce("__moved", F.lit(0))
    inbound = (
        good.join(refused, "move_id", "left_anti").join(cost, F.col("move_id") == cost["request_id"], "left").withColumn("__in", moved.cast(QTY)).filter("__in > 0").select(
            "move_id", "item_id", F.col("to_wh").alias("warehouse_id"), F.col("__in").alias("qty"),
            F.round(total / F.col("__in").cast("decimal(14,4)"), 6).cast(COST).alias("unit_cost"),
            *[c for c in order if c not in ("move_id", "item_id", "qty")]))
    inbound = materialize(inbound, "inbound")
    short = out["short"].select(F.col("request_id").alias("move_id"), "item_id", "warehouse_id", "short_qty")
    left = out["balances"]
    if full_quantity:  # what arrives without a lot leaves the source all the same
        short = materialize(short, "short")
        owed = short.groupBy(*KEY).agg(F.sum("short_qty").cast(QTY).alias("__owed"))
        left = left.join(owed, KEY, "left").withColumn("qty_on_hand", (F.col("qty_on_hand") - F.coalesce("__owed", F.lit(0))).cast(QTY)).select(left.columns)
    got = receive_stock(inbound.withColumn("lot_no", F.lit(None).cast("string")), left, order, as_of, txn_type="XFER_IN", start_lot=start_lot, ref="move_id")
    txns_in = got["txns"].select(out["txns"].columns)
    rejects = bad.select("move_id", "error_code").unionByName(
        out["rejects"].select(F.col("request_id").alias("move_id"), "error_code"))
    return {"allocations": out["allocations"], "lots": out["lots"], "inbound": inbound,
            "txns_out": out["txns"], "txns_in": txns_in, "rejects": rejects, "short": short,
            "target_lots": got["lots"], "balances": got["balances"]}


def archive_txns(txns: DataFrame, before) -> tuple[DataFrame, DataFrame, str]:
    """Split the ledger at a date: (archive rows, remaining rows, archive name); rows without a date remain."""
    old = F.coalesce(F.col("txn_date") < F.lit(before).cast("date"), F.lit(False))
    name = "t_inv_txn_arch_" + str(before)[:7].replace("-", "")
    return txns.filter(old), txns.filter(~old), name


def write_archive(txns: DataFrame, before, archive_root: str, ledger_path: str) -> int:
    """Write the archive and the remaining ledger, both by month; returns the archived count.

    The remainder goes to ``ledger_path``, which must not be the folder ``txns``
    is read from, so a failure at any point leaves the old ledger untouched.
    """
    from millrace.sources.files import write_ledger

    old, rest, name = archive_txns(txns, before)
    target = f"{archive_root.rstrip('/')}/{name}"
    write_ledger(old, target, mode="errorifexists", grain="month")
    write_ledger(rest, ledger_path, mode="errorifexists", grain="month")
    return txns.sparkSession.read.parquet(target).count()


def archive_ledger(spark: SparkSession, ledger_path: str, before, archive_root: str) -> str:
    """Move the rows before a date out of a ledger kept by month (:func:`write_ledger`); returns the archive's folder.

    Whole months before the date are moved as files. Of the month that the date cuts, the
    old rows are written to the archive and the month is then overwritten with the others,
    so one month at most is read and rewritten, whatever the ledger holds. Each cut has a
    folder of its own in the archive. A job that fails half way is run again with the same date:
    the old rows leave the ledger only after they are in the archive, and rows that a
    first try left there are not added again. Rows that came late to a month already
    archived join it.
    """
    from millrace.sources.files import move_period, periods, read_if_there, write_ledger

    day, ledger_path = str(before), ledger_path.rstrip("/")
    cut = f"txn_month={day[:4]}{day[5:7]}"
    found = periods(spark, ledger_path)
    whole = [p for p in found if p < cut and p[len("txn_month="):].isdigit()]
    _, _, name = archive_txns(spark.range(0).select(F.lit(None).cast("date").alias("txn_date")), before)
    target = f"{archive_root.rstrip('/')}/{name}/cut={day}"
    if cut in found and not day.endswith("-01"):
        old, rest, _ = archive_txns(spark.read.parquet(f"{ledger_path}/{cut}"), before)
        old, n_old = materialize_counted(old, "archived")
        rest, n_rest = materialize_counted(rest, "remaining")
        if n_old and n_rest:
            there = read_if_there(spark, f"{target}/{cut}")
            write_ledger(old.exceptAll(there.select(old.columns)) if there is not None else old, target, grain="month")
            write_ledger(rest, ledger_path, mode="overwrite", grain="month", only_periods=True)
        elif n_old:
            whole.append(cut)
        discard(old, rest)
    for period in whole:
        move_period(spark, period, ledger_path, target)
    return target


def reconcile_balances(txns: DataFrame, lots: DataFrame, balances: DataFrame) -> DataFrame:
    """Ledger projection, lot sum and snapshot side by side; the ledger leads."""
    sign = F.when(F.col("direction") == "I", F.col("quantity")).otherwise(-F.col("quantity"))
    ledger = txns.groupBy(*KEY).agg(F.sum(sign).cast("decimal(28,4)").alias("ledger_qty"))
    lot = lots.filter(F.col("status").isin("AVAILABLE", "QUARANTINE")).groupBy(*KEY).agg(
        F.sum("qty_on_hand").cast("decimal(28,4)").alias("lot_qty"))
    snap = balances.select(*KEY, F.col("qty_on_hand").cast("decimal(28,4)").alias("balance_qty"))
    zero = F.lit(0).cast("decimal(28,4)")
    full = ledger.join(lot, KEY, "full").join(snap, KEY, "full")
    full = full.withColumns({c: F.coalesce(c, zero) for c in ("ledger_qty", "lot_qty", "balance_qty")})
    return full.withColumns({
        "lot_delta": F.col("lot_qty") - F.col("ledger_qty"),
        "balance_delta": F.col("balance_qty") - F.col("ledger_qty")})
