"""Price lists and rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import Chain, Later, small_side, valid_at
from millrace.session import broadcast_rows, discard, materialize

WILD = ("item_id", "category_id", "customer_id")

# Most tiers of one list and key that are held in one row; rules with more are met row by row.
TIERS_IN_ROW = 4096


def pick_price_list(customers: DataFrame, lists: DataFrame, as_of) -> DataFrame:
    """customer_id, price_list_id: the customer's live list, else the default.

    Several live defaults resolve to the lowest id (flagged); none gives M6002.
    """
    live = lists.filter((F.col("is_active") == "Y") & valid_at(as_of, "valid_from", "valid_to"))
    default = live.filter(F.col("is_default") == "Y").agg(
        F.min("price_list_id").alias("id"), F.count(F.lit(1)).alias("n"))
    own = live.select(F.col("price_list_id").alias("__own"))
    joined = customers.select("customer_id", F.col("price_list_id").alias("__asked")).join(
        own, F.col("__asked") == F.col("__own"), "left")
    default_id, default_n = default.select("id").scalar(), default.select("n").scalar()
    chosen = F.coalesce("__own", default_id)
    return joined.select(
        "customer_id", chosen.alias("price_list_id"),
        F.when(F.col("__own").isNull() & (default_n > 1), "Y").otherwise("N").alias("many_defaults"),
        F.when(chosen.isNull(), "M6002").alias("error_code"))


def default_price_list(lists: DataFrame, as_of) -> Column:
    live = lists.filter((F.col("is_active") == "Y") & (F.col("is_default") == "Y")
                        & valid_at(as_of, "valid_from", "valid_to"))
    return live.agg(F.min("price_list_id")).scalar()


def _preference() -> list[Column]:
    """Lower sorts first: priority, then item-, customer-, category-specific, id."""
    unset = lambda c: F.when(F.col(f"r_{c}").isNull(), 1).otherwise(0)
    return [F.col("priority"), unset("item_id"), unset("customer_id"), unset("category_id"), F.col("rule_id")]


def _live_rules(rules: DataFrame, as_of, tiered: bool) -> DataFrame:
    """Rules in force with their class (which of item, category and customer they name) and key.

    Rules of a class that share key and tier cannot both win: for a tiered match only
    the preferred one is kept.
    """
    live = rules.filter((F.col("is_active") == "Y") & valid_at(as_of, "valid_from", "valid_to")).select(
        "rule_id", F.col("price_list_id").alias("r_list"), *[F.col(c).alias(f"r_{c}") for c in WILD],
        "min_qty", "max_qty", "rule_type", "price_value", "priority")
    if tiered:
        key = ["r_list", *[f"r_{c}" for c in WILD], "min_qty", "max_qty"]
        rest = [c for c in live.columns if c not in key]
        live = live.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("priority", "rule_id")).alias("w")).select(
            *key, *[F.col(f"w.{c}").alias(c) for c in rest])
    named = F.concat(*[F.when(F.col(f"r_{c}").isNull(), "0").otherwise("1") for c in WILD])
    return live.withColumns({"r_class": named, "r_key": F.concat_ws("\x01", *[F.col(f"r_{c}").cast("string") for c in WILD])})


def _request_key(name: str) -> Column:
    """Key of a request for the rules of class ``name``; null where it lacks a named column."""
    columns = [c for c, flag in zip(WILD, name) if flag == "1"]
    given = F.lit(True)
    for c in columns:
        given = given & F.col(c).isNotNull()
    key = F.concat_ws("\x01", *[F.col(c).cast("string") for c in columns]) if columns else F.lit("")
    return F.when(given, key)


def _candidates(requests: DataFrame, live: DataFrame, tiered: bool) -> DataFrame:
    """Request x matching rule pairs.

    A wildcard match is a theta join. Instead, rules are classed by which of item,
    category and customer they name. A request gets one key per class that has rules,
    and one equi-join on list, class and key finds the pairs.
    """
    live = small_side(live)
    classes = sorted(r["r_class"] for r in live.select("r_class").distinct().collect())  # at most eight
    both = lambda name: F.when(_request_key(name).isNotNull(), F.struct(F.lit(name).alias("q_class"), _request_key(name).alias("q_key")))
    keys = F.filter(F.array(*map(both, classes)), lambda k: k.isNotNull()) if classes else F.array().cast("array<struct<q_class:string,q_key:string>>")
    asked = requests.withColumn("__k", F.explode(keys)).select(*requests.columns, "__k.q_class", "__k.q_key")
    on = (F.col("price_list_id") == F.col("r_list")) & (F.col("q_class") == F.col("r_class")) & (F.col("q_key") == F.col("r_key"))
    if tiered:
        on = on & (F.col("min_qty") <= F.col("qty")) & (F.col("max_qty").isNull() | (F.col("max_qty") > F.col("qty")))
    return asked.join(live, on).drop("q_class", "q_key", "r_class", "r_key")


def _with_rule(requests: DataFrame, rules: DataFrame, as_of, chain: Chain) -> DataFrame:
    """``requests`` with the winning rule in ``r`` (with rule_id, rule_type, price_value; null without one).

    The tiers of one list, class and key are one row: an array in order of preference. A
    request meets one row per class that has rules (at most eight joins, none of which
    adds rows), takes the first tier there that holds its quantity, and carries on the least of
    these; a class of few tiers is broadcast, whatever the others hold, and before a class of
    many the requests are written (``chain``). A request is neither exploded nor grouped nor joined back. Should one key have more
    than ``TIERS_IN_ROW`` tiers, pairs of requests and rules are made and grouped instead.
    """
    live = _live_rules(rules, as_of, tiered=True)
    rank = [c.alias(f"o{i}") for i, c in enumerate(_preference()[:-1])]
    tier = F.struct(*rank, F.col("rule_id").alias("rule_id"), "rule_type", "price_value", "min_qty", "max_qty")
    tiers = materialize(live.groupBy("r_list", "r_class", "r_key").agg(F.sort_array(F.collect_list(tier)).alias("tiers")), "tiers") if _fits(live) else None
    if tiers is None:
        pairs = _candidates(requests, live, tiered=True)
        won = pairs.groupBy("request_id").agg(F.min_by(F.struct("rule_id", "rule_type", "price_value"), F.struct(*_preference())).alias("r"))
        return requests.join(won, "request_id", "left")
    counts = tiers.groupBy("r_class").agg(F.sum(F.size("tiers")).alias("n")).collect()  # at most eight rows
    most = broadcast_rows(requests.sparkSession)
    none = F.lit(None).cast(tiers.schema["tiers"].dataType.elementType)
    out = requests.withColumn("r", none)
    for n, name in sorted(((r["n"], r["r_class"]) for r in counts), reverse=True):
        out = chain.before(out, n)
        mine = tiers.filter(F.col("r_class") == name).select(F.col("r_list").alias("__l"), F.col("r_key").alias("__k"), F.col("tiers").alias("__t"))
        out = out.join(F.broadcast(mine) if n <= most else mine, (F.col("price_list_id") == F.col("__l")) & (_request_key(name) == F.col("__k")), "left")
        holds = lambda t: (t["min_qty"] <= F.col("qty")) & (t["max_qty"].isNull() | (t["max_qty"] > F.col("qty")))
        out = out.select(*requests.columns, F.least("r", F.get(F.filter("__t", holds), 0)).alias("r"))
    return out


def _fits(live: DataFrame) -> bool:
    """Whether the tiers of every key fit in one row."""
    return (live.groupBy("r_list", "r_class", "r_key").count().agg(F.max("count")).first()[0] or 0) <= TIERS_IN_ROW


def match_price_rules(requests: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """Winning rule per request_id.

    ``requests``: request_id, price_list_id, item_id, category_id, customer_id, qty.
    """
    return _with_rule(requests, rules, as_of, Chain()).filter(F.col("r").isNotNull()).select("request_id", "r.rule_id", "r.rule_type", "r.price_value")


def price_rejects(requests: DataFrame, items: DataFrame, customers: DataFrame, lists: DataFrame, as_of) -> DataFrame:
    """Requests that :func:`price` leaves out: M1001 unknown item, M6002 no price list."""
    picked = pick_price_list(customers, lists, as_of).select("customer_id", "price_list_id")
    known = items.select("item_id", F.lit(True).alias("__item"))
    full = requests.join(known, "item_id", "left").join(picked, "customer_id", "left")
    code = F.when(F.col("__item").isNull(), "M1001").when(F.coalesce("price_list_id", default_price_list(lists, as_of)).isNull(), "M6002")
    return full.select("request_id", code.alias("error_code")).filter(F.col("error_code").isNotNull())


def price(requests: DataFrame, items: DataFrame, customers: DataFrame, lists: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """Base and final price of every request whose item and price list exist (see :func:`price_rejects`).

    ``requests``: request_id, item_id, customer_id (nullable), qty (null means 1).
    """
    picked = pick_price_list(customers, lists, as_of).select("customer_id", "price_list_id")
    dims = items.select("item_id", "category_id", "list_price")
    chain = Chain()
    full = requests.withColumn("qty", F.coalesce("qty", F.lit(1)).cast("decimal(18,4)")).join(dims, "item_id")
    full = (
        chain.before(full, customers)
        .join(picked, "customer_id", "left")
        .withColumn("price_list_id", F.coalesce("price_list_id", default_price_list(lists, as_of)))
        .filter(F.col("price_list_id").isNotNull())
    )
    won = _with_rule(full, rules, as_of, chain)
    out = won.select(*full.columns, "r.rule_id", "r.rule_type", "r.price_value")
    listed = F.col("list_price").cast("decimal(20,6)")
    fixed = F.col("rule_type").isin("LIST", "OVERRIDE")
    base = F.when(fixed, F.col("price_value")).otherwise(listed)
    one = F.lit(1).cast("decimal(1,0)")
    final = (
        F.when(fixed, F.col("price_value"))
        .when(F.col("rule_type") == "DISCOUNT_PCT",
              F.round(F.col("list_price").cast("decimal(16,4)") * (one - F.col("price_value").cast("decimal(10,6)")), 6))
        .when(F.col("rule_type") == "DISCOUNT_AMT", F.greatest(listed - F.col("price_value"), F.lit(0).cast("decimal(20,6)")))
        .otherwise(listed)
    )
    return out.select(
        *requests.columns, "price_list_id", base.cast("decimal(20,6)").alias("base_price"),
        final.cast("decimal(20,6)").alias("final_price"), "rule_id", "rule_type")


def reprice_orders(orders, lines, items, customers, lists, rules, as_of) -> Sequence[DataFrame]:
    """Reprice DRAFT/CONFIRMED orders: (orders, lines, rejects).

    The lines are priced once, when orders or lines are first taken.

    An order with a line that cannot be priced stays as it is, lines and total. ``rejects``
    (so_id, so_line_id, status, error_code) hold those lines (M1001, M6002) and the
    orders in another status (M6001, without a line).
    """
    is_open = F.col("status").isin("DRAFT", "CONFIRMED")
    live = lines.filter(F.col("line_status") != "CANCELLED").join(
        orders.filter(is_open).select("so_id", "customer_id", "status"), "so_id")
    asked = live.select(F.col("so_line_id").alias("request_id"), "item_id", "customer_id", F.col("qty_ordered").alias("qty"), "so_id")
    failed = price_rejects(asked, items, customers, lists, as_of).withColumnRenamed("request_id", "so_line_id")
    failed = materialize(live.join(failed, "so_line_id").select("so_id", "so_line_id", "status", "error_code"), "unpriced")
    held = failed.select("so_id").distinct()
    hit = F.col("__base").isNotNull()

    @cache
    def repriced() -> DataFrame:
        priced = price(asked.join(held, "so_id", "left_anti").drop("so_id"), items, customers, lists, rules, as_of)
        base, final = F.col("base_price").cast("decimal(16,6)"), F.col("final_price").cast("decimal(16,6)")
        disc = F.when((base > 0) & (final < base), F.round((base - final) / base, 4)).otherwise(0).cast("decimal(8,4)")
        disc = F.when(disc >= 1, F.lit("0.9999").cast("decimal(8,4)")).otherwise(disc)
        upd = materialize(priced.select(F.col("request_id").alias("so_line_id"), F.col("base_price").alias("__base"), disc.alias("__disc")), "priced")
        new_lines = materialize(lines.join(upd, "so_line_id", "left").withColumns({
            "unit_price": F.when(hit, F.col("__base")).otherwise(F.col("unit_price")),
            "discount_pct": F.when(hit, F.col("__disc")).otherwise(F.col("discount_pct")),
            "__hit": hit}).drop("__base", "__disc"), "repriced")
        discard(upd)
        return new_lines

    def new_orders() -> DataFrame:
        one = F.lit(1).cast("decimal(1,0)")
        amount = F.round((F.col("qty_ordered").cast("decimal(12,4)") * F.col("unit_price").cast("decimal(16,6)"))
                         * (one - F.col("discount_pct")), 4)
        totals = repriced().filter("__hit").groupBy("so_id").agg(F.sum(amount.cast("decimal(24,4)")).alias("__total"))
        return orders.join(totals, "so_id", "left").join(held.withColumn("__held", F.lit(True)), "so_id", "left").withColumn(
            "total_amount",
            F.when(is_open & F.col("__held").isNull(), F.coalesce("__total", F.lit(0)).cast("decimal(20,4)"))
            .otherwise(F.col("total_amount"))).drop("__total", "__held")

    closed = orders.filter(~is_open).select("so_id", F.lit(None).cast(lines.schema["so_line_id"].dataType).alias("so_line_id"), "status", F.lit("M6001").alias("error_code"))
    return Later(new_orders, lambda: repriced().drop("__hit"), lambda: closed.unionByName(failed))


def effective_rules(requests: DataFrame, items: DataFrame, customers: DataFrame, lists: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """Every candidate rule of each (item, customer), in match order, no tier filter.

    The answer lists candidates, so a group is one item's candidate list.
    """
    picked = pick_price_list(customers, lists, as_of).select("customer_id", "price_list_id")
    full = (requests.join(items.select("item_id", "category_id"), "item_id").join(picked, "customer_id", "left")
            .withColumn("price_list_id", F.coalesce("price_list_id", default_price_list(lists, as_of))))
    pairs = _candidates(full, _live_rules(rules, as_of, tiered=False), tiered=False)
    seq = F.row_number().over(Window.partitionBy("request_id").orderBy(*_preference()))
    return pairs.withColumn("match_seq", seq).select(
        "request_id", "item_id", "customer_id", "rule_id", "price_list_id", "min_qty", "max_qty", "rule_type",
        "price_value", "priority", "match_seq", F.when(F.col("match_seq") == 1, "Y").otherwise("N").alias("hit_flag"))
