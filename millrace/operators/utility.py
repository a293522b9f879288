"""Units, parameters, validation, money, error log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import ERROR_CODES, UNKNOWN_NUMERIC_CODE
from millrace.functions.columns import format_with_uom, money_display, round_by_digits
from millrace.operators.common import small_side, union_all


def conversion_table(uoms: DataFrame, conversions: DataFrame) -> DataFrame:
    """(from_uom, to_uom, factor): direct, through a common base, or inverse.

    Built once from the unit dimension; where several routes exist the direct
    factor wins, then the pivot with the smallest base code, then the inverse.
    """
    ratio = lambda a, b: F.round(a / b, 10).cast("decimal(19,10)")
    direct = conversions.select("from_uom", "to_uom", F.col("factor").cast("decimal(19,10)").alias("factor"),
                                F.lit(0).alias("way"), F.lit("").alias("via"))
    f = conversions.select("from_uom", F.col("to_uom").alias("via"), F.col("factor").cast("decimal(19,8)").alias("__f"))
    t = conversions.select(F.col("from_uom").alias("to_uom"), F.col("to_uom").alias("via"), F.col("factor").cast("decimal(19,8)").alias("__t"))
    pivot = f.join(t, "via").filter(F.col("from_uom") != F.col("to_uom")).select(
        "from_uom", "to_uom", ratio(F.col("__f"), F.col("__t")).alias("factor"), F.lit(1).alias("way"), "via")
    inverse = conversions.select(F.col("to_uom").alias("from_uom"), F.col("from_uom").alias("to_uom"),
                                 ratio(F.lit(1).cast("decimal(19,8)"), F.col("factor").cast("decimal(19,8)")).alias("factor"),
                                 F.lit(2).alias("way"), F.lit("").alias("via"))
    routes = union_all([direct, pivot, inverse])
    return routes.groupBy("from_uom", "to_uom").agg(F.min_by("factor", F.struct("way", "via")).alias("factor"))


def convert_uom(df: DataFrame, uoms: DataFrame, conversions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Convert ``qty`` from ``from_uom`` to ``to_uom``; impossible rows are rejects.

    Converted quantities are rounded to the digits of the target unit.
    """
    table = small_side(conversion_table(uoms, conversions))
    cat = lambda side: small_side(uoms.select(
        F.col("uom_code").alias(side), F.col("uom_category").alias(f"__{side}_cat"), F.col("decimal_digits").alias(f"__{side}_digits")))
    full = df.join(cat("from_uom"), "from_uom", "left").join(cat("to_uom"), "to_uom", "left").join(
        table, ["from_uom", "to_uom"], "left")
    trivial = (F.col("from_uom") == F.col("to_uom")) | F.col("qty").isNull()
    code = F.when(trivial, F.lit(None)).when(
        F.col("__from_uom_cat").isNull() | F.col("__to_uom_cat").isNull(), "M1101").when(
        F.col("__from_uom_cat") != F.col("__to_uom_cat"), "M1102").when(F.col("factor").isNull(), "M1101")
    raw = F.col("qty").cast("decimal(18,4)") * F.col("factor").cast("decimal(19,10)")
    done = F.when(trivial, F.col("qty").cast("decimal(28,6)")).otherwise(round_by_digits(raw, F.col("__to_uom_digits")))
    out = full.withColumns({"error_code": code, "converted": F.when(code.isNull(), done)})
    keep = [*df.columns, "converted"]
    return out.filter("error_code IS NULL").select(*keep), out.filter("error_code IS NOT NULL").select(*df.columns, "error_code")


def round_and_format(df: DataFrame, uoms: DataFrame, qty: str = "qty", uom: str = "uom") -> DataFrame:
    """Add ``rounded`` (default 4 digits) and ``formatted`` (default 2) by unit."""
    digits = small_side(uoms.select(F.col("uom_code").alias(uom), F.col("decimal_digits").alias("__digits")))
    return df.join(digits, uom, "left").withColumns({
        "rounded": round_by_digits(F.col(qty), F.col("__digits")),
        "formatted": format_with_uom(F.col(qty), F.col("__digits"), F.col(uom))}).drop("__digits")


def typed_params(params: DataFrame, number_default=0) -> DataFrame:
    """Parameter rows with text, number and date values; bad ones fall back and warn."""
    value, kind = F.col("param_value"), F.col("param_type")
    num, day = F.expr("try_cast(param_value AS decimal(30,6))"), F.expr("try_cast(param_value AS date)")
    bad = ((kind == "NUMBER") & num.isNull()) | ((kind == "DATE") & day.isNull())
    return params.withColumns({
        "value_number": F.when(kind == "NUMBER", F.coalesce(num, F.lit(number_default).cast("decimal(30,6)"))),
        "value_date": F.when(kind == "DATE", day),
        "value_string": F.when(kind == "STRING", value),
        "warning": F.when(bad, "Y").otherwise("N")})


def read_params(params: DataFrame, keys: Sequence[str]) -> dict[str, object]:
    """The named parameters on the driver; a key with several rows is an error."""
    named = typed_params(params).filter(F.col("param_key").isin(list(keys)))
    pick = {"NUMBER": "value_number", "DATE": "value_date", "STRING": "value_string"}
    one = named.groupBy("param_key").agg(F.count(F.lit(1)).alias("n"), F.first("param_type").alias("param_type"), *[F.first(c).alias(c) for c in pick.values()])
    rows = one.collect()  # a row per key at most
    repeated = sorted(r["param_key"] for r in rows if r["n"] > 1)
    if repeated:
        raise ValueError(f"parameters with several rows: {', '.join(repeated)}")
    return {r["param_key"]: r[pick[r["param_type"]]] for r in rows}


def business_dates(table: DataFrame, sys_code: str = "CORE") -> DataFrame:
    """Current, last and next business date of one system."""
    return table.filter(F.col("sys_code") == sys_code).select("sys_code", "curr_biz_date", "last_biz_date", "next_biz_date")


@dataclass(frozen=True)
class Check:
    """A row rule: ``ok`` must be true (null counts as passed, as in SQL CHECK)."""

    code: str
    ok: Column


@dataclass(frozen=True)
class ForeignKey:
    code: str
    column: str
    parent: DataFrame
    parent_column: str


@dataclass(frozen=True)
class Unique:
    code: str
    columns: tuple[str, ...]


def validate(df: DataFrame, rules: Sequence[Check | ForeignKey | Unique]) -> tuple[DataFrame, DataFrame]:
    """Split into valid rows and rejects carrying all violated codes, in rule order.

    Uniqueness counts by aggregate and join, so a value repeated in a third of
    the rows is combined before it is shuffled.
    """
    work, flags = df, []
    for i, rule in enumerate(rules):
        flag = f"__bad{i}"
        if isinstance(rule, Check):
            work = work.withColumn(flag, ~F.coalesce(rule.ok, F.lit(True)))
        elif isinstance(rule, ForeignKey):
            parent = rule.parent.select(F.col(rule.parent_column).alias(f"__p{i}")).distinct()
            work = work.join(parent, work[rule.column] == parent[f"__p{i}"], "left").withColumn(
                flag, F.col(rule.column).isNotNull() & F.col(f"__p{i}").isNull()).drop(f"__p{i}")
        else:
            cols = list(rule.columns)
            dup = df.groupBy(*cols).count().filter("count > 1").select(
                *[F.col(c).alias(f"__u{i}_{c}") for c in cols], F.lit(True).alias(f"__d{i}"))
            on = [work[c] == dup[f"__u{i}_{c}"] for c in cols]
            work = work.join(dup, on, "left").withColumn(flag, F.coalesce(f"__d{i}", F.lit(False))).drop(
                f"__d{i}", *[f"__u{i}_{c}" for c in cols])
        flags.append(F.when(F.col(flag), F.lit(rule.code)))
    work = work.withColumn("error_codes", F.array_compact(F.array(*flags)))
    work = work.drop(*[f"__bad{i}" for i in range(len(rules))])
    return work.filter(F.size("error_codes") == 0).drop("error_codes"), work.filter(F.size("error_codes") > 0)


def map_error_codes(rejects: DataFrame) -> DataFrame:
    """Add the numeric code of ``error_code`` (unknown codes get one value)."""
    pairs = [F.lit(x) for code, (_, number) in ERROR_CODES.items() for x in (code, number)]
    number = F.try_element_at(F.create_map(*pairs), F.coalesce("error_code", F.lit("")))
    return rejects.withColumn("numeric_code", F.coalesce(number, F.lit(UNKNOWN_NUMERIC_CODE)))


def sum_money(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sum ``amount`` per key; groups that mix currencies or miss one are rejects."""
    agg = df.groupBy(*keys).agg(
        F.sum("amount").alias("amount"), F.min("currency_code").alias("currency_code"), F.max("currency_code").alias("__max"),
        F.count(F.lit(1)).alias("n"), F.count("currency_code").alias("__named"))
    wrong = F.when(F.col("__named") < F.col("n"), "MISSING_CURRENCY").when(F.col("currency_code") != F.col("__max"), "MIXED_CURRENCY")
    marked = agg.withColumn("error_code", wrong)
    good = marked.filter(F.col("error_code").isNull()).drop("__max", "__named", "error_code")
    return good, marked.filter(F.col("error_code").isNotNull()).select(*keys, "n", "error_code")


def money_parts(df: DataFrame, amount: str = "amount", currency: str = "currency_code") -> DataFrame:
    """Add the amount's scale-4 value, absolute and negated value, zero test and display text."""
    value = F.round(F.col(amount), 4).cast("decimal(24,4)")
    return df.withColumns({
        "amount_scaled": value, "amount_abs": F.abs(value), "amount_minus": -value, "is_zero": value == 0,
        "amount_text": money_display(F.col(amount), F.col(currency))})


def audit_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], table_name: str) -> DataFrame:
    """INSERT/UPDATE/DELETE rows between two snapshots with old and new JSON."""
    rest = [c for c in old.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in rest])).alias(name))
    both = pack(old, "old_value").join(pack(new, "new_value"), list(keys), "full")
    action = F.when(F.col("old_value").isNull(), "INSERT").when(F.col("new_value").isNull(), "DELETE").otherwise("UPDATE")
    changed = ~F.col("old_value").eqNullSafe(F.col("new_value"))
    return both.filter(changed).select(
        F.lit(table_name).alias("table_name"), action.alias("action_type"),
        F.concat_ws("/", *keys).alias("biz_key"), "old_value", "new_value")
