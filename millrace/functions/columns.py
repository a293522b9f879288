"""Column helpers: scalar rules expressed as Catalyst expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(col, precision: int, scale: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(f"decimal({precision},{scale})")


def effective_usage(qty_per: Column, scrap: Column) -> Column:
    """Input per unit of output including scrap, held at 12 decimals."""
    loss = F.lit(1).cast("decimal(1,0)") - F.coalesce(scrap, F.lit(0).cast("decimal(8,4)"))
    return F.round(qty_per / loss, 12).cast("decimal(18,12)")


def usage_ratio(qty_per: Column, scrap: Column) -> Column:
    """Same ratio as a double, for products along a path that are not rounded."""
    return qty_per.cast("double") / (F.lit(1.0) - F.coalesce(scrap.cast("double"), F.lit(0.0)))


def period_index(day: Column) -> Column:
    """Whole months since January 2000."""
    return ((F.year(day) - 2000) * 12 + F.month(day) - 1).cast("int")


def period_start(index: Column) -> Column:
    return F.add_months(F.lit("2000-01-01").cast("date"), index)


def doc_no(prefix: str, day: Column, seq: Column) -> Column:
    """prefix + yyyymmdd + six-digit sequence."""
    six = F.lpad(F.pmod(seq, F.lit(1000000)).cast("string"), 6, "0")
    return F.concat(F.lit(prefix), F.date_format(day, "yyyyMMdd"), six)


def round_by_digits(qty: Column, digits: Column, default: int = 4) -> Column:
    """Round to a per-row number of digits (round's scale must be a literal)."""
    out = F.when(digits.isNull(), F.round(qty, default).cast("decimal(28,6)"))
    for n in range(0, 7):
        out = out.when(digits == n, F.round(qty, n).cast("decimal(28,6)"))
    return out


def format_with_uom(qty: Column, digits: Column, uom: Column, default: int = 2) -> Column:
    """Thousands separators, fixed digits and the unit as a suffix."""
    out = F.when(digits.isNull(), F.format_number(F.round(qty, default), default))
    for n in range(0, 7):
        out = out.when(digits == n, F.format_number(F.round(qty, n), n))
    return F.concat(out, F.coalesce(F.concat(F.lit(" "), uom), F.lit("")))


def text(col: Column) -> Column:
    """Oracle concatenation treats null as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def abc_class(share: Column, a: float, b: float) -> Column:
    return F.when(share <= a, "A").when(share <= b, "B").otherwise("C")


def volume_cm3(dim: Column) -> Column:
    side = lambda n: F.coalesce(dim[n], F.lit(0).cast("decimal(10,2)"))
    return (side("length_cm") * side("width_cm") * side("height_cm")).cast("decimal(30,6)")


def volumetric_weight(dim: Column) -> Column:
    """Volume over 5000, three decimals."""
    return F.round(volume_cm3(dim) / F.lit(5000), 3).cast("decimal(20,3)")


def chargeable_weight(dim: Column) -> Column:
    real = F.coalesce(dim["weight_kg"], F.lit(0).cast("decimal(10,3)"))
    return F.greatest(real, volumetric_weight(dim)).cast("decimal(20,3)")


def money_display(amount: Column, currency: Column) -> Column:
    return F.concat(F.format_number(amount, 4), F.lit(" "), currency)


def clamp_score(value: Column) -> Column:
    """Whole-point score, never below zero."""
    return F.greatest(F.lit(0), F.floor(value + 0.5)).cast("long")
