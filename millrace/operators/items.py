"""Item master and category tree."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import abc_class, chargeable_weight, volume_cm3, volumetric_weight
from millrace.operators.bom import active_bom
from millrace.operators.common import next_snapshot, split_by_rules, union_all
from millrace.operators.ordered import row_numbers, running_sums
from millrace.session import materialize, materialize_counted

# Item types, and the labels of the item description.
ITEM_TYPES = ("RAW", "SEMI", "FG", "SVC")
STOCKED_LABEL = "可库存"
NOT_STOCKED_LABEL = "不可库存"


def _tree(categories: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of every node below ``roots`` with level, path, leaf flag, root code."""
    nodes = categories.select("category_id", "parent_category_id", "category_code", "category_name")
    level = roots.select(
        *nodes.columns, F.lit(1).alias("lvl"), F.concat(F.lit("/"), "category_code").alias("path"),
        F.col("category_code").alias("root_code"), F.array("category_id").alias("visited"))
    level = materialize(level, "tree")
    levels = [level]
    while True:
        up = level.select(F.col("category_id").alias("__up"), "lvl", "path", "root_code", "visited")
        step = nodes.join(up, nodes["parent_category_id"] == up["__up"]).filter(
            ~F.array_contains("visited", F.col("category_id")))
        step = step.select(
            *nodes.columns, (F.col("lvl") + 1).alias("lvl"),
            F.concat("path", F.lit("/"), "category_code").alias("path"), "root_code",
            F.concat("visited", F.array("category_id")).alias("visited"))
        level, count = materialize_counted(step, "tree")
        if not count:
            break
        levels.append(level)
    parents = nodes.select(F.col("parent_category_id").alias("__p")).distinct()
    rows = union_all(levels)
    return rows.join(parents, rows["category_id"] == parents["__p"], "left").withColumn(
        "is_leaf", F.when(F.col("__p").isNull(), "Y").otherwise("N")).drop("__p", "visited")


def category_paths(categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Root-to-node path of every category; unreachable ones are rejects (M1003)."""
    tree = _tree(categories, categories.filter(F.col("parent_category_id").isNull()))
    lost = categories.join(tree.select("category_id"), "category_id", "left_anti").select(
        "category_id", F.lit("M1003").alias("error_code"))
    return tree.select("category_id", "path"), lost


def category_subtree(categories: DataFrame, roots: DataFrame) -> DataFrame:
    """Sub-trees of the given root ids with level, leaf flag, root code and path."""
    start = categories.join(roots.select("category_id"), "category_id", "left_semi")
    return _tree(categories, start)


def rebuild_category_tree(categories: DataFrame) -> DataFrame:
    """Snapshot with level_no, path and is_leaf recomputed for reachable nodes."""
    base = categories
    for name, kind in (("level_no", "int"), ("path", "string"), ("is_leaf", "string")):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    tree = _tree(categories, categories.filter(F.col("parent_category_id").isNull()))
    return next_snapshot(
        base, tree.select("category_id", F.col("lvl").alias("level_no"), "path", "is_leaf"), ["category_id"], insert=False)


def item_profile(items: DataFrame, headers: DataFrame, as_of) -> DataFrame:
    """Columns that depend on the item's type."""
    bom = active_bom(headers, as_of).select("item_id", F.col("bom_id").alias("__bom"))
    kind = F.col("item_type")
    made = kind.isin("FG", "SEMI")
    method = F.when(kind == "RAW", "FIFO").when(kind == "SVC", "NONE").otherwise("STD")
    stocked = F.when(kind == "SVC", "N").otherwise("Y")
    lead = F.when(kind == "RAW", 7).when(kind == "SVC", 0).otherwise(F.coalesce("lead_time_days", F.lit(1)))
    label = F.when(kind == "SVC", NOT_STOCKED_LABEL).otherwise(STOCKED_LABEL)
    return items.join(bom, "item_id", "left").select(
        "item_id", "item_code", "item_type", method.alias("valuation_method"), stocked.alias("is_stockable"),
        lead.alias("lead_time_days"), F.when(made, F.col("__bom")).alias("bom_id"),
        F.concat("item_code", F.lit(" "), "item_name", F.lit(" ["), method, F.lit("/"), label, F.lit("]")).alias("description"))


def lookup_items(df: DataFrame, items: DataFrame, key: str = "item_code") -> tuple[DataFrame, DataFrame]:
    """Attach item_id (or code) by ``key``; unknown keys are rejects (M1001)."""
    other = "item_id" if key == "item_code" else "item_code"
    joined = df.join(items.select(key, other), key, "left")
    return joined.filter(F.col(other).isNotNull()), df.join(items.select(key), key, "left_anti").withColumn(
        "error_code", F.lit("M1001"))


def load_items(new_rows: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated new items with ids after the current maximum, and the rejects.

    A code used before, or by several of the new rows, is rejected in all of them.
    """
    taken = items.select("item_code").union(new_rows.groupBy("item_code").count().filter("count > 1").select("item_code")).distinct()
    known = new_rows.join(taken.withColumn("__dup", F.lit(True)), "item_code", "left")
    good, bad = split_by_rules(known, [
        ("M1001", F.col("item_type").isin(*ITEM_TYPES), "illegal item type"),
        ("M1004", F.col("__dup").isNull(), "item code already used"),
    ])
    kind = F.col("item_type")
    method = F.when(kind == "SVC", "NONE").when(kind == "RAW", "FIFO").otherwise("STD")
    offset = items.agg(F.coalesce(F.max("item_id"), F.lit(0))).scalar()
    numbered = row_numbers(good.drop("__dup"), [], [F.col("item_code")], "__n")
    out = numbered.withColumns({
        "item_id": offset + F.col("__n"), "valuation_method": method,
        "std_cost": F.coalesce("std_cost", F.lit(0)).cast("decimal(20,6)"),
    }).drop("__n")
    return out, bad.drop("__dup")


def reclassify_abc(txns: DataFrame, items: DataFrame, start, end, a: str = "0.80", b: str = "0.95") -> DataFrame:
    """ABC class by cumulative share of outbound value, written to the items."""
    used = (
        txns.filter((F.col("direction") == "O")
                    & F.col("txn_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("item_id").agg(F.sum("total_cost").cast("decimal(26,4)").alias("amount"))
        .filter(F.col("amount") > 0)
    )
    used = materialize(used, "used")
    total = used.agg(F.sum("amount")).scalar().cast("decimal(30,4)")
    run = running_sums(used, [], [F.col("amount").desc(), F.col("item_id")], {"cum": F.col("amount")})
    within = lambda share: F.col("cum") <= F.lit(Decimal(share)).cast("decimal(6,4)") * total
    graded = run.select("item_id", F.when(within(a), "A").when(within(b), "B").otherwise("C").alias("abc_class"))
    return next_snapshot(items, graded, ["item_id"], insert=False)


def apply_item_updates(items: DataFrame, flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlay flat updates; four null dimensions clear the struct."""
    parts = ["length_cm", "width_cm", "height_cm", "weight_kg"]
    dim = F.when(F.coalesce(*parts).isNotNull(), F.struct(*parts))
    cols = ["std_cost", "list_price", "status"]
    upd = flat.select("item_id", F.col("item_name").alias("__item_name"), *[F.col(c).alias(f"__{c}") for c in cols],
                      dim.alias("__dim"), F.lit(True).alias("__hit"))
    joined = items.join(upd, "item_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    new = {c: F.when(hit, F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in cols}
    new["item_name"] = F.when(hit, F.col("__item_name")).otherwise(F.col("item_name"))
    new["dim"] = F.when(hit, F.col("__dim")).otherwise(F.col("dim"))
    out = joined.withColumns(new).select(*items.columns)
    missing = flat.join(items.select("item_id"), "item_id", "left_anti").withColumn("error_code", F.lit("M1001"))
    return out, missing


def item_full_view(items: DataFrame, categories: DataFrame, uoms: DataFrame) -> DataFrame:
    """Flattened item view with category, unit and computed volume and weights."""
    dim = F.col("dim")
    return (
        items.join(categories.select("category_id", "category_code", "category_name"), "category_id", "left")
        .join(uoms.select(F.col("uom_code").alias("base_uom"), "uom_category"), "base_uom", "left")
        .select("item_id", "item_code", "item_name", "item_type", "category_code", "category_name", "base_uom",
                "uom_category", "std_cost", "list_price", "status",
                dim["length_cm"].alias("length_cm"), dim["width_cm"].alias("width_cm"),
                dim["height_cm"].alias("height_cm"), dim["weight_kg"].alias("weight_kg"),
                F.when(dim.isNotNull(), volume_cm3(dim)).alias("volume_cm3"),
                F.when(dim.isNotNull(), volumetric_weight(dim)).alias("volumetric_kg"),
                F.when(dim.isNotNull(), chargeable_weight(dim)).alias("chargeable_kg")))
