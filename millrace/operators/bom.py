"""Product structure: explosion, where-used, version compare, cost roll, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import effective_usage, text, usage_ratio
from millrace.operators.common import best_per_key, sized_side, union_all, valid_at
from millrace.operators.graph import strongly_connected
from millrace.session import materialize, materialize_counted

LEVELS_PER_JOB = 3
# After so many levels a structure is looked at for cycles; it may go deeper.
LOOK_FOR_CYCLES = 20


def active_bom(headers: DataFrame, as_of) -> DataFrame:
    """One ACTIVE default header per item; the latest effective_from wins."""
    live = headers.filter(
        (F.col("status") == "ACTIVE") & (F.col("is_default") == "Y") & valid_at(as_of)
    )
    return best_per_key(live, ["item_id"], [F.col("effective_from"), -F.col("bom_id")])


def bom_components(lines: DataFrame, items: DataFrame, bom_id: int | None = None) -> DataFrame:
    """Current-level components with the item's code and name."""
    picked = lines if bom_id is None else lines.filter(F.col("bom_id") == bom_id)
    names = items.select(
        F.col("item_id").alias("component_item_id"),
        F.col("item_code").alias("component_code"),
        F.col("item_name").alias("component_name"),
    )
    return picked.join(names, "component_item_id").select(
        "bom_id", "line_no", "component_item_id", "component_code", "component_name",
        "qty_per", "uom", "scrap_rate",
    )


def structure_edges(headers: DataFrame, lines: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """parent -> component edges of live default headers, with item attributes."""
    live = headers.filter(
        (F.col("status") == "ACTIVE") & (F.col("is_default") == "Y") & valid_at(as_of)
    ).select("bom_id", F.col("item_id").alias("parent_item_id"))
    comp = items.select(
        F.col("item_id").alias("component_item_id"),
        F.col("item_code").alias("component_code"),
        F.col("item_name").alias("component_name"),
        "item_type",
        F.col("is_phantom").alias("item_phantom"),
    )
    flag = F.when((F.col("is_phantom") == "Y") | (F.col("item_phantom") == "Y"), "Y").otherwise("N")
    return (
        lines.join(live, "bom_id")
        .join(comp, "component_item_id")
        .select(
            "parent_item_id", "component_item_id", "component_code", "component_name", "item_type",
            "line_no", "qty_per", "scrap_rate", "uom", flag.alias("is_phantom"),
        )
    )


def _walk(edges: DataFrame, roots: DataFrame, qty: float, max_levels: int | None, round_each_level: bool):
    """Level-by-level explosion of many roots until no row is left; yields (good rows, violations).

    The visited path stops cycles; rows below ``max_levels``, if given, are violations.
    """
    edges = materialize(edges, "edges")
    carry = "decimal(18,6)" if round_each_level else "double"
    ratio = usage_ratio(F.col("qty_per"), F.col("scrap_rate"))
    front = roots.select(
        F.col("item_id").alias("root_item_id"), F.col("item_id").alias("at"),
        F.lit(qty).cast(carry).alias("carried"), F.array(F.col("item_id")).alias("visited"),
        F.lit("").alias("code_path"), F.array().cast("array<int>").alias("sort_path"),
    )
    good, bad = [], []
    level = 0
    while True:
        level += 1
        too_deep = max_levels is not None and level > max_levels
        step = front.join(edges, front["at"] == edges["parent_item_id"]).drop("at")
        carried = F.col("carried") * ratio
        if round_each_level:
            carried = F.round(F.col("carried").cast("double") * ratio, 6).cast(carry)
        step = step.withColumns({
            "lvl": F.lit(level),
            "carried": carried,
            "looped": F.array_contains("visited", F.col("component_item_id")) | F.lit(too_deep),
            "code_path": F.concat("code_path", F.lit("/"), "component_code"),
            "sort_path": F.concat("sort_path", F.array(F.col("line_no").cast("int"))),
        })
        step, count = materialize_counted(step, "explode")
        good.append(step.filter(~F.col("looped")))
        bad.append(step.filter("looped"))
        front = step.filter(~F.col("looped")).select(
            "root_item_id", F.col("component_item_id").alias("at"), "carried",
            F.concat("visited", F.array("component_item_id")).alias("visited"),
            "code_path", "sort_path",
        )
        if not count:
            break
    return edges, union_all(good), union_all(bad)


def explode_bom_checked(
    headers: DataFrame, lines: DataFrame, items: DataFrame, roots: DataFrame, qty: float = 1,
    as_of=None, max_levels: int | None = None, round_each_level: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Explosion and its violations (component already on its path, or too deep).

    The result's ``id_path`` is the chain of item ids, as the checked walk keeps it.
    """
    edges = structure_edges(headers, lines, items, as_of)
    edges, good, bad = _walk(edges, roots, qty, max_levels, round_each_level)
    parents = edges.select(F.col("parent_item_id").alias("__p")).distinct()
    id_path = F.concat(
        F.lit("/"), F.array_join(F.col("visited").cast("array<string>"), "/"),
        F.lit("/"), F.col("component_item_id").cast("string"), F.lit("/"),
    )
    rows = good.join(parents, good["component_item_id"] == parents["__p"], "left").select(
        "root_item_id", "lvl", "parent_item_id", "component_item_id", "component_code",
        "component_name", "item_type", "qty_per",
        F.round(F.col("carried"), 6).cast("decimal(18,6)").alias("cum_qty"),
        "uom", F.col("code_path").alias("path"), id_path.alias("id_path"),
        F.when(F.col("__p").isNull(), "Y").otherwise("N").alias("is_leaf"),
        "is_phantom", "sort_path",
    )
    violations = bad.select(
        "root_item_id", "lvl", "component_item_id", id_path.alias("id_path"),
        F.lit("M2002").alias("error_code"),
    )
    return rows, violations


def explode_bom(headers, lines, items, roots, qty: float = 1, as_of=None,
                max_levels: int | None = None, round_each_level: bool = False) -> DataFrame:
    """Multi-level explosion of every root; cyclic branches are cut."""
    rows, _ = explode_bom_checked(headers, lines, items, roots, qty, as_of, max_levels, round_each_level)
    return rows.drop("id_path")


def where_used(headers: DataFrame, lines: DataFrame, items: DataFrame, components: DataFrame,
               as_of=None, max_levels: int | None = None) -> DataFrame:
    """Rows of :func:`where_used_checked` alone."""
    return where_used_checked(headers, lines, items, components, as_of, max_levels)[0]


def where_used_checked(headers: DataFrame, lines: DataFrame, items: DataFrame, components: DataFrame,
                       as_of=None, max_levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Climb from each component to its top assemblies over ACTIVE effective headers, and the uses cut (M2002).

    A use is cut where its parent is on the path already; the climb goes on beside it.
    """
    live = headers.filter((F.col("status") == "ACTIVE") & valid_at(as_of)).select(
        "bom_id", F.col("item_id").alias("parent_item_id"))
    names = items.select(F.col("item_id").alias("parent_item_id"),
                         F.col("item_code").alias("parent_code"), F.col("item_name").alias("parent_name"))
    edges = materialize(lines.join(live, "bom_id").join(names, "parent_item_id").select(
        "parent_item_id", "parent_code", "parent_name", "component_item_id", "qty_per", "uom"), "uses")
    front = components.select(F.col("item_id").alias("start_item_id"), F.col("item_id").alias("at"),
                              F.array("item_id").alias("visited"), F.lit("").alias("use_path"))
    levels, cut = [], []
    level = 0
    while max_levels is None or level < max_levels:
        level += 1
        step = front.join(edges, front["at"] == edges["component_item_id"]).drop("at")
        step = step.withColumns({
            "lvl": F.lit(level),
            "use_path": F.concat("use_path", F.lit("<-"), "parent_code"),
            "looped": F.array_contains("visited", F.col("parent_item_id")),
            "visited": F.concat("visited", F.array("parent_item_id")),
        })
        step, count = materialize_counted(step, "used", ~F.col("looped"))
        cut.append(step.filter("looped"))
        step = step.filter("NOT looped")
        if not count:
            break
        levels.append(step)
        front = step.select("start_item_id", F.col("parent_item_id").alias("at"), "visited", "use_path")
    rows = union_all(levels) if levels else step
    used = edges.select(F.col("component_item_id").alias("__c")).distinct()
    rows = rows.join(used, rows["parent_item_id"] == used["__c"], "left").select(
        "start_item_id", "lvl", "parent_item_id", "parent_code", "parent_name",
        "component_item_id", "qty_per", "uom",
        F.when(F.col("__c").isNull(), 1).otherwise(0).alias("is_top"), "use_path",
    )
    looped = union_all(cut) if cut else step.limit(0)
    return rows, looped.select("start_item_id", "lvl", "parent_item_id", "component_item_id", "use_path", F.lit("M2002").alias("error_code"))


def compare_bom_versions(old: DataFrame, new: DataFrame, pair: str = "pair_id") -> DataFrame:
    """ADDED / REMOVED / QTY_CHANGED between component sets, for many pairs at once.

    Both sides carry ``pair`` naming the comparison. Multiset differences keep
    duplicates, so equality is on all compared attributes.
    """
    attrs = [pair, "component_item_id", "component_code", "qty_per", "uom", "scrap_rate"]
    o, n = old.select(attrs), new.select(attrs)
    key = [pair, "component_item_id"]
    qty = "decimal(18,6)"
    out = [pair, "component_item_id", "component_code"]
    added = n.exceptAll(o).join(o.select(key).distinct(), key, "left_anti").select(
        F.lit("ADDED").alias("change_type"), *out, F.lit(None).cast(qty).alias("old_qty_per"),
        F.col("qty_per").alias("new_qty_per"), "uom")
    removed = o.exceptAll(n).join(n.select(key).distinct(), key, "left_anti").select(
        F.lit("REMOVED").alias("change_type"), *out, F.col("qty_per").alias("old_qty_per"),
        F.lit(None).cast(qty).alias("new_qty_per"), "uom")
    same = o.intersectAll(n).select(key).distinct()
    changed = (
        o.join(same, key, "left_anti").alias("o")
        .join(n.select(*key, F.col("qty_per").alias("new_qty_per"), F.col("uom").alias("new_uom")), key)
        .filter(F.col("qty_per") != F.col("new_qty_per"))
        .select(F.lit("QTY_CHANGED").alias("change_type"), *out,
                F.col("qty_per").alias("old_qty_per"), "new_qty_per", F.col("new_uom").alias("uom"))
    )
    return union_all([added, removed, changed])


def rolled_cost(headers: DataFrame, lines: DataFrame, items: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Bottom-up unit cost of all items, rounded at every level.

    Returns (item_id, rolled_cost) and the items that cannot be costed: M1001 where a
    component below is no item, M2002 where a cycle is. One round per structure level: an
    item is costed once all its components are, until a round costs nothing new.
    """
    chosen = active_bom(headers, as_of).select("item_id", "bom_id", "base_qty")
    uses = chosen.join(lines, "bom_id").select(
        F.col("item_id").alias("parent"), F.col("component_item_id").alias("child"),
        effective_usage(F.col("qty_per"), F.col("scrap_rate")).alias("usage"),
        F.coalesce(F.nullif(F.col("base_qty"), F.lit(0).cast("decimal(18,6)")),
                   F.lit(1).cast("decimal(18,6)")).alias("base"),
    )
    uses, n_uses = materialize_counted(uses, "uses")
    have_lines = sized_side(uses.select(F.col("parent").alias("item_id")).distinct(), n_uses)
    cost = F.col("std_cost").cast("decimal(20,6)")
    empty_bom = chosen.select("item_id").join(have_lines, "item_id", "left_anti")
    absent = uses.select(F.col("child").alias("item_id")).distinct().join(items, "item_id", "left_anti").join(have_lines, "item_id", "left_anti")
    leaves = union_all([
        items.join(chosen.select("item_id"), "item_id", "left_anti").select("item_id", cost.alias("rolled_cost"), F.lit(True).alias("whole")),
        empty_bom.select("item_id", F.lit(0).cast("decimal(20,6)").alias("rolled_cost"), F.lit(True).alias("whole")),
        absent.select("item_id", F.lit(None).cast("decimal(20,6)").alias("rolled_cost"), F.lit(False).alias("whole")),
    ])
    leaves, n_done = materialize_counted(leaves, "cost")
    known = [leaves]
    while True:
        done = sized_side(union_all(known), n_done)
        open_uses = uses.join(done.select(F.col("item_id").alias("parent")), "parent", "left_anti")
        priced = open_uses.join(done.withColumnRenamed("item_id", "child"), "child", "left")
        part = F.col("rolled_cost").cast("decimal(18,6)") * F.col("usage")
        solved = (
            priced.groupBy("parent")
            .agg(F.sum(part.cast("decimal(36,18)")).alias("total"), F.max("base").alias("base"),
                 F.count(F.lit(1)).alias("n"), F.count("whole").alias("n_known"), F.bool_and("whole").alias("whole"))
            .filter("n = n_known")
            .select(F.col("parent").alias("item_id"),
                    F.when(F.col("whole"), F.round(F.col("total") / F.col("base"), 6)).cast("decimal(20,6)").alias("rolled_cost"), "whole")
        )
        solved, count = materialize_counted(solved, "cost")
        if not count:
            break
        known.append(solved)
        n_done += count
    done = sized_side(union_all(known), n_done)
    broken = done.filter(~F.col("whole")).join(have_lines, "item_id", "left_semi").select("item_id", F.lit("M1001").alias("error_code"))
    circular = have_lines.join(done, "item_id", "left_anti").withColumn("error_code", F.lit("M2002"))
    return done.filter("whole").drop("whole"), broken.unionByName(circular)


def circular_items(edges: DataFrame) -> DataFrame:
    """item_id of every item on a cycle of (parent, item_id) edges."""
    links = edges.select(F.col("parent").alias("src"), F.col("item_id").alias("dst"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    groups = strongly_connected(nodes, links)
    several = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    own = links.filter("src = dst").select(F.col("src").alias("item_id"))
    return groups.join(several, "component").select(F.col("node").alias("item_id")).union(own).distinct()


def low_level_codes(headers: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Codes of :func:`low_level_codes_checked` alone."""
    return low_level_codes_checked(headers, lines, items)[0]


def low_level_codes_checked(headers: DataFrame, lines: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, llc): deepest level of each component under any FG/SEMI root; and the items on cycles (M2002).

    Each round holds the distinct items of one level, so the number of paths
    through shared components never matters. Items on a cycle get no code and pass
    no level down; all others are coded, however deep.
    """
    active = headers.filter(F.col("status") == "ACTIVE").select("bom_id", F.col("item_id").alias("parent"))
    edges, count = materialize_counted(
        lines.join(active, "bom_id").select("parent", F.col("component_item_id").alias("item_id")).distinct(), "edges")
    edges = sized_side(edges, count)
    codes = _levels_below(edges, items, LOOK_FOR_CYCLES)
    if codes is not None:
        return codes, edges.select("item_id", F.lit("M2002").alias("error_code")).limit(0)
    circular = materialize(circular_items(edges), "circular")
    on_cycle = circular.withColumnRenamed("item_id", "parent")
    open_edges, count = materialize_counted(edges.join(on_cycle, "parent", "left_anti").join(circular, "item_id", "left_anti"), "edges")
    return _levels_below(sized_side(open_edges, count), items, None), circular.withColumn("error_code", F.lit("M2002"))


def _levels_below(edges: DataFrame, items: DataFrame, look_at: int | None) -> DataFrame | None:
    """Codes over ``edges``; None if they go deeper than ``look_at`` levels."""
    front = items.filter(F.col("item_type").isin("FG", "SEMI")).select(F.col("item_id").alias("parent"))
    chunks, level = [], 0
    while True:
        # A few levels per job: each level's distinct set feeds the next one.
        steps = []
        for _ in range(LEVELS_PER_JOB):
            level += 1
            step = front.join(edges, "parent").select("item_id").distinct()
            steps.append(step.withColumn("lvl", F.lit(level)))
            front = step.select(F.col("item_id").alias("parent"))
        chunk, count = materialize_counted(union_all(steps), "level")
        chunks.append(chunk)
        if not count:
            break
        if look_at is not None and level > look_at:
            return None
        front = chunk.filter(F.col("lvl") == level).select(F.col("item_id").alias("parent"))
    return union_all(chunks).groupBy("item_id").agg(F.max("lvl").alias("llc"))


def bom_component_list(lines: DataFrame, items: DataFrame, uoms: DataFrame) -> DataFrame:
    """Per BOM: ``line:code name xQTY UOM`` joined by ``; `` in line order."""
    from millrace.functions.columns import format_with_uom

    digits = uoms.select(F.col("uom_code").alias("uom"), "decimal_digits")
    parts = bom_components(lines, items).join(digits, "uom", "left").select(
        "bom_id", "line_no", "component_item_id",
        F.concat(
            F.col("line_no").cast("string"), F.lit(":"), text(F.col("component_code")), F.lit(" "),
            text(F.col("component_name")), F.lit(" x"),
            format_with_uom(F.col("qty_per"), F.col("decimal_digits"), F.col("uom")),
        ).alias("part"),
    )
    return parts.groupBy("bom_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(line_no, component_item_id, part))), x -> x.part), '; ')")
        .alias("component_list"))
