"""Product structure, items and pricing over the bridged tables."""

from pyspark.sql import functions as F

from millrace.operators import bom, costing, items, pricing
from millrace.plans.bridge import AS_OF
from millrace.plans.catalog import exact_div, query

_LIVE = f"status = 'ACTIVE' AND effective_from <= DATE '{AS_OF}' AND (effective_to IS NULL OR effective_to >= DATE '{AS_OF}')"
_EDGES = f"""edges AS (
    SELECT h.item_id AS parent, l.component_item_id AS child, i.item_code, i.item_name, i.item_type, l.qty_per, l.scrap_rate, l.uom,
           CASE WHEN l.is_phantom = 'Y' OR i.is_phantom = 'Y' THEN 'Y' ELSE 'N' END AS is_phantom
      FROM {{bom_lines}} l JOIN {{bom_headers}} h ON h.bom_id = l.bom_id JOIN {{items}} i ON i.item_id = l.component_item_id
     WHERE {_LIVE.replace('status', 'h.status')} AND h.is_default = 'Y')"""
_RATIO = "(CAST(e.qty_per AS DOUBLE) / (1.0::DOUBLE - CAST(e.scrap_rate AS DOUBLE)))"


def _roots(b):
    return b.items.filter("item_type = 'FG'").select("item_id")


@query("active_bom", "item_id:l bom_id:l bom_version:s base_qty:d",
       f"""SELECT item_id, bom_id, bom_version, base_qty FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY effective_from DESC, bom_id) AS rn
               FROM {{bom_headers}} WHERE {_LIVE} AND is_default = 'Y') WHERE rn = 1""")
def _(b):
    return bom.active_bom(b.bom_headers, AS_OF)


@query("bom_components", "bom_id:l line_no:l component_item_id:l component_code:s component_name:s qty_per:d uom:s scrap_rate:d",
       """SELECT l.bom_id, l.line_no, l.component_item_id, i.item_code AS component_code, i.item_name AS component_name,
                 l.qty_per, l.uom, l.scrap_rate FROM {bom_lines} l JOIN {items} i ON i.item_id = l.component_item_id""")
def _(b):
    return bom.bom_components(b.bom_lines, b.items)


_EXPLODE = f"""WITH {_EDGES}, tree AS (
    SELECT e.parent AS root, 1 AS lvl, e.*, {_RATIO} * 1.0::DOUBLE AS cum, '/' || e.item_code AS path, '/' || e.parent || '/' || e.child || '/' AS id_path
      FROM edges e JOIN {{items}} r ON r.item_id = e.parent AND r.item_type = 'FG'
    UNION ALL
    SELECT t.root, t.lvl + 1, e.*, t.cum * {_RATIO}, t.path || '/' || e.item_code, t.id_path || e.child || '/'
      FROM tree t JOIN edges e ON e.parent = t.child)
    SELECT root AS root_item_id, lvl, parent AS parent_item_id, child AS component_item_id, item_code AS component_code,
           item_name AS component_name, item_type, qty_per, CAST(ROUND(cum, 6) AS DECIMAL(18,6)) AS cum_qty, uom, path, id_path,
           CASE WHEN child IN (SELECT parent FROM edges) THEN 'N' ELSE 'Y' END AS is_leaf, is_phantom FROM tree"""
_EXPLODE_COLS = ("root_item_id:l lvl:l parent_item_id:l component_item_id:l component_code:s component_name:s item_type:s "
                 "qty_per:d cum_qty:d uom:s path:s is_leaf:s is_phantom:s")


@query("explode_bom", _EXPLODE_COLS, _EXPLODE)
def _(b):
    return bom.explode_bom(b.bom_headers, b.bom_lines, b.items, _roots(b), 1, AS_OF)


@query("explode_bom_checked", _EXPLODE_COLS + " id_path:s", _EXPLODE)
def _(b):
    rows, _bad = bom.explode_bom_checked(b.bom_headers, b.bom_lines, b.items, _roots(b), 1, AS_OF)
    return rows


def _faulty_lines(b):
    """Lines with one more for every tenth parent: itself, or (remainder 5) a number that no item has."""
    parent = b.bom_headers.select("bom_id", F.col("item_id").alias("__parent"))
    more = b.bom_lines.filter("line_no = 10").join(parent, "bom_id").filter(F.col("__parent") % 10 == 0)
    lost = b.bom_lines.filter("line_no = 10").join(parent, "bom_id").filter(F.col("__parent") % 10 == 5)
    added = more.withColumn("component_item_id", F.col("__parent")).unionByName(lost.withColumn("component_item_id", F.col("__parent") + 900000000))
    return b.bom_lines.unionByName(added.withColumn("line_no", F.lit(1000)).drop("__parent").select(b.bom_lines.columns))


@query("explode_violations", "root_item_id:l lvl:l component_item_id:l id_path:s error_code:s",
       f"""WITH {_EDGES}, selfs AS (
             SELECT h.item_id AS item FROM {{bom_lines}} l JOIN {{bom_headers}} h ON h.bom_id = l.bom_id
              WHERE {_LIVE.replace('status', 'h.status')} AND h.is_default = 'Y' AND l.line_no = 10 AND h.item_id % 10 = 0),
           tree AS (
             SELECT item_id AS root, 0 AS lvl, item_id AS child, '/' || item_id || '/' AS id_path FROM {{items}} WHERE item_type = 'FG'
             UNION ALL
             SELECT t.root, t.lvl + 1, e.child, t.id_path || e.child || '/' FROM tree t JOIN edges e ON e.parent = t.child)
           SELECT root AS root_item_id, lvl + 1 AS lvl, child AS component_item_id, id_path || child || '/' AS id_path, 'M2002' AS error_code
             FROM tree JOIN selfs ON selfs.item = tree.child""")
def _(b):
    return bom.explode_bom_checked(b.bom_headers, _faulty_lines(b), b.items, _roots(b), 1, AS_OF)[1]


@query("where_used", "start_item_id:l lvl:l parent_item_id:l parent_code:s component_item_id:l qty_per:d is_top:l use_path:s",
       f"""WITH u AS (SELECT h.item_id AS parent, i.item_code, l.component_item_id AS child, l.qty_per
             FROM {{bom_lines}} l JOIN {{bom_headers}} h ON h.bom_id = l.bom_id JOIN {{items}} i ON i.item_id = h.item_id
            WHERE {_LIVE.replace('status', 'h.status')}),
           climb AS (
             SELECT child AS start, 1 AS lvl, parent, item_code, child, qty_per, '<-' || item_code AS use_path FROM u
             UNION ALL
             SELECT c.start, c.lvl + 1, u.parent, u.item_code, u.child, u.qty_per, c.use_path || '<-' || u.item_code
               FROM climb c JOIN u ON u.child = c.parent)
           SELECT start AS start_item_id, lvl, parent AS parent_item_id, item_code AS parent_code, child AS component_item_id,
                  qty_per, CASE WHEN parent IN (SELECT child FROM u) THEN 0 ELSE 1 END AS is_top, use_path FROM climb""")
def _(b):
    return bom.where_used(b.bom_headers, b.bom_lines, b.items, b.items.select("item_id"), AS_OF)


@query("where_used_violations", "start_item_id:l lvl:l parent_item_id:l component_item_id:l use_path:s error_code:s",
       f"""WITH u AS (SELECT h.item_id AS parent, i.item_code, l.component_item_id AS child, l.line_no
             FROM {{bom_lines}} l JOIN {{bom_headers}} h ON h.bom_id = l.bom_id JOIN {{items}} i ON i.item_id = h.item_id
            WHERE {_LIVE.replace('status', 'h.status')}),
           selfs AS (SELECT parent, item_code FROM u WHERE line_no = 10 AND parent % 10 = 0),
           climb AS (
             SELECT item_id AS start, 0 AS lvl, item_id AS node, '' AS use_path FROM {{items}}
             UNION ALL
             SELECT c.start, c.lvl + 1, u.parent, c.use_path || '<-' || u.item_code FROM climb c JOIN u ON u.child = c.node)
           SELECT start AS start_item_id, lvl + 1 AS lvl, node AS parent_item_id, node AS component_item_id, use_path || '<-' || selfs.item_code AS use_path, 'M2002' AS error_code
             FROM climb JOIN selfs ON selfs.parent = climb.node""")
def _(b):
    return bom.where_used_checked(b.bom_headers, _faulty_lines(b), b.items, b.items.select("item_id"), AS_OF)[1]


def _version(b, version):
    heads = b.bom_headers.filter(F.col("bom_version") == version).select("bom_id", F.col("item_id").alias("pair_id"))
    return bom.bom_components(b.bom_lines, b.items).join(heads, "bom_id")


_VER = """SELECT h.item_id AS pair_id, l.component_item_id, i.item_code AS component_code, l.qty_per, l.uom, l.scrap_rate
            FROM {bom_lines} l JOIN {bom_headers} h ON h.bom_id = l.bom_id JOIN {items} i ON i.item_id = l.component_item_id
           WHERE h.bom_version = '%s'"""


@query("compare_bom_versions", "change_type:s pair_id:l component_item_id:l component_code:s old_qty_per:d new_qty_per:d uom:s",
       f"""WITH o AS ({_VER % 'V1'}), n AS ({_VER % 'V2'}), same AS (SELECT * FROM o INTERSECT ALL SELECT * FROM n)
           SELECT 'ADDED' AS change_type, pair_id, component_item_id, component_code, CAST(NULL AS DECIMAL(18,6)) AS old_qty_per,
                  qty_per AS new_qty_per, uom FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) a
            WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.pair_id = a.pair_id AND o.component_item_id = a.component_item_id)
           UNION ALL
           SELECT 'REMOVED', pair_id, component_item_id, component_code, qty_per, NULL, uom
             FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) r
            WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.pair_id = r.pair_id AND n.component_item_id = r.component_item_id)
           UNION ALL
           SELECT 'QTY_CHANGED', o.pair_id, o.component_item_id, o.component_code, o.qty_per, n.qty_per, n.uom
             FROM o JOIN n ON n.pair_id = o.pair_id AND n.component_item_id = o.component_item_id
            WHERE o.qty_per <> n.qty_per
              AND NOT EXISTS (SELECT 1 FROM same s WHERE s.pair_id = o.pair_id AND s.component_item_id = o.component_item_id)""")
def _(b):
    return bom.compare_bom_versions(_version(b, "V1"), _version(b, "V2"))


# Rolled cost needs aggregation between levels, which a recursive CTE cannot do:
# one CTE per level, from the deepest parents upwards. Twelve levels cover the
# ternary tree of any test size.
_USAGE = exact_div("CAST(qty_per * 1000000 AS HUGEINT)", "CAST((1 - scrap_rate) * 1000000 AS HUGEINT)", 12)
_LEVELS = 12


def _rolled_sql():
    steps = []
    for n in range(1, _LEVELS + 1):
        total = "CAST(SUM(CAST(k.cost * 1000000 AS HUGEINT) * CAST(u.usage * 1000000000000 AS HUGEINT)) AS HUGEINT)"
        steps.append(
            f"""k{n} AS (SELECT item_id, cost FROM k{n - 1} UNION ALL
                SELECT u.parent, {exact_div(total, "(CAST(MAX(u.base_qty) AS HUGEINT) * 1000000000000000000)", 6)}
                  FROM uses u JOIN k{n - 1} k ON k.item_id = u.child
                 WHERE u.parent NOT IN (SELECT item_id FROM k{n - 1})
                 GROUP BY u.parent HAVING COUNT(*) = (SELECT COUNT(*) FROM uses x WHERE x.parent = u.parent))""")
    return f"""WITH uses AS (
        SELECT h.item_id AS parent, h.base_qty, l.component_item_id AS child, {_USAGE} AS usage
          FROM {{bom_lines}} l JOIN (
               SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY effective_from DESC, bom_id) AS rn
                                FROM {{bom_headers}} WHERE {_LIVE} AND is_default = 'Y') WHERE rn = 1) h ON h.bom_id = l.bom_id),
        k0 AS (SELECT item_id, std_cost AS cost FROM {{items}} WHERE item_id NOT IN (SELECT parent FROM uses)),
        {", ".join(steps)}"""


@query("rolled_cost", "item_id:l rolled_cost:d", _rolled_sql() + f" SELECT item_id, cost AS rolled_cost FROM k{_LEVELS}")
def _(b):
    done, _failed = bom.rolled_cost(b.bom_headers, b.bom_lines, b.items, AS_OF)
    return done


@query("rolled_cost_failures", "item_id:l error_code:s",
       f"""WITH uses AS (
             SELECT h.item_id AS parent, l.component_item_id AS child, l.line_no FROM {{bom_lines}} l JOIN (
               SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY effective_from DESC, bom_id) AS rn
                                FROM {{bom_headers}} WHERE {_LIVE} AND is_default = 'Y') WHERE rn = 1) h ON h.bom_id = l.bom_id),
           loops AS (SELECT parent FROM uses WHERE line_no = 10 AND parent % 10 = 0 UNION SELECT u.parent FROM uses u JOIN loops f ON f.parent = u.child),
           lost AS (SELECT parent FROM uses WHERE line_no = 10 AND parent % 10 = 5 UNION SELECT u.parent FROM uses u JOIN lost f ON f.parent = u.child)
           SELECT parent AS item_id, 'M2002' AS error_code FROM loops
           UNION ALL SELECT parent, 'M1001' FROM lost WHERE parent NOT IN (SELECT parent FROM loops)""")
def _(b):
    return bom.rolled_cost(b.bom_headers, _faulty_lines(b), b.items, AS_OF)[1]


@query("roll_standard_cost", "item_id:l item_type:s std_cost:d",
       _rolled_sql() + f""" SELECT i.item_id, i.item_type,
            CASE WHEN i.item_type IN ('FG', 'SEMI') AND i.status = 'ACTIVE' THEN k.cost ELSE i.std_cost END AS std_cost
            FROM {{items}} i JOIN k{_LEVELS} k ON k.item_id = i.item_id""")
def _(b):
    updated, _failed = costing.roll_standard_cost(b.items, b.bom_headers, b.bom_lines, AS_OF)
    return updated


@query("low_level_code_cycles", "item_id:l error_code:s",
       """WITH u AS (SELECT h.bom_id, h.item_id AS parent, l.component_item_id AS child, l.line_no FROM {bom_lines} l JOIN {bom_headers} h ON h.bom_id = l.bom_id WHERE h.status = 'ACTIVE'),
          back AS (SELECT u.parent, u.child FROM u WHERE u.line_no = 10 AND u.parent % 10 = 0 AND u.child IN (SELECT parent FROM u))
          SELECT parent AS item_id, 'M2002' AS error_code FROM back UNION SELECT child, 'M2002' FROM back""")
def _(b):
    """Every tenth parent also goes into its first component, so the two contain each other."""
    parent = b.bom_headers.filter("status = 'ACTIVE'").select("bom_id", F.col("item_id").alias("__parent"))
    uses = b.bom_lines.join(parent, "bom_id").filter("line_no = 10 AND __parent % 10 = 0").select("__parent", F.col("component_item_id").alias("__child"))
    into = b.bom_lines.filter("line_no = 10").join(parent.withColumnRenamed("__parent", "__child"), "bom_id").join(uses, "__child")
    added = into.withColumns({"component_item_id": F.col("__parent"), "line_no": F.lit(1000)}).select(b.bom_lines.columns)
    return bom.low_level_codes_checked(b.bom_headers, b.bom_lines.unionByName(added), b.items)[1]


@query("low_level_codes", "item_id:l llc:l",
       """WITH e AS (SELECT h.item_id AS parent, l.component_item_id AS child FROM {bom_lines} l
                       JOIN {bom_headers} h ON h.bom_id = l.bom_id WHERE h.status = 'ACTIVE'),
          t AS (SELECT child, 1 AS lvl FROM e WHERE parent IN (SELECT item_id FROM {items} WHERE item_type IN ('FG', 'SEMI'))
                UNION SELECT e.child, t.lvl + 1 FROM t JOIN e ON e.parent = t.child)
          SELECT child AS item_id, MAX(lvl) AS llc FROM t GROUP BY child""")
def _(b):
    return bom.low_level_codes(b.bom_headers, b.bom_lines, b.items)


@query("bom_component_list", "bom_id:l component_list:s",
       """SELECT l.bom_id, string_agg(l.line_no || ':' || i.item_code || ' ' || i.item_name || ' x' ||
                 CASE u.decimal_digits WHEN 0 THEN printf('%.0f', l.qty_per) WHEN 2 THEN printf('%.2f', l.qty_per) ELSE printf('%.3f', l.qty_per) END
                 || ' ' || l.uom, '; ' ORDER BY l.line_no, l.component_item_id) AS component_list
            FROM {bom_lines} l JOIN {items} i ON i.item_id = l.component_item_id LEFT JOIN {uoms} u ON u.uom_code = l.uom GROUP BY l.bom_id""")
def _(b):
    return bom.bom_component_list(b.bom_lines, b.items, b.uoms)


_TREE = """WITH t AS (
    SELECT category_id, parent_category_id, category_code, category_name, 1 AS lvl, '/' || category_code AS path, category_code AS root_code
      FROM {categories} WHERE %s
    UNION ALL
    SELECT c.category_id, c.parent_category_id, c.category_code, c.category_name, t.lvl + 1, t.path || '/' || c.category_code, t.root_code
      FROM t JOIN {categories} c ON c.parent_category_id = t.category_id),
    m AS (SELECT t.*, CASE WHEN category_id IN (SELECT parent_category_id FROM {categories} WHERE parent_category_id IS NOT NULL) THEN 'N' ELSE 'Y' END AS is_leaf FROM t)"""


@query("category_paths", "category_id:s path:s error_code:s",
       _TREE % "parent_category_id IS NULL" + """ SELECT c.category_id, m.path, CASE WHEN m.path IS NULL THEN 'M1003' END AS error_code
         FROM {categories} c LEFT JOIN m ON m.category_id = c.category_id""")
def _(b):
    found, lost = items.category_paths(b.categories)
    return found.unionByName(lost, allowMissingColumns=True)


@query("category_subtree", "category_id:s parent_category_id:s category_code:s category_name:s lvl:l is_leaf:s root_code:s path:s",
       _TREE % "parent_category_id = 'ROOT'" + " SELECT * FROM m")
def _(b):
    roots = b.categories.filter("parent_category_id = 'ROOT'").select("category_id")
    return items.category_subtree(b.categories, roots)


@query("rebuild_category_tree", "category_id:s level_no:l path:s is_leaf:s",
       _TREE % "parent_category_id IS NULL" + """ SELECT c.category_id, m.lvl AS level_no, m.path, m.is_leaf
         FROM {categories} c LEFT JOIN m ON m.category_id = c.category_id""")
def _(b):
    return items.rebuild_category_tree(b.categories)


@query("item_profile", "item_id:l item_type:s valuation_method:s is_stockable:s lead_time_days:l bom_id:l description:s",
       f"""WITH h AS (SELECT item_id, bom_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY effective_from DESC, bom_id) AS rn
             FROM {{bom_headers}} WHERE {_LIVE} AND is_default = 'Y') WHERE rn = 1),
           p AS (SELECT i.*, h.bom_id AS hb, CASE i.item_type WHEN 'RAW' THEN 'FIFO' WHEN 'SVC' THEN 'NONE' ELSE 'STD' END AS vm
                   FROM {{items}} i LEFT JOIN h ON h.item_id = i.item_id)
           SELECT item_id, item_type, vm AS valuation_method, CASE WHEN item_type = 'SVC' THEN 'N' ELSE 'Y' END AS is_stockable,
                  CASE item_type WHEN 'RAW' THEN 7 WHEN 'SVC' THEN 0 ELSE COALESCE(lead_time_days, 1) END AS lead_time_days,
                  CASE WHEN item_type IN ('FG', 'SEMI') THEN hb END AS bom_id,
                  item_code || ' ' || item_name || ' [' || vm || '/' || CASE WHEN item_type = 'SVC' THEN '不可库存' ELSE '可库存' END || ']' AS description FROM p""")
def _(b):
    return items.item_profile(b.items, b.bom_headers, AS_OF)


@query("lookup_items", "ref:l item_code:s item_id:l error_code:s",
       """SELECT l.l_orderkey * 10 + l.l_linenumber AS ref, CASE WHEN l_partkey % 9 = 0 THEN 'Q' ELSE 'P' END || l_partkey AS item_code,
                 i.item_id, CASE WHEN i.item_id IS NULL THEN 'M1001' END AS error_code
            FROM lineitem l LEFT JOIN {items} i ON i.item_code = CASE WHEN l_partkey % 9 = 0 THEN 'Q' ELSE 'P' END || l_partkey""")
def _(b):
    df = b.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"),
        F.concat(F.when(F.col("l_partkey") % 9 == 0, "Q").otherwise("P"), F.col("l_partkey").cast("string")).alias("item_code"))
    found, lost = items.lookup_items(df, b.items)
    return found.unionByName(lost, allowMissingColumns=True)


@query("load_items", "item_code:s item_type:s item_id:l valuation_method:s std_cost:d error_code:s",
       """WITH n AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'P' ELSE 'N' END || p_partkey AS item_code,
                 CASE p_size % 5 WHEN 0 THEN 'RAW' WHEN 1 THEN 'SEMI' WHEN 2 THEN 'FG' WHEN 3 THEN 'SVC' ELSE 'BAD' END AS item_type,
                 CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(20,6)) END AS c FROM part),
          m AS (SELECT n.*, CASE WHEN item_type = 'BAD' THEN 'M1001' WHEN item_code LIKE 'P%' OR COUNT(*) OVER (PARTITION BY item_code) > 1 THEN 'M1004' END AS error_code FROM n)
          SELECT item_code, item_type, (SELECT MAX(p_partkey) FROM part) + ROW_NUMBER() OVER (ORDER BY item_code) AS item_id,
                 CASE item_type WHEN 'SVC' THEN 'NONE' WHEN 'RAW' THEN 'FIFO' ELSE 'STD' END AS valuation_method, COALESCE(c, 0) AS std_cost, error_code
            FROM m WHERE error_code IS NULL
          UNION ALL SELECT item_code, item_type, NULL, NULL, c, error_code FROM m WHERE error_code IS NOT NULL""")
def _(b):
    new = b.part.select(
        F.concat(F.when(F.col("p_partkey") % 10 == 0, "P").otherwise("N"), F.col("p_partkey").cast("string")).alias("item_code"),
        F.expr("CASE p_size % 5 WHEN 0 THEN 'RAW' WHEN 1 THEN 'SEMI' WHEN 2 THEN 'FG' WHEN 3 THEN 'SVC' ELSE 'BAD' END").alias("item_type"),
        F.expr("CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(20,6)) END").alias("std_cost"))
    good, bad = items.load_items(new, b.items)
    return good.unionByName(bad, allowMissingColumns=True)


@query("reclassify_abc", "item_id:l abc_class:s",
       """WITH u AS (SELECT item_id, SUM(total_cost) AS amount FROM {ledger} WHERE direction = 'O'
                       AND txn_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' GROUP BY item_id HAVING SUM(total_cost) > 0),
          r AS (SELECT item_id, SUM(amount) OVER (ORDER BY amount DESC, item_id) AS cum, (SELECT SUM(amount) FROM u) AS total FROM u)
          SELECT i.item_id, CASE WHEN cum * 100 <= total * 80 THEN 'A' WHEN cum * 100 <= total * 95 THEN 'B' WHEN cum IS NOT NULL THEN 'C' END AS abc_class
            FROM {items} i LEFT JOIN r ON r.item_id = i.item_id""")
def _(b):
    return items.reclassify_abc(b.ledger, b.items, "1998-01-01", "2000-12-31")


@query("apply_item_updates", "item_id:l item_name:s std_cost:d list_price:d status:s length_cm:d weight_kg:d error_code:s",
       """SELECT i.item_id, CASE WHEN p_partkey % 3 = 0 THEN 'New ' || p_name ELSE i.item_name END AS item_name,
                 CASE WHEN p_partkey % 6 = 0 THEN 12.5 ELSE i.std_cost END AS std_cost, i.list_price,
                 CASE WHEN p_partkey % 3 = 0 AND p_size > 40 THEN 'BLOCKED' ELSE i.status END AS status,
                 CASE WHEN p_partkey % 3 <> 0 THEN i.length_cm WHEN p_size % 4 <> 0 THEN CAST(p_size AS DECIMAL(10,2)) END AS length_cm,
                 CASE WHEN p_partkey % 3 <> 0 THEN i.weight_kg END AS weight_kg, CAST(NULL AS VARCHAR) AS error_code
            FROM {items} i JOIN part ON p_partkey = i.item_id
          UNION ALL SELECT -p_partkey, 'New ' || p_name, NULL, NULL, CASE WHEN p_size > 40 THEN 'BLOCKED' END,
                 CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DECIMAL(10,2)) END, NULL, 'M1001'
            FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 = 1""")
def _(b):
    upd = b.part.filter("p_partkey % 3 = 0").select(
        F.col("p_partkey").alias("item_id"), F.concat(F.lit("New "), "p_name").alias("item_name"),
        F.expr("CASE WHEN p_partkey % 6 = 0 THEN CAST(12.5 AS DECIMAL(20,6)) END").alias("std_cost"),
        F.lit(None).cast("decimal(20,4)").alias("list_price"),
        F.expr("CASE WHEN p_size > 40 THEN 'BLOCKED' END").alias("status"),
        F.expr("CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DECIMAL(10,2)) END").alias("length_cm"),
        F.lit(None).cast("decimal(10,2)").alias("width_cm"), F.lit(None).cast("decimal(10,2)").alias("height_cm"),
        F.lit(None).cast("decimal(10,3)").alias("weight_kg"))
    unknown = upd.filter("item_id % 7 = 1").withColumns({"item_id": -F.col("item_id"), "std_cost": F.lit(None).cast("decimal(20,6)")})
    out, missing = items.apply_item_updates(b.items_dim, upd.unionByName(unknown))
    flat = out.withColumns({"length_cm": F.col("dim.length_cm"), "weight_kg": F.col("dim.weight_kg")})
    return flat.unionByName(missing, allowMissingColumns=True)


@query("item_full_view", "item_id:l item_code:s category_code:s category_name:s base_uom:s uom_category:s length_cm:d volume_cm3:d volumetric_kg:d chargeable_kg:d",
       f"""WITH v AS (SELECT i.*, c.category_code, c.category_name, u.uom_category, length_cm * width_cm * height_cm AS volume_cm3
             FROM {{items}} i LEFT JOIN {{categories}} c ON c.category_id = i.category_id LEFT JOIN {{uoms}} u ON u.uom_code = i.base_uom),
           k AS (SELECT v.*, {exact_div("CAST(volume_cm3 * 1000000 AS HUGEINT)", "CAST(5000000000 AS HUGEINT)", 3)} AS volumetric_kg FROM v)
           SELECT k.*, CASE WHEN weight_kg IS NOT NULL THEN GREATEST(weight_kg, volumetric_kg) END AS chargeable_kg FROM k""")
def _(b):
    return items.item_full_view(b.items_dim, b.categories, b.uoms)


_LISTS = f"""live AS (SELECT * FROM {{price_lists}} WHERE is_active = 'Y' AND valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to >= DATE '{AS_OF}')),
    dflt AS (SELECT MIN(price_list_id) AS id, COUNT(*) AS n FROM live WHERE is_default = 'Y'),
    picked AS (SELECT c.customer_id, COALESCE(l.price_list_id, (SELECT id FROM dflt)) AS price_list_id,
                      CASE WHEN l.price_list_id IS NULL AND (SELECT n FROM dflt) > 1 THEN 'Y' ELSE 'N' END AS many_defaults
                 FROM {{customers}} c LEFT JOIN live l ON l.price_list_id = c.price_list_id)"""
_MATCH = """r.price_list_id = q.price_list_id AND r.is_active = 'Y' AND r.valid_from <= DATE '%s' AND (r.valid_to IS NULL OR r.valid_to >= DATE '%s')
    AND (r.item_id IS NULL OR r.item_id = q.item_id) AND (r.category_id IS NULL OR r.category_id = q.category_id)
    AND (r.customer_id IS NULL OR r.customer_id = q.customer_id)""" % (AS_OF, AS_OF)
_PREF = """r.priority, CASE WHEN r.item_id IS NULL THEN 1 ELSE 0 END, CASE WHEN r.customer_id IS NULL THEN 1 ELSE 0 END,
    CASE WHEN r.category_id IS NULL THEN 1 ELSE 0 END, r.rule_id"""


@query("pick_price_list", "customer_id:l price_list_id:l many_defaults:s", f"WITH {_LISTS} SELECT * FROM picked")
def _(b):
    return pricing.pick_price_list(b.customers, b.price_lists, AS_OF)


def _pricing_ctes(where):
    # The theta match is evaluated per distinct (item, customer, quantity), which
    # keeps the oracle's join small without leaving out any row.
    return f"""WITH {_LISTS},
        q0 AS (SELECT l.so_line_id AS request_id, l.so_id, l.item_id, o.customer_id, l.qty_ordered AS qty, i.category_id, i.list_price, p.price_list_id
                 FROM {{so_lines}} l JOIN {{sales_orders}} o ON o.so_id = l.so_id JOIN {{items}} i ON i.item_id = l.item_id
                 JOIN picked p ON p.customer_id = o.customer_id WHERE {where}),
        q AS (SELECT DISTINCT price_list_id, item_id, category_id, customer_id, qty FROM q0),
        byitem AS (SELECT q.*, r.rule_id, r.rule_type, r.price_value, r.priority, r.item_id AS ri, r.customer_id AS rc, r.category_id AS rk
                     FROM q JOIN {{price_rules}} r ON {_MATCH} AND r.item_id = q.item_id AND r.min_qty <= q.qty AND (r.max_qty IS NULL OR r.max_qty > q.qty)
                   UNION ALL SELECT q.*, r.rule_id, r.rule_type, r.price_value, r.priority, r.item_id, r.customer_id, r.category_id
                     FROM q JOIN {{price_rules}} r ON {_MATCH} AND r.item_id IS NULL AND r.category_id = q.category_id AND r.min_qty <= q.qty AND (r.max_qty IS NULL OR r.max_qty > q.qty)
                   UNION ALL SELECT q.*, r.rule_id, r.rule_type, r.price_value, r.priority, r.item_id, r.customer_id, r.category_id
                     FROM q JOIN {{price_rules}} r ON {_MATCH} AND r.item_id IS NULL AND r.category_id IS NULL AND r.customer_id = q.customer_id AND r.min_qty <= q.qty AND (r.max_qty IS NULL OR r.max_qty > q.qty)
                   UNION ALL SELECT q.*, r.rule_id, r.rule_type, r.price_value, r.priority, r.item_id, r.customer_id, r.category_id
                     FROM q JOIN {{price_rules}} r ON {_MATCH} AND r.item_id IS NULL AND r.category_id IS NULL AND r.customer_id IS NULL AND r.min_qty <= q.qty AND (r.max_qty IS NULL OR r.max_qty > q.qty)),
        won AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY price_list_id, item_id, customer_id, qty
                  ORDER BY priority, CASE WHEN ri IS NULL THEN 1 ELSE 0 END, CASE WHEN rc IS NULL THEN 1 ELSE 0 END, CASE WHEN rk IS NULL THEN 1 ELSE 0 END, rule_id) AS rn FROM byitem) WHERE rn = 1),
        priced AS (SELECT q0.*, w.rule_id, w.rule_type, CASE WHEN w.rule_type IN ('LIST', 'OVERRIDE') THEN w.price_value ELSE q0.list_price END AS base_price,
               CASE w.rule_type WHEN 'LIST' THEN w.price_value WHEN 'OVERRIDE' THEN w.price_value
                    WHEN 'DISCOUNT_PCT' THEN CAST(ROUND(CAST(q0.list_price AS DECIMAL(16,4)) * (1 - CAST(w.price_value AS DECIMAL(10,6))), 6) AS DECIMAL(20,6))
                    WHEN 'DISCOUNT_AMT' THEN GREATEST(q0.list_price - w.price_value, 0) ELSE q0.list_price END AS final_price
          FROM q0 LEFT JOIN won w ON w.item_id = q0.item_id AND w.customer_id = q0.customer_id AND w.qty = q0.qty AND w.price_list_id = q0.price_list_id)"""


def _requests(b, orders=None):
    o = b.sales_orders.select("so_id", "customer_id") if orders is None else orders
    return b.so_lines.join(o, "so_id").select(
        F.col("so_line_id").alias("request_id"), "item_id", *[c for c in o.columns if c != "so_id"], F.col("qty_ordered").alias("qty"))


@query("match_price_rules", "request_id:s rule_id:s rule_type:s price_value:d",
       _pricing_ctes("TRUE") + """ SELECT q0.request_id, w.rule_id, w.rule_type, w.price_value FROM q0 JOIN won w
         ON w.item_id = q0.item_id AND w.customer_id = q0.customer_id AND w.qty = q0.qty AND w.price_list_id = q0.price_list_id""")
def _(b):
    lists = pricing.pick_price_list(b.customers, b.price_lists, AS_OF).select("customer_id", "price_list_id")
    # the lists join the orders, which are fewer than the lines
    full = _requests(b, b.sales_orders.select("so_id", "customer_id").join(lists, "customer_id"))
    full = full.join(b.items.select("item_id", "category_id"), "item_id")
    return pricing.match_price_rules(full, b.price_rules, AS_OF)


@query("price", "request_id:s item_id:l customer_id:l qty:d price_list_id:l base_price:d final_price:d rule_id:s rule_type:s",
       _pricing_ctes("TRUE") + " SELECT * FROM priced")
def _(b):
    return pricing.price(_requests(b), b.items, b.customers, b.price_lists, b.price_rules, AS_OF)


@query("price_rejects", "request_id:l error_code:s",
       "SELECT o_orderkey AS request_id, 'M1001' AS error_code FROM orders WHERE o_orderkey NOT IN (SELECT item_id FROM {items})")
def _(b):
    req = b.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("customer_id"))
    return pricing.price_rejects(req, b.items, b.customers, b.price_lists, AS_OF)


_DISC = exact_div("CAST((base_price - final_price) * 1000000 AS HUGEINT)", "CAST(NULLIF(base_price, 0) * 1000000 AS HUGEINT)", 4)
_REPRICED = _pricing_ctes("o.status IN ('DRAFT', 'CONFIRMED') AND l.line_status <> 'CANCELLED'") + f""",
    d AS (SELECT *, CASE WHEN base_price > 0 AND final_price < base_price THEN LEAST({_DISC}, 0.9999) ELSE 0 END AS disc FROM priced)"""


@query("reprice_orders_lines", "so_line_id:s so_id:l unit_price:d discount_pct:d",
       _REPRICED + """ SELECT l.so_line_id, l.so_id, COALESCE(d.base_price, l.unit_price) AS unit_price, COALESCE(d.disc, l.discount_pct) AS discount_pct
         FROM {so_lines} l LEFT JOIN d ON d.request_id = l.so_line_id""")
def _(b):
    return pricing.reprice_orders(b.sales_orders, b.so_lines, b.items, b.customers, b.price_lists, b.price_rules, AS_OF)[1]


@query("reprice_orders", "so_id:l status:s total_amount:d",
       _REPRICED + """, t AS (SELECT so_id, SUM(CAST(ROUND(CAST(CAST(qty AS DECIMAL(12,4)) * CAST(base_price AS DECIMAL(16,6)) AS DECIMAL(28,10)) * CAST(1 - disc AS DECIMAL(8,4)), 4) AS DECIMAL(24,4))) AS total FROM d GROUP BY so_id)
         SELECT o.so_id, o.status, CASE WHEN o.status IN ('DRAFT', 'CONFIRMED') THEN COALESCE(t.total, 0) ELSE o.total_amount END AS total_amount
           FROM {sales_orders} o LEFT JOIN t ON t.so_id = o.so_id""")
def _(b):
    return pricing.reprice_orders(b.sales_orders, b.so_lines, b.items, b.customers, b.price_lists, b.price_rules, AS_OF)[0]


def _with_unknown_items(b):
    return b.so_lines.withColumn("item_id", F.when(F.col("item_id") % 70 == 0, F.col("item_id") + 900000000).otherwise(F.col("item_id")))


_UNPRICED = """SELECT l.so_id, l.so_line_id, o.status FROM {so_lines} l JOIN {sales_orders} o ON o.so_id = l.so_id
                WHERE o.status IN ('DRAFT', 'CONFIRMED') AND l.line_status <> 'CANCELLED' AND l.item_id % 70 = 0"""


@query("reprice_orders_rejects", "so_id:l so_line_id:s status:s error_code:s",
       f"""SELECT so_id, so_line_id, status, 'M1001' AS error_code FROM ({_UNPRICED})
           UNION ALL SELECT so_id, NULL, status, 'M6001' FROM {{sales_orders}} WHERE status NOT IN ('DRAFT', 'CONFIRMED')""")
def _(b):
    return pricing.reprice_orders(b.sales_orders, _with_unknown_items(b), b.items, b.customers, b.price_lists, b.price_rules, AS_OF)[2]


@query("reprice_orders_held", "so_id:l so_line_id:s total_amount:d unit_price:d discount_pct:d",
       f"""SELECT l.so_id, l.so_line_id, o.total_amount, l.unit_price, l.discount_pct FROM {{so_lines}} l JOIN {{sales_orders}} o ON o.so_id = l.so_id
            WHERE o.so_id IN (SELECT so_id FROM ({_UNPRICED}))""")
def _(b):
    """Orders with a line that cannot be priced, as they come out."""
    orders, lines, rejects = pricing.reprice_orders(b.sales_orders, _with_unknown_items(b), b.items, b.customers, b.price_lists, b.price_rules, AS_OF)
    return lines.join(orders.select("so_id", "total_amount"), "so_id").join(rejects.filter("so_line_id IS NOT NULL").select("so_id"), "so_id", "left_semi")


@query("effective_rules", "request_id:l rule_id:s priority:l match_seq:l hit_flag:s",
       f"""WITH {_LISTS}, q AS (SELECT o.o_orderkey AS request_id, o.o_orderkey % (SELECT MAX(p_partkey) + 1 FROM part) AS item_id, o.o_custkey AS customer_id, p.price_list_id, i.category_id
              FROM orders o JOIN picked p ON p.customer_id = o.o_custkey JOIN {{items}} i ON i.item_id = o.o_orderkey % (SELECT MAX(p_partkey) + 1 FROM part)),
           m AS (SELECT q.request_id, r.rule_id, r.priority, ROW_NUMBER() OVER (PARTITION BY q.request_id ORDER BY {_PREF}) AS match_seq
                   FROM q JOIN {{price_rules}} r ON {_MATCH})
           SELECT *, CASE WHEN match_seq = 1 THEN 'Y' ELSE 'N' END AS hit_flag FROM m""")
def _(b):
    n = b.part.agg(F.max("p_partkey") + 1).scalar()
    req = b.orders.select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % n).alias("item_id"), F.col("o_custkey").alias("customer_id"))
    return pricing.effective_rules(req, b.items, b.customers, b.price_lists, b.price_rules, AS_OF)
