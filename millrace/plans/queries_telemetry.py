"""Telemetry and quality jobs over events and orders."""

from pyspark.sql import functions as F

from millrace.operators import quality, telemetry
from millrace.plans.catalog import query

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_CALLS = f"""ev AS (SELECT event_id, user_id, event_type, ts, CAST(FLOOR(event_id / 2) AS BIGINT) AS call_id, event_id % 2 = 0 AS is_start, {_K} AS k FROM events),
  calls AS (SELECT s.call_id, s.user_id AS run, s.event_type AS tool, CASE WHEN e.event_type = 'error' THEN 'error' ELSE 'completed' END AS state,
                   CAST(FLOOR((epoch_us(e.ts) - epoch_us(s.ts)) / 1000) AS BIGINT) AS duration_ms,
                   CASE s.k % 3 WHEN 0 THEN 'translate' WHEN 1 THEN 'review' ELSE 'fix' END AS phase
              FROM ev s JOIN ev e ON e.call_id = s.call_id AND s.is_start AND NOT e.is_start WHERE s.k <> 5 AND e.k <> 7)"""


def _props(b):
    return b.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def _phase():
    return F.when(F.col("k") % 3 == 0, "translate").when(F.col("k") % 3 == 1, "review").otherwise("fix")


def calls(b):
    start = F.col("event_id") % 2 == 0
    rows = _props(b).filter(F.when(start, F.col("k") != 5).otherwise(F.col("k") != 7)).select(
        F.floor(F.col("event_id") / 2).cast("bigint").alias("call_id"), F.when(start, "called").otherwise("completed").alias("kind"),
        F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("state"), "ts",
        F.col("user_id").alias("run"), _phase().alias("phase"))
    return telemetry.pair_calls(rows)


@query("pair_calls", "call_id:l run:l tool:s state:s duration_ms:l", f"WITH {_CALLS} SELECT * FROM calls")
def _(b):
    return calls(b)


_PHASES = f"""{_CALLS},
  st AS (SELECT user_id AS run, CASE k % 3 WHEN 0 THEN 'translate' WHEN 1 THEN 'review' ELSE 'fix' END AS phase, ts, CAST(value AS DECIMAL(18,6)) AS cost, k FROM (SELECT *, {_K} AS k FROM events)),
  ph AS (SELECT run, phase, COUNT(*) AS api_call_count, SUM(cost) AS total_cost, SUM(k) AS i, SUM(2 * k) AS o, SUM(k % 7) AS r, SUM(k % 5) AS cr, SUM(k % 2) AS cw,
                CAST(FLOOR((epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1000) AS BIGINT) AS wall_duration_ms FROM st GROUP BY 1, 2),
  tl AS (SELECT run, phase, tool, COUNT(*) AS c, COUNT(*) FILTER (WHERE state = 'error') AS e FROM calls GROUP BY 1, 2, 3),
  tp AS (SELECT run, phase, SUM(c) AS n, string_agg(tool || ':' || c || ':' || e, ';' ORDER BY tool) AS tools FROM tl GROUP BY 1, 2)"""
_STATS = "array_join(array_sort(transform(map_entries(tool_stats), x -> concat(x.key, ':', x.value.count, ':', x.value.errors))), ';')"


def phases(b):
    k = F.col("k")
    cache = F.struct((k % 5).alias("read"), (k % 2).alias("write"))
    tokens = F.struct(k.alias("input"), (k * 2).alias("output"), (k % 7).alias("reasoning"), cache.alias("cache"))
    steps = _props(b).select(F.col("user_id").alias("run"), _phase().alias("phase"), "ts", F.col("value").cast("decimal(18,6)").alias("cost"), tokens.alias("tokens"))
    return telemetry.phase_metrics(telemetry.flatten_tokens(steps), calls(b))


@query("phase_metrics", "run:l phase:s api_call_count:l total_cost:d input:l output:l reasoning:l cacheRead:l cacheWrite:l wall_duration_ms:l tool_call_count:l tools:s",
       f"""WITH {_PHASES} SELECT ph.run, ph.phase, api_call_count, total_cost, i AS input, o AS output, r AS reasoning, cr AS cacheRead, cw AS cacheWrite, wall_duration_ms,
             COALESCE(n, 0) AS tool_call_count, tools FROM ph LEFT JOIN tp ON tp.run = ph.run AND tp.phase = ph.phase""")
def _(b):
    return phases(b).withColumn("tools", F.expr(_STATS))


_RUNS = f"""{_PHASES}, rt AS (SELECT run, string_agg(tool || ':' || c || ':' || e, ';' ORDER BY tool) AS tools, SUM(c) AS n FROM (SELECT run, tool, SUM(c) AS c, SUM(e) AS e FROM tl GROUP BY 1, 2) GROUP BY 1),
  rn AS (SELECT ph.run, SUM(api_call_count) AS api_call_count, SUM(total_cost) AS total_cost, SUM(i) AS i, SUM(o) AS o, SUM(r) AS r, SUM(cr) AS cr, SUM(cw) AS cw, SUM(wall_duration_ms) AS wall_duration_ms,
                COUNT(*) FILTER (WHERE phase = 'fix') AS fix_cycles, COALESCE(SUM(CASE WHEN phase = 'fix' THEN total_cost END), 0) AS fix_cost FROM ph GROUP BY 1)"""


@query("run_metrics", "run:l api_call_count:l total_cost:d input:l cacheWrite:l wall_duration_ms:l tool_call_count:l fix_cycles:l fix_cost:d tools:s",
       f"WITH {_RUNS} SELECT rn.run, api_call_count, total_cost, i AS input, cw AS cacheWrite, wall_duration_ms, COALESCE(n, 0) AS tool_call_count, fix_cycles, fix_cost, tools FROM rn LEFT JOIN rt ON rt.run = rn.run")
def _(b):
    return telemetry.run_metrics(phases(b)).withColumn("tools", F.expr(_STATS))


@query("efficiency", "run:l fix_cost_ratio:d token_total:l cost_per_unit:d throughput_per_hour:d",
       f"""WITH {_RUNS}, x AS (SELECT rn.*, CAST(total_cost AS DOUBLE) AS c, CAST(fix_cost AS DOUBLE) AS f, CAST(run % 9 AS DOUBLE) AS u, CAST(wall_duration_ms AS DOUBLE) AS ms FROM rn)
           SELECT run, CASE WHEN c > 0 THEN FLOOR(f / c * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE 0 END AS fix_cost_ratio, i + o + r + cr + cw AS token_total,
                  CASE WHEN c > 0 AND u > 0 THEN FLOOR(c / u * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS cost_per_unit,
                  CASE WHEN ms > 0 AND u > 0 THEN FLOOR(u / ms * 3600000.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE END AS throughput_per_hour FROM x""")
def _(b):
    return telemetry.efficiency(telemetry.run_metrics(phases(b)).withColumn("units", F.col("run") % 9))


_JS = lambda e: f"FLOOR({e} + 0.5::DOUBLE)"
_REST = lambda a, b: f"CASE WHEN {b} > 0 THEN GREATEST(0, {_JS(f'(1.0::DOUBLE - CAST({a} AS DOUBLE) / {b}) * 100')}) ELSE 100 END"
_QIN = """q AS (SELECT o_custkey AS grp, MIN(o_orderkey) % 3 <> 0 AS compiled, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS tests_passed, COUNT(*) FILTER (WHERE o_orderstatus <> 'O') AS tests_total,
    COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS todo_count, COUNT(DISTINCT o_orderpriority) AS file_count, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS violations, COUNT(*) AS loc,
    CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 101 AS DOUBLE) / 100.0::DOUBLE END AS coverage, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS compat_violations FROM orders GROUP BY o_custkey)"""


def quality_input(b):
    f = lambda c: F.count_if(c)
    return b.orders.groupBy(F.col("o_custkey").alias("grp")).agg(
        (F.min("o_orderkey") % 3 != 0).alias("compiled"), f(F.col("o_orderstatus") == "F").alias("tests_passed"), f(F.col("o_orderstatus") != "O").alias("tests_total"),
        f(F.col("o_orderpriority") == "5-LOW").alias("todo_count"), F.count_distinct("o_orderpriority").alias("file_count"),
        f(F.col("o_orderpriority") == "1-URGENT").alias("violations"), F.count(F.lit(1)).alias("loc"), f(F.col("o_orderstatus") == "P").alias("compat_violations"),
    ).withColumn("coverage", F.when(F.col("grp") % 6 == 0, None).otherwise((F.col("grp") % 101).cast("double") / 100.0))


_WQ = f"""{_QIN}, s AS (SELECT *, CASE WHEN compiled THEN 100 ELSE 0 END AS compile, CASE WHEN tests_total > 0 THEN {_JS('CAST(tests_passed AS DOUBLE) / tests_total * 100')} ELSE 0 END AS test,
   {_REST('todo_count', 'file_count')} AS todo, {_REST('violations', 'loc')} AS style, COALESCE({_JS('coverage * 100')}, 0) AS coverage_score, {_REST('compat_violations', 'file_count')} AS compat FROM q),
  wq AS (SELECT *, {_JS(' + '.join(f'CAST({c} AS DOUBLE) * {w}::DOUBLE' for c, w in [('compile', .25), ('test', .2), ('todo', .1), ('style', .15), ('coverage_score', .15), ('compat', .15)]))} AS total FROM s)"""


@query("weighted_quality", "grp:l compile:l test:l todo:l style:l coverage_score:l compat:l total:l", f"WITH {_WQ} SELECT * FROM wq")
def _(b):
    return quality.weighted_quality(quality_input(b))


def structure_input(b):
    return quality_input(b).select(
        "grp", F.col("loc").alias("sql_source"), (F.col("tests_total") + F.col("grp") % 4).alias("sql_target"), (F.col("grp") % 101).alias("table_score"),
        (F.col("grp") % 87).alias("member_score"), F.col("todo_count").alias("exceptions_source"), F.col("violations").alias("exceptions_target"),
        ((F.col("grp") % 50).cast("double") / 50.0).alias("cosine"))


_SS = f"""{_QIN}, si AS (SELECT grp, CASE WHEN loc > 0 THEN LEAST(100, {_JS('CAST(tests_total + grp % 4 AS DOUBLE) / loc * 100')}) ELSE 0 END AS sql, grp % 101 AS tables, grp % 87 AS members,
    CASE WHEN todo_count > 0 THEN GREATEST(0, {_JS('(1.0::DOUBLE - ABS(CAST(violations AS DOUBLE) / todo_count - 1.0::DOUBLE)) * 100')}) ELSE 100 END AS exceptions,
    {_JS('CAST(grp % 50 AS DOUBLE) / 50.0::DOUBLE * 100')} AS control_flow FROM q),
  ss AS (SELECT *, {_JS(' + '.join(f'CAST({c} AS DOUBLE) * {w}::DOUBLE' for c, w in [('sql', .25), ('tables', .25), ('members', .25), ('exceptions', .125), ('control_flow', .125)]))} AS total FROM si)"""


@query("structure_score", "grp:l sql:l tables:l members:l exceptions:l control_flow:l total:l", f"WITH {_SS} SELECT * FROM ss")
def _(b):
    return quality.structure_score(structure_input(b))


_LAY = [("l1", 0.1), ("l2", 0.3), ("l3", 0.35), ("l4", 0.25)]
_LW = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for n, w in _LAY)
_LS = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN CAST({n} AS DOUBLE) * {w}::DOUBLE / w ELSE 0.0::DOUBLE END" for n, w in _LAY)


@query("overall_score", "o_custkey:l total:d grade:s",
       f"""WITH x AS (SELECT o_custkey, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 101 END AS l1, CASE WHEN o_custkey % 5 <> 0 THEN MIN(o_orderkey) % 101 END AS l2,
               CASE WHEN o_custkey % 7 <> 0 THEN MAX(o_orderkey) % 101 END AS l3, CASE WHEN o_custkey % 2 = 0 THEN 90 + o_custkey % 11 END AS l4 FROM orders GROUP BY 1),
           y AS (SELECT *, {_LW} AS w FROM x), z AS (SELECT *, CASE WHEN w > 0 THEN FLOOR(({_LS}) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE ELSE 0 END AS total FROM y)
           SELECT *, CASE WHEN total >= 95 THEN 'A+' WHEN total >= 85 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 50 THEN 'C' ELSE 'D' END AS grade FROM z""")
def _(b):
    k = F.col("o_custkey")
    rows = b.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).select(
        "o_custkey", F.when(k % 4 != 0, k % 101).alias("l1"), F.when(k % 5 != 0, F.col("lo") % 101).alias("l2"),
        F.when(k % 7 != 0, F.col("hi") % 101).alias("l3"), F.when(k % 2 == 0, k % 11 + 90).alias("l4"))
    return quality.overall_score(rows)


_REV = """rv AS (SELECT 'P' || c_custkey AS package, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 4 <> 0 END AS passed, CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE c_custkey % 101 END AS score,
     CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 5 WHEN c_custkey % 33 = 1 THEN 2 ELSE 0 END AS must_fix, c_custkey % 6 AS todos FROM customer WHERE c_mktsegment <> 'BUILDING'),
  bl AS (SELECT 'P' || o_custkey AS package, COUNT(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY 1),
  ok AS (SELECT rv.*, COALESCE(n, 0) = 0 AS static_passed FROM rv LEFT JOIN bl ON bl.package = rv.package WHERE passed IS NOT NULL AND score IS NOT NULL AND NOT (passed AND must_fix > 0))"""


def review(b):
    k = F.col("c_custkey")
    pkg = lambda c: F.concat(F.lit("P"), F.col(c).cast("string")).alias("package")
    reviews = b.customer.filter("c_mktsegment <> 'BUILDING'").select(
        pkg("c_custkey"), F.when(k % 9 != 0, k % 4 != 0).alias("passed"), F.when(k % 21 != 0, k % 101).alias("score"),
        F.when(k % 4 == 0, k % 5).when(k % 33 == 1, 2).otherwise(0).alias("must_fix"), (k % 6).alias("todos"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    findings = b.orders.select(pkg("o_custkey"), F.when((F.col("o_orderstatus") == "F") & urgent, "major").otherwise("minor").alias("severity"))
    return quality.review_summary(reviews, findings, b.customer.select(pkg("c_custkey")))


@query("review_summary", "package_count:l all_passed:b total_must_fix:l total_todos:l",
       f"WITH {_REV} SELECT COUNT(*) AS package_count, BOOL_AND(passed AND static_passed) AS all_passed, SUM(must_fix) AS total_must_fix, SUM(todos) AS total_todos FROM ok")
def _(b):
    return review(b)["summary"]


@query("review_summary_packages", "package:s kind:s passed:b static_passed:b score:l must_fix:l",
       f"""WITH {_REV} SELECT package, 'result' AS kind, passed, static_passed, score, must_fix FROM ok
           UNION ALL SELECT 'P' || c_custkey, 'missing', NULL, NULL, NULL, NULL FROM customer WHERE 'P' || c_custkey NOT IN (SELECT package FROM ok)
           UNION ALL SELECT package, 'skipped', passed, NULL, score, must_fix FROM rv WHERE package NOT IN (SELECT package FROM ok)""")
def _(b):
    out = review(b)
    tag = lambda n, k: out[n].withColumn("kind", F.lit(k))
    return tag("results", "result").unionByName(tag("missing", "missing"), True).unionByName(tag("skipped", "skipped"), True)


_CNT = """cn AS (SELECT 'pkg' || l_suppkey AS package, CASE WHEN l_linenumber % 2 = 0 THEN 'LINE' ELSE 'BRANCH' END AS type,
    CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) % 6 END AS missed, CAST(l_quantity AS BIGINT) AS covered FROM lineitem),
  ag AS (SELECT package, COALESCE(SUM(missed) FILTER (WHERE type = 'LINE'), 0) AS lm, COALESCE(SUM(covered) FILTER (WHERE type = 'LINE'), 0) AS lc,
                COALESCE(SUM(missed) FILTER (WHERE type = 'BRANCH'), 0) AS bm, COALESCE(SUM(covered) FILTER (WHERE type = 'BRANCH'), 0) AS bc FROM cn GROUP BY 1)"""


@query("coverage_summary", "package:s line_rate:d branch_rate:d passed:b",
       f"""WITH {_CNT}, r AS (SELECT package, CASE WHEN lm + lc > 0 THEN CAST(lc AS DOUBLE) / CAST(lm + lc AS DOUBLE) ELSE 1 END AS line_rate, CASE WHEN bm + bc > 0 THEN CAST(bc AS DOUBLE) / CAST(bm + bc AS DOUBLE) ELSE 1 END AS branch_rate FROM ag)
           SELECT *, line_rate >= 0.9::DOUBLE AND branch_rate >= 0.75::DOUBLE AS passed FROM r""")
def _(b):
    return quality.coverage_summary(_counters(b))["packages"]


def _counters(b):
    q = F.col("l_quantity").cast("bigint")
    return b.lineitem.select(
        F.concat(F.lit("pkg"), F.col("l_suppkey").cast("string")).alias("package"), F.concat(F.lit("S"), F.col("l_partkey").cast("string"), F.lit(".java")).alias("source"),
        F.when(F.col("l_linenumber") % 2 == 0, "LINE").otherwise("BRANCH").alias("type"), F.when(F.col("l_suppkey") % 4 == 0, 0).otherwise(q % 6).alias("missed"), q.alias("covered"))


def _coverage(b):
    q, key = F.col("l_quantity").cast("bigint"), F.concat(F.lit("S"), F.col("l_partkey").cast("string"), F.lit(".java"))
    lines = b.lineitem.select(F.concat(F.lit("pkg"), F.col("l_suppkey").cast("string")).alias("package"), key.alias("source"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("nr"),
                              (q % 3).alias("mi"), q.alias("ci"), F.when(q % 5 == 0, 1).otherwise(0).alias("mb"), F.lit(0).alias("cb"))
    # every part should have a file at its own number's supplier: many of them are in no report
    files = b.part.select(F.concat(F.lit("app/src/main/java/pkg"), (F.col("p_partkey") % 10 + 1).cast("string"), F.lit("/S"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("path"),
                          F.col("p_brand").alias("owner"))
    return quality.coverage_summary(_counters(b), lines, files=files)


_RATE = lambda m, c: f"CASE WHEN {m} + {c} > 0 THEN CAST({c} AS DOUBLE) / CAST({m} + {c} AS DOUBLE) ELSE 1 END"


@query("coverage_total", "line_rate:d branch_rate:d executed:b passed:b",
       f"""WITH {_CNT}, t AS (SELECT SUM(lm) AS lm, SUM(lc) AS lc, SUM(bm) AS bm, SUM(bc) AS bc FROM ag), r AS (SELECT {_RATE('lm', 'lc')} AS line_rate, {_RATE('bm', 'bc')} AS branch_rate FROM t)
           SELECT line_rate, branch_rate, TRUE AS executed, line_rate >= 0.9::DOUBLE AND branch_rate >= 0.75::DOUBLE AS passed FROM r""")
def _(b):
    return _coverage(b)["total"]


@query("coverage_gaps", "package:s source:s nr:l mi:l mb:l",
       """SELECT 'pkg' || l_suppkey AS package, 'S' || l_partkey || '.java' AS source, l_orderkey * 8 + l_linenumber AS nr, CAST(l_quantity AS BIGINT) % 3 AS mi,
                 CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS mb FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 3 > 0 OR CAST(l_quantity AS BIGINT) % 5 = 0""")
def _(b):
    return _coverage(b)["gaps"]


_FILES = """fl AS (SELECT 'app/src/main/java/pkg' || (p_partkey % 10 + 1) || '/S' || p_partkey || '.java' AS path, p_brand AS owner, p_partkey, p_partkey % 10 + 1 AS supp FROM part),
   mt AS (SELECT l_partkey, l_suppkey, l_linenumber % 2 = 0 AS is_line, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) % 6 END AS missed, CAST(l_quantity AS BIGINT) AS covered FROM lineitem),
   jn AS (SELECT fl.path, fl.owner, mt.* FROM fl LEFT JOIN mt ON mt.l_partkey = fl.p_partkey AND mt.l_suppkey = fl.supp)"""


@query("coverage_owners", "owner:s line_rate:d branch_rate:d executed:b passed:b",
       f"""WITH {_FILES}, t AS (SELECT owner, COUNT(l_partkey) > 0 AS executed, COALESCE(SUM(missed) FILTER (WHERE is_line), 0) AS lm, COALESCE(SUM(covered) FILTER (WHERE is_line), 0) AS lc,
             COALESCE(SUM(missed) FILTER (WHERE NOT is_line), 0) AS bm, COALESCE(SUM(covered) FILTER (WHERE NOT is_line), 0) AS bc FROM jn GROUP BY 1),
           r AS (SELECT owner, executed, CASE WHEN executed THEN {_RATE('lm', 'lc')} END AS line_rate, CASE WHEN executed THEN {_RATE('bm', 'bc')} END AS branch_rate FROM t)
           SELECT *, line_rate >= 0.9::DOUBLE AND branch_rate >= 0.75::DOUBLE AS passed FROM r""")
def _(b):
    return _coverage(b)["owners"]


@query("coverage_skipped", "path:s owner:s", f"WITH {_FILES} SELECT path, owner FROM jn WHERE l_partkey IS NULL")
def _(b):
    return _coverage(b)["skipped"]


# Runs are suppliers (their lines are objects and reviews) and users (their events are builds and phases).
@query("run_business", "run:l package_count:l procedure_count:l table_count:l source_file_count:l test_file_count:l todos_remaining:l fix_cycles:l build_success:b review_average_score:d review_passed_rate:d",
       f"""WITH ob AS (SELECT DISTINCT l_suppkey AS run, l_linenumber AS kind, l_partkey AS name FROM lineitem WHERE l_linenumber <= 5),
           oc AS (SELECT run, COUNT(*) FILTER (WHERE kind = 1) AS k1, COUNT(*) FILTER (WHERE kind = 2) AS k2, COUNT(*) FILTER (WHERE kind = 3) AS k3, COUNT(*) FILTER (WHERE kind = 4) AS k4,
                         COUNT(*) FILTER (WHERE kind = 5) AS k5 FROM ob GROUP BY 1),
           rv AS (SELECT l_suppkey AS run, l_quantity AS q, l_linenumber AS todos, ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 8 + l_linenumber DESC, l_quantity DESC, l_linenumber DESC) AS rn FROM lineitem),
           rc AS (SELECT run, CAST(SUM(CAST(q * 2 AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS score, CAST(COUNT(*) FILTER (WHERE q > 20) AS DOUBLE) / COUNT(*) AS rate, SUM(todos) AS todos FROM rv WHERE rn = 1 GROUP BY 1),
           ev AS (SELECT user_id AS run, arg_max(event_type <> 'error', event_id) AS ok, COUNT(*) FILTER (WHERE {_K} % 3 = 2) AS fixes FROM events GROUP BY 1),
           ru AS (SELECT run FROM rc UNION SELECT run FROM ev)
           SELECT ru.run, COALESCE(k1, 0) AS package_count, COALESCE(k2, 0) AS procedure_count, COALESCE(k3, 0) AS table_count, COALESCE(k4, 0) AS source_file_count, COALESCE(k5, 0) AS test_file_count,
                  COALESCE(todos, 0) AS todos_remaining, COALESCE(fixes, 0) AS fix_cycles, ok AS build_success, score AS review_average_score, rate AS review_passed_rate
             FROM ru LEFT JOIN oc ON oc.run = ru.run LEFT JOIN rc ON rc.run = ru.run LEFT JOIN ev ON ev.run = ru.run""")
def _(b):
    kinds = F.array(*[F.lit(k) for k in telemetry.OBJECT_COUNTS])
    objects = b.lineitem.select(F.col("l_suppkey").alias("run"), F.get(kinds, F.col("l_linenumber").cast("int") - 1).alias("kind"), F.col("l_partkey").alias("name"))
    reviews = b.lineitem.select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("package"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
                                (F.col("l_quantity") * 2).alias("score"), (F.col("l_quantity") > 20).alias("passed"), F.col("l_linenumber").alias("todos"))
    builds = b.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))
    steps = _props(b).select(F.col("user_id").alias("run"), _phase().alias("phase"))
    return telemetry.run_business(objects, reviews, builds, steps)


_GATE = f"""{_QIN}, gi AS (SELECT grp, tests_passed AS done, tests_total AS total, file_count AS mapped, todo_count AS completed, grp % 3 <> 0 AS passed, grp % 101 AS score,
     grp % 2 = 0 AS all_passed, violations AS must_fix, compiled AS build_ok, grp % 5 <> 0 AS tests_executed, tests_passed, tests_total FROM q)"""


@query("quality_gates", "grp:l gate:s severity:s value:d",
       f"""WITH {_GATE}
           SELECT grp, 'G1' AS gate, 'blocking' AS severity, CAST(done AS DOUBLE) / total AS value FROM gi WHERE total > 0 AND CAST(done AS DOUBLE) / total < 0.8::DOUBLE
           UNION ALL SELECT grp, 'G2', 'warning', mapped FROM gi WHERE mapped < completed
           UNION ALL SELECT grp, 'G3', 'blocking', score FROM gi WHERE passed AND score < 70
           UNION ALL SELECT grp, 'G4', 'blocking', must_fix FROM gi WHERE all_passed AND must_fix > 0
           UNION ALL SELECT grp, 'G5', 'blocking', 0 FROM gi WHERE all_passed AND NOT build_ok
           UNION ALL SELECT grp, 'G6', 'warning', CAST(tests_passed AS DOUBLE) / tests_total FROM gi WHERE tests_executed AND tests_total > 0 AND CAST(tests_passed AS DOUBLE) / tests_total < 0.7::DOUBLE""")
def _(b):
    g = F.col("grp")
    rows = quality_input(b).select(
        "grp", F.col("tests_passed").alias("done"), F.col("tests_total").alias("total"), F.col("file_count").alias("mapped"), F.col("todo_count").alias("completed"),
        (g % 3 != 0).alias("passed"), (g % 101).alias("score"), (g % 2 == 0).alias("all_passed"), F.col("violations").alias("must_fix"), F.col("compiled").alias("build_ok"),
        (g % 5 != 0).alias("tests_executed"), "tests_passed", "tests_total")
    return quality.quality_gates(rows)


@query("completion_summary", "phase:s total_packages:l completed_packages:l failed_packages:l completion_ratio:d g1_passed:b",
       """WITH s AS (SELECT event_type AS phase, CASE WHEN user_id % 6 = 0 THEN 'failed' ELSE 'completed' END AS status, CAST(FLOOR(value) AS BIGINT) AS total, CAST(FLOOR(CAST(FLOOR(value) AS DOUBLE) * 0.85::DOUBLE) AS BIGINT) AS done
              FROM events),
          a AS (SELECT phase, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'completed') AS c, SUM(total) FILTER (WHERE status = 'completed') AS t, SUM(done) FILTER (WHERE status = 'completed') AS d FROM s GROUP BY 1)
          SELECT phase, n AS total_packages, c AS completed_packages, n - c AS failed_packages, CAST(d AS DOUBLE) / CAST(t AS DOUBLE) AS completion_ratio, CAST(d AS DOUBLE) / CAST(t AS DOUBLE) >= 0.8::DOUBLE AS g1_passed FROM a""")
def _(b):
    total = F.floor("value")
    rows = b.events.select(F.col("event_type").alias("phase"), F.when(F.col("user_id") % 6 == 0, "failed").otherwise("completed").alias("status"),
                           total.alias("total"), F.floor(total * 0.85).alias("done"))
    return quality.completion_summary(rows)


@query("diff_tables", "p_partkey:l field:s expected:s actual:s",
       """WITH e AS (SELECT p_partkey, p_name, p_size, CAST(p_size AS DOUBLE) / 8 AS ratio FROM part WHERE p_partkey % 40 <> 1),
          a AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN p_name || '!' ELSE p_name END AS p_name, CASE WHEN p_partkey % 19 = 0 THEN p_size + 1 ELSE p_size END AS p_size,
                       CAST(p_size AS DOUBLE) / 8 + CASE WHEN p_partkey % 23 = 0 THEN 0.5 WHEN p_partkey % 3 = 0 THEN 0.00001 ELSE 0 END AS ratio FROM part WHERE p_partkey % 40 <> 2),
          j AS (SELECT COALESCE(e.p_partkey, a.p_partkey) AS p_partkey, e.p_partkey AS ek, a.p_partkey AS ak, e.p_name AS en, a.p_name AS an, e.p_size AS es, a.p_size AS az, e.ratio AS er, a.ratio AS ar FROM e FULL JOIN a ON a.p_partkey = e.p_partkey)
          SELECT p_partkey, '<row>' AS field, CASE WHEN ek IS NOT NULL THEN 'present' END AS expected, CASE WHEN ak IS NOT NULL THEN 'present' END AS actual FROM j WHERE ek IS NULL OR ak IS NULL
          UNION ALL SELECT p_partkey, 'p_name', en, an FROM j WHERE ek IS NOT NULL AND ak IS NOT NULL AND NULLIF(en, '') IS DISTINCT FROM NULLIF(an, '')
          UNION ALL SELECT p_partkey, 'p_size', CAST(es AS VARCHAR), CAST(az AS VARCHAR) FROM j WHERE ek IS NOT NULL AND ak IS NOT NULL AND ABS(es - az) > 0.0001
          UNION ALL SELECT p_partkey, 'ratio', CAST(er AS VARCHAR), CAST(ar AS VARCHAR) FROM j WHERE ek IS NOT NULL AND ak IS NOT NULL AND ABS(er - ar) > 0.0001""")
def _(b):
    k = F.col("p_partkey")
    ratio = F.col("p_size").cast("double") / 8
    e = b.part.filter(k % 40 != 1).select("p_partkey", "p_name", "p_size", ratio.alias("ratio"))
    a = b.part.filter(k % 40 != 2).select(
        "p_partkey", F.when(k % 13 == 0, "").when(k % 17 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"),
        F.when(k % 19 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"),
        (ratio + F.when(k % 23 == 0, 0.5).when(k % 3 == 0, 0.00001).otherwise(0.0)).alias("ratio"))
    return quality.diff_tables(e, a, ["p_partkey"])


@query("equivalence_rate", "mode:s total:l passed:l failed:l skipped:l equivalence_rate:l",
       """WITH c AS (SELECT o_orderpriority AS mode, CASE WHEN o_orderkey % 9 = 0 THEN 'skipped_pg_only' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'passed' END AS status FROM orders),
          a AS (SELECT mode, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'passed') AS passed, COUNT(*) FILTER (WHERE status = 'failed') AS failed, COUNT(*) FILTER (WHERE status = 'skipped_pg_only') AS skipped FROM c GROUP BY 1)
          SELECT *, CASE WHEN total - skipped > 0 THEN FLOOR(passed * 100.0::DOUBLE / (total - skipped) + 0.5::DOUBLE) ELSE 0 END AS equivalence_rate FROM a""")
def _(b):
    status = F.when(F.col("o_orderkey") % 9 == 0, "skipped_pg_only").when(F.col("o_orderstatus") == "F", "failed").otherwise("passed")
    return quality.equivalence_rate(b.orders.select(F.col("o_orderpriority").alias("mode"), status.alias("status")))


@query("attribute_failures", "error_id:l package:s",
       """WITH x AS (SELECT event_id AS error_id, user_id, event_id % 3 AS form FROM events)
          SELECT error_id, COALESCE(CASE WHEN form = 0 AND user_id < 120 THEN 'PKG_' || (user_id % 10) WHEN form = 1 AND user_id < 60 THEN 'CLS_' || (user_id % 10) END, 'UNKNOWN') AS package FROM x""")
def _(b):
    u = F.col("user_id").cast("string")
    msg = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[ERROR] /tmp/proj/src/main/java/com/a/A"), u, F.lit("Impl.java:[12,5] cannot find symbol")))
           .when(F.col("event_id") % 3 == 1, F.concat(F.lit("<<< FAILURE! - [service.impl.Create"), u, F.lit("ServiceImplTest.run_ok]"))).otherwise("BUILD FAILURE"))
    users = b.events.select("user_id").distinct()
    files = users.filter("user_id < 120").select(F.concat(F.lit("src/main/java/com/a/A"), u, F.lit("Impl.java")).alias("path"),
                                                 F.concat(F.lit("PKG_"), (F.col("user_id") % 10).cast("string")).alias("package"))
    classes = users.filter("user_id < 60").select(F.concat(F.lit("Create"), u).alias("class_name"), F.concat(F.lit("CLS_"), (F.col("user_id") % 10).cast("string")).alias("package"))
    return quality.attribute_failures(b.events.select(F.col("event_id").alias("error_id"), msg.alias("message")), files, classes)


_KEYS = """a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT DISTINCT CASE WHEN o_orderpriority = '2-HIGH' THEN o_custkey + 1 ELSE o_custkey END AS k FROM orders WHERE o_orderstatus = 'F'),
  s AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_nationkey < 15)"""


def _keys(b):
    a = b.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"))
    o = b.orders.filter("o_orderstatus = 'F'").select(F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("k"))
    return a, o, b.customer.filter("c_nationkey < 15").select(F.col("c_custkey").alias("k"))


@query("key_consistency", "k:l finding:s severity:s",
       f"""WITH {_KEYS} SELECT k, 'missing_in_second' AS finding, 'warning' AS severity FROM a WHERE k NOT IN (SELECT k FROM b)
           UNION ALL SELECT k, 'missing_in_first', 'warning' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def _(b):
    a, o, _s = _keys(b)
    return quality.key_consistency(a, o, "k")


@query("key_consistency_scoped", "k:l finding:s severity:s",
       f"""WITH {_KEYS} SELECT k, 'missing_in_second' AS finding, 'warning' AS severity FROM a WHERE k NOT IN (SELECT k FROM b) AND k IN (SELECT k FROM s)
           UNION ALL SELECT k, 'missing_in_first', 'warning' FROM b WHERE k NOT IN (SELECT k FROM a) AND k IN (SELECT k FROM s)
           UNION ALL SELECT k, 'out_of_scope', 'warning' FROM b WHERE k NOT IN (SELECT k FROM s)""")
def _(b):
    return quality.key_consistency(*_keys(b)[:2], "k", _keys(b)[2])
