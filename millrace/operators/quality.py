"""Quality scores, gates, summaries and table comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import clamp_score
from millrace.operators.common import union_all

# Weights of the scores, in the order of their components.
QUALITY_WEIGHTS = {"compile": 0.25, "test": 0.20, "todo": 0.10, "style": 0.15, "coverage": 0.15, "compat": 0.15}
STRUCTURE_WEIGHTS = {"sql": 0.25, "tables": 0.25, "members": 0.25, "exceptions": 0.125, "control_flow": 0.125}
LAYER_WEIGHTS = {"l1": 0.10, "l2": 0.30, "l3": 0.35, "l4": 0.25}
GRADES = (("A+", 95), ("A", 85), ("B", 70), ("C", 50))


def _weighted(weights: dict[str, float]) -> Column:
    total = None
    for name, weight in weights.items():
        part = F.col(name).cast("double") * F.lit(weight)
        total = part if total is None else total + part
    return total


def weighted_quality(df: DataFrame) -> DataFrame:
    """Component scores and their weighted total.

    Input: compiled, tests_passed, tests_total, todo_count, file_count,
    violations, loc, coverage (0..1, null if not measured), compat_violations.
    """
    ratio = lambda a, b: F.col(a).cast("double") / F.col(b)
    rest = lambda a, b, empty: F.when(F.col(b) > 0, clamp_score((F.lit(1.0) - ratio(a, b)) * 100)).otherwise(F.lit(empty).cast("long"))
    scored = df.withColumns({
        "compile": F.when(F.col("compiled"), 100).otherwise(0),
        "test": F.when(F.col("tests_total") > 0, F.floor(ratio("tests_passed", "tests_total") * 100 + 0.5)).otherwise(0),
        "todo": rest("todo_count", "file_count", 100), "style": rest("violations", "loc", 100),
        "coverage_score": F.coalesce(F.floor(F.col("coverage") * 100 + 0.5), F.lit(0)),
        "compat": rest("compat_violations", "file_count", 100)})
    total = _weighted({("coverage_score" if n == "coverage" else n): w for n, w in QUALITY_WEIGHTS.items()})
    return scored.withColumn("total", F.floor(total + 0.5).cast("long"))


def structure_score(df: DataFrame) -> DataFrame:
    """Structure score from coverage percents, exception counts and similarity.

    Input: sql_source, sql_target, table_score, member_score, exceptions_source,
    exceptions_target, cosine.
    """
    ratio = F.col("exceptions_target").cast("double") / F.col("exceptions_source")
    scored = df.withColumns({
        "sql": F.when(F.col("sql_source") > 0, F.least(F.lit(100), F.floor(F.col("sql_target").cast("double") / F.col("sql_source") * 100 + 0.5))).otherwise(0),
        "tables": F.col("table_score"), "members": F.col("member_score"),
        "exceptions": F.when(F.col("exceptions_source") > 0, clamp_score((F.lit(1.0) - F.abs(ratio - 1.0)) * 100)).otherwise(F.lit(100).cast("long")),
        "control_flow": F.floor(F.col("cosine") * 100 + 0.5)})
    return scored.withColumn("total", F.floor(_weighted(STRUCTURE_WEIGHTS) + 0.5).cast("long"))


def overall_score(df: DataFrame) -> DataFrame:
    """Weighted layer score; missing layers drop out and the rest is reweighted."""
    weight = lambda n, w: F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0)
    whole = None
    for n, w in LAYER_WEIGHTS.items():
        whole = weight(n, w) if whole is None else whole + weight(n, w)
    score = None
    for n, w in LAYER_WEIGHTS.items():
        part = F.when(F.col(n).isNotNull(), F.col(n).cast("double") * F.lit(w) / F.col("__w")).otherwise(0.0)
        score = part if score is None else score + part
    out = df.withColumn("__w", whole).withColumn(
        "total", F.when(F.col("__w") > 0, F.floor(score * 10 + 0.5) / 10).otherwise(0.0)).drop("__w")
    grade = F.lit("D")
    for name, least in reversed(GRADES):
        grade = F.when(F.col("total") >= least, name).otherwise(grade)
    return out.withColumn("grade", grade)


def review_summary(reviews: DataFrame, findings: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """Per-package results, the overall summary, missing packages and bad rows.

    ``reviews``: package, passed, score, must_fix, todos; a row without package,
    verdict or score, or one that passed with must-fix issues, is skipped with a
    warning. Critical and major findings block a package, minor ones do not.
    """
    ok = F.col("package").isNotNull() & F.col("passed").isNotNull() & F.col("score").isNotNull() & ~(F.col("passed") & (F.coalesce("must_fix", F.lit(0)) > 0))
    usable = F.coalesce(ok, F.lit(False))
    blocking = findings.filter(F.col("severity").isin("critical", "major")).groupBy("package").agg(F.count(F.lit(1)).alias("blocking"))
    results = reviews.filter(usable).join(blocking, "package", "left").select(
        "package", "passed", F.coalesce(F.col("blocking") == 0, F.lit(True)).alias("static_passed"), "score",
        F.coalesce("must_fix", F.lit(0)).alias("must_fix"), F.coalesce("todos", F.lit(0)).alias("todos"))
    summary = results.agg(
        F.count(F.lit(1)).alias("package_count"), F.bool_and(F.col("passed") & F.col("static_passed")).alias("all_passed"),
        F.sum("must_fix").alias("total_must_fix"), F.sum("todos").alias("total_todos"))
    missing = expected.select("package").join(results.select("package"), "package", "left_anti")
    return {"results": results, "summary": summary, "missing": missing, "skipped": reviews.filter(~usable)}


def _coverage_rates(counters: DataFrame, keys: Sequence[str], line_target: float, branch_target: float) -> DataFrame:
    """Line and branch rates; a group without counters was not measured and neither passes nor fails."""
    part = lambda t, c: F.coalesce(F.sum(F.when(F.col("type") == t, F.col(c))), F.lit(0))
    agg = counters.groupBy(*keys).agg(part("LINE", "missed").alias("lm"), part("LINE", "covered").alias("lc"), part("BRANCH", "missed").alias("bm"),
                                      part("BRANCH", "covered").alias("bc"), (F.count("type") > 0).alias("executed"))
    rate = lambda m, c: F.when(F.col("executed"), F.when(F.col(m) + F.col(c) > 0, F.col(c).cast("double") / (F.col(m) + F.col(c))).otherwise(1.0))
    out = agg.withColumns({"line_rate": rate("lm", "lc"), "branch_rate": rate("bm", "bc")})
    return out.withColumn("passed", (F.col("line_rate") >= line_target) & (F.col("branch_rate") >= branch_target)).drop("lm", "lc", "bm", "bc")


def coverage_summary(counters: DataFrame, lines: DataFrame | None = None, line_target: float = 0.90, branch_target: float = 0.75,
                     files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Line and branch rates per ``packages`` and in ``total``, and what was not covered.

    ``counters``: package, source, type, missed, covered. ``total`` is one row even without
    counters; then ``executed`` is false and rates and ``passed`` are null: missing input is
    skipped, not failed. ``lines`` (package, source, nr, mi, mb) gives the ``gaps``: lines with
    missed instructions or branches. ``files`` (path, owner) are the source files that
    should be measured, ending in ``package/source``: ``owners`` has the rates of each owner
    (not executed where the report has none of its files) and ``skipped`` the files that
    the report does not hold.
    """
    rates = lambda df, *keys: _coverage_rates(df, keys, line_target, branch_target)
    out = {"packages": rates(counters, "package"), "total": rates(counters)}
    if lines is not None:
        out["gaps"] = lines.filter((F.col("mi") > 0) | (F.col("mb") > 0))
    if files is not None:
        path = F.concat_ws("/", "package", "source")
        # one row per file and type, so a file meets four rows at most in the join
        per_file = counters.groupBy(path.alias("__path"), "type").agg(F.sum("missed").alias("missed"), F.sum("covered").alias("covered"))
        wanted = files.select("path", "owner", F.regexp_replace("path", "^(.*/)?src/(main|test)/java/", "").alias("__path")).distinct()
        joined = wanted.join(per_file, "__path", "left")
        out["owners"] = rates(joined, "owner")
        out["skipped"] = joined.filter(F.col("type").isNull()).select("path", "owner")
    return out


def quality_gates(df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Findings of the numeric gates per group.

    Input per ``grp``: done, total, mapped, completed, passed, score, all_passed,
    must_fix, build_ok, tests_executed, tests_passed, tests_total.
    """
    rows = df if targets is None else df.join(targets.select("grp"), "grp", "left_semi")
    c, ratio = F.col, lambda a, b: F.col(a).cast("double") / F.col(b)
    num = lambda x: x.cast("double")
    gates = [
        ("G1", "blocking", (c("total") > 0) & (ratio("done", "total") < 0.8), ratio("done", "total")),
        ("G2", "warning", c("mapped") < c("completed"), num(c("mapped"))),
        ("G3", "blocking", c("passed") & (c("score") < 70), num(c("score"))),
        ("G4", "blocking", c("all_passed") & (c("must_fix") > 0), num(c("must_fix"))),
        ("G5", "blocking", c("all_passed") & ~c("build_ok"), F.lit(0.0)),
        ("G6", "warning", c("tests_executed") & (c("tests_total") > 0) & (ratio("tests_passed", "tests_total") < 0.7), ratio("tests_passed", "tests_total")),
    ]
    hit = [F.when(cond, F.struct(F.lit(g).alias("gate"), F.lit(s).alias("severity"), v.alias("value"))) for g, s, cond, v in gates]
    return rows.select("grp", F.explode(F.array_compact(F.array(*hit))).alias("f")).select("grp", "f.gate", "f.severity", "f.value")


def completion_summary(status: DataFrame) -> DataFrame:
    """Completed and failed workers per phase and the ratio done by completed ones."""
    ok = F.col("status") == "completed"
    agg = status.groupBy("phase").agg(
        F.count(F.lit(1)).alias("total_packages"), F.count_if(ok).alias("completed_packages"),
        F.coalesce(F.sum(F.when(ok, F.col("total"))), F.lit(0)).alias("__t"), F.coalesce(F.sum(F.when(ok, F.col("done"))), F.lit(0)).alias("__d"))
    ratio = F.when(F.col("__t") > 0, F.col("__d").cast("double") / F.col("__t")).otherwise(0.0)
    return agg.withColumns({
        "failed_packages": F.col("total_packages") - F.col("completed_packages"), "completion_ratio": ratio,
        "g1_passed": ratio >= 0.8}).drop("__t", "__d")


def diff_tables(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tol: float = 1e-4) -> DataFrame:
    """Cell differences: numbers within ``tol`` are equal, null equals ''.

    Rows on one side only are reported with field ``<row>``.
    """
    types = dict(expected.dtypes)
    fields = [c for c in expected.columns if c not in keys]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in fields], F.lit(True).alias(f"{p}here"))
    both = side(expected, "e_").join(side(actual, "a_"), list(keys), "full")
    cells = []
    for f in fields:
        e, a = F.col(f"e_{f}"), F.col(f"a_{f}")
        numeric = types[f].startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint"))
        if numeric:
            same = F.when(e.isNull() | a.isNull(), e.isNull() & a.isNull()).otherwise(F.abs(e.cast("double") - a.cast("double")) <= tol)
        else:
            blank = lambda x: F.nullif(x.cast("string"), F.lit(""))
            same = blank(e).eqNullSafe(blank(a))
        cells.append(F.when(~same, F.struct(F.lit(f).alias("field"), e.cast("string").alias("expected"), a.cast("string").alias("actual"))))
    lone = F.struct(F.lit("<row>").alias("field"), F.when(F.col("e_here"), "present").alias("expected"), F.when(F.col("a_here"), "present").alias("actual"))
    found = F.when(F.col("e_here").isNull() | F.col("a_here").isNull(), F.array(lone)).otherwise(F.array_compact(F.array(*cells)))
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.field", "d.expected", "d.actual")


def equivalence_rate(cases: DataFrame, mode: str = "mode") -> DataFrame:
    """Whole-percent share of passed among executable cases, by mode."""
    agg = cases.groupBy(mode).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped_pg_only").alias("skipped"))
    runnable = F.col("total") - F.col("skipped")
    return agg.withColumn("equivalence_rate", F.when(runnable > 0, F.floor(F.col("passed") * 100.0 / runnable + 0.5)).otherwise(0).cast("long"))


def attribute_failures(errors: DataFrame, files: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Owning package of each error line, by source path or by test class name.

    ``errors``: error_id, message. ``files``: path, package. ``classes``:
    class_name, package. Paths may have a prefix; the part from ``src/`` counts.
    """
    path = F.regexp_extract("message", r"(src/[^\s:]+\.java)", 1)
    cls = F.regexp_extract("message", r"([A-Z][A-Za-z0-9]*?)(?:ServiceImpl)?Test\b", 1)
    tagged = errors.select("error_id", path.alias("path"), cls.alias("class_name"))
    out = tagged.join(files.select("path", F.col("package").alias("__by_path")), "path", "left")
    if classes is not None:
        out = out.join(classes.select("class_name", F.col("package").alias("__by_class")), "class_name", "left")
    else:
        out = out.withColumn("__by_class", F.lit(None).cast("string"))
    return out.select("error_id", F.coalesce("__by_path", "__by_class", F.lit("UNKNOWN")).alias("package"))


def key_consistency(a: DataFrame, b: DataFrame, key: str, scope: DataFrame | None = None) -> DataFrame:
    """Keys of ``a`` missing in ``b`` and the other way round, as warnings.

    With a ``scope``, missing keys outside it are ignored, and keys of ``b``
    outside it are reported.
    """
    left, right = a.select(key).distinct(), b.select(key).distinct()
    missing = left.join(right, key, "left_anti")
    extra = right.join(left, key, "left_anti").withColumn("finding", F.lit("missing_in_first"))
    parts = []
    if scope is not None:
        inside = scope.select(key).distinct()
        missing = missing.join(inside, key, "left_semi")
        extra = extra.join(inside, key, "left_semi")
        parts.append(right.join(inside, key, "left_anti").withColumn("finding", F.lit("out_of_scope")))
    parts += [missing.withColumn("finding", F.lit("missing_in_second")), extra]
    return union_all(parts).withColumn("severity", F.lit("warning"))
