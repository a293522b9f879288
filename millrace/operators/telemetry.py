"""Call, phase and run metrics over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ("input", "output", "reasoning", "cacheRead", "cacheWrite")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / 1000).cast("long")


def pair_calls(events: DataFrame) -> DataFrame:
    """Completed calls with their duration.

    ``events``: call_id, kind (called/completed), tool, state, ts and any run
    columns on the called row. An end without start and a start without end give
    no row. One aggregation per call id replaces a self join.
    """
    started, ended = F.col("kind") == "called", F.col("kind") == "completed"
    rest = [c for c in events.columns if c not in ("call_id", "kind", "tool", "state", "ts")]
    per = events.groupBy("call_id").agg(
        F.min(F.when(started, F.struct("ts", "tool", *rest))).alias("s"),
        F.min(F.when(ended, F.struct("ts", "state"))).alias("e"))
    return per.filter(F.col("s").isNotNull() & F.col("e").isNotNull()).select(
        "call_id", *[F.col(f"s.{c}").alias(c) for c in rest], F.col("s.tool").alias("tool"), F.col("e.state").alias("state"),
        F.col("s.ts").alias("started_at"), elapsed_ms(F.col("s.ts"), F.col("e.ts")).alias("duration_ms"))


def flatten_tokens(steps: DataFrame) -> DataFrame:
    """Nested ``tokens`` (with ``cache.read``/``cache.write``) as flat columns."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return steps.withColumns({
        "input": zero("tokens.input"), "output": zero("tokens.output"), "reasoning": zero("tokens.reasoning"),
        "cacheRead": zero("tokens.cache.read"), "cacheWrite": zero("tokens.cache.write")}).drop("tokens")


def _tool_map(per_tool: DataFrame, keys: list[str]) -> DataFrame:
    """Map tool -> (count, errors). One entry per tool name, not per call."""
    return per_tool.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("tool", F.struct("count", "errors")))).alias("tool_stats"),
        F.sum("count").alias("tool_call_count"))


def phase_metrics(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Per (run, phase): API calls, cost, tokens, wall time and tool statistics.

    ``steps``: run, phase, ts, cost and flat token columns. ``calls``: run, phase,
    tool, state.
    """
    keys = ["run", "phase"]
    base = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("api_call_count"), F.sum(F.coalesce("cost", F.lit(0)).cast("decimal(18,6)")).alias("total_cost"),
        *[F.sum(t).alias(t) for t in TOKENS], elapsed_ms(F.min("ts"), F.max("ts")).alias("wall_duration_ms"))
    per_tool = calls.groupBy(*keys, "tool").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("state") == "error").alias("errors"))
    return base.join(_tool_map(per_tool, keys), keys, "left").withColumn(
        "tool_call_count", F.coalesce("tool_call_count", F.lit(0)))


def run_metrics(phases: DataFrame) -> DataFrame:
    """Per run: totals over phases, merged tool statistics, fix cycles and cost."""
    fix = F.col("phase") == "fix"
    totals = phases.groupBy("run").agg(
        F.sum("api_call_count").alias("api_call_count"), F.sum("total_cost").alias("total_cost"), *[F.sum(t).alias(t) for t in TOKENS],
        F.sum("wall_duration_ms").alias("wall_duration_ms"), F.sum("tool_call_count").alias("tool_call_count"),
        F.count_if(fix).alias("fix_cycles"), F.coalesce(F.sum(F.when(fix, F.col("total_cost"))), F.lit(0)).cast("decimal(28,6)").alias("fix_cost"))
    tools = phases.select("run", F.explode("tool_stats").alias("tool", "s")).groupBy("run", "tool").agg(
        F.sum("s.count").alias("count"), F.sum("s.errors").alias("errors"))
    merged = _tool_map(tools, ["run"]).select("run", "tool_stats")
    return totals.join(merged, "run", "left")


#: kinds of objects that a run counts, and the column of each
OBJECT_COUNTS = {"package": "package_count", "procedure": "procedure_count", "table": "table_count", "source_file": "source_file_count", "test_file": "test_file_count"}


def run_business(objects: DataFrame, reviews: DataFrame, builds: DataFrame, phases: DataFrame) -> DataFrame:
    """Business roll-up per run: what it worked on and how it came out.

    ``objects``: run, kind (a key of ``OBJECT_COUNTS``), name; a name counts once. ``reviews``:
    run, package, seq, score, passed, todos; the newest review of a package counts, so a package
    that was mended is judged by its last state (of equal ``seq`` the highest score). ``builds``:
    run, seq, success; the newest one counts. ``phases``: run, phase. A run that appears in any input has a row; what it
    has no rows for is null (scores, success) or 0 (counts).

    Each input is reduced to a few rows per run on its own before the rows meet in one
    aggregation, so no input is joined with another.
    """
    names = objects.filter(F.col("kind").isin(*OBJECT_COUNTS)).select("run", "kind", "name").distinct().groupBy("run", "kind").agg(F.count(F.lit(1)).alias("n"))
    newest = reviews.groupBy("run", "package").agg(F.max(F.struct("seq", "score", "passed", "todos")).alias("r")).groupBy("run").agg(
        F.count("r.score").alias("scored"), F.sum(F.col("r.score").cast("decimal(18,4)")).alias("score"), F.count(F.lit(1)).alias("reviewed"),
        F.count_if(F.col("r.passed")).alias("passed"), F.sum(F.coalesce("r.todos", F.lit(0))).alias("todos"))
    built = builds.groupBy("run").agg(F.max(F.struct("seq", "success")).alias("b")).select("run", "b.success")
    cycles = phases.groupBy("run").agg(F.count_if(F.col("phase") == "fix").alias("fixes"))
    rows = names
    for part in (newest, built, cycles):
        rows = rows.unionByName(part, allowMissingColumns=True)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b))
    agg = rows.groupBy("run").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in OBJECT_COUNTS.items()],
        *[F.sum(c).alias(f"__{c}") for c in ("scored", "score", "reviewed", "passed")],
        F.coalesce(F.sum("todos"), F.lit(0)).alias("todos_remaining"), F.bool_or("success").alias("build_success"), F.coalesce(F.sum("fixes"), F.lit(0)).alias("fix_cycles"))
    return agg.withColumns({"review_average_score": ratio("__score", "__scored"), "review_passed_rate": ratio("__passed", "__reviewed")}).drop(
        "__scored", "__score", "__reviewed", "__passed")


def _js_round(value: Column, places: int) -> Column:
    """Round half up, as floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10 ** places)
    return F.floor(value * scale + 0.5) / scale


def efficiency(runs: DataFrame) -> DataFrame:
    """Cost and throughput ratios of each run (``units`` is the work done)."""
    cost, fix = F.col("total_cost").cast("double"), F.col("fix_cost").cast("double")
    ms, units = F.col("wall_duration_ms").cast("double"), F.col("units").cast("double")
    return runs.withColumns({
        "fix_cost_ratio": F.when(cost > 0, _js_round(fix / cost, 3)).otherwise(0.0),
        "token_total": sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0])),
        "cost_per_unit": F.when((cost > 0) & (units > 0), _js_round(cost / units, 4)),
        "throughput_per_hour": F.when((ms > 0) & (units > 0), _js_round(units / ms * 3600000, 1))})
