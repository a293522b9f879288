"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import broadcast_rows, discard, materialize


def valid_at(as_of, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Effective-dating predicate, inclusive at both ends; an open end is null."""
    day = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    return (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day))


def best_per_key(df: DataFrame, keys: Sequence[str], rank_by: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``rank_by`` per key.

    An aggregate rather than ``row_number``: it combines map-side, so a hot key
    costs one row per task instead of a sort of the whole group.
    """
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(*rank_by)).alias("__best")
    )
    return picked.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in others])


def with_totals(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Attach partition totals by aggregate and join (no one-task window)."""
    if not keys:
        totals = {
            name: df.agg(F.sum(value).alias("v")).scalar() for name, value in sums.items()
        }
        return df.withColumns(totals)
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    totals = totals.select(*[F.col(k).alias(f"__t_{k}") for k in keys], *sums)
    on = [df[k].eqNullSafe(totals[f"__t_{k}"]) for k in keys]
    return df.join(totals, on).drop(*[f"__t_{k}" for k in keys])


def small_side(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast only after checking its row count.

    Beyond the bound the frame is returned as is and the join shuffles.
    """
    bound = broadcast_rows(df.sparkSession)
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def sized_side(df: DataFrame, rows: int) -> DataFrame:
    """A join side of ``rows`` rows that meets many rounds of a loop.

    A broadcast passes the driver in every round, so beyond the bound the join is
    told to shuffle; below it the planner chooses.
    """
    return df if rows <= broadcast_rows(df.sparkSession) else df.hint("merge")


# An input of fewer splits than this may be spread over the free cores.
FEW_SPLITS = 64


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input of few splits over the cores before costly row work.

    One row group is one task, however costly its rows. Inputs with enough
    splits, which large ones always have, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


class Chain:
    """A chain of joins with large sides, one step at a time.

    Before a side too large for a broadcast the rows are written as a table, so the
    shuffle files of the join before it go; the table before that one goes too.
    """

    def __init__(self):
        self.last: DataFrame | None = None

    def before(self, df: DataFrame, side: DataFrame | int) -> DataFrame:
        """``df``, as a table of its own if ``side`` (a frame or its row count) is large."""
        bound = broadcast_rows(df.sparkSession)
        if (side if isinstance(side, int) else side.limit(bound + 1).count()) <= bound:
            return df
        table = materialize(df, "chain")
        if self.last is not None:
            discard(self.last)
        self.last = table
        return table


class Later(Sequence):
    """Frames that are made when they are first taken, each by its own function."""

    def __init__(self, *make: Callable[[], DataFrame]):
        self._make, self._made = make, {}

    def __len__(self) -> int:
        return len(self._make)

    def __getitem__(self, i: int) -> DataFrame:
        at = range(len(self))[i]
        if at not in self._made:
            self._made[at] = self._make[at]()
        return self._made[at]


def safe_ratio(num: Column, den: Column) -> Column:
    """Null instead of an error when the denominator is zero."""
    return num / F.nullif(den, F.lit(0))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_failed(rules: Sequence[tuple[str, Column, str]]) -> tuple[Column, Column]:
    """Code and message of the first rule that fails, null where all hold; a null predicate counts as failed."""
    code = F.coalesce(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok, _ in rules
    ])
    message = F.coalesce(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for _, ok, m in rules
    ])
    return code, message


def split_by_rules(df: DataFrame, rules: Sequence[tuple[str, Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Split into rows passing all rules and rejects with the first failed rule.

    ``rules`` are ``(code, predicate that must hold, message)``; a null predicate
    counts as failed.
    """
    code, message = first_failed(rules)
    marked = df.withColumns({"error_code": code, "error_msg": message})
    good = marked.filter(F.col("error_code").isNull()).drop("error_code", "error_msg")
    return good, marked.filter(F.col("error_code").isNotNull())


def next_snapshot(
    current: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    *,
    insert: bool = True,
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Next snapshot after an upsert keyed by ``keys`` (null-safe).

    Columns present in ``changes`` replace those of ``current`` where a change
    row exists; other columns keep their value, or ``defaults`` on insert.
    """
    defaults = defaults or {}
    changed = [c for c in changes.columns if c not in keys]
    upd = changes.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.col(c).alias(f"__n_{c}") for c in changed],
        F.lit(True).alias("__hit"),
    )
    cur = current.withColumn("__old", F.lit(True))
    on = [cur[k].eqNullSafe(upd[f"__k_{k}"]) for k in keys]
    joined = cur.join(upd, on, "full" if insert else "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    old = F.coalesce(F.col("__old"), F.lit(False))
    cols = []
    for c in current.columns:
        if c in keys:
            cols.append(F.when(old, F.col(c)).otherwise(F.col(f"__k_{c}")).alias(c))
        elif c in changed:
            cols.append(F.when(hit, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            fresh = defaults.get(c, F.lit(None))
            cols.append(F.when(old, F.col(c)).otherwise(fresh).alias(c))
    return joined.select(*cols)


def error_rows(rejects: DataFrame, module: str, procedure: str, key: Column) -> DataFrame:
    """Rejects in the error-log layout (message cut to the log's 2000 chars)."""
    return rejects.select(
        F.col("error_code"),
        F.lit("WARN").alias("error_level"),
        F.lit(module).alias("module_name"),
        F.lit(procedure).alias("procedure_name"),
        F.substring(F.col("error_msg"), 1, 2000).alias("error_msg"),
        key.cast("string").alias("biz_key"),
    )
