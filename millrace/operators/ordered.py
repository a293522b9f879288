"""Running sums and ranks that hold when one group outgrows one task.

A Spark window sorts a whole partition key in a single task. These helpers look
at the largest group first: below ``spark.millrace.hotGroupRows`` they use the
plain window; above it they range-partition by (keys, order), sum each range,
and add the sums of the earlier ranges, so no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import hot_group_rows, materialize

PART = "__range"
# Buckets that is_hot counts, and how many of them it may look into by a list.
HASH_BUCKETS, LISTED_BUCKETS = 65536, 256


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest ``keys`` group (map-side combined)."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


def is_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some ``keys`` group is too big for one task.

    Rows are first counted by hash bucket, which shuffles a bounded number of rows;
    groups are counted only in buckets that hold more rows than one task may sort.
    """
    bound = hot_group_rows(df.sparkSession)
    if not keys:
        return largest_group(df, keys) > bound
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS))
    full = [r["b"] for r in df.groupBy(bucket.alias("b")).count().filter(F.col("count") > bound).limit(LISTED_BUCKETS + 1).collect()]
    if not full:
        return False
    return largest_group(df.filter(bucket.isin(full)) if len(full) <= LISTED_BUCKETS else df, keys) > bound


def range_split(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Fix ``df`` in contiguous (keys, order) ranges numbered by ``PART``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + list(order)
    ranged = df.repartitionByRange(n, *by).withColumn(PART, F.spark_partition_id())
    return materialize(ranged, "ranges")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    hot: bool | None = None,
) -> DataFrame:
    """Add inclusive running sums; ``order`` must be unique within ``keys``.

    Pass ``hot`` where the answer of :func:`is_hot` is already known.
    """
    if not (is_hot(df, keys) if hot is None else hot):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(w) for name, value in sums.items()})

    values = {f"__v_{name}": value for name, value in sums.items()}
    ranged = range_split(df.withColumns(values), keys, order)
    group = [PART, *keys]
    totals = ranged.groupBy(*group).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__g_{c}") for c in group],
        *[F.sum(v).over(before).alias(f"__o{v}") for v in values],
    )
    on = [ranged[c].eqNullSafe(offsets[f"__g_{c}"]) for c in group]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, on)
    out = joined.withColumns({
        name: F.sum(f"__v_{name}").over(inside) + F.coalesce(F.col(f"__o__v_{name}"), F.lit(0))
        for name in sums
    })
    return out.drop(PART, *values, *[f"__o{v}" for v in values], *[f"__g_{c}" for c in group])


def _numbered_ranges(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers of the whole frame: sorted ranges are written with each row's place in
    its range, and the rows of the earlier ranges are added. The rows are shuffled once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered")
    part = F.shiftright("__place", 33)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias(PART)).count().select(PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__place") - F.shiftleft(F.col(PART), 33)
    return placed.withColumn(PART, part).join(F.broadcast(offsets), PART).withColumn(
        name, inside + F.col("__before") + 1).drop("__place", "__before", PART)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, hot: bool | None = None) -> DataFrame:
    """``row_number`` over a unique order, safe for hot groups."""
    if not keys and hot is not False:
        return _numbered_ranges(df, order, name)
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, hot)


def peer_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    sums: Mapping[str, Column],
    *,
    descending: bool = False,
    rank: str | None = None,
    dense_rank: str | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Running sums in which rows with equal ``order_col`` share one value.

    This is the default RANGE frame. Values are first combined per distinct
    ``order_col``, so a value shared by many rows is one row in the window.
    """
    group = [*keys, order_col]
    agg = {f"__s_{name}": F.sum(value) for name, value in sums.items()}
    agg["__n"] = F.count(F.lit(1))
    peers = df.groupBy(*group).agg(*[e.alias(n) for n, e in agg.items()])
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    wanted = {name: F.col(f"__s_{name}") for name in sums}
    wanted["__cum_n"] = F.col("__n")
    wanted["__dense"] = F.lit(1).cast("long")
    run = running_sums(peers, keys, [order], wanted, hot)
    cols = [F.col(name) for name in sums]
    if rank:
        cols.append((F.col("__cum_n") - F.col("__n") + 1).alias(rank))
    if dense_rank:
        cols.append(F.col("__dense").alias(dense_rank))
    run = run.select(*[F.col(c).alias(f"__g_{c}") for c in group], *cols)
    on = [df[c].eqNullSafe(run[f"__g_{c}"]) for c in group]
    return df.join(run, on).drop(*[f"__g_{c}" for c in group])


def ntile(df: DataFrame, order: Sequence[Column], buckets: int, name: str, total: int) -> DataFrame:
    """``ntile`` over the whole frame of ``total`` rows, from row numbers."""
    numbered = row_numbers(df, [], order, "__rn", total > hot_group_rows(df.sparkSession))
    base, rest = divmod(total, buckets)
    cut = rest * (base + 1)
    tile = F.when(
        F.col("__rn") <= cut, F.ceil(F.col("__rn") / (base + 1))
    ).otherwise(rest + F.ceil((F.col("__rn") - cut) / max(base, 1)))
    return numbered.withColumn(name, tile.cast("int")).drop("__rn")
