"""Uniform shuffle into shards of exact size with a hypergeometric communication matrix.

How many rows each input partition sends to each block of each shard is drawn from the
law that a uniform permutation of all rows would give: a multivariate hypergeometric
matrix with the partition sizes as row sums and the block sizes as column sums. It is
drawn along a binary tree over the partitions, each node from a seed of its own, so a
task computes its row alone and no matrix passes through the driver. The task then
permutes its rows locally among those targets, the rows are exchanged, and each block
is permuted again; a block's slots follow its shard's earlier blocks. All permutations
are then equally likely, and shard sizes differ by one at most.

``docs`` must give the same partitions each time it is read, as a table scan does;
pass ``stable=False`` for anything else and it is written to the scratch folder first.
A partition that changes its size between the passes stops the job.

Null and empty texts, repeated rows and extra columns are carried along unread. An
empty table gives no rows. Columns called shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import keep, map_arrow


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good items among ``draws`` without replacement, by inverting the law.

    Probabilities are built from their ratios around the mode over twelve standard
    deviations on either side, which holds all but about 1e-30 of the mass at any size.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = 30 + int(12 * np.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))))
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def _share(rng: np.random.Generator, columns: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: ``draws`` items from the columns."""
    out = np.zeros_like(columns)
    left = int(columns.sum())
    for j, size in enumerate(columns.tolist()):
        left -= size
        out[j] = hypergeometric(rng, size, left, draws)
        draws -= int(out[j])
        if not draws:
            break
    return out


def matrix_row(sizes: np.ndarray, columns: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix."""
    ends = np.cumsum(sizes)
    lo, hi, columns = 0, len(sizes), columns.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rows = int(ends[mid - 1] - (ends[lo - 1] if lo else 0))
        left = _share(np.random.default_rng([seed, lo, hi]), columns, rows)
        if part < mid:
            hi, columns = mid, left
        else:
            lo, columns = mid, columns - left
    return columns


def even_sizes(total: int, parts: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return total // parts + (np.arange(parts) < total % parts).astype(np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, stable: bool = True, block_rows: int = 4096, max_blocks: int = 512) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    A shard is exchanged in blocks of about ``block_rows`` rows, at most ``max_blocks``
    of them; beyond that blocks grow, and Spark's sort spills.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    if not stable:
        docs = keep(docs, "shuffle-input")
    counted = docs.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()  # a row per partition
    parts = {r["part"]: r["count"] for r in counted}
    sizes = np.array([parts.get(p, 0) for p in range(max(parts, default=0) + 1)], np.int64)
    total = int(sizes.sum())
    per_shard = even_sizes(total, shards)
    blocks = int(min(max_blocks, max(1, -(-total // (shards * block_rows)))))
    columns = np.concatenate([even_sizes(int(n), blocks) for n in per_shard])
    starts = np.concatenate([np.cumsum(c) - c for c in columns.reshape(shards, blocks)])
    shared = spark.sparkContext.broadcast((sizes, columns))  # a number per partition and per block

    def make():
        all_sizes, all_columns = shared.value
        part = TaskContext.get().partitionId()
        size = int(all_sizes[part]) if part < len(all_sizes) else 0
        rng = np.random.default_rng([seed, 1 << 40, part])
        sends = matrix_row(all_sizes, all_columns, part, seed) if size else np.zeros(len(all_columns), np.int64)
        target = rng.permutation(np.repeat(np.arange(len(all_columns), dtype=np.int32), sends))
        given = [0]

        def step(batch):
            at, given[0] = given[0], given[0] + batch.num_rows
            if given[0] > size:
                raise RuntimeError("a partition changed its size between two reads; use stable=False")
            again = rng.integers(-2**63, 2**63 - 1, batch.num_rows, dtype=np.int64)
            place = part * (1 << 33) + np.arange(at, given[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(target[at:given[0]]), pa.array(again), pa.array(place)], names=[*batch.schema.names, "__target", "__again", "__place"])

        def close():
            if given[0] != size:
                raise RuntimeError("a partition changed its size between two reads; use stable=False")
            return ()

        step.close = close
        return step

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    sent = map_arrow(docs, make, schema + "__target int, __again bigint, __place bigint")
    order = Window.partitionBy("__target").orderBy("__again", "__place")
    first = F.element_at(F.lit(starts.tolist()), F.col("__target") + 1)
    return (sent.withColumn("slot", first.cast("bigint") + F.row_number().over(order) - 1)
            .withColumn("shard", F.floor(F.col("__target") / blocks).cast("int")).drop("__target", "__again", "__place"))
