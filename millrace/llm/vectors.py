"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Equal vectors are one class with its smallest ids. Class vectors are assigned to lists
around centroids; the direction of a vector from its centroid is rotated at random and
kept as one sign bit per dimension, with the correction scalars (residual length,
alignment of the sign vector with the direction, its product with the centroid). A query
visits its ``probes`` nearest lists: inner products are estimated from the packed bits,
with an error bound, and only vectors whose upper bound reaches the k-th best lower
bound are compared with the original vectors in double precision.

Centroids are learned from at most ``sample`` classes (those with the smallest hashes);
every row is indexed. Lists are dealt in blocks of vectors and blocks of queries, so
neither a crowded list nor a crowd of equal queries meets in one task.

Vectors that are null, zero, hold null or non-finite components, or differ in length
from the most frequent length take no part, neither as query nor as candidate. A null
id takes no part. A repeated id is one candidate per distinct vector. Ties go to the
smaller id; with fewer candidates than k all are returned. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import keep, keep_counted, map_arrow

EPSILON = 1.9  # half-width of the error bound, in deviations of the estimate


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["length"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _digests(x: np.ndarray) -> list[bytes]:
    import xxhash

    x = x + 0.0  # one zero
    return [xxhash.xxh3_128_digest(row.tobytes()) for row in x]


def _classes(rows: DataFrame, keep_ids: int) -> DataFrame:
    """(digest, ids, v): distinct vectors with their smallest ids."""

    def make():
        def step(batch):
            x, ids = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            groups: dict[bytes, list[int]] = {}
            for i, d in enumerate(_digests(x)):
                groups.setdefault(d, []).append(i)
            first = pa.array([g[0] for g in groups.values()], pa.int32())
            least = [sorted(set(ids[g].tolist()))[:keep_ids] for g in groups.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array(least, pa.list_(pa.int64())), batch.column("v").take(first)], names=["digest", "ids", "v"])

        return step

    parts = map_arrow(rows, make, "digest binary, ids array<bigint>, v array<double>")
    return parts.groupBy("digest").agg(F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("ids")))), 1, keep_ids).alias("ids"), F.first("v").alias("v"))


def _query_classes(rows: DataFrame) -> DataFrame:
    """(query_id, digest)."""

    def make():
        def step(batch):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_digests(_matrix(batch.column("v"))), pa.binary())], names=["query_id", "digest"])

        return step

    return map_arrow(rows, make, "query_id bigint, digest binary").distinct()


def learn_centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds on unit vectors, on the driver; ``x`` is the bounded sample."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        best = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        n = np.bincount(best, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c.astype(np.float64)


def rotation(d: int, seed: int = 4) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, centroids: np.ndarray, turn: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalars: residual length, alignment, product with the centroid) of unit vectors."""
    c = centroids[which]
    residual = x - c
    length = np.linalg.norm(residual, axis=1)
    o = residual / np.where(length > 0, length, 1)[:, None]
    y = o @ turn.T
    aligned = np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(y > 0, axis=1), np.stack([length, np.where(aligned > 0, aligned, 1), (o * c).sum(axis=1)], axis=1)


def estimate(bits: np.ndarray, scalars: np.ndarray, queries: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, error bounds) of unit queries with one list's vectors, from the codes."""
    d = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    offset = queries - centroid
    z = (offset @ turn.T).astype(np.float32)
    length, aligned, with_centroid = scalars.T
    guess = (z @ signs.T) / np.sqrt(d) / aligned
    error = np.linalg.norm(offset, axis=1)[:, None] * (np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned) * EPSILON / np.sqrt(max(d - 1, 1))
    return queries @ centroid.reshape(-1, 1) + length * (guess + with_centroid), length * error


def nearest(vectors: DataFrame, query_modulus: int, k: int = 5, probe_share: float = 0.7, least_probes: int = 8, list_rows: int = 1024, max_lists: int = 1024, sample: int = 8192, block_rows: int = 2048, query_rows: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``query_modulus``
    the ``k`` nearest other rows found, by cosine of the original vectors."""
    spark = vectors.sparkSession
    rows = _valid(vectors, id_col, vector_col)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    classes, n = keep_counted(_classes(rows, k + 1), "vector-classes")
    if not n:
        return spark.createDataFrame([], schema)
    queries = keep(_query_classes(rows.where(F.col("vec_id") % query_modulus == 0)), "query-classes")
    some = classes.orderBy(F.xxhash64("digest"), "digest").limit(sample).select("v").collect()
    learned = unit(np.array([r["v"] for r in some]))
    centroids = learn_centroids(learned, min(max_lists, max(1, n // list_rows)))
    probes = min(len(centroids), max(least_probes, int(len(centroids) * probe_share)))
    turn = rotation(learned.shape[1])
    shared = spark.sparkContext.broadcast((centroids, turn))  # at most max_lists centroids

    def coded():
        c, t = shared.value

        def step(batch):
            x = unit(_matrix(batch.column("v")))
            which = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
            bits, scalars = encode(x, c, t, which)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(list(scalars), pa.list_(pa.float64()))], names=[*batch.schema.names, "list", "bits", "scalars"])

        return step

    def probed():
        c, _ = shared.value

        def step(batch):
            x = unit(_matrix(batch.column("v")))
            order = np.argsort(-(x @ c.T - 0.5 * (c * c).sum(1)), axis=1, kind="stable")[:, :probes]
            own = pa.array(np.repeat(np.arange(len(x), dtype=np.int32), order.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(own), batch.column("v").take(own), pa.array(order.ravel().astype(np.int32))], names=["digest", "v", "list"])

        return step

    index = keep(map_arrow(classes, coded, "digest binary, ids array<bigint>, v array<double>, list int, bits binary, scalars array<double>"), "vector-index")
    asked = classes.select("digest", "v").join(queries.select("digest").distinct(), "digest", "left_semi")
    visits = keep(map_arrow(asked, probed, "digest binary, v array<double>, list int"), "list-visits")
    blocks = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    crowds = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("crowds"))
    plan = F.broadcast(blocks.join(crowds, "list"))  # a row per list
    part = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.join(plan, "list").select("list", part("digest", F.col("blocks")).alias("block"), every(F.col("crowds")).alias("crowd"), "ids", "v", "bits", "scalars")
    right = visits.join(plan, "list").select(F.col("list").alias("q_list"), every(F.col("blocks")).alias("q_block"), part("digest", F.col("crowds")).alias("q_crowd"), "digest", "v")

    def search(stored, asking):
        import pandas as pd

        c, t = shared.value
        if not len(stored) or not len(asking):
            return pd.DataFrame({"digest": [], "ids": [], "score": []}, dtype=object)
        x, q = unit(np.stack(stored["v"].to_list())), unit(np.stack(asking["v"].to_list()))
        bits = np.frombuffer(b"".join(stored["bits"]), np.uint8).reshape(len(x), -1)
        guess, error = estimate(bits, np.stack(stored["scalars"].to_list()), q, c[stored["list"].iloc[0]], t)
        lower, m = guess - error, min(k + 1, len(x))
        bar = np.partition(lower, len(x) - m, axis=1)[:, len(x) - m]
        first = np.array([i[0] for i in stored["ids"]])
        digests, ids, scores = [], [], []
        for i in range(len(q)):
            near = np.flatnonzero(guess[i] + error[i] >= bar[i])
            exact = x[near] @ q[i]
            best = np.lexsort((first[near], -exact))[:m]
            digests += [asking["digest"].iloc[i]] * len(best)
            ids += [stored["ids"].iloc[j] for j in near[best]]
            scores += exact[best].tolist()
        return pd.DataFrame({"digest": digests, "ids": ids, "score": scores})

    found = left.groupBy("list", "block", "crowd").cogroup(right.groupBy("q_list", "q_block", "q_crowd")).applyInPandas(search, "digest binary, ids array<bigint>, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.select("digest", F.explode("ids").alias("vec_id"), "score").withColumn("at", F.row_number().over(Window.partitionBy("digest").orderBy(*order))).where(F.col("at") <= k + 1)
    best = keep(best, "query-results")
    ranked = queries.join(best, "digest").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "digest").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], vectors: list, query_modulus: int, k: int = 5) -> list[tuple]:
    """(query_id, rank, vec_id, score) with every vector compared, for tests and recall."""
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    x, ids = np.array([vectors[i] for i in ok], np.float64), np.array([ids[i] for i in ok])
    norm = np.linalg.norm(x, axis=1)
    out = []
    for i in np.flatnonzero(ids % query_modulus == 0):
        score = x @ x[i] / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score))[:k + 1] if j != i][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out
