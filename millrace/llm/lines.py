"""Lines found in many documents are dropped, with two Bloom filters before any shuffle.

A line's key is the line stripped of ASCII white space and lower-cased in A-Z. Every
task keeps the keys of its documents and sets their bits in a filter of keys seen in
one document and a filter of keys seen in two or more. The task filters are merged:
bits that two tasks have seen go to the second filter too. A key of two documents is
therefore always in the merged second filter; only such suspects are shuffled, with
their whole key, and counted exactly. The filters have a fixed size: beyond about
``filter_bits / 8`` distinct lines they let more lines through, which costs shuffle
but changes no result.

Each row counts as one document, also with a repeated doc_id. A null or empty text is
one empty line; empty keys are never dropped. With ``keep_lines="none"`` every line of a
repeated key is dropped; with ``keep_lines="first"`` its first line by (doc_id, text hash, line
number), null ids first, stays, and repeated rows all keep it. A document may lose all
lines and is then empty. Other columns stay as they are; columns called n_lines or n_dropped are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep, map_arrow

SEGMENT_BITS = 20


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Two filter positions per key."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask]).astype(np.int64)


def _task_filters(texts: DataFrame, bits: int, flush: int = 500_000) -> DataFrame:
    """(segment, once, twice): sorted positions set in each segment, per part of a task."""

    def make():
        counts: dict[bytes, int] = {}

        def flushed():
            keys = list(counts)
            many = np.fromiter((c > 1 for c in counts.values()), bool, len(keys))
            at = _positions(keys, bits)
            counts.clear()
            once, twice = np.unique(at), np.unique(at[:, many])
            segments = np.unique(once >> SEGMENT_BITS)
            cut = lambda a: [(a[lo:hi] & ((1 << SEGMENT_BITS) - 1)).astype("<u4").tobytes() for lo, hi in zip(np.searchsorted(a, segments << SEGMENT_BITS), np.searchsorted(a, (segments + 1) << SEGMENT_BITS))]
            yield pa.RecordBatch.from_arrays([pa.array(segments.astype(np.int32)), pa.array(cut(once), pa.binary()), pa.array(cut(twice), pa.binary())], names=["segment", "once", "twice"])

        def step(batch):
            for text in batch.column("text"):
                for key in set(map(line_key, text.as_buffer().to_pybytes().split(b"\n"))):
                    if key:
                        counts[key] = counts.get(key, 0) + 1
                if len(counts) >= flush:
                    yield from flushed()

        def close():
            if counts:
                yield from flushed()

        step.close = close
        return step

    return map_arrow(texts, make, "segment int, once binary, twice binary")


def _merged_filter(parts: DataFrame) -> DataFrame:
    """(segment, bitmap) of the second filter."""

    def make():
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def bitmap(positions: bytes) -> np.ndarray:
            out = np.zeros(1 << SEGMENT_BITS, bool)
            out[np.frombuffer(positions, "<u4")] = True
            return np.packbits(out)

        def step(batch):
            for segment, once, twice in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice"))):
                new = bitmap(once)
                if segment not in maps:
                    maps[segment] = (new, bitmap(twice))
                else:
                    seen, more = maps[segment]
                    more |= bitmap(twice) | (seen & new)
                    seen |= new
            return ()

        def close():
            yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([m.tobytes() for _, m in maps.values()], pa.binary())], names=["segment", "bitmap"])

        step.close = close
        return step

    return map_arrow(parts.repartition("segment"), make, "segment int, bitmap binary")


def _suspects(rows: DataFrame, filter_of_two, bits: int) -> DataFrame:
    """(doc_id, text_hash, key, lines, docs): suspected lines of each document, one row per key and document."""

    def make():
        bitmap = np.frombuffer(filter_of_two.value, np.uint8)

        def step(batch):
            out: dict[str, list] = {"doc": [], "key": [], "lines": []}
            owner, keys, places = [], [], []
            for k, text in enumerate(batch.column("text")):
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    key = line_key(line)
                    if key:
                        found.setdefault(key, []).append(i)
                owner.extend([k] * len(found))
                keys.extend(found)
                places.extend(found.values())
            if not keys:
                return
            at = _positions(keys, bits)
            hit = ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
            for i in np.flatnonzero(hit).tolist():
                out["doc"].append(owner[i])
                out["key"].append(keys[i].decode())
                out["lines"].append(places[i])
            doc = pa.array(out["doc"], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(doc), batch.column("text_hash").take(doc), pa.array(out["key"], pa.string()), pa.array(out["lines"], pa.list_(pa.int32()))], names=["doc_id", "text_hash", "key", "lines"])

        return step

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, make, f"doc_id {id_type}, text_hash bigint, key string, lines array<int>")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, filter_bits: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text", keep_lines: str = "none") -> DataFrame:
    """``docs`` without the lines whose key is in at least ``min_docs`` documents (2 or more), or without all but the first of them.

    Adds n_lines (before dropping) and n_dropped.
    """
    if keep_lines not in ("none", "first"):
        raise ValueError(f"keep_lines is none or first, not {keep_lines}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    full = docs.drop("n_lines", "n_dropped").withColumn(text_col, text)
    rows = full.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    merged = _merged_filter(_task_filters(rows.select(F.encode("text", "UTF-8").alias("text")), filter_bits)).collect()  # filter_bits bits at most
    bitmap = np.zeros(filter_bits >> 3, np.uint8)
    for r in merged:
        lo = r["segment"] << (SEGMENT_BITS - 3)
        bitmap[lo:lo + (1 << (SEGMENT_BITS - 3))] = np.frombuffer(r["bitmap"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    suspects = keep(_suspects(rows.withColumn("text", F.encode("text", "UTF-8")), shared, filter_bits), "suspects")
    first = F.min(F.struct("doc_id", "text_hash", F.col("lines")[0].alias("line"))).alias("first")
    repeated = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), first).where(F.col("docs") >= min_docs).select("key", "first")
    repeated = keep(repeated, "repeated-keys")  # a plain table on this side lets AQE split a hot key on the other
    lost = suspects.join(repeated, "key").select("doc_id", "text_hash", "first", F.explode("lines").alias("line"))
    if keep_lines == "first":
        lost = lost.where(~F.struct("doc_id", "text_hash", "line").eqNullSafe(F.col("first")))
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("__lost")).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    lost = keep(lost, "lost-lines")
    joined = full.join(lost.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left")

    @F.pandas_udf("string")
    def kept(texts, lost_lines):
        import pandas as pd

        def without(t, gone):
            gone = set(gone)
            return "\n".join([line for i, line in enumerate(t.split("\n")) if i not in gone])

        return pd.Series([t if gone is None else without(t, gone) for t, gone in zip(texts, lost_lines)], dtype=object)

    n_lines = F.size(F.split(F.col(text_col), "\n", -1))
    return joined.select(
        *[kept(text_col, "__lost").alias(c) if c == text_col else F.col(c) for c in full.columns],
        n_lines.cast("bigint").alias("n_lines"), F.coalesce(F.size("__lost"), F.lit(0)).cast("bigint").alias("n_dropped"))
