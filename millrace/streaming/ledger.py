"""Structured Streaming projections of the stock ledger and of call events."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.inventory import COST, KEY, QTY, _average_step, scaled, unscaled
from millrace.session import scratch_root


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table (file or folder of files) as a stream."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a stream reads a folder: that of the table, or the single file by its exact name in a pattern
    return reader.parquet(f"{folder.rstrip('/')}/{name}[.]parquet")


PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, mode: str, keyed: bool = False) -> DataFrame:
    """Run a stream over everything available and return what it emitted (``keyed``: with the state store of keyed processors).

    Each micro-batch overwrites its own folder, so a batch repeated after a
    failure is not counted twice. ``batch`` numbers the emissions; in update
    mode the highest one per key is the current value.
    """
    spark = stream.sparkSession
    root = f"{scratch_root(spark)}/millrace/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    kept = spark.conf.get(PROVIDER_KEY, None)
    if keyed:
        spark.conf.set(PROVIDER_KEY, ROCKS)
    try:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
                 .trigger(availableNow=True).foreachBatch(save).start())
        query.awaitTermination()
    finally:
        if keyed:
            spark.conf.set(PROVIDER_KEY, kept) if kept else spark.conf.unset(PROVIDER_KEY)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/out")


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Last emission of each key."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def stream_balances(ledger: DataFrame) -> DataFrame:
    """Running signed quantity and row count per item and warehouse (update mode).

    Signed sums combine map-side in every micro-batch, so a hot key reaches the
    state store as one row per task.
    """
    signed = F.when(F.col("direction") == "I", F.col("quantity")).otherwise(-F.col("quantity"))
    return ledger.groupBy(*KEY).agg(F.sum(signed).cast("decimal(28,4)").alias("qty_on_hand"), F.count(F.lit(1)).alias("moves"))


def _average_rows(bucket, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Advance the (quantity, average, moves) of a bucket's keys by a micro-batch."""
    known = {}
    if state.exists:
        ids, whs, qtys, avgs, counts = state.get
        known = {(i, w): (q, a, n) for i, w, q, a, n in zip(ids, whs, qtys, avgs, counts)}
    columns = (*KEY, "seq", "d", "i", "c", "h")
    rows = sorted(row for pdf in batches for row in zip(*(pdf[c].tolist() for c in columns)))
    touched = set()
    for item, wh, _, delta, in_qty, cost, has_cost in rows:
        qty, avg, moves = known.get((item, wh), (0, 0, 0))
        (avg, _), _out = _average_step((avg, moves > 0), (qty, in_qty, cost, has_cost))
        known[item, wh] = (qty + delta, avg, moves + 1)
        touched.add((item, wh))
    state.update(tuple(map(list, zip(*((i, w, *v) for (i, w), v in known.items())))))
    yield pd.DataFrame([(*k, *known[k]) for k in touched], columns=[*KEY, "q", "a", "moves"])


def stream_moving_average(movements: DataFrame, buckets: int = 512) -> DataFrame:
    """Quantity and moving average per key over ordered movements (update mode).

    ``movements``: item_id, warehouse_id, seq, delta_qty, in_qty, in_cost. The
    state of a key is three numbers; keys are held in hash ``buckets`` so that the
    per-group cost of Python state is shared by the keys of a bucket (choose the
    count for some hundred keys each; it is fixed for the life of a checkpoint).
    Rows of one micro-batch are put in ``seq`` order; batches must arrive in that
    order too. Bound the batch size at the source (for example files per
    trigger), which bounds the rows of a bucket.
    """
    rows = movements.select(
        F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket"), *KEY, "seq", scaled(F.col("delta_qty"), 4).alias("d"),
        scaled(F.col("in_qty"), 4).alias("i"), scaled(F.col("in_cost"), 6).alias("c"),
        F.when(F.col("in_cost").isNull(), 0).otherwise(1).cast("bigint").alias("h"))
    kinds = dict(movements.dtypes)
    item, wh = kinds["item_id"], kinds["warehouse_id"]
    state = f"i array<{item}>, w array<{wh}>, q array<bigint>, a array<bigint>, n array<bigint>"
    folded = rows.groupBy("bucket").applyInPandasWithState(
        _average_rows, f"item_id {item}, warehouse_id {wh}, q bigint, a bigint, moves bigint", state, "update", GroupStateTimeout.NoTimeout)
    return folded.select(*KEY, unscaled("q", 4, QTY).alias("qty_on_hand"), unscaled("a", 6, COST).alias("avg_cost"), "moves")


class _BucketAverage(StatefulProcessor):
    """Per bucket of keys: the settled (quantity, average, moves) of each key and a buffer of rows ahead of the watermark.

    A row at or behind the watermark is late: it changes nothing and comes out as it is.
    Other rows wait in the buffer, so rows out of order within the delay are put in order;
    a timer at the row's time settles them once the watermark has passed it.
    """

    ROW = ["k", "at", "seq", "d", "i", "c", "h"]
    #: Rows in one element of the buffer: a call to the state store costs far more than a row.
    CHUNK = 10_000

    def __init__(self, seq_type: str):
        self.seq_type = seq_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "k array<string>, q array<bigint>, a array<bigint>, n array<bigint>")
        kinds = {"k": "string", "seq": self.seq_type}
        self.buffer = handle.getListState("buffer", ", ".join(f"{c} array<{kinds.get(c, 'bigint')}>" for c in self.ROW))

    def _known(self) -> dict[str, tuple[int, int, int]]:
        return {k: v for k, *v in zip(*self.settled.get())} if self.settled.exists() else {}

    def _waiting(self) -> list[tuple]:
        return [row for chunk in self.buffer.get() for row in zip(*chunk)] if self.buffer.exists() else []

    def _chunks(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[at:at + self.CHUNK]))) for at in range(0, len(rows), self.CHUNK)]

    @staticmethod
    def _by_key(rows: list[tuple]) -> dict[str, list[tuple]]:
        of_key = defaultdict(list)
        for key, *rest in rows:
            of_key[key].append(tuple(rest))
        return of_key

    @staticmethod
    def _folded(value: tuple, rows: list[tuple]) -> tuple[int, int, int]:
        qty, avg, moves = value
        for _, _, delta, in_qty, cost, has_cost in sorted(rows):
            (avg, _), _out = _average_step((avg, moves > 0), (qty, in_qty, cost, has_cost))
            qty, moves = qty + delta, moves + 1
        return qty, avg, moves

    def _result(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["k", "late_seq", "late_qty", "q", "a", "moves"])
        return out.astype({"late_qty": "Int64", "q": "Int64", "a": "Int64", "moves": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new, late = [], []
        for pdf in rows:
            for row in zip(*(pdf[c].tolist() for c in self.ROW)):
                (new if row[1] > passed else late).append(row)
        out = [(k, seq, delta, None, None, None) for k, _, seq, delta, *_ in late]
        if new:
            known, of_key = self._known(), self._by_key(new)
            waiting = self._by_key([r for r in self._waiting() if r[0] in of_key])
            self.buffer.appendList(self._chunks(new))
            self.handle.registerTimer(max(r[1] for r in new) // 1000 + 1)
            out += [(k, None, None, *self._folded(known.get(k, (0, 0, 0)), waiting[k] + of_key[k])) for k in of_key]
        yield self._result(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._waiting()
        due, rest = [r for r in waiting if r[1] <= passed], [r for r in waiting if r[1] > passed]
        if due:
            known = self._known()
            for k, of_key in self._by_key(due).items():
                known[k] = self._folded(known.get(k, (0, 0, 0)), of_key)
            self.settled.update((list(known), *map(list, zip(*known.values()))))
            self.buffer.put(self._chunks(rest)) if rest else self.buffer.clear()
        yield self._result([])

    def close(self) -> None:
        pass


def stream_moving_average_late(movements: DataFrame, delay: str = "30 days", buckets: int = 1024) -> DataFrame:
    """Quantity and moving average per key with event time (update mode), and the late rows.

    ``movements``: ts, item_id, warehouse_id, seq, delta_qty, in_qty, in_cost. Rows are
    folded by (ts, seq) in whatever order they arrive, as long as the watermark (the
    latest ts less ``delay``) has not passed them. A row behind it comes out with its
    ``late_seq`` and ``late_qty``; all others update qty_on_hand, avg_cost and moves,
    which hold all rows of the key so far. A key's state is three numbers and the rows of
    the last ``delay``. Every call of Python state costs a round trip, so keys share state and timers
    in hash ``buckets``, as in :func:`stream_moving_average`: calls and timers grow with the buckets,
    not with the keys. A micro-batch emits only the keys it holds. Needs the RocksDB state store
    (:func:`run_to_table` sets it).
    """
    kinds = dict(movements.dtypes)
    # the watermark moves on, but rows behind it are not dropped: "at" is a plain number
    # a row without time is behind every watermark; keys travel as text, which keeps nulls apart from numbers
    rows = movements.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket"), F.to_json(F.struct(*KEY)).alias("k"),
        F.coalesce(F.unix_micros("ts"), F.lit(-2 ** 63)).alias("at"), "seq", scaled(F.col("delta_qty"), 4).alias("d"), scaled(F.col("in_qty"), 4).alias("i"),
        scaled(F.col("in_cost"), 6).alias("c"), F.when(F.col("in_cost").isNull(), 0).otherwise(1).cast("bigint").alias("h"))
    out = f"k string, late_seq {kinds['seq']}, late_qty bigint, q bigint, a bigint, moves bigint"
    folded = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_BucketAverage(kinds["seq"]), outputStructType=out, outputMode="Update", timeMode="EventTime")
    late = F.col("late_seq").isNotNull()
    key = F.from_json("k", ", ".join(f"{c} {kinds[c]}" for c in KEY))
    return folded.withColumn("k", key).select(
        *[F.col(f"k.{c}").alias(c) for c in KEY], "late_seq", F.when(late, unscaled("late_qty", 4, QTY)).alias("late_qty"), F.when(~late, unscaled("q", 4, QTY)).alias("qty_on_hand"),
        F.when(~late, unscaled("a", 6, COST)).alias("avg_cost"), "moves")


def stream_pair_calls(started: DataFrame, ended: DataFrame, timeout: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Pair start and end events by call id; ends later than ``timeout`` stay unpaired.

    Both sides carry a watermark and the join bounds the end by the start, so
    state of calls that can no longer finish is dropped.
    """
    s = started.select("call_id", "run", "tool", F.col("ts").cast("timestamp").alias("start_ts")).withWatermark("start_ts", delay)
    e = ended.select(F.col("call_id").alias("end_call"), "state", F.col("ts").cast("timestamp").alias("end_ts")).withWatermark("end_ts", delay)
    on = (F.col("call_id") == F.col("end_call")) & (F.col("end_ts") >= F.col("start_ts")) & (
        F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {timeout}"))
    ms = F.floor((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000).cast("long")
    return s.join(e, on).select("call_id", "run", "tool", "state", "start_ts", ms.alias("duration_ms"))


def closing_event(spark: SparkSession, schema: T.StructType, **values) -> DataFrame:
    """A one-row stream that moves the watermark on, to be united with the events before their watermark.

    Append mode returns a session when the watermark has passed its end, so the last ones
    come out only after a later event. The row must arrive after all events: with events
    read in one micro-batch, or as the last file of theirs. Columns without a value are null.
    """
    path = f"{scratch_root(spark)}/millrace/closing-{uuid.uuid4().hex}"
    row = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def stream_session_calls(started: DataFrame, ended: DataFrame, gap: str = "30 minutes", timeout: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Calls, errors and time per run and session of calls, from start and end events (append mode).

    Two stateful operators in one query: starts meet ends in a stream join, and the pairs
    go to session windows over their starts; ``gap`` without a call ends a session. A
    session comes out once, when the watermark has passed it, and its state is dropped
    then, as the join drops starts that can no longer end.
    """
    pairs = stream_pair_calls(started, ended, timeout, delay)
    agg = pairs.groupBy(F.session_window("start_ts", gap).alias("w"), "run").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("state") == "error").alias("errors"), F.sum("duration_ms").alias("duration_ms"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "run", "calls", "errors", "duration_ms")


def stream_phase_metrics(events: DataFrame, kind: str = "tumbling", size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Calls and cost per phase in tumbling, sliding or session windows.

    Rows behind the watermark are dropped. ``size`` is the gap for sessions,
    which are kept per run and phase and run in append mode: a session comes out once
    it is over (see :func:`closing_event`), and its state goes.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    if kind == "tumbling":
        window, keys = F.window("ts", size), ["phase"]
    elif kind == "sliding":
        window, keys = F.window("ts", size, slide or size), ["phase"]
    elif kind == "session":
        window, keys = F.session_window("ts", size), ["run", "phase"]
    else:
        raise ValueError("kind must be tumbling, sliding or session")
    agg = rows.groupBy(window.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.col("cost").cast("decimal(18,6)")).alias("cost"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "calls", "cost")
