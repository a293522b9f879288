"""Streaming runs over the given tables, compared with their batch meaning."""

import uuid

from pyspark.sql import functions as F

from millrace.plans.bridge import FRAMES
from millrace.plans.catalog import query
from millrace.plans.queries_inventory import _folded, _MOVES, movements
from millrace.plans.queries_telemetry import _K
from millrace.session import scratch_root
from millrace.streaming import ledger as streams


def _stream_ledger(b):
    """The ledger frame's own text over a streaming source."""
    return b.spark.sql(FRAMES["ledger"], lineitem=streams.stream_table(b.spark, b.sf_dir, "lineitem"))


@query("stream_balances", "item_id:l warehouse_id:l qty_on_hand:d moves:l",
       "SELECT item_id, warehouse_id, SUM(CASE WHEN direction = 'I' THEN quantity ELSE -quantity END) AS qty_on_hand, COUNT(*) AS moves FROM {ledger} GROUP BY 1, 2")
def _(b):
    return streams.latest(streams.run_to_table(streams.stream_balances(_stream_ledger(b)), "update"), ["item_id", "warehouse_id"])


class _LedgerOnly:
    def __init__(self, ledger):
        self.ledger = ledger


# From an empty store: the same fold as the batch operator without opening balances.
@query("stream_moving_average", "item_id:l warehouse_id:l qty_on_hand:d avg_cost:d moves:l",
       "WITH nobal AS (SELECT * FROM {balances} WHERE FALSE), " + _folded(_MOVES).replace("{balances}", "nobal")
       + " SELECT item_id, warehouse_id, qty AS qty_on_hand, avg AS avg_cost, moves FROM after")
def _(b):
    moves = movements(_LedgerOnly(_stream_ledger(b)))
    return streams.latest(streams.run_to_table(streams.stream_moving_average(moves), "update"), ["item_id", "warehouse_id"])


# Three micro-batches: up to 1996, up to 1998 and the rest. Every fifth row of the first
# two comes one batch later than its time: those of 1998 within the delay, in disorder;
# those up to 1996 come with the rest, far behind the watermark.
_BATCH = """CASE WHEN txn_date < DATE '1996-01-01' THEN CASE WHEN {odd} THEN 3 ELSE 1 END
                 WHEN txn_date < DATE '1998-01-01' THEN 2
                 WHEN txn_date < DATE '1998-03-01' THEN CASE WHEN {odd} THEN 3 ELSE 2 END ELSE 3 END"""
_ODD = "(item_id + warehouse_id + CAST(quantity AS BIGINT)) % 5 = 0"
_TIMELY = _MOVES.replace("FROM {ledger}", "FROM {ledger} WHERE NOT (txn_date < DATE '1996-01-01' AND " + _ODD + ")")


@query("stream_moving_average_late", "item_id:l warehouse_id:l late_seq:s late_qty:d qty_on_hand:d avg_cost:d moves:l",
       "WITH nobal AS (SELECT * FROM {balances} WHERE FALSE), " + _folded(_TIMELY).replace("{balances}", "nobal")
       + " SELECT item_id, warehouse_id, NULL AS late_seq, NULL AS late_qty, qty AS qty_on_hand, avg AS avg_cost, moves FROM after"
       + " UNION ALL SELECT item_id, warehouse_id, CAST(txn_date AS VARCHAR(10)) || txn_id, CASE WHEN direction = 'I' THEN quantity ELSE -quantity END, NULL, NULL, NULL"
       + " FROM {ledger} WHERE txn_date < DATE '1996-01-01' AND " + _ODD)
def _(b):
    batch = F.expr(_BATCH.format(odd=_ODD))
    ledger = b.ledger.withColumn("batch", batch)
    folder = f"{scratch_root(b.spark)}/millrace/arrivals-{uuid.uuid4().hex}"
    for n in (1, 2, 3):  # one after the other, so that the stream takes them in this order
        mine = ledger.filter(F.col("batch") == n)
        mine = movements(_LedgerOnly(mine)).withColumn("ts", F.to_timestamp(F.substring("seq", 1, 10)))
        mine.repartition(1).write.mode("append").parquet(folder)
    stream = b.spark.readStream.schema(b.spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    emitted = streams.run_to_table(streams.stream_moving_average_late(stream, "90 days"), "update", keyed=True)
    now = streams.latest(emitted.filter("late_seq IS NULL"), ["item_id", "warehouse_id"])
    return now.unionByName(emitted.filter("late_seq IS NOT NULL").drop("batch"))


@query("stream_pair_calls", "call_id:l run:l tool:s state:s duration_ms:l",
       f"""WITH ev AS (SELECT event_id, user_id, event_type, ts, CAST(FLOOR(event_id / 2) AS BIGINT) AS call_id, event_id % 2 = 0 AS is_start, {_K} AS k FROM events)
           SELECT s.call_id, s.user_id AS run, s.event_type AS tool, CASE WHEN e.event_type = 'error' THEN 'error' ELSE 'completed' END AS state,
                  FLOOR((epoch_us(e.ts) - epoch_us(s.ts)) / 1000) AS duration_ms
             FROM ev s JOIN ev e ON e.call_id = s.call_id AND s.is_start AND NOT e.is_start AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 5 MINUTE""")
def _(b):
    return streams.run_to_table(streams.stream_pair_calls(_call_side(b, True, None), _call_side(b, False, None), "5 minutes"), "append")


def _call_side(b, is_start, closing_id):
    e = streams.stream_table(b.spark, b.sf_dir, "events").filter((F.col("event_id") % 2 == 0) == F.lit(is_start))
    e = e.select(F.floor(F.col("event_id") / 2).cast("bigint").alias("call_id"), F.col("user_id").alias("run"), F.col("event_type").alias("tool"),
                 F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    return e.unionByName(streams.closing_event(b.spark, e.schema, call_id=closing_id, ts=_END)) if closing_id else e


# far behind every event of the table
_END = "2100-01-01 00:00:00"


@query("stream_session_calls", "window_start:s window_end:s run:l calls:l errors:l duration_ms:l",
       f"""WITH ev AS (SELECT event_id, user_id, event_type, ts, CAST(FLOOR(event_id / 2) AS BIGINT) AS call_id, event_id % 2 = 0 AS is_start FROM events),
           pr AS (SELECT s.user_id AS run, s.ts, e.event_type = 'error' AS bad, CAST(FLOOR((epoch_us(e.ts) - epoch_us(s.ts)) / 1000) AS BIGINT) AS ms
                    FROM ev s JOIN ev e ON e.call_id = s.call_id AND s.is_start AND NOT e.is_start AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 5 MINUTE),
           g AS (SELECT *, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM pr WINDOW w AS (PARTITION BY run ORDER BY ts)),
           s AS (SELECT *, SUM(fresh) OVER (PARTITION BY run ORDER BY ts) AS sid FROM g)
           SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(MAX(ts) + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, run, COUNT(*) AS calls,
                  COUNT(*) FILTER (WHERE bad) AS errors, SUM(ms) AS duration_ms FROM s GROUP BY run, sid""")
def _(b):
    sessions = streams.stream_session_calls(_call_side(b, True, -1), _call_side(b, False, -2), "24 hours", "5 minutes")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return streams.run_to_table(sessions, "append").withColumns({c: text(c) for c in ("window_start", "window_end")})


def _windows(kind, size, slide=None):
    def build(b):
        e = streams.stream_table(b.spark, b.sf_dir, "events").select(
            F.col("user_id").alias("run"), F.col("event_type").alias("phase"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cost"))
        if kind == "session":
            closed = e.unionByName(streams.closing_event(b.spark, e.schema, ts=_END))
            out = streams.run_to_table(streams.stream_phase_metrics(closed, kind, size), "append")
        else:
            out = streams.latest(streams.run_to_table(streams.stream_phase_metrics(e, kind, size, slide), "update"), ["window_start", "phase"])
        return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return build


_COST = "SUM(CAST(value AS DECIMAL(18,6))) AS cost"
query("stream_phase_metrics_tumbling", "window_start:s phase:s calls:l cost:d",
      f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS phase, COUNT(*) AS calls, {_COST} FROM events GROUP BY 1, 2")(
    _windows("tumbling", "1 hour"))
query("stream_phase_metrics_sliding", "window_start:s phase:s calls:l cost:d",
      f"""SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(b AS INT)), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS phase, COUNT(*) AS calls, {_COST}
            FROM events, range(2) AS r(b) GROUP BY 1, 2""")(
    _windows("sliding", "2 hours", "1 hour"))
query("stream_phase_metrics_session", "window_start:s run:l phase:s calls:l cost:d",
      f"""WITH g AS (SELECT *, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
          s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS sid FROM g)
          SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS run, event_type AS phase, COUNT(*) AS calls, {_COST} FROM s GROUP BY user_id, event_type, sid""")(
    _windows("session", "12 hours"))
