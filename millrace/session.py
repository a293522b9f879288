"""Session construction and the shared scratch location used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
HOT_ROWS_KEY = "spark.millrace.hotGroupRows"
BROADCAST_ROWS_KEY = "spark.millrace.broadcastRows"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: dict[str, str] = {}


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="millrace-")
    return _scratch[app]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block, a finished execution removes its shuffle files."""
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def materialize_counted(df: DataFrame, label: str = "step", where: Column | None = None, codec: str = "zstd") -> tuple[DataFrame, int]:
    """Write ``df`` to the shared scratch folder; (the table read back, its row count).

    Cuts lineage in a way that survives executor loss, and unlike a plain
    checkpoint keeps column pruning and real size statistics for the next join.
    The count (of rows satisfying ``where``, if given) is observed while writing,
    so loops need no extra emptiness job. The shuffle files go when the table is
    written: on disk, a chain of steps holds its tables and the shuffles of one step.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), "millrace", f"{label}-{uuid.uuid4().hex}")
    seen = Observation()
    count = F.count(F.lit(1)) if where is None else F.count_if(where)
    with shuffles_removed(spark):
        df.observe(seen, count.alias("n")).write.mode("errorifexists").option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table, seen.get["n"]


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """The table of :func:`materialize_counted` alone."""
    return materialize_counted(df, label)[0]


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`materialize` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_group_rows(spark: SparkSession) -> int:
    """Largest group one task may sort; bigger groups are range-split."""
    return int(spark.conf.get(HOT_ROWS_KEY, "2000000"))


def broadcast_rows(spark: SparkSession) -> int:
    """Row bound under which a side may be broadcast."""
    return int(spark.conf.get(BROADCAST_ROWS_KEY, "100000"))
