"""Readers and writers: parquet tables, text corpora, JSON and XML reports, JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_SUFFIXES = "*.{sql,pks,pkb,pls,SQL,PKS,PKB,PLS}"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_text_corpus(spark: SparkSession, folder: str, pattern: str = SQL_SUFFIXES) -> DataFrame:
    """Every matching file below ``folder`` as one row (path, text).

    Only the listing is recursive; the file bodies are read by the tasks.
    """
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json_artifacts(
    spark: SparkSession, path: str, schema: str, renamed: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Multi-line JSON documents with an explicit schema.

    ``renamed`` maps a column to its older names; the first non-null one wins.
    """
    df = spark.read.schema(schema).json(path, multiLine=True)
    for name, older in (renamed or {}).items():
        df = df.withColumn(name, F.coalesce(*[F.col(c) for c in (name, *older)])).drop(
            *[c for c in older if c != name]
        )
    return df


def read_duplication_report(spark: SparkSession, path: str) -> DataFrame:
    """Copy-paste-detector XML: one row per (group, file occurrence)."""
    schema = "_lines INT, _tokens INT, file ARRAY<STRUCT<_line: INT, _path: STRING>>, codefragment STRING"
    df = spark.read.schema(schema).xml(path, rowTag="duplication")
    return df.select(
        F.xxhash64("codefragment", "_lines", "_tokens", "file").alias("group_id"),  # reports may leave the fragment out
        F.col("_lines").alias("lines"), F.col("_tokens").alias("tokens"),
        F.explode("file").alias("f"),
    ).select("group_id", "lines", "tokens", F.col("f._line").alias("start_line"), F.col("f._path").alias("file"))


def read_style_report(spark: SparkSession, path: str) -> DataFrame:
    """Checkstyle XML: one row per error."""
    schema = "_name STRING, error ARRAY<STRUCT<_line: INT, _severity: STRING, _message: STRING, _source: STRING>>"
    df = spark.read.schema(schema).xml(path, rowTag="file")
    e = df.select(F.col("_name").alias("file"), F.explode("error").alias("e"))
    return e.select(
        "file", F.col("e._line").alias("line"), F.col("e._source").alias("rule"),
        F.col("e._severity").alias("level"), F.col("e._message").alias("message"),
        F.lit("checkstyle").alias("tool"),
    )


def read_rule_report(spark: SparkSession, path: str) -> DataFrame:
    """PMD XML: one row per violation."""
    schema = (
        "_name STRING, violation ARRAY<STRUCT<_beginline: INT, _rule: STRING, _priority: INT, _VALUE: STRING>>"
    )
    df = spark.read.schema(schema).xml(path, rowTag="file")
    v = df.select(F.col("_name").alias("file"), F.explode("violation").alias("v"))
    return v.select(
        "file", F.col("v._beginline").alias("line"), F.col("v._rule").alias("rule"),
        F.col("v._priority").cast("string").alias("level"), F.trim("v._VALUE").alias("message"),
        F.lit("pmd").alias("tool"),
    )


def read_coverage_rows(spark: SparkSession, path: str) -> DataFrame:
    """JaCoCo XML in one scan: the class counters and the source lines of every package.

    ``level`` is 'counter' (class, type, missed, covered) or 'line' (nr, and the missed and
    covered instructions mi, ci and branches mb, cb); columns of the other level are null.
    """
    counter = "counter: ARRAY<STRUCT<_type: STRING, _missed: BIGINT, _covered: BIGINT>>"
    line = "line: ARRAY<STRUCT<_nr: INT, _mi: BIGINT, _ci: BIGINT, _mb: BIGINT, _cb: BIGINT>>"
    schema = f"_name STRING, class ARRAY<STRUCT<_name: STRING, _sourcefilename: STRING, {counter}>>, sourcefile ARRAY<STRUCT<_name: STRING, {line}>>"
    df = spark.read.schema(schema).xml(path, rowTag="package")

    def row(level, source, **values):
        kinds = {"class": "string", "type": "string", "missed": "bigint", "covered": "bigint", "nr": "int", "mi": "bigint", "ci": "bigint", "mb": "bigint", "cb": "bigint"}
        return F.struct(F.lit(level).alias("level"), source.alias("source"), *[values.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    def each(parts, children, make):
        """One row per child of each part; none where either list is missing."""
        return F.flatten(F.transform(F.coalesce(F.col(parts), F.array()), lambda p: F.transform(F.coalesce(p[children], F.array()), lambda x: make(p, x))))

    counters = each("class", "counter", lambda c, n: row("counter", c["_sourcefilename"], **{"class": c["_name"]}, type=n["_type"], missed=n["_missed"], covered=n["_covered"]))
    lines = each("sourcefile", "line", lambda f, n: row("line", f["_name"], nr=n["_nr"], mi=n["_mi"], ci=n["_ci"], mb=n["_mb"], cb=n["_cb"]))
    return df.select(F.col("_name").alias("package"), F.explode(F.concat(counters, lines)).alias("r")).select("package", "r.*")


def read_coverage_report(spark: SparkSession, path: str) -> DataFrame:
    """JaCoCo XML: one row per class counter (package, class, source, type, missed, covered)."""
    return read_coverage_rows(spark, path).filter("level = 'counter'").select("package", "class", "source", "type", "missed", "covered")


def read_jdbc_tables(
    spark: SparkSession, url: str, schema: str, name_like: str, *,
    user: str | None = None, password: str | None = None, query_timeout: int = 30,
) -> DataFrame:
    """Table catalogue of a PostgreSQL-family database, filtered in the source."""
    quote = lambda s: s.replace("'", "''")
    sql = (
        "SELECT table_schema, table_name FROM information_schema.tables "
        f"WHERE table_schema = '{quote(schema)}' AND table_name LIKE '{quote(name_like)}'"
    )
    reader = spark.read.format("jdbc").option("url", url).option("query", sql)
    reader = reader.option("queryTimeout", query_timeout)
    if user is not None:
        reader = reader.option("user", user)
    if password is not None:
        reader = reader.option("password", password)
    return reader.load()


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
    lower: int | None = None, upper: int | None = None, partitions: int = 1, **options: str,
) -> DataFrame:
    """A JDBC table; give a numeric ``partition_column`` to read it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def append_batch(rows: DataFrame, path: str, batch_id: int | str) -> None:
    """Append ``rows`` as one batch, exactly once.

    A batch is a partition of its own, written by dynamic overwrite: the files of a
    repeated job or micro-batch replace those of its first try when the job commits,
    and other batches are not touched. The same id must bring the same rows.
    """
    rows.withColumn("batch_id", F.lit(str(batch_id))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_ledger(txns: DataFrame, path: str, mode: str = "append", grain: str = "quarter", only_periods: bool = False) -> None:
    """Ledger sink partitioned by quarter (or month) of ``txn_date``.

    Rows of a period come together, and a busy period is split by its size
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so files follow the data:
    one for a small period, many for a large one. With ``only_periods`` an overwrite
    replaces the periods that have rows in ``txns`` and leaves the others.
    """
    part = {
        "quarter": F.concat(F.year("txn_date"), F.lit("Q"), F.quarter("txn_date")),
        "month": F.date_format("txn_date", "yyyyMM"),
    }[grain]
    name = f"txn_{grain}"
    out = txns.withColumn(name, part).hint("rebalance", name).write.mode(mode)
    if only_periods:
        out = out.option("partitionOverwriteMode", "dynamic")
    out.partitionBy(name).parquet(path)


def periods(spark: SparkSession, path: str) -> list[str]:
    """Folder names of the periods of a ledger, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().getName() for f in found if f.isDirectory() and "=" in f.getPath().getName())


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet files of a folder, None without the folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(path) if there else None


def move_period(spark: SparkSession, period: str, source: str, target: str) -> None:
    """Move the files of a period from one ledger to another without reading them.

    If the target has the period already, its files are joined by those of the source.
    """
    Path = spark._jvm.org.apache.hadoop.fs.Path
    old, new = Path(f"{source}/{period}"), Path(f"{target}/{period}")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.exists(new):
        moved = fs.rename(old, new)
    else:
        moved = all([fs.rename(f.getPath(), Path(new, f.getPath().getName())) for f in fs.listStatus(old)]) and fs.delete(old, True)
    if not moved:
        raise OSError(f"{old} could not be moved to {new}")
