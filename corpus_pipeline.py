"""Training-data pipeline over ``documents``: quality, line dedup, near duplicates, PII, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``; n_chars follows the text. Null texts count as empty. A document that
loses all its lines stays as an empty document until the near-duplicate stage, which
keeps one document of every group, the one with the smallest doc_id (then text hash). Labels are read
from the folder, everything else from the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, lines, packing, privacy, quality
from millrace.llm.common import keep, load, tokenizer_path

ORACLE_SQL = None  # the stages cannot be expressed in SQL; tests/llm/test_pipeline.py compares with plain Python


def _with_text(df: DataFrame, text, columns: list[str]) -> DataFrame:
    made = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).where(F.col("quality_score") >= 0.5).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold, but for each line's first place."""
    return _with_text(lines.drop_repeated_lines(docs, min_docs=10, keep_lines="first"), F.col("text"), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    row = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))  # ids can repeat over different texts
    groups = jaccard.similarity_groups(docs.select(row.alias("row"), "text"), words=5, threshold=0.8, id_col="row")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).select(F.col("doc_id").alias("__row")).distinct()
    return docs.join(kept.hint("shuffle_hash"), row == F.col("__row"), "left_semi").dropDuplicates(["doc_id", "text"])


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and revealing terms replaced."""
    return _with_text(privacy.sanitise(docs, scope="document"), F.col("sanitised"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 1024 ids: one row per piece."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=0, outputs=("ids",))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", hide_private),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
