"""The status fold on a stream.

The running aggregate has the same expressions as the batch fold: rows of a hot
task combine before the shuffle and the state per task is a handful of values.
Each micro-batch writes the tasks it changed as a new version, in a folder of its
own that a retry overwrites, and readers take the latest version of each task.

Every ``compact_every`` batches the versions so far are merged into a base with a
row per task, so a reader opens one base and less than ``compact_every`` versions
however long the stream has run.  A base counts once its mark is there, a file of
one row that is written last; a batch that is run again writes the same base again.
Folders of versions below the latest mark are never read and may be removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concordat.operators.status import finish_fold, fold_aggregates


def fold_status_stream(
    log: DataFrame,
    target: str,
    checkpoint: str,
    continuous: bool = False,
    interval: str = "10 seconds",
    compact_every: int = 100,
) -> StreamingQuery:
    def write_version(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/versions/version={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            _write_base(changed.sparkSession, target, batch_id)

    writer = (
        log.groupBy("task_id")
        .agg(*fold_aggregates())
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_version)
    )
    trigger = {"processingTime": interval} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _write_base(spark: SparkSession, target: str, through: int) -> None:
    merged = _latest_versions(spark, target, through)
    merged.write.mode("overwrite").parquet(f"{target}/base/version={through}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{target}/marks/mark={through}")


def _marked_base(spark: SparkSession, target: str, below: int | None) -> int | None:
    """The latest complete base, of those ahead of a batch when one is named."""
    try:
        marks = spark.read.parquet(f"{target}/marks")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if below is not None:
        marks = marks.where(F.col("mark") < below)
    return marks.agg(F.max("mark")).first()[0]


def versions_to_read(spark: SparkSession, target: str, through: int | None = None) -> DataFrame:
    """The latest base and the versions after it, up to a batch when one is named."""
    versions = spark.read.parquet(f"{target}/versions")
    if through is not None:
        versions = versions.where(F.col("version") <= through)
    base = _marked_base(spark, target, through)
    if base is None:
        return versions
    merged = spark.read.parquet(f"{target}/base/version={base}").withColumn("version", F.lit(base))
    return versions.where(F.col("version") > base).unionByName(merged)


def _latest_versions(spark: SparkSession, target: str, through: int | None = None) -> DataFrame:
    versions = versions_to_read(spark, target, through)
    fields = [c for c in versions.columns if c not in ("task_id", "version")]
    newest = F.max(F.struct("version", *fields))
    return (
        versions.groupBy("task_id")
        .agg(newest.alias("v"))
        .select("task_id", *[F.col("v")[f].alias(f) for f in fields])
    )


def latest_status(spark: SparkSession, target: str) -> DataFrame:
    """Status of every task from the versions written so far."""
    return finish_fold(_latest_versions(spark, target))


def stream_creations(spark: SparkSession, target: str) -> DataFrame:
    """When each task was created, from the versions: what ``orphan_updates`` needs beside a log."""
    return (
        versions_to_read(spark, target)
        .where(F.col("created_seq").isNotNull())
        .groupBy("task_id")
        .agg(F.min("created_seq").alias("created_seq"))
    )
