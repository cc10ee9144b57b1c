"""Folding a log of status changes to the latest status of each task.

The log has ``task_id``, ``seq``, ``op`` (``create`` or ``update``), ``status``,
``result`` and ``info``; ``seq`` is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import is_empty
from concordat.operators.joins import keyed_join

RUNNING = "RUNNING"

_FIELDS = ["status", "result", "info"]


def fold_aggregates() -> list[Column]:
    """The aggregates of the fold; they combine before the shuffle, in a batch or a stream.

    A new value counts only when it is not empty, so each field keeps its latest
    such value and the sequence number it came with.
    """
    is_create = F.col("op") == "create"
    status = F.when(is_create, F.lit(RUNNING)).otherwise(F.col("status"))
    values = {"status": status, "result": F.col("result"), "info": F.col("info")}
    aggregates = [F.min(F.when(is_create, F.col("seq"))).alias("created_seq")]
    for field in _FIELDS:
        counts = ~is_empty(values[field])
        if field != "status":
            counts = counts & ~is_create
        latest = F.struct(F.col("seq"), values[field].alias("value"))
        aggregates.append(F.max(F.when(counts, latest)).alias(f"last_{field}"))
    return aggregates


def finish_fold(folded: DataFrame) -> DataFrame:
    """Task rows from the aggregates: values that came before the creation do not count."""

    def value(field: str) -> Column:
        last = F.col(f"last_{field}")
        return F.when(last["seq"] > F.col("created_seq"), last["value"])

    return folded.where(F.col("created_seq").isNotNull()).select(
        "task_id",
        F.coalesce(value("status"), F.lit(RUNNING)).alias("status"),
        F.coalesce(value("result"), F.lit("")).alias("result"),
        value("info").alias("info"),
    )


def fold_status(log: DataFrame) -> DataFrame:
    """Latest status of every created task: one aggregate, no window."""
    return finish_fold(log.groupBy("task_id").agg(*fold_aggregates()))


def creations(log: DataFrame) -> DataFrame:
    """When each task was created (``task_id``, ``created_seq``)."""
    return (
        log.where(F.col("op") == "create")
        .groupBy("task_id")
        .agg(F.min("seq").alias("created_seq"))
    )


def orphan_updates(
    log: DataFrame, created: DataFrame | None = None, salts: int = 1
) -> DataFrame:
    """Updates that came before their task was created, or whose task never was.

    ``created`` gives the creations where they are known already, as from the
    versions of a streamed fold; otherwise they are taken from the log.
    """
    known = creations(log) if created is None else created
    before = F.col("created_seq").isNull() | (F.col("seq") < F.col("created_seq"))
    updates = log.where(F.col("op") == "update")
    return keyed_join(updates, known, ["task_id"], "left", salts).where(before).drop("created_seq")
