"""Tasks inside job definitions and the objects they refer to.

Tasks are rows: ``job_id``, ``pos``, ``task_key``, ``ref_type`` and ``ref_id``.
``ref_type`` is ``pipeline``, ``job``, ``notebook_warehouse``, ``notebook_compute``
or null.  Directories are rows ``ref_type``, ``id`` and ``name``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import is_empty
from concordat.operators.joins import keyed_join, one_row_per_key

# Types of references, in order of priority.
REFERENCE_TYPES = ["pipeline", "job", "notebook_warehouse", "notebook_compute"]
# These names must be unique in the target; the first match counts for the others.
UNIQUE_TYPES = ["pipeline", "job"]


def reference_type(task: Column) -> Column:
    """Type of the reference a nested task makes, null when it makes none."""
    notebook = task["notebook_task"]
    return (
        F.when(task["pipeline_task"].isNotNull(), "pipeline")
        .when(task["run_job_task"].isNotNull(), "job")
        .when(notebook.isNotNull() & ~is_empty(notebook["warehouse_id"]), "notebook_warehouse")
        .when(notebook.isNotNull() & ~is_empty(task["existing_cluster_id"]), "notebook_compute")
    )


def explode_tasks(jobs: DataFrame, tasks: str = "tasks") -> DataFrame:
    """Nested tasks as rows, with the type and id of their reference.

    A job without tasks gives one row whose ``pos`` is null, so ``nest_tasks`` returns it.
    """
    task = F.col("task")
    ref_type = reference_type(task)
    ref_id = (
        F.when(ref_type == "pipeline", task["pipeline_task"]["pipeline_id"])
        .when(ref_type == "job", task["run_job_task"]["job_id"].cast("string"))
        .when(ref_type == "notebook_warehouse", task["notebook_task"]["warehouse_id"])
        .when(ref_type == "notebook_compute", task["existing_cluster_id"])
    )
    return jobs.select("job_id", F.posexplode_outer(tasks).alias("pos", "task")).select(
        "job_id",
        "pos",
        task["task_key"].alias("task_key"),
        ref_type.alias("ref_type"),
        ref_id.alias("ref_id"),
        "task",
    )


def capture_references(
    tasks: DataFrame, directory: DataFrame, salts: int = 1, merge: bool = False
) -> DataFrame:
    """The name behind each task's reference; tasks without a reference are dropped.

    Pipelines and jobs are named in ``referenced_name``, warehouses and clusters
    in ``cluster_name``.  A job that is listed without a name is its own error; the
    other types are found without one.
    """
    referring = tasks.where(F.col("ref_type").isin(REFERENCE_TYPES))
    names = one_row_per_key(
        directory.withColumns({"__name": F.col("name"), "__found": F.lit(True)}),
        {"ref_type": F.col("ref_type"), "ref_id": F.col("id")},
        ["__name", "__found"],
        ["__name"],
    )
    joined = keyed_join(referring, names, ["ref_type", "ref_id"], "left", salts, merge=merge)
    is_task = F.col("ref_type").isin(UNIQUE_TYPES)
    error = (
        F.when(is_empty(F.col("ref_id").cast("string")), "REFERENCE_WITHOUT_ID")
        .when((F.col("ref_type") == "job") & is_empty("__name"), "JOB_WITHOUT_NAME")
        .when(F.col("__found").isNull(), "NAME_NOT_FOUND")
    )
    return joined.select(
        "job_id",
        "pos",
        "task_key",
        "ref_type",
        F.when(is_task, F.col("ref_id")).alias("referenced_id"),
        F.when(is_task, F.col("__name")).alias("referenced_name"),
        F.when(~is_task, F.col("ref_id")).alias("cluster_id"),
        F.when(~is_task, F.col("__name")).alias("cluster_name"),
        error.alias("error"),
    )


def _target_ids(directory: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first id in the given order per type and name; clusters and warehouses are found without case."""
    is_unique = F.col("ref_type").isin(UNIQUE_TYPES)
    usable = is_unique | ~(is_empty("name") | is_empty(F.col("id").cast("string")))
    return (
        directory.where(usable)
        .groupBy("ref_type", F.when(is_unique, F.col("name")).otherwise(F.lower("name")).alias("__name"))
        .agg(F.count(F.lit(1)).alias("__matches"), F.min(F.struct(*order, F.col("id").alias("__id")))["__id"].alias("__new_id"))
    )


def rewrite_references(
    tasks: DataFrame, infos: DataFrame, target: DataFrame, salts: int = 1, order: Sequence[str] = ("id",),
    with_type: bool = False,
) -> DataFrame:
    """Each task with the id its reference has in the target estate.

    ``infos`` are captured references (``job_id``, ``task_key``, ``seq``,
    ``ref_type``, ``name``); of several for one task the last counts, and tasks
    without one keep their reference.  Rows keep ``pos`` for the original order.
    Of several warehouses or clusters with one name the first in ``order`` counts, columns
    of ``target``.  A target without an id is an error for every type.  ``with_type`` adds
    ``new_ref_type``, the type under which a changed reference is listed.
    """
    last = F.max(F.struct("seq", F.col("ref_type").alias("t"), F.col("name").alias("n")))
    latest = (
        infos.groupBy("job_id", "task_key")
        .agg(last.alias("info"))
        .select(
            "job_id",
            "task_key",
            F.lit(True).alias("__listed"),
            F.col("info.t").alias("__type"),
            F.col("info.n").alias("__wanted"),
        )
    )
    is_unique = F.col("__type").isin(UNIQUE_TYPES)
    listed = keyed_join(tasks, latest, ["job_id", "task_key"], "left", salts).withColumn(
        "__name", F.when(is_unique, F.col("__wanted")).otherwise(F.lower("__wanted"))
    )
    ids = _target_ids(target, order).withColumnRenamed("ref_type", "__type")
    joined = keyed_join(listed, ids, ["__type", "__name"], "left", salts)
    changes = F.coalesce(F.col("__listed"), F.lit(False)) & F.col("__type").isin(REFERENCE_TYPES)
    matches = F.coalesce(F.col("__matches"), F.lit(0))
    empty_id = is_empty(F.col("__new_id").cast("string"))
    error = F.when(
        changes,
        F.when(is_empty("__wanted"), "EMPTY_NAME")
        .when(matches == 0, "NAME_NOT_FOUND")
        .when(is_unique & (matches > 1), "NAME_NOT_UNIQUE")
        .when(empty_id, "EMPTY_ID"),
    )
    new_id = F.when(changes, F.when(error.isNull(), F.col("__new_id"))).otherwise(F.col("ref_id"))
    carried = [c for c in tasks.columns if c != "ref_id"]
    written = [F.when(changes, F.col("__type")).alias("new_ref_type")] if with_type else []
    return joined.select(
        *carried, F.col("ref_id"), new_id.alias("new_ref_id"), *written, error.alias("error")
    )


def rebuild_jobs(
    jobs: DataFrame, infos: DataFrame, target: DataFrame, salts: int = 1, order: Sequence[str] = ("id",)
) -> DataFrame:
    """The nested jobs with every listed reference replaced by the id of the target estate.

    ``jobs`` has one row per ``job_id`` with an array ``tasks`` of nested definitions; its other
    columns are kept.  ``errors`` lists, in the order of the tasks, what stands in the way of a
    job; such a job has null ``tasks``.  Beside the errors of ``rewrite_references`` a task may
    lack the definition its reference is written into, and a job's id may be no number.
    A job without tasks is returned as it is.
    """
    rewritten = rewrite_references(explode_tasks(jobs), infos, target, salts, order, with_type=True)
    task, kind, new_id = F.col("task"), F.col("new_ref_type"), F.col("new_ref_id").cast("string")
    number = new_id.try_cast("bigint")
    lacks = {
        "pipeline": task["pipeline_task"].isNull(),
        "job": task["run_job_task"].isNull(),
        "notebook_warehouse": task["notebook_task"].isNull(),
    }
    no_place = F.lit(False)
    for name, absent in lacks.items():
        no_place = no_place | ((kind == name) & absent)
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(no_place, "TASK_OF_ANOTHER_TYPE")
        .when((kind == "job") & number.isNull(), "JOB_ID_NOT_A_NUMBER")
    )
    changed = (
        F.when(kind == "pipeline", task.withField("pipeline_task.pipeline_id", new_id))
        .when(kind == "job", task.withField("run_job_task.job_id", number))
        .when(kind == "notebook_warehouse", task.withField("notebook_task.warehouse_id", new_id))
        .when(kind == "notebook_compute", task.withField("existing_cluster_id", new_id))
        .otherwise(task)
    )
    nested = nest_tasks(rewritten.withColumns({"task": changed, "error": error}), "task").withColumns(
        {"__tasks": F.col("tasks.task")}
    )
    whole = keyed_join(jobs, nested.drop("tasks"), ["job_id"], "left", unique_facts=True)
    failed = F.size("errors") > 0
    rebuilt = F.when(F.coalesce(F.size("tasks"), F.lit(0)) <= 0, F.col("tasks")).when(~failed, F.col("__tasks"))
    return whole.select(*[c for c in jobs.columns if c != "tasks"], rebuilt.alias("tasks"), "errors")


def nest_tasks(rows: DataFrame, *fields: str) -> DataFrame:
    """Task rows as one ordered array per job, for tasks that came from nested definitions.

    A definition was one row before ``explode_tasks``, which bounds the array.  Errors come
    in the order of their tasks, each with its ``task_key``; a job without tasks has empty arrays.
    """
    kept = F.when(F.col("pos").isNotNull(), F.struct("pos", *fields, F.struct("task_key", "error").alias("__error")))
    collected = F.array_sort(F.collect_list(kept))
    problems = F.filter(F.transform("__all", lambda t: t["__error"]), lambda e: e["error"].isNotNull())
    return rows.groupBy("job_id").agg(collected.alias("__all")).select(
        "job_id",
        F.transform("__all", lambda t: F.struct(*[t[f].alias(f) for f in fields])).alias("tasks"),
        problems.alias("errors"),
    )
