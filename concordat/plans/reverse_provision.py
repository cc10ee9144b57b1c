"""From table metadata to descriptor updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import col, is_empty, iso_millis_utc, record
from concordat.operators.contract import (
    as_problem,
    contract_problem,
    derive_contract,
    mark_primary_key,
    updates_of,
    usable_requests,
)
from concordat.operators.joins import keyed_join
from concordat.operators.lookup import unique_lookup
from concordat.operators.principals import run_as_guard
from concordat.operators.problems import gather_problems


def contract_problems(
    inventory: DataFrame, constraints: DataFrame, salts: int = 1
) -> DataFrame:
    """Every problem of the tables that have any; one bad column fails its whole table."""
    derived = derive_contract(mark_primary_key(inventory, constraints, salts))
    return gather_problems(
        as_problem(derived.where("problem IS NOT NULL"), ["table_name"], "problem"), ["table_name"]
    )


def reverse_provision_plan(
    inventory: DataFrame,
    constraints: DataFrame,
    requests: DataFrame,
    form_prefix: str,
    salts: int = 1,
) -> DataFrame:
    """Descriptor updates of every requested table whose columns all have a contract type."""
    usable = usable_requests(inventory.select("table_name", contract_problem().alias("problem")), requests)
    # columns of other tables are gone before the keys are marked, and texts are made after all shuffles
    relevant = keyed_join(inventory, usable.select("table_name"), ["table_name"], "left_semi", salts, merge=True)
    derived = derive_contract(mark_primary_key(relevant, constraints, salts, merge=True))
    return updates_of(derived, usable, form_prefix)


# Where a workflow's own part and its captured references go in a descriptor.
WORKFLOW_PATH = "spec.mesh.specific.workflow"
TASK_INFOS_PATH = "spec.mesh.specific.workflowTasksInfoList"


def judge_workflow_requests(
    requests: DataFrame,
    jobs: DataFrame,
    captured: DataFrame,
    service_principals: DataFrame,
    order: Sequence[str] = ("seq",),
    salts: int = 1,
) -> DataFrame:
    """``requests`` with the ``job_id`` each one means, and the first ``error`` in its way.

    ``requests`` has one row per ``request_id`` with ``name`` and ``expected_run_as``; ``jobs``
    one per ``job_id`` with ``name`` and ``run_as``; ``captured`` is what ``capture_references``
    gives for their tasks.  A name must be given and name exactly one job, every reference of
    its tasks must be captured, and the job must still run as expected.
    """
    columns = requests.columns
    found = unique_lookup(requests.withColumn("__asked", F.col("name")), jobs, "name", "name", "job_id", salts=salts, merge=True)
    broken = _per_job(captured).where("__broken")
    runs = jobs.select("job_id", "run_as")
    known = found.withColumn("job_id", F.when(F.col("verdict") == "OK", F.col("id"))).drop("id", "match_count")
    known = keyed_join(known, broken, ["job_id"], "left", salts, merge=True)
    known = keyed_join(known, runs, ["job_id"], "left", salts, merge=True)
    guarded = run_as_guard(known.withColumnRenamed("verdict", "__lookup"), service_principals, order, salts, merge=True)
    error = (
        F.when(is_empty("name"), "EMPTY_NAME")
        .when(F.col("__lookup") != "OK", F.col("__lookup"))
        .when(F.coalesce("__broken", F.lit(False)), "REFERENCE_NOT_CAPTURED")
        .when(F.col("verdict") != "OK", F.col("verdict"))
    )
    return guarded.select(*columns, "job_id", error.alias("error"))


def _per_job(captured: DataFrame) -> DataFrame:
    """One row per job with captured references; ``__broken`` says that any of them has an error."""
    return captured.groupBy("job_id").agg(F.max(F.col("error").isNotNull()).alias("__broken"))


def workflow_updates(
    judged: DataFrame,
    jobs: DataFrame,
    captured: DataFrame,
    form_prefix: str,
    modified_by: str,
    updated_at: Column,
    salts: int = 1,
) -> DataFrame:
    """Descriptor updates (``request_id``, ``path``, ``pos``, ``value_json``) of requests without error.

    The captured references go under one path, a row per task: its value is the list of its rows
    in the order of ``pos``, and a job without any has one row of null ``pos`` with the empty list.
    The job's id, creation, creator and settings, which ``jobs`` has as JSON text, go under one path
    each; the name in the settings is not the descriptor's to keep.  ``form_prefix`` is the root of
    the form parameters in the caller's portal, where ``modified_by`` and the moment of the update go.
    """
    # without error a request means a job; said here, all uses have one plan and share its shuffles
    usable = judged.where("error IS NULL AND job_id IS NOT NULL").select("request_id", "job_id")
    info = F.struct(
        F.col("task_key").alias("taskKey"), F.col("ref_type").alias("referencedTaskType"),
        F.col("referenced_id").alias("referencedTaskId"), F.col("referenced_name").alias("referencedTaskName"),
        F.col("cluster_name").alias("referencedClusterName"), F.col("cluster_id").alias("referencedClusterId"),
    )
    # requests may share a job, so its tasks may come more than once; their text is made after the shuffle
    rows = keyed_join(captured.drop("error"), usable, ["job_id"], "inner", salts, merge=True)
    tasks = rows.select(
        "request_id", F.lit(TASK_INFOS_PATH).alias("path"), "pos", F.to_json(info, {"ignoreNullFields": "false"}).alias("value_json")
    )
    # the aggregate is the one that judges requests, so that it is shuffled once for both
    seen = _per_job(captured).where("__broken IS NOT NULL").select("job_id")
    none = keyed_join(usable, seen, ["job_id"], "left_anti", salts, merge=True).select(
        "request_id", F.lit(TASK_INFOS_PATH).alias("path"), F.lit(None).cast("int").alias("pos"), F.lit("[]").alias("value_json")
    )
    values = {
        f"{WORKFLOW_PATH}.job_id": _json("job_id"),
        f"{WORKFLOW_PATH}.created_time": _json("created_time"),
        f"{WORKFLOW_PATH}.creator_user_name": _json("creator_user_name"),
        f"{WORKFLOW_PATH}.settings": F.coalesce("settings", F.lit("{}")),
        f"{WORKFLOW_PATH}.settings.name": F.lit('"IGNORED"'),
        f"{form_prefix}.modifiedByRef": _json(F.lit(modified_by)),
        f"{form_prefix}.updatedDate": _json(iso_millis_utc(updated_at)),
    }
    each = F.array(*[record(path=F.lit(path), value_json=value) for path, value in values.items()])
    details = keyed_join(usable, jobs, ["job_id"], "inner", salts, merge=True).select("request_id", F.explode(each).alias("u"))
    return tasks.unionByName(none).unionByName(
        details.select("request_id", "u.path", F.lit(None).cast("int").alias("pos"), "u.value_json")
    )


def _json(value: str | Column) -> Column:
    """A value as JSON text, null included."""
    whole = F.to_json(F.struct(col(value).alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(whole, r'(?s)^\{"v":(.*)\}\z', 1)
