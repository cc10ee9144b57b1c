"""Rules of a workload's own part, by what its template makes of it: a job, a workflow or a pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.operators import component_rules as r
from concordat.operators.component_rules import INTEGER, OBJECT, TEXT, list_of, members, needed, object_with
from concordat.operators.components import AUTOSCALE_MODES, template_route

# Members of the fields below; those of the platform's own types are exact in case.
GIT_REFERENCE_TYPES = ["BRANCH", "TAG"]
GIT_PROVIDERS = [
    "awsCodeCommit", "azureDevOpsServices", "bitbucketCloud", "bitbucketServer", "gitHub", "gitHubEnterprise", "gitLab",
    "gitLabEnterpriseEdition",
]
AVAILABILITIES = ["ON_DEMAND_AZURE", "SPOT_AZURE", "SPOT_WITH_FALLBACK_AZURE"]
RUNTIME_ENGINES = ["NULL", "PHOTON", "STANDARD"]
PRODUCT_EDITIONS = ["advanced", "core", "pro"]
CHANNELS = ["preview", "current"]


def _text(value: str) -> str:
    return r._text_of(value)


def _is_flag(value: str) -> str:
    """True or false, or a text or number that reads as one."""
    words = "'true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', 'on', 'off', '1', '0'"
    return (
        f"(schema_of_variant({value}) = 'BOOLEAN' OR ({r._is_text(value)} AND lower({_text(value)}) IN ({words}))"
        f" OR ({r._is_number(value)} AND try_cast({_text(value)} AS double) IN (0, 1)))"
    )


def _is_real(value: str) -> str:
    return f"({r._is_number(value)} OR ({r._is_text(value)} AND try_cast({_text(value)} AS double) IS NOT NULL))"


def _is_text_map(value: str) -> str:
    entries = f"map_values(try_variant_get({value}, '$', 'map<string,variant>'))"
    return f"forall({entries}, one -> schema_of_variant(one) = 'STRING')"


FLAG = r.Rule(_is_flag)
REAL = r.Rule(_is_real)
TEXTS = list_of(TEXT)
FILLED = replace(TEXT, allowed=lambda v: f"length({_text(v)}) >= 1")
FILLED_TEXTS = replace(TEXTS, allowed=lambda v: f"size(try_variant_get({v}, '$', 'array<variant>')) >= 1")
POSITIVE = replace(INTEGER, allowed=lambda v: f"try_cast({_text(v)} AS double) >= 1")
PAIRS = list_of(object_with({"name": needed(TEXT), "value": needed(TEXT)}))


def _exactly(names: Sequence[str]) -> r.Rule:
    return r.Rule(r._is_text, lambda v: r._one_of(_text(v), list(names)))


def _also(name: str, rule: r.Rule) -> r.Rule:
    return replace(rule, other=name)


# The fields of each part and which of them must be there.
_GIT = {"gitRepoUrl": needed(TEXT)}
_WORKLOAD = {
    "workspace": needed(TEXT),
    "git": needed(object_with(_GIT)),
    "repoPath": needed(TEXT),
    "runAsPrincipalName": TEXT,
    "metastore": TEXT,
}
JOB_CLUSTER = object_with({
    "clusterSparkVersion": needed(TEXT),
    "nodeTypeId": needed(TEXT),
    "numWorkers": needed(POSITIVE),
    "spotBidMaxPrice": REAL,
    "firstOnDemand": INTEGER,
    "spotInstances": FLAG,
    "availability": _exactly(AVAILABILITIES),
    "driverNodeTypeId": TEXT,
    "sparkConf": PAIRS,
    "sparkEnvVars": PAIRS,
    "runtimeEngine": _exactly(RUNTIME_ENGINES),
})
PIPELINE_CLUSTER = object_with({
    "policy_id": TEXT,
    "mode": _exactly(AUTOSCALE_MODES),
    "minWorkers": _also("min_workers", INTEGER),
    "maxWorkers": _also("max_workers", INTEGER),
    "numWorkers": _also("num_workers", INTEGER),
    "workerType": _also("worker_type", needed(FILLED)),
    "driverType": _also("driver_type", needed(FILLED)),
    "sparkConf": _also("spark_conf", PAIRS),
    "sparkEnvVars": _also("spark_env_vars", PAIRS),
    "tags": replace(OBJECT, allowed=_is_text_map),
})
WORKLOADS: dict[str, r.Rule] = {
    "job": object_with({
        **_WORKLOAD,
        "git": needed(object_with({
            **_GIT,
            "gitReference": needed(TEXT),
            "gitReferenceType": needed(members(GIT_REFERENCE_TYPES)),
            "gitPath": needed(TEXT),
            "gitProvider": _exactly(GIT_PROVIDERS),
        })),
        "jobName": needed(TEXT),
        "description": TEXT,
        "cluster": needed(JOB_CLUSTER),
        "scheduling": object_with({"cronExpression": needed(TEXT), "javaTimezoneId": needed(TEXT)}),
    }),
    "workflow": object_with({
        **_WORKLOAD,
        "workflow": needed(OBJECT),
        "workflowTasksInfoList": _also("workflow_tasks_info", list_of(object_with({
            "taskKey": _also("task_key", TEXT),
            "referencedTaskType": _also("referenced_task_type", TEXT),
            "referencedTaskId": _also("referenced_task_id", TEXT),
            "referencedTaskName": _also("referenced_task_name", TEXT),
            "referencedClusterName": _also("referenced_cluster_name", TEXT),
            "referencedClusterId": _also("referenced_cluster_id", TEXT),
        }))),
        "override": needed(FLAG),
    }),
    "dlt": object_with({
        **_WORKLOAD,
        "pipelineName": _also("pipeline_name", needed(FILLED)),
        "catalog": needed(FILLED),
        "productEdition": _also("product_edition", needed(members(PRODUCT_EDITIONS))),
        "continuous": needed(FLAG),
        "photon": needed(FLAG),
        "channel": needed(members(CHANNELS)),
        "cluster": needed(PIPELINE_CLUSTER),
        "notebooks": needed(FILLED_TEXTS),
        "target": needed(TEXT),
        "files": TEXTS,
        "notifications": list_of(object_with({"mail": needed(TEXT), "alert": needed(TEXTS)})),
    }),
}


def _sizing_problem(part: str) -> str:
    """SQL of the problem of a pipeline cluster's size; only sound fields are compared."""

    def there(name: str, other: str) -> str:
        found = f"coalesce(try_variant_get({part}, '$.cluster.{name}', 'variant'), try_variant_get({part}, '$.cluster.{other}', 'variant'))"
        return f"({found} IS NOT NULL AND NOT is_variant_null({found}))"

    low, high, fixed = there("minWorkers", "min_workers"), there("maxWorkers", "max_workers"), there("numWorkers", "num_workers")
    modes = ", ".join(repr(m) for m in AUTOSCALE_MODES)
    scales = f"coalesce(try_variant_get({part}, '$.cluster.mode', 'string') IN ({modes}), false)"
    return f"""CASE WHEN {scales} THEN
            CASE WHEN NOT {low} OR NOT {high} THEN 'cluster: autoscale needs min and max workers'
                 WHEN {fixed} THEN 'cluster: autoscale excludes a fixed number' END
        WHEN NOT {fixed} THEN 'cluster: fixed size needs a number of workers'
        WHEN {low} OR {high} THEN 'cluster: fixed size excludes min and max workers' END"""


def workload_problems(part: str, route: str) -> str:
    """SQL of the problems of a workload's own part, a VARIANT, by the rules of its route.

    A part that is no object, and a route without rules, are the only problem.  A pipeline's
    cluster size is judged where its cluster has no other problem.
    """
    cases = []
    for name, rule in WORKLOADS.items():
        fields = r._field_problems(part, "$", rule, "''", 0)
        if name == "dlt":
            # computed once: a list of one list, whose element the function names
            fields = f"""element_at(transform(array({fields}), found ->
                IF(exists(found, p -> contains(p, ' cluster')), found, array_compact(array_append(found, {_sizing_problem(part)})))), 1)"""
        cases.append(f"WHEN '{name}' THEN {fields}")
    return f"""CASE WHEN NOT coalesce({r._is_object(part)}, false) THEN array('wrong type of specific')
        ELSE CASE {route} {' '.join(cases)} ELSE array('no rules for this template') END END"""


def with_workload_problems(
    components: DataFrame, routes: Mapping[str, Sequence[str]], specific: str = "specific", template: str = "template_id"
) -> DataFrame:
    """Adds ``route`` and ``problems`` of workloads, one row per component.

    ``specific`` is the component's own part as JSON text or VARIANT; text that is no JSON, null
    included, is a wrong type.  ``problems`` is empty for a sound part.
    """
    part = F.col(f"`{specific}`")
    if components.schema[specific].dataType.simpleString() == "string":
        part = F.try_parse_json(part)
    # generated columns are computed once, however many rules look at them
    row = F.struct(part.alias("part"), template_route(template, routes).alias("route"))
    kept = [F.col(f"`{c}`") for c in components.columns if c not in ("route", "problems")]
    read = components.select(*kept, F.explode(F.array(row)).alias("__r"))
    return read.select(*kept, F.col("__r.route").alias("route"), F.expr(workload_problems("__r.part", "__r.route")).alias("problems"))
