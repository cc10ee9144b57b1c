import pytest
from helpers import rows
from pyspark.sql import functions as F

from concordat.functions.maps import last_wins_map
from concordat.operators import lookup
from concordat.operators import workflows as w
from concordat.operators.definitions import compare_definitions

TASK = (
    "task_key string, pipeline_task struct<pipeline_id:string>, run_job_task struct<job_id:bigint>, "
    "notebook_task struct<warehouse_id:string>, existing_cluster_id string"
)
JOBS = f"job_id int, tasks array<struct<{TASK.replace(' string', ':string').replace(' struct', ':struct')}>>"
INFO = "job_id int, task_key string, seq int, ref_type string, name string"
DIRECTORY = "ref_type string, name string, id string"


def jobs(spark, *tasks, job=1):
    return spark.createDataFrame([(job, list(tasks))], JOBS)


def test_reference_types_by_priority(spark):
    df = jobs(
        spark,
        ("both", ("p1",), (5,), None, None), ("job", None, (5,), None, None),
        ("warehouse", None, None, ("w1",), "c1"), ("compute", None, None, (None,), "c1"),
        ("cluster only", None, None, None, "c1"), ("nothing", None, None, (None,), None),
    )
    got = {r["task_key"]: (r["ref_type"], r["ref_id"]) for r in w.explode_tasks(df).collect()}
    assert got == {
        "both": ("pipeline", "p1"), "job": ("job", "5"), "warehouse": ("notebook_warehouse", "w1"),
        "compute": ("notebook_compute", "c1"), "cluster only": (None, None), "nothing": (None, None),
    }


def test_capture(spark):
    tasks = spark.createDataFrame(
        [(1, 0, "a", "pipeline", "p1"), (1, 1, "b", "notebook_warehouse", "w1"), (1, 2, "c", None, None),
         (1, 3, "d", "job", "9"), (1, 4, "e", "job", "5"), (1, 5, "f", "notebook_compute", "n"), (1, 6, "g", "notebook_compute", "x")],
        "job_id int, pos int, task_key string, ref_type string, ref_id string",
    )
    directory = spark.createDataFrame(
        [("pipeline", "Pipe", "p1"), ("notebook_warehouse", "Ware", "w1"), ("job", "", "5"), ("notebook_compute", None, "n")], DIRECTORY
    )
    got = w.capture_references(tasks, directory)
    assert rows(got, "task_key", "referenced_name", "cluster_name", "error") == [
        ("a", "Pipe", None, None), ("b", None, "Ware", None), ("d", None, None, "JOB_WITHOUT_NAME"),
        ("e", "", None, "JOB_WITHOUT_NAME"), ("f", None, None, None), ("g", None, None, "NAME_NOT_FOUND"),
    ]


def rewrite(spark, df, infos, directory):
    return w.rewrite_references(
        w.explode_tasks(df).drop("task"), spark.createDataFrame(infos, INFO), spark.createDataFrame(directory, DIRECTORY)
    )


def test_rewrite_keeps_order_and_unlisted_tasks(spark):
    df = jobs(spark, ("dlt_task", ("old-dlt-id",), None, None, None), ("notebook_task", None, None, ("w",), None))
    got = rewrite(spark, df, [(1, "dlt_task", 0, "pipeline", "dlt")], [("pipeline", "dlt", "new-dlt-id")])
    nested = w.nest_tasks(got, "task_key", "new_ref_id").first()
    assert [tuple(t) for t in nested["tasks"]] == [("dlt_task", "new-dlt-id"), ("notebook_task", "w")]
    assert nested["errors"] == []


def test_first_listed_counts_and_jobs_without_tasks_stay(spark):
    target = spark.createDataFrame(
        [("notebook_warehouse", "w", "z", 1), ("notebook_warehouse", "w", "a", 2)], DIRECTORY + ", place int"
    )
    df = jobs(spark, ("t", None, None, ("old",), None))
    empty = df.withColumn("tasks", F.slice("tasks", 1, 0)).withColumn("job_id", F.col("job_id") + 1)
    infos = spark.createDataFrame([(1, "t", 0, "notebook_warehouse", "w")], INFO)
    got = w.rewrite_references(w.explode_tasks(df.union(empty)).drop("task"), infos, target, order=["place"])
    nested = {r["job_id"]: [tuple(t) for t in r["tasks"]] for r in w.nest_tasks(got, "task_key", "new_ref_id").collect()}
    assert nested == {1: [("t", "z")], 2: []}


@pytest.mark.parametrize(
    "infos, directory, expected",
    [
        ([(1, "t", 0, "pipeline", "a"), (1, "t", 1, "pipeline", "b")], [("pipeline", "a", "A"), ("pipeline", "b", "B")], ("B", None)),
        ([(1, "t", 0, "pipeline", "a")], [("job", "a", "A")], (None, "NAME_NOT_FOUND")),
        ([(1, "t", 0, "pipeline", "a")], [("pipeline", "a", "A"), ("pipeline", "a", "B")], (None, "NAME_NOT_UNIQUE")),
        ([(1, "t", 0, "pipeline", "a")], [("pipeline", "A", "A")], (None, "NAME_NOT_FOUND")),
        ([(1, "t", 0, "pipeline", "a")], [("pipeline", "a", None)], (None, "EMPTY_ID")),
        ([(1, "t", 0, "job", "a")], [("job", "a", None)], (None, "EMPTY_ID")),
        ([(1, "t", 0, "pipeline", "")], [], (None, "EMPTY_NAME")),
        ([(1, "t", 0, "notebook_warehouse", "wH")], [("notebook_warehouse", "Wh", "1"), ("notebook_warehouse", "wh", "2")], ("1", None)),
        ([(1, "t", 0, None, "x")], [], ("old", None)),
        ([(2, "t", 0, "pipeline", "a")], [("pipeline", "a", "A")], ("old", None)),
    ],
)
def test_rewrite_cases(spark, infos, directory, expected):
    df = jobs(spark, ("t", ("old",), None, None, None))
    assert rows(rewrite(spark, df, infos, directory), "new_ref_id", "error") == [expected]


DEFINITION = "name string, schedule string, override boolean, environment string"


@pytest.mark.parametrize(
    "requested, existing, verdict",
    [
        (("", "s", False, "dev"), [], "ERROR_NO_NAME"),
        ((None, "s", False, "dev"), [], "ERROR_NO_NAME"),
        (("w", "s", False, "development"), [], "OK_NEW"),
        (("w", "s", False, "development"), [("w", 1, "s"), ("w", 2, "s")], "ERROR_NOT_UNIQUE"),
        (("w", "s", False, "development"), [("w", None, "s")], "ERROR_EMPTY_ID"),
        (("w", "s", False, "development"), [("w", 1, "s")], "OK_SAME"),
        (("w", None, False, "development"), [("w", 1, None)], "OK_SAME"),
        (("w", "s", True, "development"), [("w", 1, "t")], "OK_OVERRIDE"),
        (("w", "s", False, "Development"), [("w", 1, "t")], "ERROR_DIFFERS"),
        (("w", None, False, "production"), [("w", 1, "t")], "ERROR_EMPTY_REQUEST"),
        (("w", "s", None, "production"), [("w", 1, "t")], "OK_CHANGED"),
    ],
)
def test_definition_verdicts(spark, requested, existing, verdict):
    got = compare_definitions(
        spark.createDataFrame([requested], DEFINITION),
        spark.createDataFrame(existing, "name string, id int, schedule string"),
        ["schedule"],
        {"schedule": F.lit(None)},
    )
    assert rows(got, "verdict") == [(verdict,)]


EXISTING = "name string, id string"


def test_unique_lookup_and_plans(spark):
    requests = spark.createDataFrame([(n,) for n in ("one", "two", "none", "blank")], "name string")
    existing = spark.createDataFrame([("one", "1"), ("two", "2"), ("two", "3"), ("blank", "")], EXISTING)
    assert rows(lookup.unique_lookup(requests, existing), "name", "id", "verdict") == [
        ("blank", None, "EMPTY_ID"), ("none", None, "NOT_FOUND"), ("one", "1", "OK"), ("two", None, "AMBIGUOUS"),
    ]
    lenient = lookup.unique_lookup(requests, existing, empty_id_is_error=False).where("name = 'blank'")
    assert rows(lenient, "id", "verdict") == [("", "OK")]
    assert rows(lookup.upsert_plan(requests, existing), "name", "id", "action") == [
        ("blank", None, "ERROR_EMPTY_ID"), ("none", None, "CREATE"), ("one", "1", "UPDATE"), ("two", None, "ERROR_NOT_UNIQUE"),
    ]
    assert rows(lookup.delete_plan(requests.where("name <> 'one'"), existing), "name", "id") == [
        ("blank", ""), ("two", "2"), ("two", "3"),
    ]


def test_first_match(spark):
    directory = spark.createDataFrame(
        [("WH", "", 0), ("wh", "b", 2), ("Wh", "a", 1), ("", "x", 0), (None, "y", 0)], "name string, id string, seq int"
    )
    requests = spark.createDataFrame([("wH",), ("",), (None,), ("zz",)], "wanted string")
    got = lookup.first_match_lookup(requests, directory, {"wanted": "name"}, "id", ["seq"])
    assert rows(got) == sorted([("wH", "a"), ("", None), (None, None), ("zz", None)], key=repr)
    padded = spark.createDataFrame([("\t wh \n",)], "wanted string")
    got = lookup.first_match_lookup(padded, directory, {"wanted": "name"}, "id", ["seq"], lookup.trim_casefold)
    assert rows(got, "id") == [("a",)]


def test_names_like(spark):
    names = spark.createDataFrame([("a_b",), ("axb",), ("a%b",), ("ab",)], "name string")
    assert rows(lookup.names_like(names, "name", "a_b")) == [("a%b",), ("a_b",), ("axb",)]
    assert rows(lookup.names_like(names, "name", "a_b", escape=True)) == [("a_b",)]
    assert rows(lookup.names_like(names, "name", "a%b", escape=True)) == [("a%b",)]


def test_last_wins(spark):
    pairs = spark.createDataFrame([("o", "k", "1", 1), ("o", "k", "2", 2), ("o", "l", "3", 0)], "owner string, key string, value string, seq int")
    assert rows(lookup.last_wins(pairs, ["owner"], "key", "value", ["seq"])) == [("o", "k", "2"), ("o", "l", "3")]
    lists = spark.createDataFrame(
        [(1, [("a", "1"), ("b", "2"), ("a", "3")]), (2, None), (3, [])], "id int, e array<struct<name:string,value:string>>"
    )
    assert {r[0]: r[1] for r in lists.select("id", last_wins_map("e")).collect()} == {1: {"a": "3", "b": "2"}, 2: {}, 3: {}}


def test_rebuilt_jobs(spark):
    shape = ("job_id bigint, name string, tasks array<struct<task_key: string, pipeline_task: struct<pipeline_id: string>,"
             " run_job_task: struct<job_id: bigint>, notebook_task: struct<warehouse_id: string>, existing_cluster_id: string>>")
    task = lambda key, pipeline=None, job=None, warehouse=None, cluster=None: (
        key, pipeline and (pipeline,), job and (job,), warehouse and (warehouse,), cluster)
    jobs = spark.createDataFrame([
        (1, "a", [task("p", pipeline="old"), task("plain", warehouse="w"), task("j", job=5)]),
        (2, "b", None), (3, "c", []),
        (4, "d", [task("p", warehouse="w"), task("j", job=6)]),
    ], shape)
    infos = spark.createDataFrame([
        (1, "p", 1, "pipeline", "P"), (1, "j", 1, "job", "J"), (4, "p", 1, "pipeline", "P"), (4, "j", 1, "job", "text"),
    ], "job_id bigint, task_key string, seq int, ref_type string, name string")
    target = spark.createDataFrame([("pipeline", "P", "new"), ("job", "J", "77"), ("job", "text", "x1")],
                                   "ref_type string, name string, id string")
    found = {r["job_id"]: r for r in w.rebuild_jobs(jobs, infos, target).collect()}
    first = found[1]["tasks"]
    assert [t["task_key"] for t in first] == ["p", "plain", "j"]
    assert first[0]["pipeline_task"]["pipeline_id"] == "new" and first[2]["run_job_task"]["job_id"] == 77
    assert first[1]["notebook_task"]["warehouse_id"] == "w"
    assert found[2]["tasks"] is None and found[3]["tasks"] == [] and found[3]["errors"] == []
    assert found[4]["tasks"] is None and [e["error"] for e in found[4]["errors"]] == ["TASK_OF_ANOTHER_TYPE", "JOB_ID_NOT_A_NUMBER"]
    assert [found[i]["name"] for i in (1, 2, 3, 4)] == ["a", "b", "c", "d"]


def test_updates_of_workflows(spark):
    """A job asked for twice, one without tasks, and every reason against an update."""
    import datetime

    from pyspark.sql import functions as F

    from concordat.plans.reverse_provision import judge_workflow_requests, workflow_updates

    jobs = spark.createDataFrame(
        [(1, "a", "app", 5, None, '{"x": 1}'), (2, "b", None, None, "me", None), (3, "c", "app", 5, "me", "{}"), (4, "d", "app", 1, "", "{}"), (5, "d", "app", 1, "", "{}"), (6, "e", "lost", 1, "", "{}")],
        "job_id bigint, name string, run_as string, created_time bigint, creator_user_name string, settings string",
    )
    captured = spark.createDataFrame(
        [(1, 0, "t0", "pipeline", "p", "P", None, None, None), (1, 1, "t1", "notebook_compute", None, None, "c", None, None), (3, 0, "t", "job", "9", None, None, None, "JOB_WITHOUT_NAME")],
        "job_id bigint, pos int, task_key string, ref_type string, referenced_id string, referenced_name string, cluster_id string, cluster_name string, error string",
    )
    principals = spark.createDataFrame([("app", "Runner", 1)], "application_id string, display_name string, seq int")
    requests = spark.createDataFrame(
        [(1, "a", "runner"), (2, "a", None), (3, "b", "runner"), (4, "c", None), (5, "d", None), (6, "", None), (7, None, None), (8, "zz", None), (9, "a", "other"), (10, "e", "runner")],
        "request_id int, name string, expected_run_as string",
    )
    judged = judge_workflow_requests(requests, jobs, captured, principals)
    assert {r["request_id"]: (r["job_id"], r["error"]) for r in judged.collect()} == {
        1: (1, None), 2: (1, None), 3: (2, None), 4: (3, "REFERENCE_NOT_CAPTURED"), 5: (None, "AMBIGUOUS"), 6: (None, "EMPTY_NAME"),
        7: (None, "EMPTY_NAME"), 8: (None, "NOT_FOUND"), 9: (1, "ERROR_RUN_AS_CHANGED"), 10: (6, "ERROR_UNKNOWN_PRINCIPAL"),
    }
    moment = F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5, 6000))
    found = workflow_updates(judged, jobs, captured, "form", "template", moment).collect()
    assert len(found) == 2 * (7 + 2) + 7 + 1
    values = {(r["request_id"], r["path"].rsplit(".", 1)[-1], r["pos"]): r["value_json"] for r in found}
    assert values[1, "workflowTasksInfoList", 1] == (
        '{"taskKey":"t1","referencedTaskType":"notebook_compute","referencedTaskId":null,"referencedTaskName":null,'
        '"referencedClusterName":null,"referencedClusterId":"c"}'
    )
    assert values[3, "workflowTasksInfoList", None] == "[]" and values[3, "settings", None] == "{}"
    assert values[3, "created_time", None] == values[1, "creator_user_name", None] == "null"
    assert values[2, "updatedDate", None] == '"2024-01-02T03:04:05.006Z"' and values[2, "name", None] == '"IGNORED"'


def test_workflow_updates_broadcast_nothing_that_grows_with_the_jobs(spark):
    from pyspark.sql import functions as F

    from concordat.plans.reverse_provision import judge_workflow_requests, workflow_updates

    jobs = spark.createDataFrame([(1, "a", "app", 5, "me", "{}")], "job_id bigint, name string, run_as string, created_time bigint, creator_user_name string, settings string")
    tasks = spark.createDataFrame([(1, 0, "t0", "pipeline", "p")], "job_id bigint, pos int, task_key string, ref_type string, ref_id string")
    names = spark.createDataFrame([("pipeline", "p", "P")], "ref_type string, id string, name string")
    principals = spark.createDataFrame([("app", "Runner", 1)], "application_id string, display_name string, seq int")
    requests = spark.createDataFrame([(1, "a", "runner")], "request_id int, name string, expected_run_as string")
    captured = w.capture_references(tasks, names, merge=True)
    judged = judge_workflow_requests(requests, jobs, captured, principals)
    updates = workflow_updates(judged, jobs, captured, "form", "template", F.lit("2024-01-02").cast("timestamp"))
    assert updates.count() == 8
    assert "Broadcast" not in updates._jdf.queryExecution().executedPlan().toString()
