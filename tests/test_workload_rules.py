import json

from helpers import rows
from pyspark.sql import functions as F

from checks.components import _FLOW, _JOB, _PIPELINE, ROUTES
from concordat.operators.workload_rules import with_workload_problems

TEMPLATES = {"job": "urn:template:batch-job:1", "workflow": "urn:template:task-graph:1", "dlt": '"urn:template:live-tables:3"'}


def problems(spark, *parts):
    table = spark.createDataFrame([(i, TEMPLATES.get(t, t), p, "old") for i, (t, p) in enumerate(parts)], "i int, template_id string, specific string, route string")
    got = with_workload_problems(table, ROUTES)
    assert got.columns == ["i", "template_id", "specific", "route", "problems"]
    as_variant = with_workload_problems(table.withColumn("specific", F.try_parse_json("specific")), ROUTES)
    assert rows(as_variant, "i", "route", "problems") == rows(got, "i", "route", "problems")
    return [(r["route"], r["problems"]) for r in got.orderBy("i").collect()]


def test_sound_parts_and_odd_ones(spark):
    found = problems(spark, ("job", _JOB), ("workflow", _FLOW), ("dlt", _PIPELINE), ("other", _JOB), (None, _JOB), ("job", None), ("dlt", "[1]"), ("job", "{}"))
    assert found[:3] == [("job", []), ("workflow", []), ("dlt", [])]
    assert found[3] == found[4] == (None, ["no rules for this template"])
    assert found[5] == ("job", ["wrong type of specific"]) and found[6] == ("dlt", ["wrong type of specific"])
    assert set(found[7][1]) == {f"missing {name}" for name in ("workspace", "git", "repoPath", "jobName", "cluster")}


def test_all_problems_of_a_part_are_listed(spark):
    part = json.loads(_PIPELINE)
    part |= {"catalog": "", "target": None, "files": ["a", 2], "notifications": [{"mail": 1}]}
    part["cluster"] = {"workerType": "x", "driverType": "", "minWorkers": 1}
    ((_, found),) = problems(spark, ("dlt", json.dumps(part)))
    assert set(found) == {
        "invalid catalog", "missing target", "wrong type of files[1]", "wrong type of notifications[0].mail",
        "missing notifications[0].alert", "invalid cluster.driverType",
    }
    part["cluster"]["driverType"] = "y"
    ((_, found),) = problems(spark, ("dlt", json.dumps(part)))
    assert "cluster: fixed size needs a number of workers" in found and "invalid cluster.driverType" not in found


def test_a_field_under_both_names_counts_by_the_first(spark):
    part = json.loads(_PIPELINE) | {"pipeline_name": ""}
    flow = json.loads(_FLOW) | {"workflow_tasks_info": [3]}
    found = problems(spark, ("dlt", json.dumps(part)), ("workflow", json.dumps(flow)))
    assert [p for _, p in found] == [[], []]
