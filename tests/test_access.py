import pytest
from helpers import rows
from pyspark.sql import functions as F

from concordat.functions import permissions as lists
from concordat.operators import access as a
from concordat.plans.access_update import access_update_plan

VIEW = "cat.sch.view"


def grants(spark, *principals, privilege="SELECT"):
    return spark.createDataFrame([(VIEW, p, privilege) for p in principals], "securable string, principal string, privilege string")


def desired(spark, *principals):
    return spark.createDataFrame([(VIEW, p) for p in principals], "securable string, principal string")


def securable(spark, environment, owner="owner@x.com", dev_group="dev-group"):
    return spark.createDataFrame(
        [(VIEW, environment, owner, dev_group)], "securable string, environment string, owner string, dev_group string"
    )


def test_development_keeps_owner_and_group(spark):
    current = grants(spark, "keep", "remove", "dev-group", "owner@x.com")
    revoked = a.revoke_set(current, desired(spark, "keep", "add"), securable(spark, "DEVELOPMENT"))
    assert rows(revoked) == [(VIEW, "remove", "SELECT", "REVOKE")]


def test_production_revokes_owner_and_group(spark):
    revoked = a.revoke_set(grants(spark, "owner@x.com", "dev-group"), desired(spark, "u"), securable(spark, "production"))
    assert rows(revoked, "principal") == [("dev-group",), ("owner@x.com",)]


def test_only_select_is_revoked_and_case_counts(spark):
    current = grants(spark, "Keep", privilege="ALL_PRIVILEGES").unionByName(grants(spark, "Keep"))
    revoked = a.revoke_set(current, desired(spark, "keep"), securable(spark, "qa"))
    assert rows(revoked) == [(VIEW, "Keep", "SELECT", "REVOKE")]


def test_grants_cover_catalog_and_schema(spark):
    assert rows(a.grant_set(desired(spark, "keep", "keep"))) == sorted(
        [("TABLE", VIEW, "keep", "SELECT", "GRANT"), ("CATALOG", "cat", "keep", "USE_CATALOG", "GRANT"),
         ("SCHEMA", "cat.sch", "keep", "USE_SCHEMA", "GRANT")], key=repr)
    current = grants(spark, "keep").withColumnRenamed("securable", "object_name")
    missing = a.grant_set(desired(spark, "keep"), current, "missing_only")
    assert rows(missing, "object_type") == [("CATALOG",), ("SCHEMA",)]
    with pytest.raises(ValueError):
        a.grant_set(desired(spark, "keep"), mode="some")


def test_configured_grants_only_in_development(spark):
    assert a.configured_grants(securable(spark, "production"), "SELECT", "SELECT").count() == 0
    got = a.configured_grants(securable(spark, "Development"), "ALL_PRIVILEGES", "SELECT").where("object_type = 'TABLE'")
    assert rows(got, "principal", "privilege") == [("dev-group", "SELECT"), ("owner@x.com", "ALL_PRIVILEGES")]


def test_configured_levels(spark):
    jobs = spark.createDataFrame([("j", "o", "g"), ("k", None, "")], "object_id string, owner string, dev_group string")
    assert rows(a.configured_levels(jobs, "can_manage", "no_permissions")) == [("j", "user", "o", "CAN_MANAGE")]
    assert a.configured_levels(jobs, "NO_PERMISSIONS", "no_permissions").count() == 0


def test_direct_assignments(spark):
    assignments = spark.createDataFrame(
        [("ws", "/x/ws/1", "P1"), ("ws", "/x/2", "p1"), ("ws", "/x/ws/3", "p2")],
        "resource_name string, assignment_id string, principal_id string",
    )
    wanted = spark.createDataFrame([("ws", "p1"), ("ws", "P1")], "resource_name string, principal_id string")
    assert rows(a.direct_assignments(assignments, wanted)) == [("ws", "/x/ws/1", "P1")]


def update(spark, environment, requested, current, owner="user:owner_x.com"):
    refs = spark.createDataFrame([(VIEW, r) for r in requested], "securable string, ref string")
    directory = spark.createDataFrame([("Dev-Group",), ("Readers",)], "display_name string")
    return access_update_plan(refs, securable(spark, environment, owner, "dev-group"), grants(spark, *current), directory)


def test_plan_in_development(spark):
    plan = update(spark, "development", ["user:keep_x.com", "group:readers"], ["keep@x.com", "old", "Dev-Group", "owner@x.com"])
    assert rows(plan.where("object_type = 'TABLE'"), "principal", "privilege", "action") == [
        ("Readers", "SELECT", "GRANT"), ("keep@x.com", "SELECT", "GRANT"), ("old", "SELECT", "REVOKE"),
    ]
    assert plan.count() == 7


def test_plan_in_production(spark):
    plan = update(spark, "production", ["user:u_x.com"], ["owner@x.com", "Dev-Group"])
    assert rows(plan.where("action = 'REVOKE'"), "principal") == [("Dev-Group",), ("owner@x.com",)]


@pytest.mark.parametrize(
    "requested, current, owner",
    [
        (["user:ok_x.com", "nonsense"], ["old"], "user:owner_x.com"),
        (["user:ok_x.com", "group:missing"], ["old"], "user:owner_x.com"),
        (["user:ok_x.com", None], ["old"], "user:owner_x.com"),
        (["user:ok_x.com"], ["old", ""], "user:owner_x.com"),
        (["user:ok_x.com"], ["old", None], "user:owner_x.com"),
        (["user:ok_x.com"], ["old"], "group:missing"),
        (["user:ok_x.com"], ["old"], None),
    ],
)
def test_any_failure_changes_nothing(spark, requested, current, owner):
    assert update(spark, "development", requested, current, owner).count() == 0


def test_no_requests_revoke_everything(spark):
    assert rows(update(spark, "production", [], ["a", "b"]), "principal", "action") == [("a", "REVOKE"), ("b", "REVOKE")]


def test_gate_verdicts(spark):
    mapped = spark.createDataFrame([("v1", "e"), ("v1", None), ("v2", None), ("v3", None)], "securable string, error string")
    current = spark.createDataFrame([("v2", ""), ("v3", "p")], "securable string, principal string")
    verdicts = a.gate_verdicts(mapped, current)
    assert rows(verdicts) == [
        ("v1", 1, 0, "ERROR_UNMAPPED_REFERENCE"), ("v2", 0, 1, "ERROR_EMPTY_PRINCIPAL"), ("v3", 0, 0, "OK"),
    ]
    assert rows(a.passing_only(mapped, verdicts), "securable") == [("v3",)]


LISTED = "id int, entries array<struct<user_name:string,group_name:string,service_principal_name:string,levels:array<string>>>"


def permission_list(spark, *entries):
    return spark.createDataFrame([(1, list(entries))], LISTED).withColumn("requested", lists.first_levels("entries"))


USER = ("u", None, None, ["CAN_MANAGE", "CAN_READ"])
GROUP = (None, "g", None, ["CAN_EDIT"])


def as_tuples(value):
    return None if value is None else [tuple(e) for e in value]


def test_remove_a_group_from_a_list(spark):
    df = permission_list(spark, USER, GROUP).withColumn("after", lists.drop_principal("requested", group=F.lit("g")))
    row = df.select("after", lists.is_unchanged("requested", "after").alias("same")).first()
    assert as_tuples(row["after"]) == [("u", None, None, "CAN_MANAGE")] and row["same"] is False


def test_unknown_user_leaves_the_list(spark):
    df = permission_list(spark, USER, GROUP).withColumn("after", lists.drop_principal("requested", user=F.lit("x")))
    assert df.select(lists.is_unchanged("requested", "after")).first()[0] is True
    with pytest.raises(ValueError):
        lists.drop_principal("requested")


def test_a_null_list_is_an_empty_one(spark):
    df = spark.createDataFrame([(1, None)], LISTED).withColumn("requested", lists.first_levels("entries"))
    row = df.select("requested", lists.append_entry("requested", "CAN_RUN", user=F.lit("u")).alias("after")).first()
    assert row["requested"] == [] and as_tuples(row["after"]) == [("u", None, None, "CAN_RUN")]


def test_append_keeps_duplicates(spark):
    df = permission_list(spark, USER).select(lists.append_entry("requested", "CAN_MANAGE", user=F.lit("u")).alias("after"))
    assert as_tuples(df.first()["after"]) == [("u", None, None, "CAN_MANAGE")] * 2


@pytest.mark.parametrize("levels", [[], None, [""], [None]])
def test_entry_without_level_is_an_error(spark, levels):
    row = permission_list(spark, USER, ("x", None, None, levels)).select(
        "requested", lists.has_entry_without_level("entries").alias("bad")
    ).first()
    assert row["requested"] is None and row["bad"] is True
