from helpers import rows
from pyspark.sql import functions as F

from concordat.functions.principals import group_reference, user_mail
from concordat.operators import principals as p


def refs(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "ref string")


def groups(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "display_name string")


def test_names_of_users_and_groups(spark):
    mapped = p.map_to_names(
        refs(spark, "user:john.doe_example.com", "group:data-engineers", "invalid:subject", "User:x", "group:none"),
        groups(spark, "Data-Engineers", "Others"),
    )
    assert rows(mapped) == sorted(
        [
            ("user:john.doe_example.com", "john.doe@example.com", None),
            ("group:data-engineers", "Data-Engineers", None),
            ("invalid:subject", None, "NOT_A_REFERENCE"),
            ("User:x", None, "NOT_A_REFERENCE"),
            ("group:none", None, "GROUP_NOT_FOUND"),
        ],
        key=repr,
    )


def test_ambiguous_group(spark):
    mapped = p.map_to_names(refs(spark, "group:AMBIGUOUS-group"), groups(spark, "Ambiguous-Group", "ambiguous-group"))
    assert rows(mapped) == [("group:AMBIGUOUS-group", None, "GROUP_NOT_UNIQUE")]


def test_mail_replaces_only_the_last_underscore(spark):
    cases = {"a_b_c.com": "a_b@c.com", "plain": "plain", "_x": "@x", "x_": "x@", "a\n_b": "a\n@b", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r[0]: r[1] for r in df.select("u", user_mail("u")).collect()} == cases


def test_group_prefix_is_added_once(spark):
    df = spark.createDataFrame([("g",), ("group:g",)], "g string")
    assert rows(df.select(group_reference("g"))) == [("group:g",), ("group:g",)]


def test_distinct_references(spark):
    assert rows(p.distinct_references(refs(spark, "user:a", "user:a", "group:b"))) == [("group:b",), ("user:a",)]


def test_ids_take_the_first_match(spark):
    users = spark.createDataFrame([("a@x.com", "u2", 2), ("a@x.com", "u1", 1), ("b@x.com", "", 0)], "mail string, id string, seq int")
    grps = spark.createDataFrame([("Team", "g1", 1)], "display_name string, id string, seq int")
    got = p.map_to_ids(refs(spark, "user:a_x.com", "user:b_x.com", "group:Team", "group:team", "x"), users, grps, ["seq"])
    assert {r["ref"]: (r["mapped"], r["error"]) for r in got.collect()} == {
        "user:a_x.com": ("u1", None),
        "user:b_x.com": (None, "USER_NOT_FOUND"),
        "group:Team": ("g1", None),
        "group:team": (None, "GROUP_NOT_FOUND"),
        "x": (None, "NOT_A_REFERENCE"),
    }


def test_workspace_assignments(spark):
    wanted = spark.createDataFrame([("user", "a@x"), ("group", "G"), ("group", "g"), ("user", "z")], "kind string, name string")
    users = spark.createDataFrame([("a@x", "1"), ("z", None)], "user_name string, id string")
    grps = spark.createDataFrame([("G", "7")], "display_name string, id string")
    assert rows(p.workspace_assignments(wanted, users, grps)) == sorted(
        [("user", "a@x", "1", "ADMIN", None), ("group", "G", "7", "USER", None),
         ("group", "g", None, None, "NOT_FOUND"), ("user", "z", None, None, "NOT_FOUND")], key=repr)


def test_run_as_guard(spark):
    definitions = spark.createDataFrame(
        [("same", " APP-1 ", "robot"), ("changed", "app-1", "other"), ("not lowered", "app-1", "Robot"),
         ("unknown", "app-9", "robot"), ("unnamed", "app-2", "robot"), ("unset", "app-9", None), ("blank", "  ", "robot")],
        "name string, run_as string, expected_run_as string",
    )
    directory = spark.createDataFrame(
        [("app-1", "Robot", 1), ("APP-1", "Later", 2), ("app-2", None, 3)], "application_id string, display_name string, seq int"
    )
    got = p.run_as_guard(definitions, directory, [F.col("seq")])
    assert {r["name"]: r["verdict"] for r in got.collect()} == {
        "same": "OK", "changed": "ERROR_RUN_AS_CHANGED", "not lowered": "ERROR_RUN_AS_CHANGED",
        "unknown": "ERROR_UNKNOWN_PRINCIPAL", "unnamed": "ERROR_UNKNOWN_PRINCIPAL", "unset": "OK", "blank": "OK",
    }
