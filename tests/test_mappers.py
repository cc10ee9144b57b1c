import pytest
from helpers import rows

from concordat.operators.mappers import batch_mapper, mapper, register
from concordat.operators.principals import workspace_assignments


def refs(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row int, ref string")


def test_a_function_of_lists_is_a_mapper(spark, tmp_path):
    log = str(tmp_path / "asked")

    def of_batch(part):
        with open(log, "a") as f:
            f.write("".join(f"{len(part)} {r}\n" for r in part))
        return {r: ValueError("no such user") if r == "user:lost" else "" if r == "user:empty" else r.upper() for r in part if r != "user:silent"}

    wanted = refs(spark, "user:a", "user:a", "user:lost", "user:empty", "user:silent", None, *[f"user:u{i}" for i in range(50)])
    found = {r["row"]: (r["mapped"], r["error"]) for r in batch_mapper(of_batch, batch=7, calls=2)(wanted).collect()}
    assert found[0] == found[1] == ("USER:A", None) and found[2] == (None, "no such user") and found[5] == (None, "NOT_A_REFERENCE")
    assert found[3] == found[4] == (None, "NOT_MAPPED") and found[55] == ("USER:U49", None)
    asked = [line.split() for line in open(log)]
    assert len(asked) == len({r for _, r in asked}) == 54 and max(int(n) for n, _ in asked) == 7


def test_an_exception_is_the_error_of_its_list(spark):
    def of_batch(part):
        raise TimeoutError

    got = rows(batch_mapper(of_batch)(refs(spark, "user:a", "group:b")), "mapped", "error")
    assert got == [(None, "TimeoutError")] * 2


def test_mappers_by_name(spark):
    groups = spark.createDataFrame([("Readers",)], "display_name string")
    found = rows(mapper("names", groups=groups)(refs(spark, "group:readers", "user:a_x.com", "nothing")), "mapped", "error")
    assert found == [("Readers", None), ("a@x.com", None), (None, "NOT_A_REFERENCE")]
    with pytest.raises(ValueError):
        mapper("unknown")
    with pytest.raises(ValueError):
        register("names", None)


def test_the_first_listed_principal_counts(spark):
    users = spark.createDataFrame([("u", "9", 1), ("u", "1", 2), ("v", "", 1), ("v", "3", 2)], "user_name string, id string, seq int")
    groups = spark.createDataFrame([("g", "5", 7)], "display_name string, id string, seq int")
    wanted = spark.createDataFrame([("user", "u"), ("user", "v"), ("group", "g"), ("group", "u")], "kind string, name string")
    got = rows(workspace_assignments(wanted, users, groups, ["seq"]))
    assert got == [("group", "g", "5", "USER", None), ("group", "u", None, None, "NOT_FOUND"), ("user", "u", "9", "ADMIN", None), ("user", "v", None, None, "NOT_FOUND")]
    assert ("user", "u", "1", "ADMIN", None) in rows(workspace_assignments(wanted, users, groups))
