import random

from helpers import rows

from concordat.operators.profile_states import DISTINCT_ERROR, keep_states, kept_states, partition_states, profile_of_states
from concordat.operators.row_rules import profile

EXACT = ["column_name", "rows", "nulls", "min_value", "max_value"]


def data(spark, days, n=3000, seed=1):
    rng = random.Random(seed)
    made = [
        (rng.choice(days), rng.randrange(10**6), rng.choice([None, "a", "é", f"t{rng.randrange(900)}"]), rng.choice([None, rng.gauss(0, 1), float("nan")]), [1])
        for _ in range(n)
    ]
    return spark.createDataFrame(made, "day int, `id.x` long, name string, score double, parts array<int>")


def test_merged_states_equal_the_whole_profile(spark, tmp_path):
    whole = data(spark, [1, 2, 3, None])
    keep_states(whole.where("day <= 2"), ["day"], str(tmp_path / "states"))
    keep_states(whole.where("day = 2 OR day = 3 OR day IS NULL"), ["day"], str(tmp_path / "states"))
    keep_states(whole.where("day = 3"), ["day"], str(tmp_path / "states"))  # run again
    states = kept_states(spark, str(tmp_path / "states"))
    assert states.count() == 4
    found, exact = profile_of_states(states, (0.1, 0.5)), profile(whole.drop("day"))
    assert rows(found, *EXACT) == rows(exact, *EXACT)
    counted = {r["column_name"]: r["distinct_values"] for r in exact.collect()}
    for r in found.collect():
        assert abs(r["distinct_values"] - counted[r["column_name"]]) <= 4 * DISTINCT_ERROR * counted[r["column_name"]] + 1
        if r["column_name"] == "score":
            low, high = r["quantiles"]
            assert abs(low + 1.28) < 0.15 and abs(high) < 0.1
        elif r["column_name"] != "id.x":
            assert r["quantiles"] is None


def test_a_column_that_comes_later(spark, tmp_path):
    path = str(tmp_path / "states")
    keep_states(spark.sql("SELECT 1 AS day, 5 AS a FROM range(3)"), ["day"], path)
    keep_states(spark.sql("SELECT 2 AS day, 7 AS a, 'x' AS b FROM range(2)"), ["day"], path)
    found = rows(profile_of_states(kept_states(spark, path)), *EXACT, "distinct_values")
    assert found == [("a", 5, 0, "5", "7", 2), ("b", 5, 3, "x", "x", 1)]


def test_states_are_small_and_empty_tables_have_none(spark):
    df = data(spark, [1])
    assert profile_of_states(partition_states(df.limit(0), ["day"])).count() == 0
    nothing = rows(profile_of_states(partition_states(spark.sql("SELECT 1 AS day, CAST(NULL AS DOUBLE) AS v, map('k', 1) AS m"), ["day"])))
    assert nothing == [("m", 1, 0, None, None, None, None), ("v", 1, 1, 0, None, None, None)]
