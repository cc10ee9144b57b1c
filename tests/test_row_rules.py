import datetime

from helpers import rows

from concordat.operators import row_rules as r
from concordat.operators.row_rules import ColumnRule


def data(spark):
    return spark.createDataFrame(
        [(1, "abc", 12.345, "7", None), (1, None, 99999.0, "x", "2024-01-01"), (2, "abcdef", None, None, "nope"), (None, "", -5.0, " 8 ", "")],
        "id int, name string, amount double, code string, day string",
    )


RULES = [
    ColumnRule("id", constraint="PRIMARY_KEY"), ColumnRule("name", "STRING", "NOT_NULL", data_length=3),
    ColumnRule("amount", "DECIMAL", precision=5, scale=2), ColumnRule("code", "int"), ColumnRule("day", "DATE"),
]


def test_counts(spark):
    assert rows(r.count_violations(data(spark), RULES)) == [
        ("amount", "DECIMAL_FIT", 1, 4), ("code", "CASTABLE", 1, 4), ("day", "CASTABLE", 2, 4),
        ("id", "NOT_NULL", 1, 4), ("name", "MAX_LENGTH", 1, 4), ("name", "NOT_NULL", 1, 4),
    ]


def test_rows_and_counts_agree(spark):
    broken = r.violating_rows(data(spark), RULES)
    assert sum(len(v) for (v,) in rows(broken, "violations")) == 7
    assert broken.count() == 3


def test_one_scan_reads_only_ruled_columns(spark, tmp_path):
    data(spark).write.parquet(str(tmp_path / "t"))
    counts = r.count_violations(spark.read.parquet(str(tmp_path / "t")), [ColumnRule("id", constraint="NOT_NULL")])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<id:int>" in plan


def test_duplicate_keys(spark):
    assert rows(r.duplicate_keys(data(spark), ["id"])) == [(1, 2)]


def test_profile(spark):
    df = data(spark)
    got = {x["column_name"]: tuple(x)[1:] for x in r.profile(df).collect()}
    assert got["id"] == (4, 1, 2, "1", "2")
    assert got["name"] == (4, 1, 3, "", "abcdef")
    assert got["amount"] == (4, 1, 3, "-5.0", "99999.0")
    estimated = {x["column_name"]: tuple(x)[1:] for x in r.profile(df, exact=False).collect()}
    assert estimated == got


def test_freshness(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 12),), (None,)], "ts timestamp_ntz")
    assert r.freshness(df, "ts", "2024-01-02 11:00:00", "24 HOURS").first()["is_fresh"] is True
    assert r.freshness(df, "ts", "2024-01-02 13:00:00", "24 HOURS").first()["is_fresh"] is False
    assert r.freshness(df.where("ts IS NULL"), "ts", "2024-01-02 13:00:00", "24 HOURS").first()["is_fresh"] is False


def test_cheap_conditions_equal_casts(spark):
    """Doubles around the bound of a decimal, and texts around the form of a number."""
    edges = [99999.994, 99999.995, 99999.996, 99999.99, 100000.0, -99999.995, -99999.994, 0.0, float("nan"), float("inf"), None, 1e20]
    df = spark.createDataFrame([(x,) for x in edges], "x double")
    for precision, scale in ((7, 2), (5, 0), (3, 3), (15, 4)):
        plain = f"x IS NOT NULL AND try_cast(x AS decimal({precision},{scale})) IS NULL"
        got = r.count_violations(df, [ColumnRule("x", precision=precision, scale=scale)]).first()["violations"]
        assert got == df.where(plain).count(), (precision, scale)
    texts = ["1", " 1", "1 ", "\t+1\n", "-1", "1.5", ".5", "1e3", "", " ", "x1", "1x", "\x7f3", "99999999999", "\u00a05", None, "--1", "+"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for name, spark_type in (("INT", "int"), ("BIGINT", "bigint"), ("DOUBLE", "double"), ("BOOLEAN", "boolean")):
        plain = f"x IS NOT NULL AND try_cast(x AS {spark_type}) IS NULL"
        got = r.count_violations(df, [ColumnRule("x", name)]).first()["violations"]
        assert got == df.where(plain).count(), name


def test_profile_covers_every_column(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (CAST(9 AS DECIMAL(6,2)), array(1), map(1, 2), true, 'b', DATE'2024-01-02'), "
        "(10, array(1), null, false, null, null), (100.5, null, null, true, 'a', DATE'2024-01-01') AS t(d, a, m, b, s, t)"
    )
    expected = [
        ("a", 3, 1, 1, None, None), ("b", 3, 0, 2, "false", "true"), ("d", 3, 0, 3, "9.00", "100.50"), ("m", 3, 2, None, None, None),
        ("s", 3, 1, 2, "a", "b"), ("t", 3, 1, 2, "2024-01-01 00:00:00", "2024-01-02 00:00:00"),
    ]
    names = ["column_name", "rows", "nulls", "distinct_values", "min_value", "max_value"]
    assert rows(r.profile(df), *names) == expected == rows(r.profile(df, exact=False), *names)
    assert {x["distinct_values"] for x in r.profile(df.limit(0)).collect()} == {0, None}
