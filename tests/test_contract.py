from helpers import rows
from pyspark.sql import functions as F

from concordat.functions.types import CONTRACT_TYPES, contract_type, is_contract_type
from concordat.operators import contract as c
from concordat.operators.problems import gather_problems
from concordat.plans.reverse_provision import contract_problems, reverse_provision_plan
from concordat.schemas import COLUMN_INVENTORY
from concordat.sources.catalog import column_inventory, database_inventory, scan_table

CONSTRAINTS = "table_name string, constraint_name string, child_columns array<string>"


def inventory(spark, *columns):
    return spark.createDataFrame([("c.s.t", i, *col) for i, col in enumerate(columns)], COLUMN_INVENTORY)


def derive(spark, keys, *columns, strict=False):
    constraints = spark.createDataFrame([("c.s.t", "pk", keys)] if keys else [], CONSTRAINTS)
    marked = c.mark_primary_key(inventory(spark, *columns), constraints)
    return {r["name"]: r for r in c.derive_contract(marked, strict).collect()}


def test_mixed_types_with_unknown_nullability(spark):
    got = derive(
        spark, [],
        ("id", "INT", "int", None, None, None, None),
        ("string_field", "STRING", "string", None, None, None, None),
        ("decimal_field", "DECIMAL", "decimal(10,4)", 10, 4, None, None),
    )
    assert [r["constraint"] for r in got.values()] == ["NOT_NULL"] * 3
    assert got["string_field"]["data_length"] == 65535
    assert (got["decimal_field"]["precision"], got["decimal_field"]["scale"]) == (10, 4)
    assert got["id"]["description"] == "int" and got["id"]["data_length"] is None


def test_constraints_and_comments(spark):
    got = derive(
        spark, ["pk_col"],
        ("pk_col", "INT", "int", None, None, False, None),
        ("not_null_col", "STRING", "string", None, None, False, ""),
        ("date_col", "DATE", "date", None, None, True, "a date"),
        ("array_col", "ARRAY", "array<string>", None, None, True, None),
    )
    assert got["pk_col"]["constraint"] == "PRIMARY_KEY"
    assert got["not_null_col"]["constraint"] == "NOT_NULL"
    assert got["date_col"]["constraint"] is None and got["date_col"]["description"] == "a date"
    assert got["array_col"]["data_type"] == "ARRAY" and got["array_col"]["description"] == "array<string>"


def test_decimal_without_fraction_digits(spark):
    column = ("d", "DECIMAL", "decimal(10,0)", 10, 0, True, None)
    assert derive(spark, [], column)["d"]["precision"] is None
    strict = derive(spark, [], column, strict=True)["d"]
    assert (strict["precision"], strict["scale"]) == (10, 0)


def test_type_map(spark):
    cases = {
        "DECIMAL(10,0)": "DECIMAL", "ARRAY<INT>": "ARRAY", "MAP<STRING,INT>": "MAP", "STRUCT<A:INT>": "STRUCT",
        "VARCHAR(3)": "VARCHAR", "CHAR(3)": "CHAR", "TIMESTAMP_NTZ": "TIMESTAMPZ", "TIMESTAMP": "TIMESTAMP",
        "LONG": "LONG", "INTERVAL": "INTERVAL", "INTERVAL DAY TO SECOND": None, "VOID": None, "int": None,
        "SHORT": None, "INTEGER": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", contract_type("t")).collect()} == cases


def test_declared_types(spark):
    df = spark.createDataFrame([("bigint",), ("Json",), ("timestamp_ntz",), (None,)], "data_type string")
    assert rows(c.unknown_types(df)) == [("timestamp_ntz",), (None,)]
    assert len(CONTRACT_TYPES) == len(set(CONTRACT_TYPES)) == 43
    assert df.where(is_contract_type("data_type")).count() == 2


def test_missing_columns_keep_case_and_list_all(spark):
    inv = inventory(spark, ("id", "INT", "int", None, None, True, None), ("value", "INT", "int", None, None, True, None))
    contract = spark.createDataFrame(
        [("c.s.t", n) for n in ("id", "extra_column", "VALUE", "other")], "table_name string, name string"
    )
    missing = c.missing_columns(contract, inv)
    assert rows(missing, "name") == [("VALUE",), ("extra_column",), ("other",)]
    gathered = gather_problems(missing, ["table_name"], "name")
    assert rows(gathered, "name", "times", "problem_count") == [("VALUE", 1, 3), ("extra_column", 1, 3), ("other", 1, 3)]


def test_every_problem_is_listed_at_any_size(spark):
    problems = spark.range(3000).select(
        F.when(F.col("id") < 2990, "big").otherwise("small").alias("unit"),
        F.concat(F.lit("m"), F.col("id") % 1500).alias("message"),
    )
    got = gather_problems(problems, ["unit"]).where("unit = 'big'").collect()
    assert sorted(r["message"] for r in got) == sorted(f"m{i}" for i in range(1500))
    assert sum(r["times"] for r in got) == 2990 and {r["problem_count"] for r in got} == {2990}


def test_repeated_columns(spark):
    contract = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "a")], "table_name string, name string")
    assert rows(c.duplicate_columns(contract)) == [("t", "a", 2)]


def test_projection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b.c` int, d int")
    assert c.contract_projection(df, ["d", "b.c"]).columns == ["d", "b.c"]
    assert c.contract_projection(df, []).columns == df.columns
    assert c.contract_projection(df, None).columns == df.columns


def test_inventory_of_saved_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("DROP TABLE IF EXISTS shop.items")
    spark.sql(
        "CREATE TABLE shop.items (id BIGINT COMMENT 'key', code VARCHAR(5), price DECIMAL(8,2), at TIMESTAMP_NTZ) USING parquet"
    )
    got = rows(database_inventory(spark, "shop"), "table_name", "pos", "column_name", "type_name", "type_precision", "comment")
    assert got == [
        ("shop.items", 0, "id", "BIGINT", None, "key"),
        ("shop.items", 1, "code", "VARCHAR(5)", None, None),
        ("shop.items", 2, "price", "DECIMAL(8,2)", 8, None),
        ("shop.items", 3, "at", "TIMESTAMP_NTZ", None, None),
    ]
    assert scan_table(spark, "spark_catalog", "shop", "items").columns == ["id", "code", "price", "at"]


def plan_inputs(spark, bad=False):
    cols = [("id", "INT", "int", None, None, False, None), ("n", "VOID" if bad else "STRING", "x", None, None, True, 'say "hi"')]
    requests = spark.createDataFrame(
        [("c.s.t", "c", "s", "t", "schema_and_details", False), ("c.s.v", "c", "s", "v", "SCHEMA_AND_DETAILS", True),
         ("c.s.no", "c", "s", "no", "SCHEMA", False)],
        "table_name string, catalog string, schema string, table string, option string, is_view boolean",
    )
    constraints = spark.createDataFrame([("c.s.t", "pk", ["id"])], CONSTRAINTS)
    extra = spark.createDataFrame([("c.s.v", 0, "id", "INT", "int", None, None, True, None)], COLUMN_INVENTORY)
    return inventory(spark, *cols).unionByName(extra), constraints, requests


def test_update_map(spark):
    inv, constraints, requests = plan_inputs(spark)
    plan = reverse_provision_plan(inv, constraints, requests, "form")
    got = {(r["table_name"], r["path"], r["pos"]): r["value_json"] for r in plan.collect()}
    assert {t for t, _, _ in got} == {"c.s.t"} and len(got) == 10
    assert got["c.s.t", "form.tableName", None] == '"t"'
    assert got["c.s.t", "spec.mesh.specific.catalogName", None] == '"c"'
    schema = [v for (_, path, _), v in sorted(got.items(), key=str) if path == "spec.mesh.dataContract.schema"]
    assert schema == [
        '{"name":"id","dataType":"INT","dataLength":null,"constraint":"PRIMARY_KEY","precision":null,'
        '"scale":null,"description":"int","tags":null}',
        '{"name":"n","dataType":"STRING","dataLength":65535,"constraint":null,"precision":null,'
        '"scale":null,"description":"say \\"hi\\"","tags":null}',
    ]
    assert rows(c.update_errors(requests, inv), "table_name", "error") == [
        ("c.s.no", "TABLE_NOT_FOUND"), ("c.s.v", "DETAILS_OF_A_VIEW"),
    ]


def test_one_bad_column_fails_its_table(spark):
    inv, constraints, requests = plan_inputs(spark, bad=True)
    assert reverse_provision_plan(inv, constraints, requests, "form").count() == 0
    problems = contract_problems(inv, constraints).collect()
    assert [(r["table_name"], r["message"]) for r in problems] == [("c.s.t", "UNKNOWN_TYPE VOID")]


def test_update_map_keeps_every_column_of_a_wide_table(spark):
    cols = [(f"c{i:03d}", "INT", "int", None, None, True, None) for i in range(1200)]
    cols.append(cols[7])
    marked = c.mark_primary_key(inventory(spark, *cols), spark.createDataFrame([], CONSTRAINTS))
    requests = spark.createDataFrame(
        [("c.s.t", "c", "s", "t", "SCHEMA_AND_DETAILS", False)],
        "table_name string, catalog string, schema string, table string, option string, is_view boolean",
    )
    plan = c.update_map(c.derive_contract(marked), requests, "form")
    schema = plan.where("path = 'spec.mesh.dataContract.schema'")
    names = sorted(f"c{i:03d}" for i in [*range(1200), 7])
    assert [n for (n,) in rows(schema.select(F.get_json_object("value_json", "$.name")))] == names
    assert plan.where("path LIKE '%Name'").count() == 6


def test_inventory_reads_types_from_the_schema(spark):
    df = spark.sql("SELECT CAST(1 AS DECIMAL(10,4)) AS d, array(1) AS a, INTERVAL '1' DAY AS i, NULL AS n")
    assert rows(column_inventory(spark, {"t": df}), "column_name", "type_name", "type_scale") == [
        ("a", "ARRAY<INT>", None), ("d", "DECIMAL(10,4)", 4), ("i", "INTERVAL DAY", None), ("n", "VOID", None),
    ]


def test_update_map_broadcasts_nothing_that_grows_with_the_tables(spark):
    """Names are compressed in shuffle files to a fraction of the rows that a broadcast holds."""
    inv, constraints, requests = plan_inputs(spark, bad=False)
    plan = reverse_provision_plan(inv, constraints, requests, "form")
    assert plan.count() > 0
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
