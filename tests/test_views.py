import pytest
from helpers import rows

from concordat.sources.views import (
    ViewColumn,
    described_columns,
    publish_view,
    unpublish_view,
    view_statement,
)


@pytest.fixture
def source(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS dev_schema")
    spark.sql("CREATE DATABASE IF NOT EXISTS prod_schema")
    spark.sql("DROP TABLE IF EXISTS dev_schema.input_table")
    spark.sql("CREATE TABLE dev_schema.input_table USING parquet AS SELECT 1 AS id, 'v' AS value, 'n' AS notes, 2 AS more")
    return "`spark_catalog`.`dev_schema`.`input_table`"


TARGET = ["spark_catalog", "prod_schema", "output_view"]


def test_publish_replace_and_unpublish(spark, source):
    contract = [ViewColumn("value", "it's the value"), ViewColumn("id", "  "), ViewColumn("notes")]
    publish_view(spark, source, TARGET, contract, "The team's \\ view")
    assert spark.table("prod_schema.output_view").columns == ["value", "id", "notes"]
    assert described_columns(spark, TARGET) == [("value", "it's the value"), ("id", None), ("notes", None)]
    described = [t.description for t in spark.catalog.listTables("prod_schema") if t.name == "output_view"]
    assert described == ["The team's \\ view"]

    publish_view(spark, source, TARGET)
    assert rows(spark.table("prod_schema.output_view")) == [(1, "v", "n", 2)]

    assert unpublish_view(spark, TARGET) is True
    assert not spark.catalog.tableExists("prod_schema.output_view")
    assert unpublish_view(spark, TARGET) is False


def test_unpublish_from_a_missing_schema_succeeds(spark):
    assert unpublish_view(spark, ["spark_catalog", "no_such_schema", "v"]) is False


def test_statement_quotes_names():
    sql = view_statement("`c`.`s`.`t`", ["c", "s", "odd`name"], [ViewColumn("a b")])
    assert sql == "CREATE OR REPLACE VIEW `c`.`s`.`odd``name` (`a b`) AS SELECT `a b` FROM `c`.`s`.`t`"
