import pytest
from helpers import rows

from concordat.plans.provision import find_workspaces, publish_verdicts
from concordat.schemas import COLUMN_INVENTORY

PUBLICATION = (
    "target_view string, source_table string, environment string, workspace string, metastore_attached boolean"
)


@pytest.mark.parametrize(
    "publication, columns, expected",
    [
        (("v", "c.s.t", "development", "known", True), ["id"], ("OK", None, 0)),
        (("v", "c.s.t", "development", "known", True), [], ("OK", None, 0)),
        (("v", "c.s.t", "development", "new", True), ["id"], ("OK_WARN", "WORKSPACE_UNKNOWN", 0)),
        (("v", "c.s.t", "development", "known", False), ["id"], ("OK_WARN", "METASTORE_NOT_ATTACHED_YET", 0)),
        (("v", "c.s.t", "development", "adb-1.2.azuredatabricks.net", None), ["id"], ("ERROR", "METASTORE_MISSING", 0)),
        (("v", "c.s.t", "qa", "https://adb-1.2.azuredatabricks.net", True), ["id"], ("OK", None, 0)),
        (("v", "c.s.none", "Development", "known", True), ["id"], ("ERROR", "TABLE_NOT_CREATED_YET", 0)),
        (("v", "c.s.none", "qa", "known", True), ["id"], ("ERROR", "TABLE_NOT_DEPLOYED", 0)),
        (("v", "c.s.t", "qa", "known", True), ["id", "ID", "extra"], ("ERROR", "COLUMNS_MISSING", 2)),
        (("v", "c.s.t", "qa", "known", True), ["id", "id"], ("ERROR", "COLUMNS_REPEATED", 0)),
    ],
)
def test_verdicts(spark, publication, columns, expected):
    inventory = spark.createDataFrame([("c.s.t", 0, "id", "INT", "int", None, None, True, None)], COLUMN_INVENTORY)
    contract = spark.createDataFrame(
        [("v", publication[1], n) for n in columns], "target_view string, source_table string, name string"
    )
    workspaces = spark.createDataFrame([("known",)], "name string")
    publications = find_workspaces(spark.createDataFrame([publication], PUBLICATION), workspaces)
    got = publish_verdicts(publications, contract, inventory)
    assert rows(got, "verdict", "reason", "missing_columns") == [expected]
    if expected[1] == "COLUMNS_REPEATED":
        lenient = publish_verdicts(publications, contract, inventory, reject_duplicates=False)
        assert rows(lenient, "verdict") == [("OK",)]
