"""Tables and their columns.

``column_inventory`` takes tables that are open already and lists their schemas on the driver.
For a whole estate nothing is opened: ``database_inventory`` asks the session's catalog in one
call, ``inventory_from_catalog`` takes the catalog's own table of columns, and
``footers.folder_inventory`` reads the files' footers in the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.names import quote_identifier
from concordat.schemas import COLUMN_INVENTORY
from concordat.sources.stores import carried


def scan_table(spark: SparkSession, *name: str) -> DataFrame:
    """A table by its (one- to three-part) name, every part quoted."""
    return spark.read.table(quote_identifier(*name))


def scan_files(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _type_text(field: T.StructField) -> str:
    """CHAR and VARCHAR are strings with their declaration kept in the metadata."""
    return field.metadata.get("__CHAR_VARCHAR_TYPE_STRING") or field.dataType.simpleString()


def inventory_rows(table: str, schema: T.StructType) -> list[tuple]:
    rows = []
    for pos, field in enumerate(schema.fields):
        decimal = field.dataType if isinstance(field.dataType, T.DecimalType) else None
        rows.append(
            (
                table,
                pos,
                field.name,
                _type_text(field).upper(),
                _type_text(field),
                decimal.precision if decimal else None,
                decimal.scale if decimal else None,
                field.nullable,
                field.metadata.get("comment"),
            )
        )
    return rows


def column_inventory(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The columns of the given tables as rows."""
    rows = [row for name, df in tables.items() for row in inventory_rows(name, df.schema)]
    return spark.createDataFrame(rows, COLUMN_INVENTORY)


def _full_name() -> Column:
    return F.concat_ws(".", "table_catalog", "table_schema", "table_name")


def inventory_from_catalog(columns: DataFrame) -> DataFrame:
    """The inventory of a whole estate from its catalog's own table of columns.

    ``columns`` is laid out as ``information_schema.columns``: the three parts of the table's
    name, ``column_name``, ``ordinal_position`` (from 1), ``full_data_type``,
    ``numeric_precision``, ``numeric_scale``, ``is_nullable`` (YES, NO or null) and ``comment``.
    Nothing is listed by the driver and no table is opened.
    """
    return columns.select(
        _full_name().alias("table_name"),
        (F.col("ordinal_position") - 1).cast("int").alias("pos"),
        "column_name",
        F.upper("full_data_type").alias("type_name"),
        F.col("full_data_type").alias("type_text"),
        F.col("numeric_precision").cast("int").alias("type_precision"),
        F.col("numeric_scale").cast("int").alias("type_scale"),
        (F.upper("is_nullable") == "YES").alias("nullable"),
        "comment",
    )


def keys_from_catalog(usage: DataFrame, constraint_type: str = "PRIMARY KEY") -> DataFrame:
    """Key constraints (``table_name``, ``constraint_name``, ``child_columns``) in key order.

    ``usage`` has a row per column of a constraint, as the catalog's key columns joined with
    its constraints: the table's name in parts, ``constraint_name``, ``constraint_type``,
    ``column_name`` and ``ordinal_position``.  A key has no more columns than its table.
    """
    placed = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name")))
    return (
        usage.where(F.col("constraint_type") == constraint_type)
        .groupBy(_full_name().alias("table_name"), "constraint_name")
        .agg(placed.alias("placed"))
        .select("table_name", "constraint_name", F.col("placed.column_name").alias("child_columns"))
    )


def database_inventory(spark: SparkSession, database: str) -> DataFrame:
    """The columns of every table and view of a database of the session's catalog.

    The catalog answers for all of them in one call and none is opened; the driver sees one
    text per table and executors turn it into rows.
    """
    catalog = spark._jsparkSession.sessionState().catalog()
    listed = catalog.getTablesByName(catalog.listTables(database, "*", False))
    found = [listed.apply(i) for i in range(listed.size())]
    texts = [(f"{database}.{t.identifier().table()}", t.schema().json()) for t in found]
    schemas = spark.createDataFrame(texts, "table_name string, schema_json string")
    return schemas.mapInPandas(_from_schema_texts(), COLUMN_INVENTORY)


def _from_schema_texts():
    carried(__name__)

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                row for name, text in zip(frame["table_name"], frame["schema_json"])
                for row in inventory_rows(name, T.StructType.fromJson(json.loads(text)))
            ]
            yield pd.DataFrame(rows, columns=COLUMN_INVENTORY.names, dtype=object)

    return convert
