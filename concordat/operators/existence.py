"""Which wanted catalogs, schemas and tables exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.operators.joins import keyed_join


def _flagged(wanted: DataFrame, present: DataFrame, on: list[str], flag: str, salts: int):
    marked = present.distinct().withColumn(flag, F.lit(True))
    return keyed_join(wanted, marked, on, "left", salts).withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def catalog_exists(
    wanted: DataFrame, catalogs: DataFrame, catalog: str = "catalog", salts: int = 1
) -> DataFrame:
    """Adds ``catalog_exists``; names compare without case."""
    present = catalogs.select(F.lower(catalog).alias("__catalog"))
    keyed = wanted.withColumn("__catalog", F.lower(catalog))
    return _flagged(keyed, present, ["__catalog"], "catalog_exists", salts).drop("__catalog")


def schema_exists(
    wanted: DataFrame,
    catalogs: DataFrame,
    schemas: DataFrame,
    catalog: str = "catalog",
    schema: str = "schema",
    salts: int = 1,
) -> DataFrame:
    """Adds ``schema_exists`` and ``error``; asking about a missing catalog is an error."""
    present = schemas.select(
        F.lower(catalog).alias("__catalog"), F.lower(schema).alias("__schema")
    )
    checked = catalog_exists(wanted, catalogs, catalog, salts).withColumns(
        {"__catalog": F.lower(catalog), "__schema": F.lower(schema)}
    )
    flagged = _flagged(checked, present, ["__catalog", "__schema"], "schema_exists", salts)
    return (
        flagged.withColumn("error", F.when(~F.col("catalog_exists"), "CATALOG_NOT_FOUND"))
        .withColumn("schema_exists", F.when(F.col("catalog_exists"), F.col("schema_exists")))
        .drop("__catalog", "__schema", "catalog_exists")
    )


def table_exists(
    wanted: DataFrame,
    tables: DataFrame,
    table: str = "table_name",
    salts: int = 1,
) -> DataFrame:
    """Adds ``table_exists``; full names compare exactly."""
    present = tables.select(table)
    return _flagged(wanted, present, [table], "table_exists", salts)
