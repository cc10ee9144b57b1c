"""From parsed descriptors to the tables the plans work on.

``products`` is the result of ``parse_descriptors``: ``product``, ``component_id`` and
``errors`` beside the caller's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import is_empty, qualified_name
from concordat.functions.principals import group_reference

# Fields of an output port's own part and the columns they become.
PORT_FIELDS = {
    "catalogName": "catalog_name",
    "schemaName": "schema_name",
    "tableName": "table_name",
    "sqlWarehouseName": "sql_warehouse_name",
    "workspaceOP": "workspace_op",
    "catalogNameOP": "catalog_name_op",
    "schemaNameOP": "schema_name_op",
    "viewNameOP": "view_name_op",
}
OUTPUT_PORT = "outputport"


def _field(name: str, other: str | None = None) -> Column:
    """A text of the component's own part, under its name or the column's; null for any other type."""
    found = F.try_variant_get(F.col("__specific"), f"$.{name}", "variant")
    if other is not None:
        found = F.coalesce(found, F.try_variant_get(F.col("__specific"), f"$.{other}", "variant"))
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def requested_ports(products: DataFrame) -> DataFrame:
    """The output ports that descriptors ask to provision, one row each.

    ``target_view`` and ``source_table`` are qualified names; ``owner`` and ``dev_group`` are
    references; ``schema`` is the contract as it was declared.  ``errors`` names fields of the
    port's own part that are absent, empty or no text.  Descriptors with errors, and those that
    ask for another kind of component, give no row.
    """
    first = F.get(F.filter("product.components", lambda c: c["id"] == F.col("component_id")), F.lit(0))
    # A generated row is computed once, however many of its fields are read later.
    row = F.struct(
        F.col("product.id").alias("product_id"),
        F.col("product.environment").alias("environment"),
        F.col("product.dataProductOwner").alias("owner"),
        group_reference("product.devGroup").alias("dev_group"),
        first.alias("c"),
        F.try_parse_json(first["specific"]).alias("__specific"),
    )
    wanted = products.where(F.col("product").isNotNull()).select(F.explode(F.array(row)).alias("r")).select("r.*")
    own = wanted.where(F.col("c.kind") == OUTPUT_PORT)
    fields = own.withColumns(
        {"workspace": _field("workspace"), "metastore": _field("metastore"),
         **{column: _field(name, column) for name, column in PORT_FIELDS.items()}}
    )
    problems = [F.when(F.col("workspace").isNull(), "missing workspace")]
    problems += [F.when(is_empty(column), F.lit(f"missing {name}")) for name, column in PORT_FIELDS.items()]
    return fields.select(
        "product_id",
        F.col("c.id").alias("component_id"),
        "environment",
        "owner",
        "dev_group",
        "workspace",
        "workspace_op",
        "metastore",
        "sql_warehouse_name",
        qualified_name("catalog_name", "schema_name", "table_name").alias("source_table"),
        qualified_name("catalog_name_op", "schema_name_op", "view_name_op").alias("target_view"),
        F.col("c.description").alias("description"),
        F.col("c.dataContract.schema").alias("schema"),
        F.array_compact(F.array(*problems)).alias("errors"),
    )


def contract_columns(ports: DataFrame) -> DataFrame:
    """The declared columns of ports as rows: one per column, in order."""
    return ports.select(
        "target_view", "source_table", F.posexplode("schema").alias("pos", "c")
    ).select(
        "target_view",
        "source_table",
        "pos",
        F.col("c.name").alias("name"),
        F.col("c.dataType").alias("data_type"),
        F.col("c.dataLength").alias("data_length"),
        F.col("c.constraint").alias("constraint"),
        F.col("c.precision").alias("precision"),
        F.col("c.scale").alias("scale"),
        F.col("c.description").alias("description"),
        F.col("c.tags").alias("tags"),
    )
