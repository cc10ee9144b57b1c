"""Contracts: deriving them from tables, checking them, projecting data by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import col, is_empty, quote_identifier, record
from concordat.functions.types import STRING_LENGTH, contract_type, is_contract_type
from concordat.operators.joins import keyed_join

# Where the derived schema and the table details go in a descriptor.
SCHEMA_PATH = "spec.mesh.dataContract.schema"
DETAILS_PREFIX = "spec.mesh.specific"
WITH_DETAILS = "SCHEMA_AND_DETAILS"


def contract_projection(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Only the contract's columns in contract order; without any, every column."""
    if not columns:
        return df
    return df.select(*[F.col(quote_identifier(c)) for c in columns])


def missing_columns(
    contract: DataFrame,
    inventory: DataFrame,
    table: str = "table_name",
    name: str = "name",
    salts: int = 1,
) -> DataFrame:
    """Contract columns absent from their source table; names are compared as data, with case."""
    present = inventory.select(F.col("table_name").alias(table), F.col("column_name").alias(name))
    return keyed_join(contract, present, [table, name], "left_anti", salts)


def duplicate_columns(
    contract: DataFrame, table: str = "table_name", name: str = "name"
) -> DataFrame:
    """Names a contract lists more than once; a view cannot be created from them."""
    return (
        contract.groupBy(table, name)
        .agg(F.count(F.lit(1)).alias("times"))
        .where(F.col("times") > 1)
    )


def unknown_types(contract: DataFrame, data_type: str = "data_type") -> DataFrame:
    """Contract columns whose declared type is not a contract type."""
    return contract.where(~F.coalesce(is_contract_type(data_type), F.lit(False)))


def mark_primary_key(
    inventory: DataFrame, constraints: DataFrame, salts: int = 1, merge: bool = False
) -> DataFrame:
    """Adds ``is_primary_key``: the column is in any primary-key constraint of its table."""
    keys = (
        constraints.select("table_name", F.explode("child_columns").alias("column_name"))
        .distinct()
        .withColumn("is_primary_key", F.lit(True))
    )
    return keyed_join(inventory, keys, ["table_name", "column_name"], "left", salts, merge=merge).withColumn(
        "is_primary_key", F.coalesce(F.col("is_primary_key"), F.lit(False))
    )


def derive_contract(marked: DataFrame, strict_decimals: bool = False) -> DataFrame:
    """Contract column of each inventory row, or the problem that prevents one.

    Precision and scale are recorded only when both are non-zero; with
    ``strict_decimals`` a decimal without fraction digits keeps them as well.
    Unknown nullability counts as NOT_NULL.
    """
    mapped = contract_type("type_name")
    precision, scale = F.col("type_precision"), F.col("type_scale")
    if strict_decimals:
        has_digits = precision.isNotNull() & scale.isNotNull()
    else:
        has_digits = (precision != 0) & (scale != 0)
    has_digits = (mapped == "DECIMAL") & has_digits
    comment = F.when(~is_empty("comment"), F.col("comment")).otherwise(F.col("type_text"))
    constraint = F.when(F.col("is_primary_key"), "PRIMARY_KEY").when(
        ~F.coalesce(F.col("nullable"), F.lit(False)), "NOT_NULL"
    )
    return marked.select(
        "table_name",
        "pos",
        F.col("column_name").alias("name"),
        mapped.alias("data_type"),
        F.when(F.col("type_name") == "STRING", F.lit(STRING_LENGTH)).alias("data_length"),
        constraint.alias("constraint"),
        F.when(has_digits, precision).alias("precision"),
        F.when(has_digits, scale).alias("scale"),
        comment.alias("description"),
        contract_problem().alias("problem"),
    )


def contract_problem() -> Column:
    """What prevents a contract column of an inventory row; null when nothing does."""
    incomplete = is_empty("column_name") | is_empty("type_name")
    return F.when(incomplete, "MISSING_NAME_OR_TYPE").when(
        contract_type("type_name").isNull(), F.concat(F.lit("UNKNOWN_TYPE "), F.col("type_name"))
    )


# Contract columns in a descriptor: field of the descriptor, column of the derived rows.
_JSON_FIELDS = {
    "name": "name",
    "dataType": "data_type",
    "dataLength": "data_length",
    "constraint": "constraint",
    "precision": "precision",
    "scale": "scale",
    "description": "description",
}


def _column_json(item: Column) -> Column:
    """One derived column as JSON.  Fields that are null are written out."""
    fields = {key: item[source] for key, source in _JSON_FIELDS.items()}
    return F.to_json(
        record(**fields, tags=F.lit(None).cast("string")), {"ignoreNullFields": "false"}
    )


def update_map(derived: DataFrame, requests: DataFrame, form_prefix: str) -> DataFrame:
    """Descriptor updates (``table_name``, ``path``, ``pos``, ``value_json``).

    ``derived`` are the rows of ``derive_contract``; a table with a problem in any
    of its columns gets no update.  ``requests`` has one row per table:
    ``table_name``, ``catalog``, ``schema``, ``table``, ``option`` and ``is_view``.
    The derived schema goes under two paths, one row per column: the value of such a
    path is the list of its rows in the order of ``pos``.  The table details go under
    six more when the option asks for them, with a null ``pos``.  ``form_prefix`` is
    the root of the form parameters in the caller's portal.  Views asked for details
    are left out (see ``update_errors``).
    """
    usable = usable_requests(derived, requests)
    rows = keyed_join(derived, usable.select("table_name"), ["table_name"], "left_semi", merge=True)
    return updates_of(rows, usable, form_prefix)


def usable_requests(problems: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests of tables none of whose columns has a ``problem``, but for the details of views."""
    sound = (
        problems.groupBy("table_name").agg(F.max(F.col("problem").isNotNull()).alias("__bad"))
        .where(~F.col("__bad")).select("table_name")
    )
    return keyed_join(
        requests.where(_update_error().isNull()), sound, ["table_name"], "left_semi", unique_facts=True, merge=True
    )


def updates_of(derived: DataFrame, usable: DataFrame, form_prefix: str) -> DataFrame:
    """The updates of ``update_map`` from the derived rows of usable requests' tables alone."""
    paths = F.array(F.lit(SCHEMA_PATH), F.lit(f"{form_prefix}.schemaDefinition.schemaColumns"))
    item = F.struct(*_JSON_FIELDS.values())
    schema_updates = derived.select("table_name", "pos", _column_json(item).alias("value_json")).select(
        "table_name", F.explode(paths).alias("path"), "pos", "value_json"
    )
    details = F.array(
        *[
            record(path=F.lit(f"{prefix}.{key}"), value_json=_json_text(F.col(source)))
            for prefix in (DETAILS_PREFIX, form_prefix)
            for key, source in (
                ("catalogName", "catalog"),
                ("schemaName", "schema"),
                ("tableName", "table"),
            )
        ]
    )
    detail_updates = (
        usable.where(F.upper("option") == WITH_DETAILS).select("table_name", F.explode(details).alias("u"))
        .select("table_name", "u.path", F.lit(None).cast(derived.schema["pos"].dataType).alias("pos"), "u.value_json")
    )
    return schema_updates.unionByName(detail_updates)


def _json_text(value: Column) -> Column:
    """A string as JSON text: the value part of a one-field object."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)


def _update_error() -> Column:
    return F.when(
        (F.upper("option") == WITH_DETAILS) & F.coalesce(F.col("is_view"), F.lit(False)),
        "DETAILS_OF_A_VIEW",
    )


def update_errors(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Requests for tables that do not exist, and for the details of views."""
    known = inventory.select("table_name").distinct().withColumn("__known", F.lit(True))
    checked = keyed_join(requests, known, ["table_name"], "left", unique_facts=True)
    error = F.when(F.col("__known").isNull(), "TABLE_NOT_FOUND").otherwise(_update_error())
    return checked.withColumn("error", error).where(F.col("error").isNotNull()).drop("__known")


def as_problem(rows: DataFrame, unit: Sequence[str], message: str | Column) -> DataFrame:
    return rows.select(*unit, col(message).alias("message"))
