"""Publishing a contract-shaped view of a table, describing it and taking it back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from concordat.functions.names import quote_identifier


@dataclass(frozen=True)
class ViewColumn:
    name: str
    description: str | None = None


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is_blank(value: str | None) -> bool:
    return value is None or not value.strip()


def view_statement(
    source: str,
    target: Sequence[str],
    contract: Sequence[ViewColumn] = (),
    description: str | None = None,
    temporary: bool = False,
) -> str:
    """SQL of the view: the contract's columns in order, or all without a contract.

    ``source`` is a relation as it stands in SQL; blank descriptions are skipped.
    """
    columns, declared = "*", ""
    if contract:
        columns = ", ".join(quote_identifier(c.name) for c in contract)
        declared = " (" + ", ".join(
            quote_identifier(c.name)
            + ("" if _is_blank(c.description) else f" COMMENT {_text(c.description)}")
            for c in contract
        ) + ")"
    comment = "" if _is_blank(description) else f" COMMENT {_text(description)}"
    kind = "TEMPORARY VIEW" if temporary else "VIEW"
    return (
        f"CREATE OR REPLACE {kind} {quote_identifier(*target)}{declared}{comment} "
        f"AS SELECT {columns} FROM {source}"
    )


def publish_view(
    spark: SparkSession,
    source: str,
    target: Sequence[str],
    contract: Sequence[ViewColumn] = (),
    description: str | None = None,
    temporary: bool = False,
) -> None:
    """Create or replace the view, with the descriptions of its columns and itself."""
    spark.sql(view_statement(source, target, contract, description, temporary))


def unpublish_view(spark: SparkSession, target: Sequence[str]) -> bool:
    """Drop the view if it is there; a missing catalog or schema is no error.

    True when there was something to drop.
    """
    *container, _ = target
    if container and not spark.catalog.databaseExists(quote_identifier(*container)):
        return False
    present = spark.catalog.tableExists(quote_identifier(*target))
    spark.sql(f"DROP VIEW IF EXISTS {quote_identifier(*target)}")
    return present


def described_columns(spark: SparkSession, target: Sequence[str]) -> list[tuple[str, str | None]]:
    """The column descriptions a view carries."""
    schema = spark.table(quote_identifier(*target)).schema
    return [(f.name, f.metadata.get("comment")) for f in schema.fields]
