"""Lookups by name, and the create, update and delete plans built on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import col, is_empty, like_name
from concordat.operators.joins import keyed_join, one_row_per_key


def casefold(c: Column) -> Column:
    return F.lower(c)


def trim_casefold(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+\z", ""))


def exact(c: Column) -> Column:
    return c


def names_like(
    table: DataFrame, name: str, wanted: str, escape: bool = False
) -> DataFrame:
    """Rows whose name is LIKE the wanted one."""
    return table.where(like_name(name, wanted, escape))


def _matches_per_name(existing: DataFrame, name: str, id_col: str) -> DataFrame:
    return existing.groupBy(F.col(name)).agg(
        F.count(F.lit(1)).alias("match_count"), F.max(id_col).alias("id")
    )


def unique_lookup(
    requests: DataFrame,
    existing: DataFrame,
    name: str = "name",
    existing_name: str = "name",
    existing_id: str = "id",
    empty_id_is_error: bool = True,
    salts: int = 1,
    merge: bool = False,
) -> DataFrame:
    """Resolve each requested name that must exist exactly once.

    Adds ``id``, ``match_count`` and ``verdict`` (NOT_FOUND, AMBIGUOUS, EMPTY_ID, OK).
    """
    found = _matches_per_name(existing, existing_name, existing_id).withColumnRenamed(
        existing_name, name
    )
    joined = keyed_join(requests, found, [name], "left", salts, merge=merge)
    count = F.coalesce(F.col("match_count"), F.lit(0))
    no_id = is_empty(F.col("id").cast("string")) if empty_id_is_error else F.lit(False)
    verdict = (
        F.when(count == 0, "NOT_FOUND")
        .when(count > 1, "AMBIGUOUS")
        .when(no_id, "EMPTY_ID")
        .otherwise("OK")
    )
    return joined.withColumns(
        {
            "id": F.when(verdict == "OK", F.col("id")),
            "match_count": count,
            "verdict": verdict,
        }
    )


def first_match_lookup(
    requests: DataFrame,
    directory: DataFrame,
    on: dict[str, str],
    value: str,
    order: Sequence[str | Column],
    normalise: Callable[[Column], Column] = casefold,
    output: str = "id",
    salts: int = 1,
) -> DataFrame:
    """Resolve each request to its first match in listing order, null when there is none.

    ``on`` maps request columns to directory columns; both are normalised.
    Directory rows with an empty key or value never match.
    """
    usable = ~is_empty(F.col(value).cast("string"))
    for column in on.values():
        usable = usable & ~is_empty(column)
    keys = {f"__key_{i}": normalise(F.col(c)) for i, c in enumerate(on.values())}
    first = one_row_per_key(
        directory.where(usable).withColumn("__value", F.col(value)), keys, ["__value"], order
    )
    keyed = requests.withColumns(
        {f"__key_{i}": normalise(F.col(c)) for i, c in enumerate(on)}
    )
    return (
        keyed_join(keyed, first, list(keys), "left", salts)
        .withColumnRenamed("__value", output)
        .drop(*keys)
    )


def upsert_plan(
    requests: DataFrame,
    existing: DataFrame,
    name: str = "name",
    existing_name: str = "name",
    existing_id: str = "id",
    salts: int = 1,
) -> DataFrame:
    """CREATE, UPDATE, ERROR_NOT_UNIQUE or ERROR_EMPTY_ID for each requested name."""
    resolved = unique_lookup(
        requests, existing, name, existing_name, existing_id, True, salts
    )
    action = (
        F.when(F.col("verdict") == "NOT_FOUND", "CREATE")
        .when(F.col("verdict") == "AMBIGUOUS", "ERROR_NOT_UNIQUE")
        .when(F.col("verdict") == "EMPTY_ID", "ERROR_EMPTY_ID")
        .otherwise("UPDATE")
    )
    return resolved.withColumn("action", action).drop("verdict")


def delete_plan(
    requests: DataFrame,
    existing: DataFrame,
    name: str = "name",
    existing_name: str = "name",
    salts: int = 1,
) -> DataFrame:
    """Every existing object that carries a requested name, one row each."""
    wanted = requests.select(F.col(name).alias(existing_name)).distinct()
    return keyed_join(existing, wanted, [existing_name], "left_semi", salts).withColumn(
        "action", F.lit("DELETE")
    )


def last_wins(
    pairs: DataFrame, owner: Sequence[str], key: str, value: str, order: Sequence[str | Column]
) -> DataFrame:
    """One value per owner and key: the last in order, ties broken by the value."""
    ranked = F.struct(
        *[col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("value")
    )
    return (
        pairs.groupBy(*owner, key)
        .agg(F.max(ranked).alias("last"))
        .select(*owner, key, F.col("last")["value"].alias(value))
    )
