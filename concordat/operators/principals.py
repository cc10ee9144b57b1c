"""Mapping references to the names and ids of a directory.

A mapper takes a DataFrame with ``ref`` and gives ``ref``, ``mapped`` and
``error``, exactly one of the last two being set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import is_blank, is_empty
from concordat.functions.principals import reference_kind, reference_name, user_mail
from concordat.operators.joins import keyed_join, one_row_per_key
from concordat.operators.lookup import trim_casefold


def distinct_references(refs: DataFrame, ref: str = "ref") -> DataFrame:
    """Each reference once, so that it is mapped once however often it is used."""
    return refs.select(F.col(ref).alias("ref")).distinct()


def _parsed(refs: DataFrame) -> DataFrame:
    return refs.withColumns({"__kind": reference_kind("ref"), "__name": reference_name("ref")})


def canonical_groups(groups: DataFrame, display_name: str = "display_name") -> DataFrame:
    """One row per group name without case: how many carry it, and its spelling."""
    return groups.groupBy(F.lower(display_name).alias("__group")).agg(
        F.count(F.lit(1)).alias("__groups"), F.min(display_name).alias("__display")
    )


def map_to_names(refs: DataFrame, groups: DataFrame, salts: int = 1) -> DataFrame:
    """Users become mail addresses, groups the one spelling the directory has for them."""
    keyed = _parsed(refs).withColumn(
        "__group", F.when(F.col("__kind") == "group", F.lower("__name"))
    )
    joined = keyed_join(keyed, canonical_groups(groups), ["__group"], "left", salts)
    count = F.coalesce(F.col("__groups"), F.lit(0))
    error = F.when(F.col("__kind").isNull(), "NOT_A_REFERENCE").when(
        F.col("__kind") == "group",
        F.when(count == 0, "GROUP_NOT_FOUND")
        .when(count > 1, "GROUP_NOT_UNIQUE")
        .when(is_empty("__display"), "GROUP_WITHOUT_NAME"),
    )
    mapped = F.when(F.col("__kind") == "user", user_mail("__name")).otherwise(F.col("__display"))
    return joined.select(
        *refs.columns, F.when(error.isNull(), mapped).alias("mapped"), error.alias("error")
    )


def map_to_ids(
    refs: DataFrame,
    users: DataFrame,
    groups: DataFrame,
    order: Sequence[str] = ("id",),
    salts: int = 1,
) -> DataFrame:
    """Users by mail and groups by display name to their object id; the first match counts."""
    entries = users.select(
        F.lit("user").alias("__kind"), F.col("mail").alias("__entry"), "id", *_extra(order)
    ).unionByName(
        groups.select(
            F.lit("group").alias("__kind"),
            F.col("display_name").alias("__entry"),
            "id",
            *_extra(order),
        )
    )
    directory = one_row_per_key(
        entries.withColumn("__id", F.col("id")),
        {"__kind": F.col("__kind"), "__entry": F.col("__entry")},
        ["__id"],
        order,
    )
    keyed = _parsed(refs).withColumn(
        "__entry",
        F.when(F.col("__kind") == "user", user_mail("__name")).otherwise(F.col("__name")),
    )
    joined = keyed_join(keyed, directory, ["__kind", "__entry"], "left", salts)
    error = F.when(F.col("__kind").isNull(), "NOT_A_REFERENCE").when(
        is_empty(F.col("__id").cast("string")),
        F.when(F.col("__kind") == "user", "USER_NOT_FOUND").otherwise("GROUP_NOT_FOUND"),
    )
    return joined.select(
        *refs.columns, F.when(error.isNull(), F.col("__id")).alias("mapped"), error.alias("error")
    )


def _extra(order: Sequence[str]) -> list[str]:
    return [o for o in order if o != "id"]


def workspace_assignments(
    principals: DataFrame,
    users: DataFrame,
    groups: DataFrame,
    order: Sequence[str] = ("id",),
    salts: int = 1,
) -> DataFrame:
    """Account id and workspace permission of principals given as (``kind``, ``name``).

    Names match exactly; users become ADMIN and groups USER.  Of several of a name the first in
    ``order``, columns of both directories, counts; if that one has no id, none is found.
    """
    entries = users.select(
        F.lit("user").alias("kind"), F.col("user_name").alias("name"), F.col("id"), *_extra(order)
    ).unionByName(
        groups.select(
            F.lit("group").alias("kind"), F.col("display_name").alias("name"), F.col("id"), *_extra(order)
        )
    )
    directory = one_row_per_key(
        entries.withColumn("__id", F.col("id")), {"kind": F.col("kind"), "name": F.col("name")}, ["__id"], order
    )
    joined = keyed_join(principals, directory, ["kind", "name"], "left", salts)
    found = ~is_empty(F.col("__id").cast("string"))
    permission = F.when(F.col("kind") == "user", "ADMIN").otherwise("USER")
    return joined.select(
        *principals.columns,
        F.when(found, F.col("__id")).alias("principal_id"),
        F.when(found, permission).alias("permission"),
        F.when(~found, "NOT_FOUND").alias("error"),
    )


def run_as_guard(
    definitions: DataFrame,
    service_principals: DataFrame,
    order: Sequence[str | Column],
    salts: int = 1,
    merge: bool = False,
) -> DataFrame:
    """Verdict on definitions whose ``run_as`` must still be ``expected_run_as``.

    Checked only where both are set.  The display name found for ``run_as`` is
    lowered, the expected name is taken as it is.
    """
    directory = one_row_per_key(
        service_principals.where(~is_empty("application_id")).withColumn(
            "__display", F.col("display_name")
        ),
        {"__application": trim_casefold(F.col("application_id"))},
        ["__display"],
        order,
    )
    keyed = definitions.withColumn("__application", trim_casefold(F.col("run_as")))
    resolved = keyed_join(keyed, directory, ["__application"], "left", salts, merge=merge)
    display = F.col("__display")
    verdict = (
        F.when(is_empty("expected_run_as") | is_blank("run_as"), "OK")
        .when(is_empty(display), "ERROR_UNKNOWN_PRINCIPAL")
        .when(F.lower(display) != F.col("expected_run_as"), "ERROR_RUN_AS_CHANGED")
        .otherwise("OK")
    )
    return resolved.withColumn("verdict", verdict).drop("__application", "__display")
