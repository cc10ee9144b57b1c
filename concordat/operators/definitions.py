"""Comparing requested definitions with those that exist."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import is_empty
from concordat.operators.access import DEVELOPMENT
from concordat.operators.joins import keyed_join
from concordat.operators.normal_form import comparable


def compare_definitions(
    requested: DataFrame,
    existing: DataFrame,
    settings: Sequence[str],
    empty_settings: Mapping[str, Column] | None = None,
    development: str = DEVELOPMENT,
    salts: int = 1,
) -> DataFrame:
    """Verdict on deploying each requested definition over what has its name.

    ``requested`` has ``name``, ``override``, ``environment`` and the ``settings``
    columns; ``existing`` has ``name``, ``id`` and the same settings.  Only the
    settings are compared: creation time, creator, id and run-as name are set by
    the platform.  ``empty_settings`` gives the value of each setting in an empty
    definition, where ``existing.<setting>`` refers to the existing one.  Settings may be
    nested and hold maps, whose entries have no order.
    """
    body = F.struct("id", *settings)
    found = existing.groupBy("name").agg(
        F.count(F.lit(1)).alias("existing_count"), F.any_value(body).alias("existing")
    )
    joined = keyed_join(requested, found, ["name"], "left", salts)
    count = F.coalesce(F.col("existing_count"), F.lit(0))
    same = F.lit(True)
    types = {setting: requested.schema[setting].dataType for setting in settings}
    for setting, dtype in types.items():
        known = comparable(F.col("existing")[setting].cast(dtype), dtype)
        same = same & comparable(F.col(setting), dtype).eqNullSafe(known)
    is_blank_request = F.lit(empty_settings is not None)
    for setting, value in (empty_settings or {}).items():
        blank = comparable(value.cast(types[setting]), types[setting])
        is_blank_request = is_blank_request & comparable(F.col(setting), types[setting]).eqNullSafe(blank)
    verdict = (
        F.when(is_empty("name"), "ERROR_NO_NAME")
        .when(count == 0, "OK_NEW")
        .when(count > 1, "ERROR_NOT_UNIQUE")
        .when(is_empty(F.col("existing")["id"].cast("string")), "ERROR_EMPTY_ID")
        .when(same, "OK_SAME")
        .when(F.coalesce(F.col("override"), F.lit(False)), "OK_OVERRIDE")
        .when(F.lower("environment") == development.lower(), "ERROR_DIFFERS")
        .when(is_blank_request, "ERROR_EMPTY_REQUEST")
        .otherwise("OK_CHANGED")
    )
    return joined.select(
        *requested.columns,
        count.alias("existing_count"),
        F.when(count == 1, F.col("existing")["id"]).alias("existing_id"),
        verdict.alias("verdict"),
    )
