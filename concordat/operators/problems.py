"""Gathering every problem of a unit instead of stopping at the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.operators.joins import keyed_join


def gather_problems(problems: DataFrame, unit: Sequence[str], message: str = "message") -> DataFrame:
    """Every problem of each unit: ``message``, how many ``times``, and the unit's ``problem_count``.

    One row per unit and message, whatever their number; nothing of a unit is gathered.
    """
    unit = list(unit)
    counted = problems.groupBy(*unit, message).agg(F.count(F.lit(1)).alias("times"))
    totals = problems.groupBy(*unit).agg(F.count(F.lit(1)).alias("problem_count"))
    return keyed_join(counted, totals, unit, "inner")


def split_by_problems(
    rows: DataFrame, problems: DataFrame, unit: Sequence[str], salts: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Rows of units without any problem, and of units with at least one."""
    unit = list(unit)
    failing = problems.select(*unit).distinct()
    return (
        keyed_join(rows, failing, unit, "left_anti", salts),
        keyed_join(rows, failing, unit, "left_semi", salts),
    )
