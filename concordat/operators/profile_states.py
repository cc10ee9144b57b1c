"""Profiles that are kept and merged: a state per partition of a table, in place of its rows.

The state of a partition is one row: its number of rows, and for every column the nulls, the
bounds in the column's own type, a sketch of its distinct values and, for numbers, one of its
quantiles.  States merge into the profile of any set of partitions, so after an append only
the new partitions are read.  A state is a few kilobytes a column, whatever its partition holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.names import quote_identifier
from concordat.operators.row_rules import _NUMBERS, _hashable, _ordered

# The sketch of distinct values has 2**12 registers: one standard error is 1.04 / 2**6 of the count.
DISTINCT_BITS = 12
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_BITS / 2)


def _state(name: str, dtype: T.DataType) -> Column:
    value = F.col(quote_identifier(name))
    bound = _ordered(value, dtype)
    parts = {"nulls": F.count_if(value.isNull())}
    if bound is not None:
        parts |= {"low": F.min(bound), "high": F.max(bound)}
    if _hashable(dtype):
        parts["distinct"] = F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(DISTINCT_BITS))
    if isinstance(dtype, _NUMBERS):
        number = value.cast("double")
        parts["ranks"] = F.call_function("kll_sketch_agg_double", F.when(~F.isnan(number), number))
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def partition_states(df: DataFrame, partition: Sequence[str]) -> DataFrame:
    """A row per partition: its ``partition`` columns, ``__rows`` and a state per other column.

    Rows with a null in a partition column form a partition like any other.
    """
    columns = [f for f in df.schema.fields if f.name not in partition]
    return df.groupBy(*[F.col(quote_identifier(p)) for p in partition]).agg(
        F.count(F.lit(1)).alias("__rows"), *[_state(f.name, f.dataType).alias(f.name) for f in columns]
    )


def keep_states(changed: DataFrame, partition: Sequence[str], path: str) -> None:
    """Write the states of the partitions that ``changed`` holds whole; others at ``path`` stay as they are.

    Written again, a partition replaces its state, so a run that is repeated changes nothing.
    """
    states = partition_states(changed, partition)
    states.write.partitionBy(*partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def kept_states(spark: SparkSession, path: str) -> DataFrame:
    """All kept states; a column that came later is null in the states before it."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def _merged(name: str, dtype: T.StructType) -> Column:
    has, state = set(dtype.fieldNames()), F.col(quote_identifier(name))
    # a partition from before the column had it null in every row
    parts = {"nulls": F.sum(F.coalesce(state["nulls"], F.col("__rows")))}
    if "low" in has:
        parts |= {"low": F.min(state["low"]), "high": F.max(state["high"])}
    if "distinct" in has:
        parts["distinct"] = F.hll_union_agg(state["distinct"])
    if "ranks" in has:
        parts["ranks"] = F.call_function("kll_merge_agg_double", state["ranks"])
    return F.struct(*[c.alias(k) for k, c in parts.items()]).alias(name)


def profile_of_states(states: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile of all partitions with a state: a row per column that is no partition column.

    Rows, nulls, smallest and largest value are exact; ``distinct_values`` is an estimate with a
    standard error of ``DISTINCT_ERROR``, ``quantiles`` one per asked fraction of the numbers
    that are not NaN.  What a column's type does not have is null.  No states give no rows.
    """
    columns = [f for f in states.schema.fields if isinstance(f.dataType, T.StructType) and "nulls" in f.dataType.fieldNames()]
    merged = states.groupBy(F.lit(1).alias("__all")).agg(
        F.sum("__rows").alias("__rows"), *[_merged(f.name, f.dataType) for f in columns]
    )
    lines = []
    for f in columns:
        has, state = set(f.dataType.fieldNames()), F.col(quote_identifier(f.name))
        asked = F.array(*[F.lit(float(q)) for q in quantiles])
        filled = F.col("__rows") > state["nulls"]
        lines.append(F.struct(
            F.lit(f.name).alias("column_name"), F.col("__rows").alias("rows"), state["nulls"].alias("nulls"),
            (F.hll_sketch_estimate(state["distinct"]) if "distinct" in has else F.lit(None).cast("long")).alias("distinct_values"),
            (state["low"].cast("string") if "low" in has else F.lit(None).cast("string")).alias("min_value"),
            (state["high"].cast("string") if "high" in has else F.lit(None).cast("string")).alias("max_value"),
            (F.when(filled & (F.call_function("kll_sketch_get_n_double", state["ranks"]) > 0),
                    F.call_function("kll_sketch_get_quantile_double", state["ranks"], asked))
             if "ranks" in has else F.lit(None).cast("array<double>")).alias("quantiles"),
        ))
    return merged.select(F.explode(F.array(*lines)).alias("line")).select("line.*")
