"""Checking data rows against the contract declared for them (an extension)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.names import quote_identifier
from concordat.functions.types import CASTABLE_TYPES


@dataclass(frozen=True)
class ColumnRule:
    """The part of a contract column that says something about values."""

    name: str
    data_type: str | None = None
    constraint: str | None = None
    data_length: int | None = None
    precision: int | None = None
    scale: int | None = None


_WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")

# What text must start with to be read as a whole number: a cast that fails costs
# far more than this test, so text that cannot pass is not cast at all.
_NUMBER_START = r"^[\x00-\x20\x7f]*[+\-0-9]"


def _uncastable(value: Column, dtype: T.DataType | None, spark_type: str) -> Column:
    unfit = value.try_cast(spark_type).isNull()
    if isinstance(dtype, T.StringType) and spark_type in _WHOLE_NUMBERS:
        unfit = ~value.rlike(_NUMBER_START) | unfit
    return value.isNotNull() & unfit


# A decimal of up to this many digits has an exact shortest form as a double.
_EXACT_DIGITS = 15


def _unfit_decimal(value: Column, dtype: T.DataType | None, precision: int, scale: int) -> Column:
    """The value rounds to more digits before the point than the declaration has.

    Numbers are compared with the smallest magnitude that rounds up to too many
    digits, which costs far less than a cast that fails; NaN compares as larger.
    """
    plain = isinstance(
        dtype, (T.DoubleType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    )
    if not plain or precision + 1 > _EXACT_DIGITS:
        return value.isNotNull() & value.try_cast(f"decimal({precision},{scale})").isNull()
    too_large = Decimal(10) ** (precision - scale) - Decimal(5) / Decimal(10) ** (scale + 1)
    return value.isNotNull() & (F.abs(value.cast("double")) >= F.lit(float(too_large)))


def rule_conditions(
    rules: Sequence[ColumnRule], schema: T.StructType | None = None
) -> list[tuple[str, str, Column]]:
    """(column, rule, condition that a value breaks it) for everything the contract declares.

    With the schema of the data at hand cheaper conditions are chosen where the
    type of the column allows.
    """
    types = {f.name.lower(): f.dataType for f in schema.fields} if schema else {}
    conditions = []
    for rule in rules:
        value = F.col(quote_identifier(rule.name))
        dtype = types.get(rule.name.lower())
        if rule.constraint in ("NOT_NULL", "PRIMARY_KEY"):
            conditions.append((rule.name, "NOT_NULL", value.isNull()))
        if rule.data_length is not None:
            too_long = F.length(value) > rule.data_length
            conditions.append((rule.name, "MAX_LENGTH", F.coalesce(too_long, F.lit(False))))
        if rule.precision is not None and rule.scale is not None:
            unfit = _unfit_decimal(value, dtype, rule.precision, rule.scale)
            conditions.append((rule.name, "DECIMAL_FIT", unfit))
        castable = CASTABLE_TYPES.get((rule.data_type or "").upper())
        if castable:
            conditions.append((rule.name, "CASTABLE", _uncastable(value, dtype, castable)))
    return conditions


def count_violations(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Violations per column and rule in one pass over the columns that have rules."""
    conditions = rule_conditions(rules, df.schema)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c).alias(f"v{i}") for i, (_, _, c) in enumerate(conditions)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(rule).alias("rule"),
                F.col(f"v{i}").alias("violations"),
            )
            for i, (name, rule, _) in enumerate(conditions)
        ]
    )
    return counts.select("rows", F.explode(lines).alias("line")).select(
        "line.column_name", "line.rule", "line.violations", "rows"
    )


def violating_rows(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """The rows that break any rule, with the rules they break."""
    broken = [F.when(c, F.lit(f"{name} {rule}")) for name, rule, c in rule_conditions(rules, df.schema)]
    marked = df.withColumn("violations", F.array_compact(F.array(*broken)))
    return marked.where(F.size("violations") > 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values carried by more than one row; keys with a null part are no duplicates."""
    named = [F.col(f"`{key}`") for key in keys]
    complete = df
    for key in named:
        complete = complete.where(key.isNotNull())
    return complete.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _ordered(value: Column, dtype: T.DataType) -> Column | None:
    """The value as it is compared for bounds; None for types without bounds."""
    if isinstance(dtype, _TIMES):
        return value.cast("timestamp_ntz")
    if isinstance(dtype, (*_NUMBERS, T.StringType, T.BooleanType)):
        return value
    return None


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows, nulls, distinct values, smallest and largest value of every column.

    Rows, nulls and bounds come from one aggregate over one scan; numbers are compared as
    numbers.  Arrays, structs, binaries and the like have no bounds, maps no distinct values
    either.  The exact form counts distinct values by 128 bits of hash of each value, so long
    texts never travel and a frequent value is one row per task ahead of the shuffle.  The
    other form estimates them in the same scan.  A table without rows has 0 rows and no bounds.
    """
    fields = df.schema.fields
    if not fields:
        raise ValueError("no columns")
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        value = F.col(quote_identifier(field.name))
        bound = _ordered(value, field.dataType)
        nothing = F.lit(None).cast("string")
        countable = not exact and _hashable(field.dataType)
        aggregates.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.count_if(value.isNull()).alias("nulls"),
                (F.approx_count_distinct(F.when(value.isNotNull(), F.xxhash64(value))) if countable else F.lit(None).cast("long")).alias("estimate"),
                (nothing if bound is None else F.min(bound).cast("string")).alias("min_value"),
                (nothing if bound is None else F.max(bound).cast("string")).alias("max_value"),
            ).alias(f"c{i}")
        )
    lines = df.agg(*aggregates).select(
        "rows", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(fields))])).alias("c")
    ).select("c.column_name", "rows", "c.nulls", "c.estimate", "c.min_value", "c.max_value")
    if not exact:
        return lines.withColumnRenamed("estimate", "distinct_values")
    hashable = [f.name for f in fields if _hashable(f.dataType)]
    found = _distinct_values(df, hashable)
    known = F.when(F.col("column_name").isin(hashable), F.coalesce("distinct_values", F.lit(0)))
    return lines.join(found, "column_name", "left").select(
        "column_name", "rows", "nulls", known.alias("distinct_values"), "min_value", "max_value"
    )


def _hashable(dtype: T.DataType) -> bool:
    return "map<" not in dtype.simpleString() and not isinstance(dtype, (T.NullType, T.VariantType))


def _distinct_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exact numbers of distinct values, nulls not counted."""
    # Places instead of names: a key of fixed width is hashed without leaving generated code.
    cells = []
    for i, name in enumerate(names):
        value = F.col(quote_identifier(name))
        cell = F.struct(F.lit(i).alias("place"), F.xxhash64(value).alias("h"), F.xxhash64(F.lit(1), value).alias("g"))
        cells.append(F.when(value.isNotNull(), cell))
    each = df.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").select("c.*")
    counts = each.groupBy("place", "h", "g").count().groupBy("place").agg(F.count(F.lit(1)).alias("distinct_values"))
    placed = F.array(*[F.lit(name) for name in names]) if names else F.array().cast("array<string>")
    return counts.select(F.get(placed, F.col("place")).alias("column_name"), "distinct_values")


def freshness(df: DataFrame, ts: str, as_of: str | Column, limit: str) -> DataFrame:
    """Newest timestamp of a table and whether it is within ``limit`` of ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    newest = F.max(F.col(ts).cast("timestamp_ntz"))
    return df.agg(newest.alias("newest")).select(
        "newest",
        F.coalesce(F.col("newest") >= now - F.expr(f"INTERVAL {limit}"), F.lit(False)).alias("is_fresh"),
    )
