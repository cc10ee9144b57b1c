"""Joins of a large table against a table with one row per key.

No operator hints a broadcast: the optimiser and adaptive execution broadcast a
side only when its size is under ``spark.sql.autoBroadcastJoinThreshold`` and
shuffle both sides beyond it.

In a shuffle join one key may hold a large part of the fact rows.  Adaptive
execution splits such a partition, but only where both sides come straight from a
shuffle made for this join.  A directory that was just aggregated by the join key
is not: it would be used as it lies, and the hot partition would stay whole.  The
join therefore also compares a hash of the key.  That costs one more shuffle of
the directory, one row per key, and lets every hot fact partition be split.  The hash
comes first: a sort goes by a number of 64 bits then, where names that begin alike would
be compared in full.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import col

_HASH = "__key_hash"
_SALT = "__salt"


def _hashable(type_text: str) -> bool:
    return "map<" not in type_text and "variant" not in type_text


def keyed_join(
    facts: DataFrame,
    directory: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salts: int = 1,
    unique_facts: bool = False,
    merge: bool = False,
) -> DataFrame:
    """Join ``facts`` with ``directory``, which has at most one row per key.

    Only a join that filters may have more: there a repeated key changes nothing.

    ``how`` keeps the fact side whole or filters it: ``inner``, ``left``,
    ``left_semi`` or ``left_anti``.  ``unique_facts`` says that the facts have one
    row per key as well, so that no key can be hot and both sides may be used as
    they lie.  ``salts`` above 1 spreads the rows of each key over so many
    partitions without adaptive execution, repeating every directory row as often.
    ``merge`` is for directories that grow with the facts: they are never broadcast, not even
    while their shuffle files, many times smaller than their rows, are under the threshold.
    """
    on = list(on)
    if merge:
        directory = directory.hint("merge")
    if unique_facts:
        return facts.join(directory, on, how)
    if salts > 1:
        # A hash of the row keeps the salt the same when a lost task is run again.
        spread = [c for c, t in facts.dtypes if c not in on and _hashable(t)]
        salt = F.pmod(F.xxhash64(*(spread or on)), F.lit(salts))
        every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        salted = facts.withColumn(_SALT, salt)
        return salted.join(directory.withColumn(_SALT, every_salt), [*on, _SALT], how).drop(_SALT)
    key_hash = F.xxhash64(*on)
    # A null key matches nothing; its rows would all meet in one partition, so they are dealt by the whole row.
    others = [c for c, t in facts.dtypes if c in on or _hashable(t)]
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    return (
        facts.withColumn(_HASH, F.when(has_null, F.xxhash64(*[F.col(f"`{c}`") for c in others])).otherwise(key_hash))
        .join(directory.withColumn(_HASH, key_hash), [_HASH, *on], how)
        .drop(_HASH)
    )


def one_row_per_key(
    table: DataFrame,
    keys: Mapping[str, Column],
    values: Sequence[str],
    order: Sequence[str | Column],
) -> DataFrame:
    """The first row per key in the given order, by an aggregate that combines before the shuffle.

    Nulls come last in the order.  Ties are broken by the values, so the result
    never depends on the order in which rows arrive.
    """
    ranks = [c for o in order for c in (col(o).isNull(), col(o))]
    ranked = F.struct(
        *[rank.alias(f"o{i}") for i, rank in enumerate(ranks)], *[F.col(v) for v in values]
    )
    return (
        table.groupBy(*[expr.alias(name) for name, expr in keys.items()])
        .agg(F.min(ranked).alias("first"))
        .select(*keys, *[F.col("first")[v].alias(v) for v in values])
    )
