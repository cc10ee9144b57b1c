"""Maps from key-value lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.names import col


def last_wins_map(entries: str | Column, key: str = "name", value: str = "value") -> Column:
    """Map of a list of key-value structs; a repeated key keeps its last value, a null list is empty.

    For the short lists inside one definition; ``operators.lookup.last_wins``
    does the same for pairs held as rows.
    """
    newest_first = F.reverse(
        F.coalesce(
            F.transform(col(entries), lambda e: F.struct(e[key].alias("k"), e[value].alias("v"))),
            F.array().cast("array<struct<k:string,v:string>>"),
        )
    )
    keys = F.transform(newest_first, lambda e: e["k"])
    winners = F.filter(newest_first, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.map_from_entries(winners)
