"""Permission lists held as arrays: one row per object, one array entry per principal.

A listed entry has ``user_name``, ``group_name``, ``service_principal_name`` and
``levels``; a requested entry has one ``permission_level`` instead of the levels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.names import col, is_empty


def _entry(user: Column, group: Column, service: Column, level: Column) -> Column:
    return F.struct(
        user.cast("string").alias("user_name"),
        group.cast("string").alias("group_name"),
        service.cast("string").alias("service_principal_name"),
        level.cast("string").alias("permission_level"),
    )


def _or_empty(entries: str | Column) -> Column:
    """An object without a list has an empty one."""
    return F.coalesce(col(entries), F.array())


def has_entry_without_level(entries: str | Column) -> Column:
    return F.exists(
        _or_empty(entries), lambda e: is_empty(F.get(e["levels"], F.lit(0)))
    )


def first_levels(entries: str | Column) -> Column:
    """Requested entries with the first level of each listed entry.

    Null when any entry lacks a level: such a list may not be written back.  A null
    list has no entries.
    """
    listed = _or_empty(entries)
    requested = F.transform(
        listed,
        lambda e: _entry(
            e["user_name"],
            e["group_name"],
            e["service_principal_name"],
            F.get(e["levels"], F.lit(0)),
        ),
    )
    return F.when(~has_entry_without_level(listed), requested)


def append_entry(
    requested: str | Column,
    level: str | Column,
    user: Column | None = None,
    group: Column | None = None,
) -> Column:
    """The list with one more entry at its end; entries already there are kept, equal ones too."""
    none = F.lit(None).cast("string")
    level = F.lit(level) if isinstance(level, str) else level
    new = _entry(none if user is None else user, none if group is None else group, none, level)
    return F.array_append(col(requested), new)


def drop_principal(
    requested: str | Column, user: Column | None = None, group: Column | None = None
) -> Column:
    """The list without the entries of one user or group."""
    if user is None and group is None:
        raise ValueError("name a user or a group")

    def kept(entry: Column) -> Column:
        hit = F.lit(False)
        if user is not None:
            hit = hit | F.coalesce((user != "") & (entry["user_name"] == user), F.lit(False))
        if group is not None:
            hit = hit | F.coalesce((group != "") & (entry["group_name"] == group), F.lit(False))
        return ~hit

    return F.filter(col(requested), kept)


def is_unchanged(before: str | Column, after: str | Column) -> Column:
    return F.size(col(before)) == F.size(col(after))
