"""References such as ``user:ann_example.com`` and ``group:engineers``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.names import col

# The two reference prefixes, matched case-sensitively.
USER_PREFIX = "user:"
GROUP_PREFIX = "group:"


def reference_kind(ref: str | Column) -> Column:
    """``user``, ``group`` or null for text that is no reference."""
    c = col(ref)
    return F.when(c.startswith(USER_PREFIX), "user").when(c.startswith(GROUP_PREFIX), "group")


def reference_name(ref: str | Column) -> Column:
    """The text after the prefix, null for text that is no reference."""
    c = col(ref)
    return F.when(
        c.startswith(USER_PREFIX), F.substring(c, len(USER_PREFIX) + 1, 2**31 - 1)
    ).when(c.startswith(GROUP_PREFIX), F.substring(c, len(GROUP_PREFIX) + 1, 2**31 - 1))


def user_mail(user: str | Column) -> Column:
    """User name as mail address: the last underscore becomes ``@``."""
    c = col(user)
    domain = F.substring_index(c, "_", -1)
    local = F.left(c, F.length(c) - F.length(domain) - 1)
    return F.when(F.contains(c, F.lit("_")), F.concat(local, F.lit("@"), domain)).otherwise(c)


def group_reference(group: str | Column) -> Column:
    """The group as a reference: the prefix is added unless it is there."""
    c = col(group)
    return F.when(c.startswith(GROUP_PREFIX), c).otherwise(F.concat(F.lit(GROUP_PREFIX), c))
