"""From requested references to the grants and revokes of every view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import is_empty, record
from concordat.functions.principals import group_reference
from concordat.operators.access import DEVELOPMENT, READ, plan_rows, usage_rows
from concordat.operators.joins import keyed_join
from concordat.operators.mappers import Mapper, names_in


def mapped_requests(
    requests: DataFrame, securables: DataFrame, groups: DataFrame | None, salts: int = 1, mapper: Mapper | None = None
) -> DataFrame:
    """Every reference a view needs (``role`` access, owner or dev_group) with its mapping.

    ``mapper`` maps them; the default one takes names from ``groups``.  It maps a user by an
    expression, so only references to groups meet the directory.
    """
    roles = F.array(
        record(role=F.lit("owner"), ref=F.col("owner")),
        record(role=F.lit("dev_group"), ref=group_reference("dev_group")),
    )
    uses = (
        requests.select("securable", F.lit("access").alias("role"), "ref")
        .distinct()
        .unionByName(
            securables.select("securable", F.explode(roles).alias("r")).select("securable", "r.*")
        )
    )
    # A missing reference is one that cannot be mapped.  The joins imply the filter;
    # stated here it is the same in every branch, so the uses are shuffled once.
    uses = uses.withColumn("ref", F.coalesce("ref", F.lit(""))).where(
        F.col("securable").isNotNull()
    )
    return (mapper or names_in(groups, salts))(uses)


# What is known of a view and a principal, as bits of one number.
_WANTED, _ENTITLED, _HELD, _BROKEN = 1, 2, 4, 8


def _has(bit: int) -> Column:
    return F.col("claims").bitwiseAND(F.lit(bit)) != 0


def _claims(mapped: DataFrame, current: DataFrame) -> DataFrame:
    """One row per view and principal with everything claimed of them."""
    from_references = (
        F.when(F.col("error").isNotNull(), F.lit(_BROKEN))
        .when(F.col("role") == "access", F.lit(_WANTED))
        .otherwise(F.lit(_ENTITLED))
    )
    from_grants = F.when(is_empty("principal"), F.lit(_BROKEN)).otherwise(F.lit(_HELD))
    rows = mapped.select(
        "securable", F.col("mapped").alias("principal"), from_references.alias("claims")
    ).unionByName(current.select("securable", "principal", from_grants.alias("claims")))
    return rows.groupBy("securable", "principal").agg(F.bit_or("claims").alias("claims"))


def access_update_plan(
    requests: DataFrame,
    securables: DataFrame,
    current: DataFrame,
    groups: DataFrame | None = None,
    development: str = DEVELOPMENT,
    salts: int = 1,
    mapper: Mapper | None = None,
) -> DataFrame:
    """Plan rows (``object_type``, ``object_name``, ``principal``, ``privilege``, ``action``).

    ``requests`` has ``securable`` and ``ref``; ``securables`` has one row per view
    with owner and development group as references.  A view with any reference
    that cannot be mapped, or any current grant without principal, is left as it
    is, and so is a view that ``securables`` does not list.  References are mapped to names by
    ``groups``, or by a ``mapper`` (see ``operators.mappers``).

    References and grants meet in one aggregate by view and principal; what blocks
    a view is an aggregate of that, and comes back to the pairs in one join.
    """
    pairs = _claims(mapped_requests(requests, securables, groups, salts, mapper), current)
    blocked = pairs.groupBy("securable").agg(F.max(_has(_BROKEN)).alias("blocked"))
    open_views = keyed_join(
        blocked, securables.select("securable", "environment"), ["securable"], "inner", unique_facts=True
    ).where(~F.col("blocked"))
    in_development = F.lower("environment") == development.lower()
    judged = keyed_join(pairs, open_views, ["securable"], "inner", salts)
    keeps = _has(_WANTED) | (_has(_ENTITLED) & in_development)
    revoke = record(
        object_type=F.lit("TABLE"),
        object_name=F.col("securable"),
        privilege=F.lit(READ),
        action=F.lit("REVOKE"),
    )
    none = F.filter(F.array(revoke), lambda row: F.lit(False))
    changes = F.concat(
        F.when(_has(_HELD) & ~keeps, F.array(revoke)).otherwise(none),
        F.when(_has(_WANTED), usage_rows(F.lit(READ))).otherwise(none),
    )
    return plan_rows(judged, changes)
