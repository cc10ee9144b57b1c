"""Access reconciliation: which grants to revoke, which to give, and when to do neither.

``current`` grants have ``securable``, ``principal`` and ``privilege``; ``desired``
access has ``securable`` and ``principal``; ``securables`` has ``securable``,
``environment``, ``owner`` and ``dev_group``.  A securable is a dotted view name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import is_empty, record
from concordat.operators.joins import keyed_join

# Environment name, privileges and the level that means no entry.
DEVELOPMENT = "development"
READ = "SELECT"
USE_CATALOG = "USE_CATALOG"
USE_SCHEMA = "USE_SCHEMA"
NO_PERMISSIONS = "NO_PERMISSIONS"

_PAIR = ["securable", "principal"]


def _in_development(development: str) -> Column:
    return F.lower("environment") == development.lower()


def _owner_and_group(securables: DataFrame, development: str) -> DataFrame:
    return (
        securables.where(_in_development(development))
        .select("securable", F.explode(F.array("owner", "dev_group")).alias("principal"))
        .where(~is_empty("principal"))
    )


def revoke_set(
    current: DataFrame, desired: DataFrame, securables: DataFrame, development: str = DEVELOPMENT
) -> DataFrame:
    """Principals that lose SELECT: those with any current grant that are not desired.

    In development the owner and the development group keep their access.  Names
    compare with case, and only SELECT is revoked whatever the grant is.
    """
    kept = desired.select(*_PAIR).unionByName(_owner_and_group(securables, development)).distinct()
    return (
        current.select(*_PAIR)
        .distinct()
        .join(kept, _PAIR, "left_anti")
        .select(*_PAIR, F.lit(READ).alias("privilege"), F.lit("REVOKE").alias("action"))
    )


def usage_rows(privilege: Column, view: Column | None = None) -> Column:
    """A grant on a view (``securable``) as an array: itself and the usage grants on its catalog and schema."""
    view = F.col("securable") if view is None else view

    def grant(object_type: str, name: Column, given: Column) -> Column:
        return record(
            object_type=F.lit(object_type), object_name=name, privilege=given, action=F.lit("GRANT")
        )

    return F.array(
        grant("TABLE", view, privilege),
        grant("CATALOG", F.substring_index(view, ".", 1), F.lit(USE_CATALOG)),
        grant("SCHEMA", F.substring_index(view, ".", 2), F.lit(USE_SCHEMA)),
    )


def plan_rows(df: DataFrame, rows: Column) -> DataFrame:
    """The plan rows in an array column beside ``principal``, each once."""
    return (
        df.select("principal", F.explode(rows).alias("r"))
        .select("r.object_type", "r.object_name", "principal", "r.privilege", "r.action")
        .distinct()
    )


def with_usage(grants: DataFrame) -> DataFrame:
    """Each grant on a view with the usage grants on its catalog and schema, every row once."""
    return plan_rows(grants, usage_rows(F.col("privilege")))


def grant_set(
    desired: DataFrame, current_grants: DataFrame | None = None, mode: str = "all"
) -> DataFrame:
    """SELECT with usage for every desired principal, those who have it already too.

    With ``mode="missing_only"`` the rows already in ``current_grants``
    (``object_name``, ``principal``, ``privilege``) are left out.
    """
    grants = with_usage(desired.select(*_PAIR).withColumn("privilege", F.lit(READ)))
    if mode == "all":
        return grants
    if mode != "missing_only" or current_grants is None:
        raise ValueError("mode is 'all', or 'missing_only' with the current grants")
    return grants.join(
        current_grants.distinct(), ["object_name", "principal", "privilege"], "left_anti"
    )


def gate_verdicts(mapped: DataFrame, current: DataFrame) -> DataFrame:
    """Per view: the number of references that failed to map and of grants without principal.

    ``mapped`` has ``securable`` and ``error``.  One failure of either kind stops
    every change of the view.
    """
    failures = mapped.select(
        "securable",
        F.col("error").isNotNull().cast("bigint").alias("unmapped"),
        F.lit(0).cast("bigint").alias("unnamed"),
    ).unionByName(
        current.select(
            "securable",
            F.lit(0).cast("bigint").alias("unmapped"),
            is_empty("principal").cast("bigint").alias("unnamed"),
        )
    )
    counts = failures.groupBy("securable").agg(
        F.sum("unmapped").alias("unmapped_references"),
        F.sum("unnamed").alias("unnamed_principals"),
    )
    verdict = (
        F.when(F.col("unmapped_references") > 0, "ERROR_UNMAPPED_REFERENCE")
        .when(F.col("unnamed_principals") > 0, "ERROR_EMPTY_PRINCIPAL")
        .otherwise("OK")
    )
    return counts.withColumn("verdict", verdict)


def passing_only(rows: DataFrame, verdicts: DataFrame, salts: int = 1) -> DataFrame:
    """Rows of the views whose gate verdict is not an error."""
    failing = verdicts.where(F.col("verdict") != "OK").select("securable")
    return keyed_join(rows, failing, ["securable"], "left_anti", salts)


def configured_grants(
    securables: DataFrame,
    owner_privilege: str,
    developer_privilege: str,
    development: str = DEVELOPMENT,
) -> DataFrame:
    """Configured privileges of owner and development group on new views, in development only."""
    pairs = F.array(
        record(principal=F.col("owner"), privilege=F.lit(owner_privilege)),
        record(principal=F.col("dev_group"), privilege=F.lit(developer_privilege)),
    )
    return with_usage(
        securables.where(_in_development(development))
        .select("securable", F.explode(pairs).alias("p"))
        .select("securable", "p.principal", "p.privilege")
        .where(~is_empty("principal"))
    )


def configured_privilege(principal: str, privilege: str, development: str = DEVELOPMENT) -> Column:
    """The configured privilege of a principal on a new view, null outside development or without principal."""
    return F.when(_in_development(development) & ~is_empty(principal), privilege)


def configured_levels(
    objects: DataFrame, owner_level: str, developer_level: str, object_id: str = "object_id"
) -> DataFrame:
    """Configured levels of owner and development group on jobs or pipelines, in every environment.

    An object without owner or without group has no row for it.
    """
    pairs = F.array(
        record(
            principal_type=F.lit("user"),
            principal=F.col("owner"),
            permission_level=F.lit(owner_level.upper()),
        ),
        record(
            principal_type=F.lit("group"),
            principal=F.col("dev_group"),
            permission_level=F.lit(developer_level.upper()),
        ),
    )
    return (
        objects.select(object_id, F.explode(pairs).alias("p"))
        .select(object_id, "p.principal_type", "p.principal", "p.permission_level")
        .where((F.col("permission_level") != NO_PERMISSIONS) & ~is_empty("principal"))
    )


def direct_assignments(assignments: DataFrame, wanted: DataFrame, salts: int = 1) -> DataFrame:
    """Role assignments made on the resource itself, not inherited from above it.

    Both sides have ``resource_name`` and ``principal_id``.  Principal ids compare
    without case; an assignment is direct when its id contains the resource name.
    """
    key = F.lower("principal_id")
    direct = F.contains(F.col("assignment_id"), F.col("resource_name")) & ~is_empty("principal_id")
    requested = wanted.select("resource_name", key.alias("__principal")).distinct()
    return keyed_join(
        assignments.where(direct).withColumn("__principal", key),
        requested,
        ["resource_name", "__principal"],
        "left_semi",
        salts,
    ).drop("__principal")
