"""Access reconciliation and permission lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import derived, table
from checks.registry import query
from concordat.functions import permissions as lists
from concordat.operators import access as a

_PROTECTED = """SELECT securable, owner AS principal FROM {securables} WHERE lower(environment) = 'development'
    UNION ALL SELECT securable, dev_group FROM {securables} WHERE lower(environment) = 'development'"""


@query(
    "x1_revoke_set",
    f"""SELECT DISTINCT securable, principal, 'SELECT' AS privilege, 'REVOKE' AS action FROM {{current_grants}}
        WHERE (securable, principal) NOT IN (SELECT (securable, principal) FROM {{desired_access}})
          AND (securable, principal) NOT IN (
              SELECT (securable, principal) FROM ({_PROTECTED}) WHERE principal IS NOT NULL)""",
)
def revoke_set(spark, sf_dir):
    return a.revoke_set(
        derived(spark, sf_dir, "current_grants"),
        derived(spark, sf_dir, "desired_access"),
        derived(spark, sf_dir, "securables"),
    )


def _expanded(source: str) -> str:
    return f"""SELECT 'TABLE' AS object_type, securable AS object_name, principal, privilege FROM {source}
      UNION SELECT 'CATALOG', split_part(securable, '.', 1), principal, 'USE_CATALOG' FROM {source}
      UNION SELECT 'SCHEMA', split_part(securable, '.', 1) || '.' || split_part(securable, '.', 2), principal,
                   'USE_SCHEMA' FROM {source}"""


@query(
    "x2_grant_set",
    f"""AS_WITH wanted AS (SELECT *, 'SELECT' AS privilege FROM {{desired_access}})
      SELECT *, 'GRANT' AS action FROM ({_expanded('wanted')})""",
)
def grant_set(spark, sf_dir):
    return a.grant_set(derived(spark, sf_dir, "desired_access"))


@query(
    "x2_grant_set_missing_only",
    f"""AS_WITH wanted AS (SELECT *, 'SELECT' AS privilege FROM {{desired_access}})
      SELECT *, 'GRANT' AS action FROM ({_expanded('wanted')}) e
      WHERE NOT EXISTS (SELECT 1 FROM {{current_grants}} c WHERE c.securable = e.object_name
                          AND c.principal = e.principal AND c.privilege = e.privilege)""",
)
def grant_set_missing_only(spark, sf_dir):
    current = derived(spark, sf_dir, "current_grants").withColumnRenamed("securable", "object_name")
    return a.grant_set(derived(spark, sf_dir, "desired_access"), current, "missing_only")


_GATE = """gate AS (
    SELECT securable, CAST(sum(bad) AS BIGINT) AS unmapped_references, CAST(sum(blank) AS BIGINT) AS unnamed_principals
    FROM (SELECT securable, CASE WHEN starts_with(ref, 'invalid:') THEN 1 ELSE 0 END AS bad, 0 AS blank
          FROM {access_requests}
          UNION ALL SELECT securable, 0, CASE WHEN principal = '' THEN 1 ELSE 0 END FROM {access_grants})
    GROUP BY securable),
  verdicts AS (SELECT *, CASE WHEN unmapped_references > 0 THEN 'ERROR_UNMAPPED_REFERENCE'
                              WHEN unnamed_principals > 0 THEN 'ERROR_EMPTY_PRINCIPAL' ELSE 'OK' END AS verdict
               FROM gate)"""


def _gate(spark, sf_dir):
    requests = derived(spark, sf_dir, "access_requests").withColumn(
        "error", F.when(F.col("ref").startswith("invalid:"), "NOT_A_REFERENCE")
    )
    return a.gate_verdicts(requests, derived(spark, sf_dir, "access_grants"))


@query("x3_gate_verdicts", f"AS_WITH {_GATE} SELECT * FROM verdicts")
def gate_verdicts(spark, sf_dir):
    return _gate(spark, sf_dir)


@query(
    "x3_passing_requests",
    f"""AS_WITH {_GATE} SELECT * FROM {{access_requests}}
        WHERE securable NOT IN (SELECT securable FROM verdicts WHERE verdict <> 'OK')""",
)
def passing_requests(spark, sf_dir):
    return a.passing_only(derived(spark, sf_dir, "access_requests"), _gate(spark, sf_dir))


@query(
    "x4_configured_grants",
    f"""AS_WITH wanted AS (
          SELECT securable, owner AS principal, 'ALL_PRIVILEGES' AS privilege FROM {{securables}}
          WHERE lower(environment) = 'development' AND owner IS NOT NULL
          UNION ALL SELECT securable, dev_group, 'SELECT' FROM {{securables}}
          WHERE lower(environment) = 'development' AND dev_group IS NOT NULL)
      SELECT *, 'GRANT' AS action FROM ({_expanded('wanted')})""",
)
def configured_grants(spark, sf_dir):
    return a.configured_grants(derived(spark, sf_dir, "securables"), "ALL_PRIVILEGES", "SELECT")


@query(
    "x4_configured_levels",
    """SELECT o_orderkey AS object_id, 'group' AS principal_type, o_orderpriority AS principal,
              'CAN_VIEW' AS permission_level FROM orders""",
)
def configured_levels(spark, sf_dir):
    objects = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("object_id"),
        F.col("o_custkey").cast("string").alias("owner"),
        F.col("o_orderpriority").alias("dev_group"),
    )
    return a.configured_levels(objects, "no_permissions", "can_view")


@query(
    "p5_direct_assignments",
    """SELECT resource_name, assignment_id, principal_id FROM {role_assignments} a
       WHERE contains(assignment_id, resource_name)
         AND (resource_name, lower(principal_id)) IN (
             SELECT (resource_name, lower(principal_id)) FROM {assignment_requests})""",
)
def direct_assignments(spark, sf_dir):
    return a.direct_assignments(
        derived(spark, sf_dir, "role_assignments"), derived(spark, sf_dir, "assignment_requests")
    ).select("resource_name", "assignment_id", "principal_id")


def _listed(spark, sf_dir):
    """A permission list per customer: a user, the nation's group, and the user again for some."""

    def entry(user, group, *levels):
        return F.struct(
            user.cast("string").alias("user_name"), group.cast("string").alias("group_name"),
            F.lit(None).cast("string").alias("service_principal_name"),
            F.array(*levels).cast("array<string>").alias("levels"),
        )

    none = F.lit(None)
    key = F.col("c_custkey")
    own = entry(F.col("c_name"), none, F.lit("CAN_MANAGE"), F.lit("CAN_READ"))
    bare = entry(F.col("c_name"), none)
    group = entry(none, F.concat(F.lit("nation_"), F.col("c_nationkey")), F.lit("CAN_EDIT"))
    entries = F.when(key % 7 == 0, F.array(bare, group)).when(
        key % 3 == 0, F.array(own, group, own)
    ).otherwise(F.array(own, group))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", entries.alias("entries"))


def _shown(requested):
    def one(e):
        return F.concat(
            F.coalesce(e["user_name"], F.lit("-")), F.lit("/"),
            F.coalesce(e["group_name"], F.lit("-")), F.lit("/"), e["permission_level"],
        )

    return F.array_join(F.transform(requested, one), ",")


_OWN = "c_name || '/-/CAN_MANAGE'"
_GROUP = "'-/nation_' || c_nationkey || '/CAN_EDIT'"


@query(
    "k11_first_levels",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL
               WHEN c_custkey % 3 = 0 THEN {_OWN} || ',' || {_GROUP} || ',' || {_OWN}
               ELSE {_OWN} || ',' || {_GROUP} END AS entries, c_custkey % 7 = 0 AS is_error
        FROM customer""",
)
def first_levels(spark, sf_dir):
    listed = _listed(spark, sf_dir)
    return listed.select(
        "c_custkey", _shown(lists.first_levels("entries")).alias("entries"),
        lists.has_entry_without_level("entries").alias("is_error"),
    )


@query(
    "x5_appended_entry",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL
               WHEN c_custkey % 3 = 0 THEN {_OWN} || ',' || {_GROUP} || ',' || {_OWN}
               ELSE {_OWN} || ',' || {_GROUP} END || ',' || c_name || '/-/CAN_RUN' AS entries
        FROM customer""",
)
def appended_entry(spark, sf_dir):
    requested = lists.first_levels("entries")
    return _listed(spark, sf_dir).select(
        "c_custkey",
        _shown(lists.append_entry(requested, "CAN_RUN", user=F.col("c_name"))).alias("entries"),
    )


@query(
    "p6_dropped_principal",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN {_GROUP}
               WHEN c_custkey % 3 = 0 THEN {_OWN} || ',' || {_GROUP} || ',' || {_OWN}
               ELSE {_OWN} || ',' || {_GROUP} END AS entries,
              CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey % 2 <> 0 END AS is_unchanged
        FROM customer""",
)
def dropped_principal(spark, sf_dir):
    """The customer's own entries go where the nation is even; elsewhere nobody is found."""
    user = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("nobody"))
    rows = _listed(spark, sf_dir).withColumn("requested", lists.first_levels("entries"))
    rows = rows.withColumn("left_over", lists.drop_principal("requested", user=user))
    return rows.select(
        "c_custkey", _shown(F.col("left_over")).alias("entries"),
        lists.is_unchanged("requested", "left_over").alias("is_unchanged"),
    )
