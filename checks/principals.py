"""References, groups and directory ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import derived
from checks.registry import query
from concordat.functions.principals import (
    group_reference,
    reference_kind,
    reference_name,
    user_mail,
)
from concordat.operators import principals as p

_MAIL_SQL = "regexp_replace(substr(ref, 6), '^(.*)_([^_]*)$', '\\1@\\2')"


@query("a3_distinct_references", "SELECT DISTINCT ref FROM {refs}")
def distinct_references(spark, sf_dir):
    return p.distinct_references(derived(spark, sf_dir, "refs"))


@query(
    "k1_reference_parse",
    """SELECT ref, CASE WHEN starts_with(ref, 'user:') THEN 'user'
                        WHEN starts_with(ref, 'group:') THEN 'group' END AS kind,
              CASE WHEN starts_with(ref, 'user:') THEN substr(ref, 6)
                   WHEN starts_with(ref, 'group:') THEN substr(ref, 7) END AS name
       FROM {refs}""",
)
def reference_parse(spark, sf_dir):
    return derived(spark, sf_dir, "refs").select(
        "ref", reference_kind("ref").alias("kind"), reference_name("ref").alias("name")
    )


@query(
    "k2_user_mail",
    f"SELECT ref, {_MAIL_SQL} AS mail FROM {{refs}} WHERE starts_with(ref, 'user:')",
)
def mail(spark, sf_dir):
    users = derived(spark, sf_dir, "refs").where(reference_kind("ref") == "user")
    return users.select("ref", user_mail(reference_name("ref")).alias("mail"))


@query(
    "k3_group_reference",
    """SELECT ref, CASE WHEN starts_with(ref, 'group:') THEN ref ELSE concat('group:', ref) END AS group_ref
       FROM {refs}""",
)
def prefixed_group(spark, sf_dir):
    return derived(spark, sf_dir, "refs").select("ref", group_reference("ref").alias("group_ref"))


@query(
    "j6_names_of_references",
    f"""AS_WITH canon AS (SELECT lower(display_name) AS g, count(*) AS n, min(display_name) AS display
                    FROM {{groups}} GROUP BY 1),
      joined AS (SELECT ref, n, display FROM (SELECT DISTINCT ref FROM {{refs}}) r
                 LEFT JOIN canon ON starts_with(ref, 'group:') AND lower(substr(ref, 7)) = g)
      SELECT ref,
             CASE WHEN starts_with(ref, 'user:') THEN {_MAIL_SQL} WHEN n = 1 THEN display END AS mapped,
             CASE WHEN starts_with(ref, 'user:') THEN NULL
                  WHEN NOT starts_with(ref, 'group:') THEN 'NOT_A_REFERENCE'
                  WHEN n IS NULL THEN 'GROUP_NOT_FOUND' WHEN n > 1 THEN 'GROUP_NOT_UNIQUE' END AS error
      FROM joined""",
)
def names_of_references(spark, sf_dir):
    refs = p.distinct_references(derived(spark, sf_dir, "refs"))
    return p.map_to_names(refs, derived(spark, sf_dir, "groups"))


@query(
    "j7_ids_of_references",
    f"""AS_WITH users AS (SELECT mail, min(id) AS id FROM {{directory_users}} GROUP BY mail),
      grps AS (SELECT display_name, min(id) AS id FROM {{directory_groups}} GROUP BY display_name),
      joined AS (SELECT ref, coalesce(u.id, g.id) AS id
                 FROM (SELECT DISTINCT ref FROM {{refs}}) r
                 LEFT JOIN users u ON starts_with(ref, 'user:') AND {_MAIL_SQL} = u.mail
                 LEFT JOIN grps g ON starts_with(ref, 'group:') AND substr(ref, 7) = g.display_name)
      SELECT ref, id AS mapped,
             CASE WHEN starts_with(ref, 'user:') THEN CASE WHEN id IS NULL THEN 'USER_NOT_FOUND' END
                  WHEN starts_with(ref, 'group:') THEN CASE WHEN id IS NULL THEN 'GROUP_NOT_FOUND' END
                  ELSE 'NOT_A_REFERENCE' END AS error
      FROM joined""",
)
def ids_of_references(spark, sf_dir):
    refs = p.distinct_references(derived(spark, sf_dir, "refs"))
    return p.map_to_ids(
        refs, derived(spark, sf_dir, "directory_users"), derived(spark, sf_dir, "directory_groups")
    )


@query(
    "j10_workspace_assignments",
    """AS_WITH entries AS (SELECT 'user' AS kind, mail AS name, min(id) AS id FROM {directory_users} GROUP BY mail
                     UNION ALL SELECT 'group', display_name, id FROM {account_groups})
      SELECT p.kind, p.name, request_id, e.id AS principal_id,
             CASE WHEN e.id IS NOT NULL THEN CASE p.kind WHEN 'user' THEN 'ADMIN' ELSE 'USER' END END AS permission,
             CASE WHEN e.id IS NULL THEN 'NOT_FOUND' END AS error
      FROM {principals} p LEFT JOIN entries e ON p.kind = e.kind AND p.name = e.name""",
)
def workspace_assignments(spark, sf_dir):
    users = derived(spark, sf_dir, "directory_users").withColumnRenamed("mail", "user_name")
    return p.workspace_assignments(
        derived(spark, sf_dir, "principals"), users, derived(spark, sf_dir, "account_groups")
    )


@query(
    "v7_run_as_guard",
    """SELECT job_id, run_as, expected_run_as,
              CASE WHEN expected_run_as IS NULL OR trim(run_as) = '' THEN 'OK'
                   WHEN display_name IS NULL THEN 'ERROR_UNKNOWN_PRINCIPAL'
                   WHEN lower(display_name) <> expected_run_as THEN 'ERROR_RUN_AS_CHANGED' ELSE 'OK' END AS verdict
       FROM {run_as_definitions} LEFT JOIN {service_principals} ON lower(trim(run_as)) = application_id""",
)
def run_as_guard(spark, sf_dir):
    return p.run_as_guard(
        derived(spark, sf_dir, "run_as_definitions"),
        derived(spark, sf_dir, "service_principals"),
        [F.col("seq")],
    )
