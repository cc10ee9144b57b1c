"""End-to-end plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.contracts import DERIVED_SQL
from checks.inputs import derived, table
from checks.registry import query
from concordat.operators.contract import update_errors
from concordat.operators.mappers import mapper
from concordat.plans.access_update import access_update_plan
from concordat.plans.provision import find_workspaces, publish_verdicts
from concordat.plans.reverse_provision import contract_problems, reverse_provision_plan


@query(
    "v5_publish_verdicts",
    """AS_WITH missing AS (SELECT target_view, count(*) AS n FROM {contract_columns} cc
            WHERE NOT EXISTS (SELECT 1 FROM {columns_inv} i
                               WHERE i.table_name = cc.source_table AND i.column_name = cc.name) GROUP BY target_view),
      repeated AS (SELECT DISTINCT target_view FROM (SELECT target_view, name FROM {contract_columns}
                   GROUP BY ALL HAVING count(*) > 1)),
      judged AS (
        SELECT p.*, NOT starts_with(workspace, 'https://') AS is_managed,
               starts_with(workspace, 'https://') OR w.name IS NOT NULL AS workspace_known, m.n,
               CASE WHEN NOT (starts_with(workspace, 'https://') OR w.name IS NOT NULL) THEN 'WORKSPACE_UNKNOWN'
                    WHEN NOT metastore_attached AND NOT starts_with(workspace, 'https://') THEN 'METASTORE_NOT_ATTACHED_YET'
                    WHEN NOT metastore_attached THEN 'METASTORE_MISSING'
                    WHEN source_table NOT IN (SELECT table_name FROM {columns_inv}) THEN
                         CASE WHEN lower(environment) = 'development' THEN 'TABLE_NOT_CREATED_YET' ELSE 'TABLE_NOT_DEPLOYED' END
                    WHEN m.n > 0 THEN 'COLUMNS_MISSING'
                    WHEN r.target_view IS NOT NULL THEN 'COLUMNS_REPEATED' END AS reason
        FROM {publications} p LEFT JOIN {workspaces} w ON p.workspace = w.name
        LEFT JOIN missing m ON m.target_view = p.target_view
        LEFT JOIN repeated r ON r.target_view = p.target_view)
      SELECT target_view, source_table, environment, workspace, metastore_attached, is_managed, workspace_known,
             CASE WHEN reason = 'COLUMNS_MISSING' THEN n ELSE 0 END AS missing_columns, reason,
             CASE WHEN reason IS NULL THEN 'OK'
                  WHEN reason IN ('WORKSPACE_UNKNOWN', 'METASTORE_NOT_ATTACHED_YET') THEN 'OK_WARN' ELSE 'ERROR' END AS verdict
      FROM judged""",
)
def verdicts(spark, sf_dir):
    publications = find_workspaces(
        derived(spark, sf_dir, "publications"), derived(spark, sf_dir, "workspaces")
    )
    return publish_verdicts(
        publications,
        derived(spark, sf_dir, "contract_columns"),
        derived(spark, sf_dir, "columns_inv"),
    )


_MAPPED = """canon AS (SELECT lower(display_name) AS g, count(*) AS n, min(display_name) AS display FROM {groups} GROUP BY 1),
  uses AS (SELECT DISTINCT securable, 'access' AS role, ref FROM {access_requests}
           UNION ALL SELECT securable, 'owner', owner FROM {access_securables}
           UNION ALL SELECT securable, 'dev_group', concat('group:', dev_group) FROM {access_securables}),
  mapped AS (SELECT securable, role,
                    CASE WHEN starts_with(ref, 'user:')
                         THEN regexp_replace(substr(ref, 6), '^(.*)_([^_]*)$', '\\1@\\2')
                         WHEN starts_with(ref, 'group:') AND n = 1 THEN display END AS principal
             FROM uses LEFT JOIN canon ON starts_with(ref, 'group:') AND lower(substr(ref, 7)) = g),
  failing AS (SELECT securable FROM mapped WHERE principal IS NULL
              UNION SELECT securable FROM {access_grants} WHERE principal = ''),
  usable AS (SELECT * FROM mapped WHERE securable NOT IN (SELECT securable FROM failing)),
  wanted AS (SELECT DISTINCT securable, principal FROM usable WHERE role = 'access'),
  kept AS (SELECT * FROM wanted UNION
           SELECT u.securable, principal FROM usable u JOIN {access_securables} s ON u.securable = s.securable
           WHERE role <> 'access' AND lower(environment) = 'development')"""


_PLAN_SQL = f"""AS_WITH {_MAPPED}
      SELECT DISTINCT 'TABLE' AS object_type, securable AS object_name, principal, 'SELECT' AS privilege, 'REVOKE' AS action
      FROM {{access_grants}} WHERE securable IN (SELECT securable FROM usable)
        AND (securable, principal) NOT IN (SELECT (securable, principal) FROM kept)
      UNION ALL
      SELECT *, 'GRANT' FROM (
        SELECT 'TABLE', securable, principal, 'SELECT' FROM wanted
        UNION SELECT 'CATALOG', split_part(securable, '.', 1), principal, 'USE_CATALOG' FROM wanted
        UNION SELECT 'SCHEMA', split_part(securable, '.', 1) || '.' || split_part(securable, '.', 2), principal, 'USE_SCHEMA'
        FROM wanted)"""


@query("access_update_plan", _PLAN_SQL)
def access_plan(spark, sf_dir):
    return access_update_plan(
        derived(spark, sf_dir, "access_requests"),
        derived(spark, sf_dir, "access_securables"),
        derived(spark, sf_dir, "access_grants"),
        derived(spark, sf_dir, "groups"),
    )


@query("access_update_plan_by_batches", _PLAN_SQL)
def access_plan_by_batches(spark, sf_dir):
    """The same plan with a mapper in Python, which is asked for lists of references."""
    spellings: dict[str, list[str]] = {}
    for row in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows at any scale
        if row["n_nationkey"] % 5:
            spellings.setdefault(row["n_name"].lower(), []).append(row["n_name"])
        if row["n_nationkey"] % 7 == 1:
            spellings.setdefault(row["n_name"].lower(), []).append(row["n_name"].lower())

    def of_batch(refs):
        answers = {}
        for ref in refs:
            if ref.startswith("user:"):
                local, at, domain = ref[5:].rpartition("_")
                answers[ref] = f"{local}@{domain}" if at else ref[5:]
            elif ref.startswith("group:"):
                found = spellings.get(ref[6:].lower(), [])
                answers[ref] = found[0] if len(found) == 1 else LookupError(f"{len(found)} groups")
        return answers

    return access_update_plan(
        derived(spark, sf_dir, "access_requests"), derived(spark, sf_dir, "access_securables"),
        derived(spark, sf_dir, "access_grants"), mapper=mapper("batches", of_batch=of_batch),
    )


_JSON = """concat('{"name":"', name, '","dataType":"', data_type, '","dataLength":', coalesce(CAST(data_length AS VARCHAR), 'null'),
   ',"constraint":', coalesce('"' || "constraint" || '"', 'null'), ',"precision":', coalesce(CAST(precision AS VARCHAR), 'null'),
   ',"scale":', coalesce(CAST(scale AS VARCHAR), 'null'), ',"description":"', description, '","tags":null}')"""


@query(
    "k13_update_map",
    f"""AS_WITH {DERIVED_SQL},
      failing AS (SELECT DISTINCT table_name FROM derived_columns WHERE problem IS NOT NULL),
      usable AS (SELECT * FROM {{update_requests}} WHERE table_name NOT IN (SELECT table_name FROM failing)
                   AND table_name IN (SELECT table_name FROM {{columns_inv}})
                   AND NOT (upper(option) = 'SCHEMA_AND_DETAILS' AND is_view)),
      items AS (SELECT table_name, pos, {_JSON} AS value_json FROM derived_columns
                WHERE table_name IN (SELECT table_name FROM usable))
      SELECT table_name, path, pos, value_json
      FROM items, (VALUES ('spec.mesh.dataContract.schema'), ('form.parameters.schemaDefinition.schemaColumns')) p(path)
      UNION ALL
      SELECT table_name, prefix || '.' || key, NULL,
             '"' || CASE key WHEN 'catalogName' THEN catalog WHEN 'schemaName' THEN schema ELSE "table" END || '"'
      FROM usable, (VALUES ('spec.mesh.specific'), ('form.parameters')) a(prefix),
           (VALUES ('catalogName'), ('schemaName'), ('tableName')) k(key)
      WHERE upper(option) = 'SCHEMA_AND_DETAILS'""",
)
def update_map(spark, sf_dir):
    return reverse_provision_plan(
        derived(spark, sf_dir, "columns_inv"),
        derived(spark, sf_dir, "table_constraints"),
        derived(spark, sf_dir, "update_requests"),
        "form.parameters",
    )


@query(
    "k13_update_errors",
    """SELECT table_name, error FROM (
         SELECT table_name, CASE WHEN table_name NOT IN (SELECT table_name FROM {columns_inv}) THEN 'TABLE_NOT_FOUND'
                WHEN upper(option) = 'SCHEMA_AND_DETAILS' AND is_view THEN 'DETAILS_OF_A_VIEW' END AS error
         FROM {update_requests}) WHERE error IS NOT NULL""",
)
def failed_updates(spark, sf_dir):
    return update_errors(
        derived(spark, sf_dir, "update_requests"), derived(spark, sf_dir, "columns_inv")
    ).select("table_name", "error")


@query(
    "a2_contract_problems",
    f"""AS_WITH {DERIVED_SQL},
      counted AS (SELECT table_name, problem AS message, count(*) AS times FROM derived_columns
                  WHERE problem IS NOT NULL GROUP BY ALL)
      SELECT *, CAST(sum(times) OVER (PARTITION BY table_name) AS BIGINT) AS problem_count FROM counted""",
)
def gathered_contract_problems(spark, sf_dir):
    return contract_problems(
        derived(spark, sf_dir, "columns_inv"), derived(spark, sf_dir, "table_constraints")
    )
