"""Lookups by name, existence checks and the plans built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import derived, table
from checks.registry import query
from concordat.operators import lookup
from concordat.operators.definitions import compare_definitions
from concordat.operators.existence import catalog_exists, schema_exists, table_exists
from concordat.operators.normal_form import compare_nested
from concordat.operators.patterns import match_patterns, pattern_verdicts


@query(
    "p2_catalog_exists",
    """SELECT request_id, catalog, lower(catalog) IN (SELECT lower(catalog) FROM {catalogs}) AS catalog_exists
       FROM {wanted_schemas}""",
)
def p2_catalog(spark, sf_dir):
    wanted = derived(spark, sf_dir, "wanted_schemas").select("request_id", "catalog")
    return catalog_exists(wanted, derived(spark, sf_dir, "catalogs"))


@query(
    "p2_schema_exists",
    """SELECT request_id, catalog, schema,
              CASE WHEN known THEN EXISTS (SELECT 1 FROM {catalog_schemas} s
                   WHERE lower(s.catalog) = lower(w.catalog) AND lower(s.schema) = lower(w.schema)) END AS schema_exists,
              CASE WHEN NOT known THEN 'CATALOG_NOT_FOUND' END AS error
       FROM (SELECT *, lower(catalog) IN (SELECT lower(catalog) FROM {catalogs}) AS known
             FROM {wanted_schemas}) w""",
)
def p2_schema(spark, sf_dir):
    return schema_exists(
        derived(spark, sf_dir, "wanted_schemas"),
        derived(spark, sf_dir, "catalogs"),
        derived(spark, sf_dir, "catalog_schemas"),
    )


@query(
    "p2_table_exists",
    """SELECT target_view, source_table,
              source_table IN (SELECT table_name FROM {columns_inv}) AS table_exists FROM {publications}""",
)
def p2_table(spark, sf_dir):
    return table_exists(
        derived(spark, sf_dir, "publications").select("target_view", "source_table"),
        derived(spark, sf_dir, "columns_inv").select(F.col("table_name").alias("source_table")),
        "source_table",
    )


@query("p7_names_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%_ing'")
def names_like(spark, sf_dir):
    return lookup.names_like(table(spark, sf_dir, "part"), "p_name", "%_ing").select("p_partkey", "p_name")


@query(
    "p7_names_like_escaped",
    "SELECT request_id, name FROM {unique_requests} WHERE name = 'job_1'",
)
def names_like_escaped(spark, sf_dir):
    """With escaping the underscore of the name matches only itself."""
    return lookup.names_like(derived(spark, sf_dir, "unique_requests"), "name", "job_1", escape=True)


@query(
    "p7_patterns_matched",
    """SELECT request_id, pattern, job_id, job_name FROM {name_patterns} p JOIN {job_names} n
         ON CASE WHEN request_id % 8 IN (6, 7) THEN false
                 ELSE job_name LIKE pattern ESCAPE chr(92) END""",
)
def patterns_matched(spark, sf_dir):
    """All patterns against all names at once."""
    return match_patterns(
        derived(spark, sf_dir, "job_names"), derived(spark, sf_dir, "name_patterns"), "job_name", wildcards=True
    )


@query(
    "p7_pattern_verdicts",
    """SELECT request_id, pattern, CASE WHEN request_id % 8 = 6 THEN 'MALFORMED' WHEN request_id % 8 = 7 THEN 'EMPTY'
              WHEN pattern = '%_' THEN 'NO_LITERAL' ELSE 'OK' END AS verdict
       FROM {name_patterns}""",
)
def patterns_judged(spark, sf_dir):
    return pattern_verdicts(derived(spark, sf_dir, "name_patterns"))


_FOUND = """found AS (SELECT name, count(*) AS match_count, max(id) AS id FROM {unique_existing} GROUP BY name),
    joined AS (SELECT r.*, coalesce(match_count, 0) AS match_count, f.id
               FROM {unique_requests} r LEFT JOIN found f ON r.name = f.name)"""


@query(
    "j2_unique_lookup",
    f"""AS_WITH {_FOUND}
      SELECT request_id, name, match_count, CASE WHEN match_count = 1 THEN id END AS id,
             CASE WHEN match_count = 0 THEN 'NOT_FOUND' WHEN match_count > 1 THEN 'AMBIGUOUS'
                  WHEN id IS NULL THEN 'EMPTY_ID' ELSE 'OK' END AS verdict
      FROM joined""",
)
def unique_lookup(spark, sf_dir):
    return lookup.unique_lookup(
        derived(spark, sf_dir, "unique_requests"), derived(spark, sf_dir, "unique_existing")
    )


@query(
    "j3_first_match",
    """AS_WITH firsts AS (SELECT lower(name) AS k, arg_min(id, seq) AS id FROM {name_directory}
                    WHERE id <> '' GROUP BY lower(name))
      SELECT request_id, wanted, zone, f.id FROM {name_requests} r LEFT JOIN firsts f ON lower(wanted) = f.k""",
)
def first_match(spark, sf_dir):
    return lookup.first_match_lookup(
        derived(spark, sf_dir, "name_requests"), derived(spark, sf_dir, "name_directory"),
        {"wanted": "name"}, "id", ["seq"],
    )


@query(
    "j3_first_match_two_keys",
    """AS_WITH firsts AS (SELECT lower(name) AS k, lower(zone) AS z, arg_min(id, seq) AS id FROM {name_directory}
                    WHERE id <> '' GROUP BY ALL)
      SELECT request_id, wanted, zone, f.id FROM {name_requests} r
        LEFT JOIN firsts f ON lower(wanted) = f.k AND lower(r.zone) = f.z""",
)
def first_match_two_keys(spark, sf_dir):
    return lookup.first_match_lookup(
        derived(spark, sf_dir, "name_requests"), derived(spark, sf_dir, "name_directory"),
        {"wanted": "name", "zone": "zone"}, "id", ["seq"],
    )


@query(
    "j4_trimmed_match",
    """AS_WITH firsts AS (SELECT lower(trim(name)) AS k, arg_min(id, seq) AS id FROM {padded_directory}
                    WHERE id <> '' GROUP BY ALL)
      SELECT request_id, wanted, f.id FROM {padded_requests} r
        LEFT JOIN firsts f ON lower(regexp_replace(wanted, '^\\s+|\\s+$', '', 'g')) = f.k""",
)
def trimmed_match(spark, sf_dir):
    return lookup.first_match_lookup(
        derived(spark, sf_dir, "padded_requests"), derived(spark, sf_dir, "padded_directory"),
        {"wanted": "name"}, "id", ["seq"], lookup.trim_casefold,
    )


@query(
    "a1_upsert_plan",
    """AS_WITH found AS (SELECT name, count(*) AS match_count, max(id) AS id FROM {unique_existing} GROUP BY name)
      SELECT r.name, coalesce(match_count, 0) AS match_count, CASE WHEN match_count = 1 THEN id END AS id,
             CASE WHEN match_count IS NULL THEN 'CREATE' WHEN match_count > 1 THEN 'ERROR_NOT_UNIQUE'
                  WHEN id IS NULL THEN 'ERROR_EMPTY_ID' ELSE 'UPDATE' END AS action
      FROM (SELECT DISTINCT name FROM {unique_requests}) r LEFT JOIN found f ON r.name = f.name""",
)
def upsert_plan(spark, sf_dir):
    return lookup.upsert_plan(
        derived(spark, sf_dir, "unique_requests").select("name").distinct(),
        derived(spark, sf_dir, "unique_existing"),
    )


@query(
    "a4_delete_plan",
    """SELECT name, id, 'DELETE' AS action FROM {unique_existing}
       WHERE name IN (SELECT name FROM {delete_requests})""",
)
def delete_plan(spark, sf_dir):
    return lookup.delete_plan(
        derived(spark, sf_dir, "delete_requests"),
        derived(spark, sf_dir, "unique_existing").select("name", "id"),
    )


@query(
    "v6_definition_compare",
    """AS_WITH found AS (SELECT name, count(*) AS n, min(id) AS id, min(size_setting) AS old_size,
                          min(type_setting) AS old_type FROM {unique_existing} GROUP BY name)
      SELECT r.*, coalesce(n, 0) AS existing_count, CASE WHEN n = 1 THEN id END AS existing_id,
             CASE WHEN r.name = '' THEN 'ERROR_NO_NAME' WHEN n IS NULL THEN 'OK_NEW'
                  WHEN n > 1 THEN 'ERROR_NOT_UNIQUE' WHEN id IS NULL THEN 'ERROR_EMPTY_ID'
                  WHEN size_setting = old_size AND type_setting = old_type THEN 'OK_SAME'
                  WHEN override THEN 'OK_OVERRIDE' WHEN lower(environment) = 'development' THEN 'ERROR_DIFFERS'
                  WHEN size_setting = 0 THEN 'ERROR_EMPTY_REQUEST' ELSE 'OK_CHANGED' END AS verdict
      FROM {requested_definitions} r LEFT JOIN found f ON r.name = f.name""",
)
def definition_compare(spark, sf_dir):
    return compare_definitions(
        derived(spark, sf_dir, "requested_definitions"),
        derived(spark, sf_dir, "unique_existing"),
        ["size_setting", "type_setting"],
        {"size_setting": F.lit(0), "type_setting": F.col("existing.type_setting")},
    )


@query(
    "v6_nested_definition_compare",
    """AS_WITH found AS (SELECT name, count(*) AS n, min(id) AS id FROM {deployed_jobs} GROUP BY name)
      SELECT request_id, r.name, coalesce(n, 0) AS existing_count, CASE WHEN n = 1 THEN id END AS existing_id,
             CASE WHEN request_id % 41 = 0 THEN 'ERROR_UNREADABLE' WHEN n IS NULL THEN 'OK_NEW'
                  WHEN n > 1 THEN 'ERROR_NOT_UNIQUE' WHEN id = '' THEN 'ERROR_EMPTY_ID'
                  WHEN id <> 'again' AND request_id % 13 <> 0 AND request_id % 11 <> 0 THEN 'OK_SAME'
                  WHEN override THEN 'OK_OVERRIDE' WHEN environment = 'DEVELOPMENT' THEN 'ERROR_DIFFERS'
                  ELSE 'OK_CHANGED' END AS verdict
      FROM {requested_jobs} r LEFT JOIN found f ON r.name = f.name""",
)
def nested_definition_compare(spark, sf_dir):
    """Jobs whose fields come in any order; stamps of the platform are no part of the comparison."""
    return compare_nested(
        derived(spark, sf_dir, "requested_jobs"), derived(spark, sf_dir, "deployed_jobs"),
        ignored=["created", "owner", "tasks[*].seen"],
    ).select("request_id", "name", "existing_count", "existing_id", "verdict")


@query(
    "k9_last_wins",
    """SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY ALL""",
)
def last_wins(spark, sf_dir):
    return lookup.last_wins(table(spark, sf_dir, "events"), ["user_id"], "event_type", "props", ["event_id"])
