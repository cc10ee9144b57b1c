"""Deriving and checking contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import derived
from checks.registry import query
from concordat.functions.types import contract_type
from concordat.operators import contract as c
from concordat.operators.problems import gather_problems

# The type map as the SQL of the oracles.
_TYPE_SQL = """CASE WHEN regexp_matches(type_name, '^DECIMAL.*') THEN 'DECIMAL'
     WHEN regexp_matches(type_name, '^ARRAY.*') THEN 'ARRAY'
     WHEN regexp_matches(type_name, '^MAP.*') THEN 'MAP'
     WHEN regexp_matches(type_name, '^STRUCT.*') THEN 'STRUCT'
     WHEN regexp_matches(type_name, '^VARCHAR.*') THEN 'VARCHAR'
     WHEN regexp_matches(type_name, '^CHAR.*') THEN 'CHAR'
     WHEN type_name = 'TIMESTAMP_NTZ' THEN 'TIMESTAMPZ'
     WHEN type_name IN ('BIGINT', 'BINARY', 'BOOLEAN', 'DATE', 'DOUBLE', 'FLOAT', 'INT', 'INTERVAL',
                        'SMALLINT', 'STRING', 'TIMESTAMP', 'TINYINT', 'VARIANT', 'LONG') THEN type_name END"""

MARKED_SQL = """keys AS (SELECT DISTINCT table_name, unnest(child_columns) AS column_name FROM {table_constraints}),
  marked AS (SELECT i.*, k.column_name IS NOT NULL AS is_primary_key
             FROM {columns_inv} i LEFT JOIN keys k
               ON i.table_name = k.table_name AND i.column_name = k.column_name)"""

DERIVED_SQL = MARKED_SQL + f""",
  typed AS (SELECT *, {_TYPE_SQL} AS mapped FROM marked),
  derived_columns AS (
    SELECT table_name, pos, column_name AS name, mapped AS data_type,
           CASE WHEN type_name = 'STRING' THEN 65535 END AS data_length,
           CASE WHEN is_primary_key THEN 'PRIMARY_KEY'
                WHEN nullable IS NULL OR NOT nullable THEN 'NOT_NULL' END AS "constraint",
           CASE WHEN mapped = 'DECIMAL' AND type_precision <> 0 AND type_scale <> 0 THEN type_precision END AS precision,
           CASE WHEN mapped = 'DECIMAL' AND type_precision <> 0 AND type_scale <> 0 THEN type_scale END AS scale,
           CASE WHEN comment IS NULL OR comment = '' THEN type_text ELSE comment END AS description,
           CASE WHEN column_name = '' THEN 'MISSING_NAME_OR_TYPE'
                WHEN mapped IS NULL THEN concat('UNKNOWN_TYPE ', type_name) END AS problem
    FROM typed)"""


@query(
    "k4_type_map",
    f"""SELECT type_name, {_TYPE_SQL} AS data_type, count(*) AS columns
        FROM {{columns_inv}} GROUP BY ALL""",
)
def type_map(spark, sf_dir):
    inventory = derived(spark, sf_dir, "columns_inv")
    mapped = inventory.select("type_name", contract_type("type_name").alias("data_type"))
    return mapped.groupBy("type_name", "data_type").agg(F.count(F.lit(1)).alias("columns"))


@query("k5_derived_contract", f"AS_WITH {DERIVED_SQL} SELECT * FROM derived_columns")
def derived_contract(spark, sf_dir):
    marked = c.mark_primary_key(
        derived(spark, sf_dir, "columns_inv"), derived(spark, sf_dir, "table_constraints")
    )
    return c.derive_contract(marked)


@query(
    "j5_primary_key_mark",
    f"AS_WITH {MARKED_SQL} SELECT table_name, pos, column_name, is_primary_key FROM marked",
)
def primary_key_mark(spark, sf_dir):
    return c.mark_primary_key(
        derived(spark, sf_dir, "columns_inv"), derived(spark, sf_dir, "table_constraints")
    ).select("table_name", "pos", "column_name", "is_primary_key")


@query(
    "k6_unknown_types",
    """SELECT target_view, name, data_type FROM {contract_columns}
       WHERE data_type IN ('NUMBERS', 'timestamp_ntz')""",
)
def unknown_types(spark, sf_dir):
    return c.unknown_types(derived(spark, sf_dir, "contract_columns")).select(
        "target_view", "name", "data_type"
    )


_MISSING_SQL = """SELECT target_view, source_table, pos, name FROM {contract_columns} cc
       WHERE NOT EXISTS (SELECT 1 FROM {columns_inv} i
                          WHERE i.table_name = cc.source_table AND i.column_name = cc.name)"""


@query("j1_missing_columns", _MISSING_SQL)
def missing_columns(spark, sf_dir):
    return c.missing_columns(
        derived(spark, sf_dir, "contract_columns"), derived(spark, sf_dir, "columns_inv"), "source_table"
    ).select("target_view", "source_table", "pos", "name")


@query(
    "a2_gathered_problems",
    f"""AS_WITH missing AS ({_MISSING_SQL}),
        counted AS (SELECT target_view, name, count(*) AS times FROM missing GROUP BY ALL)
        SELECT *, CAST(sum(times) OVER (PARTITION BY target_view) AS BIGINT) AS problem_count FROM counted""",
)
def gathered_problems(spark, sf_dir):
    """All missing columns of each view, as often as the contract names them."""
    return gather_problems(missing_columns(spark, sf_dir), ["target_view"], "name")


@query(
    "q9_repeated_columns",
    """SELECT target_view, name, count(*) AS times FROM {contract_columns}
       GROUP BY ALL HAVING count(*) > 1""",
)
def repeated_columns(spark, sf_dir):
    return c.duplicate_columns(derived(spark, sf_dir, "contract_columns"), "target_view")
