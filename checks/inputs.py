"""Input tables of the operators, derived from the given tables.

Each is one SQL text that Spark and DuckDB read alike.  ``{name}`` stands for a
given table or another derived input: a DataFrame in Spark, a CTE in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_MAIL = "concat(replace(lower(c_name), '#', '.'), '@example.com')"

INPUTS: dict[str, str] = {
    # ---- table metadata: an order is a table, a line item one of its columns
    "raw_columns": """
        SELECT concat('cat.sales.t', CAST(l_orderkey AS STRING)) AS table_name,
               l_linenumber AS pos,
               CASE WHEN l_quantity = 13 AND l_suppkey % 10 = 3 THEN ''
                    ELSE concat('c', CAST(l_linenumber AS STRING), '_', CAST(l_partkey % 10 AS STRING))
               END AS column_name,
               CASE WHEN l_partkey % 197 = 0 THEN 'VOID'
                    WHEN l_partkey % 199 = 0 THEN 'INTERVAL DAY TO SECOND'
                    ELSE CASE l_partkey % 23
                         WHEN 0 THEN 'DECIMAL(10,4)' WHEN 1 THEN 'DECIMAL(10,0)'
                         WHEN 2 THEN 'ARRAY<STRING>' WHEN 3 THEN 'MAP<STRING,INT>'
                         WHEN 4 THEN 'STRUCT<A:INT>' WHEN 5 THEN 'VARCHAR(20)'
                         WHEN 6 THEN 'CHAR(3)' WHEN 7 THEN 'TIMESTAMP_NTZ'
                         WHEN 8 THEN 'TIMESTAMP' WHEN 9 THEN 'BIGINT'
                         WHEN 10 THEN 'INT' WHEN 11 THEN 'SMALLINT'
                         WHEN 12 THEN 'TINYINT' WHEN 13 THEN 'LONG'
                         WHEN 14 THEN 'DOUBLE' WHEN 15 THEN 'FLOAT'
                         WHEN 16 THEN 'BOOLEAN' WHEN 17 THEN 'BINARY'
                         WHEN 18 THEN 'DATE' WHEN 19 THEN 'VARIANT'
                         WHEN 20 THEN 'INTERVAL' ELSE 'STRING' END
               END AS type_name,
               CASE WHEN l_partkey % 23 < 2 THEN 10 END AS type_precision,
               CASE l_partkey % 23 WHEN 0 THEN 4 WHEN 1 THEN 0 END AS type_scale,
               CASE l_returnflag WHEN 'N' THEN true WHEN 'R' THEN false END AS nullable,
               CASE WHEN l_linestatus = 'O' THEN concat('line ', CAST(l_linenumber AS STRING))
                    WHEN l_suppkey % 2 = 0 THEN '' END AS comment
        FROM {lineitem}""",
    "columns_inv": """
        SELECT table_name, pos, column_name, type_name, lower(type_name) AS type_text,
               type_precision, type_scale, nullable, comment FROM {raw_columns}""",
    "key_lists": """
        SELECT concat('cat.sales.t', CAST(o_orderkey AS STRING)) AS table_name, 'pk' AS constraint_name,
               concat('c', CAST(o_orderkey % 7 + 1 AS STRING), '_', CAST(o_custkey % 10 AS STRING),
                      ',c', CAST(o_custkey % 7 + 1 AS STRING), '_', CAST(o_orderkey % 10 AS STRING)) AS key_list
        FROM {orders}""",
    "table_constraints": """
        SELECT table_name, constraint_name, split(key_list, ',') AS child_columns FROM {key_lists}""",
    "catalog_columns": """
        SELECT split_part(table_name, '.', 1) AS table_catalog, split_part(table_name, '.', 2) AS table_schema,
               split_part(table_name, '.', 3) AS table_name, column_name, pos + 1 AS ordinal_position,
               type_text AS full_data_type, type_precision AS numeric_precision, type_scale AS numeric_scale,
               CASE WHEN nullable THEN 'YES' WHEN NOT nullable THEN 'NO' END AS is_nullable, comment
        FROM {columns_inv}""",
    "catalog_keys": """
        SELECT 'cat' AS table_catalog, 'sales' AS table_schema, split_part(table_name, '.', 3) AS table_name,
               constraint_name, 'PRIMARY KEY' AS constraint_type, split_part(key_list, ',', 2) AS column_name,
               2 AS ordinal_position FROM {key_lists}
        UNION ALL
        SELECT 'cat', 'sales', split_part(table_name, '.', 3), constraint_name, 'PRIMARY KEY',
               split_part(key_list, ',', 1), 1 FROM {key_lists}
        UNION ALL
        SELECT 'cat', 'sales', split_part(table_name, '.', 3), 'fk', 'FOREIGN KEY',
               split_part(key_list, ',', 1), 1 FROM {key_lists}""",
    "contract_columns": """
        SELECT concat('cat.pub.v', CAST(l_orderkey AS STRING)) AS target_view,
               concat('cat.sales.t', CAST(l_orderkey AS STRING)) AS source_table,
               l_linenumber AS pos,
               CASE WHEN l_partkey % 53 = 0
                    THEN concat('C', CAST(l_linenumber AS STRING), '_', CAST(l_partkey % 10 AS STRING))
                    WHEN l_partkey % 59 = 0 THEN 'extra_column'
                    ELSE concat('c', CAST(l_linenumber AS STRING), '_', CAST(l_partkey % 10 AS STRING))
               END AS name,
               CASE l_partkey % 7 WHEN 0 THEN 'bigint' WHEN 1 THEN 'Varchar' WHEN 2 THEN 'NUMBERS'
                    WHEN 3 THEN 'DECIMAL' WHEN 4 THEN 'JSON' WHEN 5 THEN 'timestamp_ntz'
                    ELSE 'STRING' END AS data_type,
               CASE WHEN l_partkey % 10 = 0 THEN 'PII.Sensitive'
                    WHEN l_partkey % 10 = 1 THEN 'Tier.Gold' END AS tag
        FROM {lineitem}""",
    "publications": """
        SELECT concat('cat.pub.v', CAST(o_orderkey AS STRING)) AS target_view,
               CASE WHEN o_orderkey % 41 = 0 THEN 'cat.sales.absent'
                    ELSE concat('cat.sales.t', CAST(o_orderkey AS STRING)) END AS source_table,
               CASE WHEN o_orderstatus = 'O' THEN 'Development' ELSE 'production' END AS environment,
               CASE WHEN o_custkey % 10 < 2
                    THEN concat('https://adb-', CAST(o_custkey AS STRING), '.7.azuredatabricks.net')
                    ELSE concat('ws_', CAST(o_custkey AS STRING)) END AS workspace,
               o_custkey % 8 <> 0 AS metastore_attached
        FROM {orders}""",
    "workspaces": """
        SELECT concat('ws_', CAST(c_custkey AS STRING)) AS name FROM {customer} WHERE c_custkey % 10 <> 3""",
    "update_requests": """
        SELECT concat('cat.sales.t', CAST(o_orderkey AS STRING)) AS table_name, 'cat' AS catalog,
               'sales' AS schema, concat('t', CAST(o_orderkey AS STRING)) AS table,
               CASE o_orderkey % 3 WHEN 0 THEN 'SCHEMA_AND_DETAILS' WHEN 1 THEN 'schema_and_details'
                    ELSE 'SCHEMA' END AS option,
               o_orderkey % 13 = 0 AS is_view
        FROM {orders}""",
    # ---- references and directories
    "refs": """
        SELECT CASE WHEN c_custkey % 10 < 6
                    THEN concat('user:', replace(lower(c_name), '#', '.'), '_example.com')
                    WHEN c_custkey % 10 < 9 THEN concat('group:', lower(n_name))
                    ELSE concat('invalid:', c_name) END AS ref
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "groups": """
        SELECT n_name AS display_name, n_nationkey AS group_id FROM {nation} WHERE n_nationkey % 5 <> 0
        UNION ALL
        SELECT lower(n_name), n_nationkey + 100 FROM {nation} WHERE n_nationkey % 7 = 1""",
    "directory_users": f"""
        SELECT {_MAIL} AS mail, c_custkey AS id FROM {{customer}} WHERE c_custkey % 9 <> 0
        UNION ALL
        SELECT {_MAIL}, c_custkey + 5 FROM {{customer}} WHERE c_custkey % 4 = 0""",
    "directory_groups": """
        SELECT lower(n_name) AS display_name, CAST(n_nationkey AS BIGINT) AS id FROM {nation}
        WHERE n_nationkey % 5 <> 0""",
    "principals": f"""
        SELECT CASE WHEN c_custkey % 3 = 0 THEN 'group' ELSE 'user' END AS kind,
               CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment
                    WHEN c_custkey % 3 = 1 THEN upper({_MAIL}) ELSE {_MAIL} END AS name,
               c_custkey AS request_id
        FROM {{customer}}""",
    "account_groups": """
        SELECT c_mktsegment AS display_name, min(c_custkey) AS id FROM {customer}
        WHERE c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment""",
    # ---- access
    "current_grants": f"""
        SELECT concat('cat.', lower(c_mktsegment), '.orders_view') AS securable, {_MAIL} AS principal,
               CASE WHEN c_custkey % 4 = 0 THEN 'ALL_PRIVILEGES' ELSE 'SELECT' END AS privilege
        FROM {{customer}} WHERE c_custkey % 3 <> 0""",
    "desired_access": f"""
        SELECT concat('cat.', lower(c_mktsegment), '.orders_view') AS securable, {_MAIL} AS principal
        FROM {{customer}} WHERE c_custkey % 2 = 0""",
    "securables": f"""
        SELECT concat('cat.', lower(c_mktsegment), '.orders_view') AS securable,
               CASE WHEN c_mktsegment < 'G' THEN 'Development' ELSE 'production' END AS environment,
               min(CASE WHEN c_custkey % 6 = 1 THEN {_MAIL} END) AS owner,
               max(CASE WHEN c_custkey % 6 = 5 THEN {_MAIL} END) AS dev_group
        FROM {{customer}} GROUP BY c_mktsegment""",
    "access_requests": """
        SELECT concat('cat.', lower(c_mktsegment), '.n', CAST(c_nationkey AS STRING)) AS securable,
               CASE WHEN c_nationkey % 6 = 5 AND o_orderkey % 10 = 0 THEN concat('invalid:', c_name)
                    WHEN o_orderkey % 5 = 0
                    THEN concat('group:nation_', CAST(c_nationkey - c_nationkey % 5 + 2 AS STRING))
                    ELSE concat('user:', replace(lower(c_name), '#', '.'), '_example.com') END AS ref
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "access_securables": """
        SELECT concat('cat.', lower(c_mktsegment), '.n', CAST(c_nationkey AS STRING)) AS securable,
               CASE WHEN c_mktsegment < 'G' THEN 'DEVELOPMENT' ELSE 'production' END AS environment,
               concat('user:', replace(lower(min(c_name)), '#', '.'), '_example.com') AS owner,
               concat('nation_', CAST(min(c_nationkey - c_nationkey % 5 + 3) AS STRING)) AS dev_group
        FROM {customer} GROUP BY c_mktsegment, c_nationkey""",
    "access_grants": f"""
        SELECT concat('cat.', lower(c_mktsegment), '.n', CAST(c_nationkey AS STRING)) AS securable,
               CASE WHEN c_nationkey % 7 = 3 AND c_custkey % 10 = 1 THEN '' ELSE {_MAIL} END AS principal,
               'SELECT' AS privilege
        FROM {{customer}} WHERE c_custkey % 3 <> 0""",
    "role_assignments": """
        SELECT concat('ws', CAST(l_suppkey AS STRING)) AS resource_name,
               CASE WHEN l_linenumber % 2 = 0
                    THEN concat('/sub/rg/ws', CAST(l_suppkey AS STRING), '/roles/', CAST(l_orderkey AS STRING))
                    ELSE concat('/sub/rg/roles/', CAST(l_orderkey AS STRING)) END AS assignment_id,
               CASE WHEN l_returnflag = 'A' THEN concat('P-', CAST(l_partkey AS STRING))
                    ELSE concat('p-', CAST(l_partkey AS STRING)) END AS principal_id
        FROM {lineitem}""",
    "assignment_requests": """
        SELECT concat('ws', CAST(l_suppkey AS STRING)) AS resource_name,
               concat('p-', CAST(l_partkey AS STRING)) AS principal_id
        FROM {lineitem} WHERE l_orderkey % 3 = 0""",
    # ---- lookups
    "name_requests": """
        SELECT o_orderkey AS request_id,
               concat('CUSTOMER#', lpad(CAST(o_custkey AS STRING), 9, '0')) AS wanted,
               o_orderstatus AS zone
        FROM {orders}""",
    "name_directory": """
        SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name,
               CASE WHEN c_custkey % 2 = 0 THEN 'o' ELSE 'P' END AS zone,
               CASE WHEN c_custkey % 19 = 0 THEN '' ELSE concat('w', CAST(c_custkey AS STRING)) END AS id,
               c_custkey AS seq
        FROM {customer}
        UNION ALL
        SELECT lower(c_name), 'f', concat('again', CAST(c_custkey AS STRING)),
               CASE WHEN c_custkey % 2 = 0 THEN -c_custkey ELSE c_custkey + 1000000000 END
        FROM {customer} WHERE c_custkey % 7 = 0""",
    "padded_requests": """
        SELECT request_id, concat('  ', lower(wanted), chr(9), ' ') AS wanted FROM {name_requests}""",
    "padded_directory": """
        SELECT concat(' ', name, ' ') AS name, id, seq FROM {name_directory}""",
    "unique_requests": """
        SELECT l_orderkey AS request_id, concat('job_', CAST(l_partkey AS STRING)) AS name FROM {lineitem}""",
    "delete_requests": """
        SELECT concat('job_', CAST(l_suppkey AS STRING)) AS name FROM {lineitem}""",
    "unique_existing": """
        SELECT concat('job_', CAST(p_partkey - CASE WHEN p_partkey % 5 = 1 THEN 1 ELSE 0 END AS STRING)) AS name,
               CASE WHEN p_partkey % 11 <> 0 THEN p_partkey END AS id,
               CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS size_setting,
               p_type AS type_setting
        FROM {part}""",
    "requested_definitions": """
        SELECT CASE WHEN p_partkey % 101 = 0 THEN '' ELSE concat('job_', CAST(p_partkey AS STRING)) END AS name,
               CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size END AS size_setting,
               p_type AS type_setting,
               p_partkey % 4 = 0 AS override,
               CASE WHEN p_partkey % 2 = 0 THEN 'DEVELOPMENT' ELSE 'production' END AS environment
        FROM {part}""",
    "wanted_schemas": """
        SELECT l_orderkey AS request_id, concat('CAT_', CAST(l_suppkey AS STRING)) AS catalog,
               concat('Sch_', CAST(l_partkey % 5 AS STRING)) AS schema
        FROM {lineitem}""",
    "catalogs": """
        SELECT concat('cat_', CAST(s_suppkey AS STRING)) AS catalog FROM {supplier} WHERE s_suppkey % 6 <> 0""",
    "catalog_schemas": """
        SELECT concat('cat_', CAST(s_suppkey AS STRING)) AS catalog,
               concat('SCH_', CAST(s_nationkey % 5 AS STRING)) AS schema FROM {supplier}""",
    # ---- workflows
    "tasks": """
        SELECT l_orderkey AS job_id, l_linenumber AS pos, concat('t', CAST(l_linenumber AS STRING)) AS task_key,
               CASE l_partkey % 5 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'job' WHEN 2 THEN 'notebook_warehouse'
                    WHEN 3 THEN 'notebook_compute' END AS ref_type,
               concat('id-', CAST(l_partkey AS STRING)) AS ref_id
        FROM {lineitem}""",
    "source_directory": """
        SELECT CASE p_partkey % 5 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'job' WHEN 2 THEN 'notebook_warehouse'
                    WHEN 3 THEN 'notebook_compute' ELSE 'none' END AS ref_type,
               concat('id-', CAST(p_partkey AS STRING)) AS id,
               CASE WHEN p_partkey % 23 = 0 THEN '' ELSE concat('Object_', CAST(p_partkey AS STRING)) END AS name
        FROM {part} WHERE p_partkey % 29 <> 0""",
    "task_infos": """
        SELECT l_orderkey AS job_id, concat('t', CAST(l_linenumber AS STRING)) AS task_key, l_partkey AS seq,
               CASE l_partkey % 5 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'job' WHEN 2 THEN 'notebook_warehouse'
                    WHEN 3 THEN 'notebook_compute' END AS ref_type,
               CASE WHEN l_partkey % 43 = 0 THEN '' ELSE concat('Object_', CAST(l_partkey AS STRING)) END AS name
        FROM {lineitem} WHERE l_partkey % 3 <> 0""",
    "target_directory": """
        SELECT CASE p_partkey % 5 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'job' WHEN 2 THEN 'notebook_warehouse'
                    WHEN 3 THEN 'notebook_compute' ELSE 'none' END AS ref_type,
               CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 > 1
                    THEN upper(concat('Object_', CAST(p_partkey AS STRING)))
                    ELSE concat('Object_', CAST(p_partkey AS STRING)) END AS name,
               CASE WHEN p_partkey % 41 <> 0 THEN concat('new-', CAST(p_partkey AS STRING)) END AS id
        FROM {part} WHERE p_partkey % 37 <> 0
        UNION ALL
        SELECT CASE p_partkey % 5 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'job' WHEN 2 THEN 'notebook_warehouse'
                    WHEN 3 THEN 'notebook_compute' ELSE 'none' END,
               concat('Object_', CAST(p_partkey AS STRING)), concat('more-', CAST(p_partkey AS STRING))
        FROM {part} WHERE p_partkey % 31 = 0""",
    "rebuild_targets": """
        SELECT ref_type, name, CASE WHEN ref_type = 'job' AND id NOT LIKE 'new-%7'
                                    THEN replace(replace(id, 'new-', ''), 'more-', '') ELSE id END AS id
        FROM {target_directory}""",
    "rebuild_infos": """
        SELECT o_orderkey AS job_id, 'main' AS task_key, 1 AS seq,
               CASE o_custkey % 5 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'job' WHEN 2 THEN 'notebook_warehouse'
                    WHEN 3 THEN 'notebook_compute' END AS ref_type,
               concat('Object_', CAST(o_custkey AS STRING)) AS name
        FROM {orders} WHERE o_orderkey % 6 <> 5""",
    "run_as_definitions": """
        SELECT o_orderkey AS job_id,
               CASE WHEN o_orderkey % 11 = 0 THEN ' '
                    WHEN o_orderkey % 13 = 0 THEN concat('app-missing-', CAST(o_custkey AS STRING))
                    ELSE concat(' APP-', CAST(o_custkey AS STRING)) END AS run_as,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    WHEN o_orderkey % 5 = 0 THEN concat('Principal ', CAST(o_custkey AS STRING))
                    ELSE concat('principal ', CAST(o_custkey AS STRING)) END AS expected_run_as
        FROM {orders}""",
    "service_principals": """
        SELECT concat('app-', CAST(c_custkey AS STRING)) AS application_id,
               CASE WHEN c_custkey % 17 <> 0 THEN concat('Principal ', CAST(c_custkey AS STRING)) END AS display_name,
               c_custkey AS seq
        FROM {customer}""",
    # ---- provisioning: a product per customer
    "product_inventory": """
        SELECT concat('cat.raw.c', CAST(c_custkey AS STRING)) AS table_name, 0 AS pos, 'key' AS column_name
        FROM {customer} WHERE c_custkey % 9 <> 0
        UNION ALL
        SELECT concat('cat.raw.c', CAST(c_custkey AS STRING)), 1, 'note' FROM {customer}
        WHERE c_custkey % 9 <> 0 AND c_custkey % 5 <> 0""",
    "product_workspaces": """
        SELECT concat('ws_', CAST(c_custkey AS STRING)) AS name, c_custkey % 8 <> 0 AS metastore_attached
        FROM {customer} WHERE c_custkey % 10 <> 3""",
    # ---- status log
    "status_log": """
        SELECT user_id AS task_id, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'create' ELSE 'update' END AS op,
               CASE event_type WHEN 'signup' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED'
                    WHEN 'error' THEN 'FAILED' END AS status,
               CASE event_type WHEN 'view' THEN props ELSE '' END AS result,
               CASE event_type WHEN 'click' THEN props END AS info
        FROM {events}""",
    # ---- workflows to take back into their descriptors; a workflow is an order
    "workflow_jobs": """
        SELECT o_orderkey AS job_id, o_orderkey * 1000 AS created_time,
               concat('flow_', CAST(o_orderkey - CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS STRING)) AS name,
               CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE concat('app-', CAST(o_custkey AS STRING)) END AS run_as,
               CASE WHEN o_orderkey % 5 <> 0 THEN concat('user "', o_orderpriority, '"') END AS creator_user_name,
               CASE WHEN o_orderkey % 37 <> 0 THEN concat('[', CAST(o_custkey AS STRING), ']') END AS settings
        FROM {orders}""",
    "workflow_requests": """
        SELECT o_orderkey AS request_id,
               CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN 'flow_none'
                    ELSE concat('flow_', CAST(o_orderkey AS STRING)) END AS name,
               CASE WHEN o_orderkey % 7 <> 0 THEN
                    concat('principal ', CASE WHEN o_orderkey % 31 = 0 THEN 'other' ELSE CAST(o_custkey AS STRING) END)
               END AS expected_run_as
        FROM {orders}""",
    # ---- patterns of names; chr(92) is a backslash, which the two dialects write differently
    "job_names": """
        SELECT c_custkey AS job_id, concat('Customer', CASE c_custkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '%' ELSE '-' END,
               right(concat('00000000', CAST(c_custkey AS STRING)), 9), '_', lower(c_mktsegment)) AS job_name
        FROM {customer}""",
    "name_patterns": """
        SELECT o_orderkey AS request_id, CASE o_orderkey % 8
               WHEN 0 THEN concat('Customer_', digits, '%')
               WHEN 1 THEN concat('%', right(digits, 7), chr(92), '_house%')
               WHEN 2 THEN concat('Customer', chr(92), '%', digits, '_building')
               WHEN 3 THEN concat('%', right(digits, 4), '_m%y')
               WHEN 4 THEN concat('Customer-', digits, '_machinery')
               WHEN 5 THEN CASE WHEN o_custkey % 2 = 0 THEN '%_' ELSE '' END
               WHEN 6 THEN concat('Customer', chr(92), 'd', digits) END AS pattern
        FROM (SELECT o_orderkey, o_custkey, right(concat('00000000', CAST(o_custkey AS STRING)), 9) AS digits FROM {orders})""",
    # ---- nested definitions as JSON, with < and > for braces until they are complete:
    # the same settings in another order, with other stamps, or changed
    "requested_jobs": """
        SELECT request_id, name, override, environment,
               replace(replace(text, '<', chr(123)), '>', chr(125)) AS definition
        FROM (SELECT o_orderkey AS request_id, concat('job_', CAST(o_orderkey AS STRING)) AS name,
                     o_orderkey % 5 = 0 AS override,
                     CASE WHEN o_orderkey % 3 = 0 THEN 'DEVELOPMENT' ELSE 'production' END AS environment,
                     CASE WHEN o_orderkey % 41 = 0 THEN '<unclosed' ELSE
                     concat('<"retries": ', CAST(o_custkey % 4 AS STRING), ', "labels": <"b": "', o_orderstatus,
                            '", "a": 1.50>, "tasks": [<"key": "t1", "seen": ', CAST(o_orderkey AS STRING),
                            '>, <"key": "t2">], "created": 1>') END AS text
              FROM {orders})""",
    "deployed_jobs": """
        SELECT id, name, replace(replace(text, '<', chr(123)), '>', chr(125)) AS definition
        FROM (SELECT CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('id-', CAST(o_orderkey AS STRING)) END AS id,
                     concat('job_', CAST(o_orderkey AS STRING)) AS name,
                     concat('<"tasks": [<"seen": null, "key": "t1">, <"key": "t', CASE WHEN o_orderkey % 13 = 0 THEN '9' ELSE '2' END,
                            '">], "created": 77, "labels": <"a": 1.5, "b": "', o_orderstatus, '">, "owner": <"name": "x">, "retries": ',
                            CAST((o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 4 AS STRING), '>') AS text
              FROM {orders} WHERE o_orderkey % 7 <> 0
              UNION ALL
              SELECT 'again', concat('job_', CAST(o_orderkey AS STRING)), '<>' FROM {orders} WHERE o_orderkey % 19 = 0)""",
    # ---- components
    "components": """
        SELECT (p_partkey - p_partkey % 5) AS product_id, CAST(p_partkey % 5 AS INT) AS pos,
               CASE WHEN p_partkey % 35 = 4 THEN concat('cmp-', CAST(p_partkey - 1 AS STRING))
                    ELSE concat('cmp-', CAST(p_partkey AS STRING)) END AS id,
               CASE p_partkey % 5 WHEN 0 THEN 'outputport' WHEN 1 THEN 'workload' WHEN 2 THEN 'storage'
                    WHEN 3 THEN 'observability' ELSE 'other' END AS kind,
               concat('"urn:template:', CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 > 0 THEN 'view'
                                            ELSE CASE p_size % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'batch-job'
                                                 WHEN 2 THEN 'live-tables' WHEN 3 THEN 'task-graph'
                                                 ELSE 'retired' END END,
                      '":0.0.', CAST(p_partkey % 3 AS STRING)) AS template_id,
               concat('cmp-', CAST(p_partkey + 1 AS STRING), ',cmp-', CAST(p_partkey + 7 AS STRING)) AS depends_list
        FROM {part}""",
    "component_rows": """
        SELECT product_id, pos, id, kind, template_id, split(depends_list, ',') AS depends_on FROM {components}""",
    "clusters": """
        SELECT p_partkey AS cluster_id,
               CASE p_partkey % 4 WHEN 0 THEN 'ENHANCED' WHEN 1 THEN 'LEGACY' WHEN 2 THEN 'FIXED' END AS mode,
               CASE WHEN p_size % 3 = 0 THEN 1 END AS min_workers,
               CASE WHEN p_size % 2 = 0 THEN 8 END AS max_workers,
               CASE WHEN p_size % 5 < 3 THEN 4 END AS num_workers
        FROM {part}""",
}

_PLACE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = INPUTS[name]
    parts = {n: derived(spark, sf_dir, n) for n in set(_PLACE.findall(text))}
    return spark.sql(text, **parts)


def _needed(text: str, found: list[str]) -> None:
    for name in _PLACE.findall(text):
        if name in TABLES or name in found:
            continue
        _needed(INPUTS[name], found)
        if name not in found:
            found.append(name)


def with_inputs(sql: str) -> str:
    """DuckDB text of a query: the derived inputs it names become CTEs before it.

    A query that needs CTEs of its own starts with ``AS_WITH``; they follow the inputs.
    """
    needed: list[str] = []
    _needed(sql, needed)
    body = _PLACE.sub(r"\1", sql).strip()
    own, marker = [], "AS_WITH"
    if body.startswith(marker):
        own, body = [body[len(marker):].strip()], ""
    ctes = [f"{n} AS ({_PLACE.sub(chr(92) + '1', INPUTS[n]).strip()})" for n in needed]
    if not ctes and not own:
        return body
    if own:
        head = ", ".join(ctes)
        return "WITH " + (head + ", " if head else "") + own[0]
    return "WITH " + ", ".join(ctes) + " " + body
