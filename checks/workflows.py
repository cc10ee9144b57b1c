"""Task references: captured in one estate, rewritten for another."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import derived, table
from checks.registry import query
from concordat.operators import workflows as w
from concordat.plans.reverse_provision import judge_workflow_requests, workflow_updates


@query(
    "j8_captured_references",
    """SELECT job_id, pos, task_key, t.ref_type,
              CASE WHEN t.ref_type IN ('pipeline', 'job') THEN ref_id END AS referenced_id,
              CASE WHEN t.ref_type IN ('pipeline', 'job') THEN name END AS referenced_name,
              CASE WHEN t.ref_type NOT IN ('pipeline', 'job') THEN ref_id END AS cluster_id,
              CASE WHEN t.ref_type NOT IN ('pipeline', 'job') THEN name END AS cluster_name,
              CASE WHEN t.ref_type = 'job' AND (name IS NULL OR name = '') THEN 'JOB_WITHOUT_NAME'
                   WHEN name IS NULL THEN 'NAME_NOT_FOUND' END AS error
       FROM {tasks} t LEFT JOIN {source_directory} d ON t.ref_type = d.ref_type AND t.ref_id = d.id
       WHERE t.ref_type IS NOT NULL""",
)
def captured_references(spark, sf_dir):
    return w.capture_references(derived(spark, sf_dir, "tasks"), derived(spark, sf_dir, "source_directory"))


@query(
    "j9_rewritten_references",
    """AS_WITH latest AS (SELECT DISTINCT i.* FROM {task_infos} i
           JOIN (SELECT job_id, task_key, max(seq) AS seq FROM {task_infos} GROUP BY ALL) m USING (job_id, task_key, seq)),
      ids AS (SELECT ref_type, CASE WHEN ref_type IN ('pipeline', 'job') THEN name ELSE lower(name) END AS k,
                     count(*) AS n, min(id) AS id
              FROM {target_directory} WHERE ref_type IN ('pipeline', 'job') OR id IS NOT NULL GROUP BY ALL),
      joined AS (SELECT t.*, l.ref_type AS wanted_type, l.name AS wanted, n, id
                 FROM {tasks} t LEFT JOIN latest l USING (job_id, task_key)
                 LEFT JOIN ids ON l.ref_type = ids.ref_type
                   AND CASE WHEN l.ref_type IN ('pipeline', 'job') THEN l.name ELSE lower(l.name) END = k),
      judged AS (SELECT *, CASE WHEN wanted_type IS NULL THEN NULL WHEN wanted = '' THEN 'EMPTY_NAME'
                     WHEN n IS NULL THEN 'NAME_NOT_FOUND'
                     WHEN wanted_type IN ('pipeline', 'job') AND n > 1 THEN 'NAME_NOT_UNIQUE'
                     WHEN id IS NULL THEN 'EMPTY_ID' END AS error FROM joined)
      SELECT job_id, pos, task_key, ref_type, ref_id,
             CASE WHEN wanted_type IS NULL THEN ref_id WHEN error IS NULL THEN id END AS new_ref_id, error
      FROM judged""",
)
def rewritten_references(spark, sf_dir):
    return w.rewrite_references(
        derived(spark, sf_dir, "tasks"),
        derived(spark, sf_dir, "task_infos"),
        derived(spark, sf_dir, "target_directory"),
    )


@query(
    "j9_nested_rewrite",
    """AS_WITH ids AS (SELECT name, count(*) AS n, min(id) AS id FROM {target_directory}
                       WHERE ref_type = 'pipeline' GROUP BY name),
      one AS (SELECT o_orderkey AS job_id, id, n FROM orders
              LEFT JOIN ids ON name = concat('Object_', CAST(o_custkey AS STRING)))
      SELECT job_id,
             concat('live=', coalesce(CASE WHEN n = 1 THEN id END, '?'), ' note=old-note') AS tasks,
             CASE WHEN n IS NULL THEN 'NAME_NOT_FOUND' WHEN n > 1 THEN 'NAME_NOT_UNIQUE'
                  WHEN id IS NULL THEN 'EMPTY_ID' ELSE '' END AS errors
      FROM one""",
)
def nested_rewrite(spark, sf_dir):
    """Definitions of two tasks each, taken apart, rewritten and put together in order."""
    none = F.lit(None).cast("string")

    def task(key, pipeline=none, warehouse=none):
        return F.struct(
            F.lit(key).alias("task_key"),
            F.when(pipeline.isNotNull(), F.struct(pipeline.alias("pipeline_id"))).alias("pipeline_task"),
            F.lit(None).cast("struct<job_id:bigint>").alias("run_job_task"),
            F.when(warehouse.isNotNull(), F.struct(warehouse.alias("warehouse_id"))).alias("notebook_task"),
            none.alias("existing_cluster_id"),
        )

    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("Object_"), F.col("o_custkey")).alias("name"),
        F.array(
            task("live", pipeline=F.lit("old-live")), task("note", warehouse=F.lit("old-note"))
        ).alias("tasks"),
    )
    infos = jobs.select(
        "job_id", F.lit("live").alias("task_key"), F.lit(1).alias("seq"),
        F.lit("pipeline").alias("ref_type"), "name",
    )
    rewritten = w.rewrite_references(
        w.explode_tasks(jobs).drop("task"), infos, derived(spark, sf_dir, "target_directory")
    )
    nested = w.nest_tasks(rewritten, "task_key", "new_ref_id")
    shown = F.transform(
        "tasks", lambda t: F.concat(t["task_key"], F.lit("="), F.coalesce(t["new_ref_id"], F.lit("?")))
    )
    return nested.select(
        "job_id", F.array_join(shown, " ").alias("tasks"), F.array_join("errors.error", ",").alias("errors")
    )


_OLD = "'old-' || CAST(o_custkey AS VARCHAR)"


@query(
    "j9_rebuilt_jobs",
    f"""AS_WITH ids AS (SELECT ref_type, CASE WHEN ref_type IN ('pipeline', 'job') THEN name ELSE lower(name) END AS k,
                           count(*) AS n, min(id) AS id
              FROM {{rebuild_targets}} WHERE ref_type IN ('pipeline', 'job') OR id IS NOT NULL GROUP BY ALL),
      found AS (SELECT o.*, i.job_id IS NOT NULL AS listed, i.ref_type, n, id,
                       o_orderkey % 13 = 0 AS has_none, o_orderkey % 10 = 9 AS is_plain
                FROM orders o LEFT JOIN {{rebuild_infos}} i ON o_orderkey = i.job_id
                LEFT JOIN ids ON ids.ref_type = i.ref_type AND k =
                  CASE WHEN i.ref_type IN ('pipeline', 'job') THEN i.name ELSE lower(i.name) END),
      judged AS (SELECT *, CASE WHEN has_none OR NOT listed OR ref_type IS NULL THEN ''
                     WHEN n IS NULL THEN 'main NAME_NOT_FOUND'
                     WHEN ref_type IN ('pipeline', 'job') AND n > 1 THEN 'main NAME_NOT_UNIQUE'
                     WHEN id IS NULL THEN 'main EMPTY_ID'
                     WHEN is_plain AND ref_type <> 'notebook_compute' THEN 'main TASK_OF_ANOTHER_TYPE'
                     WHEN ref_type = 'job' AND TRY_CAST(id AS BIGINT) IS NULL THEN 'main JOB_ID_NOT_A_NUMBER'
                     ELSE '' END AS errors,
                 CASE WHEN listed AND ref_type IS NOT NULL THEN id END AS new_id FROM found)
      SELECT o_orderkey AS job_id, o_orderpriority AS job_name, errors,
             CASE WHEN has_none THEN CASE WHEN o_orderkey % 2 = 0 THEN '[]' END
                  WHEN errors = '' THEN '[{{"task_key":"main"' || CASE WHEN is_plain THEN
                        CASE WHEN new_id IS NOT NULL THEN ',"existing_cluster_id":"' || new_id || '"' ELSE '' END
                     ELSE CASE o_custkey % 5
                        WHEN 0 THEN ',"pipeline_task":{{"pipeline_id":"' || coalesce(new_id, {_OLD}) || '"}}'
                        WHEN 1 THEN ',"run_job_task":{{"job_id":' || coalesce(new_id, CAST(o_custkey AS VARCHAR)) || '}}'
                        WHEN 2 THEN ',"notebook_task":{{"warehouse_id":"' || coalesce(new_id, {_OLD}) || '"}}'
                        ELSE ',"notebook_task":{{}},"existing_cluster_id":"' || coalesce(new_id, {_OLD}) || '"' END
                     END || '}},{{"task_key":"last","notebook_task":{{"warehouse_id":"kept"}}}}]' END AS tasks
      FROM judged""",
)
def rebuilt_jobs(spark, sf_dir):
    """Whole nested jobs, compared as JSON: all types, jobs without tasks, tasks of another type."""
    kind, key, order = F.col("o_custkey") % 5, F.col("o_custkey"), F.col("o_orderkey")
    old = F.concat(F.lit("old-"), key.cast("string"))
    is_plain = order % 10 == 9
    none = F.lit(None).cast("string")
    main = F.struct(
        F.lit("main").alias("task_key"),
        F.when(~is_plain & (kind == 0), F.struct(old.alias("pipeline_id"))).alias("pipeline_task"),
        F.when(~is_plain & (kind == 1), F.struct(key.alias("job_id"))).alias("run_job_task"),
        F.when(~is_plain & (kind > 1), F.struct(F.when(kind == 2, old).alias("warehouse_id"))).alias("notebook_task"),
        F.when(~is_plain & (kind > 2), old).alias("existing_cluster_id"),
    )
    last = F.struct(
        F.lit("last").alias("task_key"),
        F.lit(None).cast("struct<pipeline_id:string>").alias("pipeline_task"),
        F.lit(None).cast("struct<job_id:bigint>").alias("run_job_task"),
        F.struct(F.lit("kept").alias("warehouse_id")).alias("notebook_task"),
        none.alias("existing_cluster_id"),
    )
    tasks = F.array(main, last)
    empty = F.filter(tasks, lambda task: F.lit(False))
    jobs = table(spark, sf_dir, "orders").select(
        order.alias("job_id"),
        F.col("o_orderpriority").alias("job_name"),
        F.when(order % 13 != 0, tasks).when(order % 2 == 0, empty).alias("tasks"),
    )
    rebuilt = w.rebuild_jobs(jobs, derived(spark, sf_dir, "rebuild_infos"), derived(spark, sf_dir, "rebuild_targets"))
    listed = F.transform("errors", lambda e: F.concat_ws(" ", e["task_key"], e["error"]))
    return rebuilt.select(
        "job_id", "job_name", F.to_json("tasks").alias("tasks"), F.array_join(listed, ",").alias("errors")
    )


_CAPTURED = """captured AS (SELECT t.*, name, (t.ref_type = 'job' AND coalesce(name, '') = '') OR name IS NULL AS failed
        FROM {tasks} t LEFT JOIN {source_directory} d ON t.ref_type = d.ref_type AND t.ref_id = d.id WHERE t.ref_type IS NOT NULL),
      judged AS (SELECT r.*, j.job_id, j.run_as, CASE WHEN r.name = '' THEN 'EMPTY_NAME' WHEN n IS NULL THEN 'NOT_FOUND'
             WHEN n > 1 THEN 'AMBIGUOUS' WHEN f.id IN (SELECT job_id FROM captured WHERE failed) THEN 'REFERENCE_NOT_CAPTURED'
             WHEN expected_run_as IS NULL OR trim(run_as) = '' THEN NULL WHEN display_name IS NULL THEN 'ERROR_UNKNOWN_PRINCIPAL'
             WHEN lower(display_name) <> expected_run_as THEN 'ERROR_RUN_AS_CHANGED' END AS error
        FROM {workflow_requests} r
        LEFT JOIN (SELECT name, count(*) AS n, max(job_id) AS id FROM {workflow_jobs} GROUP BY name) f ON r.name = f.name
        LEFT JOIN {workflow_jobs} j ON j.job_id = CASE WHEN n = 1 AND r.name <> '' THEN f.id END
        LEFT JOIN {service_principals} s ON lower(trim(run_as)) = application_id)"""


def _judged_workflows(spark, sf_dir):
    captured = w.capture_references(derived(spark, sf_dir, "tasks"), derived(spark, sf_dir, "source_directory"), merge=True)
    jobs = derived(spark, sf_dir, "workflow_jobs")
    principals = derived(spark, sf_dir, "service_principals")
    return judge_workflow_requests(derived(spark, sf_dir, "workflow_requests"), jobs, captured, principals), jobs, captured


@query("workflow_update_verdicts", "AS_WITH " + _CAPTURED + " SELECT request_id, name, expected_run_as, job_id, error FROM judged")
def workflow_verdicts(spark, sf_dir):
    """Which workflows may be taken back into their descriptors."""
    return _judged_workflows(spark, sf_dir)[0]


@query(
    "workflow_update_map",
    "AS_WITH " + _CAPTURED + """,
      usable AS (SELECT request_id, job_id FROM judged WHERE error IS NULL),
      quoted AS (SELECT c.*, ref_type IN ('pipeline', 'job') AS is_task, '"' || ref_id || '"' AS i, '"' || name || '"' AS m FROM captured c),
      task_rows AS (SELECT request_id, 'spec.mesh.specific.workflowTasksInfoList' AS path, pos, chr(123) || '"taskKey":"' || task_key
               || '","referencedTaskType":"' || ref_type || '","referencedTaskId":' || CASE WHEN is_task THEN i ELSE 'null' END
               || ',"referencedTaskName":' || CASE WHEN is_task THEN m ELSE 'null' END || ',"referencedClusterName":'
               || CASE WHEN is_task THEN 'null' ELSE m END || ',"referencedClusterId":' || CASE WHEN is_task THEN 'null' ELSE i END
               || chr(125) AS value_json FROM usable JOIN quoted USING (job_id)),
      no_tasks AS (SELECT request_id, 'spec.mesh.specific.workflowTasksInfoList', NULL, '[]' FROM usable
               WHERE job_id NOT IN (SELECT job_id FROM captured)),
      details AS (SELECT request_id, unnest(['spec.mesh.specific.workflow.job_id', 'spec.mesh.specific.workflow.created_time',
                 'spec.mesh.specific.workflow.creator_user_name', 'spec.mesh.specific.workflow.settings',
                 'spec.mesh.specific.workflow.settings.name', 'form.parameters.modifiedByRef', 'form.parameters.updatedDate']) AS path,
               NULL AS pos, unnest([CAST(job_id AS VARCHAR), CAST(created_time AS VARCHAR),
                 coalesce('"' || replace(creator_user_name, '"', chr(92) || '"') || '"', 'null'), coalesce(settings, chr(123) || chr(125)),
                 '"IGNORED"', '"template.1"', '"2024-05-06T07:08:09.010Z"']) AS value_json
               FROM usable JOIN {workflow_jobs} USING (job_id))
      SELECT * FROM task_rows UNION ALL SELECT * FROM no_tasks UNION ALL SELECT * FROM details""",
)
def workflow_map(spark, sf_dir):
    judged, jobs, captured = _judged_workflows(spark, sf_dir)
    moment = F.to_timestamp(F.lit("2024-05-06 07:08:09.010"))
    return workflow_updates(judged, jobs, captured, "form.parameters", "template.1", moment)
