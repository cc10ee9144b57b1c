"""The status fold, in a batch and on a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.inputs import INPUTS, derived, table
from checks.registry import query
from concordat.operators.status import fold_status, orphan_updates
from concordat.session import shared_folder
from concordat.streaming.orphans import orphan_stream, orphans_so_far
from concordat.streaming.status import fold_status_stream, latest_status

_FOLD_SQL = """AS_WITH created AS (SELECT task_id, min(seq) AS c FROM {status_log} WHERE op = 'create' GROUP BY task_id),
      known AS (SELECT l.* FROM {status_log} l JOIN created USING (task_id) WHERE seq >= c)
      SELECT task_id,
             arg_max(CASE op WHEN 'create' THEN 'RUNNING' ELSE status END, seq)
               FILTER (op = 'create' OR (status IS NOT NULL AND status <> '')) AS status,
             coalesce(arg_max(result, seq) FILTER (op = 'update' AND result IS NOT NULL AND result <> ''), '') AS result,
             arg_max(info, seq) FILTER (op = 'update' AND info IS NOT NULL AND info <> '') AS info
      FROM known GROUP BY task_id"""


@query("t2_status_fold", _FOLD_SQL)
def status_fold(spark, sf_dir):
    return fold_status(derived(spark, sf_dir, "status_log"))


_ORPHANS_SQL = """AS_WITH created AS (SELECT task_id, min(seq) AS c FROM {status_log} WHERE op = 'create' GROUP BY task_id)
      SELECT l.* FROM {status_log} l LEFT JOIN created USING (task_id)
      WHERE op = 'update' AND (c IS NULL OR seq < c)"""


@query("t2_orphan_updates", _ORPHANS_SQL)
def orphans(spark, sf_dir):
    return orphan_updates(derived(spark, sf_dir, "status_log"))


@query("t2_streamed_status_fold", _FOLD_SQL)
def streamed_fold(spark, sf_dir):
    """The same fold over a stream of the log; equal to the batch fold."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    log = spark.sql(INPUTS["status_log"], events=stream)
    folder = f"{shared_folder(spark)}/status-{uuid.uuid4().hex}"
    fold_status_stream(log, f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    return latest_status(spark, f"{folder}/data")


@query("t2_streamed_orphans", _ORPHANS_SQL)
def streamed_orphans(spark, sf_dir):
    """The side output of the stream over a log that arrives out of order, in two runs of several micro-batches."""
    log = derived(spark, sf_dir, "status_log")
    folder = f"{shared_folder(spark)}/orphans-{uuid.uuid4().hex}"
    for run in (0, 1):
        # creations come late: the order of arrival is a hash
        arriving = log.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == run)
        arriving.repartition(4, "seq").write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
        orphan_stream(stream, f"{folder}/side", f"{folder}/checkpoint", shares=4).awaitTermination()
    return orphans_so_far(spark, f"{folder}/side", log.schema)
