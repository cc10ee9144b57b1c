"""A published projection in versions: each micro-batch is one, and counts once it is whole.

The number of the micro-batch is the commit: its rows go to a folder of that number, which a
retry overwrites, and then its mark is written.  Readers see the versions up to the last mark,
so a stop inside a batch loses nothing and doubles nothing.  The contract may change between
runs: each version has the columns of its own time and is read in those of the contract asked
for.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from concordat.operators.contract import contract_projection

# A column of a type on the left can be read as those on its right.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint",),
    "float": ("double",), "date": ("timestamp_ntz",),
}


def breaking_changes(published: T.StructType, wanted: T.StructType) -> list[str]:
    """Columns whose published type cannot be read as the wanted one; new and dropped columns break nothing."""
    found = []
    known = {f.name: f.dataType.simpleString() for f in published.fields}
    for field in wanted.fields:
        old, new = known.get(field.name), field.dataType.simpleString()
        if old is not None and old != new and new not in _WIDER.get(old, ()):
            found.append(f"{field.name}: {old} cannot become {new}")
    return found


def publish_versions(
    source: DataFrame,
    columns: Sequence[str] | None,
    target: str,
    checkpoint: str,
    continuous: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Write the contract's columns of a stream below ``target``, a version per micro-batch.

    A contract that reads a published column in a narrower or other type is refused before
    anything is written.
    """
    rows = contract_projection(source, columns)
    problems = [p for schema in _schemas(source.sparkSession, target) for p in breaking_changes(schema, rows.schema)]
    if problems:
        raise ValueError("; ".join(sorted(set(problems))))

    def write_version(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/version={number}")
        mark = batch.sparkSession.createDataFrame([(batch.schema.json(),)], "columns string")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{target}/marks/mark={number}")

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write_version)
    trigger = {"processingTime": interval} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _marks(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{target}/marks")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _schemas(spark: SparkSession, target: str) -> list[T.StructType]:
    """The different contracts published so far; as many as there were changes."""
    marks = _marks(spark, target)
    texts = [] if marks is None else [r["columns"] for r in marks.select("columns").distinct().collect()]
    return [T.StructType.fromJson(json.loads(text)) for text in texts]


def published_rows(spark: SparkSession, target: str, contract: T.StructType) -> DataFrame:
    """All published rows in the columns of a contract, with their ``version``.

    A column that a version did not have yet is null there; one that the contract no longer
    has is not read.  Before the first version there are no rows.
    """
    marks = _marks(spark, target)
    last = None if marks is None else marks.agg(F.max("mark")).first()[0]
    typed = T.StructType([*contract.fields, T.StructField("version", T.IntegerType())])
    if last is None:
        return spark.createDataFrame([], typed)
    versions = spark.read.schema(typed).parquet(f"{target}/rows")
    return versions.where(F.col("version") <= last)
