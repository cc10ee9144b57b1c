"""Reading the tables, and tables written between the steps of an operator.

Steps that are read more than once, or that end a loop, are written as Parquet below the
folder that ``spark.checkpoint.dir`` names, which every executor can read.  A lost executor
then costs the tasks it was running and nothing that was finished.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from concordat.session import shared_folder

# Shuffle files of a step are of no use once its table is written.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder for the tables of one run of an operator."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tables-"))
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


@contextmanager
def option(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written below ``folder`` and read back: the step ends here."""
    spark, path = df.sparkSession, f"{folder}/{name}"
    with option(spark, _DROP_SHUFFLES, "true"), option(spark, _BATCH_ROWS, "1000"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str, name: str) -> None:
    """Remove a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def made_folder(spark: SparkSession, folder: str) -> str:
    """Make the folder; its full address, for tasks that write files themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    return store.makeQualified(path).toUri().toString()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that long texts do not add up in a worker."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_HOLDERS: dict[str, Callable[[], None]] = {}


def holding(owner: str, release: Callable[[], None]) -> None:
    """Called in a worker that keeps something between tasks: what other owners keep is released.

    Workers outlive the step they were started for, and a pipeline has many.
    """
    others = [o for o in _HOLDERS if o != owner]
    for other in others:
        _HOLDERS.pop(other)()
    _HOLDERS[owner] = release
    if others:
        give_back()


def give_back() -> None:
    """Return memory that is free in this worker to the machine, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(column: pa.Array) -> list[str]:
    """The texts; null counts as empty."""
    return [t or "" for t in column.to_pylist()]
