"""The column inventory of an estate of Parquet tables, read from file footers by the executors.

A data source of its own: the driver lists the tables below a folder with one call, deals them
into partitions, and each partition opens the footers of its tables.  No table's data is read
and none is opened by the driver.  A table is a file ``name.parquet`` or a folder; of a folder
the first data file in order of names tells the columns, as it does for a scan, and folders
``key=value`` on the way to it tell partition columns.

Workers get the code with the task and import nothing of ours.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from concordat.schemas import COLUMN_INVENTORY
from concordat.sources.stores import carried, listed, opened

# Fixed value: where a Spark writer keeps its own schema in a footer.
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"

_FIELDS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in COLUMN_INVENTORY.fields) + ", problem string"


def _first_file(fs, path: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The first data file below ``path`` and the (column, value) folders on the way."""
    import pyarrow.fs as pafs

    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return path, []
    partitions: list[tuple[str, str]] = []
    while True:
        below = sorted((i for i in fs.get_file_info(pafs.FileSelector(path)) if not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        files = [i.path for i in below if i.type == pafs.FileType.File and i.size]
        if files:
            return files[0], partitions
        folders = [i for i in below if i.type == pafs.FileType.Directory]
        if not folders:
            return None, partitions
        path = folders[0].path
        if "=" in folders[0].base_name:
            partitions.append(tuple(folders[0].base_name.split("=", 1)))


def _partition_type(value: str):
    """Whole numbers as a scan takes them; everything else as text."""
    from pyspark.sql import types as T

    digits = value.removeprefix("-")
    if digits.isascii() and digits.isdigit():
        return T.IntegerType() if -(1 << 31) <= int(value) < 1 << 31 else T.LongType()
    return T.StringType()


def _schema_of(fs, path: str):
    import pyarrow.parquet as pq
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_schema

    with fs.open_input_file(path) as file:
        schema = pq.ParquetFile(file).schema_arrow
    own = (schema.metadata or {}).get(_SPARK_SCHEMA)
    return T.StructType.fromJson(json.loads(own)) if own else from_arrow_schema(schema, prefer_timestamp_ntz=True)


def _rows_of(table: str, location: str) -> Iterator[tuple]:
    from pyspark.sql import types as T

    try:
        fs, path = opened(location)
        file, partitions = _first_file(fs, path)
        if file is None:
            yield (table, *[None] * 8, "no data file")
            return
        fields = list(_schema_of(fs, file).fields)
    except Exception as problem:  # whatever a file can be: an error is a row
        yield (table, *[None] * 8, f"unreadable: {' '.join(str(problem).split())}")
        return
    fields += [T.StructField(name, _partition_type(value)) for name, value in partitions]
    for pos, field in enumerate(fields):
        text = field.metadata.get("__CHAR_VARCHAR_TYPE_STRING") or field.dataType.simpleString()
        decimal = field.dataType if isinstance(field.dataType, T.DecimalType) else None
        # files may lack a column or hold nulls whatever they say: a scan takes all as nullable
        yield (
            table, pos, field.name, text.upper(), text, decimal and decimal.precision, decimal and decimal.scale,
            True, field.metadata.get("comment"), None,
        )


class Tables(InputPartition):
    def __init__(self, tables: list[tuple[str, str]]) -> None:
        self.tables = tables


class FooterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._root, self._prefix = options["path"], options.get("prefix", "")
        self._per_partition = int(options.get("tablesperpartition", "50"))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        _, entries = listed(self._root)
        # paths below a store's root: what stands ahead of the root's own path belongs to each of them
        ahead = self._root[: len(self._root) - len(opened(self._root)[1])] if "://" in self._root else ""
        tables = [
            (self._prefix + i.base_name.removesuffix(".parquet"), ahead + i.path)
            for i in entries if i.type == pafs.FileType.Directory or i.base_name.endswith(".parquet")
        ]
        n = self._per_partition
        return [Tables(tables[at : at + n]) for at in range(0, len(tables), n)]

    def read(self, partition: Tables) -> Iterator[tuple]:
        for table, location in partition.tables if partition else []:
            yield from _rows_of(table, location)


class FooterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "table_footers"

    def schema(self) -> str:
        return _FIELDS

    def reader(self, schema: T.StructType) -> FooterReader:
        return FooterReader(self.options)


def folder_inventory(spark: SparkSession, root: str, prefix: str = "", tables_per_partition: int = 50) -> DataFrame:
    """The columns of every Parquet table below ``root``, in the columns of ``column_inventory`` and ``problem``.

    Names are those of the files and folders behind ``prefix``.  A table without a data file
    and one whose footer cannot be read have one row with a ``problem``.  ``root`` is in a store
    that pyarrow opens; for others take ``inventory_from_catalog``.
    """
    carried(__name__)
    spark.dataSource.register(FooterSource)
    options = {"prefix": prefix, "tablesPerPartition": tables_per_partition}
    return spark.read.format("table_footers").options(**options).load(root)
