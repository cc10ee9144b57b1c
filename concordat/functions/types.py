"""The two type vocabularies and the mapping between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.names import col

# Platform types matched by prefix, keeping only the prefix.
PREFIX_TYPES = ["DECIMAL", "ARRAY", "MAP", "STRUCT", "VARCHAR", "CHAR"]

# Platform types matched whole that keep their name.
SAME_NAME_TYPES = [
    "BIGINT", "BINARY", "BOOLEAN", "DATE", "DOUBLE", "FLOAT", "INT", "INTERVAL",
    "SMALLINT", "STRING", "TIMESTAMP", "TINYINT", "VARIANT", "LONG",
]

# Platform types matched whole that change their name.
RENAMED_TYPES = {"TIMESTAMP_NTZ": "TIMESTAMPZ"}

# The type names a contract may use.
CONTRACT_TYPES = [
    "NUMBER", "TINYINT", "SMALLINT", "INT", "BIGINT", "BYTEINT", "BYTES", "FLOAT",
    "DOUBLE", "DECIMAL", "NUMERIC", "TIMESTAMP", "TIMESTAMPZ", "TIME", "DATE",
    "DATETIME", "INTERVAL", "STRING", "MEDIUMTEXT", "TEXT", "CHAR", "LONG", "VARCHAR",
    "BOOLEAN", "BINARY", "VARBINARY", "ARRAY", "BLOB", "LONGBLOB", "MEDIUMBLOB", "MAP",
    "STRUCT", "UNION", "SET", "GEOGRAPHY", "ENUM", "JSON", "UUID", "VARIANT",
    "GEOMETRY", "POINT", "POLYGON", "BYTEA",
]

# Fixed value: length recorded for every STRING column.
STRING_LENGTH = 65535

# Spark types used to test whether a value can be read as its declared type.
CASTABLE_TYPES = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint",
    "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp", "TIMESTAMPZ": "timestamp_ntz",
}


def contract_type(platform_type: str | Column) -> Column:
    """Contract type of a platform type, null when there is none."""
    t = col(platform_type)
    mapped = F.when(t.isin(SAME_NAME_TYPES), t)
    for name, renamed in RENAMED_TYPES.items():
        mapped = mapped.when(t == name, F.lit(renamed))
    for prefix in PREFIX_TYPES:
        mapped = mapped.when(t.startswith(prefix), F.lit(prefix))
    return mapped


def is_contract_type(declared: str | Column) -> Column:
    return F.upper(col(declared)).isin(CONTRACT_TYPES)
