"""Scans, published views, column inventory and the streamed projection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.inputs import TABLES, derived, table
from checks.registry import query
from concordat.operators.contract import contract_projection, missing_columns
from concordat.operators.row_rules import ColumnRule, count_violations
from concordat.session import shared_folder
from concordat.sources.catalog import column_inventory, inventory_from_catalog, keys_from_catalog, scan_files
from concordat.sources.footers import folder_inventory
from concordat.sources.views import ViewColumn, described_columns, publish_view, unpublish_view
from concordat.streaming.projection import publish_stream
from concordat.streaming.versions import publish_versions, published_rows


@query("s1_table_scan", "SELECT * FROM orders")
def table_scan(spark, sf_dir):
    return scan_files(spark, sf_dir, "orders")


@query("p1_contract_projection", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def projection(spark, sf_dir):
    """Contract checked against the source's columns, then published as a view and read back."""
    wanted = ["c_custkey", "c_name", "c_nationkey"]
    source = scan_files(spark, sf_dir, "customer")
    inventory = column_inventory(spark, {"customer": source})
    contract = spark.createDataFrame([("customer", c) for c in wanted], "table_name string, name string")
    if not missing_columns(contract, inventory).isEmpty():
        raise ValueError("the contract names columns its source does not have")
    publish_view(
        spark, f"parquet.`{sf_dir}/customer.parquet`", ["customer_published"],
        [ViewColumn(c) for c in wanted], temporary=True,
    )
    return contract_projection(spark.table("customer_published"), wanted)


@query(
    "s2_published_view",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem",
)
def published_view(spark, sf_dir):
    contract = [ViewColumn(c) for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")]
    publish_view(
        spark, f"parquet.`{sf_dir}/lineitem.parquet`", ["lineitem_published"], contract, temporary=True
    )
    return spark.table("lineitem_published")


@query("s2_published_view_without_contract", "SELECT * FROM events")
def published_whole(spark, sf_dir):
    publish_view(spark, f"parquet.`{sf_dir}/events.parquet`", ["events_published"], temporary=True)
    return spark.table("events_published")


@query(
    "s3_described_view",
    """SELECT d.column_name, d.description, CASE d.column_name
                WHEN 'o_orderkey' THEN k WHEN 'o_orderstatus' THEN s ELSE p END AS filled_rows
         FROM (VALUES ('o_orderkey', 'The order''s key'), ('o_orderstatus', NULL),
                      ('o_totalprice', 'Price \\ total')) d(column_name, description),
              (SELECT count(o_orderkey) AS k, count(o_orderstatus) AS s, count(o_totalprice) AS p
                 FROM orders)""",
)
def described_view(spark, sf_dir):
    """Descriptions read back from the view, beside the number of filled rows in each column."""
    contract = [
        ViewColumn("o_orderkey", "The order's key"),
        ViewColumn("o_orderstatus", "  "),
        ViewColumn("o_totalprice", "Price \\ total"),
    ]
    publish_view(
        spark, f"parquet.`{sf_dir}/orders.parquet`", ["orders_described"], contract,
        "Orders as published", temporary=True,
    )
    described = spark.createDataFrame(
        described_columns(spark, ["orders_described"]), "column_name string, description string"
    )
    view = spark.table("orders_described")
    filled = view.agg(*[F.count(c.name).alias(c.name) for c in contract]).select(
        F.explode(
            F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.col(c.name).alias("filled_rows"))
                      for c in contract])
        ).alias("f")
    ).select("f.*")
    return described.join(filled, ["column_name"])


@query(
    "s4_unpublished_views",
    """SELECT 's4_kept' AS view_name, false AS dropped, false AS dropped_again, count(*) AS rows_left FROM orders
       UNION ALL SELECT 's4_taken_back', true, false, NULL""",
)
def unpublished_views(spark, sf_dir):
    """Two views of orders are published and one is taken back, twice; rows are read through what is left."""
    views = ["s4_kept", "s4_taken_back"]
    for view in views:
        publish_view(spark, f"parquet.`{sf_dir}/orders.parquet`", [view], temporary=True)
    dropped = {"s4_taken_back": unpublish_view(spark, ["s4_taken_back"])}
    again = {"s4_taken_back": unpublish_view(spark, ["s4_taken_back"])}
    found = None
    for view in views:
        is_left = spark.catalog.tableExists(view)
        counted = (spark.table(view) if is_left else table(spark, sf_dir, "orders")).agg(
            F.lit(view).alias("view_name"),
            F.lit(dropped.get(view, False)).alias("dropped"),
            F.lit(again.get(view, False)).alias("dropped_again"),
            (F.count(F.lit(1)) if is_left else F.max(F.lit(None).cast("bigint"))).alias("rows_left"),
        )
        found = counted if found is None else found.unionByName(counted)
    return found


@query(
    "s5_inventory_from_catalog",
    """SELECT concat('cat.sales.', split_part(table_name, '.', 3)) AS table_name, pos, column_name, type_name, type_text,
              type_precision, type_scale, nullable, comment FROM {columns_inv}""",
)
def inventory_of_catalog(spark, sf_dir):
    """The inventory of an estate of one table per order, from rows as a catalog lists its columns."""
    return inventory_from_catalog(derived(spark, sf_dir, "catalog_columns"))


@query(
    "s5_keys_from_catalog",
    """SELECT table_name, constraint_name, key_list FROM {key_lists}""",
)
def keys_of_catalog(spark, sf_dir):
    """Primary keys from rows as a catalog lists the columns of its constraints."""
    keys = keys_from_catalog(derived(spark, sf_dir, "catalog_keys"))
    return keys.select("table_name", "constraint_name", F.array_join("child_columns", ",").alias("key_list"))


# Column types of the given tables as the inventory names them.
_COLUMN_TYPES = {
    "region": {"r_regionkey": "INT", "r_name": "STRING"},
    "nation": {"n_nationkey": "INT", "n_name": "STRING", "n_regionkey": "INT"},
    "customer": {
        "c_custkey": "BIGINT", "c_name": "STRING", "c_nationkey": "INT", "c_acctbal": "DOUBLE",
        "c_mktsegment": "STRING",
    },
    "supplier": {"s_suppkey": "BIGINT", "s_name": "STRING", "s_nationkey": "INT", "s_acctbal": "DOUBLE"},
    "part": {
        "p_partkey": "BIGINT", "p_name": "STRING", "p_brand": "STRING", "p_type": "STRING",
        "p_size": "INT", "p_retailprice": "DOUBLE",
    },
    "orders": {
        "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "STRING",
        "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP_NTZ", "o_orderpriority": "STRING",
    },
    "lineitem": {
        "l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT", "l_linenumber": "INT",
        "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE",
        "l_returnflag": "STRING", "l_linestatus": "STRING", "l_shipdate": "TIMESTAMP_NTZ",
    },
    "events": {
        "event_id": "BIGINT", "ts": "TIMESTAMP_NTZ", "user_id": "BIGINT", "event_type": "STRING",
        "value": "DOUBLE", "props": "STRING",
    },
    "documents": {
        "doc_id": "BIGINT", "text": "STRING", "lang": "STRING", "source": "STRING", "n_chars": "BIGINT",
    },
    "embeddings": {"vec_id": "BIGINT", "embedding": "ARRAY<FLOAT>", "label": "INT"},
    "pages": {"page_id": "BIGINT", "url": "STRING", "html": "STRING"},
    "benchmark": {"item_id": "BIGINT", "text": "STRING"},
    "labels": {"doc_id": "BIGINT", "quality": "INT", "toxic": "INT"},
    "conversations": {"conv_id": "BIGINT", "turn": "BIGINT", "role": "STRING", "text": "STRING"},
}

_INVENTORY_ORACLE = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {pos} AS pos, '{c}' AS column_name, '{dtype}' AS type_name, "
    f"true AS nullable, count(*) - count({c}) AS null_rows, count(*) AS table_rows FROM {t}"
    for t, columns in _COLUMN_TYPES.items()
    for pos, (c, dtype) in enumerate(columns.items())
)


@query("s5_column_inventory", _INVENTORY_ORACLE)
def inventory(spark, sf_dir):
    """Declared columns of every table beside what its rows hold."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    observed = None
    for name, df in tables.items():
        rules = [ColumnRule(c, constraint="NOT_NULL") for c in df.columns]
        counts = count_violations(df, rules).select(
            F.lit(name).alias("table_name"), "column_name",
            F.col("violations").alias("null_rows"), F.col("rows").alias("table_rows"),
        )
        observed = counts if observed is None else observed.unionByName(counts)
    declared = column_inventory(spark, tables).select(
        "table_name", "pos", "column_name", "type_name", "nullable"
    )
    return declared.join(observed, ["table_name", "column_name"])


@query(
    "s5_inventory_from_footers",
    " UNION ALL ".join(
        f"SELECT 'lake.{t}' AS table_name, {pos} AS pos, '{c}' AS column_name, '{dtype}' AS type_name, "
        f"true AS nullable, count(*) AS table_rows FROM {t} HAVING count(*) > 0"
        for t, columns in _COLUMN_TYPES.items() for pos, (c, dtype) in enumerate(columns.items())
    ),
)
def inventory_of_footers(spark, sf_dir):
    """The columns of all tables in the folder, from their footers, beside their numbers of rows."""
    columns = folder_inventory(spark, sf_dir, prefix="lake.").where("problem IS NULL")
    counts = None
    for t in TABLES:
        counted = table(spark, sf_dir, t).agg(F.lit(f"lake.{t}").alias("table_name"), F.count("*").alias("table_rows"))
        counts = counted if counts is None else counts.unionByName(counted)
    return columns.join(counts, "table_name").select("table_name", "pos", "column_name", "type_name", "nullable", "table_rows")


@query("t1_streamed_projection", "SELECT event_id, user_id, event_type, value FROM events")
def streamed_projection(spark, sf_dir):
    """The projection published through a stream; equal to the batch projection."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events*.parquet")
    folder = f"{shared_folder(spark)}/projection-{uuid.uuid4().hex}"
    wanted = ["event_id", "user_id", "event_type", "value"]
    publish_stream(stream, wanted, f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(source.select(*wanted).schema).parquet(f"{folder}/data")


@query(
    "t1_versioned_projection",
    """SELECT event_id, user_id, CASE WHEN event_id % 2 = 1 THEN props END AS props FROM events""",
)
def versioned_projection(spark, sf_dir):
    """Events in two runs of a stream; the contract has one column more in the second."""
    source = table(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    for run, wanted in enumerate((["event_id", "user_id"], ["event_id", "user_id", "props"])):
        source.where(F.col("event_id") % 2 == run).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
        publish_versions(stream, wanted, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return published_rows(spark, f"{folder}/out", source.select(*wanted).schema).drop("version")
