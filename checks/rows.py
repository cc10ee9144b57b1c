"""Row checks against declared contracts (an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.inputs import table
from checks.registry import query
from concordat.operators import row_rules as r
from concordat.operators.profile_states import keep_states, kept_states, profile_of_states
from concordat.operators.row_rules import ColumnRule
from concordat.session import shared_folder


@query(
    "e1_null_violations",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 'NOT_NULL' AS rule, count(*) - count({c}) AS violations, "
        "count(*) AS rows FROM events"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)
def null_violations(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return r.count_violations(events, [ColumnRule(c, constraint="NOT_NULL") for c in events.columns])


@query(
    "e2_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    return r.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "e3_length_violations",
    """SELECT 'text' AS column_name, 'MAX_LENGTH' AS rule, count(*) FILTER (length(text) > 1000) AS violations,
              count(*) AS rows FROM documents""",
)
def length_violations(spark, sf_dir):
    return r.count_violations(table(spark, sf_dir, "documents"), [ColumnRule("text", data_length=1000)])


@query(
    "e4_decimal_violations",
    """SELECT 'o_totalprice' AS column_name, 'DECIMAL_FIT' AS rule,
              count(*) FILTER (o_totalprice IS NOT NULL AND TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL) AS violations,
              count(*) AS rows FROM orders""",
)
def decimal_violations(spark, sf_dir):
    return r.count_violations(
        table(spark, sf_dir, "orders"), [ColumnRule("o_totalprice", precision=7, scale=2)]
    )


@query(
    "e5_type_violations",
    """SELECT 'props' AS column_name, 'CASTABLE' AS rule,
              count(*) FILTER (TRY_CAST(props AS INT) IS NULL) AS violations, count(*) AS rows FROM events
       UNION ALL SELECT 'value', 'CASTABLE', 0, count(*) FROM events""",
)
def type_violations(spark, sf_dir):
    return r.count_violations(
        table(spark, sf_dir, "events"), [ColumnRule("props", "INT"), ColumnRule("value", "INT")]
    )


@query(
    "e1_e4_rules_in_one_pass",
    """SELECT c AS column_name, r AS rule, CASE r WHEN 'NOT_NULL' THEN n WHEN 'MAX_LENGTH' THEN l ELSE d END AS violations, rows
       FROM (SELECT count(*) AS rows, count(*) - count(l_orderkey) AS n,
                    count(*) FILTER (length(l_returnflag) > 0) AS l,
                    count(*) FILTER (TRY_CAST(l_extendedprice AS DECIMAL(6,2)) IS NULL) AS d FROM lineitem),
            (VALUES ('l_orderkey', 'NOT_NULL'), ('l_returnflag', 'MAX_LENGTH'), ('l_extendedprice', 'DECIMAL_FIT')) v(c, r)""",
)
def rules_in_one_pass(spark, sf_dir):
    return r.count_violations(
        table(spark, sf_dir, "lineitem"),
        [
            ColumnRule("l_orderkey", constraint="PRIMARY_KEY"),
            ColumnRule("l_returnflag", data_length=0),
            ColumnRule("l_extendedprice", precision=6, scale=2),
        ],
    )


@query(
    "e3_violating_rows",
    """SELECT doc_id, concat_ws(',', CASE WHEN length(text) > 1000 THEN 'text MAX_LENGTH' END,
                                CASE WHEN length(lang) > 1 THEN 'lang MAX_LENGTH' END) AS violations
       FROM documents WHERE length(text) > 1000 OR length(lang) > 1""",
)
def violating_rows(spark, sf_dir):
    rules = [ColumnRule("text", data_length=1000), ColumnRule("lang", data_length=1)]
    return r.violating_rows(table(spark, sf_dir, "documents"), rules).select(
        "doc_id", F.array_join("violations", ",").alias("violations")
    )


@query(
    "e6_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, "
        f"count(DISTINCT {c}) AS distinct_values FROM lineitem"
        for c in (
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        )
    ),
)
def profile(spark, sf_dir):
    return r.profile(table(spark, sf_dir, "lineitem")).select(
        "column_name", "rows", "nulls", "distinct_values"
    )


@query(
    "e6_profile_with_bounds",
    """SELECT 'c_custkey' AS column_name, count(*) AS rows, count(*) - count(c_custkey) AS nulls,
              count(DISTINCT c_custkey) AS distinct_values,
              CAST(min(c_custkey) AS VARCHAR) AS min_value, CAST(max(c_custkey) AS VARCHAR) AS max_value FROM customer
       UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), count(DISTINCT c_name),
              min(c_name), max(c_name) FROM customer
       UNION ALL SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey), count(DISTINCT c_nationkey),
              CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR) FROM customer
       UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment),
              min(c_mktsegment), max(c_mktsegment) FROM customer
       UNION ALL SELECT 'c_acctbal', count(*), count(*) - count(c_acctbal), count(DISTINCT c_acctbal),
              CAST(min(c_acctbal) AS VARCHAR), CAST(max(c_acctbal) AS VARCHAR) FROM customer""",
)
def profile_with_bounds(spark, sf_dir):
    return r.profile(table(spark, sf_dir, "customer"))


@query(
    "e6_profile_of_kept_states",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS min_value, "
        f"CAST(max({c}) AS VARCHAR) AS max_value, true AS distinct_is_close FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def profile_of_kept_states(spark, sf_dir):
    """Orders by status, profiled in two runs: one partition is read again, one is new; the rest is merged."""
    orders = table(spark, sf_dir, "orders")
    path = f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}"
    keep_states(orders.where("o_orderstatus IN ('F', 'O')"), ["o_orderstatus"], path)
    keep_states(orders.where("o_orderstatus NOT IN ('F')"), ["o_orderstatus"], path)
    kept = profile_of_states(kept_states(spark, path))
    exact = r.profile(orders).select("column_name", F.col("distinct_values").alias("counted"))
    close = F.abs(F.col("distinct_values") - F.col("counted")) <= F.col("counted") * 0.08
    return kept.join(exact, "column_name").select(
        "column_name", "rows", "nulls", "min_value", "max_value", close.alias("distinct_is_close")
    )


@query(
    "e7_freshness",
    """SELECT max(ts) AS newest, max(ts) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOURS AS is_fresh
       FROM events""",
)
def freshness(spark, sf_dir):
    return r.freshness(table(spark, sf_dir, "events"), "ts", "2024-01-31 00:00:00", "24 HOURS")
