"""Scalar functions on names, identifiers and timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import table
from checks.registry import query
from concordat.functions import names
from concordat.functions.maps import last_wins_map


@query(
    "p8_workspace_reference",
    """SELECT page_id, NOT regexp_matches(url, '^(?:https?://(?:[a-z]+\\.)?[a-z]+\\.example\\.(?:com|org)/[a-z]+/(\\d+))') AS is_managed,
              CASE WHEN regexp_matches(url, '^(?:https?://(?:[a-z]+\\.)?[a-z]+\\.example\\.(?:com|org)/[a-z]+/(\\d+))')
                   THEN regexp_extract(url, '^(?:https?://(?:[a-z]+\\.)?[a-z]+\\.example\\.(?:com|org)/[a-z]+/(\\d+))', 1) END AS workspace_id,
              CASE WHEN NOT regexp_matches(url, '^(?:https?://(?:[a-z]+\\.)?[a-z]+\\.example\\.(?:com|org)/[a-z]+/(\\d+))')
                   THEN url END AS workspace_name
       FROM pages""",
)
def workspace_reference(spark, sf_dir):
    pattern = r"https?://(?:[a-z]+\.)?[a-z]+\.example\.(?:com|org)/[a-z]+/(\d+)"
    found = names.workspace_reference("url", pattern)
    return table(spark, sf_dir, "pages").select("page_id", found.alias("w")).select("page_id", "w.*")


@query(
    "k8_qualified_names",
    """SELECT l_orderkey, concat('cat.', l_returnflag, '.t', CAST(l_partkey AS STRING)) AS plain,
              concat('`cat`.`', l_returnflag, '`.`t', CAST(l_partkey AS STRING), '`') AS quoted FROM lineitem""",
)
def qualified_names(spark, sf_dir):
    parts = [F.lit("cat"), F.col("l_returnflag"), F.concat(F.lit("t"), F.col("l_partkey"))]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        names.qualified_name(*parts).alias("plain"),
        names.quoted_name(*parts).alias("quoted"),
    )


@query(
    "k9_last_wins_map",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'a=' || o_custkey || ',b=2'
                               WHEN o_orderstatus = 'O' THEN 'a=1,b=2' ELSE '' END AS settings
       FROM orders""",
)
def settings_map(spark, sf_dir):
    def pair(key, value):
        return F.struct(F.lit(key).alias("name"), F.lit(value).cast("string").alias("value"))

    again = F.struct(F.lit("a").alias("name"), F.col("o_custkey").cast("string").alias("value"))
    entries = F.when(
        F.col("o_orderstatus") == "F", F.array(pair("a", 1), pair("b", 2), again)
    ).when(F.col("o_orderstatus") == "O", F.array(pair("a", 1), pair("b", 2)))
    pairs = F.array_sort(F.map_entries(last_wins_map(entries)))
    shown = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(shown, ",").alias("settings"))


@query(
    "k10_canonical_member",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machinery'
                              WHEN 'FURNITURE' THEN 'Furniture' END AS segment FROM customer""",
)
def canonical_member(spark, sf_dir):
    member = names.canonical_member("c_mktsegment", ["Building", "Machinery", "Furniture"])
    return table(spark, sf_dir, "customer").select("c_custkey", member.alias("segment"))


@query("k12_iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def iso_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", names.iso_millis_utc("ts").alias("iso"))
