import pytest
from helpers import rows
from pyspark.sql import functions as F

from concordat.operators.joins import keyed_join, one_row_per_key


def facts(spark, n=6000):
    """A third of the rows has one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 200)
    return spark.range(n).select("id", key.alias("k"), F.repeat(F.lit("x"), 50).alias("pad"))


def directory(spark):
    return spark.range(300).where("id % 5 <> 0").select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_and_hashed_joins_equal_the_plain_one(spark, how):
    plain = rows(facts(spark).join(directory(spark), ["k"], how).select("id", "k"))
    for salts in (1, 5):
        joined = keyed_join(facts(spark), directory(spark), ["k"], how, salts)
        assert rows(joined, "id", "k") == plain
    assert rows(keyed_join(facts(spark), directory(spark), ["k"], how, unique_facts=True), "id", "k") == plain


def test_hot_keys_are_split_even_against_an_aggregated_directory(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    names = one_row_per_key(
        directory(spark).withColumn("key", F.col("k")), {"k": F.col("key")}, ["name"], ["name"]
    )
    for how in ("left", "left_semi", "left_anti"):
        joined = keyed_join(facts(spark).repartition(8, "id"), names, ["k"], how)
        expected = facts(spark).join(directory(spark), ["k"], how).count()
        assert len(joined.collect()) == expected
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "skew=true" in plan, plan


def test_null_keys_are_spread_and_match_nothing(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__coalescePartitions__enabled="false",
         spark__sql__shuffle__partitions="8")
    users = spark.range(4000).select("id", F.when(F.col("id") % 5 == 0, F.lit("a")).alias("k"))
    names = spark.createDataFrame([("a", "x"), (None, "y")], "k string, name string")
    joined = keyed_join(users, names, ["k"])
    assert joined.where("name = 'x'").count() == 800 and joined.where("name IS NULL").count() == 3200
    sizes = [n for (n,) in rows(joined.groupBy(F.spark_partition_id()).count(), "count")]
    assert len(sizes) == 8 and max(sizes) < 1600


def test_first_row_per_key_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 1, "y"), ("b", 2, "x"), ("b", 1, "w")], "key string, seq int, v string")
    for parts in (1, 3):
        got = one_row_per_key(df.repartition(parts), {"key": F.col("key")}, ["v"], ["seq"])
        assert rows(got) == [("a", "y"), ("b", "w")]


def test_a_directory_that_grows_is_not_broadcast_by_the_size_of_its_files(spark):
    facts = spark.createDataFrame([(i, i % 5) for i in range(20)], "id int, k int")
    directory = spark.createDataFrame([(i, str(i)) for i in range(5)], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = keyed_join(facts, directory, ["k"], how, merge=True)
        assert joined.count() == (0 if how == "left_anti" else 20)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
