import pytest
from helpers import rows

from concordat.streaming.versions import breaking_changes, publish_versions, published_rows


def add(spark, folder, start):
    df = spark.range(start, start + 10).selectExpr("CAST(id AS INT) AS id", "concat('n', id) AS name", "id * 2 AS twice")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def publish(spark, folder, columns, expression=None):
    stream = spark.readStream.schema("id INT, name STRING, twice BIGINT").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream = stream if expression is None else stream.withColumn("id", stream["id"].cast(expression))
    publish_versions(stream, columns, f"{folder}/out", f"{folder}/check").awaitTermination()


@pytest.mark.parametrize("stop_at", ["/rows/version=1", "/marks/mark=1"])
def test_a_stop_inside_a_batch_and_another_contract(spark, tmp_path, monkeypatch, stop_at):
    from pyspark.sql import DataFrameWriter

    write, failed = DataFrameWriter.parquet, []

    def stop_after(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        if path.endswith(stop_at) and not failed:
            failed.append(path)
            raise RuntimeError("stopped")

    contract = spark.createDataFrame([], "id BIGINT, name STRING, twice BIGINT").schema
    assert published_rows(spark, f"{tmp_path}/out", contract).count() == 0
    for start in (0, 10, 20):
        add(spark, tmp_path, start)
    monkeypatch.setattr(DataFrameWriter, "parquet", stop_after)
    with pytest.raises(Exception, match="stopped"):
        publish(spark, tmp_path, ["id", "name"])
    visible = published_rows(spark, f"{tmp_path}/out", contract)
    assert rows(visible, "id") == sorted([(i,) for i in range(10 if "rows" in stop_at else 20)], key=repr)
    publish(spark, tmp_path, ["id", "twice"], "bigint")  # the stopped batch again, and the rest, in another contract
    found = published_rows(spark, f"{tmp_path}/out", contract)
    expected = [(i, f"n{i}" if i < 10 else None, None if i < 10 else 2 * i) for i in range(30)]
    assert rows(found, "id", "name", "twice") == sorted(expected, key=repr)
    assert found.select("version").distinct().count() == 3


def test_a_contract_that_breaks_readers_is_refused(spark, tmp_path):
    add(spark, tmp_path, 0)
    publish(spark, tmp_path, ["id", "name"], "bigint")
    with pytest.raises(ValueError, match="id: bigint cannot become int"):
        publish(spark, tmp_path, ["id"])
    old, new = (spark.createDataFrame([], s).schema for s in ("a INT, b DATE, c STRING", "a BIGINT, b TIMESTAMP_NTZ, d INT"))
    assert breaking_changes(old, new) == [] and len(breaking_changes(new, old)) == 2
