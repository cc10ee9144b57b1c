import io
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml
from helpers import rows

from concordat.sources import documents
from concordat.sources.catalog import database_inventory, inventory_rows
from concordat.sources.footers import folder_inventory

COLUMNS = ["table_name", "pos", "column_name", "type_name", "type_precision", "type_scale", "comment", "problem"]


def test_footers_of_a_thousand_tables(spark, tmp_path):
    for i in range(1000):
        schema = pa.schema([("id", pa.int64()), (f"c{i % 7}", pa.decimal128(10, i % 7)), ("tags", pa.list_(pa.string()))])
        pq.write_table(schema.empty_table(), f"{tmp_path}/t{i:04d}.parquet")
    found = folder_inventory(spark, str(tmp_path), prefix="lake.", tables_per_partition=60)
    assert found.rdd.getNumPartitions() == 17
    expected = []
    for i in range(1000):
        name = f"lake.t{i:04d}"
        expected += [(name, 0, "id", "BIGINT", None, None, None, None), (name, 1, f"c{i % 7}", f"DECIMAL(10,{i % 7})", 10, i % 7, None, None)]
        expected += [(name, 2, "tags", "ARRAY<STRING>", None, None, None, None)]
    assert rows(found, *COLUMNS) == sorted(expected, key=repr)


def test_footers_of_written_folders(spark, tmp_path):
    df = spark.sql("SELECT CAST(1 AS SMALLINT) AS a, CAST('x' AS STRING) AS b, DATE'2024-01-01' AS d, 7 AS year, 'de' AS land")
    described = df.withMetadata("b", {"comment": "what b is", "__CHAR_VARCHAR_TYPE_STRING": "varchar(5)"})
    described.write.partitionBy("year", "land").parquet(f"{tmp_path}/parts")
    df.select("a").where("a > 1").write.parquet(f"{tmp_path}/plain")
    (tmp_path / "nothing").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "broken.parquet").write_bytes(b"no footer")
    (tmp_path / "notes.txt").write_text("not a table")
    found = {tuple(r) for r in folder_inventory(spark, str(tmp_path)).select(*COLUMNS).collect()}
    plain = {r for r in found if r[0] != "broken"}
    assert plain == {
        ("parts", 0, "a", "SMALLINT", None, None, None, None), ("parts", 1, "b", "VARCHAR(5)", None, None, "what b is", None),
        ("parts", 2, "d", "DATE", None, None, None, None), ("parts", 3, "year", "INT", None, None, None, None),
        ("parts", 4, "land", "STRING", None, None, None, None), ("plain", 0, "a", "SMALLINT", None, None, None, None),
        ("nothing", *[None] * 6, "no data file"),
    }
    (broken,) = found - plain
    assert broken[0] == "broken" and broken[-1].startswith("unreadable: ")
    scanned = spark.read.parquet(f"{tmp_path}/parts").schema
    assert sorted((r[1], r[2], r[3]) for r in found if r[0] == "parts") == sorted(
        (pos, name, type_name) for _, pos, name, type_name, *_ in inventory_rows("parts", scanned)
    )


def test_inventory_of_a_database_opens_no_table(spark, monkeypatch):
    spark.sql("CREATE DATABASE estate")
    try:
        for i in range(30):
            spark.sql(f"CREATE TABLE estate.t{i} (id BIGINT COMMENT 'key', price DECIMAL(9,{i % 5}), note VARCHAR(7)) USING parquet")
        spark.sql("CREATE VIEW estate.v AS SELECT id, price AS cost FROM estate.t3")
        spark.sql("CREATE TEMPORARY VIEW passing AS SELECT 1 AS x")
        monkeypatch.setattr(type(spark.read), "table", lambda *_: pytest.fail("a table was opened"))
        found = rows(database_inventory(spark, "estate"), "table_name", "pos", "column_name", "type_name", "type_scale", "comment")
    finally:
        monkeypatch.undo()
        spark.sql("DROP DATABASE estate CASCADE")
    expected = [("estate.v", 0, "id", "BIGINT", None, "key"), ("estate.v", 1, "cost", "DECIMAL(9,3)", 3, None)]
    for i in range(30):
        name = f"estate.t{i}"
        expected += [(name, 0, "id", "BIGINT", None, "key"), (name, 1, "price", f"DECIMAL(9,{i % 5})", i % 5, None)]
        expected += [(name, 2, "note", "VARCHAR(7)", None, None)]
    assert found == sorted(expected, key=repr)


def split_documents(data):
    """The documents of a file, by lines."""
    out, place, head = [], 0, True
    lines, at = [], 0
    for line in data.splitlines(keepends=True):
        if line.startswith(b"---") and (len(line) == 3 or line[3:4] in b" \t\r\n"):
            if not head or any(x.strip() and not x.strip().startswith(b"#") and not x.startswith(b"%") for x in lines):
                out.append((place, b"".join(lines)))
            place, head, lines = at, False, [line[3:]]
        else:
            lines.append(line)
        at += len(line)
    if not head or any(x.strip() and not x.strip().startswith(b"#") and not x.startswith(b"%") for x in lines):
        out.append((place, b"".join(lines)))
    return out


@pytest.mark.parametrize("chunk", [3, 7, 1 << 20])
def test_ranges_hold_every_document_once(monkeypatch, chunk):
    monkeypatch.setattr(documents, "_CHUNK", chunk)
    rng = random.Random(chunk)
    lines = [b"---\n", b"--- {a: 1}\n", b"a: 1\n", b"# note\n", b"\n", b"----\n", b" ---\n", b"---x\n", b"---\r\n", b"%YAML 1.2\n", b"b: long text over here\n", b"---"]
    for _ in range(150):
        data = b"".join(rng.choice(lines) for _ in range(rng.randrange(14)))
        data = data.replace(b"---" + b"---", b"---\n---").rstrip(b"\n") if rng.random() < 0.3 else data
        expected = [(p, t.rstrip(b"\n")) for p, t in split_documents(data)]
        for size in (1, 2, 5, 11, 1000):
            found = []
            for start in range(0, len(data), size):
                found += documents.documents(io.BytesIO(data), start, min(len(data), start + size))
            assert [(p, t.rstrip(b"\n")) for p, t in found] == expected, (data, size)


def test_documents_of_a_folder(spark, tmp_path):
    for i in range(4):
        text = "".join(f"---\nname: d{i}-{j}\nnote: {'é' * j}\n" for j in range(50 * i))
        (tmp_path / f"f{i}.yaml").write_text(text)
    (tmp_path / "_log").write_text("---\nnot: read\n")
    found = documents.read_documents(spark, str(tmp_path), range_bytes=1000)
    assert found.rdd.getNumPartitions() > 10
    names = [yaml.safe_load(r["descriptor"])["name"] for r in found.collect()]
    assert sorted(names) == sorted(f"d{i}-{j}" for i in range(4) for j in range(50 * i))
    assert found.select("source", "place").distinct().count() == 300


def test_stream_of_documents_goes_on_after_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()

    def run(stop_in_batch=None):
        stream = documents.follow_documents(spark, str(source), f"{tmp_path}/log", range_bytes=200)

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if number == stop_in_batch:
                raise RuntimeError("stopped")

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()

    def add(i):
        (source / f"f{9 - i}.yaml").write_text("".join(f"---\nname: d{i}-{j}\n" for j in range(30)))

    add(0)
    run()
    run()  # nothing new
    add(1)
    add(2)
    with pytest.raises(Exception, match="stopped"):
        run(stop_in_batch=1)
    add(3)
    run()  # the stopped batch again
    run()
    columns = ["source", "place", "descriptor"]
    assert rows(spark.read.parquet(out), *columns) == rows(documents.read_documents(spark, str(source)), *columns)
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
