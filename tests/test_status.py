import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from helpers import rows

from concordat.operators.status import fold_status, orphan_updates
from concordat.schemas import STATUS_EVENT
from concordat.session import STREAMING_SETTINGS
from concordat.streaming.orphans import EarlyUpdates, _packed, _table, orphan_stream, orphans_so_far
from concordat.streaming.projection import publish_stream
from concordat.streaming.status import fold_status_stream, latest_status, stream_creations, versions_to_read


def log(spark, *events):
    return spark.createDataFrame(list(events), STATUS_EVENT)


def test_create_then_update(spark):
    created = ("t", 1, "create", None, None, None)
    assert rows(fold_status(log(spark, created))) == [("t", "RUNNING", "", None)]
    done = log(spark, created, ("t", 2, "update", "COMPLETED", "Success", "{}"))
    assert rows(fold_status(done)) == [("t", "COMPLETED", "Success", "{}")]


def test_empty_values_do_not_overwrite(spark):
    df = log(
        spark, ("t", 1, "create", None, None, None), ("t", 2, "update", "FAILED", "why", "i"), ("t", 3, "update", "", None, ""),
    )
    assert rows(fold_status(df)) == [("t", "FAILED", "why", "i")]


def test_unknown_and_early_updates_are_orphans(spark):
    early = ("t", 1, "update", "FAILED", "early", "early")
    never = ("u", 5, "update", "COMPLETED", "x", None)
    df = log(spark, early, ("t", 2, "create", None, None, None), never)
    assert rows(fold_status(df)) == [("t", "RUNNING", "", None)]
    assert rows(orphan_updates(df), "task_id", "seq") == [("t", 1), ("u", 5)]


def replay(events):
    """The fold written as a loop over the log."""
    state, orphans = {}, []
    for task, seq, op, status, result, info in sorted(events, key=lambda e: e[1]):
        if op == "create":
            if task in state:
                state[task]["status"] = "RUNNING"
            else:
                state[task] = {"status": "RUNNING", "result": "", "info": None}
        elif task not in state:
            orphans.append((task, seq))
        else:
            for field, value in (("status", status), ("result", result), ("info", info)):
                if value:
                    state[task][field] = value
    return sorted((t, s["status"], s["result"], s["info"]) for t, s in state.items()), sorted(orphans)


def random_events(n=3000, tasks=40, seed=3):
    rng = random.Random(seed)
    events = []
    for seq in range(n):
        # A third of the log belongs to one task.
        task = "hot" if rng.random() < 0.33 else f"t{rng.randrange(tasks)}"
        op = "create" if rng.random() < 0.05 else "update"
        pick = lambda *v: rng.choice(v)
        events.append((task, seq, op, pick(None, "", "COMPLETED", "FAILED"), pick(None, "", f"r{seq}"), pick(None, "", f"i{seq}")))
    rng.shuffle(events)
    return events


def test_fold_equals_a_replay(spark):
    events = random_events()
    df = log(spark, *events).repartition(5)
    folded, orphans = replay(events)
    assert sorted(map(tuple, fold_status(df).collect()), key=repr) == sorted(folded, key=repr)
    assert rows(orphan_updates(df), "task_id", "seq") == sorted(orphans, key=repr)


@pytest.mark.parametrize("settings", [{}, STREAMING_SETTINGS], ids=["default", "rocksdb"])
def test_stream_equals_batch_over_several_batches_and_runs(spark, conf, tmp_path, settings):
    conf(**{k.replace(".", "__"): v for k, v in settings.items()})
    events = sorted(random_events(), key=lambda e: e[1])
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    seen, orphans = [], []
    for i in range(3):
        chunk = events[i * 1000 : (i + 1) * 1000]
        seen += chunk
        log(spark, *chunk).write.mode("append").parquet(source)
        stream = spark.readStream.schema(STATUS_EVENT).option("maxFilesPerTrigger", 2).parquet(source)
        fold_status_stream(stream, target, checkpoint, compact_every=2).awaitTermination()
        expected, orphans = replay(seen)
        assert rows(latest_status(spark, target)) == sorted(expected, key=repr)
    late = orphan_updates(log(spark, *seen), stream_creations(spark, target))
    assert rows(late, "task_id", "seq") == sorted(orphans, key=repr)
    versions = {r["version"] for r in spark.read.parquet(f"{target}/versions").select("version").distinct().collect()}
    last_mark = spark.read.parquet(f"{target}/marks").agg({"mark": "max"}).first()[0]
    assert len(versions) > 3 and last_mark > 1
    read = versions_to_read(spark, target)
    assert read.agg({"version": "min"}).first()[0] == last_mark
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan  # older folders are pruned, not read


def test_streamed_projection_continues_where_it_stopped(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for start in (0, 50):
        spark.range(start, start + 50).selectExpr("id", "id * 2 AS twice", "'x' AS other").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, twice bigint, other string").parquet(source)
        publish_stream(stream, ["twice", "id"], target, checkpoint).awaitTermination()
    out = spark.read.parquet(target)
    assert out.columns == ["twice", "id"] and rows(out, "id") == sorted([(i,) for i in range(100)], key=repr)


def test_continuous_publication_runs_until_stopped(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    stream = spark.readStream.schema("id bigint").parquet(source)
    query = publish_stream(stream, None, str(tmp_path / "out"), str(tmp_path / "check"), continuous=True, interval="1 second")
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def run_orphans(spark, folder, shares=3, **options):
    stream = spark.readStream.schema(STATUS_EVENT).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = orphan_stream(stream, f"{folder}/side", f"{folder}/check", shares=shares, **options)
    query.awaitTermination()


@pytest.mark.parametrize("shares", [1, 3])
def test_side_output_equals_the_batch_after_every_run(spark, tmp_path, shares):
    """Arrival in any order: creations come after updates that are younger than they are."""
    events = random_events(1500, tasks=12)
    for i in range(3):
        log(spark, *events[i * 500 : (i + 1) * 500]).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        run_orphans(spark, tmp_path, shares)
        seen = log(spark, *events[: (i + 1) * 500])
        assert rows(orphans_so_far(spark, f"{tmp_path}/side", STATUS_EVENT)) == rows(orphan_updates(seen))
    side = spark.read.parquet(f"{tmp_path}/side")
    assert side.where("taken_back").count() > 0 and side.select("version").distinct().count() > 3


def test_side_output_after_a_stop_inside_a_batch(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    write, failed = DataFrameWriter.parquet, []

    def stop_after_writing(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        if path.endswith("/side/version=1") and not failed:
            failed.append(path)
            raise RuntimeError("stopped")

    events = random_events(900, tasks=9, seed=8)
    for i in range(3):
        log(spark, *events[i * 300 : (i + 1) * 300]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(DataFrameWriter, "parquet", stop_after_writing)
    with pytest.raises(Exception, match="stopped"):
        run_orphans(spark, tmp_path)
    run_orphans(spark, tmp_path)
    assert failed and rows(orphans_so_far(spark, f"{tmp_path}/side", STATUS_EVENT)) == rows(orphan_updates(log(spark, *events)))


def test_side_output_of_odd_rows(spark, tmp_path):
    """Tasks without id, repeated rows, other operations, a creation that comes earlier still, and no rows at all."""
    assert orphans_so_far(spark, f"{tmp_path}/side", STATUS_EVENT).count() == 0
    batches = [
        [(None, 1, "create", None, None, None), (None, 2, "update", "FAILED", "", ""), *[("t", 5, "update", "x", None, None)] * 2, ("t", 6, "other", None, None, None)],
        [("t", 7, "create", None, None, None), ("t", 3, "update", "y", "", ""), ("u", 9, "update", None, None, None)],
        [("t", 4, "create", None, None, None), ("u", 9, "create", None, None, None)],
    ]
    seen = []
    for batch in batches:
        seen += batch
        log(spark, *batch).write.mode("append").parquet(f"{tmp_path}/in")
        run_orphans(spark, tmp_path)
        assert rows(orphans_so_far(spark, f"{tmp_path}/side", STATUS_EVENT)) == rows(orphan_updates(log(spark, *seen)))
    assert {r["task_id"] for r in orphans_so_far(spark, f"{tmp_path}/side", STATUS_EVENT).collect()} == {None, "t"}


def test_side_output_has_a_state_for_a_page_of_tasks(spark, tmp_path):
    """Calls into Python and rows of state are bounded by the pages, however many the tasks; without this, 900 tasks had 900."""
    events = [e for t in range(900) for e in ((f"t{t}", 3 * t + 1, "update", "x", "", ""), (f"t{t}", 3 * t + t % 3, "create", None, None, None))]
    random.Random(5).shuffle(events)
    for i in range(2):
        log(spark, *events[i * 900 : (i + 1) * 900]).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(STATUS_EVENT).parquet(f"{tmp_path}/in")
        query = orphan_stream(stream, f"{tmp_path}/side", f"{tmp_path}/check", shares=2, pages=8)
        query.awaitTermination()
        seen = orphan_updates(log(spark, *events[: (i + 1) * 900]))
        assert rows(orphans_so_far(spark, f"{tmp_path}/side", STATUS_EVENT)) == rows(seen) and seen.count() > 200
        kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        assert kept and 0 < max(kept) <= 3 * 8 * 2  # a value, a list and its counter for each page and share
    assert spark.read.parquet(f"{tmp_path}/side").where("taken_back").count() > 100


def test_side_output_of_ids_that_are_numbers_and_of_rows_without_seq(spark, tmp_path):
    numbers = "task_id bigint, seq bigint, op string, status string, result string, info string"
    batches = [
        [(1, 5, "update", "x", None, None), (1, None, "update", "y", None, None), (2, None, "create", None, None, None), (2, 3, "update", "z", None, None)],
        [(1, 4, "create", None, None, None), (None, 1, "update", "a", None, None), (1, None, "update", "b", None, None)],
        [(2, 2, "create", None, None, None), (3, None, "update", None, None, None), (1, 1, "update", "c", "", "")],
    ]
    seen = []
    for batch in batches:
        seen += batch
        spark.createDataFrame(batch, numbers).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(numbers).parquet(f"{tmp_path}/in")
        orphan_stream(stream, f"{tmp_path}/side", f"{tmp_path}/check", shares=2, pages=2).awaitTermination()
        log_so_far = spark.createDataFrame(seen, numbers)
        assert rows(orphans_so_far(spark, f"{tmp_path}/side", log_so_far.schema)) == rows(orphan_updates(log_so_far))


SIDE = pa.schema([(f.name, pa.int64() if f.name == "seq" else pa.string()) for f in STATUS_EVENT])


class Kept:
    """A value or a list of a page's state, without a store."""

    def __init__(self):
        self.held = []

    def get(self):
        return iter(self.held) if self.is_list else (self.held[0] if self.held else None)

    def update(self, value):
        self.held = [value]

    def put(self, values):
        self.held = list(values)

    def appendValue(self, value):
        self.held.append(value)

    def clear(self):
        self.held = []


def test_side_output_lets_go_of_what_was_written_long_ago():
    """Neighbours of a page are let go of one by one; what is written again stays as long again."""
    names = [f.name for f in STATUS_EVENT]
    update = lambda task, seq: (task, seq, "update", "x", "", "")
    create = lambda task, seq: (task, seq, "create", None, None, None)
    steps = [
        (0, [update("t", 5), update("u", 5), create("v", 1)], [("t", 5, False), ("u", 5, False)]),
        (60, [update("u", 6), update("v", 9), create("w", 3)], [("u", 6, False)]),
        # the creation of v and the first updates were written 100 ms ago
        (100, [create("t", 4), create("u", 4), update("v", 10), update("w", 7)], [("u", 6, True), ("v", 10, False)]),
        (190, [update("t", 8), update("w", 7), create("v", 2)], [("v", 10, True), ("w", 7, False)]),
        (200, [update("t", 8), update("v", 8)], [("t", 8, False)]),
    ]
    for ttl_ms in (100, None):
        page = EarlyUpdates(ttl_ms)
        page._tasks, page._early = Kept(), Kept()
        page._tasks.is_list, page._early.is_list = False, True
        for now, events, expected in steps:
            packed = _packed(pa.table({n: [e[i] for e in events] for i, n in enumerate(names)}, SIDE))
            timer = SimpleNamespace(getCurrentProcessingTimeInMs=lambda now=now: now)
            side = [r for out in page.handleInputRows((0, 0), iter([pd.DataFrame({"packed": [packed]})]), timer) for r in _table(out["packed"][0]).to_pylist()]
            if ttl_ms:
                assert sorted((r["task_id"], r["seq"], r["taken_back"]) for r in side) == expected, now
    assert not page._early.held  # without a limit all were taken back
