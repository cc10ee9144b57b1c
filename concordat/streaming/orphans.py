"""Early updates as a side output of the status log's stream.

An update is early while no creation of its task with a smaller sequence number has been
seen.  The stream emits every early update at once, as an orphan, and keeps its sequence
number in the state.  When a creation comes that is older than kept updates, they
are no orphans after all: the stream takes them back and forgets them.  A task's earliest
creation only ever gets earlier, so nothing taken back can become an orphan again, and what
was emitted less what was taken back is, after every micro-batch and for any order of arrival,
what ``orphan_updates`` gives for the log so far.

State lies in RocksDB by pages, each of the tasks of a hash: a page's earliest creations, and a
list of its early sequence numbers, which is read only when a creation comes for a task that has
some.  A call into Python costs as much as thousands of rows, so tasks do not have one each.
``shares`` deals the updates of a task over so many states, each of which sees every creation
of the task; a task with a third of the log is then not one task's work.

Rows travel to and from the state as Arrow tables in bytes, one for the rows of a page, and are
folded as columns.  Nowhere are the rows of a micro-batch held together.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from concordat.operators.joins import keyed_join
from concordat.session import STREAMING_SETTINGS

_CHUNK = 10_000
_BUFFER = 8 << 20  # bytes of rows that are put together by page
_BLOCK = 1 << 20  # early updates in one element of a page's list
_LATEST = np.iinfo(np.int64).max


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _table(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def _array(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _mask(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.to_numpy()


def _pack_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page and share, with its rows in bytes; a buffer of rows at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= _BUFFER:
            yield _by_page(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield _by_page(pa.Table.from_batches(held))


def _by_page(table: pa.Table) -> pa.RecordBatch:
    page, share = (table[c].to_numpy() for c in ("__page", "__share"))
    order = np.lexsort((share, page))
    page, share = page[order], share[order]
    starts = np.flatnonzero(np.diff(page, prepend=-1) | np.diff(share, prepend=-1)) if len(order) else order
    events = table.drop_columns(["__page", "__share"]).take(pa.array(order)).combine_chunks()
    packed = [_packed(events.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(page[starts]), pa.array(share[starts]), pa.array(packed, pa.binary())], ["__page", "__share", "packed"]
    )


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for packed in batch.column(0):
            held.append(_table(packed.as_py()))
            size += len(held[-1])
            if size >= _CHUNK:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


class _Page:
    """Tasks with their earliest creations and whether any of their updates are kept as early.

    ``created_at`` and ``early_at`` are when that was written last, or -1 where there is none.
    """

    def __init__(self, packed: bytes | None, now: int, ttl_ms: int | None) -> None:
        self.ids: pa.Array | None = None
        self.created = np.zeros(0, np.int64)
        self.created_at, self.early_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if packed is not None:
            table = _table(packed)
            self.ids = _array(table, "task_id")
            self.created, self.created_at, self.early_at = (table[c].to_numpy().copy() for c in ("created", "created_at", "early_at"))
            if ttl_ms is not None:
                self.created_at[self.created_at + ttl_ms <= now] = -1
                self.early_at[self.early_at + ttl_ms <= now] = -1
                self.created[self.created_at < 0] = _LATEST
        self.before = self.created.copy(), self.created_at.copy(), self.early_at.copy()

    def find(self, ids: pa.Array) -> np.ndarray:
        """Where tasks stand in the page, -1 if they do not."""
        return pc.index_in(ids, value_set=self.ids).fill_null(-1).to_numpy().astype(np.int64)

    def place(self, ids: pa.Array) -> np.ndarray:
        """Where tasks stand in the page; those that did not stand there do now."""
        self.ids = ids.slice(0, 0) if self.ids is None else self.ids
        coded = ids.dictionary_encode()
        at = self.find(coded.dictionary)
        new = at < 0
        if new.any():
            at[new] = len(self.ids) + np.arange(new.sum())
            self.ids = pa.concat_arrays([self.ids, coded.dictionary.filter(pa.array(new))])
            grow = lambda values, value: np.concatenate([values, np.full(new.sum(), value, np.int64)])
            self.created, self.created_at, self.early_at = grow(self.created, _LATEST), grow(self.created_at, -1), grow(self.early_at, -1)
            self.before = grow(self.before[0], _LATEST), grow(self.before[1], -1), grow(self.before[2], -1)
        return at[coded.indices.to_numpy()]

    def earlier(self) -> np.ndarray:
        """Tasks whose earliest creation came in this micro-batch."""
        return (self.created_at >= 0) & ((self.before[1] < 0) | (self.created != self.before[0]))

    def changed(self) -> bool:
        now = self.created, self.created_at, self.early_at
        return any((a != b).any() for a, b in zip(now, self.before, strict=True))

    def packed(self) -> bytes | None:
        known = (self.created_at >= 0) | (self.early_at >= 0)
        if not known.any():
            return None
        columns = [pa.array(x[known]) for x in (self.created, self.created_at, self.early_at)]
        return _packed(pa.table([self.ids.filter(pa.array(known)), *columns], ["task_id", "created", "created_at", "early_at"]))


class EarlyUpdates(StatefulProcessor):
    """Emits early updates (``taken_back`` false) and takes back those a creation turns out to precede."""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tasks = handle.getValueState("tasks", "packed binary", self._ttl_ms)
        self._early = handle.getListState("early", "packed binary", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self._ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        stored = self._tasks.get()
        page = _Page(None if stored is None else stored[0], now, self._ttl_ms)
        kept, schema = [], None
        for packed in (p for chunk in rows for p in chunk["packed"]):
            events = _table(packed)
            schema = events.schema
            early = self._fold(page, events, now, kept)
            if early.any():
                side = events.filter(pa.array(early))
                yield _row(side.append_column("taken_back", pa.array(np.zeros(len(side), bool))))
        for at in self._resolved(page, kept, now):
            columns = [at[f.name].cast(f.type) if f.name in at.column_names else pa.nulls(len(at), f.type) for f in schema]
            yield _row(pa.table(columns, names=schema.names).append_column("taken_back", pa.array(np.ones(len(at), bool))))
        if page.changed():
            left = page.packed()
            self._tasks.clear() if left is None else self._tasks.update((left,))

    def _fold(self, page: _Page, events: pa.Table, now: int, kept: list[pa.Table]) -> np.ndarray:
        """Creations into the page; which updates are early, of which those of a task are added to ``kept``."""
        ids, seq = _array(events, "task_id"), _array(events, "seq")
        known, has_seq = _mask(ids.is_valid()), _mask(seq.is_valid())
        seqs = seq.fill_null(0).to_numpy()
        is_create = _mask(pc.equal(events["op"], "create"))
        at = np.full(len(events), -1)
        if known.any():
            at[known] = page.place(ids.filter(pa.array(known)))
            creates = is_create & known & has_seq
            before = page.created.copy(), page.created_at.copy()
            np.minimum.at(page.created, at[creates], seqs[creates])
            page.created_at[at[creates]] = np.where(page.created_at[at[creates]] < 0, now, page.created_at[at[creates]])
            page.created_at[(page.created != before[0]) & (before[1] >= 0)] = now
        early = ~is_create & ~known  # a missing id names no task: its updates are orphans for good
        updates = np.flatnonzero(~is_create & known)
        place = at[updates]
        early[updates] = (page.created_at[place] < 0) | (has_seq[updates] & (seqs[updates] < page.created[place]))
        keep = pa.array(early & known)
        if (early & known).any():
            kept.append(_early(ids.filter(keep), seq.filter(keep), np.full(int((early & known).sum()), now, np.int64)))
        return early

    def _resolved(self, page: _Page, kept: list[pa.Table], now: int) -> Iterator[pa.Table]:
        """Early updates that come after a creation; the others are kept in the list of the page."""
        earlier = page.earlier()
        again = bool((earlier & (page.early_at >= 0)).any())
        if again:
            kept = [*(_table(x[0]) for x in self._early.get()), *kept]
        if not kept:
            return
        early = pa.concat_tables(kept).combine_chunks()
        at, written = page.find(_array(early, "task_id")), early["written"].to_numpy().copy()
        seq = _array(early, "seq")
        moved = earlier[at] & (at >= 0)
        known = np.ones(len(early), bool) if self._ttl_ms is None else written + self._ttl_ms > now
        gone = known & moved & (~_mask(seq.is_valid()) | (seq.fill_null(0).to_numpy() >= page.created[at]))
        still = known & ~gone
        written[moved] = now
        page.early_at[earlier] = -1
        there = still & (at >= 0)
        np.maximum.at(page.early_at, at[there], written[there])
        left = _early(_array(early, "task_id"), seq, written).filter(pa.array(still))
        blocks = [(_packed(left.slice(x, _BLOCK)),) for x in range(0, len(left), _BLOCK)]
        if not again:
            for block in blocks:
                self._early.appendValue(block)
        elif blocks:
            self._early.put(blocks)
        else:
            self._early.clear()
        if gone.any():
            back = early.select(["task_id", "seq"]).filter(pa.array(gone))
            for x in range(0, len(back), _BLOCK):
                yield back.slice(x, _BLOCK)

    def close(self) -> None:
        pass


def _early(ids: pa.Array, seq: pa.Array, written: np.ndarray) -> pa.Table:
    return pa.table([ids, seq, pa.array(written)], ["task_id", "seq", "written"])


def _row(table: pa.Table) -> pd.DataFrame:
    return pd.DataFrame({"packed": [_packed(table)]})


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query takes its state store from the session when it starts."""
    before = {k: spark.conf.get(k, None) for k in STREAMING_SETTINGS}
    for key, value in STREAMING_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def orphan_stream(
    log: DataFrame,
    target: str,
    checkpoint: str,
    continuous: bool = False,
    interval: str = "10 seconds",
    shares: int = 1,
    ttl_ms: int | None = None,
    pages: int = 128,
) -> StreamingQuery:
    """Write the side output of a log's stream; ``orphans_so_far`` reads it.

    Each micro-batch writes a folder of its own, which a retry overwrites.  ``shares`` and
    ``pages`` are fixed for the life of a checkpoint; a micro-batch reads the pages of its tasks, so
    more pages suit small micro-batches among many tasks.  ``ttl_ms`` lets go of what the state knows of a
    task after so long without a write; an update emitted before that stays an orphan.
    """
    share = F.pmod(F.xxhash64("seq"), F.lit(shares)).cast("int")
    every = F.when(F.col("op") == "create", F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(share))
    of_task = F.when(F.col("task_id").isNull(), F.xxhash64("seq")).otherwise(F.xxhash64("task_id"))
    dealt = (
        log.where(F.col("op").isin("create", "update"))
        .withColumn("__share", F.explode(every)).withColumn("__page", F.pmod(of_task, F.lit(pages)).cast("int"))
    )
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in log.schema], T.StructField("taken_back", T.BooleanType())])
    packed = dealt.repartition("__page", "__share").mapInArrow(_pack_pages, "__page int, __share int, packed binary")
    side = packed.groupBy("__page", "__share").transformWithStateInPandas(
        EarlyUpdates(ttl_ms), T.StructType([T.StructField("packed", T.BinaryType())]), "append",
        "None" if ttl_ms is None else "ProcessingTime",
    ).mapInArrow(_unpack, schema)

    def write_version(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    writer = side.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write_version)
    trigger = {"processingTime": interval} if continuous else {"availableNow": True}
    with _state_on_disk(log.sparkSession):
        return writer.trigger(**trigger).start()


def orphans_so_far(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The updates that are orphans as of the last micro-batch, in the columns of the log."""
    try:
        side = spark.read.parquet(target)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":  # no micro-batch yet
            return spark.createDataFrame([], schema)
        raise
    side = side.withColumn("__seq", F.coalesce("seq", F.lit(0))).withColumn("__no_seq", F.col("seq").isNull())
    at = ["task_id", "__seq", "__no_seq"]
    return keyed_join(side.where("NOT taken_back"), side.where("taken_back").select(*at), at, "left_anti").select(*schema.names)
