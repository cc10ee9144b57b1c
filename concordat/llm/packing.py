"""Packing of documents into sequences of bounded length by their length histogram.

Documents are tokenized and cut: pieces of exactly the sequence length stand alone, what is
left of each document is one shorter piece.  Only the histogram of piece lengths, at most one
count per length up to the limit, reaches the driver.  There lengths are placed longest
first, each into the packs with the most room left (*shortest pack first*), as counts of
packing patterns.  Each pattern then takes its pieces of a length by their rank among all
pieces of that length.

Ranks come from counts per (length, slice) and their running sums, where a slice is a hash of
the document, so a length that a third of all pieces share is never gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.llm.common import batch, partitions, texts, work_folder, written
from concordat.llm.tokens import by_size, encoded
from concordat.operators.joins import keyed_join


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, pieces of it)]) that hold every piece exactly once.

    Lengths go longest first into the packs with the most room; what fits nowhere opens new
    packs.  Patterns are counts, so the work depends on the number of lengths, not of pieces.
    """
    room: dict[int, list[list]] = {}  # room left -> [times, {length: pieces}]

    def keep(left: int, times: int, pattern: dict[int, int]) -> None:
        room.setdefault(left, []).append([times, pattern])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length} does not fit into {size}")
        while todo:
            left = max((r for r in room if room[r]), default=0)
            if left < length:
                whole, rest = divmod(todo, size // length)
                # short pieces share new packs at once instead of one after another
                if whole:
                    keep(size - (size // length) * length, whole, {length: size // length})
                if rest:
                    keep(size - rest * length, 1, {length: rest})
                break
            times, pattern = room[left].pop()
            used = min(times, todo)
            keep(left - length, used, pattern | {length: pattern.get(length, 0) + 1})
            if used < times:
                keep(left, times - used, pattern)
            todo -= used
    return [(times, sorted(p.items(), reverse=True)) for left in sorted(room) for times, p in room[left]]


def _slots(patterns, first_sequence: int) -> dict[str, np.ndarray]:
    """For each length the ranks at which a pattern takes over, as sorted columns."""
    rows, taken, sequence = [], {}, first_sequence
    for times, pattern in patterns:
        offset = 0
        for length, pieces in pattern:
            at = taken.get(length, 0)
            rows.append((length, at, sequence, pieces, offset))
            taken[length] = at + times * pieces
            offset += length * pieces
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "pieces", "offset"), table.T))


def pieces_of(documents: DataFrame, tokenizer: str, size: int, end_id: int | None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, copy_of): the cut documents."""
    out = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("slice", pa.int64()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 1):
            rows = []
            for doc, slice_, ids in zip(
                b.column(0).to_pylist(), b.column(2).to_pylist(), encoded(texts(b.column(1)), tokenizer, end_id)
            ):
                for at in range(0, len(ids), size):
                    part = ids[at : at + size].astype("<u4")
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), slice_))
            if rows:
                yield batch(out, *(list(c) for c in zip(*rows)))

    chosen = documents.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("doc_id", "text").alias("slice")
    )
    return chosen.mapInArrow(
        work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slice long"
    )


def pack(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int | None = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece.

    ``start`` counts the document's ids before the piece, ``offset`` those before it in its
    sequence; sequences are numbered from 0 and filled without gaps.  Null texts count as
    empty: with an ``end_id`` they give a piece of one id, without one no piece.  Repeated rows
    are packed as often as they come.  Other columns are ignored; no rows give no sequences.
    """
    spark = documents.sparkSession
    folder = work_folder(spark)
    pieces = written(pieces_of(documents, tokenizer, size, end_id), folder, "pieces")
    slices = 4 * partitions(spark)
    short = pieces.where(F.col("length") < size).withColumn("slice", F.pmod("slice", F.lit(slices)).cast("int"))
    full = pieces.where(F.col("length") == size).withColumn("slice", F.pmod("slice", F.lit(slices)).cast("int"))

    def ranked(table: DataFrame) -> DataFrame:
        counts = table.groupBy("length", "slice").agg(F.count("*").alias("n"))
        before = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        first = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        order = W.partitionBy("length", "slice").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
        return keyed_join(table.withColumn("at", F.row_number().over(order) - 1), first, ["length", "slice"]).withColumn(
            "rank", F.col("first") + F.col("at")
        )

    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    alone = histogram.pop(size, 0)
    slots = _slots(pack_histogram(histogram, size), alone)

    out = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.int64(1) << np.int64(48)
        starts = slots["length"] * most + slots["rank"]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            at = np.searchsorted(starts, length * most + rank, side="right") - 1
            k = rank - slots["rank"][at]
            pieces_, nth = slots["pieces"][at], k % slots["pieces"][at]
            yield batch(
                out, *(b.column(i) for i in range(5)),
                slots["sequence"][at] + k // pieces_, slots["offset"][at] + nth * length,
            )

    shared = ranked(short).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    # whole sequences are counted through the same ranks: one length, many slices
    single = ranked(full).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return single.unionByName(shared)
