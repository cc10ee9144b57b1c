"""Exact top-k search by tiled matrix products.

Vectors are dealt into shards and queries into tiles by a hash of their ids, each one binary
matrix.  Every tile meets every shard; a task multiplies the two and keeps the best k of the
shard per query.  The lists of a query are then merged as a tree, ``fan`` lists at a time, so
no group holds more than ``fan * k`` rows, however many shards there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import batch, work_folder, written
from concordat.llm.scores import Scores, matrix, numbers, products, usable, whole_parts

def _matrices(vectors: DataFrame, size: int, n: int) -> DataFrame:
    """(width, block, ids, rows, numbers): about ``size`` vectors of one length in each row, by ascending id."""
    blocks = max(1, -(-n // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        ids, rows = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        order = np.lexsort((rows, ids))
        values = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        return pa.table({
            "width": pa.array([table.column("width")[0].as_py()], pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
            "rows": pa.array([rows[order].astype("<i8").tobytes()], pa.binary()),
            "numbers": pa.array([numbers(values)], pa.binary()),
        })

    return dealt.groupBy("width", "block").applyInArrow(pack, "width int, block int, ids binary, rows binary, numbers binary")


def best_of_shard(own: np.ndarray, q: np.ndarray, rows: np.ndarray, v: np.ndarray, k: int, step: int = 256):
    """(query, vector, score): places of each query's best k other rows; ties to the first vector."""
    out = []
    for at in range(0, len(own), step):
        scores = products(q[at : at + step], v)
        others = own[at : at + step, None] != rows[None]
        if scores.dtype == object:
            found = [[c for c in np.flatnonzero(o)] for o in others]
            found = [sorted(c, key=lambda j: (-s[j], j))[:k] for c, s in zip(found, scores)]
            who = np.repeat(np.arange(len(found)), [len(c) for c in found])
            col = np.array([j for c in found for j in c], int)
        else:
            # the k + 1 best hold the k best others; equal scores at the edge go by place
            n = min(k + 1, len(rows))
            edge = np.partition(scores, -n, axis=1)[:, -n, None]
            above, level = scores > edge, scores == edge
            keep = above | (level & (np.cumsum(level, axis=1) <= n - above.sum(axis=1, keepdims=True)))
            who, col = np.nonzero(keep & others)
            order = np.lexsort((col, -scores[who, col], who))
            who, col = who[order], col[order]
            first = np.searchsorted(who, np.arange(len(scores)))
            kept = np.arange(len(who)) - first[who] < k
            who, col = who[kept], col[kept]
        out.append((who + at, col, scores[who, col]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def search(
    embeddings: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0,
    shard: int = 8192, tile: int = 1024, fan: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products.

    Components become ``floor(scale * x)``.  Queries are the rows where ``is_query`` holds;
    candidates are all rows but the query's own; ties go to the smaller vec_id, and a query
    with fewer candidates gets them all.  Rows are told apart as rows: those that share a
    vec_id are candidates for each other, and each that is a query has a list of its own.
    Null and empty vectors, those with a null or non-finite component and rows without id take
    no part; vectors of different lengths are not compared.  Scores are exact: one that 64
    bits do not hold is ordered by its value and returned as null.

    A tile of queries is sent to every shard, so shards grow with the table: they hold
    ``shard`` rows or four times the square root of the rows, whichever is more, and at most
    64 MB of numbers.
    """
    folder = work_folder(embeddings.sparkSession)
    vectors = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.size("embedding").alias("width"),
        whole_parts(F.col("embedding"), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    vectors = written(vectors, folder, "vectors")
    count = vectors.agg(
        F.count("*").alias("n"), F.count_if("query").alias("q"), F.max("width").alias("width"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("largest"),
    ).first()
    width, n = count["width"] or 1, count["n"]
    scores = Scores(int(count["largest"] or 0), width)
    shard = min(max(shard, 4 * math.isqrt(n)), max(1, (8 << 20) // width))
    shards = written(_matrices(vectors.drop("query"), shard, n), folder, "shards")
    tiles = _matrices(vectors.where("query").drop("query"), tile, count["q"]).select(
        "width", F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"), F.col("numbers").alias("query_numbers"),
        F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // shard)) - 1))).alias("block"),
    )
    fields = [("query_row", pa.int64()), ("query_id", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("less", scores.arrow)]
    out = pa.schema(fields)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, *parts = (b.column(j)[i] for j in range(7))
                ids, rows, query_ids, query_rows = (np.frombuffer(parts[j].as_buffer(), "<i8") for j in (0, 1, 3, 4))
                v, q = matrix(parts[2].as_py(), len(ids)), matrix(parts[5].as_py(), len(query_ids))
                who, col, score = best_of_shard(query_rows, q, rows, v, k)
                yield batch(out, query_rows[who], query_ids[who], np.full(len(who), block.as_py()), ids[col], scores.column(-score))

    lists = (
        shards.join(tiles, ["width", "block"])
        .select("block", "ids", "rows", "numbers", "query_ids", "query_rows", "query_numbers")
        .mapInArrow(multiply, f"query_row long, query_id long, part int, vec_id long, less {scores.sql}")
    )
    left = max(1, -(-n // shard))
    while True:
        left = -(-left // fan)
        merged = lists.groupBy("query_row", "query_id", F.floor(F.col("part") / fan).cast("int").alias("part")).agg(
            F.slice(F.array_sort(F.collect_list(F.struct("less", "vec_id"))), 1, k).alias("best")
        )
        placed = merged.select("query_row", "query_id", "part", F.posexplode("best").alias("at", "b"))
        lists = placed.select("query_row", "query_id", "part", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.less")
        if left == 1:
            return lists.select("query_id", "rank", "vec_id", scores.as_long("less", -1).alias("score"))
