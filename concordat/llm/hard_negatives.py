"""Hard negatives by exact search in a multiway hyperplane tree.

A node of the tree has up to ``ways`` split points; a row goes to the nearest.  For every split
point and every sibling subtree the node keeps the range of the distances from that point to
the rows below that sibling.  A search for scores in a window is a search in an annulus around
the anchor: a subtree is left out once, for any split point, the distances that the annulus
allows and the range that is kept do not meet.  Leaves are searched exactly, by matrix products.

The tree is fitted on a bounded sample; ranges cover every row.  Tree and ranges go to the
tasks: their size follows from ``sample`` and ``ways``, never from the number of rows.  A leaf
is any number of blocks of about ``block`` rows, so a leaf that holds a third of all rows is
searched by many tasks.

Inner products are distances here by ``|x - q|**2 = |x|**2 + |q|**2 - 2 * score``; the nodes keep
the range of ``|x|**2`` of every subtree for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.llm.common import batch, pieces, work_folder, written
from concordat.llm.scores import Scores, matrix, numbers, products, usable, whole_parts

_SLACK = 1e-9  # of a distance, for rounding


class Node(NamedTuple):
    points: np.ndarray  # split points, one row each
    children: list  # per split point: the number of a leaf, or a Node
    number: int


class Tree(NamedTuple):
    """A tree over vectors of one length, its leaves and its nodes numbered from 0."""

    root: Node | int
    nodes: int
    leaves: int


def _square(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows to points."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * (x @ points.T), 0)


def grow(sample: np.ndarray, ways: int, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree whose leaves hold at most ``leaf`` rows of the sample, or equal ones only."""
    count = {"node": 0, "leaf": 0}

    def number(kind: str) -> int:
        count[kind] += 1
        return count[kind] - 1

    def below(rows: np.ndarray) -> Node | int:
        if len(rows) <= leaf:
            return number("leaf")
        # far from each other: of a few candidates always the one farthest from those taken
        some = rows[rng.permutation(len(rows))[: 3 * ways]]
        taken, gap = [0], _square(some, some[:1])[:, 0]
        while len(taken) < min(ways, len(some)) and gap.max() > 0:
            taken.append(int(gap.argmax()))
            gap = np.minimum(gap, _square(some, some[taken[-1:]])[:, 0])
        points = some[taken]
        nearest = _square(rows, points).argmin(axis=1)
        if len(taken) == 1 or len(np.unique(nearest)) == 1:
            return number("leaf")
        own = number("node")
        return Node(points, [below(rows[nearest == i]) for i in range(len(points))], own)

    root = below(sample)
    return Tree(root, count["node"], count["leaf"])


def descend(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, list]:
    """The leaf of every row, and (node, child, distances to the split points, squares) for every step."""
    leaf, steps = np.zeros(len(x), np.int32), []
    squares = (x * x).sum(1)

    def below(node: Node | int, rows: np.ndarray) -> None:
        if not isinstance(node, Node):
            leaf[rows] = node
            return
        d = _square(x[rows], node.points)
        nearest = d.argmin(axis=1)
        for child, under in enumerate(node.children):
            mine = nearest == child
            if mine.any():
                steps.append((node.number, child, np.sqrt(d[mine]), squares[rows[mine]]))
                below(under, rows[mine])

    below(tree.root, np.arange(len(x)))
    return leaf, steps


class Ranges:
    """Least and greatest distance per (node, child, split point), and of the squares in the last column."""

    def __init__(self, nodes: int, ways: int) -> None:
        self.low = np.full((nodes, ways, ways + 1), np.inf)
        self.high = np.full((nodes, ways, ways + 1), -np.inf)

    def add(self, steps: list) -> None:
        for node, child, d, squares in steps:
            n = d.shape[1]
            for out, best in ((self.low, np.minimum), (self.high, np.maximum)):
                reduced = best.reduce(np.concatenate([d, squares[:, None]], axis=1))
                # a distance that is no number tells nothing
                reduced = np.where(np.isnan(reduced), -np.inf if best is np.minimum else np.inf, reduced)
                out[node, child, :n] = best(out[node, child, :n], reduced[:n])
                out[node, child, -1] = best(out[node, child, -1], reduced[-1])


def reached(tree: Tree, ranges: Ranges, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(leaf, anchors) of every leaf that may hold a score in any of an anchor's windows.

    ``low`` and ``high`` are (anchors, windows); a window whose low is above its high is empty.
    """
    out, square = [], (q * q).sum(1)

    def below(node: Node | int, who: np.ndarray) -> None:
        if not len(who):
            return
        if not isinstance(node, Node):
            out.append((node, who))
            return
        n = len(node.points)
        lo, hi = ranges.low[node.number, :n], ranges.high[node.number, :n]
        filled = lo[:, -1] <= hi[:, -1]
        d = np.sqrt(_square(q[who], node.points))[:, None, None, :]  # anchors, windows, children, points
        with np.errstate(over="ignore", invalid="ignore"):
            outer = square[who][:, None, None] + hi[None, None, :, -1] - 2 * low[who][:, :, None]
            inner = square[who][:, None, None] + lo[None, None, :, -1] - 2 * high[who][:, :, None]
            slack = _SLACK * (square[who][:, None, None] + hi[None, None, :, -1])
            r2 = np.sqrt(np.maximum(outer + slack, 0))[..., None]
            r1 = np.sqrt(np.maximum(inner - slack, 0))[..., None]
            margin = _SLACK * (d + r2)
            apart = (d + r2 + margin < lo[:, :n]) | (np.maximum(d - r2, r1 - d) - margin > hi[:, :n])
            out_of_reach = apart.any(axis=3) | (outer + slack < 0) | (low[who] > high[who])[:, :, None] | ~filled
        alive = ~out_of_reach.all(axis=1)
        for child, under in enumerate(node.children):
            below(under, who[alive[:, child]])

    below(tree.root, np.arange(len(q)))
    return out


def best(scores: np.ndarray, fits: np.ndarray, low: list, high: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row among ``fits`` and from low to high; ties to the first column."""
    if scores.dtype == object or scores.shape[1] <= k:
        who, col = [], []
        for i, (row, lo, hi) in enumerate(zip(scores, low, high)):
            left = [j for j in np.flatnonzero(fits[i]) if (lo is None or row[j] >= lo) and (hi is None or row[j] <= hi)]
            left = sorted(left, key=lambda j: (-row[j], j))[:k]
            who, col = who + [i] * len(left), col + left
        return np.array(who, int), np.array(col, int)
    ends = np.iinfo(np.int64)
    lo = np.array([ends.min + 1 if x is None else min(max(x, ends.min + 1), ends.max) for x in low])[:, None]
    hi = np.array([ends.max if x is None else min(max(x, ends.min), ends.max) for x in high])[:, None]
    masked = np.where(fits & (scores >= lo) & (scores <= hi), scores, ends.min)
    edge = np.partition(masked, -k, axis=1)[:, -k, None]
    above, level = masked > edge, (masked == edge) & (masked > ends.min)
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))))


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _usable(embeddings: DataFrame, is_anchor: Column, scale: float) -> DataFrame:
    return (
        embeddings.where(usable(F.col("embedding"))).where("vec_id IS NOT NULL AND label IS NOT NULL")
        .select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"),
            F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.size("embedding").alias("width"),
            whole_parts(F.col("embedding"), scale).alias("vector"),
        )
    )


_PLACED = "row long, vec_id long, label long, anchor boolean, width int, leaf int, vector array<double>, at int, low double, high double"
_REQUEST = ["row", "label", "width", "leaf", "vector", "positive", "floor"]


def _fitted(vectors: DataFrame, n: int, width: int, sample: int, sample_bytes: int, ways: int, leaf: int) -> dict[int, Tree]:
    """A tree for every length among about ``sample`` rows, fewer if they took over ``sample_bytes``."""
    size = max(1, min(sample, sample_bytes // (8 * max(1, width))))
    chosen = vectors.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n))) < size).select("row", "width", "vector").collect()
    rows: dict[int, list] = {}
    for r in sorted(chosen):
        rows.setdefault(r["width"], []).append(r["vector"])
    return {w: grow(np.array(v), ways, leaf, np.random.default_rng(w)) for w, v in rows.items()}


def _placed(vectors: DataFrame, trees: dict[int, Tree], ways: int) -> DataFrame:
    """Every vector with its leaf, and rows of ranges (null ``row``): flat place, least, greatest."""
    types = [("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("width", pa.int32())]
    out = pa.schema([*types, ("leaf", pa.int32()), ("vector", pa.list_(pa.float64())), ("at", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = {w: Ranges(t.nodes, ways) for w, t in trees.items()}
        for b in pieces(batches, 1024):
            widths = b.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                own = b.take(pa.array(np.flatnonzero(widths == w)))
                leaf = np.zeros(len(own), np.int32)
                if w in trees:
                    leaf, steps = descend(trees[w], _vectors(own.column("vector")))
                    ranges[w].add(steps)
                none = [pa.nulls(len(own), t) for t in (pa.int32(), pa.float64(), pa.float64())]
                yield batch(out, *own.columns[:5], leaf, own.column("vector"), *none)
        for w, r in ranges.items():
            low, high = r.low.ravel(), r.high.ravel()
            at = np.flatnonzero(low <= high)
            none = [pa.nulls(len(at), t) for t in out.types]
            yield batch(out, *none[:4], np.full(len(at), w), *none[5:7], at, low[at], high[at])

    columns = ["row", "vec_id", "label", "anchor", "width", "vector"]
    return vectors.select(*columns).mapInArrow(place, _PLACED)


def _collected(placed: DataFrame, trees: dict[int, Tree], ways: int) -> dict[int, Ranges]:
    """The ranges over all rows; as many numbers as the trees have, however many rows there are."""
    ranges = {w: Ranges(t.nodes, ways) for w, t in trees.items()}
    merged = placed.where("row IS NULL").groupBy("width", "at").agg(F.min("low"), F.max("high"))
    for w, at, low, high in merged.collect():
        ranges[w].low.flat[at], ranges[w].high.flat[at] = low, high
    return ranges


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(width, leaf, block, ...): about equal parts of a leaf as matrices, ascending by id."""

    def pack(table: pa.Table) -> pa.Table:
        ids, row, label = (table.column(c).to_numpy() for c in ("vec_id", "row", "label"))
        order = np.lexsort((row, ids))
        x = _vectors(table.column("vector").combine_chunks())[order]
        return pa.table({
            "width": pa.array(table.column("width")[:1].to_pylist(), pa.int32()),
            "leaf": pa.array(table.column("leaf")[:1].to_pylist(), pa.int32()),
            "block": pa.array(table.column("block")[:1].to_pylist(), pa.int32()),
            **{n: pa.array([c[order].astype("<i8").tobytes()], pa.binary()) for n, c in (("ids", ids), ("rows", row), ("labels", label))},
            "numbers": pa.array([numbers(x)], pa.binary()),
        })

    dealt = rows.join(sizes, ["width", "leaf"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    fields = "width int, leaf int, block int, ids binary, rows binary, labels binary, numbers binary"
    return dealt.drop("blocks").groupBy("width", "leaf", "block").applyInArrow(pack, fields)


def limits(positive: int | None, floor: int | None, window: tuple[int, int, int]) -> tuple[int | None, int | None]:
    """Least and greatest score that is looked for: any from the floor on, or those in a positive's window."""
    if positive is None:
        return floor, None
    least, most, whole = window
    low = -(-least * positive // whole)
    return low if floor is None else max(low, floor), most * positive // whole


class Search(NamedTuple):
    """What a search needs: the tree with its ranges, the blocks and how many a leaf has."""

    trees: dict[int, Tree]
    ranges: dict[int, Ranges]
    blocks: DataFrame
    sizes: DataFrame
    scores: Scores
    window: tuple[int, int, int]  # of a positive's score: least and greatest, as parts of the last

    def tiles(self, requests: DataFrame, home: bool) -> DataFrame:
        """(width, leaf, tile): the requests that must see a leaf, packed; their own leaf or all others."""
        scores, out = self.scores, pa.schema([("width", pa.int32()), ("leaf", pa.int32()), ("tile", pa.binary())])
        window, trees, ranges = self.window, self.trees, self.ranges

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 256):
                widths, leaf = b.column("width").to_numpy(), b.column("leaf").to_numpy()
                for w in np.unique(widths).tolist():
                    mine = np.flatnonzero(widths == w)
                    if home or w not in trees:
                        goals = [(v, mine[leaf[mine] == v]) for v in np.unique(leaf[mine]).tolist()] if home else []
                    else:
                        own = b.take(pa.array(mine))
                        windows = [
                            [limits(p, f, window) for p, f in zip(scores.values(ps), scores.values(fs))]
                            for ps, fs in zip(own.column("positive").to_pylist(), own.column("floor").to_pylist())
                        ]
                        slots = max(map(len, windows))
                        low, high = np.full((len(mine), slots), np.inf), np.full((len(mine), slots), -np.inf)
                        for i, row in enumerate(windows):
                            for j, (lo, hi) in enumerate(row):
                                low[i, j], high[i, j] = _as_float(lo, -np.inf), _as_float(hi, np.inf)
                        found = reached(trees[w], ranges[w], _vectors(own.column("vector")), low, high)
                        goals = [(v, mine[who[leaf[mine[who]] != v]]) for v, who in found]
                    for v, who in goals:
                        if len(who):
                            yield batch(out, [w], [v], [_packed(b.take(pa.array(who)))])

        return requests.select(*_REQUEST).mapInArrow(spread, "width int, leaf int, tile binary")

    def found(self, requests: DataFrame, home: bool, same: bool, k: int) -> DataFrame:
        """(row, slot, vec_id, score): every request's k best per slot in each block it visits."""
        scores, window = self.scores, self.window
        out = pa.schema([("row", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", scores.arrow)])

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 1):
                ids, rows, labels = (np.frombuffer(b.column(c)[0].as_buffer(), "<i8") for c in ("ids", "rows", "labels"))
                x = matrix(b.column("numbers")[0].as_py(), len(ids))
                for t in pieces(pa.ipc.open_stream(b.column("tile")[0].as_buffer()), 64):
                    own, label = t.column("row").to_numpy(), t.column("label").to_numpy()
                    product = products(_vectors(t.column("vector")), x)
                    alike = label[:, None] == labels[None]
                    fits = alike & (own[:, None] != rows[None]) if same else ~alike
                    asked = [list(zip(scores.values(p), scores.values(f))) for p, f in zip(t.column("positive").to_pylist(), t.column("floor").to_pylist())]
                    for slot in range(max(map(len, asked))):
                        has = np.array([i for i, a in enumerate(asked) if len(a) > slot])
                        low, high = zip(*(limits(*asked[i][slot], window) for i in has))
                        who, col = best(product[has], fits[has], low, high, k)
                        yield batch(out, own[has[who]], np.full(len(who), slot), ids[col], scores.column(product[has[who], col]))

        visits = self.tiles(requests, home).join(self.sizes, ["width", "leaf"])
        visits = visits.select("width", "leaf", "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        met = self.blocks.join(visits, ["width", "leaf", "block"]).select("ids", "rows", "labels", "numbers", "tile")
        lists = met.mapInArrow(multiply, f"row long, slot int, vec_id long, score {scores.sql}")
        return _first(lists, k)


def _as_float(x: int | None, none: float) -> float:
    try:
        return none if x is None else float(x)
    except OverflowError:
        return np.inf if x > 0 else -np.inf


def _packed(requests: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, requests.schema) as stream:
        stream.write_batch(requests)
    return sink.getvalue().to_pybytes()


def _first(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each (row, slot) with their rank; tasks keep k of a list ahead of the shuffle."""
    order = W.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")
    return lists.select("row", "slot", "vec_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100),
    scale: float = 256.0, sample: int = 4096, sample_bytes: int = 1 << 25, ways: int = 12, leaf: int = 64, block: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor row.

    Components become ``floor(scale * x)``; a row's score is its inner product with the anchor,
    computed exactly.  An anchor's positives are its ``positives`` best other rows of its label;
    its negatives for each are the ``negatives`` best rows of other labels whose score is
    between ``window[0]`` and ``window[1]`` parts in ``window[2]`` of the positive's score.
    Higher scores come first, ties go to the smaller vec_id; where there are fewer, all count.

    Rows are told apart as rows: those that share a vec_id are each other's candidates, and if
    they are anchors each has its own result.  Rows without id, label or vector, with an empty
    vector or one with a null or non-finite component take no part.  Vectors of different
    lengths are not compared.  A score that 64 bits do not hold is ordered by its exact value
    and returned as null.  Labels are integers; further columns are not read; an empty table
    gives no rows.

    The tree is fitted on about ``sample`` rows, chosen by hash (fewer if they are longer than
    ``sample_bytes`` in all), with ``leaf`` sample rows a leaf; every row is indexed and the
    result does not depend on the tree.  A first visit to each anchor's own leaf gives a least
    score, which narrows the annulus that the other leaves are tested with.
    """
    spark = embeddings.sparkSession
    folder = work_folder(spark)
    vectors = written(_usable(embeddings, is_anchor, scale), folder, "vectors")
    n, width, largest = vectors.agg(
        F.count("*"), F.max("width"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))
    ).first()
    width, largest = width or 0, int(largest or 0)
    scores = Scores(largest, width, 2 * max(map(abs, window)))
    trees = _fitted(vectors, n, width, sample, sample_bytes, ways, leaf)
    placed = written(_placed(vectors, trees, ways), folder, "placed")
    rows = placed.where("row IS NOT NULL").drop("at", "low", "high")
    room = F.least(F.lit(block), F.lit(1 << 22) / F.col("width"))  # rows of a block, at most 32 MB of numbers
    sizes = written(
        rows.groupBy("width", "leaf").count().select("width", "leaf", F.ceil(F.col("count") / room).cast("int").alias("blocks")), folder, "sizes"
    )
    blocks = written(_blocks(rows.drop("anchor"), sizes), folder, "blocks")
    search = Search(trees, _collected(placed, trees, ways), blocks, sizes, scores, window)

    anchors, none = rows.where("anchor").drop("anchor"), F.array(F.lit(None).cast(scores.sql))
    near = written(search.found(anchors.select("*", none.alias("positive"), none.alias("floor")), True, True, positives), folder, "near")
    floors = near.groupBy("row").agg(F.when(F.count("*") == positives, F.min("score")).alias("least"))
    asked = anchors.join(floors, "row", "left").select(*anchors.columns, none.alias("positive"), F.array("least").alias("floor"))
    far = search.found(asked, False, True, positives)
    best_rows = written(_first(near.drop("rank").union(far.drop("rank")), positives), folder, "positives")

    pairs = best_rows.select("row", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive"))
    slots = pairs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "positive"))).alias("slots"))
    asked = anchors.join(slots, "row").select(*anchors.columns, F.col("slots.positive").alias("positive"))
    floorless = asked.withColumn("floor", F.transform("positive", lambda _: F.lit(None).cast(scores.sql)))
    near = written(search.found(floorless, True, False, negatives), folder, "near-negatives")
    floors = near.groupBy("row", "slot").agg(F.when(F.count("*") == negatives, F.min("score")).alias("least"))
    floors = pairs.join(floors, ["row", "slot"], "left").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("slot", "least"))).alias("slots")
    )
    asked = asked.join(floors, "row").select(*asked.columns, F.col("slots.least").alias("floor"))
    far = search.found(asked, False, False, negatives)
    chosen = _first(near.drop("rank").union(far.drop("rank")), negatives)
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return pairs.join(chosen, ["row", "slot"]).join(ids, "row").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        scores.as_long("positive").alias("positive_score"), scores.as_long("score").alias("negative_score"),
    )
