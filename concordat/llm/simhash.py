"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most d bits, cut into ``d // 2 + 1`` segments,
agree in one segment or differ there in a single bit.  Every distinct fingerprint is indexed
under the exact value of each segment and under every variant of it with one bit left open.
Equal values meet under the first, values one bit apart under the second; a comparison of all
64 bits then decides.  d = 4 gives three segments and 67 signatures.

A signature may be shared by a large part of all fingerprints.  Its rows are then dealt over
tiles of about ``tile`` rows by a hash of the fingerprint, and every pair of tiles is one
group, so no task gathers an unbounded group.  A task never emits the pairs it finds but a
spanning forest of them, at most one link per fingerprint and group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import batch, give_back, holding, partitions, pieces, work_folder, written
from concordat.llm.components import components
from concordat.operators.joins import keyed_join

BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text: bit set if over half of its shingles' XXH64 (seed 42) have it.

    A-Z are lowered, words are what ASCII white space separates.  A text of fewer words than a
    shingle is one shingle; one without words (null, empty, blank) gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    digest = xxhash.xxh64_intdigest
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256)
    return int(_WEIGHTS[((counts @ _BYTE_BITS).ravel() * 2 > len(hashes))].sum(dtype=np.uint64))


def with_fingerprint(documents: DataFrame, shingle: int = 4, hashes: bool = False) -> DataFrame:
    """(doc_id, fingerprint bigint) of every row; the 64 bits are kept as a signed number.

    ``hashes`` adds the two hashes of the row's text that ``row_key`` has.
    """
    more = ["text_one", "text_two"] if hashes else []
    names = ["doc_id", "fingerprint", *more]
    out = pa.schema([(n, pa.int64()) for n in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("shingles", give_back)
        for b in pieces(batches):
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(out, b.column(0), found.view(np.int64), *b.columns[2:])

    keys = row_key()
    return documents.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), *[keys[n].alias(n) for n in more]
    ).mapInArrow(work, ", ".join(f"{n} long" for n in names))


def row_key() -> dict[str, Column]:
    """Columns, never null, that are equal for rows of the same doc_id and text; their order puts null ids last."""
    number, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return {
        "no_id": number.isNull(), "id": F.coalesce(number, F.lit(0)),
        "text_one": F.xxhash64(text), "text_two": F.xxhash64(F.lit(1), text),
    }


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: few enough that one differs by at most one bit."""
    n = max_bits // 2 + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def signatures(prints: DataFrame, max_bits: int, tile: int) -> DataFrame:
    """(sig, bit, fingerprint): a row for each signature and tile pair of each fingerprint.

    ``bit`` is the open bit, -1 for an exact segment.  Sizes are counted per exact segment
    value (one row per fingerprint and segment, combined before the shuffle); a variant with
    an open bit is as large as its two values together.
    """
    cut = segments(max_bits)
    masks = [(((1 << w) - 1) << a) for a, w in cut]
    per_segment = prints.select(
        "fingerprint",
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("seg"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("value"))
                for i, m in enumerate(masks)
            ])
        ).alias("s"),
    ).select("fingerprint", "s.seg", "s.value")
    large = per_segment.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > tile // 2)

    def bits_of(seg_mask: int) -> list[int]:
        return [i for i in range(BITS) if seg_mask >> i & 1]

    def per_seg(make):
        expr = None
        for i, m in enumerate(masks):
            expr = F.when(F.col("seg") == i, make(i, m)) if expr is None else expr.when(F.col("seg") == i, make(i, m))
        return expr

    # what a large value adds to its own signatures and to those of the values one bit away
    bit_struct = lambda value, b: F.struct(value.alias("value"), F.lit(b).alias("bit"))
    spread = large.select(
        "seg", "n",
        F.explode(per_seg(lambda i, m: F.array(
            *[bit_struct(F.col("value"), b) for b in [-1, *bits_of(m)]],
            *[bit_struct(F.col("value").bitwiseXOR(F.lit(_signed(1 << b))), b) for b in bits_of(m)],
        ))).alias("t"),
    ).select("seg", "t.value", "t.bit", "n")
    sizes = (
        spread.groupBy("seg", "value", "bit").agg(F.sum("n").alias("n"))
        .groupBy("seg", "value").agg(F.map_from_entries(F.collect_list(F.struct("bit", "n"))).alias("sizes"))
    )
    keyed = keyed_join(per_segment, sizes, ["seg", "value"], "left")
    rows = keyed.select(
        "fingerprint", "seg", "value", "sizes",
        F.explode(per_seg(lambda i, m: F.array(*[F.lit(b) for b in [-1, *bits_of(m)]]))).alias("bit"),
    )
    open_value = F.when(F.col("bit") < 0, F.col("value")).otherwise(
        F.col("value").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))
    )
    # values below the counting threshold add less than a tile
    tiles = F.ceil((F.coalesce(F.col("sizes")[F.col("bit")], F.lit(0)) + F.lit(1)) / F.lit(tile)).cast("int")
    dealt = rows.select(
        "fingerprint", "seg", "bit", open_value.alias("value"), tiles.alias("tiles"),
    ).withColumn("mine", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
    return dealt.select(
        "fingerprint", "bit", "seg", "value", "mine",
        F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"),
    ).select(
        F.xxhash64("seg", "bit", "value", F.least("mine", "other"), F.greatest("mine", "other")).alias("sig"),
        F.col("bit").cast("int").alias("bit"), "fingerprint",
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that join what the links (a, b) join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(batches: Iterator[pa.RecordBatch], max_bits: int, held: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Links within the groups of a partition sorted by signature; groups may span batches."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    left: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
    xs: list[np.ndarray] = []
    ys: list[np.ndarray] = []

    def compare(sig, bit, fp):
        at, step = np.arange(len(sig)), 0
        while True:
            step += 1
            at = at[at < len(sig) - step]
            at = at[sig[at] == sig[at + step]]
            if not len(at):
                return
            one, two = fp[at], fp[at + step]
            apart = (one ^ two).view(np.uint64)
            near = np.bitwise_count(apart) <= max_bits
            # under an open bit only those that differ there; the others meet under the exact value
            b = bit[at]
            near &= (b < 0) | ((apart >> np.maximum(b, 0).astype(np.uint64)) & np.uint64(1)).astype(bool)
            if near.any():
                xs.append(one[near])
                ys.append(two[near])
                if sum(map(len, xs)) > held:
                    a, c = _forest(np.concatenate(xs), np.concatenate(ys))
                    xs[:], ys[:] = [a], [c]

    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        sig, bit, fp = (np.concatenate(p) for p in zip(left, now))
        if not len(sig):
            continue
        others = np.flatnonzero(sig != sig[-1])
        end = int(others[-1]) + 1 if len(others) else 0
        compare(sig[:end], bit[:end], fp[:end])
        left = [sig[end:], bit[end:], fp[end:]]
    compare(*left)
    if xs:
        yield batch(out, *_forest(np.concatenate(xs), np.concatenate(ys)))


def links(prints: DataFrame, max_bits: int = 4, tile: int = 4096) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints within ``max_bits`` of each other."""
    rows = signatures(prints, max_bits, tile)
    return (
        rows.repartition(partitions(prints.sparkSession), "sig").sortWithinPartitions("sig")
        .mapInArrow(lambda it: _links(it, max_bits), "a long, b long")
    )


def _placed(first: DataFrame, value: str, folder: str, max_bits: int, tile: int) -> DataFrame:
    """(fingerprint, value, root) of ``first``, a row per fingerprint; the root of a component is a fingerprint."""
    found = written(links(first.select("fingerprint"), max_bits, tile), folder, "links")
    roots = components(found, folder)
    return first.join(roots, first["fingerprint"] == roots["node"], "left").select(
        "fingerprint", value, F.coalesce("root", "fingerprint").alias("root")
    )


def survivors(documents: DataFrame, shingle: int = 4, max_bits: int = 4, tile: int = 4096) -> DataFrame:
    """The ``row_key`` of one row of each component of ``documents``: the least by (doc_id, text hash), null ids last.

    Components are those of ``near_duplicates``.  Minima are combined before each shuffle, so
    a large component is never gathered.
    """
    folder = work_folder(documents.sparkSession)
    least = F.struct(*[c.alias(n) for n, c in row_key().items() if n in ("no_id", "id")], "text_one", "text_two")
    prints = with_fingerprint(documents, shingle, hashes=True)
    first = written(prints.groupBy("fingerprint").agg(F.min(least).alias("first")), folder, "distinct")
    placed = _placed(first, "first", folder, max_bits, tile)
    return placed.groupBy("root").agg(F.min("first").alias("first")).select("first.*")


def near_duplicates(documents: DataFrame, shingle: int = 4, max_bits: int = 4, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``documents`` (doc_id, text, ...).

    ``component_id`` is the smallest doc_id reachable over links of at most ``max_bits``
    differing bits.  Equal texts have distance 0.  Null and blank texts have fingerprint zero
    and are linked like any other.  Repeated rows give repeated rows; a null doc_id belongs to
    its component but never names it unless no other does.  Other columns are ignored.
    """
    spark = documents.sparkSession
    folder = work_folder(spark)
    prints = written(with_fingerprint(documents, shingle), folder, "fingerprints")
    first = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), folder, "distinct")
    placed = _placed(first, "first_id", folder, max_bits, tile)
    names = keyed_join(
        placed, placed.groupBy("root").agg(F.min("first_id").alias("component_id")), ["root"]
    ).select("fingerprint", "component_id")
    names = written(names, folder, "names")
    return keyed_join(prints, names, ["fingerprint"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
