"""Document fingerprints: a digest of quartile buckets, and its difference score.

The byte triplets of a sliding window are hashed into buckets and counted.  The digest holds
the length on a logarithmic scale, the shape of the quartiles, and two bits per bucket: the
quartile its count falls into.  The difference of two digests adds up the distance of their
buckets, lengths and shapes and is at most 1; its complement is the likeness.

In the digest's hex text: 2 digits length, 4 digits quartile shape, then the buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import batch, partitions, pieces

BUCKETS = 256
# Offsets of a triplet's bytes in the window, each kind hashed with factors of its own.
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 4))
_FACTORS = np.random.default_rng(7).integers(1 << 20, 1 << 31, (len(_TRIPLETS), 4), dtype=np.int64).astype(np.uint32) | 1
# Distance of two quartile codes; opposite quartiles count double.
_STEPS = np.array([0, 1, 2, 6], np.int64)
_UNRELATED = 1.625  # mean distance of a bucket if codes were independent
_WIDE = 4
_NO_ID = -(1 << 63)


def digest(data: bytes) -> np.ndarray:
    """The digest of some bytes: length code, three shape codes, then a code per bucket."""
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    wide = raw.astype(np.uint32)
    for (i, j, k), (a, b, c, salt) in zip(_TRIPLETS, _FACTORS):
        n = len(raw) - k
        if n > 0:
            h = (wide[i : i + n] * a + wide[j : j + n] * b) ^ (wide[k : k + n] * c + salt)
            h *= np.uint32(0x9E3779B1)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1)
    length = min(255, int(np.log(len(raw) + 1) * 12))
    shape = [min(15, int(16 * q / (quartiles[2] + 1))) for q in quartiles[:2]] + [min(255, int(quartiles[2]).bit_length())]
    return np.concatenate([[length], shape, codes]).astype(np.uint8)


def as_text(d: np.ndarray) -> str:
    """The digest as hex digits."""
    codes = d[4:].reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return f"{d[0]:02x}{d[1]:01x}{d[2]:01x}{d[3]:02x}" + packed.astype(np.uint8).tobytes().hex()


def from_text(text: str) -> np.ndarray:
    """The digest that ``as_text`` wrote."""
    packed = np.frombuffer(bytes.fromhex(text[6:]), np.uint8)
    codes = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()
    head = [int(text[:2], 16), int(text[2], 16), int(text[3], 16), int(text[4:6], 16)]
    return np.concatenate([head, codes]).astype(np.uint8)


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """0 for equal digests, at most 1; around 1 for digests that have nothing in common."""
    apart = np.abs(a.astype(np.int64) - b)
    buckets = _STEPS[apart[4:]].sum() / (_UNRELATED * BUCKETS)
    length = min(int(apart[0]), 48) / 48
    shape = min(int(apart[1] + apart[2]), 16) / 16
    return float(min(1.0, 0.9 * buckets + 0.07 * length + 0.03 * shape))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b)


def with_fingerprint(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; null texts count as empty."""
    out = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield batch(out, b.column(0), [as_text(digest((t or "").encode("utf-8", "replace"))) for t in b.column(1).to_pylist()])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, fingerprint string"
    )


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by the beginning of another one."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def against_neighbours(documents: DataFrame) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document.

    Next is the document with the next smaller doc_id; after the smallest comes the largest,
    and a single document is its own next one.  Null texts count as empty, null ids come below
    all others, rows that share an id are ordered by a hash of their text.  Other columns are
    ignored; no rows give no rows.

    Documents are dealt by ranges of ids, one shuffle of the texts.  Each range also gets the
    last document of the range below it; which ids those are is known from the ids alone.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ranges = _WIDE * partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def largest(batches):
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, doc, side="right")
            top = np.full(len(bounds) + 1, _NO_ID)
            np.maximum.at(top, at, doc)
            seen = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(top[seen], pa.int64())], ["at", "doc"])

    tops = sorted(rows.select("doc").mapInArrow(largest, "at long, doc long").groupBy("at").agg(F.max("doc").alias("doc")).collect())
    next_range = {top.doc: tops[(i + 1) % len(tops)]["at"] for i, top in enumerate(tops)}
    dealt = pa.schema([("at", pa.int64()), ("own", pa.bool_()), ("doc", pa.int64()), ("no_id", pa.bool_()), ("text", pa.string())])

    def deal(batches):
        carried = np.array(sorted(next_range), np.int64)
        for b in pieces(batches):
            doc = b.column(0).to_numpy(zero_copy_only=False)
            yield batch(dealt, np.searchsorted(bounds, doc, side="right"), np.ones(len(doc), bool), *b.columns)
            also = np.flatnonzero(np.isin(doc, carried))
            if len(also):
                to = [next_range[d] for d in doc[also].tolist()]
                yield batch(dealt, to, np.zeros(len(also), bool), *b.take(pa.array(also)).columns)

    out = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def compare(batches):
        below_text, below = "", None
        for b in pieces(batches):
            found = []
            for own, doc, no_id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                mine = digest(text.encode("utf-8", "replace"))
                if own:
                    changed = edited(text, below_text).encode("utf-8", "replace")
                    other = digest(changed)
                    found.append((
                        None if no_id else doc, len(text), hashlib.sha256(changed).hexdigest(), as_text(mine), as_text(other),
                        likeness(mine, other), likeness(mine, below),
                    ))
                below_text, below = text, mine
            if found:
                yield batch(out, *(list(c) for c in zip(*found)))

    return (
        rows.mapInArrow(deal, "at long, own boolean, doc long, no_id boolean, text string")
        .repartition("at").sortWithinPartitions("at", "own", "doc", F.xxhash64("text"))
        .select("own", "doc", "no_id", "text")
        .mapInArrow(
            compare,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double",
        )
    )
