"""Token ids in files of canonical length-limited Huffman codes.

Ids of all documents are counted; the counts, one per id of the vocabulary, give code lengths
by package-merge.  Codes are canonical, so the lengths alone define them, and every file
carries them.  A file holds blocks that are decoded independently.  A block has its documents'
ids and token counts, the bit offset of every ``STEP``-th token as a checkpoint, and the bits.
Decoding starts at all checkpoints of a block at once and takes one token per step from each,
by a table over the next ``limit`` bits.

Layout, little-endian::

    file      b"HUFT", u32 format, u32 code length limit, u32 n, n x u8 code lengths, block...
    block     u32 documents, u32 tokens, u32 checkpoints, u32 bytes of code
              documents x (u8 id is null, i64 id, u64 row hash, u32 tokens), checkpoints x u32, code

Files hold ascending documents and are at most ``file_bytes`` long plus a block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.llm.common import batch, drop, made_folder, partitions, texts, work_folder, written
from concordat.llm.tokens import by_size, encoded
from concordat.operators.joins import keyed_join

MAGIC = b"HUFT"
STEP = 256
_HEAD = np.dtype([("null", "u1"), ("doc", "<i8"), ("row", "<i8"), ("tokens", "<u4")])

# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never come."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < len(leaves))
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id, counting up."""
    codes = np.zeros(len(lengths), np.uint64)
    code = at = 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == length)
        code <<= length - at
        at = length
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decoding_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each possible next ``limit`` bits: the id and the length of its code (0: no code)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    ids[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return ids, sizes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bit offset of every STEP-th id, the bits)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    total = int(end[-1]) if len(end) else 0
    # each code lies in one 32-bit word or crosses into the next; sums of disjoint bits are exact
    wide = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
    words = total // 32 + 2
    high = np.bincount(at >> 5, (wide >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount((at >> 5) + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return at[::STEP].astype("<u4"), (high + low).astype(">u4").tobytes()[: (total + 7) // 8]


def decode_block(code: bytes, checkpoints: np.ndarray, n: int, table, limit: int) -> np.ndarray:
    """The ``n`` ids of a block, all checkpoints in step."""
    ids, sizes = table
    raw = np.frombuffer(code + bytes(8), np.uint8).astype(np.uint32)
    # the 32 bits that begin at each byte; a code of up to 24 bits is within them
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at, runs = checkpoints.astype(np.int64), len(checkpoints)
    out = np.empty((STEP, runs), np.uint32)
    last = n - (runs - 1) * STEP
    for step in range(min(STEP, n)):
        if step == last:
            at = at[:-1]
        live = len(at)
        peek = (words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[step, :live] = ids[peek]
        at = at + sizes[peek]
    return out.T.reshape(-1)[:n]


# ---------------------------------------------------------------- files


def _file_head(lengths: np.ndarray, limit: int) -> bytes:
    return MAGIC + np.array([1, limit, len(lengths)], "<u4").tobytes() + lengths.astype(np.uint8).tobytes()


def _block(docs: list[tuple], ids: list[np.ndarray], lengths, codes) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    marks, code = encode_block(flat, lengths, codes)
    head = np.array([(d is None, d or 0, r, len(x)) for (d, r), x in zip(docs, ids)], _HEAD)
    return np.array([len(docs), len(flat), len(marks), len(code)], "<u4").tobytes() + head.tobytes() + marks.tobytes() + code


def read_file(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents' heads, ids of all of them in turn) of each block."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    _, limit, n = (int(x) for x in np.frombuffer(content, "<u4", 3, 4))
    table = decoding_table(np.frombuffer(content, np.uint8, n, 16), limit)
    at = 16 + n
    while at < len(content):
        docs, tokens, marks, size = (int(x) for x in np.frombuffer(content, "<u4", 4, at))
        at += 16
        head = np.frombuffer(content, _HEAD, docs, at)
        at += head.nbytes
        checkpoints = np.frombuffer(content, "<u4", marks, at)
        at += checkpoints.nbytes
        yield head, decode_block(content[at : at + size], checkpoints, tokens, table, limit)
        at += size


def _store(path: str, content: bytes) -> None:
    """Write a file whole or not at all; a task that runs again writes the same file."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, place)


_RUN = pa.schema([("file", pa.string()), ("part", pa.int32()), ("nth", pa.int64()), ("tokens", pa.int64())])


def _write_files(batches, folder, lengths, limit, block_tokens, file_bytes):
    """Rows (part, nth, doc, row, ids) to files; one row per file."""
    codes = canonical_codes(lengths)
    head = _file_head(lengths, limit)
    state: dict = {}
    done: list[tuple] = []

    def close_block():
        if state["docs"]:
            state["parts"].append(_block(state["docs"], state["ids"], lengths, codes))
            state["size"] += len(state["parts"][-1])
            state["docs"], state["ids"], state["held"] = [], [], 0

    def close_file():
        if state:
            close_block()
            name = f"{state['part']:06d}-{state['nth']:012d}.huft"
            _store(f"{folder}/{name}", head + b"".join(state["parts"]))
            done.append((name, state["part"], state["nth"], state["tokens"]))
            state.clear()

    for b in batches:
        parts, nths, docs, rows = (b.column(i).to_pylist() for i in range(4))
        for i, (part, nth, doc, row) in enumerate(zip(parts, nths, docs, rows)):
            ids = np.frombuffer(b.column(4)[i].as_buffer(), "<u4" if b.column(5)[i].as_py() == 4 else "<u2")
            if state and (part != state["part"] or nth != state["next"] or state["size"] > file_bytes):
                close_file()
            if not state:
                state.update(part=part, nth=nth, tokens=0, size=0, parts=[], docs=[], ids=[], held=0)
            state["docs"].append((doc, row)), state["ids"].append(ids)
            state["held"] += len(ids)
            state["tokens"] += len(ids)
            state["next"] = nth + 1
            if state["held"] >= block_tokens:
                close_block()
    close_file()
    if done:
        yield batch(_RUN, *(list(c) for c in zip(*done)))


def write_tokens(
    documents: DataFrame, tokenizer: str, folder: str, end_id: int | None = 1,
    limit: int = 16, block_tokens: int = 1 << 20, file_bytes: int = 8 << 20,
) -> DataFrame:
    """Write the ids of ``documents`` below ``folder`` in ascending doc_id; (file, part, nth, tokens).

    ``nth`` numbers the documents of a part; parts follow each other.  Null ids come first, rows
    with one id are ordered by their text's hash.  Nothing is written for no rows.
    """
    spark = documents.sparkSession
    n = 2 * partitions(spark)
    counted = pa.map_(pa.int64(), pa.int64())
    out = pa.schema([
        ("nth", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()),
        ("counts", counted),
    ])

    def work(batches):
        """A row per document, then one without number that counts the ids of all."""
        nth, total = 0, np.zeros(0, np.int64)
        for b in by_size(batches, 2):
            found = encoded(texts(b.column(2)), tokenizer, end_id)
            data, width = [], []
            for ids in found:
                short = not len(ids) or int(ids.max()) < 1 << 16
                data.append(ids.astype("<u2" if short else "<u4").tobytes())
                width.append(2 if short else 4)
            here = np.bincount(np.concatenate(found), minlength=len(total))
            here[: len(total)] += total
            total = here
            yield batch(
                out, np.arange(nth, nth + b.num_rows), b.column(0), b.column(1), data, width, pa.nulls(b.num_rows, counted)
            )
            nth += b.num_rows
        seen = np.flatnonzero(total)
        yield batch(out, [None], [None], [None], [None], [None], pa.MapArray.from_arrays([0, len(seen)], seen, total[seen]))

    ids = written(
        documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), F.col("text").cast("string"))
        .repartitionByRange(n, "doc", "row").sortWithinPartitions("doc", "row")
        .mapInArrow(work, "nth long, doc long, row long, ids binary, width int, counts map<long, long>")
        .select(F.spark_partition_id().alias("part"), "nth", "doc", "row", "ids", "width", "counts"),
        folder, "ids",
    )

    counts_of = ids.select(F.explode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in counts_of], default=-1) + 1, np.int64)
    for r in counts_of:
        counts[r["id"]] = r["n"]
    while np.count_nonzero(counts) > 1 << limit:
        limit += 1
    lengths = code_lengths(counts, limit)
    target = made_folder(spark, f"{folder}/files")
    files = written(
        ids.where("nth IS NOT NULL").drop("counts").mapInArrow(
            lambda it: _write_files(it, target, lengths, limit, block_tokens, file_bytes),
            "file string, part int, nth long, tokens long",
        ),
        folder, "written",
    )
    drop(spark, folder, "ids")
    return files


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``write_tokens``."""
    spark = files.sparkSession
    # parts are as many as the partitions of the write; files within them are numbered by a window each
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    ahead, bases = 0, []
    for part in sorted(totals):
        bases.append((part, ahead))
        ahead += totals[part]
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    earlier = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    placed = files.join(spark.createDataFrame(bases, "part int, ahead long"), "part").select(
        "file", (F.col("ahead") + F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).alias("base")
    )
    out = pa.schema([
        ("file", pa.string()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
    ])

    def work(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                inside = 0
                for head, ids in read_file(content.as_buffer().to_pybytes()):
                    ends = np.cumsum(head["tokens"].astype(np.int64))
                    starts = ends - head["tokens"]
                    data = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                    yield batch(
                        out, [path.rsplit("/", 1)[1]] * len(head),
                        pa.array(head["doc"], pa.int64(), mask=head["null"].astype(bool)), inside + starts,
                        head["tokens"].astype(np.int64), crc,
                    )
                    inside += len(ids)

    decoded = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.huft").load(f"{folder}/files").select("path", "content")
        .mapInArrow(work, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    )
    return keyed_join(decoded, placed, ["file"], "inner").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def through_files(documents: DataFrame, tokenizer: str, end_id: int | None = 1, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from files written for ``documents``.

    ``start`` counts the ids of all documents before it in ascending doc_id.  Null texts count
    as empty, repeated rows are written as often as they come, other columns are ignored.
    """
    folder = work_folder(documents.sparkSession)
    return read_tokens(write_tokens(documents, tokenizer, folder, end_id, **options), folder)
