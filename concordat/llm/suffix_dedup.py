"""Repeated substrings of a corpus found by deep-shallow suffix sorting.

A byte is removed if a string of ``window`` bytes that covers it also starts earlier in the
corpus: in a document with a smaller id, or further to the left in the same one.

Sorting every suffix of the corpus would shuffle many times its size, so suffixes are sorted
only where a repeat is possible.

1. *Anchors.*  In each window the leftmost ``gram`` with the smallest hash is its anchor.
   Equal windows have equal anchors at equal offsets, and neighbouring windows mostly share
   one.  An anchor with the text of all windows it stands for is an occurrence.
2. *Open anchors.*  An anchor that occurs once repeats nothing.  Tasks count what they see
   themselves and settle the rest by the anchor's hash; occurrences of anchors that occur more
   often are open.
3. *Deep-shallow sorting* of the suffixes at all open anchors, and of the reversed texts before
   them: multikey quicksort over characters of eight bytes to a shallow depth, then a blind
   trie for every group that still has a common prefix.  From the sorted order follow, for
   each distance of a window's start from the anchor, the classes of equal windows; all but
   the earliest of a class are repeats.  Nothing is removed for equal hashes: texts that are
   equal byte for byte share one entry of a task, and of the order.

An anchor may occur in a large part of all documents with as many texts around it.  Anchors
with over ``hot`` texts, counted by task, are taken apart into single windows and dealt by the
window's hash, so equal windows still meet, are sorted like other texts, and nothing else does.  Occurrences travel as
packed columns, one row per task and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm import hashing
from concordat.llm.common import batch, give_back, holding, partitions, pieces, work_folder, written
from concordat.operators.joins import keyed_join

WINDOW = 100
GRAM = 50
NO_ID = -(1 << 63)  # a null doc_id comes before all others
_OCCURRENCE, _SPAN, _OPEN = 0, 1, 2
_U = np.uint64

# ---------------------------------------------------------------- packed columns


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length as one compressed value; integers as differences."""
    parts = [np.int64(len(columns[0])).tobytes()]
    for c in columns:
        parts.append((np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.int64 else c).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, dtypes: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for d in dtypes:
        c = np.frombuffer(raw, d, n, at)
        at += c.nbytes
        out.append(np.cumsum(c) if c.dtype == np.int64 else c)
    return out


def _gathered(blobs: list[bytes], dtypes: list) -> list[np.ndarray]:
    parts = [_unpack(b, dtypes) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, d) for i, d in enumerate(dtypes)]


# ---------------------------------------------------------------- anchors

def _first_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the leftmost smallest."""
    least, at, wide = h, np.arange(len(h), dtype=np.int32), 1

    def joined(least, at, step, n):
        right = least[step : step + n] < least[:n]
        return np.minimum(least[:n], least[step : step + n]), np.where(right, at[step : step + n], at[:n])

    while wide * 2 <= width:
        least, at = joined(least, at, wide, len(least) - wide)
        wide *= 2
    if wide < width:
        least, at = joined(least, at, width - wide, len(h) - width + 1)
    return at


def _anchors(data: list[bytes], window: int, gram: int):
    """Of texts laid end to end: (text, anchor, first window, last window, key, text hash) columns."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(d) for d in data], np.int64)
    ends = np.cumsum(lengths)
    if len(raw) < window:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, _U)] * 2
    values = raw.astype(_U) + _U(1)
    one = hashing.prefix(values, hashing.BASES[0])
    n = len(raw)
    begin = np.arange(n - gram + 1)
    key = hashing.of_ranges(one, begin, begin + gram, hashing.BASES[0])
    at = _first_least(key, window - gram + 1)
    text = np.repeat(np.arange(len(data)), lengths)[: n - window + 1]
    inside = np.flatnonzero(np.arange(n - window + 1) + window <= ends[text])
    if not len(inside):
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, _U)] * 2
    text, at = text[inside], at[inside].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    first, last, anchor = inside[new], inside[np.append(new[1:], len(at)) - 1], at[new]
    two = hashing.prefix(values, hashing.BASES[1])
    around = hashing.of_ranges(two, first, last + window, hashing.BASES[1])
    around = hashing.mixed(around + (anchor - first).astype(_U) * _U(0x9E3779B97F4A7C15) + (last - first).astype(_U))
    return [text[new], anchor, first, last, key[anchor], around]


def _small(window: int) -> type:
    """The narrowest type for counts and lengths around an anchor, all under twice the window."""
    return next(t for t in (np.uint8, np.uint16, np.int32) if 2 * window <= np.iinfo(t).max)


# key, text hash, doc, row hash, first window, windows, anchor's offset, marker
def _occ(window: int) -> list:
    return [np.uint64, np.uint64, np.int64, np.int64, np.int64, _small(window), _small(window), np.uint8]


_SPANS = [np.int64, np.int64, np.int64, np.int64]


def _without_copies(c: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Occurrences by key, text and place, each place once; and which is the first of its text."""
    order = np.lexsort((c[7], c[4], c[3], c[2], c[1], c[0]))
    c = [x[order] for x in c]
    same = lambda *columns: np.logical_and.reduce([c[i][1:] == c[i][:-1] for i in columns])
    keep, lead = np.ones(len(order), bool), np.ones(len(order), bool)
    keep[1:], lead[1:] = ~same(0, 1, 2, 3, 4), ~same(0, 1)
    return [x[keep] for x in c], lead[keep]


def _per_key(key: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Of sorted keys: for each row the sum of ``counted`` over its key."""
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    sums = np.add.reduceat(counted.astype(np.int64), np.flatnonzero(new)) if len(key) else np.empty(0, np.int64)
    return sums[np.cumsum(new) - 1] if len(key) else sums


def _by_bucket(columns: list[np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.lexsort((columns[4] if len(columns) > 4 else columns[2], columns[2], bucket))
    columns, bucket = [x[order] for x in columns], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[a]), [x[a:b] for x in columns]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (hashing.mixed(key) % _U(buckets)).astype(np.int64)


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary())])
_PACKED_SQL = "bucket int, kind int, packed binary"


def _occurrences(batches, window, gram, buckets, chunk=1 << 19, held=1 << 18):
    """A task's documents as packed occurrences: open ones where an anchor comes again, else single ones."""
    holding("anchors", hashing.release)
    kept: list[list[np.ndarray]] = []

    def flush():
        if not kept:
            return
        c = [np.concatenate([k[i] for k in kept]) for i in range(len(_occ(window)))]
        kept.clear()
        c, lead = _without_copies(c)
        again = _per_key(c[0], np.ones(len(c[0]), bool)) > 1
        rows: list[tuple[int, int, bytes]] = []
        if again.any():
            c[7] = lead.astype(np.uint8)
            rows.append((int(c[0][0] % _U(buckets)), _OPEN, _pack([x[again] for x in c])))
        # of an anchor that is open already one occurrence tells the others so
        marks = again & np.concatenate([[True], c[0][1:] != c[0][:-1]])
        c[7] = marks.astype(np.uint8)
        c = [x[marks | ~again] for x in c]
        rows += [(b, _OCCURRENCE, _pack(x)) for b, x in _by_bucket(c, _bucket(c[0], buckets))]
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            yield batch(_PACKED, *(list(x) for x in zip(*part)))

    def anchored(data, doc, row, base):
        text, anchor, first, last, key, around = _anchors(data, window, gram)
        begin = np.cumsum([0, *map(len, data)])[text]
        kept.append([
            key, around, np.array(doc, np.int64)[text], np.array(row, np.int64)[text],
            first - begin + np.array(base, np.int64)[text], (last - first + 1).astype(_small(window)),
            (anchor - first).astype(_small(window)), np.zeros(len(text), np.uint8),
        ])

    data, doc, row, base, size = [], [], [], [], 0
    for b in pieces(batches):
        for d, r, t in zip(*(b.column(i).to_pylist() for i in range(3))):
            whole = t.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(whole) - window + 1), chunk):
                part = whole[at : at + chunk + window - 1]
                if len(part) < window:
                    continue
                data.append(part), doc.append(d), row.append(r), base.append(at)
                size += len(part)
                if size >= chunk:
                    anchored(data, doc, row, base)
                    data, doc, row, base, size = [], [], [], [], 0
                    if sum(len(k[0]) for k in kept) > held:
                        yield from flush()
    if data:
        anchored(data, doc, row, base)
    yield from flush()


def _joined(spans: list[np.ndarray]) -> list[np.ndarray]:
    """Spans (doc, row, start, stop) without overlap: those of a text that touch become one."""
    order = np.lexsort((spans[2], spans[1], spans[0]))
    doc, row, start, stop = (x[order] for x in spans)
    if not len(doc):
        return spans
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
    # the furthest stop so far, text by text: texts are set apart by more than any length
    apart = np.cumsum(other) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + apart) - apart
    new = np.flatnonzero(other | np.concatenate([[True], start[1:] > reach[:-1]]))
    return [doc[new], row[new], start[new], reach[np.append(new[1:], len(doc)) - 1]]


_FOUND = pa.schema([
    ("kind", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
    ("key", pa.int64()), ("windows", pa.int32()), ("off", pa.int32()), ("lead", pa.int32()),
])
_FOUND_SQL = "kind int, doc long, row long, start long, stop long, key long, windows int, off int, lead int"


def _found_spans(spans: list[np.ndarray]) -> pa.RecordBatch:
    n = len(spans[0])
    zero = np.zeros(n, np.int64)
    return batch(_FOUND, np.full(n, _SPAN), *spans, zero, zero, zero, zero)


def _found_open(c: list[np.ndarray], window: int) -> pa.RecordBatch:
    n = len(c[0])
    spans = [c[2], c[3], c[4], c[4] + c[5].astype(np.int64) - 1 + window]
    return batch(_FOUND, np.full(n, _OPEN), *spans, c[0].view(np.int64), c[5], c[6], c[7])


def _settle_bucket(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """The open occurrences of the anchors of one bucket, and those that tasks found open."""
    holding("buckets", give_back)
    kinds, packed = table.column("kind").to_pylist(), table.column("packed").to_pylist()
    of = lambda kind: [p for k, p in zip(kinds, packed) if k == kind]
    for p in of(_OPEN):
        yield _found_open(_unpack(p, _occ(window)), window)
    c, lead = _without_copies(_gathered(of(_OCCURRENCE), _occ(window)))
    is_open = (_per_key(c[0], np.ones(len(lead), bool)) > 1) & (c[7] == 0)
    c[7] = lead.astype(np.uint8)
    yield _found_open([x[is_open] for x in c], window)


# ---------------------------------------------------------------- deep-shallow sorting


def _blind_trie(strings: list[bytes]) -> list[int]:
    """Sorted order of strings, by insertion into a blind trie.

    A node keeps the length of the common prefix below it and a child per next byte (-1: the
    end), but no text.  A string goes down blindly, is compared once with a string found
    there, and is hung in at the place where the two part.
    """

    def char(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    root: list = [strings[0], [0]]  # a leaf: its text and the places of the strings equal to it
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while len(node) == 3:
            node = node[1].get(char(s, node[0])) or next(iter(node[1].values()))
        t = node[0]
        if s == t:
            node[1].append(i)
            continue
        most = min(len(s), len(t))
        part = next((j for j in range(0, most, 16) if s[j : j + 16] != t[j : j + 16]), most)
        while part < most and s[part] == t[part]:
            part += 1
        above, node = None, root
        while len(node) == 3 and node[0] < part:
            above, node = node, node[1][char(s, node[0])]
        if len(node) == 3 and node[0] == part:
            node[1][char(s, part)] = [s, [i]]
            continue
        split: list = [part, {char(t, part): node, char(s, part): [s, [i]]}, None]
        if above is None:
            root = split
        else:
            above[1][char(s, above[0])] = split
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if len(node) == 2:
            out += node[1]
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(raw: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, words: int = 3):
    """Order of the strings ``raw[start : start + length]``, group by group.

    Multikey quicksort splits by the group and then by ``words`` characters of eight bytes
    into less, equal and greater; blind tries order what is equal up to that depth.
    """
    wide = 8 * words
    at = np.minimum(start[:, None] + np.arange(wide), max(len(raw) - 1, 0))
    head = np.where(np.arange(wide) < length[:, None], raw[at] if len(raw) else np.uint8(0), np.uint8(0))
    chars = np.ascontiguousarray(head).view(">u8").astype(_U)
    order = np.argsort(group, kind="stable")
    # all parts are split in step: a part is a run of ``order``, at some depth of its characters
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])) if len(order) else np.empty(0, np.int64)
    depth, deep = np.zeros(len(first), np.int64), []
    size = np.diff(np.append(first, len(order)))
    while True:
        deep.append(np.stack([first, size])[:, (depth == words) & (size > 1)])
        going = (depth < words) & (size > 1)
        first, size, depth = first[going], size[going], depth[going]
        if not len(first):
            break
        part = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + first[part]
        rows = order[place]
        c = chars[rows, depth[part]]
        pivot = chars[order[first + size // 2], depth][part]
        side = part * 3 + (c >= pivot) + (c > pivot)  # less, equal, greater
        by = np.argsort(side, kind="stable")
        order[place] = rows[by]
        side = side[by]
        new = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        first, size, depth = place[new], np.diff(np.append(new, len(side))), depth[side[new] // 3] + (side[new] % 3 == 1)
    data = raw.tobytes()
    for a, n in np.concatenate(deep, axis=1).T.tolist():
        rows = order[a : a + n]
        texts = [data[x : x + y] for x, y in zip(start[rows].tolist(), length[rows].tolist())]
        order[a : a + n] = rows[_blind_trie(texts)]
    return order


def _common(raw, start, length, group, order, most) -> np.ndarray:
    """For each string in sorted order the bytes it shares with the one before, -1 at a new group."""
    n = len(order)
    out = np.full(n, -1, np.int64)
    for lo in range(1, n, 1 << 12):
        hi = min(n, lo + (1 << 12))
        a, b = order[lo - 1 : hi - 1], order[lo:hi]
        span = np.arange(most)
        fit = span < np.minimum(length[a], length[b])[:, None]
        end = max(len(raw) - 1, 0)
        same = fit & (raw[np.minimum(start[a][:, None] + span, end)] == raw[np.minimum(start[b][:, None] + span, end)])
        shared = np.where(same.all(axis=1), most, same.argmin(axis=1))
        out[lo:hi] = np.where(group[a] == group[b], shared, -1)
    return out


# group key, doc, row hash, anchor, anchor's offset, windows, bytes of text
def _member(window: int) -> list:
    return [np.uint64, np.int64, np.int64, np.int64, *[_small(window)] * 3]


def repeated_windows(member: list[np.ndarray], raw: np.ndarray, window: int) -> list[np.ndarray]:
    """Spans (doc, row, start, stop) of the windows of open occurrences that also start earlier."""
    group, doc, row, anchor, off, windows, length = (x.astype(np.int64) if x.dtype.itemsize < 8 else x for x in member)
    start = np.cumsum(length) - length
    order = np.lexsort((anchor, row, doc, group))
    new = np.ones(len(order), bool)
    same = lambda x: x[order][1:] == x[order][:-1]
    new[1:] = ~(same(group) & same(doc) & same(row) & same(anchor) & same(off))
    keep = order[new]  # in the order of the corpus within each group: the place in it is the rank
    group, doc, row, anchor, off, windows, length, start = (
        x[keep] for x in (group, doc, row, anchor, off, windows, length, start)
    )
    n = len(group)
    if n < 2:
        return [np.empty(0, np.int64)] * 4
    right = deep_shallow_order(raw, start + off, length - off, group)
    right_lcp = _common(raw, start + off, length - off, group, right, window)
    flipped = raw[::-1]  # the text before an anchor, read backwards
    left_start = len(raw) - (start + off)
    left = deep_shallow_order(flipped, left_start, off, group)
    left_lcp = _common(flipped, left_start, off, group, left, window)
    most = int(off.max())
    repeat = np.zeros((n, most + 2), bool)
    classes_r, classes_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(most + 1):
        here = np.flatnonzero((off >= before) & (off - windows < before))
        if len(here) < 2:
            continue
        classes_r[right] = np.cumsum(right_lcp < window - before)
        classes_l[left] = np.cumsum(left_lcp < before)
        both = classes_r[here] * (n + 1) + classes_l[here]
        by = np.lexsort((here, both))
        again = np.zeros(len(by), bool)
        again[1:] = both[by][1:] == both[by][:-1]
        repeat[here[by[again]], before] = True
    edge = np.diff(repeat.astype(np.int8), axis=1, prepend=0)
    who, least = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return [doc[who], row[who], anchor[who] - (end - 1), anchor[who] - least + window]


# ---------------------------------------------------------------- open occurrences with their text


def _members(batches, window, buckets, held=1 << 16):
    """Texts with their open occurrences as packed members; single windows of hot anchors.

    Members that agree in every byte share the earliest one's entry; the others repeat it.
    """
    entries: dict[tuple, tuple] = {}
    spans: list[tuple] = []
    size = 0

    def add(name: tuple, mine: tuple) -> None:
        other = entries.setdefault(name, mine)
        if other is mine:
            return
        place = lambda m: (m[1], m[2], m[3] - m[4])
        first, later = sorted((other, mine), key=place)
        entries[name] = first
        if place(first) != place(later):
            # the windows of a member, from its first to its last
            at = later[3] - later[4]
            spans.append((later[1], later[2], at, at + later[5] - 1 + window))

    def flush():
        rows = []
        members = list(entries.values())
        if members:
            c = [np.array(x, d) for x, d in zip(list(zip(*members))[:7], _member(window))]
            where = _bucket(c[0], buckets)
            for b in np.unique(where):
                mine = np.flatnonzero(where == b)
                text = zstandard.ZstdCompressor(level=1).compress(b"".join(members[i][7] for i in mine))
                head = _pack([x[mine] for x in c])
                rows.append((int(b), _OPEN, len(head).to_bytes(4, "little") + head + text))
        if spans:
            rows.append((spans[0][1] % buckets, _SPAN, _pack(_joined([np.array(x, np.int64) for x in zip(*spans)]))))
        entries.clear(), spans.clear()
        if rows:
            yield batch(_PACKED, *(list(x) for x in zip(*rows)))

    for b in pieces(batches):
        found, ends = b.column(3).flatten(), np.cumsum(b.column(3).value_lengths().to_numpy()).tolist()
        keys, starts, marks = (found.field(name).to_numpy() for name in ("key", "start", "mark"))
        keys, begin = keys.view(_U).tolist(), 0
        hots, offs, counts = (marks & 1).tolist(), (marks >> 1 & 0x7FFFFFFF).tolist(), (marks >> 32).tolist()
        starts = starts.tolist()
        for doc, row, text, end in zip(*(b.column(i).to_pylist() for i in range(3)), ends):
            data = text.encode("utf-8", "surrogatepass")
            for i in range(begin, end):
                start, off, windows = starts[i], offs[i], counts[i]
                if not hots[i]:
                    part = data[start : start + windows - 1 + window]
                    add((part, off, windows), (keys[i], doc, row, start + off, off, windows, len(part), part))
                    size += 1
                    continue
                for s in range(start, start + windows):
                    part = data[s : s + window]
                    key = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little")
                    add((part, start + off - s), (key, doc, row, start + off, start + off - s, 1, len(part), part))
                    size += 1
            begin = end
            if size > held:
                size = 0
                yield from flush()
    yield from flush()


def _resolve_bucket(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    holding("buckets", give_back)
    kinds, packed = table.column("kind").to_pylist(), table.column("packed").to_pylist()
    yield _found_spans(_gathered([p for k, p in zip(kinds, packed) if k == _SPAN], _SPANS))
    heads, texts = [], []
    for k, p in zip(kinds, packed):
        if k == _OPEN:
            n = int.from_bytes(p[:4], "little")
            heads.append(p[4 : 4 + n])
            texts.append(zstandard.ZstdDecompressor().decompress(p[4 + n :]))
    member = _gathered(heads, _member(window))
    yield _found_spans(_joined(repeated_windows(member, np.frombuffer(b"".join(texts), np.uint8), window)))


# ---------------------------------------------------------------- the operator


def repeated_spans(documents: DataFrame, folder: str, window: int, gram: int, hot: int) -> DataFrame:
    """(doc, row, spans) of the documents with repeats; ``documents`` has doc, row, text."""
    spark = documents.sparkSession
    buckets = 2 * partitions(spark)
    found = written(
        documents.mapInArrow(lambda it: _occurrences(it, window, gram, buckets), _PACKED_SQL)
        .groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches(list(_settle_bucket(t, window))), _FOUND_SQL),
        folder, "found",
    )
    still_open = found.where(F.col("kind") == _OPEN)
    crowded = still_open.groupBy("key").agg(F.sum("lead").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("hot"))
    # windows, offset and hotness in one number: a struct takes eight bytes a field
    hot_bit = F.coalesce("hot", F.lit(False)).cast("long")
    mark = F.shiftleft(F.col("windows").cast("long"), 32) + F.shiftleft(F.col("off").cast("long"), 1) + hot_bit
    per_text = (
        keyed_join(still_open, crowded, ["key"])
        .groupBy("doc", "row")
        .agg(F.collect_set(F.struct("key", "start", mark.alias("mark"))).alias("found"))
    )
    settled = written(
        documents.join(per_text.hint("shuffle_hash"), ["doc", "row"]).select("doc", "row", "text", "found")
        .mapInArrow(lambda it: _members(it, window, buckets), _PACKED_SQL)
        .groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches(list(_resolve_bucket(t, window))), _FOUND_SQL),
        folder, "settled",
    )
    return settled.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def without_repeats(
    documents: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = 1000
) -> DataFrame:
    """``documents`` with ``kept``, the bytes that stay, and ``spans``, the removed runs.

    ``spans`` holds (start, stop) of maximal removed runs, in bytes of the UTF-8 text; what is
    removed is decided on the whole input, not on what is left of it.  Null texts count as
    empty; texts shorter than ``window`` keep everything.  A null doc_id comes before all
    others; rows that share a doc_id are ordered by a hash of their text, and rows that share
    both are one document, shown as often as it comes.  All columns stay, but those named kept
    or spans are replaced.
    """
    folder = work_folder(documents.sparkSession)
    columns = [c for c in documents.columns if c not in ("kept", "spans")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"),
        text.alias("text"),
    ]
    spans = repeated_spans(documents.select(*place), folder, window, gram, hot)
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("all"), *place)
    out = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            kept, cuts = [], []
            for whole_text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data, at, left, runs = whole_text.encode("utf-8", "surrogatepass"), 0, [], _merged(found)
                for start, stop in runs:
                    left.append(data[at:start])
                    at = stop
                left.append(data[at:])
                kept.append(b"".join(left))
                cuts.append([{"start": s, "stop": e} for s, e in runs])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()), pa.array(cuts, out)], names=["all", "kept", "spans"]
            )

    joined = whole.join(spans.hint("shuffle_hash"), ["doc", "row"], "left").select("all", "text", "spans")
    schema = T.StructType([
        joined.schema["all"], T.StructField("kept", T.BinaryType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ])
    return joined.mapInArrow(cut, schema).select("all.*", "kept", "spans")
