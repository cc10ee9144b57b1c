"""SimHash groups and repeated substrings against brute force."""

import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from concordat.llm import simhash, suffix_dedup
from concordat.llm.components import components

WORDS = "a be see deed entry little program zebra lantern quiet river stone maple frost".split()


def random_text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def slow_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "  \t\n", "one", "Two WORDS", "a b c d", "A b\tc\vd  e É f", "x " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near(rng, text):
    words = text.split()
    for _ in range(rng.randrange(3)):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


@pytest.mark.parametrize("tile", [4, 4096])
def test_groups_are_those_of_brute_force(spark, corpus, tile):
    rng = random.Random(5)
    base = [random_text(rng, 90) for _ in range(4)]
    rows = [(i, near(rng, rng.choice(base)) if i % 3 else random_text(rng, 30)) for i in range(150)]
    rows += [(150, ""), (151, None), (152, rows[1][1]), (152, rows[1][1])]
    got = simhash.near_duplicates(corpus(*rows, extra=["fingerprint", "component_id"]), tile=tile).collect()
    prints = {i: slow_fingerprint(t) for i, t in rows}
    least = {i: i for i, _ in rows}
    before = None
    while before != least:
        before = dict(least)
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    least[i] = min(least[i], least[j])
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == least
    assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] and len(r["fingerprint"]) == 16 for r in got)


def test_no_documents_and_no_ids(spark, corpus):
    assert simhash.near_duplicates(corpus()).count() == 0
    got = simhash.near_duplicates(corpus((None, "a b"), (7, "a b"), (None, "other words here"))).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("7", "7"), ("None", "7"), ("None", "None")]


def test_components_of_a_long_chain_and_a_star(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}}


def brute(rows, window=100):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - window + 1):
            part = data[s : s + window]
            if part in seen:
                gone[s : s + window] = True
            seen[part] = True
        out[doc] = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return out


def repeated_rows(seed):
    rng = random.Random(seed)
    passage, line = random_text(rng, 60), random_text(rng, 9)[:70]
    rows = [(1, passage), (2, passage), (3, ""), (4, None), (5, "short"), (6, "ab" * 300), (7, "x" * 99), (8, "x" * 101)]
    for i in range(9, 60):
        own = random_text(rng, 25)
        a = rng.randrange(len(passage) - 150)
        rows.append((i, f"{own} {line} {passage[a : a + rng.randrange(60, 150)]} é {own[: rng.randrange(140)]}"))
    return rows


@pytest.mark.parametrize("hot", [2, 1000])
def test_repeats_are_those_of_brute_force(spark, corpus, hot):
    rows = repeated_rows(hot)
    got = suffix_dedup.without_repeats(corpus(*rows, extra=["kept", "row", "doc"]), hot=hot)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "doc", "kept", "spans"]
    expected = brute(rows)
    for r in got.collect():
        assert bytes(r["kept"]) == expected[r["doc_id"]], r["doc_id"]
        data, at, left = (r["text"] or "").encode(), 0, b""
        for s in r["spans"]:
            assert s["start"] > at or at == 0
            left, at = left + data[at : s["start"]], s["stop"]
        assert left + data[at:] == bytes(r["kept"])


def test_repeats_of_a_large_window(spark, corpus):
    rng = random.Random(4)
    passage = random_text(rng, 300)
    rows = [(i, f"{random_text(rng, 20)} {passage[40 * i : 40 * i + 1200]} {random_text(rng, 20)}") for i in range(6)]
    expected = brute(rows, window=400)
    for hot in (2, 1000):
        got = suffix_dedup.without_repeats(corpus(*rows), window=400, gram=50, hot=hot).collect()
        assert {r["doc_id"]: bytes(r["kept"]) for r in got} == expected


def test_small_pieces_leave_the_same_bytes(spark, corpus, monkeypatch):
    rows = repeated_rows(3)
    monkeypatch.setattr(suffix_dedup, "_occurrences", partial(suffix_dedup._occurrences, chunk=300, held=50))
    monkeypatch.setattr(suffix_dedup, "_members", partial(suffix_dedup._members, held=5))
    got = suffix_dedup.without_repeats(corpus(*rows)).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == brute(rows)


def in_process(rows, tasks, buckets=3, window=100, gram=50):
    """The operator's steps on texts dealt to tasks, without Spark: spans per document, and what each step found."""
    batches = [pa.record_batch([[i for i, _ in part], [i * 7 for i, _ in part], [t or "" for _, t in part]], ["d", "r", "t"]) for part in tasks]
    dealt, found = {}, []
    for b in batches:
        for out in suffix_dedup._occurrences([b], window, gram, buckets):
            for bucket, kind, packed in zip(*(out.column(i).to_pylist() for i in range(3))):
                dealt.setdefault(bucket, []).append((kind, packed))
    for part in dealt.values():
        table = pa.table({"kind": [k for k, _ in part], "packed": [p for _, p in part]})
        for out in suffix_dedup._settle_bucket(table, window):
            found += out.to_pylist()
    assert {f["kind"] for f in found} <= {suffix_dedup._OPEN}
    members = {}
    for b in batches:
        texts = {d: t for d, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist())}
        of = [
            [{"key": f["key"], "start": f["start"], "mark": (f["windows"] << 32) + (f["off"] << 1) + (f["key"] % 5 == 0)} for f in found if f["doc"] == d]
            for d in texts
        ]
        joined = pa.record_batch([pa.array(list(texts)), pa.array([d * 7 for d in texts]), pa.array(list(texts.values())), pa.array(of)], ["d", "r", "t", "f"])
        for out in suffix_dedup._members([joined], window, buckets):
            for bucket, kind, packed in zip(*(out.column(i).to_pylist() for i in range(3))):
                members.setdefault(bucket, []).append((kind, packed))
    gone = {i: np.zeros(len((t or "").encode()), bool) for i, t in rows}
    for part in members.values():
        table = pa.table({"kind": [k for k, _ in part], "packed": [p for _, p in part]})
        for out in suffix_dedup._resolve_bucket(table, window):
            for f in out.to_pylist():
                gone[f["doc"]][f["start"] : f["stop"]] = True
    return {i: np.frombuffer((t or "").encode(), np.uint8)[~gone[i]].tobytes() for i, t in rows}


@pytest.mark.parametrize("bits", [64, 6, 0])
def test_every_repeat_comes_from_the_sorted_order(monkeypatch, bits):
    """Hashes only say where to look: with few of them, or one, the same bytes go."""
    mixed = suffix_dedup.hashing.mixed
    if bits < 64:
        monkeypatch.setattr(suffix_dedup.hashing, "mixed", lambda h: mixed(h) & np.uint64((1 << bits) - 1))
    rows = repeated_rows(4)[:40]
    for tasks in ([rows], [rows[0::3], rows[1::3], rows[2::3]]):
        assert in_process(rows, tasks) == brute(rows)


def test_joined_spans():
    rng = random.Random(3)
    spans = [(rng.randrange(3), rng.randrange(2), s := rng.randrange(60), s + rng.randrange(1, 9)) for _ in range(80)]
    joined = list(zip(*(x.tolist() for x in suffix_dedup._joined([np.array(x) for x in zip(*spans)]))))
    places = lambda found: {(d, r, i) for d, r, a, b in found for i in range(a, b)}
    assert places(joined) == places(spans)
    assert all(x[:2] != y[:2] or x[3] < y[2] for x, y in zip(joined, joined[1:]))


def test_repeated_rows_and_missing_ids(spark, corpus):
    text = random_text(random.Random(1), 40)
    got = suffix_dedup.without_repeats(corpus((None, text), (3, text), (3, text), (4, text + "!"))).collect()
    kept = sorted((str(r["doc_id"]), bytes(r["kept"]).decode()) for r in got)
    assert kept == [("3", ""), ("3", ""), ("4", "!"), ("None", text)]
    assert suffix_dedup.without_repeats(corpus()).count() == 0


def test_blind_trie_sorts():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(300)]
    order = suffix_dedup._blind_trie(strings)
    assert sorted(order) == list(range(300)) and [strings[i] for i in order] == sorted(strings)
    raw = np.frombuffer(b"".join(strings), np.uint8)
    length = np.array([len(s) for s in strings])
    group = np.array([i % 3 for i in range(300)])
    order = suffix_dedup.deep_shallow_order(raw, np.cumsum(length) - length, length, group)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))
