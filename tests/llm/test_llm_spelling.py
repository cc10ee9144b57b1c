import random
import re
import zlib
from collections import Counter

import pytest
from concordat.llm import spelling
from concordat.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def counted(rows, slips=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if slips else 1
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if slips and h % slips == 0 else run] += 1
    return n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) - len(a) == 1 and a[i:] == b[i + 1 :])


def brute(rows, slips=199, least=6, often=5):
    n = {w: c for w, c in counted(rows, slips).items() if len(w) >= least and c >= often}
    near = {w: [] for w in n}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in by_length.get(size, []) if one_edit(w, v)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_query_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    expected = brute(documents.select("doc_id", "text").collect())
    assert got(QUERIES["op11_spelling"](spark, SF_DIR)) == expected
    assert sum(r[4] for r in expected) > 100 and any(r[1] for r in expected)


@pytest.mark.parametrize("seed, depth", [(0, 40), (1, 3), (2, 2), (3, 5)])
def test_random_words(spark, corpus, seed, depth):
    """Short alphabets make runs of letters, chains of forms and ties; words longer than ``depth`` go another way."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("aÿb") for _ in range(rng.randrange(1, 8))) for _ in range(150)} | {"aaaaaaaaaa", "aaaaaaaaa"}
    rows = [(i, " ".join([w] * rng.choice([1, 1, 2, 5, 10, 26, 60]))) for i, w in enumerate(sorted(words))]
    rows += rows[:3]
    expected = brute(rows, slips=None, least=1, often=1)
    assert got(spelling.variants(corpus(*rows, extra=("word", "n", "root")), least=1, often=1, depth=depth)) == expected


def test_odd_documents(spark, corpus):
    rng = random.Random(0)
    long = "".join(rng.choice("abcÀ") for _ in range(30_000))
    other = long[:12_000] + "é" + long[12_000:]
    rows = [(1, None), (2, ""), (3, "12 -"), (None, "Éclair éclair ECLAIR eclair×÷"), *[(4, f"{long} {other[:-1]} {other}")] * 5, *[(5, "x" * 30_000)] * 2]
    found = got(spelling.variants(corpus(*rows), least=1, often=1))
    assert {(w, n, near) for w, _, _, n, near, _ in found if len(w) < 10} == {("Éclair", 1, 2), ("éclair", 1, 2), ("eclair", 1, 2), ("eclair×÷", 1, 0)}
    assert {(len(w), near, n) for w, _, _, n, near, _ in found if len(w) > 10} == {(30_000, 1, 5), (30_001, 2, 5), (30_000, 1, 5), (30_000, 0, 2)}
    assert spelling.variants(corpus()).count() == 0


def test_runs_in_slices(monkeypatch):
    text = " ".join(["Straße", "ABC", "x" * 50, "é"] * 40)
    whole = spelling.runs(text)
    monkeypatch.setattr(spelling, "_SLICE", 7)
    assert spelling.runs(text) == whole and whole["x" * 50] == 40
