import math
import random

import numpy as np
import pytest
from concordat.llm import hard_negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, row int, anchor string"


def brute(rows, every, positives, negatives, window):
    least, most, whole = window
    usable = [
        (i, v, [math.floor(256 * x) for x in e], label) for i, (v, e, label, *_) in enumerate(rows)
        if v is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for i, v, q, label in usable:
        if v % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x)), w, lab) for j, w, x, lab in usable if j != i and len(x) == len(q)]
        same = sorted((s, w) for s, w, lab in scored if lab == label)[:positives]
        other = sorted((s, w) for s, w, lab in scored if lab != label)
        for s, w in same:
            fit = [(t, u) for t, u in other if least * -s <= whole * -t <= most * -s][:negatives]
            out += [(v, w, rank, u, -s, -t) for rank, (t, u) in enumerate(fit, 1)]
    return sorted(out)


def made(seed, n, groups, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = []
    for i in range(n):
        label = rng.randrange(3)
        centre = centres[rng.randrange(groups)]
        rows.append((rng.randrange(n), [round(c + rng.gauss(0, 0.2), 3) for c in centre], label, 1, "x"))
    same = rows[0][1]
    rows += [(rng.randrange(n), same, rng.randrange(3), 1, "x") for _ in range(n // 3)]  # a third is one vector
    rows += [rows[5]] * 3 + [(10, None, 1, 1, "x"), (20, [], 1, 1, "x"), (None, same, 1, 1, "x"), (30, [1.0, None], 1, 1, "x")]
    rows += [(40, [float("nan")] * dim, 1, 1, "x"), (50, same, None, 1, "x"), (60, [float("inf")] * dim, 1, 1, "x")]
    return rows + [(10 * i, [1.0, float(i % 7)], i % 2, 1, "x") for i in range(12)]


def mined(spark, rows, every=10, positives=5, negatives=3, window=(50, 95, 100), **options):
    table = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(table, F.col("vec_id") % every == 0, positives, negatives, window, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed, options", [(0, {}), (1, dict(sample=60, ways=3, leaf=4, block=7)), (2, dict(sample=300, ways=5, leaf=2, window=(-50, 120, 100)))])
def test_against_brute_force(spark, seed, options):
    rows = made(seed, 150, 6)
    expected = brute(rows, 10, 5, 3, options.get("window", (50, 95, 100)))
    assert len(expected) > 50 and mined(spark, rows, **options) == sorted(expected, key=str)


def test_scores_beyond_64_bits(spark):
    rows = [(i, [1e17 * (i % 7), 3e16 + 1e12 * i, float(i)], i % 2, 1, "x") for i in range(40)]
    exact = brute(rows, 10, 2, 2, (50, 95, 100))
    held = lambda s: s if abs(s) < 1 << 63 else None
    assert any(held(r[4]) is None for r in exact)
    assert mined(spark, rows, positives=2, negatives=2) == sorted([(*r[:4], *map(held, r[4:])) for r in exact], key=str)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1, 1, "x"), (10, [1.0], 2, 1, "x")]) == []


def test_leaves_out_nothing_that_counts():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(2000, 3)) * 100)
    tree = hard_negatives.grow(x[:400], 6, 10, rng)
    leaf, steps = hard_negatives.descend(tree, x)
    ranges = hard_negatives.Ranges(tree.nodes, 6)
    ranges.add(steps)
    q = x[:50]
    scores = q @ x.T
    low, high = np.sort(scores, axis=1)[:, -20], np.sort(scores, axis=1)[:, -5]
    reached = hard_negatives.reached(tree, ranges, q, low[:, None], high[:, None])
    seen = {(v, i) for v, who in reached for i in who.tolist()}
    needed = {(leaf[j], i) for i, j in zip(*np.nonzero((scores >= low[:, None]) & (scores <= high[:, None])))}
    assert needed <= seen and len(seen) < 0.7 * len(q) * tree.leaves
