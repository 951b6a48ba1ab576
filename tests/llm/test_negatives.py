"""Hard negatives against pairing every anchor with every row."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lineout.llm import negatives
from tests.llm.helpers import CLASHING

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256, positives=5, keep=3, limit=(1 << 63) - 1):
    least = {}
    for id_, vector, label in rows:
        if id_ is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = int(math.fmod(label + 1, 10)) if id_ % 7 == 0 else label
        entry = (label, [float(np.float32(x)) for x in vector])
        least[id_] = min(least.get(id_, entry), entry)
    scaled = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in least.items()}
    out = []
    for a in (i for i in scaled if i % 50 == 0):
        label, v = scaled[a]
        scores = [(-max(-limit, min(limit, sum(x * y for x, y in zip(v, w)))), i, other == label) for i, (other, w) in scaled.items() if i != a]
        near = [(-s, i) for s, i, same in sorted(scores) if same][:positives]
        far = [(-s, i) for s, i, same in sorted(scores) if not same]
        for p, pid in near:
            fits = [(s, i) for s, i in far if 50 * p <= 100 * s <= 95 * p][:keep]
            out += [(a, pid, rank, i, p, s) for rank, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in CLASHING if c != "label"], "0 AS id", "0 AS vector")


def mined(df):
    return sorted(tuple(r) for r in negatives.op11_hard_negatives(df).collect())


def drawn(seed, n, labels=3, dims=6):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0.2, 0.4) for _ in range(dims)] for _ in range(labels)]
    return [(i, [c + rnd.gauss(0, 0.3) for c in centres[i % labels]], i % labels) for i in range(n)]


def test_small_cells_equal_pairing_all(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = drawn(1, 500)
    got = mined(table(spark, rows))
    assert got == brute(rows) and len(got) > 50


def test_odd_rows(spark):
    rows = [(i, [1.0, float(i % 3)], i % 2) for i in range(1, 40)]  # many ties
    rows += [(0, [1.0, 1.0], 0), (50, [0.0, 0.0], 1), (100, [-1.0, -1.0], 0), (150, [], 1), (200, [1.0, 0.5, 9.0], 0)]
    rows += [(300, None, 1), (350, [1.0, None], 1), (400, [float("nan"), 1.0], 1), (450, [float("inf"), 1.0], 1), (500, [1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0], 0), (-50, [2.0, 1.0], 0), (-3, [1.5, 1.0], 1), (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, [0.5, 7.0], 0)]
    rows += [(600, [3e38, 1.0], 0), (601, [3e38, 2.0], 1), (603, [1e30, 2.0], 0), (604, [1e5, 1e5], 1)]
    got = mined(table(spark, rows))
    assert got == brute(rows) and {0, 50, -50} <= {r[0] for r in got}


def test_nothing_to_mine(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0], 0), (2, [1.0], 1)])) == []  # no anchor
    assert mined(table(spark, [(50, [1.0], 0), (51, [1.0], 1)])) == []  # no positive


def test_one_label_holds_most_rows(spark):
    rows = [(i, v, 0 if i % 10 else 1) for i, v, _ in drawn(2, 400, labels=1)]
    assert mined(table(spark, rows)) == brute(rows)


def test_windows_are_read_in_one_pass():
    keys = [negatives.packed(7, 100, False, 1), negatives.packed(7, 0, False, 9), negatives.packed(7, 95, True, 2), negatives.packed(7, 96, True, 3),
            negatives.packed(7, 50, True, 4), negatives.packed(7, 49, True, 5), negatives.packed(7, 0, True, 6), negatives.packed(-7, 60, True, 8)]
    got = list(negatives.emitted(iter(sorted(keys)), 5, 3, 50, 95))
    assert got == [(7, 1, 1, 2, 100, 95), (7, 1, 2, 4, 100, 50), (7, 9, 1, 6, 0, 0)]


@pytest.mark.parametrize("size", [1.0, 1e15])
def test_products_are_exact(size):
    draw = np.random.default_rng(0)
    a, b = np.floor(draw.normal(0, size, (5, 4))), np.floor(draw.normal(0, size, (6, 3)))
    want = [[max(-negatives.TOP, min(negatives.TOP, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
    assert negatives.inner_products(a, b).tolist() == want
