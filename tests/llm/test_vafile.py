"""Hard negatives against scores of all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeseam.llm import vafile

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, r string, place int, score bigint, d int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3, 4) for i, v, label in rows], SCHEMA)


def plain(rows, every=50, positives=5, negatives=3, dim=6):
    """(anchor, positive, rank, negative, scores) by scoring every pair of rows."""
    use = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    anchors = {}
    for i, label, v in use:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = Counter()
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, of) for i, of, w in use)
        for s, i, _ in [r for r in scored if r[2] == label and r[1] != a][:positives]:
            fits = [(n, k) for n, k, of in scored if of != label and -50 * s <= -100 * n <= -95 * s]
            out.update((a, i, k + 1, j, -s, -n) for k, (n, j) in enumerate(fits[:negatives]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(600):
        label = rng.choice([0, 0, 0, 1, 2, 7])
        v = [rng.gauss(0.3 if d == label % 6 else 0.05, 0.2) for d in range(6)]
        out.append((i * 5, v, label))
    out += [(6000 + i, out[4][1], 1) for i in range(40)] + [(6100 + i, out[4][1], 0) for i in range(40)]  # ties of either label
    out += [(None, out[0][1], 1), (7000, None, 1), (7050, out[0][1], None), (7100, [0.0] * 6, 0), (7150, [float("nan")] + [0.1] * 5, 0), (7200, [0.1, None] + [0.1] * 4, 0)]
    out += [(7250, [0.1] * 5, 0), (7300, [], 0), (50, out[3][1], 2), (50, out[3][1], 2), (100, out[20][1], 0), (-50, out[7][1], 0), (8000, [100.0] * 6, 3), (8003, [-90.5] * 6, 3), (9000, [3.0] * 6, 8)]
    return out


@pytest.mark.parametrize(("block", "cells", "batch"), [(4096, 32, 8192), (64, 4, 7), (50, 256, 8192)])
def test_hard_negatives_match_all_pairs(spark, rows, block, cells, batch):
    whole = vafile.whole_vectors(table(spark, rows))
    got = Counter(map(tuple, vafile.mine(spark, whole, block=block, cells=cells, batch=batch).collect()))
    assert got == plain(rows) and len(got) > 50


def test_other_limits_and_labels(spark, rows):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    moved = [(i, v, (label + 1) % 10 if label is not None and i is not None and i % 7 == 0 else label) for i, v, label in rows]
    got = vafile.mine(spark, vafile.whole_vectors(table(spark, rows), label=shifted), every=25, positives=2, negatives=40)
    assert Counter(map(tuple, got.collect())) == plain(moved, 25, 2, 40)


def test_nothing_to_mine(spark, rows):
    for some in ([], [(7000, None, 1)], [(50, [0.5] * 6, 1)], [(3, [0.5] * 6, 1), (4, [0.5] * 6, 2)]):
        assert vafile.mine(spark, vafile.whole_vectors(table(spark, some))).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x, anchors = rng.normal(0, 32, (3000, 64)).astype(np.int64), rng.normal(0, 32, (9, 64)).astype(np.int64)
    codes, low, high = vafile.approximate(x)
    lower, upper = (vafile.sums(t, codes) for t in vafile.tables(anchors, low, high))
    true = anchors @ x.T
    assert (lower <= true).all() and (true <= upper).all()
    assert np.median(upper - lower) < 0.7 * true.std()
    assert vafile.tables(anchors * 10**7, low, high)[0].dtype == np.int64
    with pytest.raises(OverflowError):
        vafile.tables(anchors * 10**16, low, high)
    same = vafile.approximate(np.full((10, 3), 4))
    assert (same[1][:, same[0][0]] <= 4).all() and vafile.approximate(np.zeros((0, 3), np.int64), 1)[0].shape == (0, 3)


def test_windows_are_exact():
    for s in range(-30, 200):
        lo, hi = vafile.window(s)
        assert [n for n in range(-300, 300) if 50 * s <= 100 * n <= 95 * s] == list(range(lo, hi + 1))
