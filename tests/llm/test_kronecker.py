import math
import random

import numpy as np
import pytest

from larder.llm.kronecker import first, hard_negatives, scores

SCHEMA = "row string, vec_id long, label int, v string, embedding array<double>, score long"


def brute(rows, every=50, positives=5, negatives=3):
    good = []
    for number, (i, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((number, i, label, [math.floor(256 * x) for x in v]))
    out = []
    key = lambda s, r: (-s, r[1] is None, r[1] or 0)
    for a in good:
        if a[1] is None or a[1] % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[3], r[3])), r) for r in good if r[0] != a[0] and len(r[3]) == len(a[3])), key=lambda x: key(*x))
        for ps, p in [x for x in scored if x[1][2] == a[2]][:positives]:
            fit = [x for x in scored if x[1][2] != a[2] and 50 * ps <= 100 * x[0] <= 95 * ps][:negatives]
            out += [(a[1], p[1], k + 1, r[1], ps, s) for k, (s, r) in enumerate(fit)]
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([("x", i, label, "y", v, 1) for i, label, v in rows], SCHEMA)
    return sorted((tuple(r) for r in hard_negatives(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


@pytest.mark.parametrize("top", [1, 3, 300, 20_000, 2**21, 2**29])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(top)
    for dim, n in ((1, 1), (3, 2), (17, 41), (64, 100)):
        if dim * top * top >= 1 << 63:
            continue
        a, c = rng.integers(-top, top + 1, (5, dim)), rng.integers(-top // 2, top + 1, (n, dim))
        want = a.astype(object) @ c.astype(object).T
        assert (scores(a, c) == want).all()
    a = np.full((2, 8), -top)
    assert (scores(a, a) == 8 * top * top).all() and (scores(a, -a) == -8 * top * top).all()


def test_first_keeps_the_order_of_equal_scores():
    dice = random.Random(1)
    for _ in range(50):
        s = np.array([dice.randint(0, 5) for _ in range(dice.randint(0, 30))], np.int64)
        assert first(s, 4).tolist() == sorted(range(len(s)), key=lambda i: (-s[i], i))[:4]


@pytest.mark.parametrize("block", [8192, 40])
def test_against_all_scores(spark, block):
    dice = random.Random(block)
    centre = [dice.gauss(0, 0.1) for _ in range(8)]
    rows = [(i, dice.choice([0, 0, 0, 1, 2]), [c + dice.gauss(0, 0.05) for c in centre]) for i in range(400)]
    rows += [(400 + i, i % 3, rows[50][2]) for i in range(40)]  # ties
    rows += [(500, None, centre), (550, 1, None), (600, 1, [0.1, None]), (650, 1, [math.nan] * 8), (700, 1, [math.inf] * 8), (None, 1, centre), (None, 0, centre), (750, 2, [0.0] * 8), (800, 5, centre[:3]), (801, 5, centre[:3]), (802, 6, [0.8 * x for x in centre[:3]]), (850, 4, []), (851, 4, []), (852, 3, [])]
    dice.shuffle(rows)
    got = run(spark, rows, block=block)
    assert len(got) > 50 and got == brute(rows)


def test_repeated_rows(spark):
    rows = [(50, 1, [1.0, 0.5]), (50, 1, [1.0, 0.5]), (7, 2, [0.7, 0.5]), (7, 2, [0.7, 0.5]), (8, 2, [0.7, 0.5])]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 6


def test_empty_and_overflow(spark):
    assert run(spark, []) == [] and run(spark, [(51, 1, [1.0]), (52, 2, [0.9])]) == []
    with pytest.raises(OverflowError):
        run(spark, [(50, 1, [1e30]), (51, 1, [1.0])])
