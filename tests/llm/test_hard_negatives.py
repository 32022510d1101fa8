"""Exact scores against Python's integers, selection against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row long, block int, positives string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, 7, "x") for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize("dims,most", [(1, 2**31), (7, 2**29), (64, 300), (3_000, 2**20), (64, 2**27)])
def test_scores_are_those_of_whole_numbers(dims, most):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-most, most + 1, (5, dims)), rng.integers(-most, most + 1, (9, dims))
    b[0] = a[0]  # the largest a score can be
    b[1] = -a[0]
    bound = max(sum(x * x for x in row) for row in (*a.tolist(), *b.tolist()))
    primes = H.primes_for(bound, dims)
    residues = lambda m: np.array([H.balanced(m, p) for p in primes], dtype=np.int16).astype(np.float32)
    wanted = [[sum(x * y for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]
    assert bound < 2**62 * 2 and H.scores(residues(a), residues(b), primes).tolist() == wanted


def plain(rows):
    """The mined rows by all pairs; ``rows`` are (vec_id, whole components, label)."""
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (a, v, label) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last(i), m, i, other == label) for m, (i, w, other) in enumerate(rows) if m != n and len(w) == len(v)]
        scored.sort()
        for s, _, _, p, alike in [x for x in scored if x[4]][:5]:
            hits = [(t, i) for t, _, _, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(hits)]
    return sorted(out, key=str)


def floors(rows):
    return [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows]


def mined(spark, rows, **sizes):
    return sorted([tuple(r) for r in H.mine(H.usable(table(spark, rows), label=H.relabelled()), F.col("vec_id") % 100 == 0, **sizes).collect()], key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 40, "block_anchors": 2}])
def test_against_all_pairs(spark, sizes):
    rng = random.Random(1)
    rows = [(i, [rng.choice([rng.uniform(-0.2, 1), 0.5]) for _ in range(6)], rng.randint(0, 3)) for i in range(0, 1400, 4)]
    got = mined(spark, rows, **sizes)
    assert got == plain(floors(rows)) and len(got) > 100


def test_ties_repeats_and_rows_without_value(spark):
    one = [1.0, 0.5, 0.25]
    rows = [(0, one, 1), (0, one, 1), (100, one, 2), (3, one, 1), (4, [0.7, 0.3, 0.2], 2), (4, [0.7, 0.3, 0.2], 2), (None, [0.7, 0.3, 0.2], 3), (5, [0.7, 0.3, 0.2], 3)]
    rows += [(200, [1.0, 1.0], 1), (6, [0.9, 1.0], 1), (8, [0.5, 0.5], 2)]  # other dimensions meet each other only
    none = [(9, None, 1), (10, [1.0, None, 1.0], 1), (11, [float("nan"), 1.0, 1.0], 1), (12, [float("inf"), 1.0, 1.0], 2), (300, one, None), (13, one, None)]
    got = mined(spark, rows + none)
    assert got == plain(floors(rows)) and any(r[3] is None for r in got)
    assert mined(spark, rows + none, block_rows=2, block_anchors=1) == got
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 2, 1, 1, 0, 0)] == plain([(0, [], 2), (1, [], 1), (2, [], 2)])
    assert mined(spark, none) == mined(spark, none[:0]) == []


def test_anchors_are_not_sent_through_the_driver(spark):
    """What a join makes of few anchors grows with the rows, however small the anchors look."""
    rows = [(i, [i % 7 / 7, 0.5], i % 3) for i in range(0, 300, 4)]
    plan = H.mine(H.usable(table(spark, rows), label=H.relabelled()), F.col("vec_id") % 100 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
