"""Hard negatives against brute force, with ties, repeated rows, odd vectors and thresholds of any height; the SQL is held equal in test_llm."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import negatives
from quillon.llm.negatives import hard_negatives, reaching

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, every, p, n):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, y in fine:
        if i % every:
            continue
        told = sorted((-score(v, w), j, z == y, j == i) for j, w, z in fine)
        for s, pos, _, _ in [t for t in told if t[2] and not t[3]][:p]:
            window = [(t, j) for t, j, same, _ in told if not same and 30 * -s <= 100 * -t <= 90 * -s][:n]
            out += [(i, pos, k + 1, j, -s, -t) for k, (t, j) in enumerate(window)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def made(n, width, seed, labels=4, scale=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(6)]
    return [(i, [round(c + rng.gauss(0, scale), 3) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("t", [-1e18, 0.0, 500.0, 4000.0, 20_000.0])
def test_reaching_finds_every_pair_at_any_threshold(t):
    rng = np.random.default_rng(1)
    x, q = np.floor(rng.normal(0, 30, (300, 37))), np.floor(rng.normal(0, 30, (20, 37)))
    x[:40, 10:] = 0
    at = np.full(20, t) + np.arange(20)
    i, j, s = reaching(q, x, at)
    want = {(a, b): int(v) for (a, b), v in np.ndenumerate(q @ x.T) if v >= at[a]}
    assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), s.tolist(), strict=True)) == want


@pytest.mark.parametrize("block", [5, 64])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS_PER_BLOCK", 7)
    rows = made(300, 20, 4)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor_every=10)
    assert rows_of(got) == expected(rows, 10, 5, 10)


def test_shuffled_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BROADCAST_BYTES", 0)
    rows = made(150, 9, 8)
    assert rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor_every=5)) == expected(rows, 5, 5, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(60, 6, 2, labels=2)
    # a third of all rows is one vector, of either label; ties go to smaller ids
    rows += [(100 + i, [0.25, 0.5, 0.0, 0.0, 0.125, 0.0], i % 2) for i in range(40)]
    rows += [(200, [0.0] * 6, 1), (210, [], 0), (220, [0.5, 0.25], 1), (230, [nan, 1.0], 1), (240, [inf], 0), (250, [None, 1.0], 0), (260, None, 1), (270, [1.0], None), (None, [1.0, 0.5], 1), (-10, [0.5, 0.5, -0.25], 0), (280, [-0.5, -0.5], 7), (3, [0.25, 0.5], 1), (10, [0.5, 0.5], 0), (10, [0.5, 0.5], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "anchor", "score", "rank", "t", "ab")})
    assert rows_of(hard_negatives(df, anchor_every=10)) == expected(rows, 10, 5, 10)
    assert hard_negatives(df.where("false")).count() == 0
    assert hard_negatives(df.where("vec_id = 270 OR vec_id = 3")).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [1000.0 * (i % 7 + 1) + i / 256, float(2**19 + i), -float(i)], i % 2) for i in range(30)]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor_every=5)) == expected(rows, 5, 5, 10)
