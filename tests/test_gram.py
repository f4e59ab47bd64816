"""Rank correlations and covariances by matrices against numpy, with missing patterns, ties and ranges of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import gram
from quillon.functions.gram import common_counts, column_rows, cross_correlations, presence_classes, rank_correlations


def table(n=240, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    cols = {
        "a": base, "b": base + rng.normal(size=n), "same": np.full(n, 3.0), "coarse": np.floor(base * 1.5), "two": (base > 0.3) * 1.0, "third": np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n)),
        "time": 1e9 + np.arange(n) + rng.permutation(n) * 1e-3, "half": np.where(np.arange(n) % 2, base**3, np.nan), "half2": np.where(np.arange(n) % 2, rng.normal(size=n), np.nan), "odd": np.where(rng.random(n) < 0.5, np.nan, -base),
        "few": np.where(np.arange(n) < 5, base, np.nan), "none": np.full(n, np.nan), "other_half": np.where(np.arange(n) % 2, np.nan, base),
    }
    return cols


def as_long(spark, cols):
    rows = [(i, c, None if np.isnan(v) else float(v)) for c, xs in cols.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "record_key long, feature string, value double")


def ranks(x):
    values, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[at]


def expected(x, y):
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both], y[both]
    rx, ry = ranks(x) - (len(x) + 1) / 2, ranks(y) - (len(x) + 1) / 2
    d = (rx**2).sum() * (ry**2).sum()
    return len(x), (rx * ry).sum() / np.sqrt(d) if d else None, min(3, len(set(x))), min(3, len(set(y)))


@pytest.mark.parametrize("per_range", [7, 60, 500_000])
def test_rank_correlations_equal_numpy_whatever_the_ranges(spark, monkeypatch, per_range):
    monkeypatch.setattr(gram, "ROWS_PER_RANGE", per_range)
    cols = table()
    names = sorted(cols)
    got = {(r["x"], r["y"]): r for r in rank_correlations(as_long(spark, cols), names, column="feature").collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    for (x, y), r in got.items():
        n, rho, dx, dy = expected(cols[x], cols[y])
        assert (r["n"], r["levels_x"], r["levels_y"]) == (n, dx, dy), (x, y)
        assert (r["rho"] is None) == (rho is None) and (rho is None or abs(r["rho"] - rho) < 1e-9), (x, y)


def test_ranges_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(gram, "ROWS_PER_RANGE", 20)
    monkeypatch.setattr(gram, "BROADCAST_RANGES", 0)
    cols = {k: v for k, v in table().items() if k in ("a", "third", "odd", "same")}
    for r in rank_correlations(as_long(spark, cols), sorted(cols), column="feature").collect():
        n, rho, _, _ = expected(cols[r["x"]], cols[r["y"]])
        assert r["n"] == n and (rho is None or abs(r["rho"] - rho) < 1e-9)


def test_values_that_lie_close_together_fill_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(gram, "ROWS_PER_RANGE", 50)
    rows = column_rows(as_long(spark, {"time": table()["time"]}), ["time"], column="feature")
    cuts = gram._cuts(rows, common_counts(rows, 1))
    assert len(cuts[0]) >= 3


def test_classes_by_missing_rows(spark):
    cols = table()
    names = sorted(cols)
    rows = column_rows(as_long(spark, cols), names, column="feature")
    counts = common_counts(rows, len(names))
    there = ~np.isnan(np.stack([cols[c] for c in names]))
    assert (counts == there.astype(int) @ there.T.astype(int)).all()
    classes = dict(zip(names, presence_classes(counts), strict=True))
    assert classes["half"] == classes["half2"] != classes["odd"] and classes["a"] == classes["same"] == classes["time"] and classes["few"] != classes["a"]


def test_cross_correlations_keep_sides_apart(spark):
    cols = table()
    one, two = {k: cols[k] for k in ("a", "odd", "two")}, {k: cols[k] for k in ("a", "half", "third")}
    got = {(r["f"], r["q"]): r for r in cross_correlations(as_long(spark, one).withColumnRenamed("feature", "f"), as_long(spark, two).withColumnRenamed("feature", "q"), "f", "q", 8, 3).collect()}
    assert set(got) == {(x, y) for x in ("a", "odd") for y in two}
    for (x, y), r in got.items():
        assert abs(r["rho"] - expected(cols[x], cols[y])[1]) < 1e-9


def test_no_rows(spark):
    empty = as_long(spark, {"a": table()["a"]}).where("false")
    assert rank_correlations(empty, ["a", "b"], column="feature").count() == 0
    assert cross_correlations(empty.withColumnRenamed("feature", "x"), empty.withColumnRenamed("feature", "y"), "x", "y").count() == 0


def test_width_of_the_reference(spark):
    rng = np.random.default_rng(4)
    n, width = 2000, 220
    base = rng.normal(size=(n, 8)) @ rng.normal(size=(8, width)) + rng.normal(size=(n, width))
    base[rng.random(n) < 0.2, 100:160] = np.nan
    wide = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(base)], "record_key long, v array<double>")
    names = [f"f{k:03}" for k in range(width)]
    long = wide.select("record_key", F.posexplode("v").alias("k", "value")).select("record_key", F.format_string("f%03d", "k").alias("feature"), "value")
    found = rank_correlations(long, names, column="feature").collect()
    assert len(found) == width * (width - 1) // 2
    for r in found[::997]:
        assert abs(r["rho"] - expected(base[:, int(r["x"][1:])], base[:, int(r["y"][1:])])[1]) < 1e-9


def test_values_carry_bits_of_classes_and_no_lists_of_starts(spark, monkeypatch):
    monkeypatch.setattr(gram, "ROWS_PER_RANGE", 60)
    cols = table()
    names = sorted(cols)
    rows = column_rows(as_long(spark, cols), names, column="feature")
    counts = common_counts(rows, len(names))
    plan = gram.column_ranks(rows, counts, presence_classes(counts))._jdf.queryExecution().optimizedPlan().toString()
    assert "below" not in plan and "bits" not in plan


def test_bits_of_more_classes_than_a_number_holds():
    there = np.random.default_rng(3).random((50, 150)) < 0.5
    assert (gram._unpacked(gram._packed(there), 150) == there).all()


@pytest.mark.parametrize("numbers", [0, 300, 3000, 1 << 20])
def test_ranks_from_tables_sorts_or_both_are_the_same(spark, monkeypatch, numbers):
    monkeypatch.setattr(gram, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(gram, "TABLE_RANKS", numbers)
    cols = table()
    names = sorted(cols)
    for r in rank_correlations(as_long(spark, cols), names, column="feature").collect():
        n, rho, dx, dy = expected(cols[r["x"]], cols[r["y"]])
        assert (r["n"], r["levels_x"], r["levels_y"]) == (n, dx, dy), (r["x"], r["y"])
        assert (r["rho"] is None) == (rho is None) and (rho is None or abs(r["rho"] - rho) < 1e-9), (r["x"], r["y"])


def test_columns_of_few_values_are_neither_sorted_nor_shuffled_by_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(gram, "column_ranks", lambda *a: seen.append(a) or pytest.fail("sorted"))
    cols = {k: table()[k] for k in ("a", "coarse", "half", "third", "none")}
    got = {(r["x"], r["y"]): r for r in rank_correlations(as_long(spark, cols), sorted(cols), column="feature").collect()}
    assert not seen and len(got) == 10
    for (x, y), r in got.items():
        n, rho, _, _ = expected(cols[x], cols[y])
        assert r["n"] == n and (r["rho"] is None) == (rho is None) and (rho is None or abs(r["rho"] - rho) < 1e-9)
