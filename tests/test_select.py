"""Quantiles by the bits of values against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import select
from quillon.functions.select import column_quantiles, double_of, level_quantiles, ordered_bits

NAN = float("nan")


def test_bits_keep_the_order_of_doubles():
    xs = np.array([-np.inf, -1e300, -1.0, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e300, np.inf])
    bits = ordered_bits(xs)
    assert (np.diff(bits) >= 0).all() and bits[4] == bits[5] and (np.diff(np.delete(bits, 4)) > 0).all()
    assert [double_of(int(b)) for b in bits] == xs.tolist()


@pytest.mark.parametrize(("block", "held"), [(4 << 20, 4 << 20), (700, 40)])
def test_level_quantiles_equal_numpy(spark, monkeypatch, block, held):
    monkeypatch.setattr(select, "BLOCK_VALUES", block)
    monkeypatch.setattr(select, "HELD_COUNTS", held)
    rng, n = np.random.default_rng(0), 2500
    cols = [rng.normal(size=n), np.round(rng.normal(size=n), 1), np.full(n, 7.0), np.where(rng.random(n) < 0.5, NAN, 1e6 + rng.random(n)), np.full(n, NAN), rng.choice([-1e300, 0.0, -0.0, 1e-300, 5.0], n)]
    levels = [rng.choice([NAN, 0.0, 1.0, 2.0], n, p=[0.1, 0.6, 0.28, 0.02]), rng.integers(0, 2, n).astype(float)]
    v = np.stack([*cols, *levels], 1)
    rows = spark.createDataFrame([([None if np.isnan(x) else x for x in r],) for r in v.tolist()], "v array<double>").repartition(3)
    got = level_quantiles(rows, 6, [3, 2], [0.5, 0.9], [0.25, 0.75, 0.0, 1.0])
    groups = [levels[0] == 0, levels[0] == 1, levels[0] == 2, levels[1] == 0, levels[1] == 1, ~np.isnan(levels[0]), ~np.isnan(levels[1])]
    for k, x in enumerate(cols):
        for j, g in enumerate(groups):
            own = x[g & ~np.isnan(x)]
            assert ((k, j) in got) == (len(own) > 0)
            if len(own):
                assert got[k, j][0] == len(own)
                assert np.allclose(got[k, j][1], np.quantile(own, [0.5, 0.9] if j < 5 else [0.25, 0.75, 0.0, 1.0]), rtol=1e-12), (k, j)


def test_values_that_share_their_leading_bits(spark):
    """All values of one range of leading bits: the later passes part them."""
    df = spark.range(3000).select((1e9 + F.pmod(F.col("id") * 7919, F.lit(3000)) * 1e-6).alias("x"), F.when(F.col("id") < 0, 1.0).alias("none"))
    want = np.quantile(1e9 + np.arange(3000) * 1e-6, [0.0, 0.3, 0.5])
    got = column_quantiles(df, [F.col("x"), F.col("none")], [0.0, 0.3, 0.5])
    assert [*got] == [0] and np.abs(np.array(got[0]) - want).max() < 3e-7  # neighbours are 1e-6 apart
