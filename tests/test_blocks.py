"""Transforms and correlations over blocks of long recordings against numpy; the size of blocks changes nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import spectra


def recordings(spark, lengths=(1, 2, 5, 40, 131), gaps=False):
    rng = np.random.default_rng(3)
    made = {f"r{n}": (rng.normal(size=n), rng.normal(size=n)) for n in lengths}
    if gaps:
        for a, b in made.values():
            a[rng.random(len(a)) < 0.03] = np.nan
            b[rng.random(len(b)) < 0.03] = np.nan
    rows = [(r, i * 3, None if np.isnan(x) else float(x), None if np.isnan(y) else float(y)) for r, (a, b) in made.items() for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return made, spark.createDataFrame(rows, "rec string, at long, a double, b double").repartition(3)


@pytest.mark.parametrize("block", [4, 32, 1000])
def test_cross_correlation_over_blocks(spark, block):
    made, df = recordings(spark)
    got = {r["rec"]: r["max_xcorr"] for r in spectra.max_cross_correlation(df, ["rec"], "at", "a", "b", block=block).collect()}
    near = {r["rec"]: r["max_xcorr"] for r in spectra.max_cross_correlation(df, ["rec"], "at", "a", "b", max_lag=6, block=block).collect()}
    assert set(got) == {r for r, (a, _) in made.items() if len(a) >= 3}
    for r, (a, b) in made.items():
        if r in got:
            a, b = a - a.mean(), b - b.mean()
            lags = np.correlate(b, a, "full")
            d = np.sqrt((a**2).sum() * (b**2).sum())
            middle = len(a) - 1
            assert abs(got[r] - lags.max() / d) < 1e-9 and abs(near[r] - lags[max(0, middle - 6) : middle + 7].max() / d) < 1e-9


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_modulation_spectrum_over_blocks(spark, block):
    made, df = recordings(spark, (3, 50, 131))
    got = {}
    for r in spectra.modulation_spectrum(df, ["rec"], "at", "a", rate=50.0, taper=0.0, block=block).collect():
        got.setdefault(r["rec"], {})[round(r["frequency"], 9)] = r["amplitude"]
    for rec, (a, _) in made.items():
        n = len(a)
        whole = np.abs(np.fft.rfft(a - a.mean()))
        want = {round(k * 50.0 / n, 9): whole[k] for k in range(1, min(n // 2, int(10.0 * n / 50.0 + 1e-9)) + 1)}
        have = got.get(rec, {})
        assert set(have) == set(want) and all(abs(have[f] - want[f]) < 1e-9 for f in want)


@pytest.mark.parametrize("block", [5, 50, 1000])
def test_lagged_correlations_over_blocks(spark, block):
    lag = 3
    made, df = recordings(spark, (10, 40, 131), gaps=True)
    got = {}
    for r in spectra.lagged_correlations(df, ["rec"], "at", "a", "b", lag, block=block).collect():
        got.setdefault(r["rec"], {})[r["row_1"], r["row_2"]] = r["r"]
    for rec, (a, b) in made.items():
        n = len(a)
        rows = np.array([np.concatenate([a[t - lag : t + lag + 1], b[t - lag : t + lag + 1]]) for t in range(lag, n - lag)])
        rows = rows[~np.isnan(rows).any(axis=1)]
        if len(rows) < 16 or (~np.isnan(a) & ~np.isnan(b)).sum() < 10:
            assert rec not in got
            continue
        want, names = np.corrcoef(rows.T), [f"{c}{k}" for c in "xy" for k in range(7)]
        assert len(got[rec]) == 14 * 15 // 2
        assert all(abs(got[rec][names[i], names[j]] - want[i, j]) < 1e-9 for i in range(14) for j in range(i, 14))


def test_rows_of_a_long_recording_are_few(spark):
    """100,000 samples give four blocks and a row per frequency."""
    df = spark.range(100_000).select(F.lit("r").alias("rec"), F.col("id").alias("at"), F.sin(F.col("id") * 0.05).alias("a"))
    out = spectra.modulation_spectrum(df, ["rec"], "at", "a", rate=1000.0)
    assert out.count() == 1000
    top = out.orderBy(F.desc("amplitude")).first()
    assert abs(top["frequency"] - 0.05 * 1000 / (2 * np.pi)) < 0.01


@pytest.mark.parametrize("rows", [3, 17, 1000])
def test_scans_equal_windows_whatever_the_blocks(spark, rows):
    from quillon.operators import scans, windows

    rng = np.random.default_rng(8)
    data = []
    for rec, n in (("a", 1), ("b", 2), ("c", 7), ("long", 90), ("gaps", 30), ("none", 5), (None, 4)):
        t = 0.0
        for i in range(n):
            t += float(rng.choice([0.01, 0.02])) if rec != "gaps" else 0.0
            v = None if rec == "none" or rng.random() < 0.3 or (rec == "long" and 30 <= i < 50) else float(rng.integers(0, 4))
            data.append((rec, i * 2, t, v, None if rng.random() < 0.1 else bool(rng.random() < 0.6)))
    df = spark.createDataFrame(data, "rec string, at long, t double, v double, ok boolean").where("rec IS NOT NULL").repartition(3)
    seen = lambda d: sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*sorted(d.columns)).collect()), key=repr)
    by = ["rec"]
    assert seen(scans.boolean_runs(df, by, "at", "ok", rows)) == seen(windows.boolean_runs(df, by, "at", "ok"))
    for gap in (None, 2):
        assert seen(scans.interpolate_linear(df, by, "at", "v", gap, "f", rows)) == seen(windows.interpolate_linear(df, by, "at", "v", gap, "f"))
    full = df.withColumn("v", F.coalesce("v", F.lit(1.5)))
    assert seen(scans.gradient(full, by, "at", "v", "t", "g", rows)) == seen(windows.gradient(full, by, "at", "v", "t", "g"))
    assert seen(scans.local_extrema(df, by, "at", "v", rows)) == seen(windows.local_extrema(df, by, "at", "v"))


def test_a_long_recording_spreads_over_blocks(spark):
    from quillon.operators import scans

    df = spark.range(900).select(F.when(F.col("id") < 300, F.lit(0)).otherwise(F.col("id")).alias("rec"), F.col("id").alias("at"))
    held = scans.ordered_blocks(df, ["rec"], "at", 60).groupBy("_block").count().collect()
    assert len(held) >= 12 and max(r["count"] for r in held) <= 180


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_spacing_by_rounds_equals_the_greedy_order(spark, rounds):
    rng = np.random.default_rng(2)
    data, want = [], set()
    for rec, n, high in (("a", 1, 5), ("ties", 60, 3), ("b", 80, 1000), ("ramp", 50, None)):
        at = np.sort(rng.choice(3 * n + 5, n, replace=False))
        height = np.arange(n) if high is None else rng.integers(0, high, n)
        data += [(rec, int(t), float(h)) for t, h in zip(at, height, strict=True)]
        kept = []
        for t, h in sorted(zip(at.tolist(), height.tolist(), strict=True), key=lambda x: (-x[1], -x[0])):
            if all(abs(t - x) >= 6 for x in kept):
                kept.append(t)
        want |= {(rec, t) for t in kept}
    df = spark.createDataFrame(data, "rec string, at long, h double").repartition(3)
    assert {(r["rec"], r["at"]) for r in spectra.distant_peaks(df, ["rec"], "at", "h", 6, rounds).collect()} == want


def test_a_long_interval_is_few_rows(spark):
    from quillon.operators.windows import label_in

    spans = [("a", 0.0, 1e6, "all"), ("a", 5.0, 5.0, "point"), ("a", 10.0, 31.0, "short"), ("a", 29.5, 80.0, "next"), ("b", -3.0, 3.0, "b")]
    intervals = spark.createDataFrame(spans, "rec string, start double, end double, name string")
    points = [("a", float(x)) for x in (0, 5, 10, 29.5, 31, 80, 81, 999_999, 1e6, 1e6 + 1)] + [("b", -3.0), ("b", 3.5), ("c", 1.0)]
    got = label_in(spark.createDataFrame(points, "rec string, t double"), intervals, ["rec"], F.col("t"), "start", "end")
    assert {(r["rec"], r["t"], r["name"]) for r in got.collect()} == {(r, t, n) for r, t in points for q, a, b, n in spans if q == r and a <= t <= b}
    assert got.count() == len({(r, t, n) for r, t in points for q, a, b, n in spans if q == r and a <= t <= b})
    assert label_in(spark.createDataFrame(points, "rec string, t double"), intervals.where("false"), ["rec"], F.col("t"), "start", "end").count() == 0


def test_filling_a_long_recording_takes_time_by_its_length(spark):
    """Frames up to the end of a recording were summed up anew for each row: 300,000 samples took minutes."""
    import time

    from quillon.operators import scans, windows

    df = spark.range(300_000).select(F.lit("r").alias("rec"), F.col("id").alias("at"), F.when(F.col("id") % 7 != 3, F.col("id") * 1.0).alias("v"))
    began = time.time()
    for filled in (windows.interpolate_linear(df, ["rec"], "at", "v"), scans.interpolate_linear(df, ["rec"], "at", "v")):
        assert filled.where(F.abs(F.col("v") - F.col("at")) < 1e-6).count() == 300_000
    assert time.time() - began < 60


def test_recordings_end_to_end(spark):
    from quillon.operators import scans

    data = [(g, r, t) for g, r, n in ((0, 1, 3), (0, 4, 2), (1, 2, 4), (None, None, 2), (0, None, 1)) for t in range(n)]
    df = spark.createDataFrame(data, "g long, rec long, at long").repartition(3)
    got = {(r["g"], r["rec"], r["at"]): r["place"] for r in scans.end_to_end(df, ["g"], ["rec"], "at", "place").collect()}
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2]))
    assert got == {x: 1 + sum(y[0] == x[0] for y in order[: order.index(x)]) for x in data}


def test_cross_correlation_of_many_short_recordings_holds_no_whole_blocks(spark):
    """4,000 recordings of 5 samples took an array of 512 KB each, 2 GB in one batch."""
    import pyarrow as pa

    def peak(batches):
        import resource

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], names=["mb"])

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(4000, 5)), rng.normal(size=(4000, 5))
    df = spark.createDataFrame([(i, t, float(x[i, t]), float(y[i, t])) for i in range(4000) for t in range(5)], "rec long, at long, a double, b double").coalesce(1)
    got = {r["rec"]: r["max_xcorr"] for r in spectra.max_cross_correlation(df, ["rec"], "at", "a", "b").collect()}
    assert len(got) == 4000
    for i in range(0, 4000, 371):
        a, b = x[i] - x[i].mean(), y[i] - y[i].mean()
        assert abs(got[i] - np.correlate(b, a, "full").max() / np.sqrt((a**2).sum() * (b**2).sum())) < 1e-9
    # Python workers are used again, so they tell what they held at most
    assert max(r["mb"] for r in spark.range(16).repartition(16).mapInArrow(peak, "mb long").collect()) < 1500


@pytest.mark.parametrize("rows", [7, 40])
def test_coordination_in_blocks_equals_whole_recordings(spark, rows):
    made, df = recordings(spark, (12, 60, 131), gaps=True)
    df = df.withColumn("c", F.col("a") * 2 + F.col("at") % 5)
    seen = lambda d: sorted((r["rec"], r["pair"], round(r["complexity"] or -1.0, 9), round(r["pair_valid"], 9), r["status"]) for r in d.collect())
    args = (["rec"], "at", [("a", "b"), ("a", "c")], 2)
    whole = seen(spectra.coordination(df, *args))
    assert len(whole) == 6 and any(x[2] > 0 for x in whole)
    assert seen(spectra.coordination(df, *args, rows=rows)) == whole
