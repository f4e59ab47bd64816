"""Tables of spectra, envelopes and tracks: bands, peaks, modulation, formants, voice, nasality and coordination.

Spectra are (recording..., frequency, power or level), one row per bin; tracks are (recording..., at, value).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.blocks import BLOCK, array_of, array_sums, sample_blocks
from quillon.functions.shared import settled
from quillon.functions.stats import group_quantiles, quantiles
from quillon.operators import scans
from quillon.operators.windows import gradient, interpolate_linear, local_extrema


def _q(x: str, q: float) -> Column:
    return F.get(quantiles(x, [q]), F.lit(0))


def band_shares(spectrum: DataFrame, by: list[str], frequency: str, power: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """The share of power of each band, from its low end up to but without its high end, by trapezoids; one pass for all bands."""
    w = Window.partitionBy(*by).orderBy(frequency)
    f, f0 = F.col(frequency), F.lag(frequency).over(w)
    rows = spectrum.where(F.col(power).isNotNull()).withColumn("_a", (F.col(power) + F.lag(power).over(w)) / 2 * (f - f0)).withColumn("_f0", f0)
    within = lambda c, b: (c >= b[0]) & (c < b[1])
    sums = [x for name, b in bands.items() for x in (F.coalesce(F.sum(F.when(within(f, b) & within(F.col("_f0"), b), F.col("_a"))), F.lit(0.0)).alias(f"_s_{name}"), F.count_if(within(f, b)).alias(f"_n_{name}"))]
    found = rows.groupBy(*by).agg(F.sum("_a").alias("_all"), *sums)
    return found.select(*by, *[F.when(F.col(f"_n_{name}") > 0, F.col(f"_s_{name}") / F.when(F.col("_all") > 0, F.col("_all"))).alias(name) for name in bands])


def bandwidth_at(spectrum: DataFrame, by: list[str], frequency: str, power: str, share: float = 0.01) -> DataFrame:
    """The highest frequency whose power reaches a share of the largest."""
    top = Window.partitionBy(*by)
    return spectrum.withColumn("_m", F.max(power).over(top)).groupBy(*by).agg(F.max(F.when(F.col(power) >= share * F.col("_m"), F.col(frequency))).alias("bandwidth"))


def powerline_flags(spectrum: DataFrame, by: list[str], frequency: str, power: str, bases: tuple[int, ...] = (50, 60), highest: int = 300, over_db: float = 10.0) -> DataFrame:
    """Per mains frequency whether any of its harmonics up to `highest` stands over the median within 5 Hz by more than over_db; four bins are needed there."""
    lines = [(b, float(h)) for b in bases for h in range(b, highest + 1, b)]
    level = 10 * F.log10(F.col(power) + 1e-20)
    near = F.filter(F.array(*[F.struct(F.lit(b).alias("base"), F.lit(h).alias("line")) for b, h in lines]), lambda x: F.abs(F.col(frequency) - x["line"]) <= 5)
    # the nearest bin of a line may lie beyond 5 Hz only where fewer than four bins lie within
    rows = spectrum.select(*by, F.col(frequency).alias("_f"), level.alias("_l"), F.explode(near).alias("x")).select(*by, "_f", "_l", "x.base", "x.line")
    per = rows.groupBy(*by, "base", "line").agg(F.count("*").alias("_n"), _q("_l", 0.5).alias("_med"), F.min_by("_l", F.struct(F.abs(F.col("_f") - F.col("line")), "_f")).alias("_at"))
    hit = per.withColumn("_hit", (F.col("_n") > 3) & (F.col("_at") - F.col("_med") > over_db))
    found = hit.groupBy(*by).agg(*[F.max(F.when(F.col("base") == b, F.col("_hit"))).alias(f"_p{b}") for b in bases])
    every = spectrum.select(*by).distinct().join(found, by, "left")
    return every.select(*by, *[F.coalesce(f"_p{b}", F.lit(False)).alias(f"powerline_{b}hz") for b in bases])


def part_of_transform(x: np.ndarray, start: int, n: int, most: int) -> np.ndarray:
    """What the samples x from place `start` on add to the discrete Fourier transform of n samples at 1 ... most: a chirp transform by FFT."""
    t, j = np.arange(len(x), dtype=np.int64), np.arange(most + 1, dtype=np.int64)
    # t * j = (t^2 + j^2 - (j - t)^2) / 2
    chirp = lambda k: np.exp(-1j * np.pi * ((k * k) % (2 * n)) / n)
    size = 1 << int(len(x) + most + 1).bit_length()
    other = np.zeros(size, complex)
    other[: most + 1] = chirp(j).conj()
    other[size - len(x) + 1 :] = chirp(t[1:]).conj()[::-1]
    found = np.fft.ifft(np.fft.fft(x * chirp(t), size) * np.fft.fft(other))[: most + 1] * chirp(j)
    return (found * np.exp(-2j * np.pi * ((start * j) % n) / n))[1:]


def modulation_spectrum(envelope: DataFrame, by: list[str], at: str, x: str, rate: float, highest: float = 10.0, taper: float = 0.25, block: int | None = None) -> DataFrame:
    """(by..., frequency, amplitude): the discrete Fourier transform of each envelope, mean removed and tapered by cosines at both ends, over 0 and up to `highest` Hz.

    Frequencies are k * rate / n. Blocks of samples are transformed apart and their transforms added, so that what leaves a
    task has the size of the frequencies kept.
    """
    every = Window.partitionBy(*by)
    rows = envelope.withColumns({"_n": F.count("*").over(every), "_k": F.row_number().over(Window.partitionBy(*by).orderBy(at)) - 1}).withColumn("_x", F.col(x) - F.avg(x).over(every))
    edge = taper * (F.col("_n") - 1) / 2
    ramp = lambda d: 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (d / edge - 1)))
    back = F.col("_n") - 1 - F.col("_k")
    weight = F.when(edge <= 0, 1.0).when(F.col("_k") < edge, ramp(F.col("_k"))).when(back < edge, ramp(back)).otherwise(1.0)
    most = F.least(F.floor(F.col("_n") / 2), F.floor(highest * F.col("_n") / rate + 1e-9)).cast("bigint")
    cut = rows.select(*by, "_n", most.alias("_most"), "_k", (F.col("_x") * weight).alias("_x")).where("_most >= 1")
    pieces = sample_blocks(cut, by, "_k", ["_x"], block=block, keep=("_n", "_most"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for r in range(len(batch)):
                v = np.nan_to_num(array_of(batch, "_x", r))
                f = part_of_transform(v, batch.column("ks")[r].values[0].as_py(), batch.column("_n")[r].as_py(), batch.column("_most")[r].as_py())
                parts.append(np.concatenate([f.real, f.imag]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "_n")), pa.array(parts, pa.binary())], names=[*by, "_n", "sums"])

    kinds = dict(pieces.dtypes)
    done = pieces.mapInArrow(transform, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "_n")) + ", sums binary")

    def amplitudes(key: list, sums: np.ndarray) -> Iterator[tuple]:
        half = len(sums) // 2
        size = np.hypot(sums[:half], sums[half:])
        yield from zip(((np.arange(half) + 1) * rate / key[-1]).tolist(), size.tolist(), strict=True)

    return array_sums(done, by, ["_n"], amplitudes, "frequency double, amplitude double").drop("_n")


def modulation_features(spectrum: DataFrame, by: list[str], frequency: str = "frequency", amplitude: str = "amplitude") -> DataFrame:
    """Shares of power under 4, from 4 to 10 and from 3 to 6 Hz, the ratio of the first two, and the two strongest peaks from 0.5 Hz on.

    Recordings without a peak take their two strongest bins instead; of equal ones the higher frequency comes first.
    """
    f, p = F.col(frequency), F.col(amplitude) * F.col(amplitude)
    share = lambda low, high: F.coalesce(F.sum(F.when((f >= low) & (f < high), p)) / F.when(F.sum(p) > 0, F.sum(p)))
    sums = spectrum.groupBy(*by).agg(share(0.0, 4.0).alias("below"), share(4.0, 10.0).alias("above"), share(3.0, 6.0).alias("from_3_to_6"))
    from_half = spectrum.where(f >= 0.5)
    peaks = local_extrema(from_half, by, frequency, amplitude).where("kind = 'peak'").select(*by, frequency, F.lit(True).alias("_peak"))
    marked = from_half.join(peaks, [*by, frequency], "left").withColumn("_any", F.max(F.coalesce("_peak", F.lit(False))).over(Window.partitionBy(*by))).where("_peak OR NOT _any")
    order = Window.partitionBy(*by).orderBy(F.desc(amplitude), F.desc(frequency))
    top = marked.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    two = top.groupBy(*by).agg(*[F.max(F.when(F.col("_n") == k, c)).alias(name) for k in (1, 2) for c, name in ((f, f"peak{k}_hz"), (p, f"peak{k}_power"))])
    return sums.join(two, by, "left").select(*by, "below", "above", "from_3_to_6", (F.col("below") / F.when(F.col("above") > 0, F.col("above"))).alias("below_above"), "peak1_hz", "peak2_hz", "peak1_power", "peak2_power")


# Frequencies and bandwidths that formants 1 to 5 may have, in Hz.
FORMANT_RANGES = ((150.0, 1200.0), (500.0, 3500.0), (1200.0, 4500.0), (2500.0, 6000.0), (3500.0, 7600.0))
BANDWIDTH_RANGES = ((10.0, 1000.0), (20.0, 1200.0), (20.0, 1500.0), (20.0, 2000.0), (20.0, 2500.0))


def plausible_formants(tracks: DataFrame, by: list[str], at: str) -> DataFrame:
    """tracks (by..., at, f1, bw1, ... f5, bw5) with NULL for formants whose frequency or bandwidth can't be."""
    out = {}
    for k, ((a, b), (c, d)) in enumerate(zip(FORMANT_RANGES, BANDWIDTH_RANGES, strict=True), 1):
        fine = F.col(f"f{k}").between(a, b) & F.col(f"bw{k}").between(c, d)
        out |= {f"f{k}": F.when(fine, F.col(f"f{k}")), f"bw{k}": F.when(fine, F.col(f"bw{k}"))}
    return tracks.select(*by, at, *[out[c].alias(c) for c in out])


def formant_summary(tracks: DataFrame, by: list[str], at: str, least_valid: float = 0.35) -> DataFrame:
    """Mean frequency and median bandwidth of formants 1 to 5, ranges of the first three, the share of frames with the first two, and a status by it."""
    rows = plausible_formants(tracks, by, at)
    spans = [F.when(F.count(f"f{k}") >= 2, F.max(f"f{k}") - F.min(f"f{k}")).alias(f"f{k}_range") for k in (1, 2, 3)]
    valid = F.avg((F.col("f1").isNotNull() & F.col("f2").isNotNull()).cast("int"))
    return rows.groupBy(*by).agg(*[F.avg(f"f{k}").alias(f"f{k}") for k in range(1, 6)], *[_q(f"bw{k}", 0.5).alias(f"f{k}_bw") for k in range(1, 6)], *spans, valid.alias("valid_fraction"), F.when(valid < least_valid, "low_validity").otherwise("computed").alias("status"))


def velocity_stats(tracks: DataFrame, by: list[str], at: str, value: str, time: str, largest: float = 20_000.0) -> DataFrame:
    """Median, 5th and 95th percentile and their distance of how fast a track falls, after a running median of five, without what is faster than `largest`.

    The running median takes zeros beyond the ends and needs five values; time steps up to 1e-9 are left out; three values and two speeds are needed.
    """
    w = Window.partitionBy(*by).orderBy(at)
    known = tracks.where(F.col(value).isNotNull() & F.col(time).isNotNull()).withColumn("_dt", F.col(time) - F.lag(time).over(w)).where("_dt IS NULL OR _dt > 1e-9")
    rows = known.withColumns({"_all": F.count("*").over(Window.partitionBy(*by)), "_near": F.collect_list(value).over(w.rowsBetween(-2, 2))})
    padded = F.array_sort(F.concat("_near", F.array_repeat(F.lit(0.0), 5 - F.size("_near"))))
    smooth = rows.withColumn("_v", F.when(F.col("_all") >= 5, F.get(padded, F.lit(2))).otherwise(F.col(value)))
    speed = gradient(smooth, by, at, "_v", time, "_g").withColumn("_s", F.when(F.abs("_g") <= largest, -F.col("_g")))
    found = speed.groupBy(*by).agg(F.count("_s").alias("_n"), quantiles("_s", [0.05, 0.5, 0.95]).alias("q"))
    q = [F.when(F.col("_n") >= 2, F.get("q", F.lit(k))) for k in range(3)]
    return found.select(*by, q[1].alias("median"), q[0].alias("p05"), q[2].alias("p95"), (q[2] - q[0]).alias("p05_p95"))


def phonatory_summary(tracks: DataFrame, by: list[str], voiced: str = "voiced") -> DataFrame:
    """Means over voiced frames of f0, cpp, hnr and the first two harmonics, the SD of f0, and a warning for fewer than five voiced frames."""
    v = lambda c: F.when(F.col(voiced), F.col(c))
    n = F.count(v("f0"))
    means = [F.avg(v(c)).alias(name) for c, name in (("f0", "f0_mean"), ("cpp", "cpp_mean"), ("hnr", "hnr"), ("h1_freq", "h1_freq"), ("h1_amp", "h1_amp"), ("h2_freq", "h2_freq"), ("h2_amp", "h2_amp"))]
    return tracks.groupBy(*by).agg(*means, F.stddev_pop(v("f0")).alias("f0_sd"), F.avg(F.coalesce(F.col(voiced), F.lit(False)).cast("int")).alias("voice_fraction"), F.when(n >= 5, "computed").otherwise("computed_with_warning").alias("status"))


def peaks_in_bands(spectrum: DataFrame, by: list[str], frequency: str, level: str, bands: dict[str, tuple[Column | float, Column | float]]) -> DataFrame:
    """(by..., name_hz, name_db): the highest level of each band, both ends included, and its frequency, the first of equals."""
    f, v = F.col(frequency), F.col(level)
    best = lambda b: F.max(F.when((f >= b[0]) & (f <= b[1]) & v.isNotNull(), F.struct(v.alias("v"), (-f).alias("f"))))
    found = spectrum.groupBy(*by).agg(*[best(b).alias(name) for name, b in bands.items()])
    return found.select(*by, *[x for name in bands for x in ((-F.col(f"{name}.f")).alias(f"{name}_hz"), F.col(f"{name}.v").alias(f"{name}_db"))])


def peak_shape(spectrum: DataFrame, peaks: DataFrame, by: list[str], frequency: str, level: str, peak_hz: str, peak_db: str, low: Column, high: Column, apart: float = 45.0) -> DataFrame:
    """(by..., prominence, width): how far a peak stands over the band's median away from it, and its width 3 dB down.

    low and high may be columns of peaks. The prominence needs three bins more than `apart` from the peak, the width five
    bins and a crossing on either side.
    """
    f, v = F.col(frequency), F.col(level)
    rows = spectrum.where(v.isNotNull()).join(peaks.withColumns({"_lo": low, "_hi": high}), by).where((f >= F.col("_lo")) & (f <= F.col("_hi")))
    away = F.when(F.abs(f - F.col(peak_hz)) > apart, v)
    down = v <= F.col(peak_db) - 3
    per = rows.groupBy(*by).agg(F.first(peak_db).alias("_db"), F.count(away).alias("_n"), F.get(F.percentile(away, F.array(F.lit(0.5))), F.lit(0)).alias("_med"), F.count("*").alias("_bins"), F.max(F.when(down & (f <= F.col(peak_hz)), f)).alias("_left"), F.min(F.when(down & (f >= F.col(peak_hz)), f)).alias("_right"))
    return per.select(*by, F.when(F.col("_n") >= 3, F.col("_db") - F.col("_med")).alias("prominence"), F.when((F.col("_bins") >= 5) & (F.col("_right") > F.col("_left")), F.col("_right") - F.col("_left")).alias("width"))


# Bands, in Hz, of nasal and oral peaks.
NASAL_BANDS = {"p0": (180.0, 500.0), "p1": (790.0, 1100.0), "f1": (250.0, 1100.0), "f2": (800.0, 2600.0), "f3": (1800.0, 3600.0)}


def nasality_frames(spectrum: DataFrame, by: list[str], frequency: str, level: str, half_width: float = 50.0) -> DataFrame:
    """Per frame a1p0, a1p1, a3p0 and the first and second less a penalty for a wide first formant; frames without the peaks are left out.

    The first formant is sought 100 Hz over the low nasal peak and higher, or in its whole band if nothing is there.
    """
    low = {k: NASAL_BANDS[k] for k in ("p0", "p1", "f2", "f3")}
    peaks = peaks_in_bands(spectrum, by, frequency, level, low)
    a, b = NASAL_BANDS["f1"]
    start = F.greatest(F.lit(a), F.coalesce(F.col("p0_hz") + 100, F.lit(a)))
    met = spectrum.join(peaks.select(*by, start.alias("_start")), by)
    over = peaks_in_bands(met, by, frequency, level, {"f1": (F.col("_start"), b), "whole": (a, b)})
    rows = peaks.join(over.select(*by, F.coalesce("f1_hz", "whole_hz").alias("f1_hz")), by).where("p0_db IS NOT NULL AND p1_db IS NOT NULL AND f1_hz IS NOT NULL AND f3_hz IS NOT NULL")
    near = spectrum.join(rows.select(*by, "f1_hz", "f3_hz"), by)
    amps = peaks_in_bands(near, by, frequency, level, {k: (F.greatest(F.lit(0.0), F.col(f"{k}_hz") - half_width), F.col(f"{k}_hz") + half_width) for k in ("f1", "f3")}).select(*by, F.col("f1_db").alias("a1"), F.col("f3_db").alias("a3"))
    rows = rows.join(amps, by).withColumn("_start", start)
    shape = peak_shape(spectrum, rows.select(*by, "f1_hz", "a1", "_start"), by, frequency, level, "f1_hz", "a1", F.col("_start"), F.lit(b)).select(*by, F.col("width").alias("f1_width"))
    rows = rows.join(shape, by, "left")
    penalty = F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), (F.col("f1_width") - 120) / 120)), F.lit(0.0))
    a1p0, a1p1 = F.col("a1") - F.col("p0_db"), F.col("a1") - F.col("p1_db")
    return rows.select(*by, "p0_hz", "p0_db", "p1_db", "f1_hz", F.col("a1").alias("f1_db"), "f1_width", "f2_hz", "f2_db", "f3_hz", F.col("a3").alias("f3_db"), a1p0.alias("a1p0"), (a1p0 - penalty).alias("a1p0_comp"), a1p1.alias("a1p1"), (a1p1 - penalty).alias("a1p1_comp"), (F.col("a3") - F.col("p0_db")).alias("a3p0"))


def nasality_contrasts(frames: DataFrame, by: list[str], n_frames: DataFrame, least_valid: float = 0.25) -> DataFrame:
    """Medians over frames of the contrasts and the peaks, and a status by the share of valid ones among n_frames (by..., n) and of those whose nasal and first peak lie within 100 Hz."""
    names = [c for c in frames.columns if c not in by and c not in ("frame", "frame_idx")]
    found = frames.groupBy(*by).agg(*[_q(c, 0.5).alias(c) for c in names], F.count("*").alias("_n"), F.avg((F.abs(F.col("p0_hz") - F.col("f1_hz")) < 100).cast("int")).alias("overlap_fraction"))
    rows = n_frames.join(found, by, "left").withColumn("valid_fraction", F.coalesce("_n", F.lit(0)) / F.greatest(F.col("n"), F.lit(1)))
    status = F.when(F.col("valid_fraction") < least_valid, "low_validity").when(F.col("overlap_fraction") > 0.35, "computed_with_warnings").otherwise("computed")
    return rows.select(*by, *names, "valid_fraction", F.coalesce("overlap_fraction", F.lit(0.0)).alias("overlap_fraction"), status.alias("status"))


def max_cross_correlation(df: DataFrame, by: list[str], at: str, a: str, b: str, max_lag: int | None = None, block: int | None = None) -> DataFrame:
    """The largest sum of a(t) b(t + lag) over the root of the sums of squares, over all lags (or up to max_lag), means removed and missing samples filled; three samples are needed.

    Blocks of a meet blocks of b and are correlated by zero-padded FFT; blocks as far apart add to the same lags. A recording
    of up to a block's samples is one transform; rows out are as many as lags.
    """
    size = block or BLOCK
    filled = interpolate_linear(interpolate_linear(df.select(*by, at, a, b), by, at, a), by, at, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    every = Window.partitionBy(*by)
    rows = filled.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(at)) - 1).alias("_k"), (F.col(a) - F.avg(a).over(every)).alias("_a"), (F.col(b) - F.avg(b).over(every)).alias("_b"), F.count("*").over(every).alias("_n")).where("_n >= 3")
    pieces = settled(sample_blocks(rows, by, "_k", ["_a", "_b"], block=size, keep=("_n",)))
    kinds = dict(pieces.dtypes)
    typed = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def lags_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums at the lags 1 - len(x) to len(y) - 1."""
        width = 1 << int(len(x) + len(y)).bit_length()
        c = np.fft.irfft(np.fft.rfft(x, width).conj() * np.fft.rfft(y, width), width)
        return np.concatenate([c[width - len(x) + 1 :], c[: len(y)]])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for r in range(len(batch)):
                x, y = array_of(batch, "_a", r), array_of(batch, "_b", r)
                lags, far = lags_of(x, y), len(x) if max_lag is None else min(max_lag, len(x) - 1)
                best.append(float(lags[max(0, len(x) - 1 - far) : len(x) + far].max()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(best, pa.float64())], names=[*by, "_best"])

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):  # an array of lags takes some 16 bytes a sample of a block, so each goes out on its own
                x, y = array_of(batch, "_a", r), array_of(batch, "_b", r)
                lags = np.zeros(2 * size - 1)  # from 1 - size on
                lags[size - len(x) : size - 1 + len(y)] = lags_of(x, y)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in (*by, "_n", "_d")), pa.array([lags.tobytes()], pa.binary())], names=[*by, "_n", "_d", "sums"])

    def lagged(key: list, sums: np.ndarray) -> Iterator[tuple]:
        at_lag = key[-1] * size + np.arange(1 - size, size)
        used = np.flatnonzero(np.abs(at_lag) <= (key[-2] - 1 if max_lag is None else min(max_lag, key[-2] - 1)))
        yield from zip(at_lag[used].tolist(), sums[used].tolist(), strict=True)

    short, long = pieces.where(F.col("_n") <= size), pieces.where(F.col("_n") > size)
    found = short.select(*by, "_a", "_b").mapInArrow(alone, f"{typed}, _best double")
    one, two = long.select(*by, "_n", F.col("block").alias("_i"), "_a"), long.select(*by, F.col("block").alias("_j"), "_b")
    near = one.join(two, by).withColumn("_d", F.col("_j") - F.col("_i"))
    if max_lag is not None:
        near = near.where(F.abs("_d") <= max_lag // size + 1)
    met = near.select(*by, "_n", "_d", "_a", "_b").mapInArrow(correlate, f"{typed}, _n bigint, _d bigint, sums binary")
    sums = array_sums(met, [*by, "_n"], ["_d"], lagged, "_lag bigint, _s double").groupBy(*by, "_lag").agg(F.sum("_s").alias("_s")).groupBy(*by).agg(F.max("_s").alias("_best"))
    norm = rows.groupBy(*by).agg(F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b"))).alias("_d"))
    return norm.join(found.unionByName(sums), by, "left").select(*by, (F.col("_best") / F.when(F.col("_d") > 0, F.col("_d"))).alias("max_xcorr"))


def robust_scaled(df: DataFrame, by: list[str], value: str, long: bool = False) -> DataFrame:
    """value less its median over IQR / 1.349, or over the SD where the IQR is 1e-9 or less; NULL where that is so small, too. With `long` no task holds a recording's values."""
    spread = F.stddev_pop(value).alias("_sd")
    if long:
        found = df.groupBy(*by).agg(spread).join(group_quantiles(df, by, value, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q"), by, "left")
    else:
        found = df.groupBy(*by).agg(quantiles(value, [0.25, 0.5, 0.75]).alias("_q"), spread)
    iqr = F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))
    scale = F.when(iqr > 1e-9, iqr / 1.349).when(F.col("_sd") > 1e-9, F.col("_sd"))
    return df.join(found, by).withColumn(value, (F.col(value) - F.get("_q", F.lit(1))) / scale).drop("_q", "_sd")


def lagged_correlations(df: DataFrame, by: list[str], at: str, x: str, y: str, max_lag: int, block: int | None = None, place: str | None = None) -> DataFrame:
    """(by..., row_1, row_2, r): correlations of the 2 * (2 * max_lag + 1) rows x(t + lag), y(t + lag) over the times at which all of them are known.

    Rows that hardly vary are left out; recordings with too few complete times give no rows. A block of times, with max_lag
    more samples on either side, gives the products of all pairs of rows as one matrix; matrices of a recording are added.
    `place` is a column that numbers a recording's samples from 1 on; without it they meet in one task to be numbered.
    """
    width, size = 2 * max_lag + 1, block or BLOCK
    names = [f"{c}{k}" for c in "xy" for k in range(width)]
    both, k = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()), F.row_number().over(Window.partitionBy(*by).orderBy(at))
    if place is not None:
        df, k = df.join(df.groupBy(*by).agg(both.alias("_valid")), by), F.col(place)
    else:
        df = df.withColumn("_valid", both.over(Window.partitionBy(*by)))
    rows = df.select(*by, (k - 1).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y"), "_valid").where(F.col("_valid") >= max(8, 2 * max_lag + 4))
    pieces = sample_blocks(rows, by, "_k", ["_x", "_y"], halo=max_lag, block=size)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for r in range(len(batch)):
                ks = batch.column("ks")[r].values.to_numpy()
                first = max(batch.column("block")[r].as_py() * size, int(ks[0]) + max_lag)
                last = min((batch.column("block")[r].as_py() + 1) * size, int(ks[-1]) + 1 - max_lag)
                total = np.zeros((len(names) + 1, len(names) + 1))
                if last > first:
                    around = [np.lib.stride_tricks.sliding_window_view(array_of(batch, c, r), width)[first - max_lag - int(ks[0]) : last - max_lag - int(ks[0])] for c in ("_x", "_y")]
                    step = max(1, (16 << 20) // (16 * len(names)))
                    for i in range(0, last - first, step):
                        z = np.concatenate([np.ones((len(around[0][i : i + step]), 1)), *(w[i : i + step] for w in around)], axis=1)
                        z = z[~np.isnan(z).any(axis=1)]
                        total += z.T @ z
                parts.append(total.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(parts, pa.binary())], names=[*by, "sums"])

    kinds = dict(pieces.dtypes)
    done = pieces.mapInArrow(multiply, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", sums binary")

    def correlations(key: list, sums: np.ndarray) -> Iterator[tuple]:
        total = sums.reshape(len(names) + 1, -1)
        n = total[0, 0]
        if n < max(8, len(names) + 2):
            return
        mean = total[0, 1:] / n
        cov = total[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        used = np.flatnonzero(sd > 1e-9)
        if len(used) < 2 or n < len(used) + 1:
            return
        for i, a in enumerate(used):
            for b in used[i:]:
                yield names[a], names[b], float(cov[a, b] / (sd[a] * sd[b]))

    return array_sums(done, by, [], correlations, "row_1 string, row_2 string, r double")


def participation_ratio(correlations: DataFrame, by: list[str]) -> DataFrame:
    """The square of the eigenvalues' sum over the sum of their squares and the number of rows, from the upper triangle of the matrix: 1 is the most."""
    same = F.col("row_1") == F.col("row_2")
    found = correlations.groupBy(*by).agg(F.count_if(same).alias("_n"), F.sum(F.when(same, F.col("r") * F.col("r")).otherwise(2 * F.col("r") * F.col("r"))).alias("_s"))
    return found.select(*by, (F.col("_n") / F.when(F.col("_s") > 1e-12, F.col("_s"))).alias("complexity"))  # the diagonal is 1


def coordination(tracks: DataFrame, by: list[str], at: str, pairs: list[tuple[str, str]], max_lag: int, least_valid: float = 0.35, rows: int | None = None) -> DataFrame:
    """(by..., pair, complexity, pair_valid, status) of pairs of tracks: gaps of up to max_lag filled, robustly scaled, lagged correlations, participation ratio.

    A track is filled and scaled once for all of its pairs. With `rows` recordings are cut into blocks of some so many rows;
    else the samples of one meet in a task.
    """
    out, names = [], list(dict.fromkeys(c for pair in pairs for c in pair))
    filled = tracks.select(*by, at, *names) if rows is None else scans.numbered(tracks.select(*by, at, *names), by, at, rows)
    for c in names:
        if rows is None:
            filled = robust_scaled(interpolate_linear(filled, by, at, c, max_gap=max(1, max_lag)), by, c)
        else:
            filled = settled(scans.filled(filled, by, at, c, max(1, max_lag)).drop(c).withColumnRenamed("_filled", c))
            filled = robust_scaled(filled, by, c, long=True)
    filled = settled(filled) if len(pairs) > 1 else filled
    for a, b in pairs:
        valid = tracks.groupBy(*by).agg(F.avg((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("int")).alias("pair_valid"))
        ratio = participation_ratio(lagged_correlations(filled, by, at, a, b, max_lag, place=None if rows is None else "_n"), by)
        met = valid.join(ratio, by, "left").withColumn("pair", F.lit(f"{a}_{b}"))
        status = F.when(F.col("complexity").isNull(), F.when(F.col("pair_valid") < least_valid, "failed").otherwise("low_validity")).when(F.col("pair_valid") < least_valid, "low_validity").otherwise("computed")
        out.append(met.select(*by, "pair", "complexity", "pair_valid", status.alias("status")))
    return reduce(DataFrame.unionByName, out)


def prominences(v: np.ndarray) -> np.ndarray:
    """How far each sample stands over the higher of two lowest points: those on the ways to the nearest higher sample, or the end, on either side."""

    def lowest(x: np.ndarray) -> np.ndarray:
        out, stack = np.empty(len(x)), []
        for i, h in enumerate(x.tolist()):
            low = h
            while stack and stack[-1][0] <= h:
                low = min(low, stack.pop()[1])
            out[i] = low
            stack.append((h, low))
        return out

    return v - np.maximum(lowest(v), lowest(v[::-1])[::-1])


def prominent_extrema(df: DataFrame, by: list[str], at: str, value: str, least: str) -> DataFrame:
    """local_extrema with their prominence, if it reaches the column `least`, one value per recording (NULL: any); a trough's is that of the negative signal.

    What is higher on either side is a matter of all samples of a recording: these meet in one Arrow batch, and one pass
    with a stack settles them.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(at).alias("_at"), F.col(value).cast("double").alias("_v"))
    types = dict(rows.dtypes)

    def stand_out(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_at")
        v = group["_v"].to_numpy(float)
        return group.assign(_up=prominences(v), _down=prominences(-v)).drop(columns="_v")

    every = rows.groupBy(*by).applyInPandas(stand_out, ", ".join(f"`{c}` {types[c]}" for c in (*by, "_at")) + ", _up double, _down double")
    limits = df.groupBy(*by).agg(F.max(least).alias("_least"))
    met = local_extrema(df, by, at, value).join(every.withColumnRenamed("_at", at), [*by, at]).join(limits, by)
    out = met.withColumn("prominence", F.when(F.col("kind") == "peak", F.col("_up")).otherwise(F.col("_down")))
    return out.where(F.col("prominence") >= F.coalesce("_least", F.lit(0.0))).select(*by, at, value, "kind", "prominence")


def spaced(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks are kept if the highest go first, of equals the later ones, and each keeps away others fewer than `distance` steps off."""
    keep, taken = np.zeros(len(at), bool), {}
    for k in np.lexsort((-at, -height)).tolist():
        t = at[k]
        cell = t // distance
        if all(abs(t - x) >= distance for c in (cell - 1, cell, cell + 1) if (x := taken.get(c)) is not None):
            keep[k], taken[cell] = True, t
    return keep


def distant_peaks(peaks: DataFrame, by: list[str], at: str, value: str, distance: int, rounds: int = 4) -> DataFrame:
    """peaks of which the highest keep others fewer than `distance` whole steps of `at` away from being kept; of equals the later one goes first.

    A peak higher than all within reach is kept and its neighbours go, whatever else is decided: a few rounds of that over
    sliding windows settle most peaks. The others fall into groups that lie `distance` apart, and each group is settled alone.
    """
    w = Window.partitionBy(*by).orderBy(at)
    near = w.rangeBetween(-(distance - 1), distance - 1)
    own = F.struct(F.col(value).alias("h"), F.col(at).alias("t"))
    rows = peaks.select(*by, at, value).withColumn("_s", F.lit(0))
    for _ in range(rounds):
        best = F.max(F.when(F.col("_s") == 0, own)).over(near)
        rows = rows.withColumn("_s", F.when((F.col("_s") == 0) & (best == own), 1).otherwise(F.col("_s")))
        rows = rows.withColumn("_s", F.when((F.col("_s") == 0) & (F.max((F.col("_s") == 1).cast("int")).over(near) == 1), 2).otherwise(F.col("_s")))
    rows = settled(rows.where("_s < 2"))
    left = rows.where("_s = 0").withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(w) >= distance, F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(w))
    kinds = dict(left.dtypes)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        return group[spaced(group[at].to_numpy(), group[value].to_numpy(float), distance)]

    kept = left.select(*by, "_group", at, value).groupBy(*by, "_group").applyInPandas(settle, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "_group", at, value)))
    chosen = rows.where("_s = 1").select(*by, at).unionByName(kept.select(*by, at))
    return peaks.join(chosen, [*by, at], "left_semi")


def syllable_peaks(envelope: DataFrame, by: list[str], at: str, value: str, distance: int) -> DataFrame:
    """Peaks of an envelope that reach the median plus the median deviation, stand out by 1.5 of it, and lie `distance` steps apart."""
    limits = envelope.groupBy(*by).agg(_q(value, 0.5).alias("_med"))
    away = envelope.join(limits, by).withColumn("_away", F.abs(F.col(value) - F.col("_med")))
    mad = away.groupBy(*by).agg(_q("_away", 0.5).alias("_mad"), F.first("_med").alias("_m"))
    rows = envelope.join(mad, by).withColumn("_least", F.greatest(F.lit(1e-8), 1.5 * F.col("_mad")))
    high = local_extrema(rows, by, at, value).where("kind = 'peak'").join(mad, by).where(F.col(value) >= F.col("_m") + F.col("_mad")).select(*by, at, value)
    apart = distant_peaks(high, by, at, value, distance)
    return apart.join(prominent_extrema(rows, by, at, value, "_least").where("kind = 'peak'").select(*by, at, "prominence"), [*by, at])
