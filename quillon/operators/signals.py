"""Frames, levels and movements of sampled signals, in table form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import db
from quillon.functions.stats import quantiles
from quillon.operators.windows import label_in


def frame_rms_db(samples: DataFrame, by: list[str], at: str, value: str, frame: int, rate: float) -> DataFrame:
    """(by..., frame_idx, mid_sec, rms, rms_db) of frames that don't overlap; `at` counts from 1, a short last frame is padded with zeros, missing samples count as 0."""
    x = F.coalesce(value, F.lit(0.0))
    found = samples.groupBy(*by, F.floor((F.col(at) - 1) / frame).alias("frame_idx")).agg(F.sqrt(F.sum(x * x) / frame).alias("rms"))
    return found.select(*by, "frame_idx", ((F.col("frame_idx") + 0.5) * frame / rate).alias("mid_sec"), "rms", db(F.col("rms")).alias("rms_db"))


def energy_mask(frames: DataFrame, by: list[str], level: str, share: float = 0.35) -> DataFrame:
    """frames with the threshold, a recording's `share` quantile of the level, and whether the level is over it."""
    limits = frames.groupBy(*by).agg(F.get(quantiles(level, [share]), F.lit(0)).alias("threshold"))
    return frames.join(limits, by).withColumn("speech", F.coalesce(F.col(level) > F.col("threshold"), F.lit(False)))


def snr_low_energy(frames: DataFrame, by: list[str], rms: str = "rms") -> DataFrame:
    """10 log10((mean - q10) / q10) of frame power, from three frames on."""
    power = frames.withColumn("_p", F.pow(rms, 2))
    low = F.get(quantiles("_p", [0.1]), F.lit(0))
    found = power.groupBy(*by).agg(F.count("_p").alias("n"), F.avg("_p").alias("mean"), low.alias("low"))
    ratio = (F.col("mean") - F.col("low")) / F.when(F.col("low") > 0, F.col("low"))
    return found.select(*by, F.when((F.col("n") >= 3) & (ratio > 0), 10 * F.log10(F.when(ratio > 0, ratio))).alias("snr_db"))


def gain_qc(frames: DataFrame, by: list[str], level: str) -> DataFrame:
    """Median, spread and upper quantiles of the level, and how far the 99th percentile stands over the median."""
    q = [F.get("q", F.lit(k)) for k in range(5)]
    found = frames.groupBy(*by).agg(quantiles(level, [0.25, 0.5, 0.75, 0.95, 0.99]).alias("q"), F.stddev_pop(level).alias("level_sd"))
    return found.select(*by, q[1].alias("level_median"), "level_sd", (q[2] - q[0]).alias("level_iqr"), q[3].alias("level_p95"), q[4].alias("level_p99"), (q[4] - q[1]).alias("crest"))


#: Fixed value: the pressure, in pascal, that sound levels are told against.
REFERENCE_PRESSURE = 20e-6


def intensity_cv(frames: DataFrame, by: list[str], rms: str = "rms") -> DataFrame:
    """Sample SD over the size of the mean of the sound level, in dB re 20 uPa, of frames with energy; NULL for fewer than two."""
    level = 20 * F.log10(F.greatest(F.col(rms), F.lit(1e-12)) / REFERENCE_PRESSURE)
    found = frames.withColumn("_l", F.when(F.col(rms) > 0, level)).groupBy(*by).agg(F.avg("_l").alias("_m"), F.stddev_samp("_l").alias("_s"))
    return found.select(*by, (F.col("_s") / F.when(F.abs("_m") >= 1e-12, F.abs("_m"))).alias("intensity_cv"))


def valid_energy_frames(frames: DataFrame, by: list[str], rms: str = "rms", share: float = 0.2, of_median: float = 0.1) -> DataFrame:
    """Frames whose rms reaches a quantile of the recording, a share of its median, and 1e-5."""
    limits = frames.groupBy(*by).agg(quantiles(rms, [share, 0.5]).alias("_q"))
    least = F.greatest(F.get("_q", F.lit(0)), of_median * F.get("_q", F.lit(1)), F.lit(1e-5))
    return frames.join(limits, by).where(F.col(rms) >= least).drop("_q")


def movement_windows(frames: DataFrame, extrema: DataFrame, by: list[str], at: str, min_frames: int = 3) -> DataFrame:
    """frames with movement_id and movement_kind: open from trough to peak, close from peak to trough, both ends included.

    A frame that ends one movement and begins the next belongs to the later one. Movements of fewer than min_frames are
    left out; a recording without any is one movement, 'whole'.
    """
    w = Window.partitionBy(*by).orderBy("_from")
    ends = extrema.withColumn("_from", F.col(at)).withColumn("_to", F.lead(at).over(w)).withColumn("_next", F.lead("kind").over(w))
    kind = F.when((F.col("kind") == "trough") & (F.col("_next") == "peak"), "open").when((F.col("kind") == "peak") & (F.col("_next") == "trough"), "close")
    moves = ends.withColumn("movement_kind", kind).where(f"movement_kind IS NOT NULL AND _to - _from + 1 >= {min_frames}")
    moves = moves.select(*by, F.row_number().over(w).alias("movement_id"), "movement_kind", "_from", "_to")
    inside = label_in(frames.select(*by, at), moves, by, F.col(at), "_from", "_to", 64.0)
    own = inside.groupBy(*by, at).agg(F.max(F.struct("movement_id", "movement_kind")).alias("_m"))
    any_ = moves.select(*by, F.lit(True).alias("_has")).distinct()
    tagged = frames.join(own, [*by, at], "left").join(any_, by, "left")
    return tagged.withColumn("movement_id", F.coalesce("_m.movement_id", F.when(F.col("_has").isNull(), 1))).withColumn("movement_kind", F.coalesce("_m.movement_kind", F.when(F.col("_has").isNull(), "whole"))).drop("_m", "_has")


def level_family(moved: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per movement p05, median, p95 and range; of each the median and IQR over movements."""
    per = moved.where("movement_id IS NOT NULL").groupBy(*by, "movement_id").agg(quantiles(value, [0.05, 0.5, 0.95]).alias("q"))
    per = per.select(*by, F.get("q", F.lit(0)).alias("p05"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("p95"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("range"))
    names = ("p05", "median", "p95", "range")
    found = per.groupBy(*by).agg(*[quantiles(c, [0.25, 0.5, 0.75]).alias(c) for c in names])
    return found.select(*by, *[x for c in names for x in (F.get(c, F.lit(1)).alias(f"{c}_median"), (F.get(c, F.lit(2)) - F.get(c, F.lit(0))).alias(f"{c}_iqr"))])


def path_rom(moved: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Length of the path within each movement; median and IQR over movements."""
    w = Window.partitionBy(*by, "movement_id").orderBy(at)
    per = moved.where("movement_id IS NOT NULL").withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w))).groupBy(*by, "movement_id").agg(F.sum("_d").alias("path"))
    found = per.groupBy(*by).agg(quantiles("path", [0.25, 0.5, 0.75]).alias("q"))
    return found.select(*by, F.get("q", F.lit(1)).alias("path_median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("path_iqr"))


def band_ratio(spectrum: DataFrame, by: list[str], frequency: str, power: str, low: float, high: float) -> DataFrame:
    """The share of power from `low` up to but without `high`, by trapezoids of successive bins inside; NULL for a band without bins."""
    w = Window.partitionBy(*by).orderBy(frequency)
    area = (F.col(power) + F.lag(power).over(w)) / 2 * (F.col(frequency) - F.lag(frequency).over(w))
    within = lambda f: (f >= low) & (f < high)
    inside = within(F.col(frequency)) & F.coalesce(within(F.lag(frequency).over(w)), F.lit(False))
    rows = spectrum.where(F.col(power).isNotNull()).withColumn("_a", area).withColumn("_in", F.when(inside, area))
    found = rows.groupBy(*by).agg(F.coalesce(F.sum("_in"), F.lit(0.0)).alias("band"), F.sum("_a").alias("all"), F.count_if(within(F.col(frequency))).alias("bins"))
    return found.select(*by, F.when(F.col("bins") > 0, F.col("band") / F.when(F.col("all") > 0, F.col("all"))).alias("band_ratio"))


def spectral_shape(spectrum: DataFrame, by: list[str], frequency: str, power: str) -> DataFrame:
    """Flatness, centroid, the frequency below which 95 % of the power lies, and the tilt in dB an octave."""
    w = Window.partitionBy(*by).orderBy(frequency)
    p, f = F.col(power), F.col(frequency)
    rows = spectrum.where(p > 0).withColumn("_up", F.sum(power).over(w)).withColumn("_all", F.sum(power).over(Window.partitionBy(*by))).withColumn("_db", 10 * F.log10(p)).withColumn("_oct", F.when(f > 0, F.log2(F.when(f > 0, f))))
    found = rows.groupBy(*by).agg((F.exp(F.avg(F.log(p))) / F.avg(p)).alias("flatness"), (F.sum(f * p) / F.sum(p)).alias("centroid"), F.min(F.when(F.col("_up") >= 0.95 * F.col("_all"), f)).alias("rolloff95"), F.regr_slope("_db", "_oct").alias("tilt_db_per_octave"))
    return found
