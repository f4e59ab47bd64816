"""Quality of recordings from tables of samples (recording, at, x), frames (recording, frame, mid_sec, level) and segments.

Samples count from 1; `rate` is samples per second. Segments are those of windows.mask_to_segments: segment_type speech or
nonspeech, segment_role speech, leading, internal or trailing, start_sec, end_sec, duration_sec.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import reason_list
from quillon.functions.stats import quantiles
from quillon.operators.windows import boolean_runs, energy_jumps, label_in, start_end_diff


def _q(x: str, q: float) -> Column:
    return F.get(quantiles(x, [q]), F.lit(0))


def _median_of(x: Column) -> Column:
    return F.get(F.percentile(x, F.array(F.lit(0.5))), F.lit(0))


def region_of(segments: DataFrame, region: str, min_pause: float = 0.30) -> DataFrame:
    """The segments of a region: speech_only, internal_pauses of at least min_pause, or effective_task, which leaves out silence before and after."""
    role, kind = F.col("segment_role"), F.col("segment_type")
    if region == "internal_pauses":
        return segments.where((role == "internal") & (F.col("duration_sec") >= min_pause))
    return segments.where(~role.isin("leading", "trailing") if region == "effective_task" else kind == "speech")


def samples_in_region(samples: DataFrame, segments: DataFrame, by: list[str], at: str, rate: float, region: str = "speech_only", min_pause: float = 0.30) -> DataFrame:
    """The samples inside a region's segments, from the rounded start up to but without the rounded end, counted from 0.

    full_file keeps all; recordings without segments, and those in which a region other than internal_pauses holds no
    sample, keep all, too.
    """
    if region == "full_file":
        return samples
    chosen = region_of(segments, region, min_pause).select(*by, F.round(F.col("start_sec") * rate).cast("bigint").alias("_from"), (F.round(F.col("end_sec") * rate) - 1).cast("bigint").alias("_to")).where("_to >= _from")
    inside = label_in(samples, chosen, by, F.col(at) - 1, "_from", "_to", 4096.0).drop("_from", "_to").dropDuplicates([*by, at])
    keeps = segments.select(*by).distinct() if region == "internal_pauses" else inside.select(*by).distinct()
    return inside.unionByName(samples.join(keeps, by, "left_anti"))


def frame_mask(samples: DataFrame, by: list[str], at: str, flag: str, frame: int) -> DataFrame:
    """(by..., frame_idx, speech): frames without overlap in which more than half of the samples are flagged; a short last frame is filled up with false."""
    share = F.count_if(F.col(flag)) / frame
    return samples.groupBy(*by, F.floor((F.col(at) - 1) / frame).alias("frame_idx")).agg((share > 0.5).alias("speech"))


def clipping_runs(samples: DataFrame, by: list[str], at: str, x: str, threshold: float = 0.999, min_run: int = 3) -> DataFrame:
    """Number of runs of at least min_run samples at or over the threshold, 0 for recordings without any."""
    runs = boolean_runs(samples.select(*by, at, (F.abs(F.col(x)) >= threshold).alias("_hit")), by, at, "_hit")
    return runs.groupBy(*by).agg(F.count_if(F.col("_hit") & (F.col("length") >= min_run)).alias("clipping_runs"))


def zero_runs(samples: DataFrame, by: list[str], at: str, x: str, rate: float, eps: float = 1e-6) -> DataFrame:
    """Runs of samples of at most eps, one after the other in the table, of at least 10 ms and 5 samples: their number and share of all samples."""
    least = max(5, int(0.01 * rate))
    rows = samples.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(at)).alias("_n"), (F.abs(F.col(x)) <= eps).alias("_zero"))
    runs = boolean_runs(rows, by, "_n", "_zero")
    long = F.col("_zero") & (F.col("length") >= least)
    return runs.groupBy(*by).agg(F.count_if(long).alias("zero_run_count"), (F.coalesce(F.sum(F.when(long, F.col("length"))), F.lit(0)) / F.sum("length")).alias("dropout_fraction"))


def best_channel(samples: DataFrame, by: list[str], channel: str, x: str) -> DataFrame:
    """The channel with the largest rms less ten times the share of clipped samples, the first of equals, and both figures."""
    per = samples.groupBy(*by, channel).agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.avg((F.abs(x) >= 0.98).cast("int")).alias("clip_fraction"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("rms") - 10 * F.col("clip_fraction")), channel)
    return per.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*by, F.col(channel).alias("selected_channel"), "rms", "clip_fraction")


def audio_summary(samples: DataFrame, by: list[str], at: str, x: str, rate: float) -> DataFrame:
    """Duration, offset, peak, rms, share near full scale, clipping runs and the signal-to-noise ratio of 30 ms frames.

    The noise is the 10 % quantile of frame power; only whole frames count, and three of them are needed.
    """
    frame, v = max(1, int(0.03 * rate)), F.col(x)
    base = samples.groupBy(*by).agg(F.count("*").alias("n_samples"), F.avg(v).alias("dc_offset"), F.max(F.abs(v)).alias("peak_abs"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg((F.abs(v) >= 0.98).cast("int")).alias("clipping_fraction"))
    power = samples.groupBy(*by, F.floor((F.col(at) - 1) / frame).alias("_f")).agg(F.count("*").alias("_n"), (F.sum(v * v) / frame + 1e-12).alias("_p")).where(F.col("_n") == frame)
    noise = power.groupBy(*by).agg(F.count("*").alias("_k"), F.avg("_p").alias("_mean"), _q("_p", 0.1).alias("_low"))
    ratio = F.when((F.col("_k") >= 3) & (F.col("_mean") > F.col("_low")), 10 * F.log10((F.col("_mean") - F.col("_low")) / F.col("_low")))
    return base.join(noise, by, "left").join(clipping_runs(samples, by, at, x), by, "left").select(*by, (F.col("n_samples") / rate).alias("duration_sec"), "n_samples", "dc_offset", "peak_abs", "rms", "clipping_fraction", "clipping_runs", ratio.alias("snr_db"))


# Limits of the checks on files, with the flag each gives.
FILE_CHECKS = (
    ("too_short", "duration_sec", "<", 0.5), ("low_snr", "snr_db", "<", 10.0), ("clipping", "clipping_fraction", ">", 0.001), ("50hz_powerline", "powerline_50hz", "is", True), ("60hz_powerline", "powerline_60hz", "is", True),
    ("very_low_speech_fraction", "speech_fraction", "<", 0.05), ("very_high_speech_fraction", "speech_fraction", ">", 0.98), ("no_or_too_few_speech_segments", "n_speech_segments", "<", 1),
)
PREPROCESS_CHECKS = (
    ("low_snr", "snr_db", "<", 10.0), ("clipping", "clipping_fraction", ">", 0.0), ("dc_offset_present", "dc_offset", "size >", 0.01), ("50hz_powerline", "powerline_50hz", "is", True), ("60hz_powerline", "powerline_60hz", "is", True),
    ("very_short", "duration_sec", "<", 1.0),
)


def dashboard_flags(files: DataFrame, by: list[str], checks: tuple[tuple, ...] = FILE_CHECKS, ok: str = "pass") -> DataFrame:
    """(by..., qc_status, qc_flags, n_qc_flags): checks on columns that files has; missing values raise no flag."""
    broken = {"<": lambda c, v: c < v, ">": lambda c, v: c > v, "size >": lambda c, v: F.abs(c) > v, "is": lambda c, v: c == F.lit(v)}
    found = [(F.coalesce(broken[op](F.col(c), limit), F.lit(False)), flag) for flag, c, op, limit in checks if c in files.columns]
    n = sum((c.cast("int") for c, _ in found), F.lit(0))
    return files.select(*by, F.when(n > 0, "review").otherwise(ok).alias("qc_status"), reason_list(found, "", ";").alias("qc_flags"), n.alias("n_qc_flags"))


def rolling_instability(frames: DataFrame, by: list[str], at: str, level: str) -> DataFrame:
    """The SD of a running median over a quarter of a recording's frames, 3 to 15 of them; two known values make a median.

    An even window reaches one frame further back than ahead. The widest window's values are held per frame, at most 15.
    """
    w = Window.partitionBy(*by).orderBy(at)
    rows = frames.where(F.col(level).isNotNull()).withColumn("_w", F.greatest(F.lit(3), F.least(F.lit(15), F.floor(F.count("*").over(Window.partitionBy(*by)) / 4))).cast("int")).withColumn("_n", F.row_number().over(w))
    near = rows.withColumn("_near", F.collect_list(F.struct("_n", F.col(level).alias("v"))).over(w.rowsBetween(-7, 7)))
    back, ahead = F.floor(F.col("_w") / 2), F.floor((F.col("_w") - 1) / 2)
    inside = F.array_sort(F.transform(F.filter("_near", lambda x: (x["_n"] >= F.col("_n") - back) & (x["_n"] <= F.col("_n") + ahead)), lambda x: x["v"]))
    k = F.size("_in")
    median = F.when(k >= 2, (F.get("_in", F.floor((k - 1) / 2).cast("int")) + F.get("_in", F.floor(k / 2).cast("int"))) / 2)
    return near.withColumn("_in", inside).withColumn("_median", median).groupBy(*by).agg(F.stddev_pop("_median").alias("rolling_instability"))


def gain_qc(frames: DataFrame, by: list[str], at: str, level: str, speech: str, segments: DataFrame | None = None, mid: str = "mid_sec") -> DataFrame:
    """Location, spread, peaks, instability, trend and, over segments, the SD of median levels of speech frames; 5 of them are needed."""
    said = frames.where(F.col(speech) & F.col(level).isNotNull())
    q = [F.get("q", F.lit(k)) for k in range(5)]
    base = said.groupBy(*by).agg(F.count("*").alias("_n"), quantiles(level, [0.25, 0.5, 0.75, 0.95, 0.99]).alias("q"), F.stddev_pop(level).alias("level_sd")).where("_n >= 5")
    found = base.select(*by, q[1].alias("level_median"), "level_sd", (q[2] - q[0]).alias("level_iqr"), q[3].alias("level_p95"), q[4].alias("level_p99"), (q[4] - q[1]).alias("crest"))
    found = found.join(rolling_instability(said, by, at, level), by, "left").join(start_end_diff(said, by, at, level), by, "left")
    if segments is not None:
        met = label_in(frames.where(F.col(level).isNotNull()), segments.where("segment_type = 'speech'"), by, F.col(mid), "start_sec", "end_sec")
        medians = met.groupBy(*by, "segment_index").agg(_q(level, 0.5).alias("_m")).groupBy(*by).agg(F.stddev_pop("_m").alias("segment_level_sd"))
        found = found.join(medians, by, "left")
    return found


def additive_qc(frames: DataFrame, by: list[str], level: str, speech: str) -> DataFrame:
    """Median, SD and 95 % quantile of the level in pauses, and how far speech stands over it; three pause frames are needed."""
    known = frames.where(F.col(level).isNotNull()).withColumn("_p", F.when(~F.col(speech), F.col(level))).withColumn("_s", F.when(F.col(speech), F.col(level)))
    found = known.groupBy(*by).agg(F.count("_p").alias("_n"), quantiles("_p", [0.5, 0.95]).alias("q"), F.stddev_pop("_p").alias("_sd"), _q("_s", 0.5).alias("_m"))
    enough = lambda c: F.when(F.col("_n") >= 3, c)
    return found.select(*by, F.when(F.col("_n") >= 3, "computed").otherwise("insufficient_pause_support").alias("status"), enough(F.get("q", F.lit(0))).alias("pause_level_median"), enough(F.col("_sd")).alias("pause_level_sd"), enough(F.get("q", F.lit(1))).alias("pause_level_p95"), enough(F.col("_m") - F.get("q", F.lit(0))).alias("speech_pause_difference"))


def pause_offsets(segments: DataFrame, by: list[str]) -> DataFrame:
    """(by..., pause_id, s0, s1, p0, p1, pause_sec): each speech segment that an internal pause follows, and that pause."""
    w = Window.partitionBy(*by).orderBy("segment_index")
    nxt = segments.withColumn("_next", F.lead(F.struct("segment_role", "start_sec", "end_sec", "duration_sec")).over(w))
    return nxt.where("segment_type = 'speech' AND _next.segment_role = 'internal'").select(*by, F.col("segment_index").alias("pause_id"), F.col("start_sec").alias("s0"), F.col("end_sec").alias("s1"), F.col("_next.start_sec").alias("p0"), F.col("_next.end_sec").alias("p1"), F.col("_next.duration_sec").alias("pause_sec"))


def reverb_qc(frames: DataFrame, segments: DataFrame, by: list[str], level: str, mid: str = "mid_sec", reach: float = 0.25, tail: float = 6.0) -> DataFrame:
    """Pauses after speech: their total and median length, how far their first `reach` seconds stand over their last ones and over the end of speech.

    A pause without frames in its last part is held against the median of all frames. Recordings without such a pause are left out.
    """
    pauses = pause_offsets(segments, by)
    m, v = F.col(mid), F.col(level)
    met = label_in(frames.where(v.isNotNull()), pauses.withColumns({"_lo": F.greatest(F.col("s0"), F.col("s1") - reach), "_hi": F.col("p1")}), by, m, "_lo", "_hi")
    early = (m >= F.col("p0")) & (m < F.least(F.col("p1"), F.col("p0") + reach))
    late = (m > F.greatest(F.col("p0"), F.col("p1") - reach)) & (m <= F.col("p1"))
    said = (m >= F.greatest(F.col("s0"), F.col("s1") - reach)) & (m <= F.col("s1"))
    per = met.groupBy(*by, "pause_id").agg(_median_of(F.when(early, v)).alias("_early"), _median_of(F.when(late, v)).alias("_late"), _median_of(F.when(said, v)).alias("_said"))
    every = frames.groupBy(*by).agg(_q(level, 0.5).alias("_all"))
    rows = pauses.join(per, [*by, "pause_id"], "left").join(every, by, "left").withColumn("_tail", F.col("_early") - F.coalesce("_late", "_all")).withColumn("_ratio", F.col("_early") - F.col("_said"))
    return rows.groupBy(*by).agg(F.sum("pause_sec").alias("total_offset_pause_sec"), _q("pause_sec", 0.5).alias("median_offset_pause_sec"), _q("_tail", 0.5).alias("tail_above_floor"), _q("_ratio", 0.5).alias("early_vs_speech_end"), F.coalesce(F.sum(F.when(F.col("_tail") > tail, F.col("pause_sec"))), F.lit(0.0)).alias("tail_duration_sec"))


def distortion_qc(samples: DataFrame, frames: DataFrame, by: list[str], at: str, x: str, rate: float, level: str, speech: str, mid: str = "mid_sec", half: float = 0.015, share: float = 0.90, hard: float = 0.999, near: float = 0.98) -> DataFrame:
    """Clipping, flat tops and peaks of the samples around a recording's loudest speech frames, those from the `share` quantile on.

    Overlapping windows count their samples once each. Three speech frames are needed.
    """
    limits = frames.where(F.col(speech) & F.col(level).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), _q(level, share).alias("_limit")).where("_n >= 3")
    marked = frames.join(limits, by).withColumn("_high", F.coalesce(F.col(speech) & (F.col(level) >= F.col("_limit")), F.lit(False)))
    sizes = marked.groupBy(*by).agg(F.count_if("_high").alias("n_high_frames"), F.avg(F.col("_high").cast("int")).alias("high_frame_fraction"))
    spans = marked.where("_high").select(*by, F.col(mid).alias("_mid"), F.greatest(F.lit(0), F.round((F.col(mid) - half) * rate)).cast("bigint").alias("_from"), (F.round((F.col(mid) + half) * rate) - 1).cast("bigint").alias("_to")).where("_to >= _from")
    met = label_in(samples, spans, by, F.col(at) - 1, "_from", "_to", 1024.0)
    v, a = F.col(x), F.abs(F.col(x))
    w = Window.partitionBy(*by, "_mid").orderBy(at)
    top = Window.partitionBy(*by, "_mid").orderBy(F.desc(a), at)
    rows = met.withColumns({"_step": F.abs(v - F.lag(x).over(w)), "_bend": F.abs(F.lag(x).over(w) - 2 * v + F.lead(x).over(w)), "_place": F.row_number().over(top)})
    per = rows.groupBy(*by, "_mid").agg(F.max((a >= hard).cast("int")).alias("_clip"), F.max((a >= near).cast("int")).alias("_near"), F.when(F.count("*") > 2, F.avg((F.col("_step") < 1e-4).cast("int"))).alias("_flat"), F.when((F.count("*") > 3) & (F.max(a) > 0), F.max(F.when(F.col("_place") == 1, F.col("_bend") / F.greatest(a, F.lit(1e-6))))).alias("_curve"))
    windows = per.groupBy(*by).agg(F.avg("_clip").alias("clipped_frame_fraction"), F.avg("_near").alias("near_clipped_frame_fraction"), _q("_flat", 0.5).alias("flat_top_fraction"), _q("_curve", 0.5).alias("peak_curvature"))
    both = met.withColumn("_pos", F.when(v > 0, v)).withColumn("_neg", F.when(v < 0, -v)).groupBy(*by).agg((F.count("*") / rate).alias("high_level_sec"), F.avg((a >= hard).cast("int")).alias("clipped_fraction"), F.avg((a >= near).cast("int")).alias("near_clipped_fraction"), _q("_pos", 0.99).alias("_p"), _q("_neg", 0.99).alias("_m"))
    lean = (F.col("_p") - F.col("_m")) / F.when(F.col("_p") + F.col("_m") > 0, F.col("_p") + F.col("_m"))
    return sizes.join(windows, by, "left").join(both, by, "left").select(*by, "n_high_frames", "high_frame_fraction", "high_level_sec", "clipped_fraction", "near_clipped_fraction", "clipped_frame_fraction", "near_clipped_frame_fraction", "flat_top_fraction", "peak_curvature", lean.alias("peak_asymmetry"))


def repeated_windows(samples: DataFrame, by: list[str], at: str, x: str, width: int) -> DataFrame:
    """Windows of `width` samples without overlap: how many correlate with the one before by more than 0.999, and the share that hardly vary; a last window is left out."""
    rows = samples.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(at)) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(*by)))
    rows = rows.select(*by, F.floor(F.col("_n") / width).alias("_w"), (F.col("_n") % width).alias("_k"), F.col(x).alias("_x"), F.floor((F.col("_all") - width) / width).alias("_last")).where("_w < _last")
    before = rows.select(*by, (F.col("_w") + 1).alias("_w"), "_k", F.col("_x").alias("_y"))
    met = rows.join(before, [*by, "_w", "_k"], "left").groupBy(*by, "_w").agg(F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"), F.covar_pop("_x", "_y").alias("_c"))
    alike = F.coalesce(F.col("_c") / F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_sx") * F.col("_sy")) > 0.999, F.lit(False))
    return met.groupBy(*by).agg(F.count_if(alike).alias("duplicate_windows"), F.avg((F.col("_sx") < 1e-5).cast("int")).alias("frozen_window_fraction"))


def temporal_qc(samples: DataFrame, frames: DataFrame, by: list[str], at: str, x: str, rate: float, frame_at: str, level: str, speech: str, jump: float = 18.0) -> DataFrame:
    """Zero runs, jumps of the level, repeated and frozen 40 ms windows, and the sum of their shares."""
    zeros, same = zero_runs(samples, by, at, x, rate), repeated_windows(samples, by, at, x, max(1, int(0.04 * rate)))
    jumps = energy_jumps(frames, by, frame_at, level, speech, jump)
    found = zeros.join(same, by, "left").join(jumps, by, "left")
    score = F.col("dropout_fraction") + F.coalesce("jump_fraction", F.lit(0.0)) + F.coalesce("frozen_window_fraction", F.lit(0.0))
    return found.withColumn("jump_fraction", F.coalesce("jump_fraction", F.lit(0.0))).withColumn("continuity_break_score", score)
