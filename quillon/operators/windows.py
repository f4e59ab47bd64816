"""Operators over ordered samples: runs, segments, interpolation, derivatives, extrema, jumps and visits.

Each takes the columns `by` that tell recordings apart and one column `at` that orders them. A recording's samples meet in
one sort within a task, as windows need; recordings share nothing, so tables of many recordings spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(by: list[str], at: str | Column):
    return Window.partitionBy(*by).orderBy(at)


def boolean_runs(df: DataFrame, by: list[str], at: str, flag: str) -> DataFrame:
    """(by..., run, flag, first, last, length): maximal runs of equal flags, NULL taken as false; run counts from 1."""
    w = _before(by, at)
    v = F.coalesce(F.col(flag), F.lit(False))
    marked = df.select(*by, at, v.alias(flag)).withColumn("_new", F.coalesce(F.lag(flag).over(w) != F.col(flag), F.lit(True)).cast("int"))
    return marked.withColumn("run", F.sum("_new").over(w)).groupBy(*by, "run", flag).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length"))


def mask_to_segments(runs: DataFrame, by: list[str], flag: str, hop: float) -> DataFrame:
    """Speech and nonspeech segments in seconds; a nonspeech first run leads, even as the only one, a last one trails."""
    lasts = F.max("run").over(Window.partitionBy(*by))
    role = F.when(F.col(flag), "speech").when(F.col("run") == 1, "leading").when(F.col("run") == lasts, "trailing").otherwise("internal")
    return runs.select(*by, F.col("run").alias("segment_index"), F.when(F.col(flag), "speech").otherwise("nonspeech").alias("segment_type"), role.alias("segment_role"), ((F.col("first") - 1) * hop).alias("start_sec"), (F.col("last") * hop).alias("end_sec"), (F.col("length") * hop).alias("duration_sec"))


def boundaries(segments: DataFrame, by: list[str]) -> DataFrame:
    """End times of all segments but each recording's last."""
    following = F.lead("segment_index").over(_before(by, "segment_index"))
    return segments.withColumn("_next", following).where("_next IS NOT NULL").select(*by, "segment_index", F.col("end_sec").alias("boundary_sec"))


def runs_of_false(runs: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Number of runs of false and the longest one; recordings without any have 0."""
    return runs.groupBy(*by).agg(F.count_if(~F.col(flag)).alias("n_gaps"), F.coalesce(F.max(F.when(~F.col(flag), F.col("length"))), F.lit(0)).alias("longest_gap"))


def voice_breaks(runs: DataFrame, by: list[str], flag: str, min_length: int) -> DataFrame:
    """Runs of false of at least min_length between the first and the last true one."""
    inside = Window.partitionBy(*by)
    edges = runs.withColumn("_a", F.min(F.when(F.col(flag), F.col("run"))).over(inside)).withColumn("_b", F.max(F.when(F.col(flag), F.col("run"))).over(inside))
    return edges.groupBy(*by).agg(F.count_if(~F.col(flag) & (F.col("run") > F.col("_a")) & (F.col("run") < F.col("_b")) & (F.col("length") >= min_length)).alias("voice_breaks"))


def interpolate_linear(df: DataFrame, by: list[str], at: str, value: str, max_gap: int | None = None, out: str | None = None) -> DataFrame:
    """Fill missing values on the line between their neighbours by position; the ends take the nearest value.

    With max_gap longer runs of missing values stay missing, and recordings with fewer than 3 values are left as they are.
    """
    w = _before(by, at)
    v = F.col(value)
    df = df.withColumn("_n", F.row_number().over(w))
    one = F.when(v.isNotNull(), F.struct("_n", v.alias("v")))
    # the next value is the last one in falling order: a frame that ends with the recording is summed up anew for each row
    upto = lambda order: F.last(one, ignorenulls=True).over(_before(by, order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_p", upto("_n")).withColumn("_q", upto(F.desc("_n")))
    p, q = F.col("_p"), F.col("_q")
    line = p["v"] + (q["v"] - p["v"]) * (F.col("_n") - p["_n"]) / F.when(q["_n"] > p["_n"], q["_n"] - p["_n"])
    filled = F.coalesce(v, line, p["v"], q["v"])
    if max_gap is not None:
        every = Window.partitionBy(*by)
        gap = F.coalesce(q["_n"], F.max("_n").over(every) + 1) - F.coalesce(p["_n"], F.lit(0)) - 1
        filled = F.when(v.isNotNull(), v).when((gap <= max_gap) & (F.count(v).over(every) >= 3), filled)
    return df.withColumn(out or value, filled).drop("_n", "_p", "_q")


def gradient(df: DataFrame, by: list[str], at: str, value: str, time: str, out: str) -> DataFrame:
    """The derivative by time: second order inside for any spacing, one-sided at the ends; NULL for fewer than 3 samples.

    Where time doesn't rise strictly throughout a recording, its positions stand in for it.
    """
    w, every = _before(by, at), Window.partitionBy(*by)
    df = df.withColumn("_n", F.row_number().over(w).cast("double")).withColumn("_rises", F.coalesce(F.col(time) > F.lag(time).over(w), F.col("_n") == 1))
    df = df.withColumn("_t", F.when(F.min("_rises").over(every), F.col(time)).otherwise(F.col("_n")))
    v, t = F.col(value), F.col("_t")
    v0, v1, t0, t1 = F.lag(value).over(w), F.lead(value).over(w), F.lag("_t").over(w), F.lead("_t").over(w)
    a, b = t - t0, t1 - t
    inner = (a * a * v1 + (b * b - a * a) * v - b * b * v0) / (a * b * (a + b))
    slope = F.when(t0.isNull(), (v1 - v) / b).when(t1.isNull(), (v - v0) / a).otherwise(inner)
    return df.withColumn(out, F.when(F.count("*").over(every) >= 3, slope)).drop("_n", "_rises", "_t")


def derivatives(df: DataFrame, by: list[str], at: str, value: str, time: str) -> DataFrame:
    """velocity, acceleration and jerk; all windows share one exchange and sort."""
    for a, b in ((value, "velocity"), ("velocity", "acceleration"), ("acceleration", "jerk")):
        df = gradient(df, by, at, a, time, b)
    return df


def scale_jumps(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Largest and 95th percentile of |change| over the value before, of successive valid positive values."""
    valid = df.where(F.col(value) > 0)
    jump = F.abs(F.col(value) - F.lag(value).over(_before(by, at))) / F.lag(value).over(_before(by, at))
    return valid.withColumn("_j", jump).groupBy(*by).agg(F.max("_j").alias("max_jump"), F.get(F.percentile("_j", F.array(F.lit(0.95))), F.lit(0)).alias("p95_jump"))


def energy_jumps(df: DataFrame, by: list[str], at: str, value: str, flag: str, limit: float = 18.0) -> DataFrame:
    """Count of changes of at least `limit` between two successive flagged samples, and its share of all successive pairs, 0 without flagged ones."""
    w = _before(by, at)
    both = F.col(flag) & F.lag(flag).over(w) & F.col(value).isNotNull() & F.lag(value).over(w).isNotNull()
    jumped = df.withColumn("_both", F.coalesce(both, F.lit(False))).withColumn("_jump", F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)) >= limit, F.lit(False)))
    found = jumped.groupBy(*by).agg(F.count("*").alias("_all"), F.count_if("_both").alias("_n"), F.count_if(F.col("_both") & F.col("_jump")).alias("n_jumps"))
    return found.select(*by, "n_jumps", F.when((F.col("_n") > 0) & (F.col("_all") > 1), F.col("n_jumps") / F.nullif(F.col("_all") - 1, F.lit(0))).otherwise(0.0).alias("jump_fraction"))


def start_end_diff(df: DataFrame, by: list[str], at: str, value: str, share: float = 0.10) -> DataFrame:
    """Mean of the last tenth less mean of the first tenth, of at least one sample each; and the slope over positions."""
    full = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(_before(by, at))).withColumn("_all", F.count("*").over(Window.partitionBy(*by)))
    k = F.greatest(F.lit(1), F.floor(F.col("_all") * share))
    return full.withColumn("_k", k).groupBy(*by).agg((F.avg(F.when(F.col("_n") > F.col("_all") - F.col("_k"), F.col(value))) - F.avg(F.when(F.col("_n") <= F.col("_k"), F.col(value)))).alias("start_end_diff"), F.regr_slope(value, "_n").alias("level_slope"))


def perturbation(df: DataFrame, by: list[str], at: str, value: str, widths: tuple[int, ...] = (3, 5, 11)) -> DataFrame:
    """Local jitter, absolute and in percent of the mean; quotients against moving means of full windows; mean |20 log10 ratio|."""
    w = _before(by, at)
    x = F.col(value)
    df = df.where(x.isNotNull()).withColumn("_d", F.abs(x - F.lag(value).over(w))).withColumn("_db", F.abs(20 * F.log10(F.when((x > 0) & (F.lag(value).over(w) > 0), x / F.lag(value).over(w)))))
    for k in widths:
        near = w.rowsBetween(-(k // 2), k // 2)
        df = df.withColumn(f"_q{k}", F.when(F.count(value).over(near) == k, F.abs(x - F.avg(value).over(near))))
    mean = F.when(F.avg(value) != 0, F.avg(value))
    return df.groupBy(*by).agg(F.avg("_d").alias("local_absolute"), (100 * F.avg("_d") / mean).alias("local_percent"), *[(100 * F.avg(f"_q{k}") / mean).alias(f"quotient_{k}") for k in widths], F.avg("_db").alias("local_db"))


def local_extrema(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """(by..., at, value, kind): strict peaks and troughs; of a level stretch the middle sample, rounded down; never the ends."""
    w = _before(by, at)
    rows = df.where(F.col(value).isNotNull()).select(*by, at, value).withColumn("_n", F.row_number().over(w)).withColumn("_new", F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("int"))
    flat = rows.withColumn("_run", F.sum("_new").over(w)).withColumn("_mid", F.floor((F.min("_n").over(Window.partitionBy(*by, "_run")) + F.max("_n").over(Window.partitionBy(*by, "_run"))) / 2)).where(F.col("_n") == F.col("_mid"))
    u = _before(by, "_run")
    kind = F.when((F.lag(value).over(u) < F.col(value)) & (F.lead(value).over(u) < F.col(value)), "peak").when((F.lag(value).over(u) > F.col(value)) & (F.lead(value).over(u) > F.col(value)), "trough")
    return flat.withColumn("kind", kind).where("kind IS NOT NULL").select(*by, at, value, "kind")


def event_rate(events: DataFrame, by: list[str], time: str, durations: DataFrame) -> DataFrame:
    """Events over duration_sec, and the sample CV of the intervals between them; recordings of `durations` without events have rate 0."""
    gaps = events.withColumn("_g", F.col(time) - F.lag(time).over(_before(by, time)))
    cv = F.stddev_samp("_g") / F.when(F.avg("_g") != 0, F.avg("_g"))
    found = gaps.groupBy(*by).agg(F.count("*").alias("n_events"), cv.alias("interval_cv"))
    return durations.join(found, by, "left").select(*by, F.coalesce("n_events", F.lit(0)).alias("n_events"), (F.coalesce("n_events", F.lit(0)) / F.when(F.col("duration_sec") > 0, F.col("duration_sec"))).alias("rate"), "interval_cv")


def path_length(df: DataFrame, by: list[str], at: str, value: str, time: str) -> DataFrame:
    """The integral of |value| over time by trapezoids of successive samples that both have it."""
    w = _before(by, at)
    a = (F.abs(F.col(value)) + F.abs(F.lag(value).over(w))) / 2 * (F.col(time) - F.lag(time).over(w))
    return df.withColumn("_a", a).groupBy(*by).agg(F.sum("_a").alias("path_length"))


def visit_order(df: DataFrame, by: list[str], date: str, tie: str) -> DataFrame:
    """record_order, days_since_first and interval_from_previous_days of each row among those equal in `by`."""
    w = Window.partitionBy(*by).orderBy(F.col(date).asc_nulls_last(), tie)
    return df.withColumn("record_order", F.row_number().over(w)).withColumn("days_since_first", F.datediff(date, F.min(date).over(Window.partitionBy(*by)))).withColumn("interval_from_previous_days", F.datediff(date, F.lag(date).over(w)))


def baseline_change(df: DataFrame, by: list[str], order: list[str], value: str, scale_by: list[str]) -> DataFrame:
    """value less the first known one among rows equal in `by`, over the sample SD of the value among rows equal in scale_by."""
    first = F.first(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sds = df.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(scale_by)]).agg(F.stddev_samp(value).alias("_sd"))
    met = df.withColumn("change", F.col(value) - first).join(sds, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(scale_by)]), "left")
    return met.withColumn("standardized_change", F.col("change") / F.when(F.col("_sd") > 0, F.col("_sd"))).drop("_sd", *[f"_g{k}" for k in range(len(scale_by))])


def manual_qc_change(df: DataFrame, by: list[str], order: list[str], answer: str) -> DataFrame:
    """flag, 1 for yes and 0 for no in any spelling, NULL for other answers, and its change from the first known one among rows equal in `by`."""
    said = F.lower(F.trim(F.col(answer).cast("string")))
    rows = df.withColumn("flag", F.when(said.isin("true", "1", "yes", "y"), 1.0).when(said.isin("false", "0", "no", "n"), 0.0))
    first = F.first("flag", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("change", F.col("flag") - first)


def sigma_clip(df: DataFrame, by: list[str], value: str, limits: tuple[float, ...] = (5.0, 3.0), ddof: int = 0) -> DataFrame:
    """value with NULL for what lies beyond limits of SDs from the mean, recomputed after each pass; n_clipped per recording."""
    spread_ = F.stddev_samp if ddof else F.stddev_pop
    every, out = Window.partitionBy(*by), df.withColumn("_was", F.col(value))
    for limit in limits:
        away = F.abs(F.col(value) - F.avg(value).over(every)) > limit * spread_(value).over(every)
        out = out.withColumn(value, F.when(~F.coalesce(away, F.lit(False)), F.col(value)))
    return out.withColumn("n_clipped", F.count_if(F.col("_was").isNotNull() & F.col(value).isNull()).over(every)).drop("_was")


def estimate_fps(df: DataFrame, by: list[str], at: str, time: str, default: float = 30.0) -> DataFrame:
    """One over the median positive step of time, `default` where there is none."""
    step = F.col(time) - F.lag(time).over(_before(by, at))
    med = F.get(F.percentile(F.when(F.col("_s") > 0, F.col("_s")), F.array(F.lit(0.5))), F.lit(0))
    return df.withColumn("_s", step).groupBy(*by).agg(F.coalesce(1 / med, F.lit(default)).alias("fps"))


def label_in(events: DataFrame, intervals: DataFrame, by: list[str], at: Column, start: str, end: str, width: float = 10.0) -> DataFrame:
    """events joined to the intervals that hold `at`, both ends included.

    An interval stands in buckets of the least power of two times `width` that is no shorter than it is: two at most,
    however long it is. An event looks in one bucket of each power that some interval has.
    """
    length = F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    level = F.greatest(F.ceil(F.log2(F.greatest(length / width, F.lit(1e-9)))), F.lit(0)).cast("int")
    bucket = lambda x: F.floor(x / (width * F.pow(F.lit(2.0), F.col("_level"))))
    leveled = intervals.withColumn("_level", level)
    cut = leveled.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    levels = [r[0] for r in leveled.select("_level").distinct().where("_level IS NOT NULL").collect()]  # powers of two of lengths
    looking = events.withColumn("_at", at).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>")))
    met = looking.withColumn("_bucket", bucket(F.col("_at"))).join(cut, [*by, "_level", "_bucket"])
    return met.where((F.col("_at") >= F.col(start)) & (F.col("_at") <= F.col(end))).drop("_bucket", "_level", "_at")
