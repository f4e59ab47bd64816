"""Counts, coverage, multi-statistic aggregation, segment and timing summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.stats import group_quantiles, joined_by, long_form, quantiles


def group_counts(df: DataFrame, design: list[str]) -> DataFrame:
    """Rows per level of each design column."""
    return df.select(*[F.col(c).cast("string") for c in design]).unpivot([], design, "group_variable", "level").where("level IS NOT NULL").groupBy("group_variable", "level").agg(F.count("*").alias("n_rows"))


def design_overview(df: DataFrame, design: list[str], top: int = 8) -> DataFrame:
    """Distinct and missing levels of each design column and its most frequent ones, ties by name."""
    long = df.select(*[F.col(c).cast("string") for c in design]).unpivot([], design, "column", "level")
    counts = long.groupBy("column", "level").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("place", F.when(F.col("level").isNotNull(), F.row_number().over(Window.partitionBy("column").orderBy(F.col("level").isNull(), F.desc("n"), "level"))))
    best = F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", F.concat_ws(": ", "level", F.col("n").cast("string")).alias("text")))))
    return ranked.groupBy("column").agg(F.count("level").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.array_join(F.transform(best, lambda x: x["text"]), "; ").alias("top_values"))


def task_subject_coverage(df: DataFrame, task: str, subject: str) -> DataFrame:
    per = df.where(F.col(task).isNotNull()).groupBy(task, subject).agg(F.count("*").alias("n"))
    return per.groupBy(task).agg(F.sum("n").alias("n_rows"), F.count(subject).alias("n_subjects"), F.count_if((F.col("n") >= 2) & F.col(subject).isNotNull()).alias("n_repeated_subjects"), (F.sum(F.when(F.col(subject).isNotNull(), F.col("n"))) / F.when(F.count(subject) > 0, F.count(subject))).alias("records_per_subject"))


def session_histogram(df: DataFrame, subject: str, session: str) -> DataFrame:
    """How many subjects have how many sessions."""
    per = df.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.count_distinct(session).alias("n_sessions"))
    return per.groupBy("n_sessions").agg(F.count("*").alias("n_subjects"))


def subject_session_counts(df: DataFrame, subject: str, session: str) -> DataFrame:
    return df.groupBy(subject, session).agg(F.count("*").alias("n_rows"))


def collapse_to_other(df: DataFrame, column: str, keep: int) -> DataFrame:
    """The `keep` most frequent levels, ties by name; the rest, NULL not, as 'Other'."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    top = counts.orderBy(F.desc("_n"), column).limit(keep).select(column, F.lit(True).alias("_top"))
    return df.join(top, column, "left").withColumn(column, F.when(F.col("_top") | F.col(column).isNull(), F.col(column)).otherwise("Other")).drop("_top")


def task_crosstab(df: DataFrame, task: str, group: str, keep: int = 6) -> DataFrame:
    """Counts and shares within each task of the most frequent groups and 'Other'."""
    counts = collapse_to_other(df.where(F.col(task).isNotNull() & F.col(group).isNotNull()).select(task, group), group, keep).groupBy(task, group).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("proportion", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(task)))


def task_readiness(df: DataFrame, task: str, subject: str, group: str, features: list[str]) -> DataFrame:
    """Rows, subjects, mean feature missingness and the smallest group of each task."""
    missing = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0)) / len(features)
    rows = df.groupBy(task).agg(F.count("*").alias("n_rows"), F.count_distinct(subject).alias("n_subjects"), F.avg(missing).alias("mean_missing_fraction"))
    least = df.where(F.col(group).isNotNull()).groupBy(task, group).agg(F.count("*").alias("n")).groupBy(task).agg(F.min("n").alias("smallest_group"))
    return rows.join(least, task, "left")


def aggregate_features(df: DataFrame, keys: list[str], features: list[str], median: bool = False, first: dict[str, str] | None = None) -> DataFrame:
    """Mean or median of every feature per group, NULL keys kept, and the number of rows; `first`: column -> what orders it, the first known value."""
    stat = (lambda c: F.get(quantiles(c, [0.5]), F.lit(0))) if median else F.avg
    extra = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(o))).alias(c) for c, o in (first or {}).items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n_files"), *[stat(c).alias(c) for c in features], *extra)


def aggregate_multistat(long: DataFrame, keys: list[str]) -> DataFrame:
    """Twelve statistics of each feature per group: the SD is that of the values themselves, from two on."""
    found = long.groupBy(*keys, "feature").agg(F.count("value").alias("n"), (1 - F.count("value") / F.count("*")).alias("missing_fraction"), F.avg("value").alias("mean"), F.when(F.count("value") >= 2, F.stddev_pop("value")).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    found = joined_by(found, group_quantiles(long, [*keys, "feature"], "value", [0.05, 0.25, 0.5, 0.75, 0.95]), [*keys, "feature"])
    q = [F.get("q", F.lit(k)) for k in range(5)]
    return found.select(*keys, "feature", "n", "missing_fraction", "mean", q[2].alias("median"), "sd", (q[3] - q[1]).alias("iqr"), q[0].alias("q05"), q[1].alias("q25"), q[3].alias("q75"), q[4].alias("q95"), "min", "max")


def impute_global_median(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing values as the column's median over all rows."""
    found = group_quantiles(long_form(df, [], features), ["feature"], "value", [0.5])
    medians = found.agg(*[F.max(F.when(F.col("feature") == c, F.get("q", F.lit(0)))).alias(f"_{c}") for c in features])
    filled = df.crossJoin(F.broadcast(medians))  # one row
    return filled.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in features else F.col(c) for c in df.columns])


def drop_sparse_features(df: DataFrame, features: list[str], limit: float) -> DataFrame:
    """df without the features missing in more than `limit` of the rows."""
    share = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in features]).first()
    return df.drop(*[c for c in features if share["_n"] and 1 - share[c] / share["_n"] > limit])


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing rows and the present share of each column."""
    row = df.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("k")) for c in columns]).alias("x"))
    return row.select("n", F.inline("x")).select("column", (F.col("n") - F.col("k")).alias("n_missing"), (F.col("k") / F.when(F.col("n") > 0, F.col("n"))).alias("fraction_present"))


def flag_counts(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """How often each entry of delimited lists occurs."""
    return df.select(F.explode(F.split(column, sep)).alias("flag")).select(F.trim("flag").alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


def temporal_summary(df: DataFrame, by: list[str], value: str, dense: bool = False) -> DataFrame:
    """Share of valid samples, median, IQR, p05, p95 and their distance of a signal per recording; dense: mean, SD, min, max, p01, p25, p75 and p99, too."""
    found = df.groupBy(*by).agg(F.count("*").alias("n_samples"), (F.count(value) / F.count("*")).alias("valid_fraction"), quantiles(value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]).alias("q"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = [F.get("q", F.lit(k)) for k in range(7)]
    more = ["mean", "sd", "min", "max", q[0].alias("p01"), q[2].alias("p25"), q[4].alias("p75"), q[6].alias("p99")] if dense else []
    return found.select(*by, "n_samples", "valid_fraction", q[3].alias("median"), (q[4] - q[2]).alias("iqr"), q[1].alias("p05"), q[5].alias("p95"), (q[5] - q[1]).alias("range_p05_p95"), *more)


def segment_summary(segments: DataFrame, by: list[str], frames: DataFrame | None = None, level: str = "rms_db") -> DataFrame:
    """Segments, the share of speech, silence before and after, the longest pause inside and, of frames, median and SD of the level."""
    d, role = F.col("duration_sec"), F.col("segment_role")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = segments.groupBy(*by).agg(F.count("*").alias("n_segments"), (zero(F.sum(F.when(role == "speech", d))) / F.when(F.sum(d) > 0, F.sum(d))).alias("speech_fraction"), zero(F.sum(F.when(role == "leading", d))).alias("leading_silence_sec"), zero(F.sum(F.when(role == "trailing", d))).alias("trailing_silence_sec"), zero(F.max(F.when(role == "internal", d))).alias("longest_internal_pause_sec"))
    if frames is None:
        return found
    levels = frames.groupBy(*by).agg(F.get(quantiles(level, [0.5]), F.lit(0)).alias(f"{level}_median"), F.stddev_pop(level).alias(f"{level}_std"))
    return found.join(levels, by, "left")


def timing_features(segments: DataFrame, by: list[str], words: Column | None = None, min_pause: float = 0.30) -> DataFrame:
    """Timing from the first speech to the last: totals, counts, means and sample CVs of pauses of at least min_pause and of longer phrases."""
    speech, d = F.col("segment_type") == "speech", F.col("duration_sec")
    every = Window.partitionBy(*by)
    inside = segments.withColumn("_a", F.min(F.when(speech, F.col("start_sec"))).over(every)).withColumn("_b", F.max(F.when(speech, F.col("end_sec"))).over(every)).where("start_sec >= _a AND end_sec <= _b")
    pause, phrase = ~speech & (d >= min_pause), speech & (d > min_pause)
    p, s = F.when(pause, d), F.when(phrase, d)
    total = F.max("_b") - F.min("_a")
    cv = lambda x: F.stddev_samp(x) / F.when(F.avg(x) > 0, F.avg(x))
    found = inside.groupBy(*by).agg(total.alias("total_duration"), F.coalesce(F.sum(F.when(speech, d)), F.lit(0.0)).alias("speech_duration"), F.coalesce(F.sum(p), F.lit(0.0)).alias("pause_duration"), F.count(p).alias("n_pauses"), F.count(s).alias("n_phrases"), F.avg(p).alias("mean_pause"), F.avg(s).alias("mean_phrase"), cv(p).alias("cv_pause"), cv(s).alias("cv_phrase"))
    found = found.withColumn("percent_pause", 100 * F.col("pause_duration") / F.when(F.col("total_duration") > 0, F.col("total_duration")))
    return found if words is None else found.withColumn("words_per_minute", 60 * words / F.when(F.col("total_duration") > 0, F.col("total_duration")))


def feature_family_overview(long: DataFrame, registry: DataFrame) -> DataFrame:
    """Features, numeric ones (all in a long table), mean missing share and median number of values of each family."""
    per = long.groupBy("feature").agg((1 - F.count("value") / F.count("*")).alias("_m"), F.count("value").alias("_k"))
    named = per.join(registry.select("feature", F.col("family")).dropDuplicates(["feature"]), "feature", "left").withColumn("family", F.coalesce("family", F.lit("unclassified")))
    return named.groupBy("family").agg(F.count("*").alias("n_features"), F.count("*").alias("n_numeric_features"), F.avg("_m").alias("mean_missing_fraction"), F.get(quantiles("_k", [0.5]), F.lit(0)).alias("median_nonmissing"))


def _warned() -> Column:
    return (F.lower(F.coalesce("status", F.lit(""))) != "pass") | (F.trim(F.coalesce("warning", F.lit(""))) != "")


def format_summary(files: DataFrame, by: list[str]) -> DataFrame:
    """Files of each format and resolution: medians of rate and duration, frames and those with a warning; NULL formats are groups, too."""
    size = F.coalesce(F.concat_ws(" x ", *[F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.col(c).cast("int").cast("string")) for c in ("width", "height")]), F.lit(""))
    rows = files.withColumn("resolution", F.when(size == "", "unknown").otherwise(size))
    return rows.groupBy(*by, "resolution").agg(F.count("*").alias("files"), F.get(quantiles("fps", [0.5]), F.lit(0)).alias("median_fps"), F.get(quantiles("duration_sec", [0.5]), F.lit(0)).alias("median_duration_sec"), F.coalesce(F.sum("n_frames"), F.lit(0)).alias("estimated_frames"), F.count_if(_warned()).alias("warnings"))


def ingest_summary(files: DataFrame) -> DataFrame:
    """One row: whether the files can be read (FAIL, REVIEW, PASS), their numbers, frames, rates and durations."""
    ok = F.lower(F.coalesce("status", F.lit(""))) == "pass"
    middle = group_quantiles(files.select(F.lit(0).alias("of"), "fps", "duration_sec").unpivot(["of"], ["fps", "duration_sec"], "measure", "x"), ["measure"], "x", [0.5])
    middle = middle.agg(*[F.max(F.when(F.col("measure") == c, F.col("q")[0])).alias(f"median_{c}") for c in ("fps", "duration_sec")])
    found = files.agg(F.count("*").alias("n_videos"), F.count_if(ok).alias("readable_videos"), F.count_if(_warned()).alias("warning_videos"), F.count_if(~ok).alias("unreadable_videos"), F.coalesce(F.sum("n_frames"), F.lit(0)).alias("total_frames"), F.min("fps").alias("min_fps"), F.max("fps").alias("max_fps"), F.sum("duration_sec").alias("total_duration_sec")).crossJoin(middle)  # one row each
    return found.withColumn("readiness", F.when(F.col("readable_videos") == 0, "FAIL").when(F.col("warning_videos") > 0, "REVIEW").otherwise("PASS"))


def warning_rows(files: DataFrame) -> DataFrame:
    """Files that aren't read as pass, or have a warning."""
    return files.where(_warned())


def feature_completion(status: DataFrame, by: list[str]) -> DataFrame:
    """Selected and computed values of each file (by..., feature, status), and the share of the latter."""
    done = F.count_if(F.col("status").isin("computed", "computed_proxy"))
    return status.groupBy(*by).agg(F.count("feature").alias("selected_feature_values"), done.alias("computed_feature_values"), (done / F.when(F.count("feature") > 0, F.count("feature"))).alias("feature_completion_fraction"))


def status_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per status, family or label."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))
