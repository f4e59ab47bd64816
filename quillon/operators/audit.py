"""Missingness, distributions, outliers, expected ranges and quality-control associations of feature tables.

`long` tables are (record_key, feature, value) with NULL for missing values, see quillon.functions.stats.long_form.
Registries are (feature, family, expected_low, expected_high), one row per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import finite, log_transform, missingness_band, qc_family_of, range_band, reason_list, winsorize, worst_of
from quillon.functions.gram import cross_correlations
from quillon.functions.select import column_quantiles
from quillon.functions.shared import global_rank, settled
from quillon.functions.stats import OUTLIER_Z, adjusted_skewness, group_quantiles, long_form, quantiles, robust_z, spread


def with_family(df: DataFrame, registry: DataFrame, feature: str = "feature", out: str = "family") -> DataFrame:
    """df with the family of a feature, 'unclassified' where the registry has none."""
    names = registry.select(F.col("feature").alias(feature), F.col("family").alias("_family")).dropDuplicates([feature])
    return df.join(names, feature, "left").withColumn(out, F.coalesce("_family", F.lit("unclassified"))).drop("_family")


def missingness_by_feature(long: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows, missing and valid ones, their share, distinct values and a band, per feature."""
    counts = long.groupBy("feature").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_valid"), F.count_distinct("value").alias("n_unique_valid"))
    counts = counts.withColumn("n_missing", F.col("n_rows") - F.col("n_valid")).withColumn("missing_fraction", F.col("n_missing") / F.col("n_rows"))
    return with_family(counts, registry).withColumn("missingness_status", missingness_band(F.col("missing_fraction")))


def missingness_by_row(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Missing features and columns of each row; no shuffle."""
    missing = lambda cols: sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    n = len(features)
    share = missing(features) / n if n else F.lit(None).cast("double")
    return df.select(key, (missing(df.columns) / len(df.columns)).alias("missing_fraction_all_columns"), share.alias("missing_fraction_feature_columns"), missing(features).alias("n_missing_features"), (n - missing(features)).alias("n_valid_features"), F.coalesce(missingness_band(share), F.lit("not_available")).alias("row_missingness_status"))


def missingness_by_group(df: DataFrame, features: list[str], design: list[str]) -> DataFrame:
    """Row missingness per level of each design column; rows without a level are left out."""
    share = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0)) / len(features)
    rows = df.select(share.alias("share"), *[F.col(c).cast("string") for c in design]).unpivot(["share"], design, "group_variable", "level").where("level IS NOT NULL")
    found = rows.groupBy("group_variable", "level").agg(F.count("*").alias("n_rows"), F.avg("share").alias("mean_feature_missing_fraction"), quantiles("share", [0.5, 0.75]).alias("q"), F.count_if(F.col("share") >= 0.80).alias("n_high_review_rows"), F.count_if(F.col("share") >= 0.50).alias("n_review_or_higher_rows"))
    return found.select("group_variable", "level", "n_rows", "mean_feature_missing_fraction", F.get("q", F.lit(0)).alias("median_feature_missing_fraction"), F.get("q", F.lit(1)).alias("q75_feature_missing_fraction"), "n_high_review_rows", "n_review_or_higher_rows")


def missingness_by_family(by_feature: DataFrame) -> DataFrame:
    return by_feature.groupBy("family").agg(F.count("*").alias("n_features"), F.avg("missing_fraction").alias("mean_missing_fraction"), F.get(quantiles("missing_fraction", [0.5]), F.lit(0)).alias("median_missing_fraction"), F.max("missing_fraction").alias("max_missing_fraction"), F.count_if(F.col("missingness_status").isin("review", "high_review")).alias("n_review_features"))


def comissing_pairs(df: DataFrame, features: list[str], top_n: int = 40) -> DataFrame:
    """Share of rows in which both of two features are missing, among the top_n features most often missing.

    One aggregate over the rows counts all pairs of these few columns, so no row is ever repeated per pair.
    """
    n_missing = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first().asDict()  # one number per feature
    top = sorted(features, key=lambda c: (-n_missing[c], c))[:top_n]
    pairs = [(min(a, b), max(a, b)) for i, a in enumerate(top) for b in top[i + 1 :]]
    both = df.agg(F.count("*").alias("n"), F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias("n_co_missing")) for a, b in pairs]).alias("pairs"))
    return both.select("n", F.inline("pairs")).select("feature_a", "feature_b", "n_co_missing", (F.col("n_co_missing") / F.col("n")).alias("co_missing_fraction"))


def distribution_summary(long: DataFrame, approx: bool = False) -> DataFrame:
    """Location, spread, quantiles, robust outliers, tails, floors and ceilings of each feature.

    Outliers: robust score above 3.5 by the median deviation, Tukey's fences where that is 0, none where the IQR is 0 too.
    """
    names = ["q01", "q05", "q25", "median", "q75", "q95", "q99"]
    of = lambda df, x, qs: df.groupBy("feature").agg(quantiles(x, qs, True).alias("q")) if approx else group_quantiles(df, ["feature"], x, qs)
    base = long.groupBy("feature").agg(F.count("*").alias("n_rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_distinct("value").alias("unique_values"))
    base = base.join(of(long, "value", [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]), "feature", "left")
    base = base.select("feature", "n_rows", "n", "mean", "sd", "min", "max", "unique_values", *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(names)]).withColumn("iqr", F.col("q75") - F.col("q25"))
    valid = long.where("value IS NOT NULL")
    away = valid.join(base.select("feature", "median"), "feature").withColumn("away", F.abs(F.col("value") - F.col("median")))
    away = of(away, "away", [0.5]).select("feature", F.get("q", F.lit(0)).alias("mad"))
    known = base.join(away, "feature", "left")
    v = F.col("value")
    out = F.when(F.col("mad") > 0, F.abs(0.6745 * (v - F.col("median")) / F.col("mad")) > OUTLIER_Z).when(F.col("iqr") > 0, (v < F.col("q25") - 1.5 * F.col("iqr")) | (v > F.col("q75") + 1.5 * F.col("iqr"))).otherwise(False)
    marks = valid.join(known.select("feature", "median", "mad", "iqr", "q25", "q75", "min", "max"), "feature").groupBy("feature").agg(F.avg(out.cast("int")).alias("robust_outlier_fraction"), F.avg((v == F.col("min")).cast("int")).alias("floor_fraction"), F.avg((v == F.col("max")).cast("int")).alias("ceiling_fraction"))
    return _described(known.join(marks, "feature", "left"))


def _described(known: DataFrame) -> DataFrame:
    some = F.col("n") > 0
    return (
        known.withColumn("missing_fraction", 1 - F.col("n") / F.col("n_rows"))
        .withColumn("robust_outlier_method", F.when(some, F.when(F.col("mad") > 0, "median_mad").when(F.col("iqr") > 0, "iqr_scaled").otherwise("zero_variance")))
        .withColumn("skew_proxy", F.when(F.col("sd") > 0, (F.col("mean") - F.col("median")) / F.col("sd")))
        .withColumn("tail_ratio", F.when(F.col("iqr") > 0, (F.col("q95") - F.col("q05")) / F.col("iqr")))
        .withColumn("robust_cv", F.when((F.col("iqr") > 0) & (F.col("median") != 0), F.col("iqr") / F.abs(F.col("median"))))
        .withColumn("zero_variance", F.col("unique_values") <= 1)
        .withColumn("near_zero_variance", F.coalesce(((F.col("iqr") == 0) & (F.col("unique_values") <= F.greatest(F.lit(2), F.floor(0.03 * F.col("n"))))) | (F.coalesce("sd", F.lit(1.0)) == 0), F.lit(False)))
        .drop("n_rows")
    )


def expected_range_flags(long: DataFrame, registry: DataFrame) -> DataFrame:
    """Valid values outside the registry's bounds, per feature, with a band of their share."""
    bounds = registry.select("feature", "expected_low", "expected_high").dropDuplicates(["feature"])
    low, high = F.col("value") < F.col("expected_low"), F.col("value") > F.col("expected_high")
    found = long.join(bounds, "feature", "left").groupBy("feature", "expected_low", "expected_high").agg(F.count("value").alias("n_valid"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(low).alias("n_below_expected"), F.count_if(high).alias("n_above_expected"))
    return _range_flags(found)


def _range_flags(found: DataFrame) -> DataFrame:
    has = F.col("expected_low").isNotNull() | F.col("expected_high").isNotNull()
    share = F.when(has & (F.col("n_valid") > 0), (F.col("n_below_expected") + F.col("n_above_expected")) / F.col("n_valid"))
    return found.withColumn("fraction_outside_expected", share).withColumn("range_status", F.when(has & (F.col("n_valid") == 0), "high_review").otherwise(range_band(share)))


def table_distribution(table: DataFrame, features: list[str]) -> DataFrame:
    """distribution_summary() of the columns of a written wide table; only distinct values are shuffled."""
    spark, names, x = table.sparkSession, ["q01", "q05", "q25", "median", "q75", "q95", "q99"], {c: finite(F.col(c).cast("double")) for c in features}
    values = table.select(*[v.alias(c) for c, v in x.items()])
    told = lambda rows, of: rows.agg(F.array(*[F.struct(F.lit(c).alias("feature"), *of(c)) for c in features]).alias("_e")).select(F.inline("_e"))
    base = told(values, lambda c: [F.count("*").alias("n_rows"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max")]).where("n_rows > 0")
    distinct = values.unpivot([], features, "feature", "value").where("value IS NOT NULL").distinct().groupBy("feature").agg(F.count("*").alias("unique_values"))
    base = base.join(distinct, "feature", "left").withColumn("unique_values", F.coalesce("unique_values", F.lit(0)))
    q = column_quantiles(table, [x[c] for c in features], [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    median = {c: q[k][3] for k, c in enumerate(features) if k in q}
    away = column_quantiles(table, [F.abs(x[c] - median[c]) for c in median], [0.5])
    mad = {c: away[k][0] for k, c in enumerate(median)}
    one = spark.createDataFrame([(c, *q[k], mad[c]) for k, c in enumerate(features) if k in q], "feature string, " + ", ".join(f"{n} double" for n in [*names, "mad"]))
    known = settled(base.join(one, "feature", "left").withColumn("iqr", F.col("q75") - F.col("q25")))
    of = {r["feature"]: r for r in known.collect()}  # one row per feature

    def marks(c: str) -> list:
        r, v = of.get(c), F.col(c)
        if r is None or not r["n"]:
            return [F.lit(None).cast("double").alias(n) for n in ("robust_outlier_fraction", "floor_fraction", "ceiling_fraction")]
        out = F.abs(0.6745 * (v - r["median"]) / r["mad"]) > OUTLIER_Z if r["mad"] > 0 else (v < r["q25"] - 1.5 * r["iqr"]) | (v > r["q75"] + 1.5 * r["iqr"]) if r["iqr"] > 0 else v.isNull()
        return [F.avg(m.cast("int")).alias(n) for m, n in ((F.when(v.isNotNull(), out), "robust_outlier_fraction"), (v == r["min"], "floor_fraction"), (v == r["max"], "ceiling_fraction"))]

    return _described(known.join(told(values, marks), "feature", "left"))


def table_range_flags(table: DataFrame, features: list[str], registry: DataFrame) -> DataFrame:
    """expected_range_flags() of the columns of a wide table, in one aggregate."""
    bounds = {r["feature"]: r for r in registry.where(F.col("feature").isin(features)).dropDuplicates(["feature"]).collect()}  # one row per feature

    def counts(c: str):
        v = finite(F.col(c).cast("double"))
        low, high = (F.lit(bounds[c][k] if c in bounds else None).cast("double") for k in ("expected_low", "expected_high"))
        return F.struct(F.lit(c).alias("feature"), low.alias("expected_low"), high.alias("expected_high"), F.count("*").alias("_n"), F.count(v).alias("n_valid"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v < low).alias("n_below_expected"), F.count_if(v > high).alias("n_above_expected"))

    return _range_flags(table.agg(F.array(*map(counts, features)).alias("_e")).select(F.inline("_e")).where("_n > 0").drop("_n"))


def robust_outlier_flags(long: DataFrame, registry: DataFrame, approx: bool = False) -> DataFrame:
    """One row per value whose robust score exceeds 3.5 or that leaves its expected range."""
    bounds = registry.select("feature", "expected_low", "expected_high").dropDuplicates(["feature"])
    scored = long.where("value IS NOT NULL").join(spread(long, approx=approx), "feature").join(bounds, "feature", "left").withColumn("robust_z", robust_z(F.col("value")))
    strong = F.coalesce(F.abs(F.col("robust_z")) > OUTLIER_Z, F.lit(False))
    low, high = (F.coalesce(c, F.lit(False)) for c in (F.col("value") < F.col("expected_low"), F.col("value") > F.col("expected_high")))
    kinds = reason_list([(strong, "robust_z_abs_gt_3_5"), (low, "below_expected_range"), (high, "above_expected_range")], "")
    method = F.when(F.col("mad") > 0, "median_mad").when(F.col("iqr") > 0, "iqr_scaled").otherwise("zero_variance")
    return scored.where(strong | low | high).select("record_key", "feature", "value", F.col("med").alias("median"), "iqr", "robust_z", kinds.alias("flag_type"), F.when(low | high, "range_review").otherwise("statistical_review").alias("review_level"), method.alias("robust_method"))


def row_outlier_burden(flags: DataFrame, n_features: int) -> DataFrame:
    """Flags per row; names of up to 30 flagged features in order."""
    found = flags.groupBy("record_key").agg(F.count_distinct("feature").alias("n_flagged_features"), F.count_if(F.col("flag_type").contains("expected_range")).alias("range_flag_count"), F.count_if(F.col("flag_type").contains("robust_z")).alias("robust_flag_count"), F.array_join(F.slice(F.array_sort(F.collect_set("feature")), 1, 30), ", ").alias("flagged_features"))
    share = F.col("n_flagged_features") / max(1, n_features)
    return found.withColumn("fraction_flagged_features", share).withColumn("review_level", worst_of([((F.col("range_flag_count") > 0) | (share >= 0.20), "review"), (share >= 0.05, "monitor")]))


def _checks(x: dict[str, Column]) -> dict[str, Column]:
    """Conditions that reviews share."""
    return {k: F.coalesce(c, F.lit(False)) for k, c in x.items()}


def distribution_review(dist: DataFrame, expected: DataFrame) -> DataFrame:
    """ok, monitor or review per feature, and why. A monitor reason is given only while nothing before it was found."""
    df = dist.join(expected.select("feature", "fraction_outside_expected", "range_status"), "feature", "left")
    c = _checks({"few": F.col("n") < 3, "zero": F.col("zero_variance"), "miss": F.col("missing_fraction") >= 0.5, "some_miss": F.col("missing_fraction") >= 0.2, "out": F.col("robust_outlier_fraction") >= 0.2, "some_out": F.col("robust_outlier_fraction") >= 0.05, "range": F.col("range_status").isin("review", "high_review"), "some_range": F.col("range_status") == "minor_review"})
    some_miss = c["some_miss"] & ~c["miss"] & ~c["few"] & ~c["zero"]
    some_out = c["some_out"] & ~c["out"] & ~c["few"] & ~c["zero"] & ~c["miss"] & ~some_miss
    some_range = c["some_range"] & ~(c["few"] | c["zero"] | c["miss"] | c["out"] | some_miss | some_out)
    reasons = [(c["few"], "too few valid observations"), (c["zero"], "zero variance"), (c["miss"], "high missingness"), (some_miss, "moderate missingness"), (c["out"], "many robust outliers"), (some_out, "some robust outliers"), (c["range"], "expected-range violations"), (some_range, "minor expected-range violations")]
    status = worst_of([(c["few"] | c["zero"] | c["miss"] | c["out"] | c["range"], "review"), (some_miss | some_out | some_range, "monitor")])
    return df.select("feature", "n", "missing_fraction", "robust_outlier_fraction", "fraction_outside_expected", status.alias("distribution_status"), reason_list(reasons, "no major distribution issue detected").alias("review_reason"))


def distribution_shape(dist: DataFrame, expected: DataFrame) -> DataFrame:
    """Shape classes and a priority per feature; reasons for monitoring by missing, outlying or out-of-range values are given only where nothing came before."""
    df = dist.join(expected.select("feature", "range_status"), "feature", "left")
    c = _checks({"few": F.col("n") < 10, "zero": F.col("zero_variance"), "near": F.col("near_zero_variance") & ~F.col("zero_variance"), "right": F.col("skew_proxy") >= 0.75, "left": F.col("skew_proxy") <= -0.75, "tail": F.col("tail_ratio") >= 4.5, "floor": F.col("floor_fraction") >= 0.2, "ceiling": F.col("ceiling_fraction") >= 0.2, "miss": F.col("missing_fraction") >= 0.5, "some_miss": F.col("missing_fraction") >= 0.2, "out": F.col("robust_outlier_fraction") >= 0.2, "some_out": F.col("robust_outlier_fraction") >= 0.05, "range": F.col("range_status").isin("review", "high_review"), "some_range": F.col("range_status") == "minor_review"})
    formed = c["few"] | c["zero"] | c["near"] | c["right"] | c["left"] | c["tail"] | c["floor"] | c["ceiling"]
    some_miss = c["some_miss"] & ~c["miss"] & ~formed
    some_out = c["some_out"] & ~c["out"] & ~formed & ~c["miss"] & ~some_miss
    some_range = c["some_range"] & ~formed & ~(c["miss"] | c["out"] | some_miss | some_out)
    priority = worst_of([(c["few"] | c["zero"] | c["miss"] | c["out"] | c["range"], "review"), (formed | some_miss | some_out | some_range, "monitor")])
    shapes = [(c["few"], "insufficient_n"), (c["zero"], "zero_variance"), (c["near"], "near_zero_variance"), (c["right"], "right-skewed"), (c["left"], "left-skewed"), (c["tail"], "heavy_tailed"), (c["floor"], "floor_effect"), (c["ceiling"], "ceiling_effect")]
    why = [(c["few"], "very small valid n"), (c["zero"], "zero variance; cannot separate records"), (c["near"], "near-zero variance / sparse spread"), (c["right"], "right-skewed"), (c["left"], "left-skewed"), (c["tail"], "heavy-tailed distribution"), (c["floor"], "possible floor effect"), (c["ceiling"], "possible ceiling effect"), (c["miss"], "high missingness"), (some_miss, "moderate missingness"), (c["out"], "large robust outlier burden"), (some_out, "some robust outliers"), (c["range"], "expected-range violations"), (some_range, "minor expected-range violations")]
    return df.select("feature", "n", reason_list(shapes, "compact_or_regular", ", ").alias("shape_class"), priority.alias("priority"), reason_list(why, "no major distribution-shape concern detected").alias("why_it_matters"))


def quality_landscape(dist: DataFrame, registry: DataFrame) -> DataFrame:
    """A score from 100 down, to one digit, by missing values, outliers, zero variance and fewer than 3 values; the status by conditions of its own."""
    miss, out = F.col("missing_fraction"), F.col("robust_outlier_fraction")
    c = _checks({"zero": F.col("zero_variance"), "few": F.col("n_valid") < 3, "miss": miss >= 0.5, "some_miss": miss >= 0.2, "out": out >= 0.2, "some_out": out >= 0.05})
    penalty = F.least(70 * F.coalesce(miss, F.lit(0.0)), F.lit(70.0)) + F.least(125 * F.coalesce(out, F.lit(0.0)), F.lit(25.0)) + F.when(c["zero"], 40.0).otherwise(0.0) + F.when(c["few"], 30.0).otherwise(0.0)
    scored = dist.withColumn("n_valid", F.coalesce("n", F.lit(0))).withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - penalty)), 1))
    status = worst_of([(c["zero"] | c["few"] | c["miss"] | c["out"], "review"), (c["some_miss"] | c["some_out"], "monitor")])
    return with_family(scored.select("feature", "missing_fraction", "robust_outlier_fraction", "n_valid", "zero_variance", status.alias("quality_status"), "quality_score"), registry)


def qc_catalog(qc_long: DataFrame) -> DataFrame:
    """Family, counts and spread of each quality metric."""
    found = qc_long.groupBy("feature").agg(F.count("value").alias("n"), (1 - F.count("value") / F.count("*")).alias("missing_fraction"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_distinct("value").alias("unique_values"))
    found = found.join(group_quantiles(qc_long, ["feature"], "value", [0.25, 0.5, 0.75]), "feature", "left")
    return found.select(F.col("feature").alias("qc_variable"), qc_family_of(F.col("feature")).alias("artifact_family"), "n", "missing_fraction", F.get("q", F.lit(1)).alias("median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"), "min", "max", "unique_values")


def _qc_scores(qc: DataFrame, key: str, metrics: list[str]) -> dict[str, Column]:
    # a metric without spread scores 0 in every row, missing values too
    found = {r["feature"]: r for r in spread(long_form(qc, key, metrics)).collect()}  # one row per metric
    scores = {}
    for c in metrics:
        med, mad, iqr = (found[c][k] if c in found else None for k in ("med", "mad", "iqr"))
        away = finite(F.col(c).cast("double")) - F.lit(med).cast("double")
        z = F.lit(0.0) if mad == 0 and iqr == 0 else 0.6745 * away / F.lit(mad) if mad else away / (F.lit(iqr) / 1.349) if iqr else F.lit(None).cast("double")
        scores[c] = F.abs(z)
    return scores


def _flag(z: Column) -> Column:
    return F.coalesce(z >= OUTLIER_Z, F.lit(False))


def qc_row_burden(qc: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Flagged metrics of each row of qc, which has a row per record; of metrics with the highest score the first by name. No shuffle but for the metrics' spread."""
    z = _qc_scores(qc, key, metrics)
    flags = sum((_flag(x).cast("int") for x in z.values()), F.lit(0)).cast("bigint")
    families = F.array_compact(F.array(*[F.when(_flag(x), qc_family_of(F.lit(c))) for c, x in z.items()]))
    ranked = F.array_min(F.array(*[F.when(x.isNotNull(), F.struct((-x).alias("z"), F.lit(c).alias("feature"))) for c, x in z.items()]))
    return qc.select(key, flags.alias("total_qc_flags"), (flags / len(metrics)).alias("qc_flag_fraction"), F.array_max(F.array(*z.values())).alias("max_abs_qc_z"), F.array_join(F.array_sort(F.array_distinct(families)), "; ").alias("elevated_qc_families"), F.coalesce(ranked["feature"], F.lit("")).alias("top_qc_variable"))


def qc_family_burden(qc: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Metrics of each artifact family, their missing share and IQR, and the median of the records' share of flagged ones; qc has a row per record.

    Shares are counted value by value, so that what is grouped grows with a family's metrics, not with the records.
    """
    shown = qc.sparkSession.createDataFrame([(c,) for c in metrics], "c string").select("c", qc_family_of(F.col("c")).alias("f")).collect()  # one row per metric
    of = {f: [r["c"] for r in shown if r["f"] == f] for f in sorted({r["f"] for r in shown})}
    z = _qc_scores(qc, key, metrics)
    share = lambda own: sum((_flag(z[c]).cast("int") for c in own), F.lit(0)) / len(own)
    rows = qc.select(F.inline(F.array(*[F.struct(F.lit(f).alias("artifact_family"), share(own).alias("share")) for f, own in of.items()])))
    rows = rows.groupBy("artifact_family", "share").agg(F.count("*").alias("n")).groupBy("artifact_family").agg(F.get(F.percentile("share", F.array(F.lit(0.5)), F.col("n")), F.lit(0)).alias("median_row_flag_fraction"))
    found = qc_catalog(long_form(qc, key, metrics)).groupBy("artifact_family").agg(F.count("*").alias("n_qc_metrics"), F.avg("missing_fraction").alias("mean_missing_fraction"), F.get(quantiles("iqr", [0.5]), F.lit(0)).alias("median_metric_iqr"))
    return found.join(rows, "artifact_family")


def _as_qc(qc_long: DataFrame) -> DataFrame:
    return qc_long.select("record_key", F.col("feature").alias("qc_variable"), "value")


def feature_qc_correlation(long: DataFrame, qc_long: DataFrame, min_n: int = 4) -> DataFrame:
    """Rank correlation of every feature with every quality metric over the rows that have both."""
    return cross_correlations(long, _as_qc(qc_long), "feature", "qc_variable", min_n)


def feature_qc_family(correlation: DataFrame) -> DataFrame:
    """Strongest metric of each artifact family per feature; ties go to the first by name."""
    df = correlation.where("rho IS NOT NULL").withColumn("artifact_family", qc_family_of(F.col("qc_variable"))).withColumn("a", F.abs(F.col("rho")))
    found = df.groupBy("feature", "artifact_family").agg(F.max("a").alias("max_abs_spearman"), F.get(quantiles("a", [0.5]), F.lit(0)).alias("median_abs_spearman"), F.count_distinct("qc_variable").alias("n_qc_metrics"), F.min(F.struct((-F.col("a")).alias("a"), "qc_variable", "rho")).alias("top"))
    rho = F.col("top.rho")
    return found.select("feature", "artifact_family", "max_abs_spearman", "median_abs_spearman", "n_qc_metrics", F.col("top.qc_variable").alias("strongest_qc_variable"), F.when(rho > 0, "positive").when(rho < 0, "negative").otherwise("zero").alias("strongest_direction"), worst_of([(F.col("max_abs_spearman") >= 0.5, "review"), (F.col("max_abs_spearman") >= 0.3, "monitor")], "context").alias("review_priority"))


def missingness_qc_association(long: DataFrame, qc_long: DataFrame) -> DataFrame:
    absent = long.withColumn("value", F.col("value").isNull().cast("double"))
    return cross_correlations(absent, _as_qc(qc_long), "feature", "qc_variable")


def outlier_qc_association(flags: DataFrame, qc_long: DataFrame) -> DataFrame:
    """Rank correlation of a row's number of outlier flags, 0 where it has none, with every quality metric."""
    counts = flags.groupBy("record_key").agg(F.count("*").alias("flags"))
    rows = qc_long.select("record_key").distinct().join(counts, "record_key", "left").select("record_key", F.lit("flags").alias("of"), F.coalesce("flags", F.lit(0)).alias("value"))
    return cross_correlations(rows, _as_qc(qc_long), "of", "qc_variable").drop("of")


def qc_integration_summary(qc_long: DataFrame, correlation: DataFrame, missing: DataFrame, outlier: DataFrame) -> DataFrame:
    """(metric, value) counts of associations at 0.30 and 0.50."""
    families = qc_long.select("feature").distinct().withColumn("f", qc_family_of(F.col("feature"))).groupBy("f").agg(F.count("*").alias("n"))
    known = families.agg(F.sum("n").alias("numeric_qc_metrics"), F.count_if(F.col("f") != "unclassified").alias("artifact_families_detected"))
    size = qc_long.agg(F.count_distinct("record_key").alias("qc_rows"))
    rows = [correlation.select("rho", F.lit("c").alias("of")), missing.select("rho", F.lit("m").alias("of")), outlier.select("rho", F.lit("o").alias("of"))]
    strong = lambda of, limit: F.count_if((F.col("of") == of) & (F.abs(F.col("rho")) >= limit))
    counts = rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(strong("c", 0.3).alias("feature_qc_pairs_abs_rho_ge_0_30"), strong("c", 0.5).alias("feature_qc_pairs_abs_rho_ge_0_50"), strong("m", 0.3).alias("missingness_qc_pairs_abs_rho_ge_0_30"), strong("o", 0.3).alias("row_outlier_qc_pairs_abs_rho_ge_0_30"))
    tall = [x.unpivot([], x.columns, "metric", "value") for x in (size, known, counts)]
    return tall[0].unionByName(tall[1]).unionByName(tall[2])


def reliability_screen(dist: DataFrame, correlation: DataFrame) -> DataFrame:
    """use, use_with_caution or exclude_or_review per feature, and why."""
    df = dist.join(correlation.groupBy("feature").agg(F.max(F.abs(F.col("rho"))).alias("qc")), "feature", "left")
    c = _checks({"zero": F.col("zero_variance"), "miss": F.col("missing_fraction") >= 0.5, "some_miss": F.col("missing_fraction") >= 0.2, "out": F.col("robust_outlier_fraction") >= 0.2, "qc": F.col("qc") >= 0.7, "some_qc": F.col("qc") >= 0.5})
    bad = c["zero"] | c["miss"]
    some_miss = c["some_miss"] & ~bad
    out = c["out"] & ~bad & ~some_miss
    some_qc = c["some_qc"] & ~c["qc"] & ~bad & ~some_miss & ~out
    reasons = [(c["zero"], "zero variance"), (c["miss"], "high missingness"), (some_miss, "moderate missingness"), (out, "many robust outliers"), (c["qc"], "strong QC association"), (some_qc, "moderate QC association")]
    label = worst_of([(bad | c["qc"], "exclude_or_review"), (some_miss | out | some_qc, "use_with_caution")], "use")
    return df.select("feature", label.alias("recommendation"), "missing_fraction", "robust_outlier_fraction", "zero_variance", F.col("qc").alias("max_abs_qc_spearman"), reason_list(reasons, "no major screening issue detected").alias("review_reason"))


# Metrics, directions and limits; the sentences are free.
QC_RULES = (
    ("additive_interference", "qadd_speech_pause_level_diff_db", "low", 10.0, "Speech is hardly louder than pauses, which may be told apart badly."),
    ("additive_interference", "qadd_pause_hum50_ratio", "high", 0.05, "Much energy at 50 Hz in pauses, perhaps mains hum."),
    ("additive_interference", "qadd_pause_hum60_ratio", "high", 0.05, "Much energy at 60 Hz in pauses, perhaps mains hum."),
    ("gain_dynamics", "qgain_speech_rms_db_std", "high", 6.0, "The level of speech varies much: gain or distance may have changed."),
    ("reverberation_echo", "qrev_post_offset_tail_db_above_floor", "high", 6.0, "Speech dies away slowly, perhaps in an echoing room."),
    ("nonlinear_distortion", "qdist_near_clipped_sample_fraction", "high", 0.01, "Loud frames come close to clipping."),
    ("temporal_discontinuity", "qtemp_waveform_continuity_break_score", "high", 0.02, "The waveform breaks off in places, perhaps by dropouts."),
)
# What a flagged family means for the features.
QC_ADVICE = {
    "additive_interference": "Check features that noise disturbs, of the spectrum, the voice and quiet passages; pauses may hold noise.",
    "gain_dynamics": "Be careful with levels and envelopes, and report how the gain varies with the results.",
    "reverberation_echo": "Be careful with pauses, their ends and energy, and with rhythm: long tails shift them.",
    "channel_device": "Be careful when comparing spectra and formants between microphones.",
    "nonlinear_distortion": "Be careful with levels, spectra and voice; try results without clipped files.",
    "temporal_discontinuity": "Be careful with timing and rhythm, and listen to files with gaps.",
}
MANY_RULES = 10_000
NO_ADVICE = "Look at these files before reading their features."
NOTHING_FOUND = "No metric is beyond its limit; plots and metadata still deserve a look."


def rules_table(df: DataFrame, rules: tuple[tuple, ...] = QC_RULES) -> DataFrame:
    """(family, feature, direction, threshold, warning): one row per rule, in the session of df."""
    return df.sparkSession.createDataFrame(list(rules), "family string, feature string, direction string, threshold double, warning string")


def qc_threshold_warnings(qc_long: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per value over a high or under a low threshold; strong_review over twice, or under half of it."""
    rules = rules_table(qc_long) if rules is None else rules
    few = rules.limit(MANY_RULES + 1).count() <= MANY_RULES
    met = qc_long.join(F.broadcast(rules) if few else rules, "feature")
    high, v, limit = F.col("direction") == "high", F.col("value"), F.col("threshold")
    strong = F.when(high, v > 2 * limit).otherwise(v < F.greatest(F.lit(0.0), limit / 2))
    return met.where(F.when(high, v > limit).otherwise(v < limit)).select("record_key", "family", "feature", "value", "threshold", "direction", "warning", F.when(strong, "strong_review").otherwise("review").alias("severity"))


def qc_recommendations(warnings: DataFrame, records: DataFrame) -> DataFrame:
    """Records flagged per family, their share and advice; one row `overall` where nothing was flagged, none without records."""
    n = records.agg(F.count("*").alias("n"))
    per = warnings.groupBy("family").agg(F.count_distinct("record_key").alias("n_records_flagged"))
    advice = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in QC_ADVICE.items() for x in kv]), F.col("family")), F.lit(NO_ADVICE))
    some = per.crossJoin(n).where("n > 0").select("family", "n_records_flagged", (F.col("n_records_flagged") / F.col("n")).alias("fraction_records_flagged"), advice.alias("recommendation"))  # n is one row
    none = n.crossJoin(warnings.agg(F.count("*").alias("w"))).where("n > 0 AND w = 0")
    return some.unionByName(none.select(F.lit("overall").alias("family"), F.lit(0).cast("bigint").alias("n_records_flagged"), F.lit(0.0).alias("fraction_records_flagged"), F.lit(NOTHING_FOUND).alias("recommendation")))


def qc_review_level(warnings: DataFrame, records: DataFrame) -> DataFrame:
    """Warnings, their families and the level of every record, those without any as well."""
    found = warnings.groupBy("record_key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ";").alias("f"))
    n = F.coalesce("n", F.lit(0))
    return records.select("record_key").join(found, "record_key", "left").select("record_key", n.alias("n_warnings"), F.coalesce("f", F.lit("")).alias("families"), worst_of([(n >= 2, "review"), (n == 1, "minor_review")], "no_threshold_warning").alias("review_level"))


def scaled_metrics(qc: DataFrame, key: str | list[str], metrics: list[str]) -> DataFrame:
    """(key..., metrics...): each metric of qc, which has a row per record, transformed where it is skewed, cut at its 1st and 99th percentile, and scaled to median and IQR.

    Metrics whose IQR is 1e-12 or less aren't scaled: their values are NULL. No shuffle but for the metrics' statistics.
    """
    keys = [key] if isinstance(key, str) else key
    own = qc.select(*keys, *[finite(F.col(c).cast("double")).alias(c) for c in metrics])
    valid = lambda df: long_form(df, keys, metrics).where("value IS NOT NULL")
    shape = {r["feature"]: r for r in valid(own).groupBy("feature").agg(adjusted_skewness("value").alias("skew"), F.min("value").alias("low"), F.count("*").alias("n")).collect()}  # one row per metric
    lit = lambda x: F.lit(x).cast("double")
    moved = own.select(*keys, *[log_transform(F.col(c), lit(shape[c]["skew"] or 0.0), lit(shape[c]["low"])).alias(c) if c in shape else F.col(c) for c in metrics])
    of = lambda df, qs: {r["feature"]: r["q"] for r in group_quantiles(valid(df), ["feature"], "value", qs).collect()}
    found = of(moved, [0.01, 0.25, 0.5, 0.75, 0.99])
    held = moved.select(*keys, *[winsorize(F.col(c), lit(found[c][0]), lit(found[c][4])).alias(c) if c in found else F.col(c) for c in metrics])
    # of five values and more, the cuts lie outside what the quartiles are made of
    middle = of(held, [0.25, 0.5, 0.75]) if any(r["n"] < 5 for r in shape.values()) else {c: q[1:4] for c, q in found.items()}
    iqr = {c: q[2] - q[0] for c, q in middle.items()}
    return held.select(*keys, *[((F.col(c) - lit(middle[c][1])) / lit(iqr[c])).alias(c) if iqr.get(c, 0.0) > 1e-12 else lit(None).alias(c) for c in metrics])


def _row_median(values: list[Column]) -> Column:
    """The median of a handful of values of one row, NULL ones left out."""
    x, n = F.sort_array(F.array(*values), asc=False), sum((c.isNotNull().cast("int") for c in values), F.lit(0))
    return 0.5 * F.get(x, F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get(x, F.floor(n / 2).cast("int"))


def qc_family_scores(scaled: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """scaled with the median of each family's metrics in place of its metrics; families has the metrics of each. No shuffle."""
    kept = [c for c in scaled.columns if not any(c in own for own in families.values())]
    return scaled.select(*kept, *[_row_median([F.col(c) for c in own]).alias(f) for f, own in families.items()])


def qc_family_rows(scaled: DataFrame, key: str, families: dict[str, list[str]]) -> DataFrame:
    """(key, family, n_features, score): the same, a row per record and family."""
    n = lambda own: sum((F.col(c).isNotNull().cast("bigint") for c in own), F.lit(0).cast("bigint"))
    return scaled.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("family"), n(own).alias("n_features"), _row_median([F.col(c) for c in own]).alias("score")) for f, own in families.items()])))


def qc_burden(scores: DataFrame, families: list[str]) -> DataFrame:
    """scores with `burden`, the median size of a record's family scores, in place of these. No shuffle."""
    kept = [c for c in scores.columns if c not in families]
    sizes = scores.select(*kept, *[F.abs(F.col(f)).alias(f) for f in families])
    return sizes.select(*kept, _row_median([F.col(f) for f in families]).alias("burden"))


def n_warnings(rules: tuple[tuple, ...] = QC_RULES) -> Column:
    """How many rules a record with a column for each metric breaks; as many as qc_threshold_warnings has rows for it."""
    broken = [F.coalesce(F.col(c) > limit if way == "high" else F.col(c) < limit, F.lit(False)) for _, c, way, limit, _ in rules]
    return sum((b.cast("int") for b in broken), F.lit(0)).cast("bigint")


def review_rank(levels: DataFrame, burden: DataFrame) -> DataFrame:
    """All records in order of review: by warnings, then by burden, unknown burdens last, then by key."""
    return ranked_for_review(levels.select("record_key", "n_warnings").join(burden, "record_key", "left"))


def ranked_for_review(rows: DataFrame) -> DataFrame:
    """The same of rows (record_key, n_warnings, burden)."""
    return global_rank(rows, [F.desc("n_warnings"), F.desc_nulls_last("burden"), F.asc("record_key")], "review_rank")


def distribution_summary_basic(long: DataFrame) -> DataFrame:
    """Fourteen statistics of each feature; outliers by 0.67448975 times the distance over the median deviation, none counted where that is 0."""
    base = long.groupBy("feature").agg(F.count("value").alias("n_valid"), (1 - F.count("value") / F.count("*")).alias("missing_fraction"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count_distinct("value").alias("_u"))
    base = base.join(group_quantiles(long, ["feature"], "value", [0.05, 0.25, 0.5, 0.75, 0.95]), "feature", "left")
    valid = long.where("value IS NOT NULL").join(base.select("feature", F.col("q")[2].alias("_med")), "feature").withColumn("_away", F.abs(F.col("value") - F.col("_med")))
    mad = group_quantiles(valid, ["feature"], "_away", [0.5]).select("feature", F.col("q")[0].alias("_mad"))
    # a missing value isn't over the limit, but counts among the rows
    out = valid.join(mad.where("_mad > 0"), "feature").groupBy("feature").agg(F.count_if(0.67448975 * F.col("_away") / F.col("_mad") > OUTLIER_Z).alias("_k"))
    rows = long.groupBy("feature").agg(F.count("*").alias("_rows"))
    met = base.join(out, "feature", "left").join(rows, "feature")
    q = [F.col("q")[k] for k in range(5)]
    return met.select("feature", "n_valid", "missing_fraction", "mean", q[2].alias("median"), "sd", (q[3] - q[1]).alias("iqr"), q[0].alias("q05"), q[1].alias("q25"), q[3].alias("q75"), q[4].alias("q95"), "min", "max", F.when(F.col("n_valid") > 0, F.coalesce("_k", F.lit(0)) / F.col("_rows")).alias("robust_outlier_fraction_abs_z_gt_3_5"), (F.col("_u") <= 1).alias("zero_variance"))


def registry_distribution_audit(long: DataFrame, registry: DataFrame) -> DataFrame:
    """Location, spread (over n) and quantiles of each feature, and values outside the registry's bounds."""
    base = long.groupBy("feature").agg(F.count("value").alias("n_available"), (1 - F.count("value") / F.count("*")).alias("missing_fraction"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    base = base.join(group_quantiles(long, ["feature"], "value", [0.05, 0.25, 0.5, 0.75, 0.95]), "feature", "left")
    flags = expected_range_flags(long, registry).select("feature", "expected_low", "expected_high", "n_below_expected", "n_above_expected")
    q = [F.col("q")[k] for k in range(5)]
    n = F.col("n_available")
    return with_family(base.join(flags, "feature", "left"), registry).select("feature", "family", "n_available", "missing_fraction", "mean", q[2].alias("median"), "sd", q[0].alias("q05"), q[1].alias("q25"), q[3].alias("q75"), q[4].alias("q95"), "expected_low", "expected_high", "n_below_expected", "n_above_expected", ((F.col("n_below_expected") + F.col("n_above_expected")) / F.when(n > 0, n)).alias("out_of_expected_fraction"))


def readiness_dimensions(by_feature: DataFrame, facts: DataFrame, n_features: int, n_numeric: int, qc: bool, metadata: float, design: int) -> DataFrame:
    """(dimension, score, status): seven scores from 0 to 100; facts has one row (n_rows), metadata is 100, 70, 35 or 0, design counts known group columns of five."""
    means = by_feature.agg(F.avg("missing_fraction").alias("miss")).join(F.broadcast(facts))  # one row each
    share = 100.0 * n_numeric / n_features if n_features else 0.0
    scores = [("Feature completeness", F.coalesce(100 * (1 - F.col("miss")), F.lit(0.0))), ("Numeric analyzability", F.lit(share)), ("Metadata context", F.lit(float(metadata))), ("QC context", F.lit(100.0 if qc else 0.0)), ("Design richness", F.lit(100.0 * design / 5)), ("Row depth", F.least(F.lit(100.0), 100.0 * F.col("n_rows") / 100)), ("Feature breadth", F.lit(min(100.0, 100.0 * n_numeric / 50)))]
    tall = means.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)).cast("double").alias("s")) for d, s in scores])))
    return tall.select("dimension", F.round("s", 1).alias("score"), worst_of([(F.col("s") >= 80, "strong"), (F.col("s") >= 50, "adequate"), (F.col("s") > 0, "limited")], "absent").alias("status"))
