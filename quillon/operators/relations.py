"""Redundancy, correlation modules and family structure of features, outcome screens, repeatability and recommendations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import finite, reason_list, relation_band, stability_band, strength_band
from quillon.functions.gram import column_names, column_rows, cross_correlations, matrix_of, moments, rank_correlations, row_correlations, table_rows
from quillon.functions.select import level_quantiles
from quillon.functions.shared import settled
from quillon.functions.stats import group_quantiles, long_form, quantiles
from quillon.operators.audit import with_family


def feature_correlation(long: DataFrame, min_n: int = 8) -> DataFrame:
    """Rank correlation of all pairs of features over the rows that have both, f1 before f2 by name; rho NULL below min_n rows."""
    return _feature_pairs(rank_correlations(long, column_names(long), column="feature"), min_n)


def _feature_pairs(found: DataFrame, min_n: int = 8) -> DataFrame:
    out = found.select(F.col("x").alias("feature_1"), F.col("y").alias("feature_2"), F.when(F.col("n") >= min_n, F.col("rho")).alias("rho"), F.col("n").alias("n_pairwise"))
    r = F.col("rho")
    return out.select("feature_1", "feature_2", r.alias("spearman_rho"), F.abs(r).alias("abs_spearman"), "n_pairwise", F.when(r >= 0, "positive").when(r < 0, "negative").otherwise("not_modelable").alias("direction"), relation_band(r).alias("relationship_strength"))


def _both_families(correlation: DataFrame, registry: DataFrame) -> DataFrame:
    return with_family(with_family(correlation, registry, "feature_1", "family_1"), registry, "feature_2", "family_2")


def redundant_pairs(correlation: DataFrame, registry: DataFrame, threshold: float = 0.80) -> DataFrame:
    found = _both_families(correlation.where(F.col("abs_spearman") >= threshold), registry)
    return found.select("feature_1", "feature_2", "spearman_rho", "abs_spearman", "n_pairwise", "family_1", "family_2", (F.col("family_1") == F.col("family_2")).alias("same_family"), F.when(F.col("abs_spearman") >= 0.90, "high").otherwise("moderate").alias("review_priority"))


def family_correlation(correlation: DataFrame, registry: DataFrame) -> DataFrame:
    found = _both_families(correlation.where("abs_spearman IS NOT NULL"), registry)
    return found.groupBy("family_1", "family_2").agg(F.avg("abs_spearman").alias("mean_abs_spearman"), F.get(quantiles("abs_spearman", [0.5]), F.lit(0)).alias("median_abs_spearman"), F.count("*").alias("n_pairs")).withColumn("relationship_type", F.when(F.col("family_1") == F.col("family_2"), "within_family").otherwise("between_family"))


def correlation_modules(correlation: DataFrame, registry: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Connected blocks of features with |rho| at or over the threshold, largest first; the representative has most links.

    Labels spread over the links, and over the links of labels, until none changes; a chain of n features takes some
    log2(n) steps. The table has a row per pair of features, whatever the number of rows behind the correlations.
    """
    correlation = settled(correlation)
    edges = correlation.where(F.col("abs_spearman") >= threshold).select("feature_1", "feature_2")
    both = settled(edges.union(edges.select("feature_2", "feature_1")).toDF("a", "b"))
    labels = settled(both.select(F.col("a").alias("feature")).distinct().withColumn("module", F.col("feature")))
    changed = True
    while changed:
        near = both.join(labels.select(F.col("feature").alias("b"), "module"), "b").groupBy("a").agg(F.min("module").alias("low"))
        lower = labels.join(near, F.col("feature") == F.col("a")).select("feature", "module", F.least("module", "low").alias("low"))
        # a label takes over the label of the feature it names
        jump = labels.select(F.col("feature").alias("low"), F.col("module").alias("lowest"))
        moved = settled(lower.join(jump, "low").select("feature", F.least("low", "lowest").alias("module"), (F.least("low", "lowest") < F.col("module")).alias("changed")))
        labels, changed = moved.select("feature", "module"), not moved.where("changed").isEmpty()
    degree = both.groupBy(F.col("a").alias("feature")).agg(F.count("*").alias("links"))
    inside = correlation.join(labels.toDF("feature_1", "m1"), "feature_1").join(labels.toDF("feature_2", "m2"), "feature_2").where("m1 = m2").groupBy(F.col("m1").alias("module")).agg(F.avg("abs_spearman").alias("mean_abs_spearman"), F.max("abs_spearman").alias("max_abs_spearman"))
    members = with_family(labels.join(degree, "feature"), registry).groupBy("module").agg(F.count("*").alias("n_features"), F.min(F.struct((-F.col("links")).alias("links"), "feature")).getField("feature").alias("representative_feature"), F.array_join(F.array_sort(F.collect_set("family")), "; ").alias("families"), F.array_join(F.array_sort(F.collect_set("feature")), "; ").alias("features"))
    number = F.row_number().over(Window.orderBy(F.desc("n_features"), "module"))
    return members.join(inside, "module").withColumn("module_id", F.format_string("M%02d", number)).drop("module")


def relationship_summary(correlation: DataFrame, modules: DataFrame, variance: DataFrame | None = None) -> DataFrame:
    """(metric, value): pairs by strength, modules and, from pca()'s variance table, percent of the first and the first three components."""
    pairs = correlation.agg(F.count("*").alias("feature_pairs_evaluated"), *[F.count_if(F.col("abs_spearman") >= t).alias(f"{name}pairs_abs_rho_ge_{t:.2f}".replace(".", "_")) for name, t in (("", 0.6), ("redundant_", 0.8), ("near_duplicate_", 0.9))])
    parts = [pairs, modules.agg(F.count("*").alias("correlation_modules_abs_rho_ge_0_70"))]
    if variance is not None:
        parts.append(variance.agg(F.round(100 * F.max(F.when(F.col("component") == 1, F.col("explained"))), 2).alias("pc1_variance_percent"), F.round(100 * F.sum(F.when(F.col("component") <= 3, F.col("explained"))), 2).alias("pc1_pc3_cumulative_percent")))
    rows = [p.select(*[F.col(c).cast("double").alias(c) for c in p.columns]).unpivot([], p.columns, "metric", "value") for p in parts]
    return reduce(DataFrame.unionByName, rows)


def continuous_screen(long: DataFrame, outcomes_long: DataFrame) -> DataFrame:
    """Rank correlation of every feature with every outcome (record_key, outcome_variable, y): 8 rows and 3 distinct values at least."""
    return _outcome_pairs(cross_correlations(long, outcomes_long.withColumnRenamed("y", "value"), "feature", "outcome_variable", min_n=8, min_distinct=3))


def _outcome_pairs(found: DataFrame) -> DataFrame:
    r = F.col("rho")
    return found.select("outcome_variable", "feature", r.alias("effect"), F.abs(r).alias("abs_effect"), F.when(r > 0, "positive").when(r < 0, "negative").otherwise("none").alias("direction"), F.col("n").alias("n_pairwise"), strength_band(r).alias("screening_strength"))


def group_screen(long: DataFrame, groups_long: DataFrame, max_levels: int = 8) -> DataFrame:
    """Contrast of the medians of groups (record_key, group_variable, level), over the pooled IQR, or SD where that is 0.

    Two levels: the larger group's median less the other's, and Cliff's delta from average ranks, exact for any size.
    Three to max_levels: highest less lowest median. Groups of the same size are ordered by name; every level needs 3 rows.
    """
    known = groups_long.where("level IS NOT NULL")
    # max_levels rows a variable at most; joined by a shuffle, all rows of a level would meet in one task
    levels = F.broadcast(settled(_levels(known, max_levels)))
    placed = known.join(levels, ["group_variable", "level"])
    values = long.select("record_key", F.concat(F.lit("f"), "feature").alias("column"), "value")
    numbers = placed.select("record_key", F.concat(F.lit("g"), "group_variable").alias("column"), (F.col("n_levels") - F.col("place")).cast("double").alias("value"))
    told = levels.collect()  # max_levels a variable
    names, sides = column_names(values, "column"), sorted({"g" + r["group_variable"] for r in told})
    if not names or not sides:
        return _contrasts(None, [], [], rank_correlations(values, []))
    rows = column_rows(values.unionByName(numbers), [*names, *sides])
    return _contrasts(rows, [c[1:] for c in names], told, row_correlations(rows, [*names, *sides], names, sides))


def _levels(known: DataFrame, max_levels: int) -> DataFrame:
    """(group_variable, level, size, place, n_levels) of (group_variable, level), larger levels first; variables of one level or more than max_levels are left out."""
    sizes = known.groupBy("group_variable", "level").agg(F.count("*").alias("size"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy("group_variable").orderBy(F.desc("size"), "level"))).withColumn("n_levels", F.count("*").over(Window.partitionBy("group_variable"))).where(F.col("n_levels").between(2, max_levels))


def _contrasts(rows: DataFrame | None, features: list[str], levels: list, ranks: DataFrame) -> DataFrame:
    """The table of group_screen() from rows of the features and, for each variable by name, the number of a row's level: the largest level has the highest.

    ranks are the correlations of features (f...) with these numbers (g...). What is put together here has a row per feature and level.
    """
    spark, key = ranks.sparkSession, ["group_variable", "feature"]
    variables = sorted({r["group_variable"] for r in levels})
    of = {v: sorted((r for r in levels if r["group_variable"] == v), key=lambda r: -r["place"]) for v in variables}
    each = [r for v in variables for r in of[v]]
    found = level_quantiles(rows, len(features), [len(of[v]) for v in variables], [0.5], [0.25, 0.75]) if each and features else {}
    middle = {(k, j - len(each)): q for (k, j), (_, q) in found.items() if j >= len(each)}
    # the spread about the quartiles, where they are equal
    flat = [(k, c) for (k, c), q in middle.items() if q[0] == q[1]]
    sd = {}
    if flat:

        def product(block: np.ndarray) -> np.ndarray:
            away = [block[~np.isnan(block[:, len(features) + c]), k] - middle[k, c][0] for k, c in flat]
            return np.stack([[np.nansum(x), np.nansum(x**2)] for x in away])

        sums = matrix_of(rows, len(features) + len(variables), product)
        for (k, c), (one, two) in zip(flat, sums, strict=True):
            n = found[k, c + len(each)][0]
            sd[k, c] = float(np.sqrt(max(two - one**2 / n, 0.0) / (n - 1))) if n > 1 else None
    per = spark.createDataFrame([(each[j]["group_variable"], features[k], each[j]["level"], each[j]["place"], each[j]["n_levels"], n, q[0]) for (k, j), (n, q) in found.items() if j < len(each)], "group_variable string, feature string, level string, place int, n_levels bigint, m bigint, med double")
    pooled = spark.createDataFrame([(variables[c], features[k], found[k, c + len(each)][0], q, sd.get((k, c))) for (k, c), q in middle.items()], "group_variable string, feature string, n bigint, q array<double>, sd double")
    by = per.groupBy(*key, "n_levels").agg(F.min("m").alias("least"), F.max(F.when(F.col("place") == 1, F.struct("level", "med", "m"))).alias("a"), F.max(F.when(F.col("place") == 2, F.struct("level", "med", "m"))).alias("b"), F.max(F.struct("med", "level")).alias("top"), F.min(F.struct("med", "level")).alias("low"))
    # the ranks of two groups are half their rows apart, so the product with them tells the rank sum of one
    ranks = ranks.select(F.expr("substring(x, 2)").alias("feature"), F.expr("substring(y, 2)").alias("group_variable"), (4 * F.col("sxy") / F.col("n")).alias("share"), F.col("levels_x").alias("distinct"))
    df = by.join(pooled, key).join(ranks, key).where("least >= 3 AND n >= 8 AND distinct >= 3")
    iqr = F.get("q", F.lit(1)) - F.get("q", F.lit(0))
    scale = F.when(iqr > 0, iqr).when(F.col("sd") > 0, F.col("sd"))
    two = F.col("n_levels") == 2
    effect = F.when(two, F.col("a.med") - F.col("b.med")).otherwise(F.col("top.med") - F.col("low.med")) / scale
    one, other = F.when(two, F.col("a.level")).otherwise(F.col("top.level")), F.when(two, F.col("b.level")).otherwise(F.col("low.level"))
    return df.select(*key, effect.alias("effect"), F.abs(effect).alias("abs_effect"), F.when(effect > 0, F.concat(F.lit("higher_in_"), one)).when(effect < 0, F.concat(F.lit("higher_in_"), other)).otherwise("none").alias("direction"), F.col("n").alias("n_pairwise"), "n_levels", one.alias("level_1"), other.alias("level_2"), F.when(two, F.col("share") / (F.col("a.m") * F.col("b.m"))).alias("cliffs_delta"), strength_band(effect).alias("screening_strength"))


class TableScreens:
    """The rank correlations and contrasts of a written table with a number in each row (gram.numbered), from one pass of ranks.

    features, outcomes and metrics are numeric columns, groups columns whose levels are compared. The results are those of
    feature_correlation, continuous_screen, audit.feature_qc_correlation and group_screen over the same rows in long form.
    """

    def __init__(self, table: DataFrame, features: list[str], outcomes: list[str] = (), metrics: list[str] = (), groups: list[str] = (), max_levels: int = 8):
        self.features = sorted(features)
        known = table.select(*[F.col(c).cast("string").alias(c) for c in groups]).unpivot([], [*groups], "group_variable", "level").where("level IS NOT NULL") if groups else None
        self.levels = _levels(known, max_levels).collect() if groups else []  # max_levels a variable
        numbers = {v: reduce(lambda c, r: c.when(F.col(v).cast("string") == r["level"], float(r["n_levels"] - r["place"])), (r for r in self.levels if r["group_variable"] == v), F) for v in sorted({r["group_variable"] for r in self.levels})}
        table = table.withColumns({f"_g{c}": numbers[v] for c, v in enumerate(numbers)}) if numbers else table
        placed = [f"_g{c}" for c in range(len(numbers))]
        names = [*("f" + c for c in self.features), *("o" + c for c in outcomes), *("q" + c for c in metrics), *("g" + v for v in numbers)]
        self.rows = table_rows(table, [*self.features, *placed])
        self.found = row_correlations(table_rows(table, [*self.features, *outcomes, *metrics, *placed]), names)

    def _pairs(self, side: str, x: str, y: str, min_n: int, min_distinct: int) -> DataFrame:
        kept = self.found.where(F.col("x").startswith("f") & F.col("y").startswith(side) & (F.col("n") >= min_n) & (F.col("levels_x") >= min_distinct) & (F.col("levels_y") >= min_distinct))
        return kept.select(F.expr("substring(x, 2)").alias(x), F.expr("substring(y, 2)").alias(y), "n", "rho")

    def feature_correlation(self, min_n: int = 8) -> DataFrame:
        pairs = self.found.where(F.col("x").startswith("f") & F.col("y").startswith("f"))
        return _feature_pairs(pairs.withColumns({c: F.expr(f"substring({c}, 2)") for c in ("x", "y")}), min_n)

    def continuous_screen(self) -> DataFrame:
        return _outcome_pairs(self._pairs("o", "feature", "outcome_variable", 8, 3))

    def qc_correlation(self, min_n: int = 4) -> DataFrame:
        return self._pairs("q", "feature", "qc_variable", min_n, 2)

    def group_screen(self) -> DataFrame:
        return _contrasts(self.rows, self.features, self.levels, self.found.where(F.col("x").startswith("f") & F.col("y").startswith("g")))


def group_balance(groups_long: DataFrame) -> DataFrame:
    counts = groups_long.where("level IS NOT NULL").groupBy("group_variable", "level").agg(F.count("*").alias("n_rows"))
    return counts.select("group_variable", "level", "n_rows", (F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("group_variable"))).alias("proportion"), F.when(F.col("n_rows") < 10, "small_level").otherwise("ok").alias("imbalance_note"))


def screening_priority(continuous: DataFrame, groups: DataFrame) -> DataFrame:
    """Both screens as one table."""
    return continuous.select("feature", F.col("outcome_variable").alias("screened_against"), F.lit("continuous").alias("screen"), "abs_effect", "n_pairwise").unionByName(groups.select("feature", F.col("group_variable").alias("screened_against"), F.lit("group").alias("screen"), "abs_effect", "n_pairwise"))


def repeatability(units_long: DataFrame, registry: DataFrame, min_units: int = 3, min_values: int = 6) -> DataFrame:
    """Variance between units (unit, feature, value) over that and the mean variance within, of units with two values or more.

    Rows without a unit take no part in the variances but in the share of missing values.
    """
    shares = units_long.groupBy("feature").agg((1 - F.count("value") / F.count("*")).alias("missing_fraction"))
    per = settled(units_long.where("unit IS NOT NULL AND value IS NOT NULL").groupBy("feature", "unit").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"), (F.max("value") - F.min("value")).alias("range")))
    return _repeated(shares, per, registry, min_units, min_values)


def table_repeatability(table: DataFrame, unit: str, features: list[str], registry: DataFrame, min_units: int = 3, min_values: int = 6) -> DataFrame:
    """repeatability() of the columns of a wide table: a unit's rows are shuffled as they are, and make one row."""
    x = {c: finite(F.col(c).cast("double")) for c in features}
    shares = table.agg(F.array(*[F.struct(F.lit(c).alias("feature"), (1 - F.try_divide(F.count(v), F.count("*"))).alias("missing_fraction")) for c, v in x.items()]).alias("_e"), F.count("*").alias("_n")).where("_n > 0").select(F.inline("_e"))
    rows = table.where(F.col(unit).isNotNull()).select(F.col(unit).alias("unit"), *[v.alias(f"_x{k}") for k, v in enumerate(x.values())]).repartition("unit")
    of = lambda c: F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("var"), (F.max(c) - F.min(c)).alias("range"))
    units = rows.groupBy("unit").agg(*[of(f"_x{k}").alias(f"_e{k}") for k in range(len(features))])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_e{k}").alias("e")) for k, c in enumerate(features)])
    per = settled(units.select("unit", F.inline(each)).where("e.n > 0").select("feature", "unit", "e.*"))
    return _repeated(shares, per, registry, min_units, min_values)


def _repeated(shares: DataFrame, per: DataFrame, registry: DataFrame, min_units: int, min_values: int) -> DataFrame:
    again = F.col("n") >= 2
    found = per.groupBy("feature").agg(F.sum("n").alias("n_valid"), F.count("*").alias("n_subjects"), F.count_if(again).alias("n_repeated_subjects"), F.avg(F.when(again, F.col("var"))).alias("within"), F.var_samp(F.when(again, F.col("mean"))).alias("between")).join(group_quantiles(per.where(again), ["feature"], "range", [0.5]).select("feature", F.col("q")[0].alias("range")), "feature", "left")
    enough = (F.col("n_repeated_subjects") >= min_units) & (F.col("n_valid") >= min_values)
    icc = F.when(enough & (F.col("between") + F.col("within") > 0), F.col("between") / (F.col("between") + F.col("within")))
    out = shares.join(found, "feature", "left").select("feature", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.coalesce("n_subjects", F.lit(0)).alias("n_subjects"), F.coalesce("n_repeated_subjects", F.lit(0)).alias("n_repeated_subjects"), icc.alias("icc1_proxy"), F.when(enough, F.col("within")).alias("within_subject_variance"), F.when(enough, F.col("between")).alias("between_subject_variance"), F.when(enough, F.col("range")).alias("median_within_subject_range"), "missing_fraction")
    return with_family(out, registry).withColumn("reliability_status", stability_band(F.col("icc1_proxy")))


def mdc95(repeat: DataFrame, dist: DataFrame) -> DataFrame:
    """The smallest detectable change, 1.96 sqrt(2) times the standard error within units, over the total SD."""
    return repeat.join(dist.select("feature", "sd"), "feature").select("feature", (1.96 * F.sqrt(F.lit(2.0)) * F.sqrt("within_subject_variance") / F.when(F.col("sd") > 0, F.col("sd"))).alias("mdc95_standardized"))


def repeatability_by_family(repeat: DataFrame) -> DataFrame:
    return repeat.groupBy("family").agg(F.count("*").alias("n_features"), F.get(quantiles("icc1_proxy", [0.5]), F.lit(0)).alias("median_icc1_proxy"), F.count_if(F.col("reliability_status") == "stable").alias("n_stable"), F.count_if(F.col("reliability_status").isin("variable", "unstable")).alias("n_unstable_or_variable"))


def recommendations(dist: DataFrame, shape: DataFrame, qc_correlation: DataFrame, redundant: DataFrame, repeat: DataFrame, screens: DataFrame, registry: DataFrame) -> DataFrame:
    """A readiness score from 100 down by every screen's findings, its label, the reasons, and whether to export by default.

    Penalties are one table of conditions, points and reasons; the score is their sum, kept in 0 to 100.
    """
    links = redundant.select(F.explode(F.array("feature_1", "feature_2")).alias("feature"), "abs_spearman").groupBy("feature").agg(F.max("abs_spearman").alias("red"), F.count("*").alias("redundant_pair_count"))
    df = (
        dist.select("feature", "n", "missing_fraction", "robust_outlier_fraction", "zero_variance", "near_zero_variance")
        .join(shape.select("feature", F.col("priority").alias("shape_priority")), "feature", "left")
        .join(qc_correlation.groupBy("feature").agg(F.max(F.abs(F.col("rho"))).alias("qc")), "feature", "left")
        .join(links, "feature", "left")
        .join(repeat.select("feature", "icc1_proxy", "reliability_status"), "feature", "left")
        .join(screens.groupBy("feature").agg(F.max("abs_effect").alias("max_screening_effect")), "feature", "left")
    )
    df = with_family(df, registry).withColumn("reliability_status", F.coalesce("reliability_status", F.lit("not_evaluable")))
    miss, out, qc, red, status, shape_ = (F.col(c) for c in ("missing_fraction", "robust_outlier_fraction", "qc", "red", "reliability_status", "shape_priority"))
    # Conditions, points and the names of reasons.
    rules = [
        (F.col("n") < 10, 30, "very small valid n", "too few values: look at the data behind it first"),
        (F.col("zero_variance"), 55, "zero variance", "leave out, or keep for the record alone"),
        (F.col("near_zero_variance") & ~F.col("zero_variance"), 20, "near-zero variance", "keep an eye on it: it says little here"),
        (miss >= 0.8, 45, "extreme missingness", "leave out or compute again, unless the question needs it"),
        ((miss >= 0.5) & (miss < 0.8), 30, "high missingness", "find out why values are missing"),
        ((miss >= 0.2) & (miss < 0.5), 12, "moderate missingness", "keep, and try results with and without the gaps"),
        (out >= 0.2, 20, "high robust outlier burden", "look at the extreme rows and their quality metrics"),
        ((out >= 0.08) & (out < 0.2), 8, "moderate outlier burden", "watch the tails"),
        (shape_ == "review", 18, "distribution shape review", None),
        (shape_ == "monitor", 8, "distribution shape monitor", None),
        (qc >= 0.7, 30, "strong QC association", "read only with quality as a covariate"),
        ((qc >= 0.5) & (qc < 0.7), 18, "moderate QC association", "export with a note on quality"),
        ((qc >= 0.3) & (qc < 0.5), 7, "weak/moderate QC association", None),
        (red >= 0.9, 10, "near-duplicate redundancy", "one feature of its block may be enough for a model"),
        ((red >= 0.8) & (red < 0.9), 5, "strong redundancy", None),
        (status == "unstable", 18, "unstable repeatability", "no statements on change without a look at repeatability"),
        (status == "variable", 10, "variable repeatability", "no statements on change without a look at repeatability"),
        (status == "not_evaluable", 4, "repeatability not evaluable", None),
    ]
    no_action = "ready for export, with preprocessing fitted on training rows only"
    rules = [(F.coalesce(c, F.lit(False)), p, why, do) for c, p, why, do in rules]
    score = F.greatest(F.lit(0), F.least(F.lit(100), sum((-F.when(c, p).otherwise(0) for c, p, _, _ in rules), F.lit(100))))
    never = F.col("zero_variance") | (F.col("n") < 5) | F.coalesce(miss >= 0.8, F.lit(False))
    s = F.col("readiness_score")
    label = F.when(never, "exclude_by_default").when(s >= 80, "recommended").when(s >= 60, "recommended_with_caution").when(s >= 40, "review_before_use").otherwise("exclude_or_recompute")
    return (
        df.withColumn("readiness_score", score)
        .withColumn("readiness_recommendation", label)
        .withColumn("ml_export_default", F.col("readiness_recommendation").isin("recommended", "recommended_with_caution"))
        .withColumn("primary_reasons", reason_list([(c, why) for c, _, why, _ in rules], "no major review flags detected"))
        .withColumn("recommended_action", reason_list([(c, do) for c, _, _, do in rules if do], no_action))
        .select("feature", "family", "readiness_recommendation", "readiness_score", "primary_reasons", "recommended_action", "ml_export_default", "missing_fraction", "robust_outlier_fraction", F.col("qc").alias("max_abs_qc_spearman"), F.col("red").alias("max_abs_redundancy"), F.coalesce("redundant_pair_count", F.lit(0)).alias("redundant_pair_count"), "icc1_proxy", "reliability_status", "max_screening_effect", "shape_priority")
    )


def recommendation_rollups(recommended: DataFrame) -> DataFrame:
    """(kind, label, n): features per decision, reason and family."""
    decisions = recommended.groupBy(F.col("readiness_recommendation").alias("label")).agg(F.count("*").alias("n")).select(F.lit("decision").alias("kind"), "label", "n")
    reasons = recommended.select(F.explode(F.split("primary_reasons", "; ")).alias("label")).groupBy("label").agg(F.count("*").alias("n")).select(F.lit("reason").alias("kind"), "label", "n")
    families = recommended.where("ml_export_default").groupBy(F.col("family").alias("label")).agg(F.count("*").alias("n")).select(F.lit("export_family").alias("kind"), "label", "n")
    return decisions.unionByName(reasons).unionByName(families)


def reliability_design(df: DataFrame, subject: str, session: str, task: str) -> DataFrame:
    """Records, sessions and tasks of each subject, and whether it can show repeatability."""
    found = df.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.count("*").alias("n_records"), F.count_distinct(session).alias("n_sessions"), F.count_distinct(task).alias("n_tasks"))
    return found.withColumn("repeated", F.col("n_records") >= 2)


def longitudinal_readiness(df: DataFrame, subject: str, task: str, session: str, date: str) -> DataFrame:
    """Records, sessions, dates and days of each subject and task, in bands of depth and span."""
    found = df.where(F.col(subject).isNotNull() & F.col(task).isNotNull()).groupBy(subject, task).agg(F.count("*").alias("n_records"), F.count_distinct(session).alias("n_sessions"), F.count_distinct(date).alias("n_dates"), F.datediff(F.max(date), F.min(date)).alias("span_days"))
    depth = F.when(F.col("n_records") >= 5, "5+").when(F.col("n_records") >= 3, "3-4").when(F.col("n_records") == 2, "2").otherwise("1")
    span = F.when(F.col("span_days").isNull(), "unknown").when(F.col("span_days") == 0, "same day").when(F.col("span_days") < 30, "under a month").when(F.col("span_days") < 365, "under a year").otherwise("a year or more")
    return found.withColumn("depth_band", depth).withColumn("span_band", span)


def pca(df: DataFrame, key: str, features: list[str], components: int = 5, plain: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variance, loadings, scores) of median-imputed features scaled by IQR, or SD where that is 0 (plain: by the SD over n after filling, from the mean); constant ones are left out.

    One pass adds up the products of all features as matrices, block by block of rows; quantiles come from group_quantiles.
    Eigenvectors of that matrix, features squared of them, are found on the driver, and scores in the tasks. Of each component
    the largest loading, the first by name if several, is positive.
    """
    spark = df.sparkSession
    values = settled(df.select(F.col(key), F.array(*[finite(F.col(c).cast("double")) for c in features]).alias("v")))
    long = values.select(F.posexplode("v").alias("feature", "value")).where("value IS NOT NULL")
    found = long.groupBy("feature").agg(F.stddev_samp("value").alias("sd")).join(group_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75]), "feature").collect()  # one row per feature
    known = {r["feature"]: (r["q"], r["sd"]) for r in found}
    middle = np.array([known[k][0][1] if k in known else 0.0 for k in range(len(features))])
    sums = moments(values.select("v"), middle.tolist())
    n, mean, total = sums[0, 0], sums[0, 1:], sums[1:, 1:]
    cov = total - np.outer(mean, mean) / max(n, 1)
    scale = np.zeros(len(features))
    for k, (q, sd) in known.items():
        scale[k] = np.sqrt(max(cov[k, k], 0.0) / n) if plain else (q[2] - q[0]) or sd or 0.0
    # rounding alone must not make a constant feature vary
    flat = np.array([k not in known or cov[k, k] <= 1e-12 * total[k, k] for k in range(len(features))])
    used = [k for k in sorted(range(len(features)), key=lambda k: features[k]) if scale[k] > 0 and not (plain and flat[k])]
    cov = cov[np.ix_(used, used)] / max(n - 1, 1) / np.outer(scale[used], scale[used])
    eigen, vectors = np.linalg.eigh(cov)
    order = np.argsort(eigen)[::-1][:components]
    top = vectors[:, order]
    top = top * np.sign(top[np.abs(top).round(12).argmax(0), np.arange(top.shape[1])])
    variance = spark.createDataFrame([(k + 1, float(eigen[o]), float(eigen[o] / eigen.sum())) for k, o in enumerate(order)], "component int, eigenvalue double, explained double")
    loadings = spark.createDataFrame([(k + 1, features[c], float(top[i, k])) for k in range(top.shape[1]) for i, c in enumerate(used)], "component int, feature string, loading double")
    shown, width, centre = min(3, top.shape[1]), len(features), (mean / max(n, 1))[used]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), width)
            z = (np.where(np.isnan(v), middle, v) - middle)[:, used]
            out = ((z - centre) / scale[used]) @ top[:, :shown]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(shown))], names=[key, *(f"pc{k + 1}" for k in range(shown))])

    kind = values.schema[key].dataType.simpleString()
    scores = values.mapInArrow(project, ", ".join([f"`{key}` {kind}", *(f"pc{k + 1} double" for k in range(shown))]))
    return variance, loadings, scores


def loading_rank(loadings: DataFrame, top: int = 20) -> DataFrame:
    """The `top` largest loadings of each component by size, ties by name."""
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature"))  # one row per feature
    return loadings.withColumn("place", place).where(F.col("place") <= top)


def screening_summary(catalog: DataFrame, continuous: DataFrame, groups: DataFrame) -> DataFrame:
    """(metric, value): variables, screens of each kind, and effects of 0.30 and more."""
    parts = [
        catalog.agg(F.count("*").alias("screening_variables_detected")), continuous.agg(F.count("*").alias("continuous_feature_outcome_tests"), F.count_if(F.col("abs_effect") >= 0.3).alias("continuous_abs_effect_ge_0_30")),
        groups.agg(F.count("*").alias("categorical_group_feature_tests"), F.count_if(F.col("abs_effect") >= 0.3).alias("group_abs_effect_ge_0_30")),
    ]
    return reduce(DataFrame.unionByName, [p.unpivot([], p.columns, "metric", "value") for p in parts])


def task_feature_profile(long: DataFrame, tasks: DataFrame, task: str | None = None) -> DataFrame:
    """(feature, effect, abs_effect, task_median, other_median): one task's median against the rest, or the range of the tasks' medians, in SDs over n.

    tasks has (record_key, task). One task and the rest need three values each; the range needs six values and two tasks.
    """
    rows = long.where("value IS NOT NULL").join(tasks.where("task IS NOT NULL"), "record_key")
    spread_ = rows.groupBy("feature").agg(F.stddev_pop("value").alias("_sd"), F.count("*").alias("_n"))
    if task is None:
        per = group_quantiles(rows, ["feature", "task"], "value", [0.5]).groupBy("feature").agg(F.max(F.col("q")[0]).alias("task_median"), F.min(F.col("q")[0]).alias("other_median"), F.count("*").alias("_tasks"))
        met = per.join(spread_, "feature").where("_tasks >= 2 AND _n >= 6 AND _sd > 0")
    else:
        side = rows.withColumn("_in", F.col("task") == task)
        sizes = side.groupBy("feature").agg(F.count_if("_in").alias("_a"), F.count_if(~F.col("_in")).alias("_b"))
        per = group_quantiles(side, ["feature", "_in"], "value", [0.5]).groupBy("feature").agg(F.max(F.when(F.col("_in"), F.col("q")[0])).alias("task_median"), F.max(F.when(~F.col("_in"), F.col("q")[0])).alias("other_median"))
        met = per.join(sizes, "feature").join(spread_, "feature").where("_a >= 3 AND _b >= 3 AND _sd > 0")
    return met.select("feature", ((F.col("task_median") - F.col("other_median")) / F.col("_sd")).alias("effect"), F.abs((F.col("task_median") - F.col("other_median")) / F.col("_sd")).alias("abs_effect"), "task_median", "other_median")


def exemplar_subjects(long: DataFrame, subjects: DataFrame, feature: str, top: int = 45) -> DataFrame:
    """(subject_id, n): the `top` subjects with most values, two at least, of a feature, ties by name; subjects has (record_key, subject_id)."""
    counts = long.where((F.col("feature") == feature) & F.col("value").isNotNull()).join(subjects.where("subject_id IS NOT NULL"), "record_key").groupBy("subject_id").agg(F.count("*").alias("n"))
    return counts.where("n >= 2").orderBy(F.desc("n"), "subject_id").limit(top)


def sorted_report(df: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """df in a report's fixed order: (column, descending) pairs, missing values last."""
    return df.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order])
