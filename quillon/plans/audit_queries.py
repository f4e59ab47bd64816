"""Queries of the audit and relation operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.gram import numbered
from quillon.functions.shared import settled
from quillon.functions.stats import long_form
from quillon.operators import audit, relations
from quillon.plans.views import FEATURES, QC_METRICS, oracle, view

DESIGN = ["task", "diagnosis", "device", "session_id"]
QUERIES, ORACLE_SQL = {}, {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and counts as BIGINT, as both engines report them."""
    to = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "int": lambda c: c.cast("bigint"), "decimal": lambda c: c.cast("double")}
    return df.select(*[next((f(F.col(c)) for k, f in to.items() if t.startswith(k)), F.col(c)).alias(c) for c, t in df.dtypes])


class Reader:
    """Gives views and tables by name; `once` gives one that several parts of a query share, computed a single time."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir, self.kept = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        return self.kept[name] if name in self.kept else view(self.spark, self.sf_dir, name)

    def once(self, name: str) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = settled(self(name))
        return self.kept[name]

    def table(self, qc: bool = False) -> DataFrame:
        """The recordings, with their quality metrics if these are asked for, written once with a number in each row."""
        rows = self("recordings")
        columns, made = rows.columns, numbered(rows.join(self("qc"), "record_key", "left") if qc else rows)
        self.kept["recordings"] = made.select(columns)
        return made


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a function (read) -> DataFrame, where read(name) gives a view or table."""

    def add(f):
        def run(spark, sf_dir):
            return rounded(f(Reader(spark, sf_dir)), digits)

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


def features_long(read, once: bool = True) -> DataFrame:
    return long_form(read.once("recordings") if once else read("recordings"), "record_key", FEATURES)


def qc_long(read, once: bool = True) -> DataFrame:
    return long_form(read.once("qc") if once else read("qc"), "record_key", QC_METRICS)


def _unpivot(view_: str, keys: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {view_}" for c in cols)


LONG = f"lf AS ({_unpivot('recordings', 'record_key', FEATURES)})"
QLONG = f"qf AS ({_unpivot('qc', 'record_key', QC_METRICS)})"
FAMILY = "coalesce(g.family, 'unclassified')"
BAND = "CASE WHEN {0} >= 0.8 THEN 'high_review' WHEN {0} >= 0.5 THEN 'review' WHEN {0} >= 0.2 THEN 'monitor' WHEN {0} IS NOT NULL THEN 'low' END"
MISSING = f"""ms AS (SELECT f.feature, {FAMILY} AS family, count(*) AS n_rows, count(value) AS n_valid, count(DISTINCT value) AS n_unique_valid, count(*) - count(value) AS n_missing, (count(*) - count(value))::DOUBLE / count(*)::DOUBLE AS missing_fraction FROM lf f LEFT JOIN registry g ON g.feature = f.feature GROUP BY ALL)"""
SHARE = "(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FEATURES) + ")"


@query("q01_missingness_by_feature", f"WITH {LONG}, {MISSING} SELECT feature, n_rows, n_valid, n_unique_valid, n_missing, round(missing_fraction, 6) AS missing_fraction, family, {BAND.format('missing_fraction')} AS missingness_status FROM ms")
def _(read):
    return audit.missingness_by_feature(features_long(read, False), read("registry"))


@query("q02_missingness_by_row", f"""SELECT record_key, round({SHARE}::DOUBLE / 17e0, 6) AS missing_fraction_all_columns, round({SHARE}::DOUBLE / 9e0, 6) AS missing_fraction_feature_columns, {SHARE}::BIGINT AS n_missing_features, (9 - {SHARE})::BIGINT AS n_valid_features, {BAND.format(f"({SHARE}::DOUBLE / 9e0)")} AS row_missingness_status FROM recordings""")
def _(read):
    return audit.missingness_by_row(read("recordings"), "record_key", FEATURES)


@query("q03_missingness_by_group", f"""WITH r AS (SELECT *, {SHARE}::DOUBLE / 9e0 AS s FROM recordings), u AS ({' UNION ALL '.join(f"SELECT '{d}' AS group_variable, {d} AS level, s FROM r" for d in DESIGN)})
SELECT group_variable, level, count(*) AS n_rows, round(avg(s), 6) AS mean_feature_missing_fraction, round(quantile_cont(s, 0.5), 6) AS median_feature_missing_fraction, round(quantile_cont(s, 0.75), 6) AS q75_feature_missing_fraction, count(*) FILTER (s >= 0.8) AS n_high_review_rows, count(*) FILTER (s >= 0.5) AS n_review_or_higher_rows FROM u WHERE level IS NOT NULL GROUP BY ALL""")
def _(read):
    return audit.missingness_by_group(read("recordings"), FEATURES, DESIGN)


@query("q04_missingness_by_family", f"""WITH {LONG}, {MISSING} SELECT family, count(*) AS n_features, round(avg(missing_fraction), 6) AS mean_missing_fraction, round(quantile_cont(missing_fraction, 0.5), 6) AS median_missing_fraction, round(max(missing_fraction), 6) AS max_missing_fraction, count(*) FILTER (missing_fraction >= 0.5) AS n_review_features FROM ms GROUP BY family""")
def _(read):
    return audit.missingness_by_family(audit.missingness_by_feature(features_long(read), read("registry")))


@query("q05_comissing_pairs", f"""WITH {LONG}, m AS (SELECT * FROM lf WHERE value IS NULL), t AS (SELECT count(*) AS n FROM recordings), f AS (SELECT DISTINCT feature FROM lf)
SELECT a.feature AS feature_a, b.feature AS feature_b, count(y.record_key) AS n_co_missing, round(count(y.record_key)::DOUBLE / any_value(n), 6) AS co_missing_fraction FROM f a JOIN f b ON a.feature < b.feature CROSS JOIN t LEFT JOIN m x ON x.feature = a.feature LEFT JOIN m y ON y.feature = b.feature AND y.record_key = x.record_key GROUP BY ALL""")
def _(read):
    return audit.comissing_pairs(read("recordings"), FEATURES)


DIST = """b AS (SELECT feature, count(*) AS n_rows, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx, count(DISTINCT value) AS unique_values, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM lf GROUP BY feature),
k AS (SELECT b.*, mad FROM b LEFT JOIN (SELECT f.feature, quantile_cont(abs(value - median), 0.5) AS mad FROM lf f JOIN b ON b.feature = f.feature WHERE value IS NOT NULL GROUP BY f.feature) USING (feature)),
o AS (SELECT f.feature, avg(CASE WHEN mad > 0 THEN (abs(0.6745e0 * (value - median) / mad) > 3.5)::INT WHEN iqr > 0 THEN (value < q25 - 1.5e0 * iqr OR value > q75 + 1.5e0 * iqr)::INT ELSE 0 END) AS robust_outlier_fraction, avg((value = mn)::INT) AS floor_fraction, avg((value = mx)::INT) AS ceiling_fraction FROM lf f JOIN k ON k.feature = f.feature WHERE value IS NOT NULL GROUP BY f.feature),
d AS (SELECT k.*, robust_outlier_fraction, floor_fraction, ceiling_fraction, 1 - n::DOUBLE / n_rows::DOUBLE AS missing_fraction, CASE WHEN n > 0 THEN CASE WHEN mad > 0 THEN 'median_mad' WHEN iqr > 0 THEN 'iqr_scaled' ELSE 'zero_variance' END END AS robust_outlier_method, CASE WHEN sd > 0 THEN (mean - median) / sd END AS skew_proxy, CASE WHEN iqr > 0 THEN (q95 - q05) / iqr END AS tail_ratio, CASE WHEN iqr > 0 AND median <> 0 THEN iqr / abs(median) END AS robust_cv, unique_values <= 1 AS zero_variance,
  coalesce((iqr = 0 AND unique_values <= greatest(2, floor(0.03e0 * n))) OR coalesce(sd, 1) = 0, false) AS near_zero_variance FROM k LEFT JOIN o USING (feature))"""
_R = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("q06_distribution_summary", f"""WITH {LONG}, {DIST} SELECT feature, n, unique_values, robust_outlier_method, zero_variance, near_zero_variance, round(mn, 6) AS "min", round(mx, 6) AS "max", {_R('mean', 'sd', 'q01', 'q05', 'q25', 'median', 'q75', 'q95', 'q99', 'iqr', 'mad', 'robust_outlier_fraction', 'floor_fraction', 'ceiling_fraction', 'missing_fraction', 'skew_proxy', 'tail_ratio', 'robust_cv')} FROM d""")
def _(read):
    return audit.distribution_summary(features_long(read))


RANGE = """rg AS (SELECT f.feature, any_value(expected_low) AS expected_low, any_value(expected_high) AS expected_high, count(value) AS n_valid, min(value) AS mn, max(value) AS mx, count(*) FILTER (value < expected_low) AS n_below_expected, count(*) FILTER (value > expected_high) AS n_above_expected FROM lf f LEFT JOIN registry g ON g.feature = f.feature GROUP BY f.feature),
e AS (SELECT *, CASE WHEN (expected_low IS NOT NULL OR expected_high IS NOT NULL) AND n_valid > 0 THEN (n_below_expected + n_above_expected)::DOUBLE / n_valid::DOUBLE END AS fraction_outside_expected FROM rg),
x AS (SELECT *, CASE WHEN fraction_outside_expected IS NULL THEN 'no_registry_range' WHEN fraction_outside_expected = 0 THEN 'within_range' WHEN fraction_outside_expected < 0.05 THEN 'minor_review' WHEN fraction_outside_expected < 0.2 THEN 'review' ELSE 'high_review' END AS range_status FROM e)"""


@query("q12_expected_range_flags", f"""WITH {LONG}, {RANGE} SELECT feature, expected_low, expected_high, n_valid, round(mn, 6) AS "min", round(mx, 6) AS "max", n_below_expected, n_above_expected, {_R('fraction_outside_expected')}, range_status FROM x""")
def _(read):
    return audit.expected_range_flags(features_long(read), read("registry"))


FLAGS = """s AS (SELECT feature, median AS med, mad, iqr FROM k),
z AS (SELECT f.record_key, f.feature, value, med, mad, iqr, CASE WHEN mad > 0 THEN 0.6745e0 * (value - med) / mad WHEN iqr > 0 THEN (value - med) / (iqr / 1.349e0) END AS rz, expected_low AS lo, expected_high AS hi FROM lf f JOIN s ON s.feature = f.feature LEFT JOIN registry g ON g.feature = f.feature WHERE value IS NOT NULL),
fl AS (SELECT record_key, feature, value, med AS median, iqr, rz AS robust_z, concat_ws('; ', CASE WHEN abs(rz) > 3.5 THEN 'robust_z_abs_gt_3_5' END, CASE WHEN value < lo THEN 'below_expected_range' END, CASE WHEN value > hi THEN 'above_expected_range' END) AS flag_type, CASE WHEN coalesce(value < lo, false) OR coalesce(value > hi, false) THEN 'range_review' ELSE 'statistical_review' END AS review_level, CASE WHEN mad > 0 THEN 'median_mad' WHEN iqr > 0 THEN 'iqr_scaled' ELSE 'zero_variance' END AS robust_method FROM z WHERE abs(rz) > 3.5 OR value < lo OR value > hi)"""


@query("q11_robust_outlier_flags", f"WITH {LONG}, {DIST}, {FLAGS} SELECT record_key, feature, flag_type, review_level, robust_method, {_R('value', 'median', 'iqr', 'robust_z')} FROM fl")
def _(read):
    return audit.robust_outlier_flags(features_long(read), read("registry"))


@query("q13_row_outlier_burden", f"""WITH {LONG}, {DIST}, {FLAGS}, c AS (SELECT record_key, count(DISTINCT feature) AS n_flagged_features, count(*) FILTER (flag_type LIKE '%expected_range%') AS range_flag_count, count(*) FILTER (flag_type LIKE '%robust_z%') AS robust_flag_count, string_agg(feature, ', ' ORDER BY feature) AS flagged_features FROM fl GROUP BY record_key)
SELECT *, round(n_flagged_features::DOUBLE / 9e0, 6) AS fraction_flagged_features, CASE WHEN range_flag_count > 0 OR n_flagged_features::DOUBLE / 9e0 >= 0.2 THEN 'review' WHEN n_flagged_features::DOUBLE / 9e0 >= 0.05 THEN 'monitor' ELSE 'ok' END AS review_level FROM c""")
def _(read):
    return audit.row_outlier_burden(audit.robust_outlier_flags(features_long(read), read("registry")), len(FEATURES))


def _dist_expected(read):
    long = features_long(read, True)
    return settled(audit.distribution_summary(long)), audit.expected_range_flags(long, read("registry"))


REVIEW = """v AS (SELECT d.feature, d.n, d.missing_fraction, d.robust_outlier_fraction, fraction_outside_expected, range_status, zero_variance, coalesce(missing_fraction >= 0.5, false) AS m2, coalesce(missing_fraction >= 0.2, false) AS m1, coalesce(robust_outlier_fraction >= 0.2, false) AS o2, coalesce(robust_outlier_fraction >= 0.05, false) AS o1 FROM d JOIN x USING (feature)),
w AS (SELECT *, m1 AND NOT (m2 OR n < 3 OR zero_variance) AS mm FROM v),
y AS (SELECT *, o1 AND NOT (o2 OR n < 3 OR zero_variance OR m2 OR mm) AS oo FROM w),
rv AS (SELECT *, range_status = 'minor_review' AND NOT (n < 3 OR zero_variance OR m2 OR o2 OR mm OR oo) AS rr, range_status IN ('review', 'high_review') AS r2 FROM y)"""


@query("q09_distribution_review", f"""WITH {LONG}, {DIST}, {RANGE}, {REVIEW}
SELECT feature, n, {_R('missing_fraction', 'robust_outlier_fraction', 'fraction_outside_expected')}, CASE WHEN n < 3 OR zero_variance OR m2 OR o2 OR r2 THEN 'review' WHEN mm OR oo OR rr THEN 'monitor' ELSE 'ok' END AS distribution_status,
coalesce(nullif(concat_ws('; ', CASE WHEN n < 3 THEN 'too few valid observations' END, CASE WHEN zero_variance THEN 'zero variance' END, CASE WHEN m2 THEN 'high missingness' END, CASE WHEN mm THEN 'moderate missingness' END, CASE WHEN o2 THEN 'many robust outliers' END, CASE WHEN oo THEN 'some robust outliers' END, CASE WHEN r2 THEN 'expected-range violations' END, CASE WHEN rr THEN 'minor expected-range violations' END), ''), 'no major distribution issue detected') AS review_reason FROM rv""")
def _(read):
    return audit.distribution_review(*_dist_expected(read))


SHAPE = """h AS (SELECT d.feature, d.n, d.zero_variance AS zv, d.near_zero_variance AND NOT d.zero_variance AS nz, coalesce(skew_proxy >= 0.75, false) AS rs, coalesce(skew_proxy <= -0.75, false) AS ls, coalesce(tail_ratio >= 4.5, false) AS ht, coalesce(floor_fraction >= 0.2, false) AS fe, coalesce(ceiling_fraction >= 0.2, false) AS ce, coalesce(missing_fraction >= 0.5, false) AS m2, coalesce(missing_fraction >= 0.2, false) AS m1, coalesce(robust_outlier_fraction >= 0.2, false) AS o2, coalesce(robust_outlier_fraction >= 0.05, false) AS o1, range_status FROM d JOIN x USING (feature)),
i AS (SELECT *, n < 10 OR zv OR nz OR rs OR ls OR ht OR fe OR ce AS formed FROM h), j AS (SELECT *, m1 AND NOT (m2 OR formed) AS mm FROM i), l AS (SELECT *, o1 AND NOT (o2 OR formed OR m2 OR mm) AS oo FROM j),
sh AS (SELECT *, range_status = 'minor_review' AND NOT (formed OR m2 OR o2 OR mm OR oo) AS rr, range_status IN ('review', 'high_review') AS r2 FROM l),
sp AS (SELECT *, CASE WHEN n < 10 OR zv OR m2 OR o2 OR r2 THEN 'review' WHEN formed OR mm OR oo OR rr THEN 'monitor' ELSE 'ok' END AS priority FROM sh)"""


@query("q10_distribution_shape", f"""WITH {LONG}, {DIST}, {RANGE}, {SHAPE}
SELECT feature, n, priority, coalesce(nullif(concat_ws(', ', CASE WHEN n < 10 THEN 'insufficient_n' END, CASE WHEN zv THEN 'zero_variance' END, CASE WHEN nz THEN 'near_zero_variance' END, CASE WHEN rs THEN 'right-skewed' END, CASE WHEN ls THEN 'left-skewed' END, CASE WHEN ht THEN 'heavy_tailed' END, CASE WHEN fe THEN 'floor_effect' END, CASE WHEN ce THEN 'ceiling_effect' END), ''), 'compact_or_regular') AS shape_class,
coalesce(nullif(concat_ws('; ', CASE WHEN n < 10 THEN 'very small valid n' END, CASE WHEN zv THEN 'zero variance; cannot separate records' END, CASE WHEN nz THEN 'near-zero variance / sparse spread' END, CASE WHEN rs THEN 'right-skewed' END, CASE WHEN ls THEN 'left-skewed' END, CASE WHEN ht THEN 'heavy-tailed distribution' END, CASE WHEN fe THEN 'possible floor effect' END, CASE WHEN ce THEN 'possible ceiling effect' END, CASE WHEN m2 THEN 'high missingness' END, CASE WHEN mm THEN 'moderate missingness' END, CASE WHEN o2 THEN 'large robust outlier burden' END, CASE WHEN oo THEN 'some robust outliers' END, CASE WHEN r2 THEN 'expected-range violations' END, CASE WHEN rr THEN 'minor expected-range violations' END), ''), 'no major distribution-shape concern detected') AS why_it_matters FROM sp""")
def _(read):
    return audit.distribution_shape(*_dist_expected(read))


@query("q14_quality_landscape", f"""WITH {LONG}, {DIST}, q AS (SELECT d.feature, missing_fraction, robust_outlier_fraction, n AS n_valid, zero_variance, {FAMILY} AS family, round(greatest(0e0, least(100e0, 100 - (least(70 * coalesce(missing_fraction, 0), 70e0) + least(125 * coalesce(robust_outlier_fraction, 0), 25e0) + CASE WHEN zero_variance THEN 40e0 ELSE 0e0 END + CASE WHEN n < 3 THEN 30e0 ELSE 0e0 END))), 1) AS quality_score FROM d LEFT JOIN registry g ON g.feature = d.feature)
SELECT feature, {_R('missing_fraction', 'robust_outlier_fraction')}, n_valid, zero_variance, quality_score, family, CASE WHEN zero_variance OR n_valid < 3 OR coalesce(missing_fraction >= 0.5, false) OR coalesce(robust_outlier_fraction >= 0.2, false) THEN 'review' WHEN coalesce(missing_fraction >= 0.2, false) OR coalesce(robust_outlier_fraction >= 0.05, false) THEN 'monitor' ELSE 'ok' END AS quality_status FROM q""")
def _(read):
    return audit.quality_landscape(audit.distribution_summary(features_long(read)), read("registry"))


QFAM = "CASE {0} WHEN 'qadd_returns' THEN 'Additive interference' WHEN 'qgain_discount_sd' THEN 'Gain / level dynamics' WHEN 'qrev_tax_max' THEN 'Reverberation / echo' WHEN 'qchan_price_ratio' THEN 'Channel / device / platform' ELSE 'Nonlinear distortion' END"
QCAT = f"qc_cat AS (SELECT feature AS qc_variable, {QFAM.format('feature')} AS artifact_family, count(value) AS n, 1 - count(value)::DOUBLE / count(*)::DOUBLE AS missing_fraction, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS mn, max(value) AS mx, count(DISTINCT value) AS unique_values FROM qf GROUP BY feature)"


@query("q16_qc_metric_catalog", f"""WITH {QLONG}, {QCAT} SELECT qc_variable, artifact_family, n, {_R('missing_fraction', 'median', 'iqr')}, round(mn, 6) AS "min", round(mx, 6) AS "max", unique_values FROM qc_cat""")
def _(read):
    return audit.qc_catalog(qc_long(read))


QSCORE = f"""qs AS (SELECT feature, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM qf GROUP BY feature), qm AS (SELECT f.feature, any_value(med) AS med, any_value(iqr) AS iqr, quantile_cont(abs(value - med), 0.5) AS mad FROM qf f JOIN qs ON qs.feature = f.feature GROUP BY f.feature),
qz AS (SELECT f.record_key, f.feature, {QFAM.format('f.feature')} AS artifact_family, abs(CASE WHEN mad = 0 AND iqr = 0 THEN 0e0 WHEN mad > 0 THEN 0.6745e0 * (value - med) / mad ELSE (value - med) / (iqr / 1.349e0) END) AS z FROM qf f JOIN qm ON qm.feature = f.feature), qg AS (SELECT *, coalesce(z >= 3.5, false) AS flag FROM qz)"""


@query("q17_qc_row_burden", f"""WITH {QLONG}, {QSCORE} SELECT record_key, count(*) FILTER (flag) AS total_qc_flags, round(avg(flag::INT), 6) AS qc_flag_fraction, round(max(z), 6) AS max_abs_qc_z, coalesce(string_agg(DISTINCT artifact_family, '; ' ORDER BY artifact_family) FILTER (flag), '') AS elevated_qc_families, coalesce((list(feature ORDER BY z DESC, feature) FILTER (z IS NOT NULL))[1], '') AS top_qc_variable FROM qg GROUP BY record_key""")
def _(read):
    return audit.qc_row_burden(read.once("qc"), "record_key", QC_METRICS)


@query("q18_qc_family_burden", f"""WITH {QLONG}, {QCAT}, {QSCORE}, a AS (SELECT artifact_family, record_key, avg(flag::INT) AS s FROM qg GROUP BY ALL)
SELECT c.artifact_family, count(*) AS n_qc_metrics, round(avg(missing_fraction), 6) AS mean_missing_fraction, round(quantile_cont(iqr, 0.5), 6) AS median_metric_iqr, round(any_value(m), 6) AS median_row_flag_fraction FROM qc_cat c JOIN (SELECT artifact_family, quantile_cont(s, 0.5) AS m FROM a GROUP BY artifact_family) b ON b.artifact_family = c.artifact_family GROUP BY c.artifact_family""")
def _(read):
    return audit.qc_family_burden(read.once("qc"), "record_key", QC_METRICS)


def _spearman_sql(pairs: str, by: str, min_n: int, distinct: int = 2, out: str = "sr") -> str:
    part = f"PARTITION BY {by}"
    return f"""{out}_p AS ({pairs}), {out}_r AS (SELECT {by}, x, y, rank() OVER ({part} ORDER BY x) + (count(*) OVER ({part}, x) - 1) / 2e0 AS rx, rank() OVER ({part} ORDER BY y) + (count(*) OVER ({part}, y) - 1) / 2e0 AS ry FROM {out}_p WHERE x IS NOT NULL AND y IS NOT NULL),
{out} AS (SELECT {by}, count(*) AS n, corr(rx, ry) AS rho FROM {out}_r GROUP BY ALL HAVING count(*) >= {min_n} AND count(DISTINCT x) >= {distinct} AND count(DISTINCT y) >= {distinct})"""


FQ = _spearman_sql("SELECT f.feature, q.feature AS qc_variable, f.value AS x, q.value AS y FROM lf f JOIN qf q USING (record_key)", "feature, qc_variable", 4, out="fq")


@query("q19_feature_qc_correlation", f"WITH {LONG}, {QLONG}, {FQ} SELECT feature, qc_variable, n, round(rho, 6) AS rho FROM fq")
def _(read):
    return audit.feature_qc_correlation(features_long(read, True), qc_long(read, True))


@query("q20_feature_qc_family", f"""WITH {LONG}, {QLONG}, {FQ}, a AS (SELECT *, abs(rho) AS a, {QFAM.format('qc_variable')} AS artifact_family FROM fq), b AS (SELECT feature, artifact_family, max(a) AS max_abs_spearman, quantile_cont(a, 0.5) AS median_abs_spearman, count(DISTINCT qc_variable) AS n_qc_metrics, (list(qc_variable ORDER BY a DESC, qc_variable))[1] AS strongest_qc_variable, (list(rho ORDER BY a DESC, qc_variable))[1] AS r FROM a GROUP BY ALL)
SELECT feature, artifact_family, {_R('max_abs_spearman', 'median_abs_spearman')}, n_qc_metrics, strongest_qc_variable, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'zero' END AS strongest_direction, CASE WHEN max_abs_spearman >= 0.5 THEN 'review' WHEN max_abs_spearman >= 0.3 THEN 'monitor' ELSE 'context' END AS review_priority FROM b""")
def _(read):
    return audit.feature_qc_family(audit.feature_qc_correlation(features_long(read, True), qc_long(read, True)))


MQ = _spearman_sql("SELECT f.feature, q.feature AS qc_variable, (f.value IS NULL)::INT::DOUBLE AS x, q.value AS y FROM lf f JOIN qf q USING (record_key)", "feature, qc_variable", 8, out="mq")
OQ = _spearman_sql("SELECT q.feature AS qc_variable, coalesce(c, 0)::DOUBLE AS x, q.value AS y FROM qf q LEFT JOIN (SELECT record_key, count(*) AS c FROM fl GROUP BY record_key) USING (record_key)", "qc_variable", 8, out="oq")


@query("q21_missingness_qc_association", f"WITH {LONG}, {QLONG}, {MQ} SELECT feature, qc_variable, n, round(rho, 6) AS rho FROM mq")
def _(read):
    return audit.missingness_qc_association(features_long(read, True), qc_long(read, True))


@query("q22_outlier_qc_association", f"WITH {LONG}, {DIST}, {FLAGS}, {QLONG}, {OQ} SELECT qc_variable, n, round(rho, 6) AS rho FROM oq")
def _(read):
    return audit.outlier_qc_association(audit.robust_outlier_flags(features_long(read, True), read("registry")), qc_long(read, True))


@query("q23_qc_integration_summary", f"""WITH {LONG}, {DIST}, {FLAGS}, {QLONG}, {FQ}, {MQ}, {OQ}
SELECT 'qc_rows' AS metric, count(DISTINCT record_key) AS value FROM qf UNION ALL SELECT 'numeric_qc_metrics', count(DISTINCT feature) FROM qf UNION ALL SELECT 'artifact_families_detected', 5 UNION ALL SELECT 'feature_qc_pairs_abs_rho_ge_0_30', count(*) FROM fq WHERE abs(rho) >= 0.3 UNION ALL SELECT 'feature_qc_pairs_abs_rho_ge_0_50', count(*) FROM fq WHERE abs(rho) >= 0.5 UNION ALL SELECT 'missingness_qc_pairs_abs_rho_ge_0_30', count(*) FROM mq WHERE abs(rho) >= 0.3 UNION ALL SELECT 'row_outlier_qc_pairs_abs_rho_ge_0_30', count(*) FROM oq WHERE abs(rho) >= 0.3""")
def _(read):
    long, qc = features_long(read, True), qc_long(read, True)
    return audit.qc_integration_summary(qc, audit.feature_qc_correlation(long, qc), audit.missingness_qc_association(long, qc), audit.outlier_qc_association(audit.robust_outlier_flags(long, read("registry")), qc))


@query("q24_reliability_screen", f"""WITH {LONG}, {DIST}, {QLONG}, {FQ}, sa AS (SELECT d.feature, missing_fraction AS m, robust_outlier_fraction AS outl, zero_variance AS zv, cq.q FROM d LEFT JOIN (SELECT feature, max(abs(rho)) AS q FROM fq GROUP BY feature) cq USING (feature)), sb AS (SELECT *, zv OR m >= 0.5 AS bad, coalesce(q >= 0.7, false) AS q2 FROM sa), c1 AS (SELECT *, m >= 0.2 AND NOT bad AS mm FROM sb), c2 AS (SELECT *, coalesce(outl >= 0.2, false) AND NOT bad AND NOT mm AS oo FROM c1), c3 AS (SELECT *, coalesce(q >= 0.5, false) AND NOT (q2 OR bad OR mm OR oo) AS qq FROM c2)
SELECT feature, CASE WHEN bad OR q2 THEN 'exclude_or_review' WHEN mm OR oo OR qq THEN 'use_with_caution' ELSE 'use' END AS recommendation, round(m, 6) AS missing_fraction, round(outl, 6) AS robust_outlier_fraction, zv AS zero_variance, round(q, 6) AS max_abs_qc_spearman, coalesce(nullif(concat_ws('; ', CASE WHEN zv THEN 'zero variance' END, CASE WHEN m >= 0.5 THEN 'high missingness' END, CASE WHEN mm THEN 'moderate missingness' END, CASE WHEN oo THEN 'many robust outliers' END, CASE WHEN q2 THEN 'strong QC association' END, CASE WHEN qq THEN 'moderate QC association' END), ''), 'no major screening issue detected') AS review_reason FROM c3""")
def _(read):
    long = features_long(read, True)
    return audit.reliability_screen(audit.distribution_summary(long), audit.feature_qc_correlation(long, qc_long(read, True)))


FF = _spearman_sql("SELECT a.feature AS feature_1, b.feature AS feature_2, a.value AS x, b.value AS y FROM lf a JOIN lf b ON a.record_key = b.record_key AND a.feature < b.feature", "feature_1, feature_2", 8, out="ff")
CORR = f"""{FF}, nn AS (SELECT feature_1, feature_2, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_pairwise FROM ff_p GROUP BY ALL),
co AS (SELECT feature_1, feature_2, rho AS spearman_rho, abs(rho) AS abs_spearman, n_pairwise FROM nn LEFT JOIN ff USING (feature_1, feature_2))"""


@query("q25_feature_correlation", f"""WITH {LONG}, {CORR} SELECT feature_1, feature_2, {_R('spearman_rho', 'abs_spearman')}, n_pairwise, CASE WHEN spearman_rho >= 0 THEN 'positive' WHEN spearman_rho < 0 THEN 'negative' ELSE 'not_modelable' END AS direction, CASE WHEN abs_spearman IS NULL THEN 'not_modelable' WHEN abs_spearman >= 0.9 THEN 'near_duplicate' WHEN abs_spearman >= 0.8 THEN 'strong_redundancy' WHEN abs_spearman >= 0.6 THEN 'moderate_block' WHEN abs_spearman >= 0.3 THEN 'weak_to_moderate' ELSE 'low' END AS relationship_strength FROM co""")
def _(read):
    return relations.feature_correlation(features_long(read, True))


BOTH = "SELECT co.*, coalesce(g1.family, 'unclassified') AS family_1, coalesce(g2.family, 'unclassified') AS family_2 FROM co LEFT JOIN registry g1 ON g1.feature = feature_1 LEFT JOIN registry g2 ON g2.feature = feature_2"


@query("q26_redundant_pairs", f"WITH {LONG}, {CORR}, bo AS ({BOTH}) SELECT feature_1, feature_2, {_R('spearman_rho', 'abs_spearman')}, n_pairwise, family_1, family_2, family_1 = family_2 AS same_family, CASE WHEN abs_spearman >= 0.9 THEN 'high' ELSE 'moderate' END AS review_priority FROM bo WHERE abs_spearman >= 0.8")
def _(read):
    return relations.redundant_pairs(relations.feature_correlation(features_long(read, True)), read("registry"))


@query("q28_family_correlation", f"WITH {LONG}, {CORR}, bo AS ({BOTH}) SELECT family_1, family_2, round(avg(abs_spearman), 6) AS mean_abs_spearman, round(quantile_cont(abs_spearman, 0.5), 6) AS median_abs_spearman, count(*) AS n_pairs, CASE WHEN family_1 = family_2 THEN 'within_family' ELSE 'between_family' END AS relationship_type FROM bo WHERE abs_spearman IS NOT NULL GROUP BY ALL")
def _(read):
    return relations.family_correlation(relations.feature_correlation(features_long(read, True)), read("registry"))


MODULES = """ed AS (SELECT feature_1 AS a, feature_2 AS b FROM co WHERE abs_spearman >= 0.7 UNION ALL SELECT feature_2, feature_1 FROM co WHERE abs_spearman >= 0.7), re AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM ed) UNION SELECT re.a, ed.b FROM re JOIN ed ON ed.a = re.b), la AS (SELECT a AS feature, min(b) AS module FROM re GROUP BY a),
dg AS (SELECT a AS feature, count(*) AS links FROM ed GROUP BY a), mo AS (SELECT module, count(*) AS n_features, (list(la.feature ORDER BY links DESC, la.feature))[1] AS representative_feature, string_agg(DISTINCT coalesce(family, 'unclassified'), '; ' ORDER BY coalesce(family, 'unclassified')) AS families, string_agg(la.feature, '; ' ORDER BY la.feature) AS features FROM la JOIN dg USING (feature) LEFT JOIN registry g ON g.feature = la.feature GROUP BY module),
ins AS (SELECT l1.module, avg(abs_spearman) AS mean_abs_spearman, max(abs_spearman) AS max_abs_spearman FROM co JOIN la l1 ON l1.feature = feature_1 JOIN la l2 ON l2.feature = feature_2 AND l2.module = l1.module GROUP BY l1.module)"""


@query("q27_correlation_modules", f"WITH RECURSIVE {LONG}, {CORR}, {MODULES} SELECT 'M' || lpad((row_number() OVER (ORDER BY n_features DESC, mo.module))::VARCHAR, 2, '0') AS module_id, n_features, representative_feature, families, features, {_R('mean_abs_spearman', 'max_abs_spearman')} FROM mo JOIN ins ON ins.module = mo.module")
def _(read):
    return relations.correlation_modules(relations.feature_correlation(features_long(read, True)), read("registry"))


@query("q30_relationship_summary", f"WITH RECURSIVE {LONG}, {CORR}, {MODULES} SELECT 'feature_pairs_evaluated' AS metric, count(*)::DOUBLE AS value FROM co UNION ALL SELECT 'pairs_abs_rho_ge_0_60', count(*) FROM co WHERE abs_spearman >= 0.6 UNION ALL SELECT 'redundant_pairs_abs_rho_ge_0_80', count(*) FROM co WHERE abs_spearman >= 0.8 UNION ALL SELECT 'near_duplicate_pairs_abs_rho_ge_0_90', count(*) FROM co WHERE abs_spearman >= 0.9 UNION ALL SELECT 'correlation_modules_abs_rho_ge_0_70', count(*) FROM mo")
def _(read):
    correlation = settled(relations.feature_correlation(features_long(read, True)))
    return relations.relationship_summary(correlation, relations.correlation_modules(correlation, read("registry")))


def _outcomes(read):
    return long_form(read("recordings"), "record_key", ["severity_score"]).select("record_key", F.col("feature").alias("outcome_variable"), F.col("value").alias("y"))


GROUP_VARIABLES = ["task", "diagnosis", "device", "half"]


def _halved(table: DataFrame) -> DataFrame:
    return table.withColumn("half", F.when(F.col("record_key") % 4 == 0, "even").otherwise("odd"))


def screens(table: DataFrame, metrics: list[str] = ()) -> relations.TableScreens:
    return relations.TableScreens(_halved(table), FEATURES, ["severity_score"], metrics, GROUP_VARIABLES)


def _groups(read):
    return _halved(read("recordings")).select("record_key", *GROUP_VARIABLES).unpivot("record_key", GROUP_VARIABLES, "group_variable", "level")


STRENGTH = "CASE WHEN {0} IS NULL THEN 'not_modelable' WHEN abs({0}) >= 0.5 THEN 'strong' WHEN abs({0}) >= 0.3 THEN 'moderate' WHEN abs({0}) >= 0.2 THEN 'weak' ELSE 'minimal' END"
CS = _spearman_sql("SELECT 'severity_score' AS outcome_variable, f.feature, f.value AS x, r.severity_score AS y FROM lf f JOIN recordings r USING (record_key)", "outcome_variable, feature", 8, 3, out="cs")


@query("q39_continuous_screen", f"WITH {LONG}, {CS} SELECT outcome_variable, feature, round(rho, 6) AS effect, round(abs(rho), 6) AS abs_effect, CASE WHEN rho > 0 THEN 'positive' WHEN rho < 0 THEN 'negative' ELSE 'none' END AS direction, n AS n_pairwise, {STRENGTH.format('rho')} AS screening_strength FROM cs")
def _(read):
    return relations.continuous_screen(features_long(read), _outcomes(read))


GROUPS = "gl AS (SELECT record_key, 'task' AS group_variable, task AS level FROM recordings UNION ALL SELECT record_key, 'diagnosis', diagnosis FROM recordings UNION ALL SELECT record_key, 'device', device FROM recordings UNION ALL SELECT record_key, 'half', CASE WHEN record_key % 4 = 0 THEN 'even' ELSE 'odd' END FROM recordings)"
GS = f"""{GROUPS}, sz AS (SELECT group_variable, level, count(*) AS size FROM gl WHERE level IS NOT NULL GROUP BY ALL), lv AS (SELECT *, row_number() OVER (PARTITION BY group_variable ORDER BY size DESC, level) AS place, count(*) OVER (PARTITION BY group_variable) AS n_levels FROM sz),
gr AS (SELECT f.feature, f.value, l.* FROM lf f JOIN gl g USING (record_key) JOIN lv l ON l.group_variable = g.group_variable AND l.level = g.level WHERE f.value IS NOT NULL AND n_levels BETWEEN 2 AND 8),
po AS (SELECT group_variable, feature, count(*) AS n, count(DISTINCT value) AS dv, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_samp(value) AS sd FROM gr GROUP BY ALL), me AS (SELECT group_variable, feature, level, place, n_levels, count(*) AS m, quantile_cont(value, 0.5) AS med FROM gr GROUP BY ALL),
ag AS (SELECT group_variable, feature, n_levels, min(m) AS least, max(level) FILTER (place = 1) AS al, max(med) FILTER (place = 1) AS am, max(m) FILTER (place = 1) AS an, max(level) FILTER (place = 2) AS bl, max(med) FILTER (place = 2) AS bm, max(m) FILTER (place = 2) AS bn, (list(level ORDER BY med DESC, level DESC))[1] AS tl, max(med) AS tm, (list(level ORDER BY med, level))[1] AS ll, min(med) AS lm FROM me GROUP BY ALL),
ra AS (SELECT group_variable, feature, place, rank() OVER (PARTITION BY group_variable, feature ORDER BY value) + (count(*) OVER (PARTITION BY group_variable, feature, value) - 1) / 2e0 AS rk FROM gr WHERE n_levels = 2), rs AS (SELECT group_variable, feature, sum(rk) AS ranks FROM ra WHERE place = 1 GROUP BY ALL),
ef AS (SELECT *, CASE WHEN n_levels = 2 THEN am - bm ELSE tm - lm END / CASE WHEN iqr > 0 THEN iqr WHEN sd > 0 THEN sd END AS effect, CASE WHEN n_levels = 2 THEN al ELSE tl END AS level_1, CASE WHEN n_levels = 2 THEN bl ELSE ll END AS level_2, CASE WHEN n_levels = 2 THEN 2e0 * (ranks - an * (an + 1) / 2e0) / (an * bn) - 1 END AS cliffs_delta FROM ag JOIN po USING (group_variable, feature) LEFT JOIN rs USING (group_variable, feature) WHERE least >= 3 AND n >= 8 AND dv >= 3)"""


@query("q40_group_screen", f"WITH {LONG}, {GS} SELECT group_variable, feature, round(effect, 6) AS effect, round(abs(effect), 6) AS abs_effect, CASE WHEN effect > 0 THEN 'higher_in_' || level_1 WHEN effect < 0 THEN 'higher_in_' || level_2 ELSE 'none' END AS direction, n AS n_pairwise, n_levels, level_1, level_2, round(cliffs_delta, 6) AS cliffs_delta, {STRENGTH.format('effect')} AS screening_strength FROM ef")
def _(read):
    return relations.TableScreens(_halved(read.table()), FEATURES, groups=GROUP_VARIABLES).group_screen()


@query("q41_group_balance", f"WITH {GROUPS}, c AS (SELECT group_variable, level, count(*) AS n_rows FROM gl WHERE level IS NOT NULL GROUP BY ALL) SELECT group_variable, level, n_rows, round(n_rows::DOUBLE / sum(n_rows) OVER (PARTITION BY group_variable), 6) AS proportion, CASE WHEN n_rows < 10 THEN 'small_level' ELSE 'ok' END AS imbalance_note FROM c")
def _(read):
    return relations.group_balance(_groups(read))


@query("q43_screening_priority", f"WITH {LONG}, {CS}, {GS} SELECT feature, outcome_variable AS screened_against, 'continuous' AS screen, round(abs(rho), 6) AS abs_effect, n AS n_pairwise FROM cs UNION ALL SELECT feature, group_variable, 'group', round(abs(effect), 6), n FROM ef")
def _(read):
    found = screens(read.table())
    return relations.screening_priority(found.continuous_screen(), found.group_screen())


def _units(read, task: bool = False):
    r = read.once("recordings")
    unit = F.concat_ws("|", F.col("subject_id").cast("string"), "task") if task else F.col("subject_id").cast("string")
    return long_form(r.withColumn("unit", unit), ["record_key", "unit"], FEATURES)


def _repeat_sql(unit: str, units: int, values: int) -> str:
    return f"""ul AS ({_unpivot('(SELECT *, ' + unit + ' AS unit FROM recordings)', 'record_key, unit', FEATURES)}), pu AS (SELECT feature, unit, count(*) AS n, avg(value) AS mean, var_samp(value) AS var, max(value) - min(value) AS rng FROM ul WHERE unit IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
pf AS (SELECT feature, sum(n)::BIGINT AS n_valid, count(*) AS n_subjects, count(*) FILTER (n >= 2) AS n_repeated_subjects, avg(var) FILTER (n >= 2) AS w, var_samp(mean) FILTER (n >= 2) AS b, quantile_cont(rng, 0.5) FILTER (n >= 2) AS r FROM pu GROUP BY feature),
rp AS (SELECT m.feature, m.missing_fraction, n_valid, n_subjects, n_repeated_subjects, CASE WHEN n_repeated_subjects >= {units} AND n_valid >= {values} THEN w END AS within_subject_variance, CASE WHEN n_repeated_subjects >= {units} AND n_valid >= {values} THEN b END AS between_subject_variance, CASE WHEN n_repeated_subjects >= {units} AND n_valid >= {values} THEN r END AS median_within_subject_range, CASE WHEN n_repeated_subjects >= {units} AND n_valid >= {values} AND w + b > 0 THEN b / (w + b) END AS icc1_proxy, {FAMILY} AS family FROM (SELECT feature, 1 - count(value)::DOUBLE / count(*)::DOUBLE AS missing_fraction FROM ul GROUP BY feature) m LEFT JOIN pf USING (feature) LEFT JOIN registry g ON g.feature = m.feature),
rr AS (SELECT *, CASE WHEN icc1_proxy IS NULL THEN 'not_evaluable' WHEN icc1_proxy >= 0.75 THEN 'stable' WHEN icc1_proxy >= 0.5 THEN 'moderate' WHEN icc1_proxy >= 0.25 THEN 'variable' ELSE 'unstable' END AS reliability_status FROM rp)"""


REPEAT_OUT = f"SELECT feature, coalesce(n_valid, 0) AS n_valid, coalesce(n_subjects, 0) AS n_subjects, coalesce(n_repeated_subjects, 0) AS n_repeated_subjects, {_R('icc1_proxy', 'missing_fraction')}, round(within_subject_variance, 3) AS within_subject_variance, round(between_subject_variance, 3) AS between_subject_variance, round(median_within_subject_range, 3) AS median_within_subject_range, family, reliability_status FROM rr"


def _coarse(df):
    # scaled before rounding, as DuckDB does: differences of values of four digits often end in a tie at the third
    return df.withColumns({c: F.round(F.col(c) * 1000) / 1000 for c in ("within_subject_variance", "between_subject_variance", "median_within_subject_range")})


@query("q46_repeatability", f"WITH {_repeat_sql('subject_id', 3, 6)} {REPEAT_OUT}")
def _(read):
    return _coarse(relations.repeatability(_units(read), read("registry")))


TASK_UNIT = "concat_ws('|', CAST(subject_id AS VARCHAR), task)"


@query("q47_repeatability_by_task", f"WITH {_repeat_sql(TASK_UNIT, 2, 4)} {REPEAT_OUT}")
def _(read):
    return _coarse(relations.repeatability(_units(read, True), read("registry"), 2, 4))


@query("q48_mdc95", f"WITH {LONG}, {DIST}, {_repeat_sql('subject_id', 3, 6)} SELECT feature, round(1.96e0 * sqrt(2e0) * sqrt(within_subject_variance) / CASE WHEN sd > 0 THEN sd END, 6) AS mdc95_standardized FROM rr JOIN d USING (feature)")
def _(read):
    return relations.mdc95(relations.repeatability(_units(read), read("registry")), audit.distribution_summary(features_long(read)))


@query("q49_repeatability_by_family", f"WITH {_repeat_sql('subject_id', 3, 6)} SELECT family, count(*) AS n_features, round(quantile_cont(icc1_proxy, 0.5), 6) AS median_icc1_proxy, count(*) FILTER (reliability_status = 'stable') AS n_stable, count(*) FILTER (reliability_status IN ('variable', 'unstable')) AS n_unstable_or_variable FROM rr GROUP BY family")
def _(read):
    return relations.repeatability_by_family(relations.repeatability(_units(read), read("registry")))


def _recommended(read):
    registry, table = read("registry"), read.table(qc=True)
    dist, expected = settled(audit.table_distribution(table, FEATURES)), audit.table_range_flags(table, FEATURES, registry)
    found = screens(table, QC_METRICS)
    redundant = relations.redundant_pairs(found.feature_correlation(), registry)
    screened = relations.screening_priority(found.continuous_screen(), found.group_screen())
    return settled(relations.recommendations(dist, audit.distribution_shape(dist, expected), found.qc_correlation(), redundant, relations.table_repeatability(table, "subject_id", FEATURES, registry), screened, registry))


ACTIONS = {"very small valid n": "too few values: look at the data behind it first", "zero variance": "leave out, or keep for the record alone", "near-zero variance": "keep an eye on it: it says little here", "extreme missingness": "leave out or compute again, unless the question needs it", "high missingness": "find out why values are missing", "moderate missingness": "keep, and try results with and without the gaps", "high robust outlier burden": "look at the extreme rows and their quality metrics", "moderate outlier burden": "watch the tails", "strong QC association": "read only with quality as a covariate", "moderate QC association": "export with a note on quality", "near-duplicate redundancy": "one feature of its block may be enough for a model", "unstable repeatability": "no statements on change without a look at repeatability", "variable repeatability": "no statements on change without a look at repeatability"}
RULES = [("n < 10", 30, "very small valid n"), ("zv", 55, "zero variance"), ("nz", 20, "near-zero variance"), ("m >= 0.8", 45, "extreme missingness"), ("m >= 0.5 AND m < 0.8", 30, "high missingness"), ("m >= 0.2 AND m < 0.5", 12, "moderate missingness"), ("o >= 0.2", 20, "high robust outlier burden"), ("o >= 0.08 AND o < 0.2", 8, "moderate outlier burden"), ("priority = 'review'", 18, "distribution shape review"), ("priority = 'monitor'", 8, "distribution shape monitor"), ("q >= 0.7", 30, "strong QC association"), ("q >= 0.5 AND q < 0.7", 18, "moderate QC association"), ("q >= 0.3 AND q < 0.5", 7, "weak/moderate QC association"), ("red >= 0.9", 10, "near-duplicate redundancy"), ("red >= 0.8 AND red < 0.9", 5, "strong redundancy"), ("st = 'unstable'", 18, "unstable repeatability"), ("st = 'variable'", 10, "variable repeatability"), ("st = 'not_evaluable'", 4, "repeatability not evaluable")]
RECOMMEND = f"""{LONG}, {DIST}, {RANGE}, {SHAPE}, {QLONG}, {FQ}, {CORR}, {_repeat_sql('subject_id', 3, 6)}, {CS}, {GS.replace('rs AS (', 'rsum AS (').replace('LEFT JOIN rs ', 'LEFT JOIN rsum ')},
lk AS (SELECT feature, max(abs_spearman) AS red, count(*) AS rc FROM (SELECT feature_1 AS feature, abs_spearman FROM co WHERE abs_spearman >= 0.8 UNION ALL SELECT feature_2, abs_spearman FROM co WHERE abs_spearman >= 0.8) GROUP BY feature),
sc AS (SELECT feature, max(a) AS se FROM (SELECT feature, abs(rho) AS a FROM cs UNION ALL SELECT feature, abs(effect) FROM ef) GROUP BY feature),
al AS (SELECT d.feature, d.n, d.zero_variance AS zv, d.near_zero_variance AND NOT d.zero_variance AS nz, d.missing_fraction AS m, d.robust_outlier_fraction AS o, priority, q, red, coalesce(rc, 0) AS rc, icc1_proxy, coalesce(reliability_status, 'not_evaluable') AS st, se, coalesce(g.family, 'unclassified') AS family FROM d JOIN sp USING (feature) LEFT JOIN (SELECT feature, max(abs(rho)) AS q FROM fq GROUP BY feature) USING (feature) LEFT JOIN lk USING (feature) LEFT JOIN rr USING (feature) LEFT JOIN sc USING (feature) LEFT JOIN registry g ON g.feature = d.feature),
sd_ AS (SELECT *, greatest(0, least(100, 100 - ({' + '.join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in RULES)}))) AS score, coalesce(nullif(concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{w}' END" for c, _, w in RULES)}), ''), 'no major review flags detected') AS reasons, coalesce(nullif(concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{ACTIONS[w]}' END" for c, _, w in RULES if w in ACTIONS)}), ''), 'ready for export, with preprocessing fitted on training rows only') AS actions FROM al),
rc_ AS (SELECT *, CASE WHEN zv OR n < 5 OR coalesce(m >= 0.8, false) THEN 'exclude_by_default' WHEN score >= 80 THEN 'recommended' WHEN score >= 60 THEN 'recommended_with_caution' WHEN score >= 40 THEN 'review_before_use' ELSE 'exclude_or_recompute' END AS rec FROM sd_)"""


@query("q51_recommendations", f"WITH {RECOMMEND} SELECT feature, family, rec AS readiness_recommendation, score::BIGINT AS readiness_score, reasons AS primary_reasons, actions AS recommended_action, rec IN ('recommended', 'recommended_with_caution') AS ml_export_default, round(m, 6) AS missing_fraction, round(o, 6) AS robust_outlier_fraction, round(q, 6) AS max_abs_qc_spearman, round(red, 6) AS max_abs_redundancy, rc AS redundant_pair_count, round(icc1_proxy, 6) AS icc1_proxy, st AS reliability_status, round(se, 6) AS max_screening_effect, priority AS shape_priority FROM rc_")
def _(read):
    return _recommended(read)


@query("q52_recommendation_rollups", f"WITH {RECOMMEND} SELECT 'decision' AS kind, rec AS label, count(*) AS n FROM rc_ GROUP BY rec UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(string_split(reasons, '; ')) AS r FROM rc_) GROUP BY r UNION ALL SELECT 'export_family', family, count(*) FROM rc_ WHERE rec IN ('recommended', 'recommended_with_caution') GROUP BY family")
def _(read):
    return relations.recommendation_rollups(_recommended(read))


RULE_METRICS = [r[1] for r in audit.QC_RULES]
WARN = f"""qm AS ({_unpivot('quality', 'record_key', RULE_METRICS)}), ru AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{m}', '{d}', CAST({t} AS DOUBLE), '{w}')" for f, m, d, t, w in audit.QC_RULES)}) AS t(family, feature, direction, threshold, warning)),
wa AS (SELECT record_key, family, feature, value, threshold, direction, warning, CASE WHEN (direction = 'high' AND value > 2 * threshold) OR (direction = 'low' AND value < threshold / 2) THEN 'strong_review' ELSE 'review' END AS severity FROM qm JOIN ru USING (feature) WHERE (direction = 'high' AND value > threshold) OR (direction = 'low' AND value < threshold)),
lv AS (SELECT q.record_key, count(w.feature) AS n_warnings, coalesce(string_agg(DISTINCT family, ';' ORDER BY family), '') AS families FROM quality q LEFT JOIN wa w ON w.record_key = q.record_key GROUP BY q.record_key)"""


def quality_long(read) -> DataFrame:
    return long_form(read.once("quality"), "record_key", RULE_METRICS)


@query("q33_qc_threshold_warnings", f"WITH {WARN} SELECT record_key, family, feature, {_R('value', 'threshold')}, direction, warning, severity FROM wa")
def _(read):
    return audit.qc_threshold_warnings(quality_long(read))


@query("q34_qc_recommendations", f"WITH {WARN} SELECT family, count(DISTINCT record_key) AS n_records_flagged, round(count(DISTINCT record_key)::DOUBLE / (SELECT count(*) FROM quality), 6) AS fraction_records_flagged, CASE family {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in audit.QC_ADVICE.items())} END AS recommendation FROM wa GROUP BY family")
def _(read):
    return audit.qc_recommendations(audit.qc_threshold_warnings(quality_long(read)), read.once("quality"))


@query("q34_qc_recommendations_overall", "SELECT 'overall' AS family, 0::BIGINT AS n_records_flagged, 0e0 AS fraction_records_flagged, '" + audit.NOTHING_FOUND + "' AS recommendation FROM (SELECT count(*) AS n FROM quality) WHERE n > 0")
def _(read):
    return audit.qc_recommendations(audit.qc_threshold_warnings(quality_long(read).where("value IS NULL")), read.once("quality"))


@query("q35_qc_review_level", f"WITH {WARN} SELECT record_key, n_warnings, families, CASE WHEN n_warnings >= 2 THEN 'review' WHEN n_warnings = 1 THEN 'minor_review' ELSE 'no_threshold_warning' END AS review_level FROM lv")
def _(read):
    return audit.qc_review_level(audit.qc_threshold_warnings(quality_long(read)), read.once("quality"))


SKEW = "CASE WHEN count(value) > 2 AND var_pop(value) > 0 THEN skewness(value) END"
SCALED = f"""qk AS (SELECT feature, coalesce({SKEW}, 0) AS skew, min(value) AS low FROM qm GROUP BY feature), qt AS (SELECT record_key, qm.feature, CASE WHEN skew > 1 AND low >= 0 THEN ln(1 + greatest(value, 0)) WHEN abs(skew) > 1 THEN asinh(value) ELSE value END AS value FROM qm JOIN qk ON qk.feature = qm.feature),
ql AS (SELECT feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM qt GROUP BY feature), qw AS (SELECT record_key, qt.feature, CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, lo), hi) END AS value FROM qt JOIN ql ON ql.feature = qt.feature),
qi AS (SELECT feature, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM qw GROUP BY feature), qp AS (SELECT record_key, qw.feature, (value - med) / CASE WHEN iqr > 1e-12 THEN iqr END AS value FROM qw JOIN qi ON qi.feature = qw.feature),
fs AS (SELECT record_key, family, count(value) AS n_features, quantile_cont(value, 0.5) AS score FROM qp JOIN ru USING (feature) GROUP BY record_key, family), bu AS (SELECT record_key, quantile_cont(abs(score), 0.5) AS burden FROM fs GROUP BY record_key)"""


FAMILY_METRICS = {f: [r[1] for r in audit.QC_RULES if r[0] == f] for f in dict.fromkeys(r[0] for r in audit.QC_RULES)}


def scaled_quality(read) -> DataFrame:
    return audit.scaled_metrics(read.once("quality"), "record_key", RULE_METRICS)


def _burden(quality) -> DataFrame:
    scaled = audit.scaled_metrics(quality, [c for c in quality.columns if c not in RULE_METRICS], RULE_METRICS)
    return audit.qc_burden(audit.qc_family_scores(scaled, FAMILY_METRICS), [*FAMILY_METRICS])


@query("q31_qc_scaled", f"WITH {WARN}, {SCALED} SELECT record_key, feature, round(value, 6) AS value FROM qp")
def _(read):
    return long_form(scaled_quality(read), "record_key", RULE_METRICS)


@query("q31_qc_family_scores", f"WITH {WARN}, {SCALED} SELECT record_key, family, n_features, round(score, 6) AS score FROM fs")
def _(read):
    return audit.qc_family_rows(scaled_quality(read), "record_key", FAMILY_METRICS)


FAMILY_CORR = _spearman_sql("SELECT a.family AS feature_1, b.family AS feature_2, round(a.score, 6) AS x, round(b.score, 6) AS y FROM fs a JOIN fs b ON a.record_key = b.record_key AND a.family < b.family", "feature_1, feature_2", 3, out="fc")


@query("q31_qc_family_correlation", f"WITH {WARN}, {SCALED}, {FAMILY_CORR} SELECT feature_1 AS family_1, feature_2 AS family_2, round(rho, 6) AS spearman_rho, n AS n_pairwise FROM fc")
def _(read):
    scores = settled(audit.qc_family_scores(scaled_quality(read), FAMILY_METRICS))
    long = long_form(scores, "record_key", [*FAMILY_METRICS])
    found = relations.feature_correlation(long.withColumn("value", F.round("value", 6)), min_n=3)  # equal scores differ in their last bits
    return found.where("spearman_rho IS NOT NULL").select(F.col("feature_1").alias("family_1"), F.col("feature_2").alias("family_2"), "spearman_rho", "n_pairwise")


@query("q31_qc_burden", f"WITH {WARN}, {SCALED} SELECT record_key, round(burden, 6) AS burden FROM bu")
def _(read):
    return _burden(read.once("quality"))


@query("w36_review_rank", f"WITH {WARN}, {SCALED} SELECT lv.record_key, n_warnings, round(burden, 6) AS burden, row_number() OVER (ORDER BY n_warnings DESC, round(burden, 6) DESC NULLS LAST, lv.record_key) AS review_rank FROM lv LEFT JOIN bu ON bu.record_key = lv.record_key")
def _(read):
    burden = _burden(read.once("quality").withColumn("n_warnings", audit.n_warnings()))
    return audit.ranked_for_review(burden.withColumn("burden", F.round("burden", 6)))
