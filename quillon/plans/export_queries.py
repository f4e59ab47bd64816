"""Queries of the hand-off operators and of further summaries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars
from quillon.functions.shared import settled
from quillon.functions.stats import long_form
from quillon.operators import assemble, audit, columns, export, relations
from quillon.plans.audit_queries import CS, GS, LONG, RANGE, RECOMMEND, SCALED, WARN, _R, _recommended, features_long, query, screens
from quillon.plans.quality_queries import PROFILE, _mapping
from quillon.plans.signal_queries import BY, SEGMENTS, _segments
from quillon.plans.views import FEATURES


@query("q07_distribution_basic", f"""WITH {LONG}, b AS (SELECT feature, count(value) AS n_valid, 1 - count(value)::DOUBLE / count(*)::DOUBLE AS missing_fraction, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95, min(value) AS mn, max(value) AS mx, count(*) AS n, count(DISTINCT value) AS u FROM lf GROUP BY feature),
m AS (SELECT f.feature, quantile_cont(abs(value - median), 0.5) AS mad FROM lf f JOIN b ON b.feature = f.feature GROUP BY f.feature), o AS (SELECT f.feature, count(*) FILTER (mad > 0 AND 0.67448975e0 * abs(value - median) / nullif(mad, 0) > 3.5) AS k FROM lf f JOIN b ON b.feature = f.feature JOIN m ON m.feature = f.feature GROUP BY f.feature)
SELECT b.feature, n_valid, {_R('missing_fraction', 'mean', 'median', 'sd', 'iqr', 'q05', 'q25', 'q75', 'q95')}, round(mn, 6) AS "min", round(mx, 6) AS "max", round(k::DOUBLE / n::DOUBLE, 6) AS robust_outlier_fraction_abs_z_gt_3_5, u <= 1 AS zero_variance FROM b JOIN o ON o.feature = b.feature""")
def _(read):
    return audit.distribution_summary_basic(features_long(read, True))


@query("q08_registry_audit", f"""WITH {LONG}, {RANGE}, b AS (SELECT feature, count(value) AS n_available, 1 - count(value)::DOUBLE / count(*)::DOUBLE AS missing_fraction, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS sd, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95 FROM lf GROUP BY feature)
SELECT b.feature, coalesce(g.family, 'unclassified') AS family, n_available, {_R('missing_fraction', 'mean', 'median', 'sd', 'q05', 'q25', 'q75', 'q95')}, e.expected_low, e.expected_high, n_below_expected, n_above_expected, round((n_below_expected + n_above_expected)::DOUBLE / n_available::DOUBLE, 6) AS out_of_expected_fraction FROM b JOIN e ON e.feature = b.feature LEFT JOIN registry g ON g.feature = b.feature""")
def _(read):
    return audit.registry_distribution_audit(features_long(read, True), read("registry"))


@query("q15_readiness_dimensions", f"""WITH {LONG}, m AS (SELECT avg(x) AS miss FROM (SELECT 1 - count(value)::DOUBLE / count(*)::DOUBLE AS x FROM lf GROUP BY feature)), n AS (SELECT count(*) AS n FROM recordings), d AS (SELECT 'Feature completeness' AS dimension, 100 * (1 - miss) AS s FROM m UNION ALL SELECT 'Numeric analyzability', 100 UNION ALL SELECT 'Metadata context', 70 UNION ALL SELECT 'QC context', 100 UNION ALL SELECT 'Design richness', 60 UNION ALL SELECT 'Row depth', least(100, n::DOUBLE) FROM n UNION ALL SELECT 'Feature breadth', 18)
SELECT dimension, round(s, 1) AS score, CASE WHEN s >= 80 THEN 'strong' WHEN s >= 50 THEN 'adequate' WHEN s > 0 THEN 'limited' ELSE 'absent' END AS status FROM d""")
def _(read):
    by_feature = audit.missingness_by_feature(features_long(read, True), read("registry"))
    return audit.readiness_dimensions(by_feature, read("recordings").agg(F.count("*").alias("n_rows")), len(FEATURES), len(columns.numeric_columns(read("recordings"), FEATURES)), True, 70, 3)


@query("q42_screening_summary", f"WITH {PROFILE}, {LONG}, {CS}, {GS} SELECT 'screening_variables_detected' AS metric, count(*) AS value FROM ro WHERE \"column\" IN ('task', 'session_id', 'recording_date', 'diagnosis', 'device', 'severity_score') UNION ALL SELECT 'continuous_feature_outcome_tests', count(*) FROM cs UNION ALL SELECT 'continuous_abs_effect_ge_0_30', count(*) FROM cs WHERE abs(rho) >= 0.3 UNION ALL SELECT 'categorical_group_feature_tests', count(*) FROM ef UNION ALL SELECT 'group_abs_effect_ge_0_30', count(*) FROM ef WHERE abs(effect) >= 0.3")
def _(read):
    found = screens(read.table())
    rows = read("recordings")
    profile = settled(columns.profile_columns(rows))
    catalog = columns.screening_catalog(rows, columns.classify_columns(rows, "feature", read("registry"), profile), FEATURES, profile)
    return relations.screening_summary(catalog, found.continuous_screen(), found.group_screen())


@query("q44_task_profile_one", f"WITH {LONG}, r AS (SELECT feature, value, task = '5-LOW' AS i FROM lf JOIN recordings USING (record_key) WHERE value IS NOT NULL), p AS (SELECT feature, quantile_cont(value, 0.5) FILTER (i) AS a, quantile_cont(value, 0.5) FILTER (NOT i) AS b, stddev_pop(value) AS s FROM r GROUP BY feature HAVING count(*) FILTER (i) >= 3 AND count(*) FILTER (NOT i) >= 3) SELECT feature, round((a - b) / s, 6) AS effect, round(abs((a - b) / s), 6) AS abs_effect, round(a, 6) AS task_median, round(b, 6) AS other_median FROM p WHERE s > 0")
def _(read):
    return relations.task_feature_profile(features_long(read, True), read("recordings").select("record_key", "task"), "5-LOW")


@query("q44_task_profile_all", f"WITH {LONG}, r AS (SELECT feature, value, task FROM lf JOIN recordings USING (record_key) WHERE value IS NOT NULL), t AS (SELECT feature, task, quantile_cont(value, 0.5) AS m FROM r GROUP BY ALL), s AS (SELECT feature, stddev_pop(value) AS s, count(*) AS n FROM r GROUP BY feature) SELECT feature, round((max(m) - min(m)) / any_value(s), 6) AS effect, round((max(m) - min(m)) / any_value(s), 6) AS abs_effect, round(max(m), 6) AS task_median, round(min(m), 6) AS other_median FROM t JOIN s USING (feature) WHERE s > 0 AND n >= 6 GROUP BY feature HAVING count(*) >= 2")
def _(read):
    return relations.task_feature_profile(features_long(read, True), read("recordings").select("record_key", "task"))


@query("l05_exemplar_subjects", "SELECT subject_id, count(qty_mean) AS n FROM recordings WHERE subject_id IS NOT NULL GROUP BY subject_id HAVING count(qty_mean) >= 2 ORDER BY n DESC, subject_id LIMIT 45")
def _(read):
    rows = read("recordings")
    return relations.exemplar_subjects(long_form(rows, "record_key", ["qty_mean"]), rows.select("record_key", "subject_id"), "qty_mean")


@query("l04_sorted_report", f"WITH {LONG} SELECT feature, count(*) - count(value) AS n_missing, row_number() OVER (ORDER BY count(*) - count(value) DESC, feature) AS place FROM lf GROUP BY feature")
def _(read):
    counts = features_long(read).groupBy("feature").agg((F.count("*") - F.count("value")).alias("n_missing"))
    report = settled(relations.sorted_report(counts, ("n_missing", True), ("feature", False)).coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1))
    return report


def _components(rows: str, features: list[str], centre: str, scale: str, components: int = 5) -> str:
    """SQL of the components of `rows` (record_key, one column per feature): pz (record_key, z), pe (component, eigenvalue, explained, v).

    A covariance matrix is squared, and divided by its trace, until only the projection on its first component is left;
    that is taken out for the next one. Features without spread have no place in it.
    """
    z = ", ".join(f"(coalesce({c}, c_{c}) - c_{c}) / nullif(s_{c}, 0)" for c in features)
    about = ", ".join(f"{centre.format(c)} AS c_{c}" for c in features)
    spread_ = ", ".join(f"{scale.format(c)} AS s_{c}" for c in features)
    n = len(features)
    return f"""pm AS (SELECT {about} FROM {rows}), pf AS (SELECT {", ".join(f"coalesce({c}, c_{c}) AS {c}" for c in features)}, {", ".join(f"{c} AS r_{c}" for c in features)} FROM {rows}, pm), ps AS (SELECT {spread_} FROM pf),
pz0 AS (SELECT record_key, [{z}] AS z FROM {rows}, pm, ps), pc AS (SELECT {", ".join(f"avg(z[{k + 1}])::DOUBLE AS m{k}" for k in range(n))} FROM pz0), pz AS (SELECT record_key, [{", ".join(f"coalesce(z[{k + 1}] - m{k}, 0)" for k in range(n))}] AS z FROM pz0, pc),
pa AS (SELECT [{", ".join("[" + ", ".join(f"sum(z[{a + 1}] * z[{b + 1}]) / (count(*) - 1)" for b in range(n)) + "]" for a in range(n))}] AS a FROM pz),
pt AS (SELECT a, list_sum(list_transform(range(1, {n + 1}), lambda i: a[i][i])) AS total FROM pa),
pi AS (SELECT 1 AS component, 0 AS step, a, total, list_transform(a, lambda r: list_transform(r, lambda x: x / total)) AS m FROM pt UNION ALL
  SELECT component, step, a, total, list_transform(m, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(range(1, {n + 1}), lambda i: m[i][i])))) AS m FROM (
    SELECT CASE WHEN step < 60 THEN component ELSE component + 1 END AS component, CASE WHEN step < 60 THEN step + 1 ELSE 0 END AS step, total,
      CASE WHEN step < 60 THEN a ELSE list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: a[i][j] - m[i][j] * list_sum(list_transform(range(1, {n + 1}), lambda k: list_dot_product(m[k], a[k]))))) END AS a,
      CASE WHEN step < 60 THEN list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: list_dot_product(m[i], m[j]))) ELSE list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: a[i][j] - m[i][j] * list_sum(list_transform(range(1, {n + 1}), lambda k: list_dot_product(m[k], a[k]))))) END AS m
    FROM pi WHERE component < {components} OR step < 60)),
pv AS (SELECT component, list_sum(list_transform(range(1, {n + 1}), lambda k: list_dot_product(m[k], a[k]))) AS eigenvalue, total, list_transform(range(1, {n + 1}), lambda i: m[i][list_position(list_transform(range(1, {n + 1}), lambda k: round(m[k][k], 12)), list_max(list_transform(range(1, {n + 1}), lambda k: round(m[k][k], 12))))]) AS p FROM pi WHERE step = 60),
pe AS (SELECT component, eigenvalue, eigenvalue / total AS explained, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS v FROM pv)"""


# Features in the order of their names, as the first largest loading is positive.
_NAMED = sorted(FEATURES)
COMPONENTS = _components("recordings", _NAMED, "quantile_cont({0}, 0.5)", "coalesce(nullif(quantile_cont(r_{0}, 0.75) - quantile_cont(r_{0}, 0.25), 0), stddev_samp(r_{0}))")
_KEPT = [c for c in _NAMED if c != "flat"]


@query("q29_pca_variance", f"WITH RECURSIVE {COMPONENTS} SELECT component, round(eigenvalue, 4) AS eigenvalue, round(explained, 4) AS explained FROM pe", digits=4)
def _(read):
    return relations.pca(read.once("recordings"), "record_key", FEATURES)[0]


@query("w37_loading_rank", f"WITH RECURSIVE {COMPONENTS}, l AS ({' UNION ALL '.join(f"SELECT component, '{c}' AS feature, v[{k + 1}] AS loading FROM pe" for k, c in enumerate(_NAMED) if c in _KEPT)}) SELECT component, feature, round(loading, 4) AS loading, row_number() OVER (PARTITION BY component ORDER BY round(abs(loading), 9) DESC, feature) AS place FROM l", digits=4)
def _(read):
    return relations.loading_rank(relations.pca(read.once("recordings"), "record_key", FEATURES)[1])


@query("q29_pca_scores", f"WITH RECURSIVE {COMPONENTS} SELECT record_key, {', '.join(f'round(max(list_dot_product(z, v)) FILTER (component = {k}), 4) AS pc{k}' for k in (1, 2, 3))} FROM pz, pe GROUP BY record_key", digits=4)
def _(read):
    return relations.pca(read.once("recordings"), "record_key", FEATURES)[2]


_QC = sorted(r[1] for r in audit.QC_RULES)
_QC_WIDE = "wide AS (SELECT record_key, " + ", ".join(f"max(value) FILTER (feature = '{c}') AS {c}" for c in _QC) + " FROM qp GROUP BY record_key)"


@query("q32_qc_pca", f"WITH RECURSIVE {WARN}, {SCALED}, {_QC_WIDE}, {_components('wide', _QC, 'quantile_cont({0}, 0.5)', 'stddev_pop({0})')} SELECT component, round(eigenvalue, 4) AS eigenvalue, round(explained, 4) AS explained FROM pe", digits=4)
def _(read):
    names = [r[1] for r in audit.QC_RULES]
    wide = settled(audit.scaled_metrics(read.once("quality"), "record_key", names))
    return relations.pca(wide, "record_key", names, plain=True)[0]


@query("g12_drop_sparse", "SELECT record_key, round(total_price, 6) AS total_price, round(qty_mean, 6) AS qty_mean FROM recordings")
def _(read):
    return assemble.missing_policy(read("recordings").select("record_key", "total_price", "qty_mean", "discount_mean"), ["total_price", "qty_mean", "discount_mean"], "drop", 0.5)


@query("g12_preserve", "SELECT record_key, round(discount_mean, 6) AS discount_mean FROM recordings")
def _(read):
    return assemble.missing_policy(read("recordings").select("record_key", "discount_mean"), ["discount_mean"], "preserve")


@query("j02_align_feature_qc", "SELECT r.record_key, round(r.qty_mean, 6) AS qty_mean, q.qrev_tax_max, 'record_key' AS how FROM recordings r LEFT JOIN qc q USING (record_key)")
def _(read):
    met, how = assemble.align_feature_qc(read("recordings").select("record_key", "subject_id", "qty_mean"), read("qc").select("record_key", "qrev_tax_max"))
    return met.select("record_key", "qty_mean", "qrev_tax_max", F.lit(how).alias("how"))


@query("j03_join_all_shared_keys", "SELECT record_key, subject_id, round(qty_mean, 6) AS qty_mean, task FROM recordings WHERE record_key % 2 = 0 AND subject_id % 3 <> 0")
def _(read):
    rows = read("recordings")
    other = rows.where("record_key % 2 = 0").select("record_key", F.when(F.col("subject_id") % 3 != 0, F.col("subject_id")).otherwise(-1).alias("subject_id"), "task")
    return assemble.join_all_shared_keys(rows.select("record_key", "subject_id", "qty_mean"), other)


@query("j11_file_match", "WITH f AS (SELECT DISTINCT 'm' || (page_id // 3)::VARCHAR || CASE page_id % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp4' ELSE '.webm' END AS path, page_id // 3 AS g FROM pages), m AS (SELECT DISTINCT g, 'M' || g::VARCHAR || CASE WHEN g % 2 = 0 THEN '.wav' ELSE '.MP4' END AS name FROM f WHERE g % 5 <> 0) SELECT path, name AS matched_name, CASE WHEN name IS NULL THEN 0e0 WHEN lower(name) = lower(path) THEN 1e0 ELSE 0.92e0 END AS match_confidence FROM f LEFT JOIN m USING (g)")
def _(read):
    g = F.floor(F.col("page_id") / 3)
    files = read("pages").select(F.concat(F.lit("m"), g.cast("string"), F.when(F.col("page_id") % 3 == 0, ".WAV").when(F.col("page_id") % 3 == 1, ".mp4").otherwise(".webm")).alias("path")).distinct()
    names = read("pages").where(g % 5 != 0).select(F.concat(F.lit("M"), g.cast("string"), F.when(g % 2 == 0, ".wav").otherwise(".MP4")).alias("file_name"))
    return assemble.file_match(files, names, [".wav", ".mp4", ".webm"])


@query("f07_scalar_formulas", """SELECT event_id, round(abs(value - 50), 6) AS asymmetry, round(abs(abs(value - 60) - abs(value - 40)), 6) AS balance, round(value - (10 + user_id) / 2e0, 6) AS excursion, event_id::VARCHAR || '|' || event_type AS row_key, strftime(ts, '%Y-%m-%d') AS day, NULL::VARCHAR AS no_day, round(least(greatest(value, 5), 90), 6) AS held FROM events""")
def _(read):
    v = F.col("value")
    return read("events").select("event_id", scalars.axis_asymmetry(v, F.lit(50.0)).alias("asymmetry"), scalars.balance_asymmetry(v - 60, v - 40).alias("balance"), scalars.midpoint_excursion(v, F.lit(10.0), F.col("user_id").cast("double")).alias("excursion"), scalars.row_key(F.col("event_id"), F.col("event_type")).alias("row_key"), scalars.coerce_date(F.col("ts").cast("string")).alias("day"), scalars.coerce_date(F.concat(F.lit("day "), F.col("event_type"))).alias("no_day"), scalars.winsorize(v, F.lit(5.0), F.lit(90.0)).alias("held"))


# hand-offs

ACOUSTIC = "ac AS (SELECT record_key, subject_id, session_id, task, device AS status, total_price AS speech_rate, qty_mean AS jitter_local, tax_mean AS n_frames_used FROM recordings)"
KINEMATIC = "ki AS (SELECT record_key, CASE WHEN qrev_tax_max > 0.06 THEN 'pass' WHEN qrev_tax_max > 0.02 THEN 'Review ' ELSE 'fail' END AS qc_status, qadd_returns AS mouth_aperture_median, qdist_heavy AS face_detected_fraction FROM qc)"


def _modalities(read):
    ac = read.once("recordings").select("record_key", "subject_id", "session_id", "task", F.col("device").alias("status"), F.col("total_price").alias("speech_rate"), F.col("qty_mean").alias("jitter_local"), F.col("tax_mean").alias("n_frames_used"))
    level = F.when(F.col("qrev_tax_max") > 0.06, "pass").when(F.col("qrev_tax_max") > 0.02, "Review ").otherwise("fail")
    return ac, read("qc").select("record_key", level.alias("qc_status"), F.col("qadd_returns").alias("mouth_aperture_median"), F.col("qdist_heavy").alias("face_detected_fraction"))


@query("q55_early_fusion", f"WITH {ACOUSTIC}, {KINEMATIC} SELECT record_key, subject_id, session_id, task, round(speech_rate, 6) AS acoustic__speech_rate, round(jitter_local, 6) AS acoustic__jitter_local, round(mouth_aperture_median, 6) AS kinematic__mouth_aperture_median FROM ac JOIN ki USING (record_key)")
def _(read):
    ac, ki = _modalities(read)
    return export.ml_export_package({"acoustic": ac, "kinematic": ki}).tables["early_fusion_ml_ready"]


@query("q55_ml_ready", f"WITH {ACOUSTIC} SELECT record_key, subject_id, session_id, task, site, region_name, round(speech_rate, 6) AS speech_rate, round(jitter_local, 6) AS jitter_local FROM (SELECT ac.*, site, region_name FROM ac LEFT JOIN metadata m ON m.subject_id = ac.subject_id)")
def _(read):
    ac, _ = _modalities(read)
    tables = export.ml_export_package({"acoustic": ac}, read("metadata")).tables
    return tables["acoustic_ml_ready"].join(export.join_metadata(ac.select("record_key", "subject_id"), read("metadata")).drop("subject_id"), "record_key")


CONTRACT = f"{ACOUSTIC}, {KINEMATIC}, kk AS (SELECT * FROM ki WHERE lower(trim(qc_status)) IN ('pass', 'review'))"


def _contract(read, matched: bool = False):
    ac, ki = _modalities(read)
    rows = ac.sparkSession
    manifest = lambda names: rows.createDataFrame([(n, n != "jitter_local") for n in names], "column_name string, include_in_ml_default boolean")
    meta = read.once("recordings").select("record_key", "diagnosis", F.col("subject_id").cast("string").alias("subject_text"))
    return export.ml_dataset_contract({"acoustic": ac.drop("status"), "kinematic": ki}, {"acoustic": manifest(["speech_rate", "jitter_local", "task"]), "kinematic": manifest(["mouth_aperture_median"])}, meta, ["record_key", "subject_id"], target="diagnosis", matched=matched)


@query("q56_contract_fused", f"WITH {CONTRACT} SELECT ac.record_key, ac.subject_id, round(speech_rate, 6) AS acoustic__speech_rate, round(mouth_aperture_median, 6) AS kinematic__mouth_aperture_median, diagnosis, ac.subject_id::VARCHAR AS subject_text FROM ac JOIN kk USING (record_key) JOIN recordings r ON r.record_key = ac.record_key")
def _(read):
    return _contract(read).tables["early_fusion"]


@query("q56_contract_matched", f"WITH {CONTRACT} SELECT record_key, subject_id, round(speech_rate, 6) AS acoustic__speech_rate FROM ac WHERE subject_id IN (SELECT subject_id FROM ac JOIN kk USING (record_key))")
def _(read):
    return _contract(read, True).tables["acoustic_only"].select("record_key", "subject_id", "acoustic__speech_rate")


@query("s05_exclusion_ledger", f"WITH {CONTRACT} SELECT 'kinematic' AS modality, record_key, 'qc_policy_pass_review' AS reason FROM ki WHERE lower(trim(qc_status)) NOT IN ('pass', 'review') UNION ALL SELECT 'acoustic', record_key, 'missing_kinematic' FROM ac WHERE record_key NOT IN (SELECT record_key FROM kk)")
def _(read):
    return _contract(read).tables["exclusions"]


@query("q56_contract_overlap", f"WITH {CONTRACT} SELECT count(*) FILTER (k.record_key IS NULL) AS a_only, count(*) FILTER (a.record_key IS NULL) AS b_only, count(*) FILTER (a.record_key IS NOT NULL AND k.record_key IS NOT NULL) AS \"both\", count(*) AS \"any\" FROM (SELECT DISTINCT record_key FROM ac) a FULL JOIN (SELECT DISTINCT record_key FROM kk) k ON k.record_key = a.record_key")
def _(read):
    return _contract(read).tables["overlap"]


@query("q57_contract_summary", f"WITH {CONTRACT} SELECT 'problem_type' AS item, 'multiclass_classification' AS value UNION ALL SELECT 'acoustic_only_rows', count(*)::VARCHAR FROM ac UNION ALL SELECT 'kinematic_only_rows', count(*)::VARCHAR FROM kk UNION ALL SELECT 'early_fusion_rows', count(*)::VARCHAR FROM ac JOIN kk USING (record_key) UNION ALL SELECT * FROM (VALUES ('acoustic_only_predictors', '1'), ('kinematic_only_predictors', '1'), ('early_fusion_predictors', '2'), ('acoustic_only_leakage', 'pass'), ('kinematic_only_leakage', 'missing_subject_column'), ('early_fusion_leakage', 'pass')) AS t(item, value)")
def _(read):
    return _contract(read).tables["summary"]


@query("q53_recommendation_plan", f"WITH {RECOMMEND}, policies AS (SELECT * FROM (VALUES ('recommended', 'include_by_default'), ('recommended_with_caution', 'include_with_caution'), ('review_before_use', 'hold_pending_review'), ('exclude_or_recompute', 'exclude_or_recompute'), ('exclude_by_default', 'exclude_by_default')) AS t(decision, policy)), re_ AS (SELECT rec, r, count(*) AS k FROM (SELECT rec, unnest(string_split(reasons, '; ')) AS r FROM rc_) GROUP BY ALL), rt AS (SELECT rec, string_agg(r, '; ' ORDER BY k DESC, r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY k DESC, r) AS p FROM re_) WHERE p <= 3 GROUP BY rec), rn AS (SELECT rec, count(*) AS n FROM rc_ GROUP BY rec) SELECT decision, coalesce(n, 0) AS n_features, policy AS default_export_policy, coalesce(t, '') AS top_current_reasons FROM policies LEFT JOIN rn ON rn.rec = decision LEFT JOIN rt ON rt.rec = decision")
def _(read):
    return export.recommendation_plan(_recommended(read))


@query("q53_priority_review", f"WITH {RECOMMEND} SELECT feature, rec AS decision, score::BIGINT AS readiness_score, CASE WHEN reasons LIKE '%variance%' THEN 'Distributions / Outliers' WHEN reasons LIKE '%missingness%' THEN 'Missingness' WHEN reasons LIKE '%QC association%' THEN 'QC Integration' WHEN reasons LIKE '%redundancy%' THEN 'Feature Relationships' WHEN reasons LIKE '%repeatability%' THEN 'Reliability / Longitudinal' ELSE 'Distributions / Outliers' END AS next_screen FROM rc_ WHERE rec <> 'recommended'")
def _(read):
    return export.priority_review(_recommended(read))


@query("q53_handoff_counts", f"WITH {RECOMMEND} SELECT 'default_export_features' AS handoff_item, count(*) FILTER (rec IN ('recommended', 'recommended_with_caution')) AS value FROM rc_ UNION ALL SELECT 'manual_review_queue', count(*) FILTER (rec = 'review_before_use') FROM rc_ UNION ALL SELECT 'hold_or_recompute', count(*) FILTER (rec IN ('exclude_or_recompute', 'exclude_by_default')) FROM rc_")
def _(read):
    return export.handoff_counts(_recommended(read))


@query("q54_task_export", f"WITH {RECOMMEND}, m AS (SELECT record_key, subject_id, session_id, task, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM recordings WHERE task = '5-LOW') SELECT record_key, 'task' AS part, NULL::VARCHAR AS feature, NULL::DOUBLE AS value FROM m UNION ALL SELECT u.record_key, 'value', u.feature, u.value FROM (UNPIVOT m ON {', '.join(FEATURES)} INTO NAME feature VALUE value) u JOIN rc_ ON rc_.feature = u.feature AND rec IN ('recommended', 'recommended_with_caution')")
def _(read):
    recommended = _recommended(read)  # writes the recordings, too
    package = export.task_export(read.once("recordings"), recommended, "5-LOW", targets=("severity_score",), covariates=("device",))
    matrix = package.tables["matrix"]
    chosen = [c for c in matrix.columns if c not in package.keys]
    rows = matrix.select("record_key", F.lit("task").alias("part"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value"))
    return rows.unionByName(long_form(matrix, "record_key", chosen).where("value IS NOT NULL").select("record_key", F.lit("value").alias("part"), "feature", "value"))


@query("q59_native_segment_events", f"WITH {SEGMENTS} SELECT sg.recording_id, kind, segment_index AS event_index, segment_type || '_' || segment_role AS event_type, {_R('start_sec', 'end_sec', 'duration_sec')} FROM sg LEFT JOIN (SELECT recording_id, max(event_type) AS kind FROM frames GROUP BY recording_id) i ON i.recording_id = sg.recording_id")
def _(read):
    index = read("frames").groupBy("recording_id").agg(F.max("event_type").alias("kind"))
    return export.native_segment_events(_segments(read), index, BY, ["kind"])


