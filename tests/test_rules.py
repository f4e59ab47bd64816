"""Literal cases: what the rules give for hand-made rows, and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import audit, columns, export, landmarks, plugins, relations, signals, spectra, windows

BY = ["r"]


def rows_of(df, *columns_):
    return sorted(tuple(r[c] for c in columns_) for r in df.collect())


def test_roles_of_a_feature_table(spark):
    df = spark.createDataFrame([("a.wav", "S1", "BAMBOO", 120.0, 12.0, "ALS", 20.5), ("b.wav", "S2", "BAMBOO", 130.0, 15.0, "HC", 21.5)], "file_name string, subject_id string, task string, f0_mean double, percent_pause double, diagnosis string, `SNR dB` double")
    got = {r["column"]: r["role"] for r in columns.classify_columns(df).collect()}
    assert got == {"file_name": "Identifier", "subject_id": "Identifier", "task": "Task", "f0_mean": "Feature", "percent_pause": "Feature", "diagnosis": "Target / label", "SNR dB": "QC feature"}
    assert {r["column"]: r["role"] for r in columns.classify_columns(df.select("f0_mean", "diagnosis"), "qc").collect()} == {"f0_mean": "QC feature", "diagnosis": "Target / label"}
    assert {r["column"]: r["confidence"] for r in columns.classify_columns(df.select("f0_mean", "percent_pause"), "metadata").collect()} == {"f0_mean": 0.72, "percent_pause": 0.72}


def test_landscape_scores_and_states(spark):
    dist = spark.createDataFrame([("zero", 50, 0.0, 0.0, True), ("few", 2, 0.0, 0.0, False), ("near", 50, 0.0, 0.0, False), ("miss", 50, 0.25, 0.0, False), ("out", 50, 0.0, 0.2, False), ("all", 0, 1.0, None, True)], "feature string, n long, missing_fraction double, robust_outlier_fraction double, zero_variance boolean")
    registry = spark.createDataFrame([("zero", "x")], "feature string, family string")
    got = {r["feature"]: (r["quality_score"], r["quality_status"]) for r in audit.quality_landscape(dist, registry).collect()}
    assert got == {"zero": (60.0, "review"), "few": (70.0, "review"), "near": (100.0, "ok"), "miss": (82.5, "monitor"), "out": (75.0, "review"), "all": (0.0, "review")}


def test_thresholds_levels_and_advice(spark):
    long = spark.createDataFrame([("a", "qadd_speech_pause_level_diff_db", 4.0), ("a", "qadd_pause_hum50_ratio", 0.1), ("b", "qadd_speech_pause_level_diff_db", 5.0), ("c", "qgain_speech_rms_db_std", 6.0), ("c", "unknown", 99.0), ("d", "qdist_near_clipped_sample_fraction", 0.021)], "record_key string, feature string, value double")
    records = spark.createDataFrame([(k,) for k in "abcd"], "record_key string")
    warnings = audit.qc_threshold_warnings(long)
    assert rows_of(warnings, "record_key", "family", "severity") == [("a", "additive_interference", "review"), ("a", "additive_interference", "strong_review"), ("b", "additive_interference", "review"), ("d", "nonlinear_distortion", "strong_review")]
    assert rows_of(audit.qc_review_level(warnings, records), "record_key", "n_warnings", "families", "review_level") == [("a", 2, "additive_interference", "review"), ("b", 1, "additive_interference", "minor_review"), ("c", 0, "", "no_threshold_warning"), ("d", 1, "nonlinear_distortion", "minor_review")]
    assert rows_of(audit.qc_recommendations(warnings, records), "family", "n_records_flagged", "fraction_records_flagged") == [("additive_interference", 2, 0.5), ("nonlinear_distortion", 1, 0.25)]
    assert rows_of(audit.qc_recommendations(warnings.where("false"), records), "family", "n_records_flagged") == [("overall", 0)]
    assert audit.qc_recommendations(warnings, records.where("false")).count() == 0
    burden = spark.createDataFrame([("a", 0.1), ("b", 0.4), ("c", 9.0)], "record_key string, burden double")
    ranked = audit.review_rank(audit.qc_review_level(warnings, records), burden)
    assert rows_of(ranked, "review_rank", "record_key") == [(1, "a"), (2, "b"), (3, "d"), (4, "c")]


def test_both_ends_of_an_interval_belong_to_it(spark):
    frames = spark.createDataFrame([(1, t) for t in (0.5, 1.0, 1.5, 2.0, 2.5)], "r int, mid double")
    parts = spark.createDataFrame([(1, 0, 1.0, 2.0)], "r int, i int, a double, b double")
    assert rows_of(windows.label_in(frames, parts, BY, F.col("mid"), "a", "b"), "mid") == [(1.0,), (1.5,), (2.0,)]


def test_band_without_its_upper_end(spark):
    df = spark.createDataFrame([(1, float(f), 1.0) for f in range(11)], "r int, f double, p double")
    of = lambda low, high: signals.band_ratio(df, BY, "f", "p", low, high).first()["band_ratio"]
    assert of(2, 6) == pytest.approx(3 / 10) and of(20, 30) is None and of(4, 5) == 0


def test_intensity_is_told_against_20_micropascal(spark):
    rms = np.array([0.01, 0.02, 0.05, 0.4])
    level = 20 * np.log10(rms / 20e-6)
    got = signals.intensity_cv(spark.createDataFrame([(1, float(x)) for x in [*rms, 0.0]], "r int, rms double"), BY).first()["intensity_cv"]
    assert got == pytest.approx(level.std(ddof=1) / level.mean())


def test_a_chain_of_60_features_is_one_module(spark):
    pairs = [(f"f{i:02d}", f"f{i + 1:02d}", 0.75) for i in range(59)] + [("f00", "g", 0.1)]
    correlation = spark.createDataFrame(pairs, "feature_1 string, feature_2 string, abs_spearman double")
    registry = spark.createDataFrame([("f00", "x")], "feature string, family string")
    assert rows_of(relations.correlation_modules(correlation, registry), "module_id", "n_features") == [("M01", 60)]


def faces(spark, frames):
    """frames: (frame, detected, {landmark: (x, y, z)})."""
    names = sorted({i for _, _, p in frames for i in p})
    schema = "r int, frame int, detected boolean, " + ", ".join(f"`{i}_{a}` double" for i in names for a in "xyz")
    return spark.createDataFrame([(1, k, d, *[float(v) for i in names for v in p.get(i, (None,) * 3)]) if all(i in p for i in names) else (1, k, d, *[None if i not in p else float(p[i][a]) for i in names for a in range(3)]) for k, d, p in frames], schema)


def test_scale_falls_back_to_the_outer_eye(spark):
    inner = faces(spark, [(k, True, {133: (0.4, 0.5, 0), 362: (0.6, 0.5, 0), 1: (0.5, 0.6, 0), 33: (0.35, 0.5, 0), 263: (0.65, 0.5, 0)}) for k in range(4)])
    row = landmarks.normalization_qc(landmarks.landmark_normalize(landmarks.landmark_scale(inner, BY), BY, "frame", [1, 33]), BY, "frame", [1, 33]).first()
    assert row["scale_median"] == pytest.approx(0.2) and (row["scale_status"], row["status"], row["qc_flags"]) == ("ok", "ok", "")
    outer = landmarks.landmark_normalize(landmarks.landmark_scale(inner.drop(*[c for c in inner.columns if c.startswith(("133", "362"))]), BY), BY, "frame", [1, 33])
    row = landmarks.normalization_qc(outer, BY, "frame", [1, 33, 61]).first()
    assert row["scale_median"] == pytest.approx(0.3) and row["scale_source"] == "landmark_distance_33_263" and row["qc_flags"] == "normalization_anchor_fallback_used;missing_selected_landmark_columns"
    assert outer.first()["33_x_norm"] == pytest.approx(-0.5)


def test_unstable_scale_and_gaps(spark):
    widths = [0.2, 0.2, 0.95, 0.2]
    df = faces(spark, [(k, True, {133: (0.0, 0, 0), 362: (w, 0, 0), 1: (0, 0, 0)}) for k, w in enumerate(widths)])
    row = landmarks.normalization_qc(landmarks.landmark_normalize(landmarks.landmark_scale(df, BY), BY, "frame", [1]), BY, "frame", [1]).first()
    assert "normalization_scale_unstable" in row["qc_flags"] and row["max_jump"] > 0.25
    gaps = faces(spark, [(k, k not in (2, 3), {1: (0.01 * k, 0, 0)}) for k in range(6)])
    row = landmarks.video_qc(gaps, BY, "frame", [1]).first()
    assert (row["max_no_face_gap"], row["n_no_face_runs"], row["qc_status"]) == (2, 1, "fail") and row["median_step"] == pytest.approx(0.01)


def test_mouth_geometry(spark):
    df = faces(spark, [(k, True, {61: (-2, 0, 0), 291: (2, 0, 0), 0: (0, 1, 0), 17: (0, -1, 0)}) for k in range(3)])
    made = landmarks.landmark_signals(df, "")
    row = df.select(*[c.alias(n) for n, c in made.items()]).first()
    assert (row["mouth_area_right"], row["mouth_area_left"], row["mouth_area_total"], row["mouth_area_abs_asymmetry"]) == (2, 2, 4, 0)
    assert row["lip_eccentricity"] == pytest.approx(math.sqrt(0.75)) and row["lower_lip_lateralization"] == 0
    assert "jaw_to_nose" not in made


def test_acceleration_of_a_parabola(spark):
    df = spark.createDataFrame([(1, k, k / 30, 0.25 * (k / 30) ** 2 + 0.2) for k in range(121)], "r int, frame int, t double, v double")
    got = {r["of"]: r for r in landmarks.speed_summaries(df, BY, "frame", "v", "t").collect()}
    assert got["acceleration"]["median"] == pytest.approx(0.5, abs=0.02) and got["jerk"]["median"] < 0.03


def test_prominence_is_the_lowest_way_to_a_higher_sample():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40, 200):
        v = rng.integers(0, 12, n).astype(float)
        want = []
        for i, h in enumerate(v):
            left = next((j for j in range(i - 1, -1, -1) if v[j] > h), -1)
            right = next((j for j in range(i + 1, n) if v[j] > h), n)
            want.append(h - max(v[left + 1 : i + 1].min(), v[i:right].min()))
        assert spectra.prominences(v).tolist() == want


def test_principal_components_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    x[rng.random(x.shape) < 0.05] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "k int, a double, b double, c double, d double")
    med, q1, q3 = (np.nanquantile(x, q, axis=0) for q in (0.5, 0.25, 0.75))
    z = (np.where(np.isnan(x), med, x) - med) / (q3 - q1)
    z -= z.mean(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    variance, loadings, scores = relations.pca(df, "k", list("abcd"), components=4)
    assert [r["explained"] for r in variance.orderBy("component").collect()] == pytest.approx((s**2 / (s**2).sum()).tolist())
    got = np.array([[r[f"pc{k}"] for k in (1, 2, 3)] for r in scores.orderBy("k").collect()])
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :3]), atol=1e-8)
    load = {(r["component"], r["feature"]): r["loading"] for r in loadings.collect()}
    assert np.allclose([[abs(load[k + 1, f]) for f in "abcd"] for k in range(4)], np.abs(vt))
    ranked = relations.loading_rank(loadings, 2).where("component = 1").orderBy("place").collect()
    assert [abs(r["loading"]) for r in ranked] == pytest.approx(sorted((abs(v) for v in vt[0]), reverse=True)[:2])


def test_export_package_of_two_modalities(spark):
    a = spark.createDataFrame([("S1", "V1", "DDK", "ALS", 4.2, 11.0, "/x/a.wav"), ("S2", "V1", "DDK", "HC", 5.0, 12.0, "/x/b.wav")], "subject_id string, session_id string, task string, diagnosis string, speech_rate double, cpp_mean double, source_file_path string")
    k = spark.createDataFrame([("S1", "V1", "DDK", "v1", 0.9, 0.3, 0.1, "ok"), ("S2", "V1", "DDK", "v2", 0.8, 0.4, 0.2, "ok")], "subject_id string, session_id string, task string, video_id string, face_detected_fraction double, mouth_aperture_median double, mouth_aperture_iqr double, status string")
    package = export.ml_export_package({"acoustic": a, "kinematic": k})
    fused = package.tables["early_fusion_ml_ready"]
    assert package.keys == ["subject_id", "session_id", "task"] and fused.count() == 2
    assert {"acoustic__speech_rate", "kinematic__mouth_aperture_median", "diagnosis"} <= set(fused.columns) and "face_detected_fraction" not in package.tables["kinematic_features_only"].columns
    roles = {r["column"]: (r["role"], r["family"], r["summary_statistic"]) for r in package.tables["feature_manifest"].collect()}
    assert roles["face_detected_fraction"] == ("qc_metric", "quality_control", "file_scalar") and roles["mouth_aperture_iqr"] == ("kinematic_predictor", "mouth_aperture_opening", "iqr")
    assert roles["source_file_path"][0] == "provenance" and roles["cpp_mean"] == ("acoustic_predictor", "phonatory_voice_quality", "mean")


def test_dataset_contract(spark):
    a = spark.createDataFrame([("S1", "V1", "T", 1.0, "pass"), ("S2", "V1", "T", 2.0, "review"), ("S3", "V1", "T", 3.0, "fail")], "subject_id string, session_id string, task string, f0_mean double, qc_status string")
    k = spark.createDataFrame([("S1", "V1", "T", "0.5"), ("S2", "V1", "T", "x")], "subject_id string, session_id string, task string, rom string")
    meta = spark.createDataFrame([("S1", "V1", "T", "ALS"), ("S2", "V1", "T", "HC"), ("S3", "V1", "T", "ALS")], "subject_id string, session_id string, task string, diagnosis string")
    manifest = lambda *names: spark.createDataFrame([(n, "Yes") for n in names], "column_name string, include_in_ml_default string")
    package = export.ml_dataset_contract({"acoustic": a, "kinematic": k}, {"acoustic": manifest("f0_mean"), "kinematic": manifest("rom", "gone")}, meta, ["subject_id", "session_id", "task"], target="diagnosis", matched=True)
    facts = {r["item"]: r["value"] for r in package.tables["summary"].collect()}
    assert facts == {"problem_type": "binary_classification", "acoustic_only_rows": "2", "acoustic_only_predictors": "1", "acoustic_only_leakage": "pass", "kinematic_only_rows": "2", "kinematic_only_predictors": "1", "kinematic_only_leakage": "pass", "early_fusion_rows": "2", "early_fusion_predictors": "2", "early_fusion_leakage": "pass"}
    assert tuple(package.tables["overlap"].select("a_only", "b_only", "both", "any").first()) == (0, 0, 2, 2)
    assert rows_of(package.tables["exclusions"], "modality", "subject_id", "reason") == [("acoustic", "S3", "qc_policy_pass_review")]
    assert rows_of(package.tables["early_fusion"], "subject_id", "kinematic__rom") == [("S1", 0.5), ("S2", None)]


def recommended(spark):
    return spark.createDataFrame([("speech_rate", "recommended", 91, "no major review flags detected", True), ("jitter_local", "review_before_use", 48, "strong QC association", False), ("dead_feature", "exclude_by_default", 12, "zero variance", False)], "feature string, readiness_recommendation string, readiness_score int, primary_reasons string, ml_export_default boolean")


def test_recommendation_plan_and_queue(spark):
    plan = {r["decision"]: r for r in export.recommendation_plan(recommended(spark)).collect()}
    assert len(plan) == 5 and plan["review_before_use"]["n_features"] == 1 and plan["review_before_use"]["default_export_policy"] == "hold_pending_review" and "strong QC association" in plan["review_before_use"]["top_current_reasons"]
    queue = {r["feature"]: r["next_screen"] for r in export.priority_review(recommended(spark)).orderBy("readiness_score").collect()}
    assert queue == {"dead_feature": "Distributions / Outliers", "jitter_local": "QC Integration"}
    assert rows_of(export.handoff_counts(recommended(spark)), "handoff_item", "value") == [("default_export_features", 1), ("hold_or_recompute", 1), ("manual_review_queue", 1)]


def test_task_export_takes_one_task(spark):
    df = spark.createDataFrame([("P01", "READ", 10.0, 60, 25.0, 1.1, 0.1), ("P02", "READ", 20.0, 70, 22.0, 1.4, 0.2), ("P01", "DDK", 10.0, 60, 30.0, 3.0, 0.9)], "subject_id string, task string, outcome double, age int, snr double, speech_rate double, jitter_local double")
    tables = export.task_export(df, recommended(spark), "READ", targets=("outcome",), covariates=("age",), qc=("snr",)).tables
    assert tables["matrix"].columns == ["subject_id", "task", "speech_rate"] and rows_of(tables["targets"], "outcome") == [(10.0,), (20.0,)]
    assert tables["qc"].columns == ["subject_id", "task", "snr"] and tables["manifest"].where("exported").count() == 1
    assert export.task_export(df, recommended(spark), None, "audit").tables["matrix"].columns == ["subject_id", "task", "speech_rate", "jitter_local"]


def test_screened_bands_of_two_tones(spark):
    t = np.arange(200) / 100
    x = np.sin(2 * np.pi * 2 * t) + 0.5 * np.sin(2 * np.pi * 5 * t)
    envelope = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "r int, at int, x double")
    spectrum = spectra.modulation_spectrum(envelope, BY, "at", "x", 100.0)
    row = spectra.modulation_features(spectrum, BY).first()
    assert (row["peak1_hz"], row["peak2_hz"]) == (2.0, 5.0) and row["below"] > 0.7 and row["below"] + row["above"] == pytest.approx(1, abs=0.01)


def test_rules_of_a_user(spark):
    long = spark.createDataFrame([("a", "loudness", 3.0), ("b", "loudness", 9.0)], "record_key string, feature string, value double")
    got = plugins.apply_rules(long, [("level", "loudness", "high", 4.0, "loud")])
    assert rows_of(got, "record_key", "family", "warning", "severity") == [("b", "level", "loud", "strong_review")]
