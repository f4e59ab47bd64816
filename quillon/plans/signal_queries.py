"""Queries of the window, aggregation and assembly operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.stats import long_form
from quillon.operators import aggregates, assemble, relations, signals, windows
from quillon.plans.audit_queries import LONG, _R, _unpivot, features_long, query
from quillon.plans.views import FEATURES

BY, AT = ["recording_id"], "frame"
W = "OVER (PARTITION BY recording_id ORDER BY frame)"
DESIGN = ["task", "diagnosis", "device"]

RUNS = f"""rm AS (SELECT recording_id, frame, coalesce(detected, false) AS detected, lag(coalesce(detected, false)) {W} AS p FROM frames), rn AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> detected THEN 1 ELSE 0 END) {W} AS run FROM rm),
ru AS (SELECT recording_id, run::BIGINT AS run, detected, min(frame) AS first, max(frame) AS last, count(*) AS length FROM rn GROUP BY recording_id, run, detected)"""
SEGMENTS = f"""{RUNS}, sg AS (SELECT recording_id, run AS segment_index, CASE WHEN detected THEN 'speech' ELSE 'nonspeech' END AS segment_type, CASE WHEN detected THEN 'speech' WHEN run = 1 THEN 'leading' WHEN run = max(run) OVER (PARTITION BY recording_id) THEN 'trailing' ELSE 'internal' END AS segment_role, (first - 1) * 0.04e0 AS start_sec, last * 0.04e0 AS end_sec, length * 0.04e0 AS duration_sec FROM ru)"""


def _runs(read):
    return windows.boolean_runs(read("frames"), BY, AT, "detected")


def _segments(read):
    return windows.mask_to_segments(_runs(read), BY, "detected", 0.04)


@query("w01_boolean_runs", f"WITH {RUNS} SELECT * FROM ru")
def _(read):
    return _runs(read)


@query("w02_mask_to_segments", f"WITH {SEGMENTS} SELECT recording_id, segment_index, segment_type, segment_role, {_R('start_sec', 'end_sec', 'duration_sec')} FROM sg")
def _(read):
    return _segments(read)


@query("w03_boundaries", f"WITH {SEGMENTS} SELECT recording_id, segment_index, round(end_sec, 6) AS boundary_sec FROM sg QUALIFY lead(segment_index) OVER (PARTITION BY recording_id ORDER BY segment_index) IS NOT NULL")
def _(read):
    return windows.boundaries(_segments(read), BY)


@query("w04_runs_of_false", f"WITH {RUNS} SELECT recording_id, count(*) FILTER (NOT detected) AS n_gaps, coalesce(max(length) FILTER (NOT detected), 0) AS longest_gap FROM ru GROUP BY recording_id")
def _(read):
    return windows.runs_of_false(_runs(read), BY, "detected")


@query("w07_voice_breaks", f"WITH {RUNS}, x AS (SELECT *, min(run) FILTER (detected) OVER (PARTITION BY recording_id) AS a, max(run) FILTER (detected) OVER (PARTITION BY recording_id) AS b FROM ru) SELECT recording_id, count(*) FILTER (NOT detected AND run > a AND run < b AND length >= 2) AS voice_breaks FROM x GROUP BY recording_id")
def _(read):
    return windows.voice_breaks(_runs(read), BY, "detected", 2)


FILL = f"""fa AS (SELECT *, frame AS n, last_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS pn, first_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qn, last_value(value IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS pv, first_value(value IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qv, max(frame) OVER (PARTITION BY recording_id) AS mx, count(value) OVER (PARTITION BY recording_id) AS k FROM frames),
fb AS (SELECT recording_id, frame, time_s, coalesce(value, pv + (qv - pv) * (n - pn)::DOUBLE / CASE WHEN qn > pn THEN (qn - pn)::DOUBLE END, pv, qv) AS filled, value, coalesce(qn, mx + 1) - coalesce(pn, 0) - 1 AS gap, k FROM fa)"""


@query("w08_interpolate_linear", f"WITH {FILL} SELECT recording_id, frame, round(filled, 6) AS filled FROM fb")
def _(read):
    return windows.interpolate_linear(read("frames"), BY, AT, "value", out="filled").select("recording_id", "frame", "filled")


@query("w09_interpolate_max_gap", f"WITH {FILL} SELECT recording_id, frame, round(CASE WHEN value IS NOT NULL THEN value WHEN gap <= 2 AND k >= 3 THEN filled END, 6) AS filled FROM fb")
def _(read):
    return windows.interpolate_linear(read("frames"), BY, AT, "value", max_gap=2, out="filled").select("recording_id", "frame", "filled")


def _grad(src: str, v: str, out: str, name: str) -> str:
    w = "OVER (PARTITION BY recording_id ORDER BY frame)"
    return f"""{name}_w AS (SELECT *, lag({v}) {w} AS v0, lead({v}) {w} AS v1, time_s - lag(time_s) {w} AS a, lead(time_s) {w} - time_s AS b, count(*) OVER (PARTITION BY recording_id) AS cnt FROM {src}),
{name} AS (SELECT * EXCLUDE (v0, v1, a, b, cnt), CASE WHEN cnt >= 3 THEN CASE WHEN a IS NULL THEN (v1 - {v}) / b WHEN b IS NULL THEN ({v} - v0) / a ELSE (a * a * v1 + (b * b - a * a) * {v} - b * b * v0) / (a * b * (a + b)) END END AS {out} FROM {name}_w)"""


@query("w10_gradient", f"WITH {FILL}, {_grad('fb', 'filled', 'velocity', 'g1')} SELECT recording_id, frame, round(velocity, 4) + 0e0 AS velocity FROM g1", digits=4)
def _(read):
    filled = windows.interpolate_linear(read("frames"), BY, AT, "value", out="filled")
    return windows.gradient(filled, BY, AT, "filled", "time_s", "velocity").select("recording_id", "frame", "velocity")


@query("w11_derivatives", f"WITH {FILL}, {_grad('fb', 'filled', 'velocity', 'g1')}, {_grad('g1', 'velocity', 'acceleration', 'g2')}, {_grad('g2', 'acceleration', 'jerk', 'g3')} SELECT recording_id, round(avg(abs(velocity)), 3) AS velocity, round(avg(abs(acceleration)), 3) AS acceleration, round(avg(abs(jerk)), 2) AS jerk FROM g3 GROUP BY recording_id", digits=3)
def _(read):
    filled = windows.interpolate_linear(read("frames"), BY, AT, "value", out="filled")
    found = windows.derivatives(filled, BY, AT, "filled", "time_s")
    return found.groupBy("recording_id").agg(F.avg(F.abs("velocity")).alias("velocity"), F.avg(F.abs("acceleration")).alias("acceleration"), F.round(F.avg(F.abs("jerk")), 2).alias("jerk"))


@query("w13_scale_jumps", f"WITH v AS (SELECT recording_id, abs(value - lag(value) {W}) / lag(value) {W} AS j FROM frames WHERE value > 0) SELECT recording_id, round(max(j), 6) AS max_jump, round(quantile_cont(j, 0.95), 6) AS p95_jump FROM v GROUP BY recording_id")
def _(read):
    return windows.scale_jumps(read("frames"), BY, AT, "value")


@query("w15_energy_jumps", f"WITH v AS (SELECT recording_id, coalesce(detected AND lag(detected) {W} AND value IS NOT NULL AND lag(value) {W} IS NOT NULL, false) AS b, coalesce(abs(value - lag(value) {W}) >= 18, false) AS j FROM frames) SELECT recording_id, count(*) FILTER (b AND j) AS n_jumps, round(CASE WHEN count(*) FILTER (b) > 0 AND count(*) > 1 THEN count(*) FILTER (b AND j)::DOUBLE / (count(*) - 1)::DOUBLE ELSE 0e0 END, 6) AS jump_fraction FROM v GROUP BY recording_id")
def _(read):
    return windows.energy_jumps(read("frames"), BY, AT, "value", "detected")


@query("w17_start_end_diff", f"WITH v AS (SELECT recording_id, value, row_number() {W} AS n, count(*) OVER (PARTITION BY recording_id) AS c FROM frames WHERE value IS NOT NULL), x AS (SELECT *, greatest(1, floor(c * 0.1e0)) AS k FROM v) SELECT recording_id, round(avg(value) FILTER (n > c - k) - avg(value) FILTER (n <= k), 6) AS start_end_diff, round(regr_slope(value, n), 6) AS level_slope FROM x GROUP BY recording_id")
def _(read):
    return windows.start_end_diff(read("frames"), BY, AT, "value")


def _quot(k: int) -> str:
    near = f"OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING)"
    return f"CASE WHEN count(value) {near} = {k} THEN abs(value - avg(value) {near}) END AS q{k}"


@query("w20_perturbation", f"WITH v AS (SELECT recording_id, value, abs(value - lag(value) {W}) AS d, CASE WHEN value > 0 AND lag(value) {W} > 0 THEN abs(20 * log10(value / lag(value) {W})) END AS b, {_quot(3)}, {_quot(5)}, {_quot(11)} FROM frames WHERE value IS NOT NULL) SELECT recording_id, round(avg(d), 6) AS local_absolute, round(100 * avg(d) / nullif(avg(value), 0), 6) AS local_percent, round(100 * avg(q3) / nullif(avg(value), 0), 6) AS quotient_3, round(100 * avg(q5) / nullif(avg(value), 0), 6) AS quotient_5, round(100 * avg(q11) / nullif(avg(value), 0), 6) AS quotient_11, round(avg(b), 6) AS local_db FROM v GROUP BY recording_id")
def _(read):
    return windows.perturbation(read("frames"), BY, AT, "value")


EXTREMA = f"""ev AS (SELECT recording_id, frame, value, row_number() {W} AS n, lag(value) {W} AS p FROM frames WHERE value IS NOT NULL), er AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> value THEN 1 ELSE 0 END) {W} AS run FROM ev), em AS (SELECT *, floor((min(n) OVER (PARTITION BY recording_id, run) + max(n) OVER (PARTITION BY recording_id, run)) / 2e0) AS mid FROM er), ef_ AS (SELECT *, lag(value) OVER (PARTITION BY recording_id ORDER BY run) AS lo, lead(value) OVER (PARTITION BY recording_id ORDER BY run) AS hi FROM em WHERE n = mid),
ex AS (SELECT recording_id, frame, value, CASE WHEN lo < value AND hi < value THEN 'peak' WHEN lo > value AND hi > value THEN 'trough' END AS kind FROM ef_ WHERE (lo < value AND hi < value) OR (lo > value AND hi > value))"""


@query("w22_local_extrema", f"WITH {EXTREMA} SELECT recording_id, frame, round(value, 6) AS value, kind FROM ex")
def _(read):
    return windows.local_extrema(read("frames"), BY, AT, "value")


@query("w26_event_rate", f"WITH {EXTREMA}, du AS (SELECT recording_id, max(time_s) AS d FROM frames GROUP BY recording_id), ga AS (SELECT recording_id, t - lag(t) OVER (PARTITION BY recording_id ORDER BY t) AS g FROM (SELECT ex.recording_id, f.time_s AS t FROM ex JOIN frames f ON f.recording_id = ex.recording_id AND f.frame = ex.frame WHERE kind = 'peak')), rt AS (SELECT recording_id, count(*) AS n, stddev_samp(g) / nullif(avg(g), 0) AS cv FROM ga GROUP BY recording_id) SELECT du.recording_id, coalesce(n, 0) AS n_events, round(coalesce(n, 0)::DOUBLE / CASE WHEN d > 0 THEN d END, 6) AS rate, round(cv, 6) AS interval_cv FROM du LEFT JOIN rt USING (recording_id)")
def _(read):
    frames = read("frames")
    peaks = windows.local_extrema(frames, BY, AT, "value").where("kind = 'peak'").join(frames.select("recording_id", "frame", "time_s"), ["recording_id", "frame"])
    return windows.event_rate(peaks, BY, "time_s", frames.groupBy("recording_id").agg(F.max("time_s").alias("duration_sec")))


@query("w29_path_length", f"WITH v AS (SELECT recording_id, (abs(value) + abs(lag(value) {W})) / 2 * (time_s - lag(time_s) {W}) AS a FROM frames) SELECT recording_id, round(sum(a), 6) AS path_length FROM v GROUP BY recording_id")
def _(read):
    return windows.path_length(read("frames"), BY, AT, "value", "time_s")


@query("w33_visit_order", "SELECT record_key, subject_id, row_number() OVER (PARTITION BY subject_id, task ORDER BY recording_date NULLS LAST, record_key) AS record_order, date_diff('day', min(recording_date) OVER (PARTITION BY subject_id, task), recording_date) AS days_since_first, date_diff('day', lag(recording_date) OVER (PARTITION BY subject_id, task ORDER BY recording_date NULLS LAST, record_key), recording_date) AS interval_from_previous_days FROM recordings")
def _(read):
    return windows.visit_order(read("recordings"), ["subject_id", "task"], "recording_date", "record_key").select("record_key", "subject_id", "record_order", "days_since_first", "interval_from_previous_days")


@query("w34_baseline_change", "WITH b AS (SELECT record_key, qty_sum, first_value(qty_sum IGNORE NULLS) OVER (PARTITION BY subject_id, task ORDER BY recording_date, record_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, stddev_samp(qty_sum) OVER (PARTITION BY task) AS s FROM recordings) SELECT record_key, round(qty_sum - f, 6) AS change, round((qty_sum - f) / CASE WHEN s > 0 THEN s END, 6) AS standardized_change FROM b")
def _(read):
    return windows.baseline_change(read("recordings"), ["subject_id", "task"], ["recording_date", "record_key"], "qty_sum", ["task"]).select("record_key", "change", "standardized_change")


@query("x27_sigma_clip", "WITH a AS (SELECT recording_id, frame, value AS v0, CASE WHEN abs(value - avg(value) OVER p) > 5 * stddev_pop(value) OVER p THEN NULL ELSE value END AS v1 FROM frames WINDOW p AS (PARTITION BY recording_id)), b AS (SELECT *, CASE WHEN abs(v1 - avg(v1) OVER p) > 3 * stddev_pop(v1) OVER p THEN NULL ELSE v1 END AS v2 FROM a WINDOW p AS (PARTITION BY recording_id)) SELECT recording_id, frame, round(v2, 6) AS value, count(*) FILTER (v0 IS NOT NULL AND v2 IS NULL) OVER (PARTITION BY recording_id) AS n_clipped FROM b")
def _(read):
    return windows.sigma_clip(read("frames").select("recording_id", "frame", "value"), BY, "value")


@query("x29_estimate_fps", f"WITH d AS (SELECT recording_id, time_s - lag(time_s) {W} AS s FROM frames) SELECT recording_id, round(coalesce(1 / quantile_cont(s, 0.5) FILTER (s > 0), 30), 6) AS fps FROM d GROUP BY recording_id")
def _(read):
    return windows.estimate_fps(read("frames"), BY, AT, "time_s")


@query("j08_frames_in_segments", f"WITH {SEGMENTS}, m AS (SELECT s.recording_id, segment_index, f.value FROM frames f JOIN sg s ON s.recording_id = f.recording_id AND f.frame * 0.04e0 >= s.start_sec AND f.frame * 0.04e0 <= s.end_sec) SELECT recording_id, segment_index, count(*) AS n_frames, round(quantile_cont(value, 0.5), 6) AS median_value FROM m GROUP BY ALL")
def _(read):
    met = windows.label_in(read("frames"), _segments(read), BY, F.col("frame") * 0.04, "start_sec", "end_sec")
    return met.groupBy("recording_id", "segment_index").agg(F.count("*").alias("n_frames"), F.get(F.percentile("value", F.array(F.lit(0.5))), F.lit(0)).alias("median_value"))


GC = " UNION ALL ".join(f"SELECT '{d}' AS group_variable, CAST({d} AS VARCHAR) AS level FROM recordings" for d in DESIGN)


@query("g02_design_overview", f'WITH gc AS ({GC}), ct AS (SELECT group_variable AS "column", level, count(*) AS n FROM gc GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS place FROM ct WHERE level IS NOT NULL) SELECT "column", count(*) AS n_unique, 0::BIGINT AS n_missing, string_agg(level || \': \' || n::VARCHAR, \'; \' ORDER BY place) FILTER (place <= 8) AS top_values FROM rk GROUP BY "column"')
def _(read):
    return aggregates.design_overview(read("recordings"), DESIGN)


@query("g04_group_counts", f"WITH gc AS ({GC}) SELECT group_variable, level, count(*) AS n_rows FROM gc WHERE level IS NOT NULL GROUP BY ALL")
def _(read):
    return aggregates.group_counts(read("recordings"), DESIGN)


@query("g05_task_subject_coverage", "WITH p AS (SELECT task, subject_id, count(*) AS n FROM recordings GROUP BY ALL) SELECT task, sum(n)::BIGINT AS n_rows, count(subject_id) AS n_subjects, count(*) FILTER (n >= 2) AS n_repeated_subjects, round(sum(n)::DOUBLE / count(subject_id)::DOUBLE, 6) AS records_per_subject FROM p GROUP BY task")
def _(read):
    return aggregates.task_subject_coverage(read("recordings"), "task", "subject_id")


@query("g06_session_histogram", "WITH p AS (SELECT subject_id, count(DISTINCT session_id) AS n_sessions FROM recordings GROUP BY subject_id) SELECT n_sessions, count(*) AS n_subjects FROM p GROUP BY n_sessions")
def _(read):
    return aggregates.session_histogram(read("recordings"), "subject_id", "session_id")


@query("g07_subject_session_counts", "SELECT subject_id, session_id, count(*) AS n_rows FROM recordings GROUP BY ALL")
def _(read):
    return aggregates.subject_session_counts(read("recordings"), "subject_id", "session_id")


@query("g08_task_crosstab", "WITH t AS (SELECT diagnosis FROM recordings GROUP BY diagnosis ORDER BY count(*) DESC, diagnosis LIMIT 3), c AS (SELECT task, CASE WHEN diagnosis IN (SELECT diagnosis FROM t) THEN diagnosis ELSE 'Other' END AS diagnosis, count(*) AS n_rows FROM recordings GROUP BY ALL) SELECT *, round(n_rows::DOUBLE / sum(n_rows) OVER (PARTITION BY task), 6) AS proportion FROM c")
def _(read):
    return aggregates.task_crosstab(read("recordings"), "task", "diagnosis", 3)


@query("g09_task_readiness", f"WITH r AS (SELECT task, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, avg(({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in FEATURES)})::DOUBLE / 9e0) AS m FROM recordings GROUP BY task), g AS (SELECT task, min(n) AS s FROM (SELECT task, diagnosis, count(*) AS n FROM recordings GROUP BY ALL) GROUP BY task) SELECT task, n_rows, n_subjects, round(m, 6) AS mean_missing_fraction, s AS smallest_group FROM r JOIN g USING (task)")
def _(read):
    return aggregates.task_readiness(read("recordings"), "task", "subject_id", "diagnosis", FEATURES)


@query("g10_aggregate_features", f"SELECT subject_id, task, count(*) AS n_files, {', '.join(f'round(avg({c}), 6) AS {c}' for c in FEATURES)}, min_by(device, record_key) AS device FROM recordings GROUP BY subject_id, task")
def _(read):
    means = aggregates.aggregate_features(read("recordings"), ["subject_id", "task"], FEATURES, first={"device": "record_key"})
    return means.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in FEATURES})  # scaled first, as DuckDB rounds: means of a few rows often tie


@query("g11_aggregate_multistat", f"WITH tl AS ({_unpivot('recordings', 'task', FEATURES)}) SELECT task, feature, count(value) AS n, round(1 - count(value)::DOUBLE / count(*)::DOUBLE, 4) AS missing_fraction, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(CASE WHEN count(value) >= 2 THEN stddev_pop(value) END, 4) AS sd, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(quantile_cont(value, 0.05), 4) AS q05, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.75), 4) AS q75, round(quantile_cont(value, 0.95), 4) AS q95, round(min(value), 4) AS \"min\", round(max(value), 4) AS \"max\" FROM tl GROUP BY task, feature", digits=4)
def _(read):
    return aggregates.aggregate_multistat(long_form(read("recordings"), "task", FEATURES), ["task"])


@query("g12_impute_global_median", f"SELECT record_key, {', '.join(f'round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM recordings)), 6) AS {c}' for c in FEATURES)} FROM recordings")
def _(read):
    return aggregates.impute_global_median(read("recordings").select("record_key", *FEATURES), FEATURES)


@query("g15_completeness", f"""WITH {LONG} SELECT feature AS "column", count(*) - count(value) AS n_missing, round(count(value)::DOUBLE / count(*)::DOUBLE, 6) AS fraction_present FROM lf GROUP BY feature""")
def _(read):
    return aggregates.completeness(read("recordings"), FEATURES)


@query("g17_flag_counts", "WITH f AS (SELECT unnest(string_split(props, ',')) AS x FROM events) SELECT trim(x) AS flag, count(*) AS n FROM f WHERE trim(x) <> '' GROUP BY ALL")
def _(read):
    return aggregates.flag_counts(read("events"), "props", ",")


TEMPORAL = "SELECT recording_id, count(*) AS n_samples, round(count(value)::DOUBLE / count(*)::DOUBLE, 6) AS valid_fraction, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS range_p05_p95"


@query("g20_temporal_summary", f"{TEMPORAL} FROM frames GROUP BY recording_id")
def _(read):
    return aggregates.temporal_summary(read("frames"), BY, "value")


@query("g20_temporal_summary_dense", TEMPORAL + ', round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS "min", round(max(value), 6) AS "max", round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99 FROM frames GROUP BY recording_id')
def _(read):
    return aggregates.temporal_summary(read("frames"), BY, "value", dense=True)


@query("g23_segment_summary", f"WITH {SEGMENTS}, lv AS (SELECT recording_id, quantile_cont(value, 0.5) AS m, stddev_pop(value) AS s FROM frames GROUP BY recording_id) SELECT sg.recording_id, count(*) AS n_segments, round(coalesce(sum(duration_sec) FILTER (segment_role = 'speech'), 0) / sum(duration_sec), 6) AS speech_fraction, round(coalesce(sum(duration_sec) FILTER (segment_role = 'leading'), 0), 6) AS leading_silence_sec, round(coalesce(sum(duration_sec) FILTER (segment_role = 'trailing'), 0), 6) AS trailing_silence_sec, round(coalesce(max(duration_sec) FILTER (segment_role = 'internal'), 0), 6) AS longest_internal_pause_sec, round(any_value(m), 6) AS value_median, round(any_value(s), 6) AS value_std FROM sg JOIN lv ON lv.recording_id = sg.recording_id GROUP BY sg.recording_id")
def _(read):
    return aggregates.segment_summary(_segments(read), BY, read("frames"), "value")


@query("g24_timing_features", f"WITH {SEGMENTS}, i AS (SELECT *, min(start_sec) FILTER (segment_type = 'speech') OVER (PARTITION BY recording_id) AS a, max(end_sec) FILTER (segment_type = 'speech') OVER (PARTITION BY recording_id) AS b FROM sg), j AS (SELECT *, segment_type = 'speech' AS sp, CASE WHEN segment_type <> 'speech' AND duration_sec >= 0.07e0 THEN duration_sec END AS p, CASE WHEN segment_type = 'speech' AND duration_sec > 0.07e0 THEN duration_sec END AS s FROM i WHERE start_sec >= a AND end_sec <= b), k AS (SELECT recording_id, max(b) - min(a) AS total_duration, coalesce(sum(duration_sec) FILTER (sp), 0) AS speech_duration, coalesce(sum(p), 0) AS pause_duration, count(p) AS n_pauses, count(s) AS n_phrases, avg(p) AS mean_pause, avg(s) AS mean_phrase, stddev_samp(p) / CASE WHEN avg(p) > 0 THEN avg(p) END AS cv_pause, stddev_samp(s) / CASE WHEN avg(s) > 0 THEN avg(s) END AS cv_phrase FROM j GROUP BY recording_id) SELECT recording_id, n_pauses, n_phrases, {_R('total_duration', 'speech_duration', 'pause_duration', 'mean_pause', 'mean_phrase', 'cv_pause', 'cv_phrase')}, round(100 * pause_duration / CASE WHEN total_duration > 0 THEN total_duration END, 6) AS percent_pause FROM k")
def _(read):
    return aggregates.timing_features(_segments(read), BY, min_pause=0.07)


@query("j05_join_new_columns", "SELECT r.record_key, r.subject_id, m.site, m.region_name FROM recordings r LEFT JOIN metadata m USING (subject_id)")
def _(read):
    return assemble.join_new_columns(read("recordings").select("record_key", "subject_id"), read("metadata"), ["subject_id"])


@query("j06_coalesce_join", "SELECT l.record_key, coalesce(CASE WHEN l.record_key % 2 = 0 THEN l.device END, 'meta' || (l.record_key % 3)::VARCHAR) AS device FROM recordings l")
def _(read):
    rows = read("recordings")
    other = rows.select("record_key", F.concat(F.lit("meta"), (F.col("record_key") % 3).cast("string")).alias("device"))
    return assemble.coalesce_join(rows.select("record_key", F.when(F.col("record_key") % 2 == 0, F.col("device")).alias("device")), other, ["record_key"])


@query("j07_alignment_report", "WITH a AS (SELECT subject_id, count(*) AS n FROM recordings GROUP BY ALL), b AS (SELECT subject_id, count(*) AS n FROM metadata GROUP BY ALL) SELECT coalesce(sum(a.n), 0)::BIGINT AS rows_a, coalesce(sum(b.n), 0)::BIGINT AS rows_b, count(a.n) AS keys_a, count(b.n) AS keys_b, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS matched_keys FROM a FULL JOIN b USING (subject_id)")
def _(read):
    return assemble.alignment_report(read("recordings"), read("metadata"), ["subject_id"])


@query("j07_early_fusion", "SELECT r.record_key, r.total_price, q.qadd_returns FROM recordings r JOIN qc q USING (record_key)")
def _(read):
    return assemble.early_fusion(read("recordings").select("record_key", "total_price"), read("qc").select("record_key", "qadd_returns"), ["record_key"])


@query("j12_unmatched_rows", "SELECT DISTINCT subject_id, 'a_only' AS side FROM recordings WHERE subject_id NOT IN (SELECT subject_id FROM metadata) UNION ALL SELECT subject_id, 'b_only' FROM metadata WHERE subject_id NOT IN (SELECT subject_id FROM recordings)")
def _(read):
    return assemble.unmatched_rows(read("recordings"), read("metadata"), ["subject_id"])


@query("j13_matched_subjects", "SELECT record_key FROM recordings WHERE subject_id IN (SELECT subject_id FROM metadata)")
def _(read):
    return assemble.matched_subjects(read("recordings"), read("metadata")).select("record_key")


@query("g19_modality_overlap", "WITH a AS (SELECT DISTINCT subject_id, 1 AS a FROM recordings), b AS (SELECT DISTINCT subject_id, 1 AS b FROM metadata) SELECT count(*) FILTER (b IS NULL) AS a_only, count(*) FILTER (a IS NULL) AS b_only, count(*) FILTER (a = 1 AND b = 1) AS \"both\", count(*) AS \"any\" FROM a FULL JOIN b USING (subject_id)")
def _(read):
    return assemble.modality_overlap(read("recordings"), read("metadata"), ["subject_id"])


@query("m11_apply_qc_policy", "SELECT record_key, 'kept' AS reason FROM recordings WHERE device = 'O' OR task = '5-LOW' UNION ALL SELECT record_key, 'qc_policy_pass_only' FROM recordings WHERE NOT (device = 'O' OR task = '5-LOW')")
def _(read):
    rows = read("recordings").select("record_key", F.when(F.col("device") == "O", "pass").otherwise("fail").alias("qc_status"), F.when(F.col("task") == "5-LOW", " OK ").alias("video_status"))
    kept, gone = assemble.apply_qc_policy(rows, ["qc_status", "video_status"], "pass_only")
    return kept.select("record_key", F.lit("kept").alias("reason")).unionByName(gone.select("record_key", "reason"))


@query("io6_dedupe_by_stem", "WITH f AS (SELECT 'media/' || (page_id // 2)::VARCHAR || CASE page_id % 3 WHEN 0 THEN '.webm' WHEN 1 THEN '.wav' ELSE '.mp4' END AS path FROM pages), r AS (SELECT path, regexp_replace(path, '\\.[^.]*$', '') AS stem, CASE WHEN path LIKE '%.wav' THEN 1 WHEN path LIKE '%.mp4' THEN 2 ELSE 3 END AS rk FROM f) SELECT path, first_value(path) OVER w AS kept_path, row_number() OVER w = 1 AS keep FROM r WINDOW w AS (PARTITION BY stem ORDER BY rk, lower(path), path)")
def _(read):
    files = read("pages").select(F.concat(F.lit("media/"), F.floor(F.col("page_id") / 2).cast("string"), F.when(F.col("page_id") % 3 == 0, ".webm").when(F.col("page_id") % 3 == 1, ".wav").otherwise(".mp4")).alias("path"))
    return assemble.dedupe_by_stem(files, [".wav", ".mp4", ".webm"])


@query("q58_group_split", "WITH s AS (SELECT DISTINCT subject_id FROM recordings WHERE subject_id IS NOT NULL), h AS (SELECT subject_id, row_number() OVER (ORDER BY md5('0:' || subject_id::VARCHAR), subject_id) AS n, ceil(count(*) OVER () * 0.2e0) AS k FROM s) SELECT record_key, CASE WHEN n <= k THEN 'test' ELSE 'train' END AS split FROM recordings LEFT JOIN h USING (subject_id)")
def _(read):
    return assemble.group_split(read("recordings"), "subject_id").select("record_key", "split")


@query("q60_feature_status", f"WITH {LONG} SELECT record_key, feature, CASE WHEN value IS NOT NULL THEN 'computed' ELSE 'missing' END AS status FROM lf")
def _(read):
    return assemble.feature_status(features_long(read))


@query("s04_key_difference", "SELECT DISTINCT subject_id FROM recordings WHERE subject_id NOT IN (SELECT subject_id FROM metadata)")
def _(read):
    return assemble.key_difference(read("recordings"), read("metadata"), ["subject_id"])


@query("s03_key_intersect", "SELECT DISTINCT subject_id FROM recordings WHERE subject_id IN (SELECT subject_id FROM metadata)")
def _(read):
    return assemble.key_intersect(read("recordings"), read("metadata"), ["subject_id"])


@query("s01_union_tables", "SELECT record_key, n_lines, NULL::DOUBLE AS qadd_returns, 'acoustic' AS modality FROM recordings UNION ALL SELECT record_key, NULL, round(qadd_returns, 6), 'quality' FROM qc")
def _(read):
    return assemble.union_tables({"acoustic": read("recordings").select("record_key", "n_lines"), "quality": read("qc").select("record_key", "qadd_returns")})


XF = "xf AS (SELECT recording_id, floor((frame - 1) / 5e0)::BIGINT AS frame_idx, sqrt(sum(coalesce(value, 0) * coalesce(value, 0)) / 5e0) AS rms FROM frames GROUP BY ALL), xg AS (SELECT *, (frame_idx + 0.5e0) * 5 / 25e0 AS mid_sec, 20 * log10(greatest(rms, 1e-10)) AS rms_db FROM xf)"


def _levels(read):
    return signals.frame_rms_db(read("frames"), BY, AT, "value", 5, 25.0)


@query("x01_frame_rms_db", f"WITH {XF} SELECT recording_id, frame_idx, {_R('mid_sec', 'rms', 'rms_db')} FROM xg")
def _(read):
    return _levels(read)


@query("x03_energy_mask", f"WITH {XF}, l AS (SELECT recording_id, quantile_cont(rms_db, 0.35) AS threshold FROM xg GROUP BY recording_id) SELECT xg.recording_id, frame_idx, round(threshold, 6) AS threshold, rms_db > threshold AS speech FROM xg JOIN l ON l.recording_id = xg.recording_id")
def _(read):
    return signals.energy_mask(_levels(read), BY, "rms_db").select("recording_id", "frame_idx", "threshold", "speech")


@query("x05_snr_low_energy", f"WITH {XF}, a AS (SELECT recording_id, count(*) AS n, avg(rms * rms) AS m, quantile_cont(rms * rms, 0.1) AS l FROM xg GROUP BY recording_id), b AS (SELECT *, (m - l) / CASE WHEN l > 0 THEN l END AS r FROM a) SELECT recording_id, round(CASE WHEN n >= 3 AND r > 0 THEN 10 * log10(r) END, 6) AS snr_db FROM b")
def _(read):
    return signals.snr_low_energy(_levels(read), BY)


@query("x07_gain_qc", f"WITH {XF} SELECT recording_id, round(quantile_cont(rms_db, 0.5), 6) AS level_median, round(stddev_pop(rms_db), 6) AS level_sd, round(quantile_cont(rms_db, 0.75) - quantile_cont(rms_db, 0.25), 6) AS level_iqr, round(quantile_cont(rms_db, 0.95), 6) AS level_p95, round(quantile_cont(rms_db, 0.99), 6) AS level_p99, round(quantile_cont(rms_db, 0.99) - quantile_cont(rms_db, 0.5), 6) AS crest FROM xg GROUP BY recording_id")
def _(read):
    return signals.gain_qc(_levels(read), BY, "rms_db")


@query("x17_intensity_cv", f"WITH {XF}, s AS (SELECT recording_id, CASE WHEN rms > 0 THEN 20 * log10(greatest(rms, 1e-12) / 2e-5) END AS l FROM xg) SELECT recording_id, round(stddev_samp(l) / CASE WHEN abs(avg(l)) >= 1e-12 THEN abs(avg(l)) END, 6) AS intensity_cv FROM s GROUP BY recording_id")
def _(read):
    return signals.intensity_cv(_levels(read), BY)


@query("x22_valid_energy_frames", f"WITH {XF}, l AS (SELECT recording_id, greatest(quantile_cont(rms, 0.2), 0.1e0 * quantile_cont(rms, 0.5), 1e-5) AS least FROM xg GROUP BY recording_id) SELECT xg.recording_id, frame_idx, round(rms, 6) AS rms FROM xg JOIN l ON l.recording_id = xg.recording_id WHERE rms >= least")
def _(read):
    return signals.valid_energy_frames(_levels(read), BY).select("recording_id", "frame_idx", "rms")


@query("x13_spectral_shape", f"WITH {XF}, s AS (SELECT recording_id, frame_idx + 1 AS f, rms AS p FROM xg WHERE rms > 0), u AS (SELECT *, sum(p) OVER (PARTITION BY recording_id ORDER BY f) AS up, sum(p) OVER (PARTITION BY recording_id) AS al FROM s) SELECT recording_id, round(exp(avg(ln(p))) / avg(p), 6) AS flatness, round(sum(f * p) / sum(p), 6) AS centroid, min(f) FILTER (up >= 0.95e0 * al) AS rolloff95, round(regr_slope(10 * log10(p), log2(f)), 6) AS tilt_db_per_octave FROM u GROUP BY recording_id")
def _(read):
    spectrum = _levels(read).select("recording_id", (F.col("frame_idx") + 1).alias("f"), F.col("rms").alias("p"))
    return signals.spectral_shape(spectrum, BY, "f", "p")


@query("x12_band_ratio", f"WITH {XF}, s AS (SELECT recording_id, frame_idx AS f, lag(frame_idx) OVER w AS f0, (rms + lag(rms) OVER w) / 2 * (frame_idx - lag(frame_idx) OVER w) AS a FROM xg WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)) SELECT recording_id, round(CASE WHEN count(*) FILTER (f >= 11 AND f < 14) > 0 THEN coalesce(sum(a) FILTER (f >= 11 AND f < 14 AND f0 >= 11 AND f0 < 14), 0) / CASE WHEN sum(a) > 0 THEN sum(a) END END, 6) AS band_ratio FROM s GROUP BY recording_id")
def _(read):
    return signals.band_ratio(_levels(read), BY, "frame_idx", "rms", 11, 14)


MOVES = f"""{EXTREMA}, mv AS (SELECT recording_id, kind, frame AS f0, lead(frame) OVER w AS f1, lead(kind) OVER w AS nk FROM ex WINDOW w AS (PARTITION BY recording_id ORDER BY frame)), mw AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY f0) AS movement_id, CASE kind WHEN 'trough' THEN 'open' ELSE 'close' END AS movement_kind, f0, f1 FROM mv WHERE nk IS NOT NULL AND nk <> kind AND f1 - f0 + 1 >= 3),
mf AS (SELECT f.recording_id, f.frame, f.value, m.movement_id, m.movement_kind FROM frames f LEFT JOIN mw m ON m.recording_id = f.recording_id AND f.frame BETWEEN f0 AND f1 QUALIFY row_number() OVER (PARTITION BY f.recording_id, f.frame ORDER BY m.movement_id DESC NULLS LAST) = 1),
mm AS (SELECT mf.recording_id, frame, value, CASE WHEN h.recording_id IS NULL THEN 1 ELSE movement_id END AS movement_id, CASE WHEN h.recording_id IS NULL THEN 'whole' ELSE movement_kind END AS movement_kind FROM mf LEFT JOIN (SELECT DISTINCT recording_id FROM mw) h ON h.recording_id = mf.recording_id)"""


def _moved(read):
    frames = read("frames").select("recording_id", "frame", "value")
    return signals.movement_windows(frames, windows.local_extrema(frames, BY, AT, "value").drop("value"), BY, AT)


@query("w25_movement_windows", f"WITH {MOVES} SELECT recording_id, frame, round(value, 6) AS value, movement_id, movement_kind FROM mm")
def _(read):
    return _moved(read)


@query("w27_path_rom", f"WITH {MOVES}, d AS (SELECT recording_id, movement_id, abs(value - lag(value) OVER (PARTITION BY recording_id, movement_id ORDER BY frame)) AS d FROM mm WHERE movement_id IS NOT NULL), p AS (SELECT recording_id, movement_id, sum(d) AS path FROM d GROUP BY ALL) SELECT recording_id, round(quantile_cont(path, 0.5), 6) AS path_median, round(quantile_cont(path, 0.75) - quantile_cont(path, 0.25), 6) AS path_iqr FROM p GROUP BY recording_id")
def _(read):
    return signals.path_rom(_moved(read), BY, AT, "value")


@query("w28_level_family", f"WITH {MOVES}, p AS (SELECT recording_id, movement_id, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS rng FROM mm WHERE movement_id IS NOT NULL GROUP BY ALL) SELECT recording_id, {', '.join(f'round(quantile_cont({c}, 0.5), 6) AS {n}_median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS {n}_iqr' for c, n in (('p05', 'p05'), ('median', 'median'), ('p95', 'p95'), ('rng', 'range')))} FROM p GROUP BY recording_id")
def _(read):
    return signals.level_family(_moved(read), BY, "value")


@query("q45_reliability_design", "SELECT subject_id, count(*) AS n_records, count(DISTINCT session_id) AS n_sessions, count(DISTINCT task) AS n_tasks, count(*) >= 2 AS repeated FROM recordings WHERE subject_id IS NOT NULL GROUP BY subject_id")
def _(read):
    return relations.reliability_design(read("recordings"), "subject_id", "session_id", "task")


@query("q50_longitudinal_readiness", "WITH a AS (SELECT subject_id, task, count(*) AS n_records, count(DISTINCT session_id) AS n_sessions, count(DISTINCT recording_date) AS n_dates, date_diff('day', min(recording_date), max(recording_date)) AS span_days FROM recordings GROUP BY ALL) SELECT *, CASE WHEN n_records >= 5 THEN '5+' WHEN n_records >= 3 THEN '3-4' WHEN n_records = 2 THEN '2' ELSE '1' END AS depth_band, CASE WHEN span_days IS NULL THEN 'unknown' WHEN span_days = 0 THEN 'same day' WHEN span_days < 30 THEN 'under a month' WHEN span_days < 365 THEN 'under a year' ELSE 'a year or more' END AS span_band FROM a")
def _(read):
    return relations.longitudinal_readiness(read("recordings"), "subject_id", "task", "session_id", "recording_date")
