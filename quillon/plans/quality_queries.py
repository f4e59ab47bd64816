"""Queries of the operators on samples, frames and segments, of column roles and of names, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.stats import long_form
from quillon.operators import aggregates, columns, quality, spectra, windows
from quillon.plans.audit_queries import _R, query
from quillon.plans.signal_queries import BY, SEGMENTS, _segments
from quillon.plans.views import FEATURES

W = "OVER (PARTITION BY recording_id ORDER BY pos)"
RATE = 200.0


def _runs_sql(name: str, source: str, flag: str, pos: str = "pos") -> str:
    """Common table expressions for maximal runs of `flag`."""
    w = f"OVER (PARTITION BY recording_id ORDER BY {pos})"
    return f"""{name}_a AS (SELECT recording_id, {pos} AS pos, {flag} AS hit, lag({flag}) {w} AS p FROM {source}), {name}_b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> hit THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY pos) AS run FROM {name}_a), {name} AS (SELECT recording_id, run, hit, count(*) AS length FROM {name}_b GROUP BY recording_id, run, hit)"""


CLIP = _runs_sql("cr", "samples", "(abs(x) >= 0.999)")
ZERO = _runs_sql("zr", "samples", "(abs(x) <= 1e-6)")


@query("w05_clipping_runs", f"WITH {CLIP} SELECT recording_id, count(*) FILTER (hit AND length >= 3) AS clipping_runs FROM cr GROUP BY recording_id")
def _(read):
    return quality.clipping_runs(read("samples"), BY, "pos", "x")


@query("w06_zero_runs", f"WITH {ZERO} SELECT recording_id, count(*) FILTER (hit AND length >= 5) AS zero_run_count, round(coalesce(sum(length) FILTER (hit AND length >= 5), 0)::DOUBLE / sum(length)::DOUBLE, 6) AS dropout_fraction FROM zr GROUP BY recording_id")
def _(read):
    return quality.zero_runs(read("samples"), BY, "pos", "x", RATE)


@query("x02_frame_mask", "SELECT recording_id, floor((pos - 1) / 4e0)::BIGINT AS frame_idx, count(*) FILTER (detected)::DOUBLE / 4e0 > 0.5 AS speech FROM samples GROUP BY ALL")
def _(read):
    return quality.frame_mask(read("samples"), BY, "pos", "detected", 4)


SUMMARY = f"""{CLIP}, po AS (SELECT recording_id, floor((pos - 1) / 6e0) AS f, sum(x * x) / 6e0 + 1e-12 AS p FROM samples GROUP BY ALL HAVING count(*) = 6), no AS (SELECT recording_id, count(*) AS k, avg(p) AS m, quantile_cont(p, 0.1) AS l FROM po GROUP BY recording_id),
au AS (SELECT s.recording_id, count(*) / 200e0 AS duration_sec, count(*) AS n_samples, avg(x) AS dc_offset, max(abs(x)) AS peak_abs, sqrt(avg(x * x)) AS rms, avg((abs(x) >= 0.98)::INT) AS clipping_fraction FROM samples s GROUP BY s.recording_id),
sm AS (SELECT au.*, clipping_runs, CASE WHEN k >= 3 AND m > l THEN 10 * log10((m - l) / l) END AS snr_db FROM au LEFT JOIN no USING (recording_id) LEFT JOIN (SELECT recording_id, count(*) FILTER (hit AND length >= 3) AS clipping_runs FROM cr GROUP BY recording_id) USING (recording_id))"""


def _audio(read):
    return quality.audio_summary(read("samples"), BY, "pos", "x", RATE)


@query("x04_audio_summary", f"WITH {SUMMARY} SELECT recording_id, n_samples, clipping_runs, {_R('duration_sec', 'dc_offset', 'peak_abs', 'rms', 'clipping_fraction', 'snr_db')} FROM sm")
def _(read):
    return _audio(read)


@query("x06_best_channel", "WITH c AS (SELECT recording_id, pos % 3 AS channel, sqrt(avg(x * x)) AS rms, avg((abs(x) >= 0.98)::INT) AS clip FROM samples GROUP BY ALL) SELECT recording_id, channel AS selected_channel, round(rms, 6) AS rms, round(clip, 6) AS clip_fraction FROM c QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY rms - 10 * clip DESC, channel) = 1")
def _(read):
    return quality.best_channel(read("samples").withColumn("channel", F.col("pos") % 3), BY, "channel", "x")


FILES = f"{SUMMARY}, sc AS (SELECT recording_id, avg(detected::INT) AS speech_fraction FROM samples GROUP BY recording_id), fl AS (SELECT sm.*, speech_fraction, sm.recording_id % 5 = 0 AS hum50, false AS hum60 FROM sm JOIN sc USING (recording_id))"


def _files(read):
    shares = read("samples").groupBy("recording_id").agg(F.avg(F.col("detected").cast("int")).alias("speech_fraction"))
    return _audio(read).join(shares, "recording_id").withColumns({"powerline_50hz": F.col("recording_id") % 5 == 0, "powerline_60hz": F.lit(False)})


@query("q36_dashboard_flags", f"""WITH {FILES}, g AS (SELECT recording_id, concat_ws(';', CASE WHEN duration_sec < 0.5 THEN 'too_short' END, CASE WHEN snr_db < 10 THEN 'low_snr' END, CASE WHEN clipping_fraction > 0.001 THEN 'clipping' END, CASE WHEN hum50 THEN '50hz_powerline' END, CASE WHEN hum60 THEN '60hz_powerline' END, CASE WHEN speech_fraction < 0.05 THEN 'very_low_speech_fraction' END, CASE WHEN speech_fraction > 0.98 THEN 'very_high_speech_fraction' END) AS qc_flags FROM fl)
SELECT recording_id, CASE WHEN qc_flags = '' THEN 'pass' ELSE 'review' END AS qc_status, qc_flags, CASE WHEN qc_flags = '' THEN 0 ELSE len(string_split(qc_flags, ';')) END::BIGINT AS n_qc_flags FROM g""")
def _(read):
    return quality.dashboard_flags(_files(read), BY)


@query("q36_preprocess_flags", f"""WITH {FILES}, g AS (SELECT recording_id, concat_ws(';', CASE WHEN snr_db < 10 THEN 'low_snr' END, CASE WHEN clipping_fraction > 0 THEN 'clipping' END, CASE WHEN abs(dc_offset) > 0.01 THEN 'dc_offset_present' END, CASE WHEN hum50 THEN '50hz_powerline' END, CASE WHEN hum60 THEN '60hz_powerline' END, CASE WHEN duration_sec < 1 THEN 'very_short' END) AS qc_flags FROM fl)
SELECT recording_id, CASE WHEN qc_flags = '' THEN 'ok' ELSE 'review' END AS qc_status, qc_flags, CASE WHEN qc_flags = '' THEN 0 ELSE len(string_split(qc_flags, ';')) END::BIGINT AS n_qc_flags FROM g""")
def _(read):
    return quality.dashboard_flags(_files(read), BY, quality.PREPROCESS_CHECKS, "ok")


def _region_sql(where: str) -> str:
    return f"s.recording_id = g.recording_id AND s.pos - 1 >= round(g.start_sec * 25) AND s.pos - 1 < round(g.end_sec * 25) AND {where}"


@query("j10_samples_speech_only", f"WITH {SEGMENTS} SELECT DISTINCT s.recording_id, s.pos, round(s.x, 6) AS x FROM samples s JOIN sg g ON {_region_sql('''g.segment_type = 'speech' ''')} UNION SELECT recording_id, pos, round(x, 6) FROM samples WHERE recording_id NOT IN (SELECT recording_id FROM sg WHERE segment_type = 'speech')")
def _(read):
    return quality.samples_in_region(read("samples").drop("detected"), _segments(read), BY, "pos", 25.0)


@query("j10_samples_internal_pauses", f"WITH {SEGMENTS} SELECT DISTINCT s.recording_id, s.pos, round(s.x, 6) AS x FROM samples s JOIN sg g ON {_region_sql('''g.segment_role = 'internal' AND g.duration_sec >= 0.07e0''')}")
def _(read):
    return quality.samples_in_region(read("samples").drop("detected"), _segments(read), BY, "pos", 25.0, "internal_pauses", 0.07)


@query("j10_samples_effective_task", f"WITH {SEGMENTS} SELECT DISTINCT s.recording_id, s.pos, round(s.x, 6) AS x FROM samples s JOIN sg g ON {_region_sql('''g.segment_role NOT IN ('leading', 'trailing')''')} UNION SELECT recording_id, pos, round(x, 6) FROM samples WHERE recording_id NOT IN (SELECT recording_id FROM sg WHERE segment_role NOT IN ('leading', 'trailing'))")
def _(read):
    return quality.samples_in_region(read("samples").drop("detected"), _segments(read), BY, "pos", 25.0, "effective_task")


LV = "lv AS (SELECT recording_id, frame, frame * 0.04e0 AS mid_sec, value AS level, detected AS speech FROM frames)"


def _level_frames(read):
    return read("frames").select("recording_id", "frame", (F.col("frame") * 0.04).alias("mid_sec"), F.col("value").alias("level"), F.col("detected").alias("speech"))


ROLL = f"""sp AS (SELECT recording_id, frame, level, row_number() OVER (PARTITION BY recording_id ORDER BY frame) AS n, count(*) OVER (PARTITION BY recording_id) AS c FROM lv WHERE speech AND level IS NOT NULL), sw AS (SELECT *, greatest(3, least(15, c // 4)) AS w FROM sp),
rm_ AS (SELECT a.recording_id, a.n, CASE WHEN count(*) >= 2 THEN quantile_cont(b.level, 0.5) END AS med FROM sw a JOIN sw b ON b.recording_id = a.recording_id AND b.n BETWEEN a.n - a.w // 2 AND a.n + (a.w - 1) // 2 GROUP BY a.recording_id, a.n), ri AS (SELECT recording_id, stddev_pop(med) AS rolling_instability FROM rm_ GROUP BY recording_id)"""


@query("w16_rolling_instability", f"WITH {LV}, {ROLL} SELECT recording_id, round(rolling_instability, 6) AS rolling_instability FROM ri")
def _(read):
    return quality.rolling_instability(_level_frames(read).where("speech"), BY, "frame", "level")


@query("x07_gain_qc_full", f"""WITH {SEGMENTS}, {LV}, {ROLL}, b AS (SELECT recording_id, quantile_cont(level, 0.5) AS level_median, stddev_pop(level) AS level_sd, quantile_cont(level, 0.75) - quantile_cont(level, 0.25) AS level_iqr, quantile_cont(level, 0.95) AS level_p95, quantile_cont(level, 0.99) AS level_p99, quantile_cont(level, 0.99) - quantile_cont(level, 0.5) AS crest, avg(level) FILTER (n > c - greatest(1, floor(c * 0.1e0))) - avg(level) FILTER (n <= greatest(1, floor(c * 0.1e0))) AS start_end_diff, regr_slope(level, n) AS level_slope FROM sp GROUP BY recording_id HAVING count(*) >= 5),
sm_ AS (SELECT recording_id, stddev_pop(m) AS segment_level_sd FROM (SELECT l.recording_id, segment_index, quantile_cont(level, 0.5) AS m FROM lv l JOIN sg s ON s.recording_id = l.recording_id AND s.segment_type = 'speech' AND l.mid_sec >= s.start_sec AND l.mid_sec <= s.end_sec WHERE level IS NOT NULL GROUP BY ALL) GROUP BY recording_id)
SELECT b.recording_id, {_R('level_median', 'level_sd', 'level_iqr', 'level_p95', 'level_p99', 'crest', 'rolling_instability', 'start_end_diff', 'level_slope', 'segment_level_sd')} FROM b LEFT JOIN ri ON ri.recording_id = b.recording_id LEFT JOIN sm_ ON sm_.recording_id = b.recording_id""")
def _(read):
    return quality.gain_qc(_level_frames(read), BY, "frame", "level", "speech", _segments(read))


@query("x08_additive_qc", f"WITH {LV}, a AS (SELECT recording_id, count(*) FILTER (NOT speech) AS n, quantile_cont(level, 0.5) FILTER (NOT speech) AS m, stddev_pop(level) FILTER (NOT speech) AS s, quantile_cont(level, 0.95) FILTER (NOT speech) AS q, quantile_cont(level, 0.5) FILTER (speech) AS d FROM lv WHERE level IS NOT NULL GROUP BY recording_id) SELECT recording_id, CASE WHEN n >= 3 THEN 'computed' ELSE 'insufficient_pause_support' END AS status, round(CASE WHEN n >= 3 THEN m END, 6) AS pause_level_median, round(CASE WHEN n >= 3 THEN s END, 6) AS pause_level_sd, round(CASE WHEN n >= 3 THEN q END, 6) AS pause_level_p95, round(CASE WHEN n >= 3 THEN d - m END, 6) AS speech_pause_difference FROM a")
def _(read):
    return quality.additive_qc(_level_frames(read), BY, "level", "speech")


OFFSETS = f"{SEGMENTS}, po AS (SELECT recording_id, segment_index AS pause_id, start_sec AS s0, end_sec AS s1, segment_type AS ty, lead(segment_role) OVER w AS r, lead(start_sec) OVER w AS p0, lead(end_sec) OVER w AS p1, lead(duration_sec) OVER w AS pause_sec FROM sg WINDOW w AS (PARTITION BY recording_id ORDER BY segment_index)), pp AS (SELECT * FROM po WHERE ty = 'speech' AND r = 'internal')"


@query("j09_pause_offsets", f"WITH {OFFSETS} SELECT recording_id, pause_id, {_R('s0', 's1', 'p0', 'p1', 'pause_sec')} FROM pp")
def _(read):
    return quality.pause_offsets(_segments(read), BY)


@query("x09_reverb_qc", f"""WITH {OFFSETS}, {LV}, al AS (SELECT recording_id, quantile_cont(level, 0.5) AS every FROM lv GROUP BY recording_id),
pm AS (SELECT p.recording_id, pause_id, any_value(pause_sec) AS pause_sec, quantile_cont(level, 0.5) FILTER (mid_sec >= p0 AND mid_sec < least(p1, p0 + 0.25e0)) AS early, quantile_cont(level, 0.5) FILTER (mid_sec > greatest(p0, p1 - 0.25e0) AND mid_sec <= p1) AS late, quantile_cont(level, 0.5) FILTER (mid_sec >= greatest(s0, s1 - 0.25e0) AND mid_sec <= s1) AS said FROM pp p LEFT JOIN lv l ON l.recording_id = p.recording_id AND level IS NOT NULL GROUP BY p.recording_id, pause_id),
pt AS (SELECT pm.*, early - coalesce(late, every) AS tail, early - said AS ratio FROM pm JOIN al USING (recording_id))
SELECT recording_id, round(sum(pause_sec), 6) AS total_offset_pause_sec, round(quantile_cont(pause_sec, 0.5), 6) AS median_offset_pause_sec, round(quantile_cont(tail, 0.5), 6) AS tail_above_floor, round(quantile_cont(ratio, 0.5), 6) AS early_vs_speech_end, round(coalesce(sum(pause_sec) FILTER (tail > 6), 0), 6) AS tail_duration_sec FROM pt GROUP BY recording_id""")
def _(read):
    return quality.reverb_qc(_level_frames(read), _segments(read), BY, "level")


DIST_ = f"""{LV}, li AS (SELECT recording_id, quantile_cont(level, 0.7) AS lim FROM lv WHERE speech AND level IS NOT NULL GROUP BY recording_id HAVING count(*) >= 3), mk AS (SELECT lv.*, coalesce(speech AND level >= lim, false) AS high FROM lv JOIN li USING (recording_id)),
sz AS (SELECT recording_id, count(*) FILTER (high) AS n_high_frames, avg(high::INT) AS high_frame_fraction FROM mk GROUP BY recording_id), sn AS (SELECT recording_id, mid_sec, greatest(0, round((mid_sec - 0.09e0) * 25)) AS f, round((mid_sec + 0.09e0) * 25) - 1 AS t FROM mk WHERE high),
me AS (SELECT s.recording_id, s.pos, s.x, n.mid_sec FROM samples s JOIN sn n ON n.recording_id = s.recording_id AND s.pos - 1 BETWEEN n.f AND n.t WHERE n.t >= n.f),
rw AS (SELECT *, abs(x - lag(x) OVER w) AS st, abs(lag(x) OVER w - 2 * x + lead(x) OVER w) AS be, row_number() OVER (PARTITION BY recording_id, mid_sec ORDER BY abs(x) DESC, pos) AS pl FROM me WINDOW w AS (PARTITION BY recording_id, mid_sec ORDER BY pos)),
pw AS (SELECT recording_id, mid_sec, max((abs(x) >= 0.999)::INT) AS c, max((abs(x) >= 0.98)::INT) AS e, CASE WHEN count(*) > 2 THEN avg((st < 1e-4)::INT) END AS f, CASE WHEN count(*) > 3 AND max(abs(x)) > 0 THEN max(be / greatest(abs(x), 1e-6)) FILTER (pl = 1) END AS u FROM rw GROUP BY recording_id, mid_sec),
wi AS (SELECT recording_id, avg(c) AS clipped_frame_fraction, avg(e) AS near_clipped_frame_fraction, quantile_cont(f, 0.5) AS flat_top_fraction, quantile_cont(u, 0.5) AS peak_curvature FROM pw GROUP BY recording_id),
bo AS (SELECT recording_id, count(*) / 25e0 AS high_level_sec, avg((abs(x) >= 0.999)::INT) AS clipped_fraction, avg((abs(x) >= 0.98)::INT) AS near_clipped_fraction, quantile_cont(x, 0.99) FILTER (x > 0) AS p, quantile_cont(-x, 0.99) FILTER (x < 0) AS m FROM me GROUP BY recording_id)"""


@query("x10_distortion_qc", f"WITH {DIST_} SELECT sz.recording_id, n_high_frames, {_R('high_frame_fraction', 'high_level_sec', 'clipped_fraction', 'near_clipped_fraction', 'clipped_frame_fraction', 'near_clipped_frame_fraction', 'flat_top_fraction', 'peak_curvature')}, round((p - m) / CASE WHEN p + m > 0 THEN p + m END, 6) AS peak_asymmetry FROM sz LEFT JOIN wi ON wi.recording_id = sz.recording_id LEFT JOIN bo ON bo.recording_id = sz.recording_id")
def _(read):
    return quality.distortion_qc(read("samples"), _level_frames(read), BY, "pos", "x", 25.0, "level", "speech", half=0.09, share=0.7)


@query("x11_temporal_qc", f"""WITH {ZERO}, {LV}, z AS (SELECT recording_id, count(*) FILTER (hit AND length >= 5) AS zero_run_count, coalesce(sum(length) FILTER (hit AND length >= 5), 0)::DOUBLE / sum(length)::DOUBLE AS dropout_fraction FROM zr GROUP BY recording_id),
r AS (SELECT recording_id, x, row_number() OVER (PARTITION BY recording_id ORDER BY pos) - 1 AS n, count(*) OVER (PARTITION BY recording_id) AS c FROM samples), v AS (SELECT recording_id, n // 8 AS w, n % 8 AS k, x FROM r WHERE n // 8 < (c - 8) // 8),
d AS (SELECT a.recording_id, a.w, stddev_pop(a.x) AS sx, stddev_pop(b.x) AS sy, covar_pop(a.x, b.x) AS cv FROM v a LEFT JOIN v b ON b.recording_id = a.recording_id AND b.w = a.w - 1 AND b.k = a.k GROUP BY a.recording_id, a.w), e AS (SELECT recording_id, count(*) FILTER (sx > 0 AND sy > 0 AND cv / (sx * sy) > 0.999) AS duplicate_windows, avg((sx < 1e-5)::INT) AS frozen_window_fraction FROM d GROUP BY recording_id),
j AS (SELECT recording_id, count(*) FILTER (b AND j) AS n_jumps, CASE WHEN count(*) FILTER (b) > 0 AND count(*) > 1 THEN count(*) FILTER (b AND j)::DOUBLE / (count(*) - 1)::DOUBLE ELSE 0e0 END AS jump_fraction FROM (SELECT recording_id, coalesce(speech AND lag(speech) OVER w AND level IS NOT NULL AND lag(level) OVER w IS NOT NULL, false) AS b, coalesce(abs(level - lag(level) OVER w) >= 18, false) AS j FROM lv WINDOW w AS (PARTITION BY recording_id ORDER BY frame)) GROUP BY recording_id)
SELECT z.recording_id, zero_run_count, round(dropout_fraction, 6) AS dropout_fraction, duplicate_windows, round(frozen_window_fraction, 6) AS frozen_window_fraction, n_jumps, round(jump_fraction, 6) AS jump_fraction, round(dropout_fraction + jump_fraction + coalesce(frozen_window_fraction, 0), 6) AS continuity_break_score FROM z LEFT JOIN e USING (recording_id) LEFT JOIN j USING (recording_id)""")
def _(read):
    return quality.temporal_qc(read("samples"), _level_frames(read), BY, "pos", "x", RATE, "frame", "level", "speech")


# column roles and names

def _typed(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, typeof({c}) IN ('BIGINT', 'DOUBLE', 'INTEGER') AS typed FROM recordings"


RECORDING_COLUMNS = ["record_key", "subject_id", "task", "session_id", "recording_date", "diagnosis", "device", "severity_score", *FEATURES]
PROFILE = f"""cl AS ({' UNION ALL '.join(map(_typed, RECORDING_COLUMNS))}), pr AS (SELECT "column", count(*) AS n_rows, count(value) AS n_valid, count(DISTINCT value) AS n_distinct, bool_or(typed) OR (count(value) > 0 AND count(TRY_CAST(value AS DOUBLE)) >= 0.8e0 * count(value)) AS numeric_like FROM cl GROUP BY "column"),
ro AS (SELECT p.*, CASE WHEN "column" = 'task' THEN 'Task' WHEN "column" IN ('record_key', 'subject_id', 'session_id') THEN 'Identifier' WHEN "column" = 'recording_date' THEN 'Time / visit' WHEN regexp_matches("column", '(^|_)status($|_)|warning|flag') THEN 'Audit / status' WHEN g.feature IS NOT NULL AND numeric_like THEN 'Feature' WHEN "column" IN ('diagnosis', 'severity_score') THEN 'Target / label' WHEN "column" = 'device' THEN 'Covariate' WHEN numeric_like THEN 'Feature' WHEN n_distinct <= least(20, greatest(3, floor(0.2e0 * greatest(n_valid, 1)))) THEN 'Covariate' ELSE 'Ignore' END AS role, g.feature IS NOT NULL AS known FROM pr p LEFT JOIN registry g ON g.feature = p."column")"""


def _mapping(read):
    return columns.classify_columns(read("recordings"), "feature", read("registry"))


@query("m03_classify_columns", f"""WITH {PROFILE} SELECT "column", role, CASE role WHEN 'Task' THEN 0.96e0 WHEN 'Identifier' THEN 0.95e0 WHEN 'Time / visit' THEN 0.92e0 WHEN 'Target / label' THEN 0.9e0 WHEN 'Covariate' THEN 0.88e0 ELSE CASE WHEN known THEN 0.97e0 ELSE 0.82e0 END END AS confidence,
CASE role WHEN 'Task' THEN 'Names the task or prompt.' WHEN 'Identifier' THEN 'Identifies rows.' WHEN 'Time / visit' THEN 'Tells when: a time, visit or date.' WHEN 'Target / label' THEN 'Named like a clinical outcome.' WHEN 'Covariate' THEN 'Named like a person''s, device''s or site''s property.' ELSE CASE WHEN known THEN 'Listed in the registry given.' ELSE 'Numbers in the main table, taken as a feature.' END END AS reason,
round(1 - n_valid::DOUBLE / n_rows::DOUBLE, 6) AS missing_fraction, n_distinct AS unique_values, numeric_like FROM ro""")
def _(read):
    return _mapping(read)


@query("m03_role_summary", f"""WITH {PROFILE}, nu AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY "column") AS k FROM ro) SELECT role, count(*) AS n_columns, string_agg("column", ', ' ORDER BY "column") FILTER (k <= 8) AS example_columns FROM nu GROUP BY role""")
def _(read):
    return columns.role_summary(_mapping(read))


@query("m02_first_present", "SELECT 'severity_score' AS first, count(severity_score) AS n_valid FROM recordings")
def _(read):
    rows = read("recordings").withColumns({"Blank Score": F.lit(" nan "), "gone": F.lit(None).cast("string")})
    c = columns.first_present(rows, ["no such column", "blank score", "gone", "Severity Score", "device"])
    return rows.agg(F.lit(c).alias("first"), F.count(c).alias("n_valid"))


@query("m06_numeric_columns", f"""SELECT kind, string_agg(c, ', ' ORDER BY c) AS columns FROM (SELECT 'typed' AS kind, c FROM (VALUES {', '.join(f"('{c}')" for c in ['severity_score', *FEATURES])}) AS t(c) UNION ALL SELECT 'lenient', c FROM (SELECT 'record_text' AS c, count(TRY_CAST(CAST(record_key AS VARCHAR) AS DOUBLE)) AS n FROM recordings UNION ALL SELECT 'session_id', count(TRY_CAST(session_id AS DOUBLE)) FROM recordings UNION ALL SELECT 'flat', count(flat) FROM recordings) WHERE n > 0) GROUP BY kind""")
def _(read):
    rows = read("recordings").withColumn("record_text", F.col("record_key").cast("string"))
    made = rows.sparkSession.createDataFrame([("typed", c) for c in columns.numeric_columns(rows, ["task", "severity_score", *FEATURES, "absent"])] + [("lenient", c) for c in columns.numeric_columns(rows, ["record_text", "session_id", "flat"], lenient=True)], "kind string, c string")
    return made.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("c")), ", ").alias("columns"))


NAMES = ("total_dur", "HNR", "fft_peaks1", "F1_F2_comp", "A1P0", "f2_range")


@query("m08_feature_family", f"SELECT family, count(*) AS n FROM (SELECT CASE p_size % 6 WHEN 0 THEN 'timing_respiratory' WHEN 1 THEN 'phonatory' WHEN 2 THEN 'rhythm_ems' WHEN 3 THEN 'coordination' WHEN 4 THEN 'resonatory_nasality' ELSE 'articulatory_formant' END AS family FROM part) GROUP BY family")
def _(read):
    named = read("part").select(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_size") % 6 + 1).cast("int")).alias("name"))
    return named.groupBy(columns.feature_family_of(F.col("name")).alias("family")).agg(F.count("*").alias("n"))


@query("m10_expected_bounds", "SELECT feature, coalesce(expected_low, 0.5e0) AS expected_low, expected_high FROM registry")
def _(read):
    rows = read("registry").select("feature", F.col("expected_low").cast("string").alias("low"), F.lit("0.5").alias("min_expected"), F.lit("n/a").alias("high"), F.col("expected_high").alias("max_expected"))
    return columns.expected_bounds(rows, ["low", "min_expected"], ["high", "max_expected"]).select("feature", "expected_low", "expected_high")


@query("m12_mask_unselected", "SELECT record_key, NULL::DOUBLE AS qadd_returns, qrev_tax_max, round(qdist_heavy, 6) AS qdist_heavy FROM qc")
def _(read):
    return columns.mask_unselected(read("qc").select("record_key", "qadd_returns", "qrev_tax_max", "qdist_heavy"), ["qadd_returns", "qdist_heavy"], ["qdist_heavy"])


PATH = "'in/' || CASE user_id % 4 WHEN 0 THEN 'SUBJ' || user_id::VARCHAR || '_SESS' || (event_id % 3)::VARCHAR WHEN 1 THEN 'p' || user_id::VARCHAR ELSE 'Clip' END || CASE event_id % 5 WHEN 0 THEN '_bamboo' WHEN 1 THEN '-PA-TA' WHEN 2 THEN '_My PassageA' WHEN 3 THEN '_V2' ELSE '' END || CASE event_id % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp4' ELSE '_x.y.flac' END"


def _paths(read):
    u, e = F.col("user_id"), F.col("event_id")
    who = F.when(u % 4 == 0, F.concat(F.lit("SUBJ"), u.cast("string"), F.lit("_SESS"), (e % 3).cast("string"))).when(u % 4 == 1, F.concat(F.lit("p"), u.cast("string"))).otherwise("Clip")
    what = F.when(e % 5 == 0, "_bamboo").when(e % 5 == 1, "-PA-TA").when(e % 5 == 2, "_My PassageA").when(e % 5 == 3, "_V2").otherwise("")
    return read("events").select("event_id", F.concat(F.lit("in/"), who, what, F.when(e % 3 == 0, ".WAV").when(e % 3 == 1, ".mp4").otherwise("_x.y.flac")).alias("path"))


TASK = "CASE event_id % 5 WHEN 0 THEN 'bamboo' WHEN 1 THEN 'ddk_pa' WHEN 2 THEN 'bamboo' END"


@query("f14_parse_filename", f"""WITH p AS (SELECT event_id, user_id, {PATH} AS path, row_number() OVER (ORDER BY event_id) AS n FROM events), q AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN user_id::VARCHAR END AS s, CASE WHEN user_id % 4 = 1 THEN 'p' || user_id::VARCHAR END AS t, CASE WHEN user_id % 4 = 0 THEN (event_id % 3)::VARCHAR END AS se, CASE WHEN event_id % 5 = 3 THEN '2' END AS it, {TASK} AS ta FROM p)
SELECT event_id, coalesce(s, t, 'AUTO_SUBJECT_' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0')) AS subject_id, coalesce(se, 'SESSION01') AS session_id, coalesce(it, '1') AS iteration, coalesce(ta, 'unknown_task') AS task, concat_ws('; ', CASE WHEN s IS NULL AND t IS NOT NULL THEN 'subject_id inferred from first filename token' END, CASE WHEN s IS NULL AND t IS NULL THEN 'subject_id generated because filename parsing failed' END, CASE WHEN se IS NULL THEN 'session_id defaulted to SESSION01' END, CASE WHEN it IS NULL THEN 'iteration defaulted to 1' END, CASE WHEN ta IS NULL THEN 'task could not be parsed; set to unknown_task' END) AS metadata_notes FROM q""")
def _(read):
    return columns.parse_filename(_paths(read), "path", "event_id", subject=r"(?i)SUBJ[_-]?([0-9]+)", session=r"(?i)SESS([0-9])", iteration=r"_V([0-9]+)").drop("path")


@query("f15_normalize_task", f"SELECT event_id, coalesce({TASK}, CASE WHEN event_id % 10 = 3 THEN 'my_own_clip' END, 'bamboo') AS task, CASE WHEN event_id % 5 = 2 THEN 'ddk_pa' WHEN event_id % 5 = 0 THEN 'bamboo_passage' WHEN event_id % 5 = 1 THEN 'ddk_pa' ELSE 'unknown' END AS path_task FROM (SELECT * FROM events)")
def _(read):
    e = F.col("event_id")
    value = F.when(e % 5 == 0, "Bamboo reading").when(e % 5 == 1, "the pa").when(e % 5 == 2, "xPASSAGEx").when(e % 10 == 3, " My own clip ").otherwise(" ")
    path = F.when(e % 5 == 0, "v/Bamboo.mp4").when(e % 5 == 1, "v/papa.mp4").when(e % 5 == 2, "Passage/a.mp4").otherwise("v/x.mp4")
    return read("events").select("event_id", columns.normalize_task(value, F.lit("in/s1_bamboo_2.wav")).alias("task"), columns.path_task(path).alias("path_task"))


@query("f16_normalize_file_name", f"""WITH p AS (SELECT event_id, {PATH} AS path FROM events) SELECT event_id, regexp_extract(path, '([^/]*)$', 1) AS file_name, lower(replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), ' ', '')) AS stem_key, (CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 99 END)::BIGINT AS priority, CASE WHEN event_id % 2 = 0 THEN 'a b.wav' END AS with_extension FROM p""")
def _(read):
    named = columns.normalize_file_name(F.when(F.col("event_id") % 4 == 0, " in/a b ").when(F.col("event_id") % 4 == 2, "a b.wav").otherwise("  "), F.when(F.col("event_id") % 4 == 0, "wav").otherwise(".mp4"))
    return _paths(read).select("event_id", columns.normalize_file_name(F.col("path")).alias("file_name"), columns.stem_key(F.col("path")).alias("stem_key"), columns.extension_priority(F.col("path")).alias("priority"), named.alias("with_extension"))


@query("g01_dataset_inventory", f"""SELECT 'input' AS section, 'feature_table_rows' AS metric, count(*)::DOUBLE AS value FROM recordings UNION ALL SELECT * FROM (VALUES ('input', 'feature_table_columns', 17e0), ('roles', 'detected_feature_columns', 9e0), ('roles', 'numeric_feature_columns', 9e0), ('roles', 'detected_identifier_columns', 3e0), ('roles', 'detected_target_label_columns', 2e0), ('roles', 'detected_covariate_columns', 1e0), ('roles', 'detected_task_columns', 1e0), ('roles', 'detected_time_columns', 1e0)) AS t(section, metric, value) UNION ALL SELECT 'design', 'unique_subjects', count(DISTINCT subject_id) FROM recordings UNION ALL SELECT 'design', 'unique_sessions', count(DISTINCT session_id) FROM recordings UNION ALL SELECT 'design', 'unique_tasks', count(DISTINCT task) FROM recordings UNION ALL SELECT 'data_quality', 'mean_feature_missingness', round(({' + '.join(f'avg(({c} IS NULL)::INT)' for c in FEATURES)}) / 9e0, 4) FROM recordings""")
def _(read):
    return columns.dataset_inventory(read("recordings"), columns.role_lists(_mapping(read)), "subject_id", "session_id", "task")


@query("q38_screening_catalog", f"""WITH {PROFILE} SELECT "column" AS variable, role AS mapped_role, CASE WHEN n_valid < 6 OR n_distinct < 2 THEN 'insufficient' WHEN "column" IN ('subject_id', 'record_key', 'severity_score') AND n_distinct > 10 THEN 'continuous_outcome' WHEN n_distinct <= 20 THEN 'categorical_group' ELSE 'high_cardinality_skip' END AS screening_type, "column" = 'severity_score' AS "numeric", n_valid, n_distinct AS n_unique, round(1 - n_valid::DOUBLE / n_rows::DOUBLE, 6) AS missing_fraction FROM ro WHERE "column" IN ('task', 'session_id', 'recording_date', 'diagnosis', 'device', 'severity_score')""")
def _(read):
    return columns.screening_catalog(read("recordings"), _mapping(read), FEATURES)


@query("g03_feature_family_overview", f"WITH x AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, count({c}) AS k, count(*) AS n FROM recordings''' for c in FEATURES)}) SELECT coalesce(family, 'unclassified') AS family, count(*) AS n_features, count(*) AS n_numeric_features, round(avg(1 - k::DOUBLE / n::DOUBLE), 6) AS mean_missing_fraction, round(quantile_cont(k, 0.5), 6) AS median_nonmissing FROM x LEFT JOIN registry USING (feature) GROUP BY ALL")
def _(read):
    return aggregates.feature_family_overview(long_form(read("recordings"), "record_key", FEATURES), read("registry"))


MEDIA = "md AS (SELECT event_id AS video_id, '.' || CASE event_id % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'webm' ELSE 'mov' END AS extension, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'h26' || (event_id % 2 + 4)::VARCHAR END AS codec_name, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 640 END AS width, 480 AS height, 25e0 + user_id % 6 AS fps, round(value, 4) AS duration_sec, event_id % 1000 AS n_frames, CASE WHEN event_type = 'error' THEN 'warning' ELSE 'pass' END AS status, CASE WHEN user_id % 7 = 0 THEN 'odd rate' ELSE ' ' END AS warning FROM events)"


def _media(read):
    e = F.col("event_id")
    return read("events").select(
        e.alias("video_id"), F.when(e % 3 == 0, ".mp4").when(e % 3 == 1, ".webm").otherwise(".mov").alias("extension"), F.when(e % 4 != 0, F.concat(F.lit("h26"), (e % 2 + 4).cast("string"))).alias("codec_name"), F.when(e % 6 != 0, 640).alias("width"), F.lit(480).alias("height"),
        (25.0 + F.col("user_id") % 6).alias("fps"), F.round("value", 4).alias("duration_sec"), (e % 1000).alias("n_frames"), F.when(F.col("event_type") == "error", "warning").otherwise("pass").alias("status"), F.when(F.col("user_id") % 7 == 0, "odd rate").otherwise(" ").alias("warning"),
    )


@query("g13_format_summary", f"WITH {MEDIA} SELECT extension, codec_name, CASE WHEN width IS NULL THEN 'unknown' ELSE width::VARCHAR || ' x ' || height::VARCHAR END AS resolution, count(*) AS files, round(quantile_cont(fps, 0.5), 6) AS median_fps, round(quantile_cont(duration_sec, 0.5), 6) AS median_duration_sec, sum(n_frames)::BIGINT AS estimated_frames, count(*) FILTER (status <> 'pass' OR trim(warning) <> '') AS warnings FROM md GROUP BY ALL")
def _(read):
    return aggregates.format_summary(_media(read), ["extension", "codec_name"])


@query("g13_ingest_summary", f"WITH {MEDIA} SELECT 'REVIEW' AS readiness, count(*) AS n_videos, count(*) FILTER (status = 'pass') AS readable_videos, count(*) FILTER (status <> 'pass' OR trim(warning) <> '') AS warning_videos, count(*) FILTER (status <> 'pass') AS unreadable_videos, sum(n_frames)::BIGINT AS total_frames, round(quantile_cont(fps, 0.5), 6) AS median_fps, min(fps) AS min_fps, max(fps) AS max_fps, round(quantile_cont(duration_sec, 0.5), 6) AS median_duration_sec, round(sum(duration_sec::DECIMAL(18,4))::DOUBLE, 2) AS total_duration_sec FROM md")
def _(read):
    found = aggregates.ingest_summary(_media(read).withColumn("duration_sec", F.col("duration_sec").cast("decimal(18,4)")))
    return found.withColumn("total_duration_sec", F.round(F.col("total_duration_sec").cast("double"), 2))


@query("g14_warning_rows", f"WITH {MEDIA} SELECT video_id, status, warning FROM md WHERE status <> 'pass' OR trim(warning) <> ''")
def _(read):
    return aggregates.warning_rows(_media(read)).select("video_id", "status", "warning")


@query("g16_feature_completion", f"WITH x AS ({' UNION ALL '.join(f'SELECT record_key, {c} IS NOT NULL AS ok FROM recordings' for c in FEATURES)}) SELECT record_key, count(*) AS selected_feature_values, count(*) FILTER (ok) AS computed_feature_values, round(count(*) FILTER (ok)::DOUBLE / count(*)::DOUBLE, 6) AS feature_completion_fraction FROM x GROUP BY record_key")
def _(read):
    status = long_form(read("recordings"), "record_key", FEATURES).select("record_key", "feature", F.when(F.col("value").isNotNull(), "computed").otherwise("missing").alias("status"))
    return aggregates.feature_completion(status, ["record_key"])


@query("g18_status_counts", "SELECT task, device AS status, count(*) AS n FROM recordings GROUP BY ALL")
def _(read):
    return aggregates.status_counts(read("recordings").withColumnRenamed("device", "status"), ["task", "status"])


@query("w12_velocity_stats", """WITH v AS (SELECT recording_id, frame, value, time_s - lag(time_s) OVER w AS d, time_s FROM frames WHERE value IS NOT NULL WINDOW w AS (PARTITION BY recording_id ORDER BY frame)), u AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS c, lag(value, 2, 0) OVER w AS a1, lag(value, 1, 0) OVER w AS a2, lead(value, 1, 0) OVER w AS a3, lead(value, 2, 0) OVER w AS a4 FROM v WHERE d IS NULL OR d > 1e-9 WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
s AS (SELECT recording_id, frame, time_s, c, CASE WHEN c >= 5 THEN list_sort([a1, a2, value, a3, a4])[3] ELSE value END AS v FROM u), g AS (SELECT *, lag(v) OVER w AS v0, lead(v) OVER w AS v1, time_s - lag(time_s) OVER w AS a, lead(time_s) OVER w - time_s AS b FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
h AS (SELECT recording_id, -(CASE WHEN a IS NULL THEN (v1 - v) / b WHEN b IS NULL THEN (v - v0) / a ELSE (a * a * v1 + (b * b - a * a) * v - b * b * v0) / (a * b * (a + b)) END) AS z FROM g WHERE c >= 3)
SELECT recording_id, round(quantile_cont(z, 0.5), 5) + 0e0 AS median, round(quantile_cont(z, 0.05), 5) + 0e0 AS p05, round(quantile_cont(z, 0.95), 5) + 0e0 AS p95, round(quantile_cont(z, 0.95) - quantile_cont(z, 0.05), 5) AS p05_p95 FROM h WHERE abs(z) <= 20000 GROUP BY recording_id""", digits=5)
def _(read):
    return spectra.velocity_stats(read("frames"), BY, "frame", "value", "time_s")


@query("w35_qc_change", "WITH r AS (SELECT q.record_key, subject_id, recording_date, task, qgain_speech_rms_db_std AS v FROM quality q JOIN recordings USING (record_key)), b AS (SELECT record_key, v, first_value(v IGNORE NULLS) OVER (PARTITION BY subject_id, task ORDER BY recording_date, record_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, stddev_samp(v) OVER (PARTITION BY task) AS s FROM r) SELECT record_key, round(v - f, 6) AS change, round((v - f) / CASE WHEN s > 0 THEN s END, 6) AS standardized_change FROM b")
def _(read):
    rows = read("quality").join(read("recordings").select("record_key", "subject_id", "recording_date", "task"), "record_key")
    return windows.baseline_change(rows, ["subject_id", "task"], ["recording_date", "record_key"], "qgain_speech_rms_db_std", ["task"]).select("record_key", "change", "standardized_change")


@query("w35_manual_qc_change", "WITH r AS (SELECT record_key, subject_id, recording_date, task, CASE device WHEN 'O' THEN 1e0 WHEN 'F' THEN 0e0 END AS v FROM recordings), b AS (SELECT record_key, v, first_value(v IGNORE NULLS) OVER (PARTITION BY subject_id, task ORDER BY recording_date, record_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM r) SELECT record_key, v AS flag, v - f AS change FROM b")
def _(read):
    rows = read("recordings").withColumn("answer", F.when(F.col("device") == "O", " Yes").when(F.col("device") == "F", "no").otherwise("unsure"))
    return windows.manual_qc_change(rows, ["subject_id", "task"], ["recording_date", "record_key"], "answer").select("record_key", "flag", "change")
