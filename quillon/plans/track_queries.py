"""Queries of the operators on spectra, tracks and landmarks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import landmarks, scans, spectra
from quillon.plans.audit_queries import _R, query
from quillon.plans.signal_queries import BY, EXTREMA, _grad
from quillon.plans.views import POINTS

W = "OVER (PARTITION BY recording_id ORDER BY frame)"

def _scaled_first(df, digits: int):
    """Doubles scaled before rounding, as DuckDB rounds: means of a few values with two decimals often tie."""
    return df.withColumns({c: F.round(F.col(c) * 10.0**digits) / 10.0**digits for c, t in df.dtypes if t == "double"})


# A spectrum of some 66 bins, 5 Hz apart, per recording.
SP = "sp AS (SELECT recording_id, frame * 5e0 AS f, coalesce(value, 0e0) + 1 AS p FROM frames)"


def _spectrum(read):
    return read("frames").select("recording_id", (F.col("frame") * 5.0).alias("f"), (F.coalesce("value", F.lit(0.0)) + 1).alias("p"))


BANDS = {"low": (0.0, 100.0), "mid": (100.0, 200.0), "high": (200.0, 1000.0), "hum50": (48.0, 52.0), "none": (9000.0, 9100.0)}
ARRAY = f"{SP}, ba AS (SELECT *, lag(f) OVER w AS f0, (p + lag(p) OVER w) / 2 * (f - lag(f) OVER w) AS a FROM sp WINDOW w AS (PARTITION BY recording_id ORDER BY f))"


@query("x12_band_shares", f"WITH {ARRAY} SELECT recording_id, {', '.join(f'round(CASE WHEN count(*) FILTER (f >= {a} AND f < {b}) > 0 THEN coalesce(sum(a) FILTER (f >= {a} AND f < {b} AND f0 >= {a} AND f0 < {b}), 0) / sum(a) END, 6) AS {n}' for n, (a, b) in BANDS.items())} FROM ba GROUP BY recording_id")
def _(read):
    return spectra.band_shares(_spectrum(read), BY, "f", "p", BANDS)


@query("x13_bandwidth", f"WITH {SP} SELECT recording_id, max(f) FILTER (p >= 0.6e0 * m) AS bandwidth FROM (SELECT *, max(p) OVER (PARTITION BY recording_id) AS m FROM sp) GROUP BY recording_id")
def _(read):
    return spectra.bandwidth_at(_spectrum(read), BY, "f", "p", 0.6)


def _lines(base: int) -> str:
    return f"(VALUES {', '.join(f'({base}, {h}e0)' for h in range(base, 301, base))})"


FINE = "fi AS (SELECT recording_id, frame * 2e0 + 40 AS f, coalesce(value, 0e0) AS p FROM frames)"


@query("x14_powerline_flags", f"""WITH {FINE}, ln AS (SELECT * FROM {_lines(50)} AS t(base, line) UNION ALL SELECT * FROM {_lines(60)} AS t(base, line)), nr AS (SELECT recording_id, base, line, f, 10 * log10(p + 1e-20) AS l FROM fi JOIN ln ON abs(f - line) <= 5), pl AS (SELECT recording_id, base, line, count(*) AS n, quantile_cont(l, 0.5) AS med, (list(l ORDER BY abs(f - line), f))[1] AS at_ FROM nr GROUP BY ALL)
SELECT r.recording_id, coalesce(bool_or(n > 3 AND at_ - med > 10) FILTER (base = 50), false) AS powerline_50hz, coalesce(bool_or(n > 3 AND at_ - med > 10) FILTER (base = 60), false) AS powerline_60hz FROM (SELECT DISTINCT recording_id FROM fi) r LEFT JOIN pl USING (recording_id) GROUP BY r.recording_id""")
def _(read):
    fine = read("frames").select("recording_id", (F.col("frame") * 2.0 + 40).alias("f"), F.coalesce("value", F.lit(0.0)).alias("p"))
    return spectra.powerline_flags(fine, BY, "f", "p")


MODULATION = """en AS (SELECT recording_id, frame, coalesce(value, 0e0) AS x FROM frames), e1 AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY recording_id) AS n, x - avg(x) OVER (PARTITION BY recording_id) AS x FROM en),
e2 AS (SELECT recording_id, k, n, x * CASE WHEN k < 0.125e0 * (n - 1) THEN 0.5e0 * (1 + cos(pi() * (k / (0.125e0 * (n - 1)) - 1))) WHEN n - 1 - k < 0.125e0 * (n - 1) THEN 0.5e0 * (1 + cos(pi() * ((n - 1 - k) / (0.125e0 * (n - 1)) - 1))) ELSE 1e0 END AS x FROM e1),
e3 AS (SELECT recording_id, n, k, x, unnest(range(1, least(floor(n / 2e0), floor(10e0 * n / 25e0 + 1e-9))::BIGINT + 1)) AS j FROM e2), mo AS (SELECT recording_id, j * 25e0 / n AS frequency, sqrt(pow(sum(x * cos(2 * pi() * ((k * j) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((k * j) % n) / n)), 2)) AS amplitude FROM e3 GROUP BY recording_id, n, j)"""


def _modulation(read):
    envelope = read("frames").select("recording_id", "frame", F.coalesce("value", F.lit(0.0)).alias("x"))
    return spectra.modulation_spectrum(envelope, BY, "frame", "x", 25.0)


@query("x15_modulation_spectrum", f"WITH {MODULATION} SELECT recording_id, {_R('frequency')}, round(amplitude, 4) AS amplitude FROM mo")
def _(read):
    return _modulation(read).withColumn("amplitude", F.round("amplitude", 4))


@query("x16_modulation_features", f"""WITH {MODULATION}, sh AS (SELECT recording_id, coalesce(sum(amplitude * amplitude) FILTER (frequency < 4), 0) / sum(amplitude * amplitude) AS below, coalesce(sum(amplitude * amplitude) FILTER (frequency >= 4 AND frequency < 10), 0) / sum(amplitude * amplitude) AS above, coalesce(sum(amplitude * amplitude) FILTER (frequency >= 3 AND frequency < 6), 0) / sum(amplitude * amplitude) AS mid FROM mo GROUP BY recording_id),
pk AS (SELECT *, lag(amplitude) OVER w < amplitude AND lead(amplitude) OVER w < amplitude AS peak FROM mo WHERE frequency >= 0.5 WINDOW w AS (PARTITION BY recording_id ORDER BY frequency)), an AS (SELECT *, bool_or(coalesce(peak, false)) OVER (PARTITION BY recording_id) AS any_ FROM pk), tp AS (SELECT recording_id, frequency, amplitude, row_number() OVER (PARTITION BY recording_id ORDER BY amplitude DESC, frequency DESC) AS k FROM an WHERE coalesce(peak, false) OR NOT any_)
SELECT sh.recording_id, {_R('below', 'above')}, round(mid, 6) AS from_3_to_6, round(below / nullif(above, 0), 6) AS below_above, round(max(frequency) FILTER (k = 1), 6) AS peak1_hz, round(max(frequency) FILTER (k = 2), 6) AS peak2_hz, round(max(amplitude * amplitude) FILTER (k = 1), 2) AS peak1_power, round(max(amplitude * amplitude) FILTER (k = 2), 2) AS peak2_power FROM sh LEFT JOIN tp ON tp.recording_id = sh.recording_id AND k <= 2 GROUP BY sh.recording_id, below, above, mid""")
def _(read):
    found = spectra.modulation_features(_modulation(read), BY)
    return found.withColumns({c: F.round(c, 2) for c in ("peak1_power", "peak2_power")})


# Tracks of five formants and of a voice.
TRACKS = "tk AS (SELECT recording_id, frame, " + ", ".join(f"CASE WHEN frame % {7 + k} = 3 THEN NULL ELSE {a}e0 + coalesce(value, 0e0) * {b}e0 END AS f{k}, 5e0 + coalesce(value, 5e1) * {c}e0 AS bw{k}" for k, (a, b, c) in enumerate(((100, 6, 4), (700, 20, 5), (1500, 15, 6), (3000, 10, 8), (4000, 9, 9)), 1)) + " FROM frames)"


def _formants(read):
    v, n = F.col("value"), F.col("frame")
    made = {}
    for k, (a, b, c) in enumerate(((100, 6, 4), (700, 20, 5), (1500, 15, 6), (3000, 10, 8), (4000, 9, 9)), 1):
        made |= {f"f{k}": F.when(n % (7 + k) != 3, a + F.coalesce(v, F.lit(0.0)) * float(b)), f"bw{k}": 5 + F.coalesce(v, F.lit(50.0)) * float(c)}
    return read("frames").select("recording_id", "frame", *[x.alias(c) for c, x in made.items()])


FINE_TRACKS = f"{TRACKS}, ok AS (SELECT recording_id, frame, " + ", ".join(f"CASE WHEN f{k} BETWEEN {a} AND {b} AND bw{k} BETWEEN {c} AND {d} THEN f{k} END AS f{k}, CASE WHEN f{k} BETWEEN {a} AND {b} AND bw{k} BETWEEN {c} AND {d} THEN bw{k} END AS bw{k}" for k, ((a, b), (c, d)) in enumerate(zip(spectra.FORMANT_RANGES, spectra.BANDWIDTH_RANGES, strict=True), 1)) + " FROM tk)"


@query("x18_formant_summary", f"WITH {FINE_TRACKS} SELECT recording_id, {', '.join(f'round(avg(f{k}), 5) AS f{k}, round(quantile_cont(bw{k}, 0.5), 5) AS f{k}_bw' for k in range(1, 6))}, {', '.join(f'round(CASE WHEN count(f{k}) >= 2 THEN max(f{k}) - min(f{k}) END, 5) AS f{k}_range' for k in (1, 2, 3))}, round(avg((f1 IS NOT NULL AND f2 IS NOT NULL)::INT), 5) AS valid_fraction, CASE WHEN avg((f1 IS NOT NULL AND f2 IS NOT NULL)::INT) < 0.35 THEN 'low_validity' ELSE 'computed' END AS status FROM ok GROUP BY recording_id", digits=5)
def _(read):
    return _scaled_first(spectra.formant_summary(_formants(read), BY, "frame"), 5)


@query("x19_phonatory_summary", "WITH v AS (SELECT recording_id, detected AND frame % 6 = 0 AS voiced, 80 + value AS f0, value / 4 AS cpp, value / 8 AS hnr, 90 + value AS h1f, -value AS h1a, 180 + value AS h2f, -2 * value AS h2a FROM frames) SELECT recording_id, round(avg(f0) FILTER (voiced), 6) AS f0_mean, round(avg(cpp) FILTER (voiced), 6) AS cpp_mean, round(avg(hnr) FILTER (voiced), 6) AS hnr, round(avg(h1f) FILTER (voiced), 6) AS h1_freq, round(avg(h1a) FILTER (voiced), 6) AS h1_amp, round(avg(h2f) FILTER (voiced), 6) AS h2_freq, round(avg(h2a) FILTER (voiced), 6) AS h2_amp, round(stddev_pop(f0) FILTER (voiced), 6) AS f0_sd, round(avg(voiced::INT), 6) AS voice_fraction, CASE WHEN count(f0) FILTER (voiced) >= 5 THEN 'computed' ELSE 'computed_with_warning' END AS status FROM v GROUP BY recording_id")
def _(read):
    v = F.col("value")
    rows = read("frames").select("recording_id", (F.col("detected") & (F.col("frame") % 6 == 0)).alias("voiced"), (80 + v).alias("f0"), (v / 4).alias("cpp"), (v / 8).alias("hnr"), (90 + v).alias("h1_freq"), (-v).alias("h1_amp"), (180 + v).alias("h2_freq"), (-2 * v).alias("h2_amp"))
    return _scaled_first(spectra.phonatory_summary(rows, BY), 6)


# Spectra of 60 bins, 60 Hz apart, three to a recording.
NS = "ns AS (SELECT recording_id, frame % 3 AS fr, 100 + floor(frame / 3) * 60e0 + 40 * (frame % 3) AS f, coalesce(value, 0e0) / 4 AS l FROM frames UNION ALL SELECT recording_id, frame % 3, 1500 + floor(frame / 3) * 60e0, coalesce(value, 1e1) / 5 FROM frames WHERE frame < 100)"


def _nasal(read):
    n, v = F.col("frame"), F.col("value")
    one = read("frames").select("recording_id", (n % 3).alias("fr"), (100 + F.floor(n / 3) * 60.0 + 40 * (n % 3)).alias("f"), (F.coalesce(v, F.lit(0.0)) / 4).alias("l"))
    two = read("frames").where("frame < 100").select("recording_id", (n % 3).alias("fr"), (1500 + F.floor(n / 3) * 60.0).alias("f"), (F.coalesce(v, F.lit(10.0)) / 5).alias("l"))
    return one.unionByName(two)


KEY = ["recording_id", "fr"]


def _peak(name: str, low: str, high: str, source: str = "ns") -> str:
    return f"{name} AS (SELECT recording_id, fr, f AS {name}_hz, l AS {name}_db FROM {source} WHERE f >= {low} AND f <= {high} QUALIFY row_number() OVER (PARTITION BY recording_id, fr ORDER BY l DESC, f) = 1)"


@query("x20_peaks_in_bands", f"WITH {NS}, {_peak('p0', '180', '500')}, {_peak('f2', '800', '2600')} SELECT b.recording_id, b.fr, p0_hz, round(p0_db, 6) AS p0_db, f2_hz, round(f2_db, 6) AS f2_db FROM (SELECT DISTINCT recording_id, fr FROM ns) b LEFT JOIN p0 USING (recording_id, fr) LEFT JOIN f2 USING (recording_id, fr)")
def _(read):
    return spectra.peaks_in_bands(_nasal(read), KEY, "f", "l", {k: spectra.NASAL_BANDS[k] for k in ("p0", "f2")})


@query("x20_peak_shape", f"WITH {NS}, {_peak('f2', '800', '2600')}, s AS (SELECT recording_id, fr, any_value(f2_db) AS db, count(*) FILTER (abs(f - f2_hz) > 45) AS n, quantile_cont(l, 0.5) FILTER (abs(f - f2_hz) > 45) AS med, count(*) AS bins, max(f) FILTER (l <= f2_db - 3 AND f <= f2_hz) AS le, min(f) FILTER (l <= f2_db - 3 AND f >= f2_hz) AS ri FROM ns JOIN f2 USING (recording_id, fr) WHERE f BETWEEN 800 AND 2600 GROUP BY recording_id, fr) SELECT recording_id, fr, round(CASE WHEN n >= 3 THEN db - med END, 6) AS prominence, CASE WHEN bins >= 5 AND ri > le THEN ri - le END AS width FROM s")
def _(read):
    rows = _nasal(read)
    return spectra.peak_shape(rows, spectra.peaks_in_bands(rows, KEY, "f", "l", {"f2": (800.0, 2600.0)}), KEY, "f", "l", "f2_hz", "f2_db", F.lit(800.0), F.lit(2600.0))


NASAL = f"""{NS}, {_peak('p0', '180', '500')}, {_peak('p1', '790', '1100')}, {_peak('f2', '800', '2600')}, {_peak('f3', '1800', '3600')}, nm AS (SELECT ns.*, greatest(250e0, coalesce(p0_hz + 100, 250e0)) AS st FROM ns LEFT JOIN p0 USING (recording_id, fr)), {_peak('fo', 'st', '1100', 'nm')}, {_peak('fw', '250', '1100')},
nr AS (SELECT p0.recording_id, p0.fr, p0_hz, p0_db, p1_db, coalesce(fo_hz, fw_hz) AS f1_hz, f2_hz, f2_db, f3_hz, greatest(250e0, p0_hz + 100) AS st FROM p0 JOIN p1 USING (recording_id, fr) JOIN f3 USING (recording_id, fr) JOIN fw USING (recording_id, fr) LEFT JOIN fo USING (recording_id, fr) LEFT JOIN f2 USING (recording_id, fr)),
am AS (SELECT nr.recording_id, nr.fr, max(l) FILTER (f BETWEEN greatest(0, f1_hz - 50) AND f1_hz + 50) AS a1, max(l) FILTER (f BETWEEN greatest(0, f3_hz - 50) AND f3_hz + 50) AS a3 FROM nr JOIN ns USING (recording_id, fr) GROUP BY ALL), na AS (SELECT nr.*, a1, a3 FROM nr JOIN am USING (recording_id, fr)),
wd AS (SELECT na.recording_id, na.fr, CASE WHEN count(*) >= 5 AND min(f) FILTER (l <= a1 - 3 AND f >= f1_hz) > max(f) FILTER (l <= a1 - 3 AND f <= f1_hz) THEN min(f) FILTER (l <= a1 - 3 AND f >= f1_hz) - max(f) FILTER (l <= a1 - 3 AND f <= f1_hz) END AS f1_width FROM na JOIN ns USING (recording_id, fr) WHERE f >= st AND f <= 1100 GROUP BY ALL),
nf AS (SELECT na.recording_id, na.fr, p0_hz, p0_db, p1_db, f1_hz, a1 AS f1_db, f1_width, f2_hz, f2_db, f3_hz, a3 AS f3_db, a1 - p0_db AS a1p0, a1 - p0_db - coalesce(greatest(-1, least(2, (f1_width - 120) / 120)), 0) AS a1p0_comp, a1 - p1_db AS a1p1, a1 - p1_db - coalesce(greatest(-1, least(2, (f1_width - 120) / 120)), 0) AS a1p1_comp, a3 - p0_db AS a3p0 FROM na LEFT JOIN wd USING (recording_id, fr))"""
NASAL_COLUMNS = ("p0_hz", "p0_db", "p1_db", "f1_hz", "f1_db", "f1_width", "f2_hz", "f2_db", "f3_hz", "f3_db", "a1p0", "a1p0_comp", "a1p1", "a1p1_comp", "a3p0")


@query("x21_nasality_frames", f"WITH {NASAL} SELECT recording_id, fr, {_R(*NASAL_COLUMNS)} FROM nf")
def _(read):
    return spectra.nasality_frames(_nasal(read), KEY, "f", "l")


@query("x21_nasality_contrasts", f"WITH {NASAL}, tot AS (SELECT recording_id, count(DISTINCT fr) AS n FROM ns GROUP BY recording_id), md AS (SELECT recording_id, {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in NASAL_COLUMNS)}, count(*) AS k, avg((abs(p0_hz - f1_hz) < 100)::INT) AS ov FROM nf GROUP BY recording_id) SELECT recording_id, {_R(*NASAL_COLUMNS)}, round(coalesce(k, 0)::DOUBLE / greatest(n, 1)::DOUBLE, 6) AS valid_fraction, round(coalesce(ov, 0), 6) AS overlap_fraction, CASE WHEN coalesce(k, 0)::DOUBLE / greatest(n, 1)::DOUBLE < 0.25 THEN 'low_validity' WHEN ov > 0.35 THEN 'computed_with_warnings' ELSE 'computed' END AS status FROM tot LEFT JOIN md USING (recording_id)")
def _(read):
    rows = _nasal(read)
    return spectra.nasality_contrasts(spectra.nasality_frames(rows, KEY, "f", "l").drop("fr"), BY, rows.groupBy("recording_id").agg(F.count_distinct("fr").alias("n")))


FILLED = """xa AS (SELECT recording_id, frame, value AS v, last_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS pn, first_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qn, last_value(value IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS pv, first_value(value IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qv FROM frames),
xl AS (SELECT recording_id, frame, coalesce(v, pv + (qv - pv) * (frame - pn)::DOUBLE / CASE WHEN qn > pn THEN (qn - pn)::DOUBLE END, pv, qv) AS v FROM xa)"""


@query("w30_max_xcorr", f"""WITH {FILLED}, b0 AS (SELECT recording_id, frame, v AS a, abs(v - 50) AS b FROM xl), b1 AS (SELECT recording_id, frame, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM b0 WINDOW w AS (PARTITION BY recording_id)), dn AS (SELECT recording_id, sqrt(sum(a * a) * sum(b * b)) AS d FROM b1 GROUP BY recording_id),
lg AS (SELECT x.recording_id, y.frame - x.frame AS lag_, sum(x.a * y.b) AS s FROM b1 x JOIN b1 y ON y.recording_id = x.recording_id GROUP BY ALL) SELECT recording_id, round(max(s) / any_value(d), 6) AS max_xcorr FROM lg JOIN dn USING (recording_id) GROUP BY recording_id""")
def _(read):
    rows = spectra.interpolate_linear(read("frames").select("recording_id", "frame", F.col("value").alias("a")), BY, "frame", "a").withColumn("b", F.abs(F.col("a") - 50))
    return spectra.max_cross_correlation(rows, BY, "frame", "a", "b")


LAGS = 2
CO = "ct AS (SELECT recording_id, frame, value AS x, CASE WHEN frame % 19 = 4 THEN NULL ELSE abs(coalesce(value, 0e0) - 50) + frame % 7 END AS y FROM frames)"


def _fill2(v: str, n: str) -> str:
    """Gaps of up to LAGS filled, then robustly scaled."""
    f = lambda k: f"last_value({k} IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING)"
    g = lambda k: f"first_value({k} IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"(CASE WHEN {v} IS NOT NULL THEN frame END)"
    return f"""{n}a AS (SELECT recording_id, frame, {v} AS v, {f(at)} AS pn, {g(at)} AS qn, {f(v)} AS pv, {g(v)} AS qv, max(frame) OVER (PARTITION BY recording_id) AS mx, count({v}) OVER (PARTITION BY recording_id) AS k FROM ct), {n}b AS (SELECT recording_id, frame, CASE WHEN v IS NOT NULL THEN v WHEN coalesce(qn, mx + 1) - coalesce(pn, 0) - 1 <= {LAGS} AND k >= 3 THEN coalesce(pv + (qv - pv) * (frame - pn)::DOUBLE / CASE WHEN qn > pn THEN (qn - pn)::DOUBLE END, pv, qv) END AS v FROM {n}a),
{n}c AS (SELECT recording_id, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, stddev_pop(v) AS sd FROM {n}b GROUP BY recording_id), {n} AS (SELECT recording_id, frame, (v - med) / CASE WHEN iqr > 1e-9 THEN iqr / 1.349e0 WHEN sd > 1e-9 THEN sd END AS v FROM {n}b JOIN {n}c USING (recording_id))"""


_NAMES = [f"{c}{k}" for c in "xy" for k in range(2 * LAGS + 1)]
_SHIFT = ", ".join(f"{'lead' if k - LAGS > 0 else 'lag'}({c}, {abs(k - LAGS)}) OVER w AS {c}{k}" for c in "xy" for k in range(2 * LAGS + 1))
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i:]]
LAGGED = f"""{CO}, {_fill2('x', 'cx')}, {_fill2('y', 'cy')}, cz AS (SELECT recording_id, frame, cx.v AS x, cy.v AS y FROM cx JOIN cy USING (recording_id, frame)), cl AS (SELECT recording_id, {_SHIFT} FROM cz WINDOW w AS (PARTITION BY recording_id ORDER BY frame)), cf AS (SELECT * FROM cl WHERE {' AND '.join(f'{n} IS NOT NULL' for n in _NAMES)}),
cm AS (SELECT recording_id, count(*) AS n, {', '.join(f'corr({a}, {b}) AS {a}_{b}' for a, b in _PAIRS)} FROM cf GROUP BY recording_id HAVING count(*) >= {len(_NAMES) + 2}), cr AS (UNPIVOT cm ON COLUMNS(* EXCLUDE (recording_id, n)) INTO NAME k VALUE r)"""


def _tracks(read):
    n, v = F.col("frame"), F.col("value")
    return read("frames").select("recording_id", "frame", v.alias("x"), F.when(n % 19 != 4, F.abs(F.coalesce(v, F.lit(0.0)) - 50) + n % 7).alias("y"))


@query("w31_lagged_correlations", f"WITH {LAGGED} SELECT recording_id, split_part(k, '_', 1) AS row_1, split_part(k, '_', 2) AS row_2, round(r, 5) + 0e0 AS r FROM cr", digits=5)
def _(read):
    rows = _tracks(read)
    for c in ("x", "y"):
        rows = spectra.robust_scaled(spectra.interpolate_linear(rows, BY, "frame", c, max_gap=LAGS), BY, c)
    return spectra.lagged_correlations(rows, BY, "frame", "x", "y", LAGS)


# Three tracks of long recordings, at the reference's reach of 250 ms in steps of 10.
FAR = 25
_FAR_TRACKS = {"t1": "value", "t2": "abs(value - 50) + frame % 7", "t3": "value * (frame % 5) + frame % 11"}
LONG_FRAMES = "nf AS (SELECT recording_id % 3 AS recording_id, row_number() OVER (PARTITION BY recording_id % 3 ORDER BY recording_id, frame) AS frame, coalesce(value, 5e1) AS value FROM frames), tt AS (SELECT recording_id, frame, " + ", ".join(f"{x} AS {c}" for c, x in _FAR_TRACKS.items()) + " FROM nf)"


def _far_sql(a: str, b: str) -> str:
    """Correlations of a and b at all lags, pair by pair of long rows, as fc_<a><b>."""
    n = f"{a}{b}"
    scaled = lambda c: f"({c} - quantile_cont({c}, 0.5) OVER w) / (quantile_cont({c}, 0.75) OVER w - quantile_cont({c}, 0.25) OVER w) * 1.349e0"
    return f"""fs_{n} AS (SELECT recording_id, frame, count(*) OVER w AS n, {scaled(a)} AS x, {scaled(b)} AS y FROM tt WINDOW w AS (PARTITION BY recording_id)),
fl_{n} AS (SELECT recording_id, frame - lag_ AS t, CASE WHEN k = 0 THEN 'x' ELSE 'y' END || (lag_ + {FAR}) AS name, k * 1000 + lag_ AS ord, CASE WHEN k = 0 THEN x ELSE y END AS v FROM fs_{n}, (SELECT unnest(range(-{FAR}, {FAR + 1})) AS lag_), (SELECT unnest([0, 1]) AS k) WHERE frame - lag_ BETWEEN {FAR + 1} AND n - {FAR}),
fc_{n} AS (SELECT p.recording_id, p.name AS row_1, q.name AS row_2, corr(p.v, q.v) AS r FROM fl_{n} p JOIN fl_{n} q ON q.recording_id = p.recording_id AND q.t = p.t AND p.ord <= q.ord GROUP BY ALL)"""


def _far_tracks(read):
    rows = read("frames").select((F.col("recording_id") % 3).alias("group"), "recording_id", "frame", F.coalesce("value", F.lit(50.0)).alias("value"))
    # a long recording: a third of all frames each
    rows = scans.end_to_end(rows, ["group"], ["recording_id"], "frame", "at").select(F.col("group").alias("recording_id"), F.col("at").alias("frame"), "value")
    return rows.select("recording_id", "frame", *[F.expr(x).alias(c) for c, x in _FAR_TRACKS.items()])


@query("w31_lagged_correlations_far", f"WITH {LONG_FRAMES}, {_far_sql('t1', 't2')} SELECT recording_id, row_1, row_2, round(r, 5) + 0e0 AS r FROM fc_t1t2", digits=5)
def _(read):
    rows = _far_tracks(read)
    for c in ("t1", "t2"):
        rows = spectra.robust_scaled(rows, BY, c, long=True)
    return spectra.lagged_correlations(rows, BY, "frame", "t1", "t2", FAR, place="frame")


_FAR_PAIRS = [("t1", "t2"), ("t1", "t3"), ("t2", "t3")]
_FAR_RATIOS = " UNION ALL ".join(f"SELECT recording_id, '{a}_{b}' AS pair, round(count(*) FILTER (row_1 = row_2) / sum(CASE WHEN row_1 = row_2 THEN r * r ELSE 2 * r * r END), 6) AS complexity, 1e0 AS pair_valid, 'computed' AS status FROM fc_{a}{b} GROUP BY recording_id" for a, b in _FAR_PAIRS)


@query("x23_coordination_far", f"WITH {LONG_FRAMES}, {', '.join(_far_sql(a, b) for a, b in _FAR_PAIRS)} {_FAR_RATIOS}")
def _(read):
    return spectra.coordination(_far_tracks(read), BY, "frame", _FAR_PAIRS, FAR, rows=100_000)


PART = f"{LAGGED}, pr AS (SELECT recording_id, count(*) FILTER (split_part(k, '_', 1) = split_part(k, '_', 2)) AS m, sum(CASE WHEN split_part(k, '_', 1) = split_part(k, '_', 2) THEN r * r ELSE 2 * r * r END) AS s FROM cr GROUP BY recording_id)"


@query("x23_coordination", f"WITH {PART}, vd AS (SELECT recording_id, avg((x IS NOT NULL AND y IS NOT NULL)::INT) AS pv FROM ct GROUP BY recording_id) SELECT recording_id, 'x_y' AS pair, round(m / s, 6) AS complexity, round(pv, 6) AS pair_valid, CASE WHEN s IS NULL THEN CASE WHEN pv < 0.35 THEN 'failed' ELSE 'low_validity' END WHEN pv < 0.35 THEN 'low_validity' ELSE 'computed' END AS status FROM vd LEFT JOIN pr USING (recording_id)")
def _(read):
    return spectra.coordination(_tracks(read), BY, "frame", [("x", "y")], LAGS)


# Extrema by prominence.
PROM = f"""{EXTREMA}, pa AS (SELECT recording_id, frame, value AS v FROM frames WHERE value IS NOT NULL), pc AS (SELECT ex.recording_id, ex.frame, ex.kind, ex.value, CASE WHEN kind = 'peak' THEN 1 ELSE -1 END AS sg FROM ex),
ph AS (SELECT pc.*, (SELECT max(p.frame) FROM pa p WHERE p.recording_id = pc.recording_id AND p.frame < pc.frame AND sg * p.v > sg * pc.value) AS lf, (SELECT min(p.frame) FROM pa p WHERE p.recording_id = pc.recording_id AND p.frame > pc.frame AND sg * p.v > sg * pc.value) AS rf FROM pc),
pq AS (SELECT ph.*, (SELECT min(sg * p.v) FROM pa p WHERE p.recording_id = ph.recording_id AND p.frame <= ph.frame AND p.frame > coalesce(lf, -1)) AS ll, (SELECT min(sg * p.v) FROM pa p WHERE p.recording_id = ph.recording_id AND p.frame >= ph.frame AND p.frame < coalesce(rf, 1e9)) AS rl FROM ph), pr AS (SELECT recording_id, frame, value, kind, sg * value - greatest(ll, rl) AS prominence FROM pq)"""


@query("w23_prominence_filter", f"WITH {PROM} SELECT recording_id, frame, round(value, 6) AS value, kind, round(prominence, 6) AS prominence FROM pr WHERE prominence >= 20")
def _(read):
    return spectra.prominent_extrema(read("frames").select("recording_id", "frame", "value", F.lit(20.0).alias("least")), BY, "frame", "value", "least")


@query("w24_min_distance", f"WITH RECURSIVE {EXTREMA}, pk AS (SELECT recording_id, frame, value, row_number() OVER (PARTITION BY recording_id ORDER BY value DESC, frame DESC) AS k FROM ex WHERE kind = 'peak'), st AS (SELECT recording_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT recording_id FROM pk) UNION ALL SELECT st.recording_id, pk.k, CASE WHEN len(list_filter(st.kept, lambda t: abs(t - pk.frame) < 5)) > 0 THEN st.kept ELSE list_append(st.kept, pk.frame) END FROM st JOIN pk ON pk.recording_id = st.recording_id AND pk.k = st.k + 1), la AS (SELECT recording_id, unnest(kept) AS frame FROM st QUALIFY k = max(k) OVER (PARTITION BY recording_id)) SELECT pk.recording_id, pk.frame, round(pk.value, 6) AS value FROM pk JOIN la ON la.recording_id = pk.recording_id AND la.frame = pk.frame")
def _(read):
    peaks = spectra.local_extrema(read("frames"), BY, "frame", "value").where("kind = 'peak'").drop("kind")
    return spectra.distant_peaks(peaks, BY, "frame", "value", 5)


@query("w24_syllable_peaks", f"""WITH RECURSIVE {PROM}, sm AS (SELECT recording_id, quantile_cont(value, 0.5) AS med FROM frames GROUP BY recording_id), sd AS (SELECT f.recording_id, any_value(med) AS med, quantile_cont(abs(value - med), 0.5) AS mad FROM frames f JOIN sm ON sm.recording_id = f.recording_id GROUP BY f.recording_id), pk AS (SELECT pr.recording_id, frame, value, prominence, mad, row_number() OVER (PARTITION BY pr.recording_id ORDER BY value DESC, frame DESC) AS k FROM pr JOIN sd ON sd.recording_id = pr.recording_id WHERE kind = 'peak' AND value >= med + mad),
st AS (SELECT recording_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT recording_id FROM pk) UNION ALL SELECT st.recording_id, pk.k, CASE WHEN len(list_filter(st.kept, lambda t: abs(t - pk.frame) < 4)) > 0 THEN st.kept ELSE list_append(st.kept, pk.frame) END FROM st JOIN pk ON pk.recording_id = st.recording_id AND pk.k = st.k + 1), la AS (SELECT recording_id, unnest(kept) AS frame FROM st QUALIFY k = max(k) OVER (PARTITION BY recording_id)) SELECT pk.recording_id, pk.frame, round(pk.value, 6) AS value, round(prominence, 6) AS prominence FROM pk JOIN la ON la.recording_id = pk.recording_id AND la.frame = pk.frame WHERE prominence >= greatest(1e-8, 1.5e0 * mad)""")
def _(read):
    return spectra.syllable_peaks(read("frames").select("recording_id", "frame", "value"), BY, "frame", "value", 4)


# landmarks

CHOSEN = [0, 1, 17, 61, 291, 133, 362, 152]
DIST = lambda a, b: " + ".join(f'pow("{a}_{x}" - "{b}_{x}", 2)' for x in "xyz")
SCALE = f"""ls AS (SELECT *, CASE WHEN detected THEN sqrt({DIST(133, 362)}) END AS s0, CASE WHEN detected THEN sqrt({DIST(33, 263)}) END AS s1 FROM face), lt AS (SELECT *, max(CASE WHEN s0 > 0 THEN 1 END) OVER (PARTITION BY recording_id) AS h0, max(CASE WHEN s1 > 0 THEN 1 END) OVER (PARTITION BY recording_id) AS h1 FROM ls),
lu AS (SELECT *, CASE WHEN h0 = 1 THEN s0 WHEN h1 = 1 THEN s1 END AS scale, CASE WHEN h0 = 1 OR h1 IS NULL THEN 'landmark_distance_133_362' ELSE 'landmark_distance_33_263' END AS scale_source, CASE WHEN h0 = 1 THEN 'ok' WHEN h1 = 1 THEN 'fallback_outer_eye_anchors' ELSE 'missing_anchor_columns' END AS scale_status FROM lt),
lm AS (SELECT recording_id, quantile_cont(scale, 0.5) FILTER (scale > 0) AS scale_median FROM lu GROUP BY recording_id), ln AS (SELECT lu.*, scale_median FROM lu LEFT JOIN lm USING (recording_id))"""


def _scaled(read):
    return landmarks.landmark_scale(read("face"), BY)


@query("x24_landmark_scale", f"WITH {SCALE} SELECT recording_id, frame, round(scale, 6) AS scale, scale_source, scale_status FROM ln")
def _(read):
    return _scaled(read).select("recording_id", "frame", "scale", "scale_source", "scale_status")


@query("x24_bbox_scale", "SELECT recording_id, frame, round(CASE WHEN detected THEN greatest(" + ", ".join(f'"{i}_x"' for i in POINTS) + ") - least(" + ", ".join(f'"{i}_x"' for i in POINTS) + ") END, 6) AS scale FROM face")
def _(read):
    return landmarks.landmark_scale(read("face"), BY, method="face_bbox_width").select("recording_id", "frame", "scale")


def _normalized(read):
    return landmarks.landmark_normalize(_scaled(read), BY, "frame", CHOSEN)


@query("x25_landmark_normalize", f"WITH {SCALE} SELECT recording_id, frame, round(scale_median, 6) AS scale_median, round(scale / scale_median, 6) AS scale_ratio, coalesce(scale > 0, false) AS scale_valid, {', '.join(f'''round(("{i}_{x}" - "1_{x}") / scale_median, 5) + 0e0 AS "{i}_{x}_norm"''' for i in (0, 291) for x in 'xyz')}, detected AND \"0_x\" IS NOT NULL AND \"0_y\" IS NOT NULL AS \"0_available\" FROM ln")
def _(read):
    found = _normalized(read)
    return found.select("recording_id", "frame", "scale_median", "scale_ratio", "scale_valid", *[F.round(F.col(f"`{i}_{x}_norm`"), 5).alias(f"{i}_{x}_norm") for i in (0, 291) for x in "xyz"], F.col("`0_available`"))


THERE = " AND ".join(f'"{i}_x" IS NOT NULL AND "{i}_y" IS NOT NULL AND "{i}_z" IS NOT NULL' for i in CHOSEN)
MEAN_THERE = "(" + " + ".join(f'(detected AND "{i}_x" IS NOT NULL AND "{i}_y" IS NOT NULL AND "{i}_z" IS NOT NULL)::INT' for i in CHOSEN) + f")::DOUBLE / {len(CHOSEN)}e0"


@query("x26_normalization_qc", f"""WITH {SCALE}, nq AS (SELECT *, CASE WHEN scale > 0 THEN scale END AS v, (detected AND {THERE})::INT AS al, {MEAN_THERE} AS mt FROM ln), nj AS (SELECT *, abs(v - lag(v) OVER w) / lag(v) OVER w AS j FROM nq WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
na AS (SELECT recording_id, count(*) AS n_frames, avg(detected::INT) AS face_detected_fraction, avg((v IS NOT NULL)::INT) AS scale_valid_fraction, quantile_cont(v, 0.5) AS med, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / quantile_cont(v, 0.5) AS scale_cv, coalesce(max(j), 0) AS mj, coalesce(quantile_cont(j, 0.95), 0) AS pj, avg(al) AS selected_complete_fraction, avg(mt) AS mean_landmark_availability, any_value(scale_source) AS scale_source, any_value(scale_status) AS scale_status, max(scale_median) AS scale_median FROM nj GROUP BY recording_id),
nf AS (SELECT *, concat_ws(';', CASE WHEN med IS NULL THEN 'normalization_anchor_missing' END, CASE WHEN scale_status = 'fallback_outer_eye_anchors' THEN 'normalization_anchor_fallback_used' END, CASE WHEN med IS NULL THEN 'normalization_invalid_scale' END, CASE WHEN face_detected_fraction < 0.6 THEN 'normalization_insufficient_face_frames' END, CASE WHEN scale_valid_fraction < 0.6 THEN 'normalization_insufficient_valid_frames' END, CASE WHEN scale_cv >= 0.2 OR (med IS NOT NULL AND mj >= 0.25) THEN 'normalization_scale_unstable' END, CASE WHEN scale_cv >= 0.1 AND scale_cv < 0.2 THEN 'normalization_high_scale_cv' END, CASE WHEN med IS NOT NULL AND mj >= 0.1 AND mj < 0.25 THEN 'normalization_high_frame_to_frame_jump' END) AS qc_flags FROM na)
SELECT recording_id, n_frames, {_R('face_detected_fraction', 'scale_valid_fraction', 'scale_cv', 'selected_complete_fraction', 'mean_landmark_availability', 'scale_median')}, round(CASE WHEN med IS NOT NULL THEN mj END, 6) AS max_jump, round(CASE WHEN med IS NOT NULL THEN pj END, 6) AS p95_jump, scale_source, CASE WHEN med IS NULL THEN 'invalid_scale' ELSE scale_status END AS scale_status, qc_flags, CASE WHEN qc_flags = '' THEN 'ok' ELSE 'qc_flagged' END AS status FROM nf""")
def _(read):
    return landmarks.normalization_qc(_normalized(read), BY, "frame", CHOSEN)


STEPS = f"""jl AS ({' UNION ALL '.join(f'SELECT recording_id, frame, {i} AS lm, "{i}_x" AS x, "{i}_y" AS y FROM face WHERE detected AND "{i}_x" IS NOT NULL AND "{i}_y" IS NOT NULL' for i in CHOSEN)}), js AS (SELECT recording_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS s, count(*) OVER (PARTITION BY recording_id, lm) AS n FROM jl WINDOW w AS (PARTITION BY recording_id, lm ORDER BY frame)), jf AS (SELECT recording_id, count(*) FILTER (detected) AS faces, count(*) AS frames_, avg(detected::INT) AS share FROM face GROUP BY recording_id),
jj AS (SELECT js.recording_id, quantile_cont(s, 0.5) AS med, quantile_cont(s, 0.95) AS p95, avg((s > 0.08)::INT) AS big FROM js JOIN jf USING (recording_id) WHERE n >= 3 AND s IS NOT NULL AND faces >= 3 GROUP BY js.recording_id)"""


@query("w14_landmark_jitter", f"WITH {STEPS} SELECT recording_id, {len(CHOSEN)}::BIGINT AS n_qc_landmarks, round(med, 6) AS median_step, round(p95, 6) AS p95_step, round(big, 6) AS large_step_fraction FROM jf LEFT JOIN jj USING (recording_id)")
def _(read):
    return landmarks.landmark_jitter(read("face"), BY, "frame", CHOSEN)


@query("q37_video_qc", f"""WITH {STEPS}, ga AS (SELECT recording_id, frame, detected, lag(detected) {W} AS p FROM face), gb AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> detected THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame) AS run FROM ga), gc AS (SELECT recording_id, run, detected, count(*) AS n FROM gb GROUP BY ALL), gd AS (SELECT recording_id, count(*) FILTER (NOT detected) AS n_gaps, coalesce(max(n) FILTER (NOT detected), 0) AS longest FROM gc GROUP BY recording_id),
v AS (SELECT jf.recording_id, frames_, faces, share AS f, n_gaps, longest, longest::DOUBLE / frames_::DOUBLE AS g, med, p95, big, coalesce(p95, 0) AS j FROM jf JOIN gd USING (recording_id) LEFT JOIN jj USING (recording_id)),
x AS (SELECT *, concat_ws('; ', CASE WHEN f < 0.75 THEN 'face detection below review threshold (' || format('{{:.1f}}', 100 * f) || '%)' WHEN f < 0.9 THEN 'face detection below pass threshold (' || format('{{:.1f}}', 100 * f) || '%)' END, CASE WHEN g >= 0.25 OR (g >= 0.1 AND f >= 0.75) THEN 'long no-face gap (' || longest::VARCHAR || ' frames; ' || format('{{:.1f}}', 100 * g) || '% of video)' END, CASE WHEN j >= 0.14 THEN 'very high landmark frame-to-frame displacement p95=' || format('{{:.3f}}', j) WHEN j >= 0.08 AND f >= 0.75 AND g < 0.25 THEN 'high landmark frame-to-frame displacement p95=' || format('{{:.3f}}', j) END) AS why FROM v)
SELECT recording_id, frames_ AS n_frames, faces AS n_faces_detected, round(f, 6) AS face_detected_fraction, n_gaps AS n_no_face_runs, longest AS max_no_face_gap, round(g, 6) AS max_gap_fraction, {len(CHOSEN)}::BIGINT AS n_qc_landmarks, round(med, 6) AS median_step, round(p95, 6) AS p95_step, round(big, 6) AS large_step_fraction, CASE WHEN f < 0.75 OR g >= 0.25 OR j >= 0.14 THEN 'fail' WHEN f < 0.9 OR g >= 0.1 OR j >= 0.08 THEN 'review' ELSE 'pass' END AS qc_status, CASE WHEN why = '' THEN 'No major automated QC concerns detected.' ELSE why END AS qc_rationale FROM x""")
def _(read):
    return landmarks.video_qc(read("face"), BY, "frame", CHOSEN)


def _sq(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f'coalesce(pow("{a}_{x}" - "{b}_{x}", 2), 0)' for x in "xyz") + ")"


def _area(a: int, b: int, c: int) -> str:
    return f'0.5e0 * abs(("{b}_x" - "{a}_x") * ("{c}_y" - "{a}_y") - ("{b}_y" - "{a}_y") * ("{c}_x" - "{a}_x"))'


def _ratio(a: str, b: str) -> str:
    return f"{a} / CASE WHEN abs({b}) > 1e-12 THEN {b} END"


AREA_R, AREA_L, OPEN, WIDE = _area(61, 0, 17), _area(291, 0, 17), _sq(0, 17), _sq(61, 291)
SIGNAL_SQL = {
    "mouth_aperture": OPEN, "outer_lip_spread": WIDE, "inner_lip_spread": _sq(78, 308), "jaw_to_nose": _sq(152, 1), "lower_lip_to_chin": _sq(14, 152), "lip_aspect_ratio": _ratio(OPEN, WIDE), "jaw_lateralization": _ratio(_sq(17, 243), _sq(17, 463)), "lip_symmetry_ratio": _ratio(_sq(291, 8), _sq(61, 8)),
    "corner_vertical_asymmetry": 'abs("61_y" - "291_y")', "corner_lateral_asymmetry": 'abs(abs("61_x") - abs("291_x"))', "left_commissure_reference_distance": _sq(291, 8), "right_commissure_reference_distance": _sq(61, 8),
    "lip_eccentricity": f"sqrt(greatest(0e0, least(1e0, 1 - pow({_ratio(f'least({OPEN}, {WIDE})', f'greatest({OPEN}, {WIDE})')}, 2))))", "mouth_area_right": AREA_R, "mouth_area_left": AREA_L, "mouth_area_total": f"{AREA_R} + {AREA_L}", "mouth_area_abs_asymmetry": f"abs({AREA_R} - {AREA_L})",
    "lower_lip_lateralization": '"17_x" - ("61_x" + "291_x") / 2',
}


@query("f09_landmark_signals", "SELECT recording_id, frame, " + ", ".join(f"round({sql}, 6) + 0e0 AS {name}" for name, sql in SIGNAL_SQL.items()) + " FROM face")
def _(read):
    face = read("face")
    return face.select("recording_id", "frame", *[c.alias(n) for n, c in landmarks.landmark_signals(face, "").items()])


CLEAN = f"""{FILLED}, k0 AS (SELECT recording_id, frame, v FROM xl), k1 AS (SELECT recording_id, frame, CASE WHEN abs(v - avg(v) OVER p) > 5 * stddev_pop(v) OVER p THEN NULL ELSE v END AS v FROM k0 WINDOW p AS (PARTITION BY recording_id)), k2 AS (SELECT recording_id, frame, CASE WHEN abs(v - avg(v) OVER p) > 3 * stddev_pop(v) OVER p THEN NULL ELSE v END AS v FROM k1 WINDOW p AS (PARTITION BY recording_id)),
k3 AS (SELECT recording_id, frame, v, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS pn, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS qn, last_value(v IGNORE NULLS) OVER b AS pv, first_value(v IGNORE NULLS) OVER a AS qv, count(*) FILTER (v IS NULL) OVER (PARTITION BY recording_id) AS n_clipped FROM k2 WINDOW b AS (PARTITION BY recording_id ORDER BY frame ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
kc AS (SELECT recording_id, frame, coalesce(v, pv + (qv - pv) * (frame - pn)::DOUBLE / CASE WHEN qn > pn THEN (qn - pn)::DOUBLE END, pv, qv) AS v, n_clipped FROM k3)"""


def _clean(read):
    return landmarks.clean_signal(read("frames").select("recording_id", "frame", "time_s", "value"), BY, "frame", "value")


@query("x28_clean_signal", f"WITH {CLEAN}, nm AS (SELECT recording_id, count(*) FILTER (value IS NULL) AS n_missing FROM frames GROUP BY recording_id) SELECT recording_id, frame, round(v, 5) AS value, n_missing, n_clipped FROM kc JOIN nm USING (recording_id)", digits=5)
def _(read):
    return _clean(read).select("recording_id", "frame", "value", "n_missing", "n_clipped")


# movements of the raw signal, by prominent extrema
MOVED = f"""{PROM}, sp_ AS (SELECT recording_id, 0.1e0 * (quantile_cont(value, 0.95) - quantile_cont(value, 0.05)) AS least, count(value) AS n FROM frames GROUP BY recording_id), pe AS (SELECT pr.* FROM pr JOIN sp_ ON sp_.recording_id = pr.recording_id WHERE prominence >= least AND n >= 6),
mv AS (SELECT recording_id, kind, frame AS f0, lead(frame) OVER w AS f1, lead(kind) OVER w AS nk FROM pe WINDOW w AS (PARTITION BY recording_id ORDER BY frame)), mw AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY f0) AS movement_id, CASE kind WHEN 'trough' THEN 'open' ELSE 'close' END AS movement_kind, f0, f1 FROM mv WHERE nk IS NOT NULL AND nk <> kind AND f1 - f0 >= 3),
mf AS (SELECT f.recording_id, f.frame, f.time_s, f.value, m.movement_id, m.movement_kind FROM frames f LEFT JOIN mw m ON m.recording_id = f.recording_id AND f.frame BETWEEN f0 AND f1 QUALIFY row_number() OVER (PARTITION BY f.recording_id, f.frame ORDER BY m.movement_id DESC NULLS LAST) = 1),
mm AS (SELECT mf.recording_id, frame, time_s, value, CASE WHEN h.recording_id IS NULL THEN 1 ELSE movement_id END AS movement_id, CASE WHEN h.recording_id IS NULL THEN 'whole' ELSE movement_kind END AS movement_kind FROM mf LEFT JOIN (SELECT DISTINCT recording_id FROM mw) h ON h.recording_id = mf.recording_id)"""


def _moved(read):
    return landmarks.movements(read.once("frames").select("recording_id", "frame", "time_s", "value"), BY, "frame", "value")


@query("w25_prominent_movements", f"WITH {MOVED} SELECT recording_id, frame, movement_id, movement_kind FROM mm")
def _(read):
    return _moved(read).select("recording_id", "frame", "movement_id", "movement_kind")


PER = f"{MOVED}, pm AS (SELECT recording_id, movement_id, any_value(movement_kind) AS movement_kind, count(*) AS n_frames, min(frame) AS start_frame, max(frame) AS end_frame, CASE WHEN count(*) >= 2 THEN max(time_s) - min(time_s) END AS duration_s, 'value' AS signal, count(value)::DOUBLE / count(*)::DOUBLE AS valid_fraction, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS range_p05_p95 FROM mm WHERE movement_id IS NOT NULL GROUP BY recording_id, movement_id)"


@query("g21_movement_summary", f"WITH {PER} SELECT recording_id, movement_id, movement_kind, n_frames, start_frame, end_frame, signal, {_R('duration_s', 'valid_fraction', 'median', 'iqr', 'p05', 'p95', 'range_p05_p95')} FROM pm")
def _(read):
    return landmarks.movement_summary(_moved(read), BY, "frame", "time_s", ["value"])


@query("g21_movement_rollup", f"WITH {PER} SELECT recording_id, signal, count(*) AS n_movements, count(*) FILTER (movement_kind = 'open') AS n_open, count(*) FILTER (movement_kind = 'close') AS n_close, round(quantile_cont(median, 0.5), 6) AS median_median, round(quantile_cont(median, 0.75) - quantile_cont(median, 0.25), 6) AS median_iqr, round(quantile_cont(range_p05_p95, 0.5), 6) AS range_median, round(quantile_cont(range_p05_p95, 0.75) - quantile_cont(range_p05_p95, 0.25), 6) AS range_iqr FROM pm GROUP BY recording_id, signal")
def _(read):
    return landmarks.movement_rollup(landmarks.movement_summary(_moved(read), BY, "frame", "time_s", ["value"]), BY)


_TO = lambda x, name: f"""CASE WHEN o.of = 'jerk' THEN round({x}) ELSE round(round({x}, 9), 3) END AS {name}"""
_SUMS = ", ".join(_TO(x, f'"{n}"') for n, x in {"mean": "avg(x)", "sd": "stddev_pop(x)", "median": "quantile_cont(x, 0.5)", "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "p05": "quantile_cont(x, 0.05)", "p95": "quantile_cont(x, 0.95)", "range_p05_p95": "quantile_cont(x, 0.95) - quantile_cont(x, 0.05)", "min": "min(x)", "max": "max(x)"}.items())
_SIZES = " UNION ALL ".join(f"SELECT recording_id, '{c}' AS of, {x} AS x FROM d3" for c, x in {"value": "v", "velocity": "abs(velocity)", "acceleration": "abs(acceleration)", "jerk": "abs(jerk)"}.items())


@query("g22_signal_summaries", f"""WITH {FILLED}, ft AS (SELECT xl.recording_id, xl.frame, time_s, xl.v FROM xl JOIN frames f ON f.recording_id = xl.recording_id AND f.frame = xl.frame), {_grad('ft', 'v', 'velocity', 'd1')}, {_grad('d1', 'velocity', 'acceleration', 'd2')}, {_grad('d2', 'acceleration', 'jerk', 'd3')}, lo AS ({_SIZES}),
pl AS (SELECT recording_id, 'velocity' AS of, round(round(sum(a), 9), 3) AS path_length FROM (SELECT recording_id, (abs(velocity) + abs(lag(velocity) OVER w)) / 2 * (time_s - lag(time_s) OVER w) AS a FROM d3 WINDOW w AS (PARTITION BY recording_id ORDER BY frame)) GROUP BY recording_id)
SELECT o.recording_id, o.of, {_SUMS}, any_value(path_length) AS path_length FROM lo o LEFT JOIN pl ON pl.recording_id = o.recording_id AND pl.of = o.of GROUP BY o.recording_id, o.of""", digits=3)
def _(read):
    rows = spectra.interpolate_linear(read("frames").select("recording_id", "frame", "time_s", "value"), BY, "frame", "value")
    found = landmarks.speed_summaries(rows, BY, "frame", "value", "time_s")
    # doubles scaled before rounding, as DuckDB rounds, and ties freed from the order of sums; the jerk has large numbers, rounded to whole ones
    exact = lambda c: F.round(F.col(c) * 1e9) / 1e9
    return found.withColumns({c: F.when(F.col("of") == "jerk", F.round(c)).otherwise(F.round(exact(c) * 1000) / 1000) for c, t in found.dtypes if t == "double"})


@query("x30_kinematic_scalars", digits=4)
def _(read):
    scaled = landmarks.landmark_scale(read("face"), BY)
    return landmarks.kinematic_scalars(landmarks.landmark_normalize(scaled, BY, "frame", list(POINTS)), BY, "frame", "time_s")
