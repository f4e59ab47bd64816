"""Scalar formulas as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing or a true value.
MISSING_TEXTS = ("", "nan", "none", "null", "nat", "<na>")
TRUE_TEXTS = ("true", "1", "yes", "y")
INCLUDE_TEXTS = (*TRUE_TEXTS, "include", "included")

# Prefixes and words of quality metrics by artifact family, tried in this order.
MANUAL_QC_WORDS = (
    ("Manual acquisition QC", ("manual_acquisition", "task_completed", "completed_as_instructed", "needs_parsing", "parsing_needed", "poor_light", "blurry", "acquisition")),
    ("Manual audio QC", ("manual_audio", "another_person_speaks", "background_noise", "poor_audio", "audio_quality", "volume_is_unstable", "microphone")),
    ("Manual video QC", ("manual_video", "another_person_in_frame", "frozen_video", "video_is_unstable")),
    ("Manual face/visibility QC", ("manual_face", "face_visibility", "subject_looks_away", "wearing_glasses", "facial_hair", "visibility", "occlusion")),
)
QC_PREFIXES = (
    ("Additive interference", ("qadd",)),
    ("Gain / level dynamics", ("qgain",)),
    ("Reverberation / echo", ("qrev",)),
    ("Channel / device / platform", ("qchan",)),
    ("Nonlinear distortion", ("qdist",)),
    ("Temporal discontinuities", ("qtemp", "qdrop")),
)
QC_WORDS = (
    ("Additive interference", ("snr", "noise", "pause_rms", "hum", "interference")),
    ("Gain / level dynamics", ("gain", "rms", "level", "agc", "peak_to_rms")),
    ("Reverberation / echo", ("reverb", "echo", "tail", "decay", "blur")),
    ("Channel / device / platform", ("channel", "device", "codec", "band", "centroid", "rolloff", "tilt", "crest")),
    ("Nonlinear distortion", ("clip", "dist", "saturat", "overload")),
    ("Temporal discontinuities", ("drop", "jump", "glitch", "skip", "discontinu", "zero_run", "temp")),
)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def finite(x: Column) -> Column:
    """NULL for NaN: missing values are NULL everywhere in this library."""
    return F.when(~F.isnan(x), x)


def normalize_name(x: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def usable(x: Column) -> Column:
    """Whether a value is there that doesn't just spell out a missing one."""
    return x.isNotNull() & ~F.lower(F.trim(x.cast("string"))).isin(*MISSING_TEXTS)


def truthy(x: Column, texts: tuple[str, ...] = INCLUDE_TEXTS) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*texts), F.lit(False))


def qc_family_of(name: Column) -> Column:
    """The artifact family of a quality metric by its name."""
    n, out = normalize_name(name), F.lit("unclassified")
    for family, words in reversed(QC_WORDS):
        out = F.when(any_of([n.contains(w) for w in words]), family).otherwise(out)
    for family, prefixes in reversed(QC_PREFIXES):
        out = F.when(any_of([n.startswith(p) for p in prefixes]), family).otherwise(out)
    for family, words in reversed(MANUAL_QC_WORDS):
        out = F.when(any_of([n.contains(w) for w in words]), family).otherwise(out)
    return out


def banded(x: Column, bands: list[tuple[float, str]], low: str) -> Column:
    """The label of the highest band whose limit x reaches, from bands sorted by falling limits; NULL stays NULL."""
    out = F.lit(low)
    for limit, label in reversed(bands):
        out = F.when(x >= limit, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def missingness_band(fraction: Column) -> Column:
    return banded(fraction, [(0.80, "high_review"), (0.50, "review"), (0.20, "monitor")], "low")


def relation_band(rho: Column) -> Column:
    return F.coalesce(banded(F.abs(rho), [(0.90, "near_duplicate"), (0.80, "strong_redundancy"), (0.60, "moderate_block"), (0.30, "weak_to_moderate")], "low"), F.lit("not_modelable"))


def strength_band(effect: Column) -> Column:
    return F.coalesce(banded(F.abs(effect), [(0.50, "strong"), (0.30, "moderate"), (0.20, "weak")], "minimal"), F.lit("not_modelable"))


def stability_band(icc: Column) -> Column:
    return F.coalesce(banded(icc, [(0.75, "stable"), (0.50, "moderate"), (0.25, "variable")], "unstable"), F.lit("not_evaluable"))


def range_band(fraction: Column) -> Column:
    return F.when(fraction.isNull(), "no_registry_range").when(fraction == 0, "within_range").when(fraction < 0.05, "minor_review").when(fraction < 0.20, "review").otherwise("high_review")


def reason_list(reasons: list[tuple[Column, str]], none: str, sep: str = "; ") -> Column:
    """The texts whose condition holds, in order, or `none`."""
    texts = F.array_compact(F.array(*[F.when(c, t) for c, t in reasons]))
    return F.when(F.size(texts) > 0, F.array_join(F.array_distinct(texts), sep)).otherwise(none)


def worst_of(rules: list[tuple[Column, str]], ok: str = "ok") -> Column:
    """The first label whose condition holds."""
    out = F.lit(ok)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(F.abs(den) > 1e-12, num / den)


def euclid_distance(a: list[Column], b: list[Column]) -> Column:
    """NULL if any coordinate is."""
    return F.sqrt(reduce(lambda x, y: x + y, [F.pow(p - q, 2) for p, q in zip(a, b, strict=True)]))


def euclid_distance_nullzero(a: list[Column], b: list[Column]) -> Column:
    """A missing difference counts as none."""
    return F.sqrt(reduce(lambda x, y: x + y, [F.coalesce(F.pow(p - q, 2), F.lit(0.0)) for p, q in zip(a, b, strict=True)]))


def triangle_area_xy(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    return 0.5 * F.abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def ellipse_eccentricity(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.pow(safe_ratio(F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))), 2))))


def axis_asymmetry(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def balance_asymmetry(a: Column, b: Column) -> Column:
    return F.abs(F.abs(a) - F.abs(b))


def midpoint_excursion(p: Column, a: Column, b: Column) -> Column:
    return p - (a + b) / 2


def db(ratio: Column) -> Column:
    return 20 * F.log10(F.greatest(ratio, F.lit(1e-10)))


def parse_rate(rate: Column) -> Column:
    """`a/b` or a number; NULL for a zero denominator and for other text."""
    parts = F.split(F.trim(rate), "/")
    number = lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d+(\.\d*)?$"), F.trim(x)).cast("double")
    num, den = number(parts[0]), number(F.get(parts, F.lit(1)))
    return F.when(F.size(parts) == 1, num).when(den != 0, num / den)


def coerce_date(text: Column) -> Column:
    """ISO text of a date, NULL where it can't be read."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd")


def row_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def log_transform(x: Column, skew: Column, low: Column) -> Column:
    """log1p for values that are never negative and skewed by more than 1, asinh for others skewed by more than 1 either way; NULL stays NULL."""
    return F.when(x.isNull(), x).when((skew > 1) & (low >= 0), F.log1p(F.greatest(x, F.lit(0.0)))).when(F.abs(skew) > 1, F.asinh(x)).otherwise(x)


def winsorize(x: Column, low: Column, high: Column) -> Column:
    """x held within low and high; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))
