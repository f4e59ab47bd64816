"""Face landmarks per frame: scale, normalisation, checks, named signals, movements and scalars.

Landmark tables are wide: (recording..., at, detected, `{i}_x`, `{i}_y`, `{i}_z` for each landmark i they have). Which
landmarks exist is told by the columns; which are usable in a recording by its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import axis_asymmetry, balance_asymmetry, ellipse_eccentricity, euclid_distance, euclid_distance_nullzero, finite, midpoint_excursion, reason_list, safe_ratio, triangle_area_xy, worst_of
from quillon.functions.shared import settled
from quillon.functions.stats import quantiles
from quillon.operators.signals import level_family, movement_windows, path_rom
from quillon.operators.spectra import max_cross_correlation, prominent_extrema
from quillon.operators.windows import boolean_runs, derivatives, interpolate_linear, path_length, runs_of_false, sigma_clip

# Landmarks between which a method measures its scale.
ANCHORS = {"intercanthal_distance": (133, 362), "interpupillary_or_outer_eye": (33, 263), "face_height_nose_chin": (10, 152)}
OUTER_EYE = (33, 263)


def _c(i: int, axis: str, suffix: str = "") -> Column:
    return F.col(f"`{i}_{axis}{suffix}`")


def has_points(df: DataFrame, *points: int, suffix: str = "") -> bool:
    return all(f"{i}_{a}{suffix}" in df.columns for i in points for a in "xyz")


def _q(x: str, q: float) -> Column:
    return F.get(quantiles(x, [q]), F.lit(0))


def landmark_scale(df: DataFrame, by: list[str], detected: str = "detected", method: str = "intercanthal_distance") -> DataFrame:
    """df with scale, scale_source and scale_status per frame: the distance of the method's anchors in frames with a face.

    intercanthal_distance (and procrustes_head_stabilized, which doesn't rotate yet) falls back to the outer corners of the
    eyes in recordings without a usable inner pair; face_bbox_width spans the x of all landmarks; raw_normalized_coordinates is 1.
    """
    face = F.coalesce(F.col(detected), F.lit(False))
    if method == "raw_normalized_coordinates":
        return df.withColumns({"scale": F.lit(1.0), "scale_source": F.lit("raw_unit_scale"), "scale_status": F.lit("raw_only")})
    if method == "face_bbox_width":
        xs = [F.col(f"`{c}`") for c in df.columns if c.endswith("_x") and c[:-2].isdigit()]
        width = F.greatest(*xs) - F.least(*xs) if len(xs) > 1 else F.lit(0.0) if xs else F.lit(None).cast("double")
        return df.withColumns({"scale": F.when(face, width), "scale_source": F.lit("face_bbox_width"), "scale_status": F.lit("ok" if xs else "missing_x_columns")})
    fine = "procrustes_not_yet_applied" if method == "procrustes_head_stabilized" else "ok"
    first = ANCHORS.get("intercanthal_distance" if method == "procrustes_head_stabilized" else method)
    if first is None:
        return df.withColumns({"scale": F.lit(None).cast("double"), "scale_source": F.lit(method), "scale_status": F.lit("unknown_method")})
    pairs = [(first, fine)] + ([(OUTER_EYE, "fallback_outer_eye_anchors")] if first == ANCHORS["intercanthal_distance"] else [])
    every, options = Window.partitionBy(*by), []
    for k, ((a, b), status) in enumerate(pairs):
        if has_points(df, a, b):
            df = df.withColumn(f"_scale{k}", F.when(face, euclid_distance([_c(a, x) for x in "xyz"], [_c(b, x) for x in "xyz"])))
            options.append((F.max(F.when(F.col(f"_scale{k}") > 0, 1)).over(every).isNotNull(), F.col(f"_scale{k}"), f"landmark_distance_{a}_{b}", status))
    pick = lambda n, none: reduce(lambda rest, o: F.when(o[0], o[n] if n == 1 else F.lit(o[n])).otherwise(rest), reversed(options), none)
    out = df.withColumns({"scale": pick(1, F.lit(None).cast("double")), "scale_source": pick(2, F.lit(f"landmark_distance_{first[0]}_{first[1]}")), "scale_status": pick(3, F.lit("missing_anchor_columns"))})
    return out.drop(*[f"_scale{k}" for k in range(len(pairs))])


def landmark_normalize(scaled: DataFrame, by: list[str], at: str, landmarks: list[int], detected: str = "detected", center: int = 1, method: str = "intercanthal_distance") -> DataFrame:
    """(by..., at, detected, scale..., scale_median, scale_ratio, scale_valid, `{i}_x_norm`..., `{i}_available`): coordinates from the centre, over the recording's median scale.

    The centre is a landmark, else the middle of the method's anchors, else 0. Landmarks without columns are left out; a
    recording without a positive scale has NULL coordinates.
    """
    good = F.when(F.col("scale") > 0, F.col("scale"))
    medians = scaled.withColumn("_g", good).groupBy(*by).agg(_q("_g", 0.5).alias("scale_median"))
    a, b = ANCHORS.get(method, ANCHORS["intercanthal_distance"])
    middle = {x: _c(center, x) for x in "xyz"} if has_points(scaled, center) else {x: (_c(a, x) + _c(b, x)) / 2 for x in "xyz"} if has_points(scaled, a, b) else {x: F.lit(0.0) for x in "xyz"}
    met = scaled.join(medians, by, "left")
    have = [i for i in landmarks if has_points(scaled, i)]
    face = F.coalesce(F.col(detected), F.lit(False))
    norm = [((_c(i, x) - middle[x]) / F.col("scale_median")).alias(f"{i}_{x}_norm") for i in have for x in "xyz"]
    there = [(face & reduce(lambda p, q: p & q, [_c(i, x).isNotNull() for x in "xyz"])).alias(f"{i}_available") for i in have]
    status = F.when(F.col("scale_median") > 0, F.col("scale_status")).otherwise("invalid_scale")
    keep = [c for c in ("time_s", "timestamp_ms") if c in scaled.columns]
    return met.select(*by, at, *keep, face.alias(detected), "scale", "scale_source", status.alias("scale_status"), "scale_median", (F.col("scale") / F.col("scale_median")).alias("scale_ratio"), F.coalesce(F.col("scale") > 0, F.lit(False)).alias("scale_valid"), *norm, *there)


def normalization_qc(normalized: DataFrame, by: list[str], at: str, landmarks: list[int], detected: str = "detected", least_face: float = 0.60, least_valid: float = 0.60, cv: tuple[float, float] = (0.10, 0.20), jump: tuple[float, float] = (0.10, 0.25)) -> DataFrame:
    """Per recording the shares of frames with a face, a scale and all landmarks, the scale's IQR over its median, its jumps between successive valid frames, and the flags raised."""
    w = Window.partitionBy(*by).orderBy(at)
    have = [i for i in landmarks if f"{i}_available" in normalized.columns]
    v = F.when(F.col("scale_valid"), F.col("scale"))
    all_there = reduce(lambda p, q: p & q, [F.col(f"`{i}_available`") for i in have]) if have else F.lit(None).cast("boolean")
    mean_there = sum((F.col(f"`{i}_available`").cast("double") for i in have), F.lit(0.0)) / len(have) if have else F.lit(None).cast("double")
    rows = normalized.withColumns({"_v": v, "_all": all_there.cast("double"), "_mean": mean_there}).withColumn("_j", F.abs(F.col("_v") - F.lag("_v").over(w)) / F.lag("_v").over(w))
    found = rows.groupBy(*by).agg(
        F.count("*").alias("n_frames"), F.avg(F.col(detected).cast("int")).alias("face_detected_fraction"), F.avg(F.col("scale_valid").cast("int")).alias("scale_valid_fraction"), quantiles("_v", [0.25, 0.5, 0.75]).alias("_q"),
        F.coalesce(F.max("_j"), F.lit(0.0)).alias("_max"), F.coalesce(_q("_j", 0.95), F.lit(0.0)).alias("_p95"), F.avg("_all").alias("selected_complete_fraction"), F.avg("_mean").alias("mean_landmark_availability"), F.first("scale_source").alias("scale_source"), F.first("scale_status").alias("scale_status"), F.max("scale_median").alias("scale_median"),
    )
    some = F.get("_q", F.lit(1)).isNotNull()
    ratio = (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))) / F.get("_q", F.lit(1))
    found = found.withColumns({"scale_cv": ratio, "max_jump": F.when(some, F.col("_max")), "p95_jump": F.when(some, F.col("_p95"))})
    over = lambda c, x: F.coalesce(F.col(c) >= x, F.lit(False))
    missing = len(have) < len(landmarks)
    flags = [
        (F.col("scale_status") == "raw_only", "normalization_method_raw_only"), (F.col("scale_source").startswith("landmark") & ~some, "normalization_anchor_missing"), (F.col("scale_status") == "fallback_outer_eye_anchors", "normalization_anchor_fallback_used"),
        (~F.coalesce(F.col("scale_median") > 0, F.lit(False)), "normalization_invalid_scale"), (F.col("face_detected_fraction") < least_face, "normalization_insufficient_face_frames"), (F.col("scale_valid_fraction") < least_valid, "normalization_insufficient_valid_frames"),
        (over("scale_cv", cv[1]) | over("max_jump", jump[1]), "normalization_scale_unstable"), (over("scale_cv", cv[0]) & ~over("scale_cv", cv[1]), "normalization_high_scale_cv"), (over("max_jump", jump[0]) & ~over("max_jump", jump[1]), "normalization_high_frame_to_frame_jump"), (F.lit(missing), "missing_selected_landmark_columns"),
    ]
    text = reason_list(flags, "", ";")
    return found.withColumn("qc_flags", text).withColumn("status", F.when(F.col("qc_flags") == "", "ok").otherwise("qc_flagged")).drop("_q", "_max", "_p95")


def landmark_jitter(df: DataFrame, by: list[str], at: str, landmarks: list[int], detected: str = "detected", large: float = 0.08) -> DataFrame:
    """Steps of each landmark between its successive valid frames with a face, pooled: median, 95th percentile and the share over `large`.

    A landmark needs three valid frames in a recording, a recording three frames with a face.
    """
    have = [i for i in landmarks if f"{i}_x" in df.columns and f"{i}_y" in df.columns]
    seen = df.where(F.col(detected))
    faces = df.groupBy(*by).agg(F.count_if(F.col(detected)).alias("_faces"))
    entries = F.array(*[F.struct(F.lit(i).alias("landmark"), _c(i, "x").alias("x"), _c(i, "y").alias("y")) for i in have])
    long = seen.select(*by, at, F.inline(entries)).where("x IS NOT NULL AND y IS NOT NULL") if have else None
    if long is None:
        return faces.select(*by, F.lit(0).alias("n_qc_landmarks"), *[F.lit(None).cast("double").alias(c) for c in ("median_step", "p95_step", "large_step_fraction")])
    w, group = Window.partitionBy(*by, "landmark").orderBy(at), Window.partitionBy(*by, "landmark")
    steps = long.withColumns({"_s": F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), "_n": F.count("*").over(group)}).where("_n >= 3 AND _s IS NOT NULL")
    found = steps.join(faces.where("_faces >= 3"), by).groupBy(*by).agg(quantiles("_s", [0.5, 0.95]).alias("_q"), F.avg((F.col("_s") > large).cast("int")).alias("large_step_fraction"))
    return faces.select(*by).join(found, by, "left").select(*by, F.lit(len(have)).alias("n_qc_landmarks"), F.get("_q", F.lit(0)).alias("median_step"), F.get("_q", F.lit(1)).alias("p95_step"), "large_step_fraction")


def video_qc(df: DataFrame, by: list[str], at: str, landmarks: list[int], detected: str = "detected", face: tuple[float, float] = (0.90, 0.75), gap: tuple[float, float] = (0.10, 0.25), jitter: tuple[float, float] = (0.08, 0.14)) -> DataFrame:
    """pass, review or fail of each recording by the share of frames with a face, the longest run without one and the jitter, and why."""
    runs = runs_of_false(boolean_runs(df.select(*by, at, detected), by, at, detected), by, detected)
    base = df.groupBy(*by).agg(F.count("*").alias("n_frames"), F.count_if(F.col(detected)).alias("n_faces_detected"))
    met = base.join(runs, by, "left").join(landmark_jitter(df, by, at, landmarks, detected), by, "left").withColumns({"face_detected_fraction": F.col("n_faces_detected") / F.col("n_frames"), "max_gap_fraction": F.col("longest_gap") / F.col("n_frames")})
    f, g, j = F.col("face_detected_fraction"), F.col("max_gap_fraction"), F.coalesce("p95_step", F.lit(0.0))
    status = worst_of([((f < face[1]) | (g >= gap[1]) | (j >= jitter[1]), "fail"), ((f < face[0]) | (g >= gap[0]) | (j >= jitter[0]), "review")], "pass")
    bad = (f < face[1]) | (g >= gap[1])  # high jitter is told only where nothing failed before it
    percent = lambda c: F.concat(F.format_number(100 * c, 1), F.lit("%"))
    long_gap = F.concat(F.lit("long no-face gap ("), F.col("longest_gap").cast("string"), F.lit(" frames; "), percent(g), F.lit(" of video)"))
    told = [
        F.when(f < face[1], F.concat(F.lit("face detection below review threshold ("), percent(f), F.lit(")"))).when(f < face[0], F.concat(F.lit("face detection below pass threshold ("), percent(f), F.lit(")"))),
        F.when((g >= gap[1]) | ((g >= gap[0]) & (f >= face[1])), long_gap),
        F.when(j >= jitter[1], F.concat(F.lit("very high landmark frame-to-frame displacement p95="), F.format_number(j, 3))).when((j >= jitter[0]) & ~bad, F.concat(F.lit("high landmark frame-to-frame displacement p95="), F.format_number(j, 3))),
    ]
    why = F.concat_ws("; ", *told)
    return met.select(*by, "n_frames", "n_faces_detected", "face_detected_fraction", F.col("n_gaps").alias("n_no_face_runs"), F.col("longest_gap").alias("max_no_face_gap"), "max_gap_fraction", "n_qc_landmarks", "median_step", "p95_step", "large_step_fraction", status.alias("qc_status"), F.when(why == "", "No major automated QC concerns detected.").otherwise(why).alias("qc_rationale"))


# The named signals: their kind and the landmarks, or signals, they are made of; of several pairs the first that exists.
SIGNALS = {
    "mouth_aperture": ("distance", ((0, 17), (13, 14))),
    "outer_lip_spread": ("distance", ((61, 291),)),
    "inner_lip_spread": ("distance", ((78, 308),)),
    "jaw_to_nose": ("distance", ((152, 1),)),
    "lower_lip_to_chin": ("distance", ((14, 152), (17, 152))),
    "lip_aspect_ratio": ("ratio", ("mouth_aperture", "outer_lip_spread")),
    "jaw_lateralization": ("distance_ratio", (((17, 243), (14, 243), (17, 133), (14, 133), (17, 33), (14, 33)), ((17, 463), (14, 463), (17, 362), (14, 362), (17, 263), (14, 263)))),
    "lip_symmetry_ratio": ("distance_ratio", (((291, 8), (291, 1)), ((61, 8), (61, 1)))),
    "corner_vertical_asymmetry": ("axis_difference", (61, 291, "y")),
    "corner_lateral_asymmetry": ("balance", (61, 291, "x")),
    "left_commissure_reference_distance": ("distance", ((291, 8), (291, 1))),
    "right_commissure_reference_distance": ("distance", ((61, 8), (61, 1))),
    "lip_eccentricity": ("eccentricity", ("mouth_aperture", "outer_lip_spread")),
    "mouth_area_right": ("area", (61, 0, 17)),
    "mouth_area_left": ("area", (291, 0, 17)),
    "mouth_area_total": ("sum", ("mouth_area_right", "mouth_area_left")),
    "mouth_area_abs_asymmetry": ("difference", ("mouth_area_right", "mouth_area_left")),
    "lower_lip_lateralization": ("excursion", (17, 61, 291, "x")),
}


def landmark_signals(df: DataFrame, suffix: str = "_norm") -> dict[str, Column]:
    """The named signals that the table's landmarks allow, as columns, in the order of SIGNALS; missing differences count as none in a distance."""
    have = lambda *p: has_points(df, *p, suffix=suffix)
    xyz = lambda i: [_c(i, a, suffix) for a in "xyz"]
    xy = lambda i: (_c(i, "x", suffix), _c(i, "y", suffix))
    first = lambda pairs: next((euclid_distance_nullzero(xyz(a), xyz(b)) for a, b in pairs if have(a, b)), None)
    out: dict[str, Column] = {}
    for name, (kind, of) in SIGNALS.items():
        found = None
        if kind == "distance":
            found = first(of)
        elif kind == "distance_ratio":
            num, den = map(first, of)
            found = safe_ratio(num, den) if num is not None and den is not None else None
        elif kind in ("axis_difference", "balance") and have(*of[:2]):
            found = (axis_asymmetry if kind == "axis_difference" else balance_asymmetry)(_c(of[0], of[2], suffix), _c(of[1], of[2], suffix))
        elif kind == "area" and have(*of):
            found = triangle_area_xy(*map(xy, of))
        elif kind == "excursion" and have(*of[:3]):
            found = midpoint_excursion(*(_c(i, of[3], suffix) for i in of[:3]))
        elif kind in ("ratio", "eccentricity", "sum", "difference") and set(of) <= set(out):
            a, b = (out[c] for c in of)
            found = {"ratio": safe_ratio, "eccentricity": ellipse_eccentricity, "sum": lambda x, y: x + y, "difference": axis_asymmetry}[kind](a, b)
        if found is not None:
            out[name] = found
    return out


def clean_signal(df: DataFrame, by: list[str], at: str, value: str, limits: tuple[float, ...] = (5.0, 3.0)) -> DataFrame:
    """value filled by lines between its neighbours, cut at SDs from the mean, one limit after another, and filled again; n_missing and n_clipped per recording."""
    rows = df.withColumn("n_missing", F.count_if(F.col(value).isNull()).over(Window.partitionBy(*by)))
    return interpolate_linear(sigma_clip(interpolate_linear(rows, by, at, value), by, value, limits), by, at, value)


def movements(df: DataFrame, by: list[str], at: str, value: str, share: float = 0.10, min_frames: int = 3) -> DataFrame:
    """df with movement_id and movement_kind from extrema that stand out by a share of the distance from the 5th to the 95th percentile."""
    spans = df.groupBy(*by).agg(quantiles(value, [0.05, 0.95]).alias("_q"), F.count(value).alias("_n"))
    spans = spans.select(*by, F.when(F.get("_q", F.lit(1)) > F.get("_q", F.lit(0)), (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))) * share).alias("_least"), "_n")
    rows = df.join(spans, by)
    found = prominent_extrema(rows.where(F.col("_n") >= max(6, 2 * min_frames)), by, at, value, "_least").select(*by, at, "kind")
    return movement_windows(df, found, by, at, min_frames + 1)


SUMMARIES = ("mean", "sd", "median", "iqr", "p05", "p95", "range_p05_p95", "min", "max")


def signal_summaries(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, SD, median, IQR, p05, p95, their distance, min and max of each group."""
    q = [F.get("_q", F.lit(k)) for k in range(5)]
    found = long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), quantiles(value, [0.05, 0.25, 0.5, 0.75, 0.95]).alias("_q"), F.min(value).alias("min"), F.max(value).alias("max"))
    return found.select(*keys, "mean", "sd", q[2].alias("median"), (q[3] - q[1]).alias("iqr"), q[0].alias("p05"), q[4].alias("p95"), (q[4] - q[0]).alias("range_p05_p95"), "min", "max")


def movement_summary(moved: DataFrame, by: list[str], at: str, time: str, signals: list[str]) -> DataFrame:
    """(by..., movement_id, movement_kind, n_frames, start_frame, end_frame, duration_s, signal, valid_fraction, median, iqr, p05, p95, range_p05_p95) per movement and signal."""
    keys = [*by, "movement_id"]
    rows = moved.where("movement_id IS NOT NULL").select(*keys, "movement_kind", at, time, *[finite(F.col(c).cast("double")).alias(f"_s{k}") for k, c in enumerate(signals)])
    # one aggregate for the spans and all signals, so that the movements are found once
    parts = [x for k in range(len(signals)) for x in (F.count(f"_s{k}").alias(f"_n{k}"), quantiles(f"_s{k}", [0.05, 0.25, 0.5, 0.75, 0.95]).alias(f"_q{k}"))]
    spans = rows.groupBy(*keys).agg(F.first("movement_kind").alias("movement_kind"), F.count("*").alias("n_frames"), F.min(at).alias("start_frame"), F.max(at).alias("end_frame"), F.when(F.count(time) >= 2, F.max(time) - F.min(time)).alias("duration_s"), *parts)
    told = [F.struct(F.lit(c).alias("signal"), (F.col(f"_n{k}") / F.col("n_frames")).alias("valid_fraction"), F.col(f"_q{k}").alias("_q")) for k, c in enumerate(signals)]
    q = [F.get("_x._q", F.lit(k)) for k in range(5)]
    found = spans.withColumn("_x", F.explode(F.array(*told)))
    return found.select(*keys, "movement_kind", "n_frames", "start_frame", "end_frame", "duration_s", "_x.signal", "_x.valid_fraction", q[2].alias("median"), (q[3] - q[1]).alias("iqr"), q[0].alias("p05"), q[4].alias("p95"), (q[4] - q[0]).alias("range_p05_p95"))


def movement_rollup(per_movement: DataFrame, by: list[str]) -> DataFrame:
    """Per recording and signal the movements, those that open and close, and median and IQR of the movements' medians and ranges."""
    q = lambda c: quantiles(c, [0.25, 0.5, 0.75])
    found = per_movement.groupBy(*by, "signal").agg(F.count("*").alias("n_movements"), F.count_if(F.col("movement_kind") == "open").alias("n_open"), F.count_if(F.col("movement_kind") == "close").alias("n_close"), q("median").alias("_m"), q("range_p05_p95").alias("_r"))
    return found.select(*by, "signal", "n_movements", "n_open", "n_close", *[x for c, n in (("_m", "median"), ("_r", "range")) for x in (F.get(c, F.lit(1)).alias(f"{n}_median"), (F.get(c, F.lit(2)) - F.get(c, F.lit(0))).alias(f"{n}_iqr"))])


# Families of scalars over movements: the signal, what of it, and the prefix.
LEVELS = (
    ("mouth_aperture", "velocity", "sLL_vert"), ("mouth_aperture", "acceleration", "aLL_vert"), ("outer_lip_spread", "velocity", "sLL_horz"), ("outer_lip_spread", "acceleration", "aLL_horz"),
    ("lip_aspect_ratio", None, "aspect"), ("jaw_lateralization", None, "jaw_lat"), ("lip_symmetry_ratio", None, "lip_symm_ratio"),
)
PATHS = (("mouth_aperture", "vert"), ("outer_lip_spread", "horz"))
_LEVEL_NAMES = {"p05": "prc_5", "median": "med", "p95": "prc_95", "range": "prc_5_95"}


def kinematic_scalars(normalized: DataFrame, by: list[str], at: str, time: str, detected: str = "detected", max_lag: int | None = None) -> DataFrame:
    """One row per recording: level, path and range families over movements, the commissures' cross-correlation, areas and eccentricity, computed scalars and flags.

    Signals are cleaned first; movements come from the mouth's aperture. max_lag bounds the lags of the cross-correlation,
    which are all of a recording's otherwise.
    """
    made = landmark_signals(normalized)
    frames = normalized.select(*by, at, time, F.col(detected).alias("_face"), *[c.alias(n) for n, c in made.items()])
    # all signals of a recording at once, as rows of one long table
    long = clean_signal(frames.unpivot([*by, at], list(made), "signal", "value"), [*by, "signal"], at, "value")
    wide = long.groupBy(*by, at).agg(*[F.max(F.when(F.col("signal") == n, F.col("value"))).alias(n) for n in made])
    frames = settled(frames.select(*by, at, time, "_face").join(wide, [*by, at]))
    moved = settled(movements(frames, by, at, "mouth_aperture") if "mouth_aperture" in made else frames.withColumns({"movement_id": F.lit(1), "movement_kind": F.lit("whole")}))
    flags = moved.groupBy(*by).agg(F.avg(F.col("_face").cast("int")).alias("_share"), F.count_distinct("movement_id").alias("n_movements"))
    out, scalars = flags, []
    speeds = moved
    for signal in dict.fromkeys(signal for signal, of, _ in LEVELS if of and signal in made):
        speeds = derivatives(speeds, by, at, signal, time).withColumns({f"_{signal}_{of}": F.abs(of) for of in ("velocity", "acceleration")}).drop("velocity", "acceleration", "jerk")
    speeds = settled(speeds)
    for signal, of, prefix in LEVELS:
        if signal in made:
            named = {f"{k}_median": f"{prefix}_{v}" for k, v in _LEVEL_NAMES.items()} | {f"{k}_iqr": f"{prefix}_{v}_iqr" for k, v in _LEVEL_NAMES.items()}
            out, scalars = out.join(level_family(speeds, by, signal if of is None else f"_{signal}_{of}").withColumnsRenamed(named), by, "left"), scalars + list(named.values())
    for signal, name in PATHS:
        if signal in made:
            paths = path_rom(moved, by, at, signal).withColumnsRenamed({"path_median": f"path_{name}_med", "path_iqr": f"path_{name}_iqr"})
            ranges = level_family(moved, by, signal).select(*by, F.col("range_median").alias(f"rom_{name}_med"), F.col("range_iqr").alias(f"rom_{name}_iqr"))
            out, scalars = out.join(paths, by, "left").join(ranges, by, "left"), [*scalars, *(f"{k}_{name}_{s}" for k in ("path", "rom") for s in ("med", "iqr"))]
    sides = ("left_commissure_reference_distance", "right_commissure_reference_distance")
    if set(sides) <= set(made):
        out, scalars = out.join(max_cross_correlation(frames, by, at, *sides, max_lag).withColumnRenamed("max_xcorr", "lat_xcorr"), by, "left"), [*scalars, "lat_xcorr"]
    means = [F.avg(c).alias(f"{c}_mean") for c in ("lip_eccentricity", "mouth_area_right", "mouth_area_left", "mouth_area_total", "mouth_area_abs_asymmetry") if c in made]
    if "lip_eccentricity" in made:
        means.append((F.max("lip_eccentricity") - F.min("lip_eccentricity")).alias("lip_eccentricity_range"))
    if "lower_lip_lateralization" in made:
        means.append((_q("lower_lip_lateralization", 0.95) - _q("lower_lip_lateralization", 0.05)).alias("lower_lip_lateralization_range"))
    out = out.join(frames.groupBy(*by).agg(*means), by, "left") if means else out
    told = reason_list([(F.col("_share") < 0.75, "low_face_detection"), (F.lit(len(made) < len(SIGNALS)), "missing_feature_inputs"), (F.col("n_movements") <= 1, "no_clear_repetitions")], "", ";")
    computed = sum((F.col(c).isNotNull().cast("int") for c in scalars), F.lit(0))
    return out.withColumns({"n_scalars_expected": F.lit(len(LEVELS) * 8 + len(PATHS) * 4 + 1), "n_scalars_computed": computed, "feature_qc_flags": told}).drop("_share")


def speed_summaries(frames: DataFrame, by: list[str], at: str, value: str, time: str) -> DataFrame:
    """(by..., of, mean ... max) of a signal, of the sizes of its velocity, acceleration and jerk, and the path length on the row of the velocity."""
    rows = derivatives(frames.select(*by, at, time, value), by, at, value, time)
    sizes = rows.select(*by, F.col(value).alias("value"), *[F.abs(c).alias(c) for c in ("velocity", "acceleration", "jerk")])
    long = sizes.unpivot(by, ["value", "velocity", "acceleration", "jerk"], "of", "x")
    paths = path_length(rows, by, at, "velocity", time).withColumn("of", F.lit("velocity"))
    return signal_summaries(long, [*by, "of"], "x").join(paths, [*by, "of"], "left")
