"""Roles of columns, names and file names: what a table's columns are, and what a file's name tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import any_of, normalize_name, usable, worst_of
from quillon.functions.shared import global_rank

# Normalised names of columns by role.
IDENTIFIERS = (
    "file_name", "filename", "file", "source_file", "source_path", "path", "relative_path", "absolute_path", "record_key", "recording_id", "sample_id", "subject_id", "participant_id",
    "patient_id", "session_id", "visit_id", "clinical_visit_id", "protocol_id", "iteration", "trial", "project", "project_name", "video_id", "audio_id", "media_id", "raw_media_file_name",
)
TASKS = ("task", "task_name", "prompt", "elicitation", "passage_name")
TIMES = ("date", "recording_date", "visit_date", "session_date", "timestamp", "timepoint", "time_point", "days_from_baseline", "months_from_baseline")
TARGETS = (
    "diagnosis", "dx", "group", "class", "label", "target", "outcome", "severity", "severity_bin", "severity_class", "severity_score", "alsfrs", "alsfrs_total", "alsfrs_total_score", "alsfrs_r",
    "alsfrs_bulbar", "alsfrs_bulbar_subscore", "alsbdi", "alsbdi_total", "progression_rate", "progressor", "disease_progression", "sentence_intelligibility_percent",
)
COVARIATES = ("age", "sex", "gender", "site", "device", "microphone", "language", "dialect", "education", "handedness", "onset_site", "disease_duration")
# Patterns of normalised names.
AUDIT_NAMES = r"(^|_)status($|_)|(^|_)warning|(^|_)flag|(^|_)reason|implementation_status|feature_status|computed_proxy|validity|manifest|hash|sha256|version|path|error|message|^n_frames$|^n_signals_aggregated$|^aggregation_profile$"
QC_NAMES = r"(^|_)qc($|_)|quality|snr|clip|clipping|noise|hum|interference|reverb|echo|dropout|gain|distortion|powerline|saturation|artifact|contamination|valid_fraction|face_detected_fraction|tracking_fraction|detection_fraction"
FEATURE_NAMES = (
    r"^f0|^cpp|^hnr|jitter|shimmer|voicebreak|^h1|^h2|^f[1-5]($|_)|formant|bandwidth|_bw$|slope|d_dx|range$|a1p0|a1p1|a3p0|p0|p1|rms|speech_dur|total_dur|pause|phrase|speech_rate|intensity|fft_|nrj_"
    r"|ratio_below_above|ddk|coord|comp$|velocity|distance|angle|area|landmark|kinematic"
)
ROLES = ("Identifier", "Feature", "QC feature", "Target / label", "Covariate", "Task", "Time / visit", "Audit / status", "Ignore")

# Names of acoustic features by family; other names are articulatory.
ACOUSTIC_FAMILIES = {
    "timing_respiratory": ("total_dur", "speech_dur", "percent_pause", "num_pause", "mean_pause_dur", "mean_phrase_dur", "cv_pause_dur", "cv_phrase_dur", "total_pause_dur", "speech_rate"),
    "rhythm_ems": ("intensity_CV", "fft_peaks1", "fft_peaks2", "fft_ampli1", "fft_ampli2", "nrj_below_boundary", "nrj_above_boundary", "nrj_3_6", "ratio_below_above"),
    "phonatory": ("f0_mean", "f0_std", "CPP_mean", "HNR", "localJitter", "localabsoluteJitter", "rapJitter", "ppq5Jitter", "ddpJitter", "localShimmer", "localdbShimmer", "apq3Shimmer", "apq5Shimmer", "apq11Shimmer", "num_voicebreaks", "H1freq", "H1amp", "H2freq", "H2amp"),
    "coordination": ("CPP_F1_comp", "CPP_F2_comp", "F1_F2_comp"),
    "resonatory_nasality": ("A1P0", "A1P0comp", "A1P1", "A1P1comp", "A3P0", "P0freq", "P0amp", "P0prom", "P1amp", "F1freq", "F1amp", "F1width", "F2freq", "F2amp", "F2width", "F3freq", "F3amp", "F3width", "RMSamp"),
}
# Parts of lower-case names by family of exported features, in this order.
EXPORT_FAMILIES = {
    "acoustic": (
        ("respiratory_timing", "pause|phrase|speech_rate|total_dur|speech_dur"), ("phonatory_voice_quality", "jitter|shimmer|hnr|cpp|f0|pitch"), ("resonatory_articulatory", "^f[1-5]|formant"),
        ("spectral_cepstral", "mfcc|spectral|centroid|rolloff"), ("acoustic_other", ""),
    ),
    "kinematic": (
        ("mouth_aperture_opening", "aperture|rom_vert|sll_vert|all_vert|path_vert|mouth_height"), ("lip_spread_horizontal", "spread|rom_horz|sll_horz|all_horz|path_horz|mouth_width"),
        ("jaw_lower_face", "jaw|chin|lower_lip_to_chin|nose"), ("symmetry_coordination", "symm|asym|left_|right_|xcorr|coord"), ("velocity", "velocity|^sll"), ("acceleration", "^all|accel"), ("kinematic_other", ""),
    ),
}

# Tokens, and parts of names without separators, that stand for a task.
TASK_ALIASES = {
    "BAMBOO": "bamboo", "BAMBOOPASSAGE": "bamboo", "PASSAGE": "bamboo", "DDK": "ddk", "PA": "ddk_pa", "TA": "ddk_ta", "KA": "ddk_ka", "PATAKA": "ddk_pataka", "VOWEL": "sustained_vowel",
    "VOWELA": "sustained_vowel_a", "VOWEL_A": "sustained_vowel_a", "VC3": "vc3", "VC3G": "vc3g", "BOBBY": "buy_bobby_a_puppy", "BUYBOBBYAPUPPY": "buy_bobby_a_puppy",
    "SENTENCE": "sentence_reading", "SENTENCES": "sentence_reading", "READING": "sentence_reading",
}
# Which of a recording's files is read first.
EXTENSIONS = (".wav", ".mp4", ".webm")
# Parts of a path that tell a video's task, in this order.
PATH_TASKS = (("bamboo", "bamboo_passage"), ("pa-ta-ka", "ddk_pataka"), ("pataka", "ddk_pataka"), ("pa", "ddk_pa"), ("papa", "ddk_pa"), ("puppy", "buy_bobby_a_puppy"), ("smile", "smile"), ("open", "mouth_open_close"))

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric_columns(df: DataFrame, columns: list[str], lenient: bool = False) -> list[str]:
    """Those of `columns` with a numeric type; lenient: with at least one value that reads as a number (one pass over the rows)."""
    types = dict(df.dtypes)
    if not lenient:
        return [c for c in columns if types.get(c, "").startswith(NUMERIC)]
    have = [c for c in columns if c in types]
    n = df.agg(*[F.count(_number(F.col(c))).alias(f"c{k}") for k, c in enumerate(have)]).first() if have else []
    return [c for c, k in zip(have, n, strict=True) if k]


def _number(x: Column) -> Column:
    y = x.cast("string").try_cast("double")
    return F.when(~F.isnan(y), y)


def first_present(df: DataFrame, names: list[str]) -> str | None:
    """The first of `names`, compared in normalised form, that is a column with a usable value; one pass over the rows."""
    plain = lambda s: "_".join(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in s.strip().lower()).split())
    columns = {plain(c): c for c in df.columns}
    have = [columns[plain(n)] for n in names if plain(n) in columns]
    if not have:
        return None
    used = df.agg(*[F.count_if(usable(F.col(c))).alias(f"c{k}") for k, c in enumerate(have)]).first()
    return next((c for c, k in zip(have, used, strict=True) if k), None)


def first_available(columns: list[str], choices: list[tuple]) -> tuple | None:
    """The first tuple of columns all of which exist: a choice by the schema alone."""
    return next((c for c in choices if set(c) <= set(columns)), None)


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_valid, n_distinct, n_numbers, numeric_like) of each column, from counts per column and value."""
    types = dict(df.dtypes)
    typed = [c for c in df.columns if types[c].startswith((*NUMERIC, "boolean"))]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    values = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    is_number = F.col("column").isin(*typed) & F.col("value").isNotNull() if typed else F.lit(False)
    number = is_number | _number(F.col("value")).isNotNull()
    known = F.col("value").isNotNull() & (F.col("value") != "NaN")
    found = values.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_valid"), F.count_if(known).alias("n_distinct"), F.coalesce(F.sum(F.when(known & number, F.col("n"))), F.lit(0)).alias("n_numbers"))
    numeric = F.col("column").isin(*typed) if typed else F.lit(False)
    return found.withColumn("numeric_like", numeric | ((F.col("n_valid") > 0) & (F.col("n_numbers") >= 0.8 * F.col("n_valid"))))


def classify_columns(df: DataFrame, kind: str = "feature", registry: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
    """(column, role, confidence, reason, missing_fraction, unique_values, numeric_like): one row per column of a feature, qc or metadata table.

    Names are compared in normalised form; the first rule that holds gives the role. A registry is (feature, ...). profile is
    what profile_columns(df) gives, for several users of it.
    """
    p = (profile_columns(df) if profile is None else profile).withColumn("name", normalize_name(F.col("column")))
    if registry is not None:
        p = p.join(registry.select(normalize_name(F.col("feature")).alias("name"), F.lit(True).alias("_known")).distinct(), "name", "left")
    name, number = F.col("name"), F.col("numeric_like")
    known = F.coalesce("_known", F.lit(False)) if registry is not None else F.lit(False)
    few = F.col("n_distinct") <= F.least(F.lit(20), F.greatest(F.lit(3), F.floor(0.2 * F.greatest(F.col("n_valid"), F.lit(1)))))
    is_kind = lambda k: F.lit(kind == k)
    rules = [
        (name.isin(*TASKS), "Task", 0.96, "Names the task or prompt."),
        (name.isin(*IDENTIFIERS) | (~number & (name == "id")), "Identifier", 0.95, "Identifies rows."),
        (name.isin(*TIMES), "Time / visit", 0.92, "Tells when: a time, visit or date."),
        (name.rlike(AUDIT_NAMES), "Audit / status", 0.88, "Tells of processing (status, path, error), no feature."),
        (is_kind("qc") & number, "QC feature", 0.90, "Numbers in a table of quality metrics."),
        (name.rlike(QC_NAMES) & number, "QC feature", 0.86, "Its name is that of a quality metric."),
        (name.rlike(QC_NAMES), "Covariate", 0.86, "Its name is that of a quality metric."),
        (known & number, "Feature", 0.97, "Listed in the registry given."),
        (name.isin(*TARGETS), "Target / label", 0.90, "Named like a clinical outcome."),
        (name.isin(*COVARIATES), "Covariate", 0.88, "Named like a person's, device's or site's property."),
        (is_kind("metadata") & (~number | few), "Covariate", 0.72, "Describes rows in a metadata table."),
        (is_kind("metadata"), "Covariate", 0.60, "Numbers in a metadata table, taken as a covariate until told otherwise."),
        (name.rlike(FEATURE_NAMES) & number, "Feature", 0.94, "Numbers under a name that features have."),
        (is_kind("feature") & number, "Feature", 0.82, "Numbers in the main table, taken as a feature."),
        (~number & few, "Covariate", 0.62, "Few distinct texts, which may group rows."),
        (F.lit(True), "Ignore", 0.50, "Texts that no rule knows."),
    ]
    role = lambda k: worst_of([(r[0], r[k]) for r in rules[:-1]], rules[-1][k])
    return p.select("column", role(1).alias("role"), role(2).alias("confidence"), role(3).alias("reason"), (1 - F.col("n_valid") / F.col("n_rows")).alias("missing_fraction"), F.col("n_distinct").alias("unique_values"), "numeric_like")


def role_lists(mapping: DataFrame) -> dict[str, list[str]]:
    """Columns by role; a mapping has one row per column of a table."""
    out: dict[str, list[str]] = {}
    for r in mapping.select("role", "column").orderBy("role", "column").collect():
        out.setdefault(r["role"], []).append(r["column"])
    return out


def role_summary(mapping: DataFrame, examples: int = 8) -> DataFrame:
    """Columns per role, and the first of them by name."""
    return mapping.groupBy("role").agg(F.count("*").alias("n_columns"), F.array_join(F.slice(F.array_sort(F.collect_list("column")), 1, examples), ", ").alias("example_columns"))


def feature_family_of(name: Column) -> Column:
    """timing, rhythm, phonatory, coordination or resonatory by the exact name, else articulatory."""
    return worst_of([(name.isin(*names), family) for family, names in ACOUSTIC_FAMILIES.items()], "articulatory_formant")


def export_family_of(name: Column, modality: str) -> Column:
    """The family of an exported feature by parts of its name."""
    low, rules = F.lower(name), EXPORT_FAMILIES[modality]
    return worst_of([(low.rlike(p), family) for family, p in rules[:-1]], rules[-1][0])


def mask_unselected(df: DataFrame, features: list[str], selected: list[str]) -> DataFrame:
    """NULL in place of features that weren't selected, all other columns as they are; an empty selection keeps all."""
    gone = [c for c in features if c in df.columns and selected and c not in selected]
    return df.withColumns({c: F.lit(None).cast(dict(df.dtypes)[c]) for c in gone}) if gone else df


def expected_bounds(registry: DataFrame, low: list[str], high: list[str]) -> DataFrame:
    """registry with expected_low and expected_high: the first of each row's aliases that reads as a number."""
    pick = lambda names: F.coalesce(*[_number(F.col(c)) for c in names if c in registry.columns], F.lit(None).cast("double"))
    return registry.withColumn("expected_low", pick(low)).withColumn("expected_high", pick(high))


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def stem(path: Column) -> Column:
    """A file's name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def normalize_file_name(name: Column, extension: Column | None = None) -> Column:
    """The trimmed name without folders, with the extension where it has none; NULL for an empty one."""
    own = F.when(F.trim(name) != "", F.trim(name))
    if extension is not None:
        ext = F.trim(F.coalesce(extension, F.lit("")))
        ext = F.when(ext == "", "").when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
        own = F.when(base_name(own) == stem(own), F.concat(own, ext)).otherwise(own)
    return base_name(own)


def stem_key(name: Column) -> Column:
    """The stem in lower case without white space."""
    return F.lower(F.regexp_replace(stem(name), r"\s+", ""))


def extension_priority(name: Column) -> Column:
    """0 for the best extension; 99 for others than EXTENSIONS."""
    ext = F.lower(F.regexp_extract(base_name(name), r"(?<=.)(\.[^.]*)$", 1))
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, EXTENSIONS)), ext), F.lit(0)) - 1, F.lit(99)).cast("int")


def _alias_task(alias: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TASK_ALIASES.items() for x in kv]), alias)


def task_of(text: Column) -> Column:
    """The task of the first token that is an alias, else of the first alias in the joined tokens; NULL if there is none.

    Two regular expressions over the text find them, whatever the number of aliases; tokens hold letters and digits only.
    """
    aliases = [a for a in TASK_ALIASES if a.isalnum()]
    parts = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"))
    token = F.regexp_extract(parts, f"(?:^|_)({'|'.join(aliases)})(?=_|$)", 1)
    # of the branches the first that fits is taken, so aliases keep their order wherever they stand
    inside = F.regexp_replace(F.replace(parts, F.lit("_"), F.lit("")), "^(?:" + "|".join(f".*?({a}).*" for a in aliases) + "|.*)$", "".join(f"${k + 1}" for k in range(len(aliases))))
    return F.coalesce(_alias_task(token), _alias_task(inside))


def normalize_task(value: Column, file_name: Column | None = None) -> Column:
    """The task that a text names, else the text in lower case with underscores; for missing texts what the file's name tells."""
    own = F.coalesce(task_of(value), F.when(F.trim(value) != "", F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))))
    return own if file_name is None else F.coalesce(own, task_of(stem(file_name)))


def path_task(path: Column) -> Column:
    """The task that a video's path tells, in any case of letters."""
    return worst_of([(F.lower(path).contains(part), task) for part, task in PATH_TASKS], "unknown")


# Patterns of stems; the first group is the value.
SUBJECT = r"(?i)(?:SUBJ|S|ID)[_-]?([A-Za-z0-9]+)"
SESSION = r"(?i)(?:SESSION|SESS)[_-]?([A-Za-z0-9]+)"
ITERATION = r"(?i)(?:ITERATION|ITER|VISIT|V)[_-]?([0-9]+)"


def parse_filename(files: DataFrame, path: str, order: str, subject: str = SUBJECT, session: str = SESSION, iteration: str = ITERATION) -> DataFrame:
    """files with subject_id, session_id, iteration, task and metadata_notes, which tells each value that the name didn't give.

    The patterns' first groups give the values. Without a subject the first token stands in if it is letters and digits,
    else AUTO_SUBJECT_ and the file's number in the order of `order`; a missing session is SESSION01, a missing iteration 1.
    """
    name = stem(F.col(path))
    of = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    token = F.get(F.split(name, r"[_\-\s]+"), F.lit(0))
    token = F.when(token.rlike(r"(?i)^(SUBJ|S|ID)?[A-Za-z]*\d+"), token)
    # numbered before they are read: sorting looks at the rows twice
    rows = global_rank(files, [F.asc(order)], "_n")
    rows = rows.withColumns({"_s": of(subject), "_t": token, "session_id": of(session), "iteration": of(iteration), "task": task_of(name)})
    notes = [
        (F.col("_s").isNull() & F.col("_t").isNotNull(), "subject_id inferred from first filename token"), (F.col("_s").isNull() & F.col("_t").isNull(), "subject_id generated because filename parsing failed"),
        (F.col("session_id").isNull(), "session_id defaulted to SESSION01"), (F.col("iteration").isNull(), "iteration defaulted to 1"), (F.col("task").isNull(), "task could not be parsed; set to unknown_task"),
    ]
    said = F.concat_ws("; ", *[F.when(c, t) for c, t in notes])
    auto = F.format_string("AUTO_SUBJECT_%04d", F.col("_n"))
    return rows.withColumn("metadata_notes", said).withColumns({"subject_id": F.coalesce("_s", "_t", auto), "session_id": F.coalesce("session_id", F.lit("SESSION01")), "iteration": F.coalesce("iteration", F.lit("1")), "task": F.coalesce("task", F.lit("unknown_task"))}).drop("_s", "_t", "_n")


def dataset_inventory(df: DataFrame, roles: dict[str, list[str]], subject: str | None = None, session: str | None = None, task: str | None = None) -> DataFrame:
    """(section, metric, value): rows, columns, columns per role, distinct subjects, sessions and tasks, mean missingness of numeric features."""
    features = roles.get("Feature", [])
    numbers = numeric_columns(df, features)
    fixed = [("input", "feature_table_columns", len(df.columns)), ("roles", "detected_feature_columns", len(features)), ("roles", "numeric_feature_columns", len(numbers))]
    fixed += [("roles", f"detected_{label}_columns", len(roles.get(role, []))) for label, role in (("identifier", "Identifier"), ("target_label", "Target / label"), ("covariate", "Covariate"), ("task", "Task"), ("time", "Time / visit"))]
    counted = [("design", f"unique_{label}", F.count_distinct(c).cast("double")) for label, c in (("subjects", subject), ("sessions", session), ("tasks", task)) if c]
    if numbers:
        counted.append(("data_quality", "mean_feature_missingness", F.round(sum((F.avg(F.col(c).isNull().cast("int")) for c in numbers), F.lit(0.0)) / len(numbers), 4)))
    row = df.agg(F.count("*").cast("double").alias("feature_table_rows"), *[x.alias(m) for _, m, x in counted])
    places = {"feature_table_rows": "input", **{m: s for s, m, _ in [*fixed, *counted]}}
    row = row.withColumns({m: F.lit(float(v)) for _, m, v in fixed})
    tall = row.unpivot([], list(places), "metric", "value")
    return tall.select(F.element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), F.col("metric")).alias("section"), "metric", "value")


def screening_catalog(df: DataFrame, mapping: DataFrame, features: list[str], profile: DataFrame | None = None) -> DataFrame:
    """(variable, mapped_role, screening_type, numeric, n_valid, n_unique, missing_fraction): columns that may be outcomes or groups.

    Candidates have a target, covariate, task or time role, or a telling name, and are no features. profile is as in classify_columns().
    """
    typed = numeric_columns(df, df.columns)
    rest = [c for c in df.columns if c not in features]
    p = (profile_columns(df.select(*rest)) if profile is None else profile.where(F.col("column").isin(rest))).join(mapping.select("column", "role"), "column", "left").withColumn("mapped_role", F.coalesce("role", F.lit("unknown")))
    named = any_of([normalize_name(F.col("column")).contains(k) for k in SCREENED_NAMES])
    numeric = F.col("column").isin(*typed) if typed else F.lit(False)
    kind = worst_of([((F.col("n_valid") < 6) | (F.col("n_distinct") < 2), "insufficient"), (numeric & (F.col("n_distinct") > 10), "continuous_outcome"), (F.col("n_distinct") <= 20, "categorical_group")], "high_cardinality_skip")
    found = p.where(named | F.col("mapped_role").isin("Target / label", "Covariate", "Task", "Time / visit"))
    return found.select(F.col("column").alias("variable"), "mapped_role", kind.alias("screening_type"), numeric.alias("numeric"), "n_valid", F.col("n_distinct").alias("n_unique"), (1 - F.col("n_valid") / F.col("n_rows")).alias("missing_fraction"))


# Parts of normalised names of outcomes and groups.
SCREENED_NAMES = (
    "diagnosis", "dx", "group", "class", "label", "target", "outcome", "severity", "severity_bin", "severity_score", "alsfrs", "alsfrs_total", "alsfrs_bulbar", "alsbdi", "progression", "intelligibility",
    "task", "task_name", "prompt", "session", "visit", "timepoint", "sex", "gender", "age", "device", "microphone",
)
