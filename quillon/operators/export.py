"""Hand-off of features for learning: column manifests, modality tables, fused tables, contracts, exclusions and plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import normalize_name, truthy, worst_of
from quillon.operators.assemble import apply_qc_policy, early_fusion, first_shared_key, join_new_columns, leakage_precheck, modality_overlap, prefix_features, problem_type
from quillon.operators.columns import export_family_of, numeric_columns

# Columns that identify rows, that may be targets, and parts of names that tell provenance or quality.
ID_COLUMNS = ("subject_id", "participant_id", "patient_id", "session_id", "visit_id", "iteration", "task", "recording_date", "record_key", "file_name", "video_id", "audio_id", "recording_id")
TARGET_COLUMNS = ("diagnosis", "disease_group", "group", "severity_score", "severity_bin", "alsfrs_r", "alsfrs_r_bulbar", "updrs", "days_from_baseline")
PROVENANCE_NAMES = "path|source|input_|output_|csv|wav|video|file_name"
QC_NAMES = "qc|status|flag|valid_fraction|detected_fraction|n_frames|n_signals|n_movements|aggregation_profile|duration_s"
CONTEXT_COLUMNS = ("subject_id", "session_id", "visit_id", "task", "recording_id", "record_key", "file_name", "video_id", "diagnosis", "severity_score", "severity_bin")
# Keys by which two modalities are aligned, the first that both have.
ALIGNMENT_KEYS = [["record_key"], ["subject_id", "session_id", "task"], ["subject_id", "visit_id", "task"], ["subject_id", "task"], ["subject_id"]]
JOIN_KEYS = ["subject_id", "session_id", "visit_id", "iteration", "task", "record_key", "recording_id"]
# Parts of lower-case names by what a column measures, and endings by the statistic it is; in this order.
PRIMITIVES = (("velocity", "velocity|^sll|speed"), ("acceleration", "^all|accel"), ("path", "path"), ("range_distribution", "rom|range|p95|p05"), ("variability", "iqr|sd|cv"), ("symmetry_coordination", "ratio|symm|asym|xcorr"))
STATISTICS = (("range_p05_p95", "range_p05_p95"), *((s, f"_{s}$") for s in ("median", "mean", "iqr", "p05", "p95", "min", "max", "sd", "std")), ("median", "_med$"), ("p95_minus_p05", "prc_5_95"), ("p95", "prc_95"), ("p05", "prc_5"))


def _by_part(name: Column, rules: tuple[tuple[str, str], ...], other: str) -> Column:
    return worst_of([(F.lower(name).rlike(pattern), label) for label, pattern in rules], other)


def column_manifest(df: DataFrame, modality: str, registry: DataFrame | None = None) -> DataFrame:
    """(column, modality, role, family, primitive, summary_statistic, include_in_ml_default, is_numeric): one row per column.

    Identifiers, targets, provenance and quality columns are told by name, predictors are the numeric rest; a registry's
    family (feature, family) goes before the one by name.
    """
    numbers = numeric_columns(df, df.columns)
    rows = df.sparkSession.createDataFrame([(c, c in numbers) for c in df.columns], "column string, is_numeric boolean")
    name, low = F.col("column"), F.lower("column")
    role = worst_of([(name.isin(*ID_COLUMNS), "id"), (name.isin(*TARGET_COLUMNS), "target_candidate"), (low.rlike(PROVENANCE_NAMES), "provenance"), (low.rlike(QC_NAMES), "qc_metric"), (F.col("is_numeric"), f"{modality}_predictor")], "metadata")
    rows = rows.withColumn("role", role).withColumn("include_in_ml_default", F.col("role").endswith("_predictor"))
    by_name = export_family_of(name, modality)
    if registry is not None:
        known = registry.select(F.lower("feature").alias("_n"), F.col("family").alias("_f")).dropDuplicates(["_n"])
        rows = rows.join(known, low == F.col("_n"), "left")
        by_name = F.coalesce("_f", by_name)
    family = F.when(F.col("include_in_ml_default"), by_name).when(F.col("role") == "qc_metric", "quality_control").when(F.col("role") == "target_candidate", "target_outcome").when(F.col("role") == "id", "row_identity").when(F.col("role") == "provenance", "provenance").otherwise("")
    return rows.select("column", F.lit(modality).alias("modality"), "role", family.alias("family"), _by_part(name, PRIMITIVES, "scalar").alias("primitive"), _by_part(name, STATISTICS, "file_scalar").alias("summary_statistic"), "include_in_ml_default", "is_numeric")


def _included(df: DataFrame, manifest: DataFrame) -> list[str]:
    found = {r[0] for r in manifest.where("include_in_ml_default").select("column").collect()}  # one row per column
    return [c for c in df.columns if c in found]


def make_ml_ready(df: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, identifiers, targets and predictors; predictors alone), by the manifest."""
    roles = {r["column"]: r["role"] for r in manifest.select("column", "role").collect()}  # one row per column
    predictors = _included(df, manifest)
    context = [c for c in CONTEXT_COLUMNS if c in df.columns]
    context += [c for c in df.columns if roles.get(c) in ("id", "target_candidate") and c not in context]
    return df.select(*context, *[c for c in predictors if c not in context]), df.select(*predictors)


def ml_ready_prefixed(df: DataFrame, manifest: DataFrame, modality: str) -> DataFrame:
    """make_ml_ready's first table with predictors renamed to modality__name; identifiers and targets keep their names."""
    table, _ = make_ml_ready(df, manifest)
    return prefix_features(table, [c for c in _included(df, manifest) if c not in (*ID_COLUMNS, *TARGET_COLUMNS) and not c.startswith(f"{modality}__")], modality)


def join_metadata(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """LEFT join by the record key, else subject, session and task, else subject and task, else the first shared key; only new columns are added."""
    keys = first_shared_key(df, metadata, [["record_key"], ["subject_id", "session_id", "task"], ["subject_id", "task"], *([c] for c in ("subject_id", "session_id", "visit_id", "task", "file_name", "video_id"))])
    return join_new_columns(df, metadata, keys) if keys else df


@dataclass(frozen=True)
class Package:
    """What is handed off: tables by name, and the keys of the fusion."""

    tables: dict[str, DataFrame]
    keys: list[str]


def ml_export_package(modalities: dict[str, DataFrame], metadata: DataFrame | None = None, registries: dict[str, DataFrame] | None = None) -> Package:
    """Per modality its ml_ready, features_only and manifest tables; the fused table of the first two by their first shared keys, their alignment, and what is missing."""
    tables, prefixed = {}, {}
    for name, df in modalities.items():
        df = df if metadata is None else join_metadata(df, metadata)
        manifest = column_manifest(df, name, (registries or {}).get(name))
        tables[f"{name}_ml_ready"], tables[f"{name}_features_only"] = make_ml_ready(df, manifest)
        tables[f"{name}_manifest"], prefixed[name] = manifest, ml_ready_prefixed(df, manifest, name)
    manifests = [tables[f"{name}_manifest"] for name in modalities]
    if manifests:
        tables["feature_manifest"] = manifests[0] if len(manifests) == 1 else manifests[0].unionByName(manifests[1])
    keys: list[str] = []
    if len(prefixed) > 1:
        a, b = [*prefixed.values()][:2]
        keys = first_shared_key(a, b, ALIGNMENT_KEYS)
        if keys:
            other = b.select(*keys, *[c for c in b.columns if c not in keys and c not in (*ID_COLUMNS, *TARGET_COLUMNS)])
            tables["early_fusion_ml_ready"] = a.join(other.drop(*[c for c in other.columns if c in a.columns and c not in keys]), keys)
    return Package(tables, keys)


def exclusion_ledger(excluded: dict[str, DataFrame], a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """(modality, keys..., reason): rows that a policy left out, by modality, and keys that the other modality lacks."""
    out = None
    for name, df in excluded.items():
        part = df.select(F.lit(name).alias("modality"), *keys, "reason")
        out = part if out is None else out.unionByName(part)
    for name, x, y, other in ((names[0], a, b, names[1]), (names[1], b, a, names[0])):
        part = x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").select(F.lit(name).alias("modality"), *keys, F.lit(f"missing_{other}").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def selected_predictors(df: DataFrame, manifest: DataFrame, column: str = "column_name") -> list[str]:
    """The manifest's included columns that df has with at least one value that reads as a number."""
    wanted = {r[0] for r in manifest.where(truthy(F.col("include_in_ml_default"))).select(column).collect()}  # one row per column
    return numeric_columns(df, [c for c in df.columns if c in wanted], lenient=True)


def ml_dataset_contract(modalities: dict[str, DataFrame], manifests: dict[str, DataFrame], metadata: DataFrame, keys: list[str], policy: str = "pass_review", target: str | None = None, matched: bool = False, statuses: tuple[str, ...] = ("qc_status", "status", "normalization_status")) -> Package:
    """Tables <modality>_only and early_fusion of rows that the policy lets through, with predictors as numbers and prefixed, metadata joined; overlap, exclusions and a summary.

    matched keeps only subjects of the fused table in the single ones. The summary is (item, value): rows, predictors, the
    kind of problem that the target poses, and the check for leakage of each table.
    """
    ready, gone, tables = {}, {}, {}
    for name, df in modalities.items():
        kept, gone[name] = apply_qc_policy(df, [c for c in statuses if c in df.columns], policy)
        used = [c for c in selected_predictors(kept, manifests[name]) if c not in keys]
        ready[name] = kept.select(*[c for c in keys if c in kept.columns], *[F.col(c).cast("string").try_cast("double").alias(f"{name}__{c}") for c in used])
    (first, a), (second, b) = [*ready.items()][:2]
    shared = [k for k in keys if k in a.columns and k in b.columns]
    fused = join_new_columns(early_fusion(a, b, shared), metadata, [k for k in keys if k in metadata.columns and k in shared])
    for name, df in ready.items():
        single = join_new_columns(df, metadata, [k for k in keys if k in df.columns and k in metadata.columns])
        tables[f"{name}_only"] = single.join(fused.select("subject_id").distinct(), "subject_id", "left_semi") if matched and "subject_id" in single.columns else single
    tables |= {"early_fusion": fused, "overlap": modality_overlap(a, b, shared), "exclusions": exclusion_ledger(gone, a, b, shared, (first, second))}
    facts = [("problem_type", problem_type(metadata, target) if target else "unconfigured")]
    for name in (f"{first}_only", f"{second}_only", "early_fusion"):
        df = tables[name]
        facts += [(f"{name}_rows", str(df.count())), (f"{name}_predictors", str(sum("__" in c for c in df.columns))), (f"{name}_leakage", leakage_precheck(df))]
    tables["summary"] = metadata.sparkSession.createDataFrame(facts, "item string, value string")
    return Package(tables, shared)


# What each decision means for the export.
DECISIONS = {
    "recommended": ("include_by_default", "Distributions / Outliers"), "recommended_with_caution": ("include_with_caution", "QC Integration"), "review_before_use": ("hold_pending_review", "QC Integration"),
    "exclude_or_recompute": ("exclude_or_recompute", "Missingness"), "exclude_by_default": ("exclude_by_default", "Distributions / Outliers"),
}
# The screen that a reason sends a feature to, the first that holds.
SCREENS = (("Missingness", "missingness"), ("QC Integration", "QC association"), ("Feature Relationships", "redundancy"), ("Reliability / Longitudinal", "repeatability"), ("Distributions / Outliers", ""))


def recommendation_plan(recommended: DataFrame, top: int = 3) -> DataFrame:
    """(decision, n_features, default_export_policy, top_current_reasons): all five decisions, those without features as well; reasons by frequency, then name."""
    rows = recommended.sparkSession.createDataFrame([(d, p) for d, (p, _) in DECISIONS.items()], "decision string, default_export_policy string")
    counts = recommended.groupBy(F.col("readiness_recommendation").alias("decision")).agg(F.count("*").alias("n"))
    reasons = recommended.select(F.col("readiness_recommendation").alias("decision"), F.explode(F.split("primary_reasons", "; ")).alias("reason")).groupBy("decision", "reason").agg(F.count("*").alias("k"))
    best = reasons.groupBy("decision").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "reason"))), 1, top), lambda x: x["reason"]), "; ").alias("r"))
    return rows.join(counts, "decision", "left").join(best, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n_features"), "default_export_policy", F.coalesce("r", F.lit("")).alias("top_current_reasons"))


def priority_review(recommended: DataFrame) -> DataFrame:
    """(feature, decision, readiness_score, next_screen) of features that aren't simply recommended; the queue's order is by score, then name."""
    why = F.col("primary_reasons")
    screen = worst_of([(why.contains("zero variance") | why.contains("variance"), "Distributions / Outliers"), *[(why.contains(part), name) for name, part in SCREENS[:-1]]], SCREENS[-1][0])
    return recommended.where("readiness_recommendation <> 'recommended'").select("feature", F.col("readiness_recommendation").alias("decision"), "readiness_score", screen.alias("next_screen"))


def handoff_counts(recommended: DataFrame) -> DataFrame:
    """(handoff_item, value): features exported by default, to be reviewed by hand, and held back or computed again."""
    d = F.col("readiness_recommendation")
    row = recommended.agg(F.count_if(F.col("ml_export_default")).alias("default_export_features"), F.count_if(d == "review_before_use").alias("manual_review_queue"), F.count_if(d.isin("exclude_or_recompute", "exclude_by_default")).alias("hold_or_recompute"))
    return row.unpivot([], row.columns, "handoff_item", "value")


# Decisions that each export profile takes in.
PROFILES = {"recommended": ("recommended",), "recommended_caution": ("recommended", "recommended_with_caution"), "review": ("recommended", "recommended_with_caution", "review_before_use"), "audit": ()}


def task_export(df: DataFrame, recommended: DataFrame, task: str | None, profile: str = "recommended_caution", keys: tuple[str, ...] = ("record_key", "subject_id", "session_id", "task"), targets: tuple[str, ...] = (), covariates: tuple[str, ...] = (), qc: tuple[str, ...] = (), task_col: str = "task") -> Package:
    """Tables matrix, targets, covariates, qc and manifest of one task's rows, or all: the features that the profile takes in; audit takes all."""
    rows = df if task is None else df.where(F.col(task_col) == task)
    allowed = PROFILES[profile]
    rec = recommended.select("feature", "readiness_recommendation", "readiness_score").withColumn("exported", F.col("readiness_recommendation").isin(*allowed) if allowed else F.lit(True))
    chosen = {r[0] for r in rec.where("exported").select("feature").collect()}  # one row per feature
    own = [k for k in keys if k in df.columns]
    part = lambda columns: rows.select(*own, *[c for c in columns if c in df.columns and c not in own])
    return Package({"matrix": part([c for c in df.columns if c in chosen]), "targets": part(targets), "covariates": part(covariates), "qc": part(qc), "manifest": rec}, own)


def native_segment_events(segments: DataFrame, index: DataFrame, by: list[str], context: list[str]) -> DataFrame:
    """Segments of all recordings as one table of events with the context columns of the index, numbered within a recording."""
    met = segments.join(index.select(*by, *context).dropDuplicates(by), by, "left")
    return met.select(*by, *context, F.col("segment_index").alias("event_index"), F.concat_ws("_", normalize_name(F.col("segment_type")), "segment_role").alias("event_type"), "start_sec", "end_sec", "duration_sec")
