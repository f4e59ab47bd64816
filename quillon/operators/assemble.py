"""Joins, set operations and the assembly of training tables: alignment, fusion, policies, exclusions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import any_of
from quillon.functions.shared import global_rank

# Quality statuses that each policy lets through.
POLICIES = {"pass_only": ("pass", "ok"), "pass_review": ("pass", "ok", "review", "monitor", "warning")}


def first_shared_key(left: DataFrame, right: DataFrame, cascade: list[list[str]]) -> list[str]:
    """The first set of keys that both tables have."""
    return next((k for k in cascade if set(k) <= set(left.columns) & set(right.columns)), [])


def join_new_columns(df: DataFrame, other: DataFrame, keys: list[str], suffix: str | None = None) -> DataFrame:
    """LEFT join with one row of `other` per key; columns that df has already are left out, or get the suffix."""
    clash = [c for c in other.columns if c in df.columns and c not in keys]
    other = other.drop(*clash) if suffix is None else other.withColumnsRenamed({c: c + suffix for c in clash})
    return df.join(other.dropDuplicates(keys), keys, "left")


def coalesce_join(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """LEFT join that fills missing values of shared columns from `other`, and adds its further ones."""
    shared = [c for c in other.columns if c in df.columns and c not in keys]
    met = df.join(other.dropDuplicates(keys).withColumnsRenamed({c: f"_{c}" for c in shared}), keys, "left")
    return met.withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(*[f"_{c}" for c in shared])


def prefix_features(df: DataFrame, features: list[str], modality: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{modality}__{c}" for c in features})


def early_fusion(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """INNER join of two modalities; refused when neither side has unique keys."""
    repeated = [not df.groupBy(*keys).count().where("count > 1").isEmpty() for df in (a, b)]
    if all(repeated):
        raise ValueError(f"{keys} are unique on neither side: the join would be many to many")
    return a.join(b.drop(*[c for c in b.columns if c in a.columns and c not in keys]), keys)


def alignment_report(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and unique keys of both sides, and keys that match, in one row."""
    per = a.groupBy(*keys).agg(F.count("*").alias("n_a")).join(b.groupBy(*keys).agg(F.count("*").alias("n_b")), keys, "full")
    return per.agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"), F.count("n_a").alias("keys_a"), F.count("n_b").alias("keys_b"), F.count_if(F.col("n_a").isNotNull() & F.col("n_b").isNotNull()).alias("matched_keys"))


def modality_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys in a only, in b only, in both, in any."""
    met = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    return met.agg(F.count_if(F.col("_b").isNull()).alias("a_only"), F.count_if(F.col("_a").isNull()).alias("b_only"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count("*").alias("any"))


def unmatched_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side that the other lacks, tagged with the side."""
    tag = lambda x, y, name: x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit(name))
    return tag(a, b, "a_only").unionByName(tag(b, a, "b_only"))


def matched_subjects(df: DataFrame, fused: DataFrame, subject: str = "subject_id") -> DataFrame:
    return df.join(fused.select(subject).distinct(), subject, "left_semi")


def apply_qc_policy(df: DataFrame, statuses: list[str], policy: str) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with a reason): one allowed status is enough; include_all keeps all rows."""
    if policy == "include_all" or not statuses:
        return df, df.where("false").withColumn("reason", F.lit(None).cast("string"))
    allowed = F.coalesce(any_of([F.coalesce(F.lower(F.trim(F.col(c))).isin(*POLICIES[policy]), F.lit(False)) for c in statuses]), F.lit(False))
    return df.where(allowed), df.where(~allowed).withColumn("reason", F.lit(f"qc_policy_{policy}"))


def file_match(files: DataFrame, metadata: DataFrame, priority: list[str]) -> DataFrame:
    """Files (path) with the metadata name that matches exactly (1.0) or by stem (0.92), else none; letters' case aside.

    Of metadata names with one stem the best extension by priority counts, then the first by name.
    """
    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    stem = lambda c: F.regexp_replace(F.lower(F.col(c)), r"\.[^.]*$", "")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.lower(ext)), F.lit(0))
    names = metadata.select(F.col("file_name").alias("name")).where("name IS NOT NULL").distinct().withColumn("_rank", F.when(rank == 0, len(priority) + 1).otherwise(rank))
    exact = names.groupBy(F.lower("name").alias("_low")).agg(F.min("name").alias("_exact"))
    by_stem = names.groupBy(stem("name").alias("_stem")).agg(F.min(F.struct("_rank", "name"))["name"].alias("_near"))
    met = files.withColumn("_low", F.lower("path")).withColumn("_stem", stem("path")).join(exact, "_low", "left").join(by_stem, "_stem", "left")
    return met.select("path", F.coalesce("_exact", "_near").alias("matched_name"), F.when(F.col("_exact").isNotNull(), 1.0).when(F.col("_near").isNotNull(), 0.92).otherwise(0.0).alias("match_confidence"))


def dedupe_by_stem(files: DataFrame, priority: list[str]) -> DataFrame:
    """(path, kept_path, keep): one file per stem, the best extension by priority, then the first path."""
    ext, stem = F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)), F.regexp_replace("path", r"\.[^.]*$", "")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), ext), F.lit(0)), F.lit(len(priority) + 1))
    w = Window.partitionBy("_stem").orderBy(rank, F.lower("path"), "path")
    return files.withColumn("_stem", stem).select("path", F.first("path").over(w).alias("kept_path"), (F.row_number().over(w) == 1).alias("keep"))


def group_split(df: DataFrame, subject: str, share: float = 0.2, seed: str = "0") -> DataFrame:
    """df with split: whole subjects, ceil(share) of them by the smallest md5 of seed and subject, are the test rows.

    The cut is the k-th smallest md5, found over subjects, not rows. Rows without a subject go to train.
    """
    subjects = df.select(subject).where(F.col(subject).isNotNull()).distinct().withColumn("_h", F.md5(F.concat(F.lit(seed + ":"), F.col(subject).cast("string"))))
    ranked = global_rank(subjects, [F.asc("_h"), F.asc(subject)], "_n")
    size = ranked.agg(F.ceil(F.count("*") * F.lit(share)).alias("_k"))
    test = ranked.join(F.broadcast(size)).where("_n <= _k").select(subject, F.lit("test").alias("split"))  # size is one row
    return df.join(test, subject, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def leakage_precheck(df: DataFrame, subject: str = "subject_id") -> str:
    """pass, or why whole subjects can't be kept apart."""
    if subject not in df.columns:
        return "missing_subject_column"
    return "pass" if df.agg(F.count_distinct(subject)).first()[0] >= 2 else "fewer_than_two_subjects"


def problem_type(df: DataFrame, target: str) -> str:
    """regression (over 90 % numbers, more than 8 distinct), binary, multiclass or unconfigured."""
    if target not in df.columns:
        return "unconfigured"
    x = F.col(target).cast("string")
    number, distinct = df.where(x.isNotNull()).agg(F.avg(F.expr(f"try_cast(CAST(`{target}` AS STRING) AS DOUBLE)").isNotNull().cast("int")), F.count_distinct(x)).first()
    if not distinct:
        return "unconfigured"
    return "regression" if number > 0.9 and distinct > 8 else "binary_classification" if distinct == 2 else "multiclass_classification"


def feature_status(long: DataFrame) -> DataFrame:
    """computed or missing for each recording and feature."""
    return long.select("record_key", "feature", F.when(F.col("value").isNotNull(), "computed").otherwise("missing").alias("status"))


def union_tables(tables: dict[str, DataFrame], tag: str = "modality") -> DataFrame:
    """Rows of all tables with the union of their columns, tagged by name."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().exceptAll(b.select(*keys).distinct())


def key_intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def align_feature_qc(features: DataFrame, qc: DataFrame, cascade: tuple[str, ...] = ("record_key", "file_name", "filename", "source_file", "subject_id", "session_id"), ordinal: str | None = None) -> tuple[DataFrame, str]:
    """(features with the columns of qc that they lack, how): LEFT join by the first shared key, else by an explicit ordinal column, else features alone."""
    keys = first_shared_key(features, qc, [[c] for c in cascade])
    if keys:
        return join_new_columns(features, qc, keys), keys[0]
    if ordinal is not None and ordinal in features.columns and ordinal in qc.columns:
        return join_new_columns(features, qc, [ordinal]), "row_order"
    return features, "none"


def join_all_shared_keys(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("record_key", "file_name", "subject_id")) -> DataFrame:
    """INNER join by all of the keys that both tables have; columns of b that a has already are left out."""
    shared = [k for k in keys if k in a.columns and k in b.columns]
    if not shared:
        raise ValueError(f"no shared key among {keys}")
    return a.join(b.drop(*[c for c in b.columns if c in a.columns and c not in shared]), shared)


def missing_policy(df: DataFrame, features: list[str], policy: str, limit: float = 0.5) -> DataFrame:
    """preserve: as it is; drop: without the features missing in more than `limit` of the rows; impute: missing values as the column's median."""
    from quillon.operators.aggregates import drop_sparse_features, impute_global_median

    return {"preserve": lambda: df, "drop": lambda: drop_sparse_features(df, features, limit), "impute": lambda: impute_global_median(df, features)}[policy]()
