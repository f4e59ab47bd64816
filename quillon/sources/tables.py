"""Tables by suffix, identifiers as text, media listings, and the writers of hand-offs and training tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.functions.scalars import finite

# The columns of a feature registry, in order, and the names each may come by.
REGISTRY_COLUMNS = {"feature": ("feature", "feature_name", "name", "column"), "family": ("family", "subsystem", "feature_family", "group", "domain"), "unit": ("unit",), "formula": ("formula",), "meaning": ("meaning", "definition"), "tier": ("tier",), "status": ("status",), "expected_low": ("expected_low", "min_expected", "low", "lower_bound"), "expected_high": ("expected_high", "max_expected", "high", "upper_bound")}


def trim_columns(df: DataFrame) -> DataFrame:
    """Column names without white space at their ends."""
    return df.toDF(*[c.strip() for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as NULL in all floating columns: aggregates skip NULL, but not NaN."""
    return df.select(*[finite(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def read_table(spark: SparkSession, path: str | None, txt_separator: str = "\t", infer: bool = True, text: tuple[str, ...] = ()) -> DataFrame | None:
    """CSV, TSV, TXT or Parquet by suffix, names trimmed, NaN as NULL; any other suffix is an error, no path is no table.

    With infer=False all columns of a text file stay strings, so that identifiers that look like numbers keep their form;
    `text` names columns that stay strings while the others are inferred. Lenient readers of .txt pass a comma.
    """
    if path is None:
        return None
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    separators = {"csv": ",", "tsv": "\t", "txt": txt_separator}
    if suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix in separators:
        reader = spark.read.option("header", True).option("sep", separators[suffix])
        df = reader.option("inferSchema", infer).csv(path)
        if infer and text:
            schema = StructType([StructField(f.name, StringType() if f.name.strip() in text else f.dataType) for f in df.schema])
            df = reader.schema(schema).csv(path)
    else:
        raise ValueError(f"unknown kind of table: {path}")
    return nan_to_null(trim_columns(df))


def list_media(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """(path, size, modified) of the files with one of the extensions, letters' case aside; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*[e.lower() for e in extensions])).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def normalize_registry(registry: DataFrame) -> DataFrame:
    """REGISTRY_COLUMNS in order, each from the first of its names that the table has; bounds as numbers."""
    out = []
    for name, aliases in REGISTRY_COLUMNS.items():
        have = [F.col(a) for a in aliases if a in registry.columns]
        column = F.coalesce(*have) if have else F.lit(None)
        out.append((column.try_cast("double") if name.startswith("expected") else column.cast("string")).alias(name))
    return registry.select(*out).where("feature IS NOT NULL")


def write_table(df: DataFrame, path: str, partition_by: str | None = None, csv: bool = False) -> None:
    """Parquet, or CSV with a header; folders are made, what was there is replaced, and an empty CSV table is its header alone."""
    if csv and partition_by is None and df.isEmpty():
        df = df.coalesce(1)  # a header needs one partition
        if not df.rdd.getNumPartitions():
            df = df.sparkSession.createDataFrame([], df.schema).repartition(1)
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.option("header", True).csv(path) if csv else writer.parquet(path)


def write_feature_handoff(values: DataFrame, registry: DataFrame, status: DataFrame, folder: str, modality: str) -> None:
    """Values, registry and status of a modality in a folder of their own, and then a one-row manifest that names it and tells how many rows each has.

    The manifest is replaced last: until then it names the tables of the hand-off before.
    """
    version = uuid.uuid4().hex
    tables = {"values": values, "registry": normalize_registry(registry), "status": status}
    spark = values.sparkSession
    for name, df in tables.items():
        write_table(df, f"{folder}/{version}/{name}")
    counts = [spark.read.parquet(f"{folder}/{version}/{name}").count() for name in tables]
    write_table(spark.createDataFrame([(modality, version, *counts)], "modality string, version string, n_values long, n_registry long, n_status long"), f"{folder}/manifest")


def read_feature_handoff(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the hand-off that the manifest names."""
    version = spark.read.parquet(f"{folder}/manifest").first()["version"]
    return {name: spark.read.parquet(f"{folder}/{version}/{name}") for name in ("values", "registry", "status")}


def write_ml_tables(df: DataFrame, ids: list[str], context: list[str], predictors: list[str], folder: str, partition_by: str | None = None) -> None:
    """ids and predictors; ids, context and predictors; predictors alone."""
    for name, columns in {"ids_predictors": [*ids, *predictors], "ids_context_predictors": [*ids, *context, *predictors], "predictors": predictors}.items():
        write_table(df.select(*columns), f"{folder}/{name}", partition_by if partition_by in columns else None)
