"""From raw documents to token ids: the STAGES, each over all that the one before kept.

Columns of documents pass unchanged through all stages but the last, whose rows are the token index of op3: doc_id, start,
n_tokens and ids_crc32 per row of the mix. SQL cannot express the quality classifier, so there is no ORACLE_SQL; the
tests hold the pipeline against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm._batches import shared_folder, small_batches, written
from quillon.llm.decontaminate import drop_contaminated
from quillon.llm.importance import keep_resampled
from quillon.llm.mixing import label_weights, mixed_rows
from quillon.llm.neardup import drop_near_duplicates
from quillon.llm.planes import op3_token_planes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler keeps.

    NULL and empty texts and those without a word go; rows with a NULL id are weighed like any other; repeated rows and rows
    that tie at the last key stay or go together; an empty table gives an empty one; without labels all rows with a word stay.
    """
    small_batches(spark)
    return keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 or more of five-word shingles, the one with the smallest id.

    NULL, empty and wordless texts are linked with nothing and stay, as do rows with a NULL id; of rows that repeat a kept
    id the first by text stays; an empty table gives an empty one.
    """
    return drop_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    NULL and empty texts have no window and stay; NULL ids and repeated rows are looked up like any other; an empty table, or
    an empty benchmark, changes nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    NULL sources are one source, the last; NULL and empty texts have size 0 and come by whole epochs only; equal rows share
    the copies taken of them all; ties of keys go by size, id and text; an empty table gives an empty one.
    """
    return mixed_rows(docs, quality=label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def token_planes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what was taken, written as compressed planes, and their index read back.

    NULL and empty texts are the end id alone; NULL ids come first; repeated rows stand side by side, each with its own
    start; an empty table gives an empty index.
    """
    return op3_token_planes(spark, sf_dir, docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_planes", token_planes)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet and read again by the next."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/stage{k}")
    return docs
