"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k of their ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.llm._batches import LOWER, SPACED_WORD, free_names, holds_cache, mix, shared_folder, span_hashes, text_slices, word_spans, written

BUCKET_BITS = 16
TARGET_ROWS = 20_000
PASSAGE = 24
BENEFIT = 3.0
PRIOR_GRAMS = 16
SMOOTH = 5.0
SEED = "pick-1"

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_IS_UPPER = np.zeros(256, np.int64)
_IS_UPPER[65:91] = 1
_IS_MARK = (SPACED_WORD & (_KIND == 0)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row of each): hashed n-grams of rows of text.

    Per word between white space: the lower-cased word, the pair with the next word, its shape (capitals and marks by
    number, length, whether it repeats the word before) and the shapes of three words in a row.
    """
    starts, ends, first = word_spans(data, offsets, SPACED_WORD)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(starts):
        return np.zeros(0, np.int64), row
    word = span_hashes(LOWER[data], starts, ends)
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags[data])])
    n_upper, n_mark = ((c := upto(f))[ends] - c[starts] for f in (_IS_UPPER, _IS_MARK))
    size = ends - starts
    same = np.zeros(len(word), np.int64)
    pair = row[1:] == row[:-1]
    same[1:] = pair & (word[1:] == word[:-1])
    shape = np.minimum(n_upper, 3) + 4 * np.minimum(n_mark, 3) + 16 * np.minimum(size // 3, 5) + 128 * same
    shape_hash = mix(shape.astype(np.uint64) + np.uint64(0x51ED270B))
    triple = row[2:] == row[:-2]
    c = np.uint64(0x9E3779B97F4A7C15)
    grams = [word, mix(word[:-1] * c + word[1:])[pair], shape_hash, mix((shape_hash[:-2] * c + shape_hash[1:-1]) * c + shape_hash[2:])[triple]]
    rows = [row, row[1:][pair], row, row[2:][triple]]
    return (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def bucket_counts(docs: DataFrame, target: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(bucket, raw, target) over all rows of docs (id, text), and over those whose id is in target, one id a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("importance")
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                at, row = features(data, offsets, bits)
                wanted = np.asarray(part.column("wanted").to_numpy(zero_copy_only=False), bool)
                raw += np.bincount(at, minlength=1 << bits)
                good += np.bincount(at[wanted[row]], minlength=1 << bits)
        have = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(raw[have]), pa.array(good[have])], names=["bucket", "raw", "target"])

    marked = docs.join(F.broadcast(target.select("id", F.lit(True).alias("wanted"))), "id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    return marked.mapInArrow(count, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


class Ratios:
    """log p_target - log p_raw of hashed n-grams, a document's own ones left out; two arrays of 2**bits, whatever the input's size.

    Counts are smoothed by SMOOTH expected ones. An n-gram would otherwise tell whether the document itself was counted in the
    target, not what it looks like; so a document's own n-grams don't count, in any bucket.
    """

    def __init__(self, counts: DataFrame, bits: int = BUCKET_BITS):
        self.raw, self.target = np.zeros(1 << bits), np.zeros(1 << bits)
        for r in counts.collect():  # at most 2**bits rows
            self.raw[r["bucket"]], self.target[r["bucket"]] = r["raw"], r["target"]
        self.share = self.target.sum() / max(self.raw.sum(), 1)

    def of(self, buckets: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The log-ratio of each n-gram; wanted: whether a row was counted in the target."""
        if not self.share:
            return np.zeros(len(buckets))
        seen, at, own = np.unique(rows * len(self.raw) + buckets, return_inverse=True, return_counts=True)
        row, bucket = np.divmod(seen, len(self.raw))
        raw, target = self.raw[bucket] - own, self.target[bucket] - own * wanted[row]
        return np.log((np.maximum(target, 0) + SMOOTH) / (self.share * np.maximum(raw, 0) + SMOOTH))[at]


def smallest_kept(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of column key, found by counting in ever narrower ranges; None if k is not below the number of rows."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return None
    if k <= 0:
        return float("inf")
    above = 0
    while low < high:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        share = (F.col("key") / 2 - low / 2) / ((high / 2 - low / 2) or 1.0)  # halves, as the width itself may be beyond the largest double
        found = inside.groupBy(F.when(F.col("key") >= high, 1023).otherwise(F.least(F.floor(share * 1023), F.lit(1022))).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()  # at most 1024 rows
        for r in found:
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def target_ids(labels: DataFrame, id_col: str, quality_col: str, target_rows: int) -> DataFrame:
    """(id) of at most target_rows documents labelled quality 1, those with the smallest hash: so few that they can be broadcast."""
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(quality_col).cast("int").alias("q")).where("id IS NOT NULL AND q IN (0, 1)").groupBy("id").agg(F.min("q").alias("q"))
    return marks.where("q = 1").orderBy(F.xxhash64("id"), "id").limit(target_rows).select("id")


def with_key(docs: DataFrame, ratios: Ratios, target: DataFrame, id_col: str, text_col: str, passage: int = PASSAGE, seed: str = SEED) -> tuple[DataFrame, str, str]:
    """(docs with two more columns, their names): the log-weight and the key, its sum with Gumbel noise; both NULL for texts without a word."""
    log_weight, key, wanted, target_id, is_target = free_names(docs, "log_weight", "key", "wanted", "target_id", "is_target")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("importance")
        for batch in batches:
            for part, data, offsets in text_slices(batch, text_col):
                at, row = features(data, offsets)
                counted = np.asarray(part.column(wanted).to_numpy(zero_copy_only=False), bool)
                n = np.bincount(row, minlength=len(part))
                total = np.bincount(row, ratios.of(at, row, counted), minlength=len(part))
                weight = pa.array(passage * total / (n + PRIOR_GRAMS), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], weight], names=[*part.schema.names[:-1], log_weight])

    schema = StructType([*docs.schema.fields, StructField(log_weight, DoubleType())])
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    marks = F.broadcast(target.select(F.col("id").alias(target_id), F.lit(True).alias(is_target)))
    marked = docs.join(marks, F.col(id_col).cast("bigint") == F.col(target_id), "left").select(*[F.col(c) for c in docs.columns], F.coalesce(is_target, F.lit(False)).alias(wanted))
    return marked.mapInArrow(weigh, schema).withColumn(key, F.col(log_weight) - F.log(-F.log(u))), log_weight, key


def least_key(keys: DataFrame, keep: float | None = None, benefit: float = BENEFIT) -> float | None:
    """The smallest key kept, of a table (log_weight, key); None: all."""
    n, like = keys.agg(F.count("key"), F.sum(F.least(F.lit(1.0), F.exp(F.col("log_weight") + benefit)))).first()
    return smallest_kept(keys, round(like or 0.0) if keep is None else int(np.ceil(keep * n)))


def is_kept(key: Column, least: float | None) -> Column:
    return key.isNotNull() if least is None else F.coalesce(key >= F.lit(least), F.lit(False))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", keep: float | None = None, benefit: float = BENEFIT, target_rows: int = TARGET_ROWS, passage: int = PASSAGE, seed: str = SEED) -> DataFrame:
    """(id, log_weight, key, kept): documents drawn without replacement, as likely as they look like the target text.

    Target: documents labelled quality 1, at most target_rows of them, those with the smallest hash of the id. Raw: all
    documents. log_weight is `passage` times the mean log-ratio of a document's hashed n-grams (PRIOR_GRAMS neutral ones
    are counted in), i.e. the importance weight of a passage of that many n-grams, so that long documents don't
    outweigh short ones. Adding Gumbel noise, made from the md5 of seed and id, and keeping the k largest keys draws k
    documents by their weights. k is the share `keep` of the rows; by default the number of documents that the two
    models expect to be like the target: the sum of min(1, exp(log_weight + benefit)), with `benefit` nats of doubt in
    a document's favour.

    One row per input row. NULL and empty texts have no n-grams and log_weight NULL: they are never kept. Repeated rows
    get equal keys and are kept or not together; rows that tie at the k-th key are all kept. NULL ids share one noise.
    Without any label of quality 1 the weights are 0 and all rows with a word are kept; an empty table gives an empty one.
    Other columns are not read.
    """
    spark = docs.sparkSession
    target = target_ids(labels, id_col, quality_col, target_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    weighed, log_weight, key = with_key(rows, Ratios(bucket_counts(rows, target)), target, "id", "text", passage, seed)
    keys = weighed.select("id", F.col(log_weight).alias("log_weight"), F.col(key).alias("key"))
    keys = written(keys, f"{shared_folder(spark)}/keys")
    return keys.withColumn("kept", is_kept(F.col("key"), least_key(keys, keep, benefit)))


def keep_resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", keep: float | None = None, benefit: float = BENEFIT, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The rows of docs that resample keeps, all columns as they were; weighs the texts again instead of joining them."""
    spark = docs.sparkSession
    target = target_ids(labels, id_col, quality_col, target_rows)
    ratios = Ratios(bucket_counts(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), target))
    weighed, log_weight, key = with_key(docs.select(id_col, text_col), ratios, target, id_col, text_col)
    keys = weighed.select(F.col(log_weight).alias("log_weight"), F.col(key).alias("key"))
    keys = written(keys, f"{shared_folder(spark)}/keys")
    weighed, log_weight, key = with_key(docs, ratios, target, id_col, text_col)
    return weighed.where(is_kept(F.col(key), least_key(keys, keep, benefit))).drop(log_weight, key)


def op8_importance(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, labels).withColumnRenamed("id", "doc_id")
