"""Mixing sources to target weights: Efraimidis-Spirakis keys, sorted within source, prefix-summed to word budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import free_names, shared_folder, written

MAX_EPOCHS = 3
BUCKETS = 1024
#: Rows of a source that are sorted at most, and sources that are broadcast at most.
SORTED_ROWS = 4096
BROADCAST_SOURCES = 100_000
LAST = 1.7976931348623157e308
SEED = "mix-1"


def text_size(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def sampling_key(id_: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from the md5 of seed and id: the smallest keys are a weighted sample without replacement.

    Weights of 0 or less, and NaN, stand after all others.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.when((weight > 0) & ~F.isnan(weight), F.least(-F.log(u) / F.when(weight > 0, weight), F.lit(LAST))).otherwise(LAST)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets that share the total of all sizes by weight, none above max_epochs times its source's size.

    sizes has one row (source, source_size) per source. Sources by code point, NULL last, weigh as `weights` repeats.
    What a full source can't take is shared out among the rest by weight, again and again; the sources that end up full
    are those with the smallest size per weight, so running sums over that order find the final level at once.
    The only single-task windows of this module run here, over one row per source.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    full = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left_size", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(full), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(full), F.lit(0)))
        .withColumn("level", F.max(F.when(F.col("left_size") / F.col("left_weight") <= F.col("ratio"), F.col("left_size") / F.col("left_weight"))).over(Window.partitionBy()))
        .select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double")).alias("target"))
    )


_ORDER = ("key", "size", "text_hash")


def _known(few: DataFrame) -> DataFrame:
    """One row per source, broadcast while there are few sources."""
    return F.broadcast(few) if few.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else few


def cut_ranges(rows: DataFrame, targets: DataFrame, folder: str, bins: int = BUCKETS, most: int = SORTED_ROWS) -> DataFrame:
    """targets with low, high and before: the rows of a source between low and high hold the place where its target falls.

    low and high are structs of _ORDER; before is the size of the rows ahead of low. A range is cut into `bins`, by
    counting, again and again until it holds `most` rows or equal ones.
    """
    at = F.struct(*_ORDER)
    every = rows.groupBy("source").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("rows"))
    cut = every.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("before", F.lit(0).cast("bigint"))
    step = 0
    while True:
        cut = written(cut, f"{folder}/cut{step}")
        wide = cut.where(f"rows > {most} AND low < high")
        if wide.isEmpty():
            return cut
        limits = wide.select(F.col("source").alias("s"), "low", "high", "rest", "before")
        inside = rows.join(_known(limits), F.col("source").eqNullSafe(F.col("s"))).where((at >= F.col("low")) & (at <= F.col("high")))
        share = F.lit(0.0)
        for c in reversed(_ORDER):  # by the first column that differs
            x, low, high = (v.cast("double") for v in (F.col(c), F.col(f"low.{c}"), F.col(f"high.{c}")))
            share = F.when(low < high, (x - low) / F.nullif(high - low, F.lit(0.0))).otherwise(share)
        counted = inside.groupBy("source", F.when(at >= F.col("high"), bins - 1).otherwise(F.coalesce(F.least(F.floor(share * (bins - 1)), F.lit(bins - 2)), F.lit(0))).alias("bin")).agg(F.sum("size").alias("held"), F.count("*").alias("rows"), F.min(at).alias("low"), F.max(at).alias("high"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        ahead = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `bins` rows a source
        placed = counted.withColumn("before", F.col("before") + ahead)
        one = F.struct("bin", "low", "high", "rows", "before")
        found = placed.groupBy(F.col("source").alias("s")).agg(F.coalesce(F.min(F.when(F.col("before") + F.col("held") >= F.col("rest"), one)), F.max(one)).alias("x"))
        kept = [c for c in cut.columns if c not in ("low", "high", "rows", "before")]
        narrowed = wide.join(found, F.col("source").eqNullSafe(F.col("s"))).select(*kept, "x.low", "x.high", "x.rows", "x.before")
        cut = cut.where(f"NOT (rows > {most} AND low < high)").unionByName(narrowed)
        step += 1


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS, seed: str = SEED, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """How often a mix takes each document: (id, text_hash, source, size, source_size, target, copies, taken), one row per input row.

    Each source is taken whole floor(target / source_size) times; what is left of the target goes to the documents with
    the smallest sampling keys, up to and without the one after which the sum is farther from the target. Keys weigh by
    `quality` (id_col, weight), the mean of the rows of an id, 1 where it has none or NULL; weights of 0 or less come last.

    The range of keys in which a source's target falls is narrowed by sums over ever smaller ranges, and only the last
    one, of at most sorted_rows rows or of equal rows, is sorted. NULL text and empty text have size 0 and are copied by
    whole epochs only; NULL source is a source of its own, the last; equal keys (repeated ids) go by size, then
    text, then arbitrarily among equal rows. An empty table gives an empty one. Other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    if quality is None:
        rows = rows.withColumn("quality_weight", F.lit(1.0))
    else:
        rows = rows.join(quality.groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col("weight").cast("double")).alias("quality_weight")), "id", "left")
    rows = rows.select("id", "text_hash", "source", "size", sampling_key(F.col("id"), F.coalesce("quality_weight", F.lit(1.0)), seed).alias("key"))
    rows = written(rows, f"{folder}/rows")

    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(max_epochs))).otherwise(0).cast("int")).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    cut = cut_ranges(rows, targets, folder, buckets, sorted_rows).select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "low", "high", "before")
    marked = rows.join(_known(cut), F.col("source").eqNullSafe(F.col("s"))).withColumn("at", F.struct(*_ORDER))
    between = (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high"))
    order = Window.partitionBy("source").orderBy(*_ORDER, "id").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = marked.where(between).withColumn("upto", F.col("before") + F.sum("size").over(order))
    # the document that crosses the target is taken if that comes closer to it
    sorted_ = sorted_.withColumn("extra", ((F.col("size") > 0) & ((F.col("upto") - F.col("rest")) <= (F.col("rest") - (F.col("upto") - F.col("size"))))).cast("int")).drop("upto")
    whole = marked.where(~between).withColumn("extra", ((F.col("size") > 0) & (F.col("at") < F.col("low"))).cast("int"))
    return whole.unionByName(sorted_).select("id", "text_hash", "source", "size", "source_size", "target", (F.col("epochs") + F.col("extra")).alias("copies"), ((F.col("epochs") + F.col("extra")) * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies, all columns as they were.

    Of rows equal in id and text, the first by its other columns comes as often as the mix takes all of them.
    """
    mix_id, mix_hash, copies, copy, row, chunk = free_names(docs, "mix_id", "mix_hash", "copies", "copy", "row", "chunk")
    mix = mix_sources(docs, id_col, text_col, **options).groupBy("id", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("times"))
    mix = written(mix, f"{shared_folder(docs.sparkSession)}/copies").where("copies > 0")

    def joined(part: DataFrame) -> DataFrame:
        part = part.select(F.col("id").alias(mix_id), F.col("text_hash").alias(mix_hash), F.col("copies").alias(copies))
        return docs.join(part, F.col(id_col).eqNullSafe(F.col(mix_id)) & (F.xxhash64(text_col) == F.col(mix_hash)))

    once = joined(mix.where("times = 1")).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))).alias(copy)).select(*docs.columns)
    several = mix.where("times > 1")
    if several.isEmpty():
        return once
    first = joined(several).groupBy(mix_id, mix_hash, copies).agg(F.min(F.struct(*docs.columns)).alias(row))
    dealt = first.select(row, copies, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1, F.lit(1000).cast("bigint"))).alias(chunk)).repartition(chunk)
    again = dealt.select(row, F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col(copies) - F.col(chunk), F.lit(1000)))).alias(copy)).select(f"{row}.*")
    return once.unionByName(again)


LABEL_WEIGHTS = {1: 2.0, 0: 0.25}


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): the mean LABEL_WEIGHTS of a document's quality labels."""
    weight = F.when(F.col("quality") == 1, LABEL_WEIGHTS[1]).when(F.col("quality") == 0, LABEL_WEIGHTS[0])
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg(weight).alias("weight"))


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix_sources(docs, quality=label_weights(labels)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, avg(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE END) AS weight FROM labels GROUP BY doc_id
), r AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix-1:' || d.doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / coalesce(w.weight, 1.0::DOUBLE) AS key
  FROM documents d LEFT JOIN w USING (doc_id)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight FROM r GROUP BY source
), o AS (
  SELECT *, 3 * source_size / weight::DOUBLE AS ratio,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM s
), t AS (
  SELECT source, source_size, least((max(CASE WHEN left_size::DOUBLE / left_weight::DOUBLE <= ratio THEN left_size::DOUBLE / left_weight::DOUBLE END) OVER ()) * weight::DOUBLE, 3.0::DOUBLE * source_size) AS target FROM o
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-9::DOUBLE), 3) ELSE 0 END::BIGINT AS epochs FROM t
), c AS (
  SELECT r.doc_id, r.source, r.size, e.source_size, e.target, e.epochs, greatest(e.target - e.epochs * e.source_size, 0.0::DOUBLE) AS rest,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.size, r.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs + CASE WHEN size > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END) * size AS taken,
  source, (epochs + CASE WHEN size > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END)::INT AS copies
FROM c
"""
