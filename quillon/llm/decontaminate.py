"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by training token windows.

Built-in DataFrame functions only. A window of n words has one of every `step` places in a row that its first step places
are, so only every step-th place of a document is looked up: by the words there that lie in the window wherever it
begins (its seed). The hashes of all seeds are the set that is broadcast; a seed that meets gives windows, whose
hashes find the benchmark's windows, which are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import shared_folder, written

N = 10
#: Numbers of 64 bits that are broadcast at most; beyond, the join is left to Spark.
BROADCAST_SEEDS = 2_000_000
BROADCAST_KEYS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text after A-Z went to lower case; NULL has none."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    # lower() takes other letters along, so only texts without any may use it
    small = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(small, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def seed_step(size: int) -> int:
    """Every so many places of a document are looked up for windows of this size; a seed has size - step + 1 words."""
    return max(1, 2 * size // 5)


def seeds_of(words: str, size: int, every: int) -> Column:
    """(size, at, seed) at each `every`-th place of the array column that a seed of a window of this size may begin at, words from 0."""
    block = size - seed_step(size) + 1
    return F.expr(f"IF(size({words}) >= {size}, transform(sequence(0, (size({words}) - {block}) DIV {every}), j -> named_struct('size', {size}, 'at', j * {every}, 'seed', xxhash64({size}, slice({words}, j * {every} + 1, {block})))), array())")


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(item_id, n_words, window, words): the distinct windows of each item; one of fewer words, but not none, is one window."""
    words = items.select(F.col(id_col).alias("item_id"), plain_words(F.col(text_col)).alias("words")).where("size(words) > 0")
    cut = words.select("item_id", F.expr(f"explode(transform(sequence(1, greatest(size(words) - {n - 1}, 1)), i -> slice(words, i, {n})))").alias("words"))
    return cut.select("item_id", F.size("words").alias("n_words"), F.xxhash64("words").alias("window"), "words").distinct()


def find_windows(docs: DataFrame, windows: DataFrame, n: int = N, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(id, text_hash, start, n_words, item_id): where docs (id, text) have a benchmark window, words from 0.

    Items of fewer than n words are looked up by windows, and seeds, of their own size. No row that stands for a place in
    a document carries more words than a window has.
    """
    folder = shared_folder(docs.sparkSession)
    windows = written(windows, f"{folder}/windows")
    sizes = [r[0] for r in windows.select("n_words").distinct().orderBy("n_words").collect()]  # at most n numbers
    seeds = [windows.where(F.col("n_words") == size).select(F.explode(seeds_of("words", size, 1)).alias("x")).select("x.seed") for size in sizes or [n]]
    known = seeds[0]
    for more in seeds[1:]:
        known = known.union(more)
    known = written(known.distinct(), f"{folder}/seeds")
    if known.count() <= broadcast_seeds:
        known = F.broadcast(known)

    words = docs.select("id", F.xxhash64("text").alias("text_hash"), plain_words(F.col("text")).alias("words"))
    places = words.select("id", "text_hash", F.explode(F.concat(*[seeds_of("words", size, seed_step(size)) for size in sizes or [n]])).alias("x")).select("id", "text_hash", "x.*")
    met = places.join(known, "seed", "left_semi").groupBy("id", "text_hash").agg(F.collect_set(F.struct("size", "at")).alias("met"))
    met = written(met.select(F.col("id").alias("met_id"), F.col("text_hash").alias("met_hash"), "met"), f"{folder}/met")
    same = F.col("id").eqNullSafe(F.col("met_id")) & (F.col("text_hash") == F.col("met_hash"))
    own = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    keys = met.select("met_id", "met_hash")
    if keys.count() <= broadcast_keys:
        own = own.join(F.broadcast(keys), same, "left_semi")
    near = own.join(met, same).select("id", "text_hash", "met", plain_words(F.col("text")).alias("words")).dropDuplicates(["id", "text_hash"])
    step = F.create_map(*[F.lit(x) for size in sizes or [n] for x in (size, seed_step(size))])
    starts = F.array_distinct(F.flatten(F.transform("met", lambda m: F.transform(F.sequence(F.greatest(m["at"] - F.element_at(step, m["size"]) + 1, F.lit(0)), m["at"]), lambda t: F.struct(t.alias("start"), m["size"].alias("size"))))))
    cut = near.select("id", "text_hash", "words", F.filter(starts, lambda x: x["start"] + x["size"] <= F.size("words")).alias("starts"))
    cut = cut.select("id", "text_hash", F.explode(F.transform("starts", lambda x: F.struct(x["start"].alias("start"), x["size"].alias("n_words"), F.slice("words", x["start"] + 1, x["size"]).alias("own_words")))).alias("x"))
    cut = cut.select("id", "text_hash", "x.*", F.xxhash64("x.own_words").alias("window"))
    return cut.join(windows, ["window", "n_words"]).where("own_words = words").select("id", "text_hash", "start", "n_words", "item_id")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = N) -> DataFrame:
    """(id, n_words, n_hit, items): words of each document, those inside a benchmark window, and the items, sorted as strings.

    One row per input row; rows that repeat an id and a text get the same values, rows that repeat an id with another
    text their own. NULL and empty texts have no words and no hits; NULL ids are matched like any other; items with NULL
    or wordless texts have no windows, a NULL item id hits words but isn't listed. Empty tables are fine. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = find_windows(rows, benchmark_windows(items, item_col, text_col, n), n)
    # windows overlap: from each start on, words count up to where the windows before have not come
    before = Window.partitionBy("id", "text_hash").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("id", "text_hash", "start").agg(F.max("n_words").alias("n_words"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("n_words")).over(before), F.lit(0))))
    per_row = spans.groupBy("id", "text_hash").agg(F.sum(F.greatest(F.col("start") + F.col("n_words") - F.col("from"), F.lit(0))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    every = rows.select("id", F.xxhash64("text").alias("text_hash"), F.size(plain_words(F.col("text"))).cast("bigint").alias("n_words"))
    per_row = per_row.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_hit", "items")
    joined = every.join(per_row, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    return joined.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def contaminated_ids(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """The distinct (id, text_hash) of documents that have a benchmark window."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return find_windows(rows, benchmark_windows(items, n=n), n).select("id", "text_hash").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """docs without the documents that have a benchmark window, all columns as they were."""
    hit = contaminated_ids(docs, items, id_col, text_col, n).select(F.col("id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"))
    return docs.join(hit, docs[id_col].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs[text_col]) == hit["_hit_hash"]), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(id, text): each document's words, joined by single spaces, without those inside a benchmark window."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = find_windows(rows, benchmark_windows(items, n=n), n).groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "n_words")).alias("spans"))
    spans = spans.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "spans")
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash")), "left").withColumn("words", plain_words(F.col("text")))
    left = F.filter("words", lambda _, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["n_words"])))
    return joined.select("id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(left, " ")).alias("text"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), h AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
