"""Hard negatives: threshold joins of anchors with all rows in the way of L2AP, with thresholds that fall until windows are full.

Vectors are whole numbers. Rows are packed into blocks, anchors too, and each block of rows meets each block of anchors
in one task. There an inverted index is read dimension by dimension, those with most energy first: a row is posted under
its dimensions up to where the norm of what is left, times the anchors', is below the least threshold. Scores add up over
the postings; pairs whose score so far plus the product of the norms left can't reach the anchor's threshold are dropped,
and what was not posted is added for the few that remain.

An anchor first looks for its positives, then for the rows in the windows below their scores. It starts with a high
threshold; if a window isn't full, that anchor alone goes on with a lower one, at last with that of the windows' ends, so
results don't depend on the thresholds. Rows of one block give at most as many hits as a window takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import BATCH_SETTING, holds_cache, shared_folder, smaller_batches, written

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these percents of the positive's.
LOWEST, HIGHEST = 30, 90
ROWS_PER_BLOCK = 4096
ANCHORS_PER_BLOCK = 1024
STEP = 8
#: Bytes of anchors that are broadcast; more are dealt to the blocks of rows by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Thresholds of the search for positives, as shares of the anchor's norm times the mean norm, and of that for negatives, as shares of the lowest window's upper end.
POSITIVE_STEPS = (0.5, 0.3, 0.15)
NEGATIVE_STEPS = (0.9, 0.7)

_KINDS = {"h": np.int16, "i": np.int32, "q": np.int64}
_EXACT = float(1 << 53)


def padded(offsets: np.ndarray, values: np.ndarray, width: int = 0) -> np.ndarray:
    """Lists as rows of a matrix, with 0 behind shorter ones."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), values.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    holds_cache("negatives")
    for batch in batches:
        for at in range(0, len(batch), ROWS_PER_BLOCK):
            part = batch.slice(at, ROWS_PER_BLOCK)
            v = part.column("v")
            m = padded(np.asarray(v.offsets), v.values.to_numpy(zero_copy_only=False))
            top = int(np.abs(m).max(initial=0))
            kind = "h" if top < 1 << 15 else "i" if top < 1 << 31 else "q"
            energy = (m.astype(np.float64) ** 2).sum(axis=0)
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("id", "label"))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(part), m.shape[1], kind, ids, labels, m.astype(_KINDS[kind]).tobytes())] + [pa.array([energy.tolist()], pa.list_(pa.float64()))], names=["n", "width", "kind", "ids", "labels", "vectors", "energy"])


def valid_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): rows that take part, v as whole numbers."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256))
    return df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("v"))


def reaching(q: np.ndarray, x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score): all pairs of rows of q and x with a score of t[i] or more; columns with most energy come first."""
    m, width = q.shape
    if not len(x) or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    norms = np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(x, axis=1).max(initial=0)
    if norms >= _EXACT:  # whole numbers of any size, pair by pair
        scores = q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
        i, j = np.nonzero(scores >= t[:, None].astype(object))
        return i, j, np.array(scores[i, j].tolist(), np.int64)
    cuts = [*range(0, width, STEP), width]
    left = lambda v: np.sqrt(np.stack([(v[:, c:] ** 2).sum(axis=1) for c in cuts]))
    q_left, x_left = left(q), left(x)
    least, slack = t.min(), 1e-9 * norms + 1e-6
    # how many steps of each row are posted
    posted = (x_left[:-1] * q_left[:-1].max(axis=1)[:, None] + slack >= least).sum(axis=0)
    rows = np.flatnonzero(posted if least > 0 else np.ones(len(x), np.int64))
    scores = np.zeros((m, len(rows)))
    for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        now = posted[rows] > g
        if not now.any():
            break
        scores[:, now] += q[:, a:b] @ x[rows[now], a:b].T
        stop = np.minimum(posted[rows], g + 1)
        open_ = (scores + q_left[stop].T * x_left[stop, rows] + slack >= t[:, None]).any(axis=0)
        if not open_.all():
            rows, scores = rows[open_], scores[:, open_]
    stop = posted[rows]
    i, j = np.nonzero(scores + q_left[stop].T * x_left[stop, rows] + slack >= t[:, None])
    found = scores[i, j]
    for g in np.unique(stop[j]):
        at = np.flatnonzero(stop[j] == g)
        if cuts[g] < width:
            found[at] += np.einsum("ij,ij->i", q[i[at], cuts[g] :], x[rows[j[at]], cuts[g] :])
    enough = found >= t[i]
    return i[enough], rows[j[enough]], np.rint(found[enough]).astype(np.int64)


def _first(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, highest scores and then smallest ids first."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[nth < k]


def _meet(order: list[int], same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block of rows with a block of anchors, to (anchor, slot, id, score): each slot's first k rows of the anchor's label, or of others within the slot's bounds."""
    dims = np.array(order, np.int64)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("negatives")
        for batch in batches:
            for r in range(len(batch)):
                n, width, kind, ids, labels, vectors = (batch.column(c)[r].as_py() for c in ("n", "width", "kind", "ids", "labels", "vectors"))
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                x = np.zeros((n, len(dims)))
                x[:, :width] = np.frombuffer(vectors, _KINDS[kind]).reshape(n, width)
                anchors = batch.column("anchors")[r].values
                own = anchors.field("label").to_numpy(zero_copy_only=False)
                use = np.flatnonzero(np.isin(own, labels) if same else np.ones(len(own), bool))
                if not len(use):
                    continue
                anchors, own = anchors.take(pa.array(use)), own[use]
                vs = anchors.field("v")
                q = padded(np.asarray(vs.offsets), vs.values.to_numpy(zero_copy_only=False).astype(np.float64), len(dims))
                t = anchors.field("t").to_numpy(zero_copy_only=False).astype(np.float64)
                i, j, s = reaching(q[:, dims], x[:, dims], t)
                fits = (own[i] == labels[j]) == same
                if same:
                    fits &= anchors.field("id").to_numpy(zero_copy_only=False)[i] != ids[j]
                i, j, s = i[fits], j[fits], s[fits]
                key = anchors.field("anchor").to_numpy(zero_copy_only=False)
                bounds = [anchors.field(c) for c in ("low", "high")]
                low, high = (padded(np.asarray(b.offsets), b.values.to_numpy(zero_copy_only=False)) for b in bounds)
                slots = np.diff(np.asarray(bounds[0].offsets))
                for slot in range(low.shape[1]):
                    inside = np.flatnonzero((slots[i] > slot) & (low[i, slot] <= s) & (s <= high[i, slot]))
                    inside = inside[_first(i[inside], s[inside], ids[j[inside]], k)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[i[inside]]), pa.array(np.full(len(inside), slot, np.int32)), pa.array(ids[j[inside]]), pa.array(s[inside])], names=["anchor", "slot", "id", "score"])

    return hits


def _firsts(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def threshold_join(blocks: DataFrame, anchors: DataFrame, order: list[int], same: bool, k: int, folder: str) -> DataFrame:
    """(anchor, slot, id, score, rank): the first k rows of each slot, of any block, that reach the anchor's threshold t.

    anchors: (anchor, id, label, v, low, high, t).
    """
    count = anchors.count()
    n_blocks = max(1, -(-count // ANCHORS_PER_BLOCK))
    packed = anchors.withColumn("ab", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks))).groupBy("ab").agg(F.collect_list(F.struct("anchor", "id", "label", "v", "low", "high", "t")).alias("anchors"))
    rows = blocks.drop("energy").withColumn("ab", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    if count * (8 * len(order) + 200) <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(packed), "ab")
    else:
        groups = F.lit(max(1, min(4096, 4 * blocks.sparkSession.sparkContext.defaultParallelism)))
        rows = rows.withColumn("group", F.pmod(F.xxhash64("ids"), groups))
        met = rows.join(packed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), groups.cast("bigint") - 1))), ["ab", "group"])
    with smaller_batches(blocks.sparkSession, 4):
        hits = written(met.select("n", "width", "kind", "ids", "labels", "vectors", "anchors").mapInArrow(_meet(order, same, k), "anchor bigint, slot int, id bigint, score bigint"), f"{folder}-hits")
    return written(_firsts(hits, k), f"{folder}-first")


def _lowered(blocks: DataFrame, anchors: DataFrame, order: list[int], same: bool, k: int, levels: list, folder: str) -> DataFrame:
    """threshold_join with ever lower levels (columns of anchors, the last one low enough for all) for the anchors that have a slot not full."""
    done, open_ = [], anchors
    for step, level in enumerate(levels):
        at = f"{folder}{step}"
        now = written(open_.withColumn("t", level.cast("double")), f"{at}-anchors")
        if now.isEmpty():
            break
        found = threshold_join(blocks, now, order, same, k, at)
        if step == len(levels) - 1:
            done.append(found)
            break
        filled = found.where(F.col("rank") == k).groupBy("anchor").agg(F.count("*").alias("filled"))
        state = now.join(filled, "anchor", "left")
        full = written(state.where("coalesce(filled, 0) >= size(low)").select("anchor"), f"{at}-full")
        done.append(found.join(full, "anchor", "left_semi"))
        open_ = now.join(full, "anchor", "left_anti").drop("t")
    return reduce(DataFrame.union, done) if done else None


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    A vector's components x become floor(256 * x); a score is the inner product with the anchor, missing components of the
    shorter vector being 0. Anchors are the rows whose id is divisible by anchor_every. Their positives are the first
    `positives` other rows of the same label by score, then by smaller id; for each, the first `negatives` rows of other
    labels in that order with lowest * positive score <= 100 * score <= highest * positive score, none below a positive
    of negative score.

    Rows with a NULL id, label or vector, or a NULL or non-finite component, take no part. Rows that repeat an id are rows of
    their own, but none is a positive of an anchor of its id. An anchor without positives or negatives gives no row, an
    empty table an empty one; other columns are not read. A score that BIGINT can't hold is an error.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = valid_rows(vectors, id_col, vector_col, label_col)
    count = rows.count()
    # equal labels in the same blocks, so that a block of rows has few of the anchors as positives' anchors
    parts = max(spark.sparkContext.defaultParallelism, -(-count // (4 * ROWS_PER_BLOCK)))
    with smaller_batches(spark):
        spark.conf.set(BATCH_SETTING, str(ROWS_PER_BLOCK))  # a batch is a block
        packed = rows.repartitionByRange(parts, "label", "id").mapInArrow(_pack, "n bigint, width bigint, kind string, ids binary, labels binary, vectors binary, energy array<double>")
        packed.write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(packed.schema).parquet(f"{folder}/blocks")
    # one number per dimension
    energy = sorted((-(r["e"] or 0), r["d"]) for r in blocks.select(F.posexplode("energy").alias("d", "e")).groupBy("d").agg(F.sum("e").alias("e")).collect())
    order = [d for _, d in energy]
    mean = F.lit(float(np.sqrt(max(-sum(e for e, _ in energy) / max(count, 1), 1.0))))

    chosen = rows.where(F.col("id") % anchor_every == 0).withColumn("anchor", F.monotonically_increasing_id())
    anchors = written(chosen, f"{folder}/anchors")
    ends = {"low": F.array(F.lit(-(1 << 63)).cast("bigint")), "high": F.array(F.lit((1 << 63) - 1).cast("bigint"))}
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)) * mean
    found = _lowered(blocks, anchors.withColumns(ends), order, True, positives, [*(norm * c for c in POSITIVE_STEPS), F.lit(float("-inf"))], f"{folder}/positives")
    empty = anchors.selectExpr("id AS anchor_id", "id AS positive_id", "CAST(1 AS INT) AS rank", "id AS negative_id", "id AS positive_score", "id AS negative_score").where("false")
    if found is None:
        return empty
    # a positive of negative score has an empty window
    told = written(found.where("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("p")), f"{folder}/windows")
    windows = anchors.join(told, "anchor").withColumn("low", F.expr(f"transform(p, x -> ({lowest} * x.positive_score + 99) div 100)")).withColumn("high", F.expr(f"transform(p, x -> {highest} * x.positive_score div 100)")).drop("p")
    top, bottom = F.array_min("high"), F.array_min("low")
    found = _lowered(blocks, windows, order, False, negatives, [*(F.greatest(top * c, bottom) for c in NEGATIVE_STEPS), bottom], f"{folder}/negatives")
    if found is None:
        return empty
    out = found.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").join(told, "anchor").withColumn("x", F.get("p", F.col("slot")))
    return out.select("anchor_id", "x.positive_id", "rank", F.col("id").alias("negative_id"), "x.positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(vectors.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")))


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
