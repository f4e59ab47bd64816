"""Sums of products over the rows of a table with many columns, as matrices: counts of common rows, rank correlations, covariances.

A row is (row, ks, xs): a number of its own, the columns it has a value in, and these values. Each task adds up a matrix
over its rows, and rows of matrices, never rows of the table repeated per pair of columns, are added across tasks. What
comes to the driver has the size of columns x columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import finite
from quillon.functions.shared import settled

#: Values of one column that are ranked in one task, about, and the most ranges that a column is cut into.
ROWS_PER_RANGE = 100_000
MAX_RANGES = 4096
#: Bytes of a task's block of rows.
BLOCK_BYTES = 32 << 20
#: First ranks of ranges that go out with the tasks' code; with more they are joined by a shuffle.
BROADCAST_RANGES = 500_000
#: Columns that are set side by side by one aggregate each; more are collected as lists.
WIDE_COLUMNS = 64
#: Ranks, of distinct values for each class, that go out with the tasks' code; columns with more are sorted.
TABLE_RANKS = 1 << 23


def column_rows(long: DataFrame, columns: list, key: str = "record_key", column: str = "column") -> DataFrame:
    """(row, ks, xs) from (key, column, value), one row per key with a value in one of the columns; (key, column) should not repeat."""
    if len(columns) <= WIDE_COLUMNS:
        # rows of a key that stand together become one before they are shuffled
        own = [F.max(F.when(F.col(column) == c, F.col("value"))).alias(f"_c{k}") for k, c in enumerate(columns)]
        wide = long.where(F.col("value").isNotNull() & F.col(column).isin(columns)).groupBy(key).agg(*own)
        ks = F.array_compact(F.array(*[F.when(F.col(f"_c{k}").isNotNull(), F.lit(k)) for k in range(len(columns))]))
        xs = F.array_compact(F.array(*[F.col(f"_c{k}") for k in range(len(columns))]))
        return settled(wide.select(F.monotonically_increasing_id().alias("row"), ks.alias("ks"), xs.alias("xs")))
    spark = long.sparkSession
    names = F.broadcast(spark.createDataFrame([(c, k) for k, c in enumerate(columns)], f"`{column}` string, _k int"))  # one row per column
    some = long.where("value IS NOT NULL").join(names, column).groupBy(key).agg(F.collect_list(F.struct("_k", "value")).alias("_e"))
    return settled(some.select(F.monotonically_increasing_id().alias("row"), F.col("_e._k").alias("ks"), F.col("_e.value").alias("xs")))


def table_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """(row, v) from a written table with a column `row`: the values of the columns in order. Nothing is shuffled."""
    return table.select("row", F.array(*[finite(F.col(c).cast("double")) for c in columns]).alias("v"))


def numbered(df: DataFrame) -> DataFrame:
    """df written with a number of its own in each row, `row`."""
    return settled(df.withColumn("row", F.monotonically_increasing_id()))


def _entries(rows: DataFrame) -> DataFrame:
    """(ks, xs), a row for each value."""
    if "v" in rows.columns:
        return rows.select(F.posexplode("v").alias("ks", "xs")).where("xs IS NOT NULL")
    return rows.select(F.explode(F.arrays_zip("ks", "xs")).alias("e")).select("e.ks", "e.xs")


def _packed(there: np.ndarray) -> list[np.ndarray]:
    """Columns of true and false as bits of whole numbers, 62 of them each."""
    return [there[:, c : c + 62] @ (1 << np.arange(min(62, there.shape[1] - c), dtype=np.int64)) for c in range(0, there.shape[1], 62)]


def _unpacked(words: list[np.ndarray], n: int) -> np.ndarray:
    return np.concatenate([w[:, None] >> np.arange(min(62, n - 62 * i)) & 1 for i, w in enumerate(words)], axis=1)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes, without an object per row."""
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _rows_of(array: pa.Array, width: int) -> np.ndarray:
    """The whole numbers that _fixed() wrote."""
    at = np.frombuffer(array.buffers()[1], np.int32)[array.offset :]
    return np.frombuffer(array.buffers()[2], np.int64, len(array) * width, int(at[0])).reshape(len(array), width)


def _dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    if "v" in batch.schema.names:
        return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), width)
    ks, xs = batch.column("ks"), batch.column("xs")
    at = np.asarray(ks.offsets)
    out = np.full((len(batch), width), np.nan)
    rows = np.repeat(np.arange(len(batch)), np.diff(at))
    out[rows, ks.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]] = xs.flatten().to_numpy(zero_copy_only=False)
    return out


def _rows_out(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array([r.tobytes() for r in sums.astype(np.float64)], pa.binary())], names=["i", "sums"])


def added(partials: DataFrame, combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> DataFrame:
    """(i, sums) with the arrays of equal i combined; a task holds one array at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["i", "sums"])
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(raw)
                if i == now:
                    held = combine(held, more)
                else:
                    if now is not None:
                        yield give()
                    now, held = i, more
        if now is not None:
            yield give()

    return partials.repartition("i").sortWithinPartitions("i").mapInArrow(add, "i int, sums binary")


def matrix_of(rows: DataFrame, width: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of product(block) over dense blocks of rows, NaN for missing values, added up by rows of the matrix.

    rows are (ks, xs), or v with all values in order.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        step = max(1, BLOCK_BYTES // (8 * max(width, 1)))
        for batch in batches:
            for at in range(0, len(batch), step):
                more = product(_dense(batch.slice(at, step), width))
                total = more if total is None else total + more
        if total is not None:
            yield _rows_out(total)

    found = {r["i"]: np.frombuffer(r["sums"]) for r in added(rows.mapInArrow(partial, "i int, sums binary")).collect()}  # columns x columns
    return np.stack([found[i] for i in range(len(found))]) if found else np.zeros((width, width))


def common_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How many rows have both of two columns."""

    def product(block: np.ndarray) -> np.ndarray:
        there = (~np.isnan(block)).astype(np.float64)
        return there.T @ there

    return matrix_of(rows, width, product)


def presence_classes(counts: np.ndarray) -> np.ndarray:
    """A class per column, equal for columns that are missing in the same rows: those that have as many rows in common as each has."""
    if not len(counts):
        return np.zeros(0, np.int64)
    own = np.diag(counts)
    same = (counts == own[:, None]) & (counts == own[None, :])
    _, classes = np.unique(same.argmax(axis=1), return_inverse=True)
    return classes


def few_valued(rows: DataFrame, width: int, n_classes: int) -> np.ndarray:
    """Whether the ranks of a column's distinct values fit in a table, together with those of the columns that have fewer; the estimate decides on the way taken, not on results."""
    few = np.zeros(width, bool)
    if 0 < n_classes <= WIDE_COLUMNS:
        if "v" in rows.columns:
            found = dict(enumerate(rows.agg(*[F.approx_count_distinct(F.col("v")[k]) for k in range(width)]).first()))
        else:
            found = {r["ks"]: r["n"] for r in _entries(rows).groupBy("ks").agg(F.approx_count_distinct("xs").alias("n")).collect()}  # one row per column
        order = sorted(range(width), key=lambda k: (found.get(k, 0), k))
        few[order] = np.cumsum([found.get(k, 0) for k in order]) * n_classes <= TABLE_RANKS
    return few


def level_ranks(rows: DataFrame, classes: np.ndarray, few: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per column its distinct values in order, and per class and value how many rows have it and twice its average rank among them; empty for columns that aren't few.

    Values are counted in the tasks, block by block, and then by value; what comes to the driver has TABLE_RANKS numbers, about.
    """
    first = np.array([int(np.flatnonzero(classes == c)[0]) for c in range(classes.max(initial=-1) + 1)], np.int64)
    names, width, chosen = [f"c{c}" for c in range(len(first))], len(few), np.flatnonzero(few)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(blocks)
            there = ~np.isnan(x)
            for k in chosen:
                own = there[:, k]
                values, at = np.unique(x[own, k], return_inverse=True)
                sums = [np.bincount(at, weights=there[own, c], minlength=len(values)).astype(np.int64) for c in first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values), *map(pa.array, sums)], names=["k", "x", *names])

        held, n = [], 0
        for batch in batches:
            held.append(_dense(batch, width))
            n += len(batch)
            if n * 8 * width >= BLOCK_BYTES:
                yield from counted(held)
                held, n = [], 0
        if n:
            yield from counted(held)

    tall = rows.mapInArrow(count, "k int, x double, " + ", ".join(f"{c} bigint" for c in names))
    found = tall.groupBy("k", "x").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    k, x = found.column("k").to_numpy(), found.column("x").to_numpy()
    order = np.lexsort((x, k))
    ends = np.searchsorted(k[order], np.arange(width + 1))
    held = np.stack([found.column(c).to_numpy()[order] for c in names])
    own = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [x[order][o] for o in own], [held[:, o] for o in own], [2 * np.cumsum(held[:, o], axis=1) - held[:, o] + 1 for o in own]


def _cuts(rows: DataFrame, counts: np.ndarray, chosen: np.ndarray | bool = True) -> list[np.ndarray]:
    """Per column the values that part its ranges, none for a column that fits in one or isn't chosen."""
    n = [min(MAX_RANGES, int(c // ROWS_PER_RANGE)) for c in np.diag(counts) * chosen]
    if not any(n):
        return [np.zeros(0)] * len(n)
    most = max(n)
    values = _entries(rows).where(F.col("ks").isin([k for k, m in enumerate(n) if m]))
    found = {r["ks"]: r["q"] for r in values.groupBy("ks").agg(F.percentile_approx("xs", [(k + 1) / (most + 1) for k in range(most)], 20 * most).alias("q")).collect()}  # MAX_RANGES a column
    return [np.unique(found[k]) if m else np.zeros(0) for k, m in enumerate(n)]


def column_ranks(rows: DataFrame, counts: np.ndarray, classes: np.ndarray, chosen: np.ndarray | None = None) -> DataFrame:
    """(row, k, ranks): twice the average rank of each value of column k, of the chosen ones, among the rows that have column k and those of a class, for every class; 0 where the row lacks that class.

    A column is sorted once. Its values are cut into ranges; a value that parts two ranges is a range of its own, so that a
    frequent value is never sorted, nor in one task. Ranks start from the counts of lower ranges, class by class: what rows
    without a class would have counted is left out by running counts of that class.
    """
    chosen = np.ones(len(counts), bool) if chosen is None else chosen
    cuts, first = _cuts(rows, counts, chosen), np.array([int(np.flatnonzero(classes == c)[0]) for c in range(classes.max(initial=-1) + 1)], np.int64)
    n_classes, width = len(first), len(counts)
    words = [f"b{i}" for i in range(-(-n_classes // 62))]
    schema = "row bigint, k int, x double, place int, " + ", ".join(f"{w} bigint" for w in words)
    # column k's ranges are the cells from base[k] on; range 2 * j holds values between two parting ones, 2 * j + 1 those equal to the j-th
    base = np.cumsum([0, *(2 * len(c) + 1 for c in cuts)])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        step = max(1, BLOCK_BYTES // (8 * width * (4 + len(words))))
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                x = _dense(batch, width)
                bits = _packed(~np.isnan(x[:, first]))
                k, r = np.nonzero(~np.isnan(x.T) & chosen[:, None])
                v = x[r, k]
                place = np.zeros(len(v), np.int32)
                ends = np.searchsorted(k, np.arange(width + 1))
                for c in range(width):
                    if len(cuts[c]):
                        own = slice(ends[c], ends[c + 1])
                        j = np.searchsorted(cuts[c], v[own])
                        place[own] = 2 * j + (cuts[c][np.minimum(j, len(cuts[c]) - 1)] == v[own])
                yield batch, r, k.astype(np.int32), v, place, bits

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, r, k, v, place, bits in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(r)), pa.array(k), pa.array(v), pa.array(place), *(pa.array(b[r]) for b in bits)], names=["row", "k", "x", "place", *words])

    long = rows.mapInArrow(spread_out, schema)
    below = held = None
    many = False
    if any(len(c) for c in cuts):

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((base[-1], n_classes))
            for _, r, k, _, place, bits in pieces(batches):
                cell, there = base[k] + place, _unpacked([b[r] for b in bits], n_classes)
                for c in range(n_classes):
                    sums[:, c] += np.bincount(cell, weights=there[:, c], minlength=base[-1])
            cell, c = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(c.astype(np.int32)), pa.array(sums[cell, c].astype(np.int64))], names=["cell", "c", "held"])

        counted = rows.mapInArrow(count, "cell bigint, c int, held bigint").groupBy("cell", "c").agg(F.sum("held").alias("held"))
        many = base[-1] * n_classes > BROADCAST_RANGES
        if many:
            column = F.broadcast(long.sparkSession.createDataFrame([(k, int(base[k]), int(base[k + 1])) for k in range(width)], "k int, _from bigint, _to bigint"))  # one row per column
            placed_at = counted.join(column, (F.col("cell") >= F.col("_from")) & (F.col("cell") < F.col("_to"))).select("k", (F.col("cell") - F.col("_from")).cast("int").alias("place"), "c", "held")
            under = F.coalesce(F.sum("held").over(Window.partitionBy("k", "c").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            every = placed_at.withColumn("below", under).groupBy("k", "place").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("below", "held").alias("v")))).alias("_s"))
            told = lambda f: F.array(*[F.coalesce(F.col("_s")[c][f], F.lit(0)) for c in range(n_classes)])
            starts = settled(every.select("k", "place", told("below").alias("below"), told("held").alias("held")))
        else:
            held = np.zeros((base[-1], n_classes), np.int64)
            for r in counted.collect():  # BROADCAST_RANGES numbers at most
                held[r["cell"], r["c"]] = r["held"]
            below = np.concatenate([np.cumsum(held[a:b], axis=0) - held[a:b] for a, b in zip(base, base[1:], strict=False)])
    # rows of one value are told their rank by the range alone, wherever they are
    salted = long.withColumn("salt", F.when(F.col("place") % 2 == 1, F.pmod(F.col("row"), F.lit(64))).otherwise(0))
    if many:
        everywhere = starts.withColumn("salt", F.explode(F.when(F.col("place") % 2 == 1, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
        placed = salted.join(everywhere.hint("merge"), ["k", "place", "salt"])
    else:
        placed = salted.repartition("k", "place", "salt")
    placed = placed.sortWithinPartitions("k", "place").select("row", "k", "x", "place", *words, *(["below", "held"] if many else []))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now, start, equal = [], None, None, None

        def out(row: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), now[0], np.int32)), _fixed(ranks.astype(np.int64, copy=False))], names=["row", "k", "ranks"])

        def done() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            row, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            bits = [np.concatenate(b) for b in zip(*(p[2] for p in parts), strict=True)]
            parts.clear()
            step = max(1, BLOCK_BYTES // (64 * n_classes))
            if equal is not None:
                for at in range(0, len(row), step):
                    yield out(row[at : at + step], _unpacked([b[at : at + step] for b in bits], n_classes) * (2 * start + equal + 1))
                return
            order = np.argsort(x, kind="stable")
            row, x, bits = row[order], x[order], [b[order] for b in bits]
            new = np.concatenate([[True], x[1:] != x[:-1]])
            lower = np.flatnonzero(new)
            group, upper = np.cumsum(new) - 1, np.append(lower[1:], len(x))
            twice = np.empty((len(lower), n_classes), np.int64)
            for c in range(n_classes):
                upto = np.concatenate([[0], np.cumsum(bits[c // 62] >> c % 62 & 1)])
                twice[:, c] = 2 * start[c] + upto[lower] + upto[upper] + 1
            for at in range(0, len(row), step):
                yield out(row[at : at + step], _unpacked([b[at : at + step] for b in bits], n_classes) * twice[group[at : at + step]])

        for batch in batches:
            if not len(batch):
                continue
            k, place = batch.column("k").to_numpy(), batch.column("place").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (place[1:] != place[:-1])]))
            row, x, bits = batch.column("row").to_numpy(), batch.column("x").to_numpy(), [batch.column(w).to_numpy() for w in words]
            for a, b in zip(new, np.append(new[1:], len(batch)), strict=True):
                if (int(k[a]), int(place[a])) != now:
                    yield from done()
                    now = (int(k[a]), int(place[a]))
                    cell = base[now[0]] + now[1]
                    start = np.array(batch.column("below")[a].as_py()) if many else np.zeros(n_classes, np.int64) if below is None else below[cell]
                    equal = (np.array(batch.column("held")[a].as_py()) if many else held[cell]) if now[1] % 2 else None
                # copies, or a slice would keep its whole batch
                parts.append((row[a:b].copy(), x[a:b].copy(), [w[a:b].copy() for w in bits]))
                if equal is not None:
                    yield from done()
        yield from done()

    return placed.mapInArrow(rank, "row bigint, k int, ranks binary")


def rank_correlations(long: DataFrame, columns: list, xs: list | None = None, ys: list | None = None, key: str = "record_key", column: str = "column") -> DataFrame:
    """(x, y, n, rho, sxy, levels_x, levels_y) of pairs of columns of (key, column, value): Spearman's rho over the rows that have both, with average ranks.

    Pairs are every two columns, x before y in `columns`, or all of xs with all of ys. n counts the rows with both (0 too),
    sxy is the sum of products of the centred ranks, levels_x and levels_y are the distinct values among these rows: 1, 2, or 3
    for more; rho is NULL where one side has a single value. Columns that are missing in the same rows have the same ranks
    for any partner; else a column is ranked once for every class of columns missing in the same rows. Columns of few distinct
    values get their ranks from a table of these, counted in one pass; the others are sorted.
    """
    if not columns or xs == [] or ys == []:
        return long.selectExpr("'' AS x", "'' AS y", "0L AS n", "0D AS rho", "0D AS sxy", "0 AS levels_x", "0 AS levels_y").where("false")
    return row_correlations(column_rows(long, columns, key, column), columns, xs, ys)


def row_correlations(rows: DataFrame, columns: list, xs: list | None = None, ys: list | None = None) -> DataFrame:
    """rank_correlations() of written rows: those of column_rows() or table_rows()."""
    spark, at = rows.sparkSession, {c: k for k, c in enumerate(columns)}
    width = len(columns)
    left = np.array([at[c] for c in (columns if xs is None else xs)], np.int64)
    right = np.array([at[c] for c in (columns if ys is None else ys)], np.int64)
    counts = common_counts(rows, width)
    classes = presence_classes(counts)
    n_classes = classes.max(initial=-1) + 1
    inside = [np.flatnonzero(classes == c) for c in range(n_classes)]
    firsts = np.array([i[0] for i in inside], np.int64)
    centre = counts[:, firsts] + 1 if n_classes else np.zeros((width, 0))

    few = few_valued(rows, width, n_classes)
    values, held, twice = level_ranks(rows, classes, few) if few.any() else ([], [], [])

    def wanted(side: np.ndarray) -> list[np.ndarray]:
        return [np.intersect1d(i, side) for i in inside]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch, width)
            there, row = ~np.isnan(x), batch.column("row").to_numpy()
            for k in np.flatnonzero(few):
                own = there[:, k]
                ranks = twice[k].T[np.searchsorted(values[k], x[own, k])] * there[own][:, firsts]
                yield pa.RecordBatch.from_arrays([pa.array(row[own]), pa.array(np.full(len(ranks), k, np.int32)), _fixed(ranks)], names=["row", "k", "ranks"])

    def products_by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, step, some = np.zeros((width, width)), max(1, BLOCK_BYTES // (8 * width * 8)), False
        one, other = wanted(left), wanted(right)
        tables = [t if t.shape[1] else np.zeros((n_classes, 1)) for t in twice]  # a column without values
        for whole in batches:
            for at in range(0, len(whole), step):
                x, some = _dense(whole.slice(at, step), width), True
                there = ~np.isnan(x)
                place = [np.searchsorted(values[k], np.where(there[:, k], x[:, k], -np.inf)) for k in range(width)]

                def centred(ks: np.ndarray, c: int) -> np.ndarray:
                    # rows without the column, or without the class, add nothing
                    return np.stack([(tables[k][c][place[k]] - centre[k, c]) * (there[:, k] & there[:, firsts[c]]) for k in ks])  # noqa: B023

                for c in range(n_classes):
                    for d in range(n_classes):
                        if len(one[c]) and len(other[d]):
                            sums[np.ix_(one[c], other[d])] += centred(one[c], d) @ centred(other[d], c).T
        if some:
            about = [np.zeros((width, n_classes)), np.full((width, n_classes), np.inf), np.full((width, n_classes), -np.inf)]
            yield _rows_out(np.concatenate([sums, *about], axis=1))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width))
        about = np.stack([np.zeros((width, n_classes)), np.full((width, n_classes), np.inf), np.full((width, n_classes), -np.inf)])
        step = max(1, BLOCK_BYTES // (8 * width * n_classes))
        wanted_left, wanted_right = wanted(left), wanted(right)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(row: np.ndarray, k: np.ndarray, values: np.ndarray) -> None:
            new = np.concatenate([[True], row[1:] != row[:-1]])
            place, starts = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(row))
            for a in range(0, len(starts) - 1, step):
                own = slice(starts[a], starts[min(a + step, len(starts) - 1)])
                block = np.zeros((min(step, len(starts) - 1 - a), width, n_classes))
                block[place[own] - a, k[own]] = values[own]
                there = block > 0
                block -= centre
                block[~there] = 0
                about[0] += (block**2).sum(axis=0)
                about[1] = np.minimum(about[1], np.where(there, block, np.inf).min(axis=0))
                about[2] = np.maximum(about[2], np.where(there, block, -np.inf).max(axis=0))
                for c in range(n_classes):
                    for d in range(n_classes):
                        if len(wanted_left[c]) and len(wanted_right[d]):
                            sums[np.ix_(wanted_left[c], wanted_right[d])] += block[:, wanted_left[c], d].T @ block[:, wanted_right[d], c]

        for batch in batches:
            if len(batch):
                kept.append((batch.column("row").to_numpy(), batch.column("k").to_numpy(), _rows_of(batch.column("ranks"), n_classes)))
                if len({int(p[0][-1]) for p in kept} | {int(kept[0][0][0])}) > 1:
                    row, k, values = (np.concatenate(x) for x in zip(*kept, strict=True))
                    end = int(np.searchsorted(row, row[-1]))  # the last row may go on
                    add(row[:end], k[:end], values[:end])
                    kept = [(row[end:], k[end:], values[end:])]
        if kept:
            add(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            yield _rows_out(np.concatenate([sums, *about], axis=1))

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = width + n_classes
        low, high = slice(n, n + n_classes), slice(n + n_classes, None)
        return np.concatenate([a[:n] + b[:n], np.minimum(a[low], b[low]), np.maximum(a[high], b[high])])

    if few.all():
        # squares, least and highest ranks are known from the tables
        away = [t - centre[k][:, None] for k, t in enumerate(twice)]
        about = [((h * z**2).sum(axis=1), np.where(h > 0, z, np.inf).min(axis=1, initial=np.inf), np.where(h > 0, z, -np.inf).max(axis=1, initial=-np.inf)) for h, z in zip(held, away, strict=True)]
        found = added(rows.mapInArrow(products_by_table, "i int, sums binary"), joined)
    else:
        about = None
        ranks = column_ranks(rows, counts, classes, ~few)
        if few.any():
            ranks = ranks.union(rows.mapInArrow(ranked, "row bigint, k int, ranks binary"))
        found = added(ranks.repartition("row").sortWithinPartitions("row").mapInArrow(products, "i int, sums binary"), joined)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(raw)
                parts = [s[:width], counts[i], *(s[width:].reshape(3, n_classes) if about is None else about[i])]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([p.tolist()], pa.list_(pa.float64())) for p in parts)], names=["i", "s", "n", "d", "low", "high"])

    told = settled(found.mapInArrow(opened, "i int, s array<double>, n array<double>, d array<double>, low array<double>, high array<double>"))  # one row per column
    names = spark.createDataFrame([(k, c, int(classes[k])) for k, c in enumerate(columns)], "i int, name string, class int")
    told = told.join(F.broadcast(names), "i")
    chosen = lambda side: F.col("i").isin([int(i) for i in side])
    one = told.where(chosen(left)).select(F.col("name").alias("x"), F.col("i").alias("_i"), F.col("class").alias("_ci"), F.col("d").alias("_di"), F.col("low").alias("_li"), F.col("high").alias("_hi"), F.posexplode(F.arrays_zip("s", "n")).alias("_j", "_e"))
    two = told.where(chosen(right)).select(F.col("name").alias("y"), F.col("i").alias("_j"), F.col("class").alias("_cj"), F.col("d").alias("_dj"), F.col("low").alias("_lj"), F.col("high").alias("_hj"))
    pairs = one.join(F.broadcast(two), "_j").withColumn("n", F.col("_e.n").cast("bigint"))
    if xs is None and ys is None:
        pairs = pairs.where("_i < _j")
    # doubled ranks of two distinct values are n apart, those of more are further apart
    levels = lambda low, high, c: F.when(F.col("n") == 0, 0).otherwise(F.when(high[c] == low[c], 1).when(high[c] - low[c] <= F.col("n"), 2).otherwise(3)).cast("int")
    pairs = pairs.withColumn("levels_x", levels(F.col("_li"), F.col("_hi"), F.col("_cj"))).withColumn("levels_y", levels(F.col("_lj"), F.col("_hj"), F.col("_ci")))
    rho = F.when((F.col("levels_x") > 1) & (F.col("levels_y") > 1), F.col("_e.s") / F.sqrt(F.col("_di")[F.col("_cj")] * F.col("_dj")[F.col("_ci")]))
    return pairs.select("x", "y", "n", rho.alias("rho"), (F.col("_e.s") / 4).alias("sxy"), "levels_x", "levels_y")


def moments(rows: DataFrame, about: list[float]) -> np.ndarray:
    """The products of (1, v - about) with itself, summed over rows (v): counts, sums and products at once. Missing values count as `about`."""
    centre = np.array(about)

    def product(block: np.ndarray) -> np.ndarray:
        z = np.concatenate([np.ones((len(block), 1)), np.where(np.isnan(block), centre, block) - centre], axis=1)
        return z.T @ z

    return matrix_of(rows, len(about), product)


def column_names(long: DataFrame, column: str = "feature") -> list[str]:
    """The names in a long table, in order."""
    return sorted(r[0] for r in long.select(column).distinct().where(F.col(column).isNotNull()).collect())  # one row per column


def cross_correlations(long: DataFrame, other: DataFrame, x: str, y: str, min_n: int = 8, min_distinct: int = 2) -> DataFrame:
    """(x, y, n, rho): rank correlation of every column of long with every one of other, both (record_key, name, value), over the rows that have both: min_n of them and min_distinct (3 at most) values at least."""
    sides = [df.select("record_key", F.concat(F.lit(side), F.col(name)).alias("column"), F.col("value").cast("double").alias("value")) for df, name, side in ((long, x, "x"), (other, y, "y"))]
    xs, ys = (column_names(s, "column") for s in sides)
    found = rank_correlations(sides[0].unionByName(sides[1]), [*xs, *ys], xs, ys)
    kept = found.where((F.col("n") >= min_n) & (F.col("levels_x") >= min_distinct) & (F.col("levels_y") >= min_distinct))
    return kept.select(F.expr("substring(x, 2)").alias(x), F.expr("substring(y, 2)").alias(y), "n", "rho")
