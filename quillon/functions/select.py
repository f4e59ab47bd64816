"""Exact quantiles of the columns of a wide table, over levels of its variables, found by the bits of the values.

Rows are those of quillon.functions.gram: the values of all columns, and after them, for each variable, the number of the
row's level among its own, from 0 on.
Three passes count the values by their leading bits, of those values only that share the bits found so far with a wanted
rank. A task holds counts, never values, and what comes to the driver is a row for each wanted rank of a column and level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.gram import _dense
from quillon.functions.scalars import finite

#: Bits that are left to find after each pass.
SHIFTS = (44, 22, 0)
#: Values of a task's block, and counts of one column that a task holds.
BLOCK_VALUES = 4 << 20
HELD_COUNTS = 4 << 20
_MOST = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; -0.0 is 0.0."""
    b = (x + 0.0).view(np.int64)
    return b ^ ((b >> 63) & _MOST)


def double_of(s: int) -> float:
    """The double of ordered_bits()."""
    return float(np.array([s ^ ((s >> 63) & int(_MOST))], np.int64).view(np.float64)[0])


def _found(bits: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct leading bits and the place of each value's among them."""
    top = bits >> shift
    if shift < 44:
        return np.unique(top, return_inverse=True)
    low = np.int64(1 << 19)  # 20 bits are few enough for a table
    there = np.zeros(1 << 20, bool)
    there[top + low] = True
    return np.flatnonzero(there) - low, (np.cumsum(there, dtype=np.int32) - 1)[top + low]


def _counts(rows: DataFrame, width: int, variables: list[int], shift: int, before: int, wanted: list[dict[int, np.ndarray]] | None) -> DataFrame:
    """(k, j, p, n): how many values of column k that group j has with leading bits p. Groups are the levels of all variables in order, then the variables."""
    n_levels, n_groups = sum(variables), sum(variables) + len(variables)
    starts = np.cumsum([0, *variables])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def give(k: int) -> pa.RecordBatch:
            bins, n = held.pop(k)
            keep = n > 0
            if wanted is not None:
                of = [*wanted[k]]
                mine = np.stack([wanted[k][p] for p in of])[np.searchsorted(np.array(of), bins >> (before - shift))]
                keep &= mine
            at, j = np.nonzero(keep)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(j.astype(np.int32)), pa.array(bins[at]), pa.array(n[at, j])], names=["k", "j", "p", "n"])

        def add(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            v, g = x[:, :width], x[:, width:]
            for k in range(width):
                if wanted is not None and not wanted[k]:
                    continue
                own = np.flatnonzero(~np.isnan(v[:, k]))
                bits = ordered_bits(v[own, k])
                if wanted is not None:
                    of = np.array([*wanted[k]])
                    p = bits >> before
                    hit = of[np.minimum(np.searchsorted(of, p), len(of) - 1)] == p
                    own, bits = own[hit], bits[hit]
                if not len(own):
                    continue
                bins, at = _found(bits, shift)
                n = np.zeros((len(bins), n_groups), np.int64)
                for c, size in enumerate(variables):
                    level = g[own, c]
                    some = ~np.isnan(level)
                    flat = at[some].astype(np.int64) * size + level[some].astype(np.int64)
                    n[:, starts[c] : starts[c + 1]] = np.bincount(flat, minlength=len(bins) * size).reshape(len(bins), size)
                    n[:, n_levels + c] = n[:, starts[c] : starts[c + 1]].sum(axis=1)
                if k in held:
                    old, m = held[k]
                    every = np.union1d(old, bins)
                    total = np.zeros((len(every), n_groups), np.int64)
                    total[np.searchsorted(every, old)] += m
                    total[np.searchsorted(every, bins)] += n
                    bins, n = every, total
                held[k] = (bins, n)
                if n.size > HELD_COUNTS:
                    yield give(k)

        parts, size = [], 0
        for batch in batches:
            x = _dense(batch, width + len(variables))
            parts.append(x)
            size += x.size
            if size >= BLOCK_VALUES:
                yield from add(np.concatenate(parts))
                parts, size = [], 0
        if size:
            yield from add(np.concatenate(parts))
        for k in [*held]:
            yield give(k)

    return rows.mapInArrow(count, "k int, j int, p bigint, n bigint").groupBy("k", "j", "p").agg(F.sum("n").alias("n"))


def level_quantiles(rows: DataFrame, width: int, variables: list[int], of_level: list[float], of_variable: list[float]) -> dict[tuple[int, int], tuple[int, list[float]]]:
    """(column, group) -> (n, quantiles), linear between ranks as quantiles() gives them; groups without values are left out.

    variables has the number of levels of each. Groups are the levels, one variable's after the other's: group j is level j, whose
    quantiles are of_level, or after the levels a variable: all rows with a level of it, with of_variable.
    """
    n_levels, spark = sum(variables), rows.sparkSession
    wanted, goals, sizes, before = None, [], {}, 64
    for shift in SHIFTS:
        counted = _counts(rows, width, variables, shift, before, wanted)
        parent = F.lit(0).cast("bigint") if wanted is None else F.shiftright("p", before - shift)
        upto = F.sum("n").over(Window.partitionBy("k", "j", "parent").orderBy("p"))
        placed = counted.withColumn("parent", parent).withColumn("upto", upto)
        if wanted is None:
            total = F.sum("n").over(Window.partitionBy("k", "j", "parent"))
            qs = F.when(F.col("j") < n_levels, F.array(*map(F.lit, of_level)).cast("array<double>")).otherwise(F.array(*map(F.lit, of_variable)).cast("array<double>"))
            asked = placed.withColumn("total", total).withColumn("at", F.explode(F.flatten(F.transform(qs, lambda q: F.array(F.floor(q * (F.col("total") - 1)), F.ceil(q * (F.col("total") - 1)))))))
            met = asked.where((F.col("at") >= F.col("upto") - F.col("n")) & (F.col("at") < F.col("upto"))).select("k", "j", "at", "p", (F.col("upto") - F.col("n")).alias("below"), "total")
        else:
            goal = F.broadcast(spark.createDataFrame(goals, "k int, j int, at bigint, parent bigint, start bigint"))  # one row per wanted rank
            asked = placed.join(goal, ["k", "j", "parent"]).withColumn("upto", F.col("start") + F.col("upto"))
            met = asked.where((F.col("at") >= F.col("upto") - F.col("n")) & (F.col("at") < F.col("upto"))).select("k", "j", "at", "p", (F.col("upto") - F.col("n")).alias("below"), F.lit(0).cast("bigint").alias("total"))
        found = {(r["k"], r["j"], r["at"]): r for r in met.distinct().collect()}  # one row per wanted rank
        if wanted is None:
            sizes = {(k, j): r["total"] for (k, j, _), r in found.items()}
        goals = [(k, j, at, r["p"], r["below"]) for (k, j, at), r in found.items()]
        wanted = [{} for _ in range(width)]
        for k, j, _, p, _ in sorted(goals, key=lambda x: x[3]):
            wanted[k].setdefault(p, np.zeros(n_levels + len(variables), bool))[j] = True
        before = shift
    values = {(k, j, at): double_of(p) for k, j, at, p, _ in goals}
    out = {}
    for (k, j), n in sizes.items():
        got = []
        for q in of_level if j < n_levels else of_variable:
            place = q * (n - 1)
            low, high = int(np.floor(place)), int(np.ceil(place))
            a, b = values[k, j, low], values[k, j, high]
            got.append(a if a == b else (high - place) * a + (place - low) * b)
        out[k, j] = (n, got)
    return out


def column_quantiles(df: DataFrame, columns: list, qs: list[float]) -> dict[int, list[float]]:
    """place of a column -> its quantiles over all rows of a wide table; columns without values are left out."""
    rows = df.select(F.array(*[finite(c.cast("double")) for c in columns], F.lit(0.0)).alias("v"))
    return {k: q for (k, j), (_, q) in level_quantiles(rows, len(columns), [1], [], qs).items() if j == 1}
