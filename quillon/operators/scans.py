"""Runs, gaps, gradients and extrema of recordings too long for one task: blocks are scanned alone, and what one block hands to the next is a row.

Rows of a recording are cut into blocks that follow each other in its order. A block's summary (its last row, its last
known value, its sum) is one row; summaries of a recording are chained by a window over its blocks, and each block is
finished with what was carried to it. Results are those of quillon.operators.windows, whatever the size of the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.shared import settled

#: Rows of a block, about.
ROWS = 1_000_000


def ordered_blocks(df: DataFrame, by: list[str], at: str, rows: int | None = None) -> DataFrame:
    """df with _block: numbers that rise with `at` in each recording, for some `rows` rows each; (by, at) tells rows apart."""
    parts = max(1, -(-df.count() // (rows or ROWS)))
    ordered = df.repartitionByRange(parts, *by, at).sortWithinPartitions(*by, at)
    return settled(ordered.withColumn("_block", F.spark_partition_id()))


def end_to_end(df: DataFrame, group: list[str], by: list[str], at: str, place: str) -> DataFrame:
    """df with `place`, from 1 on: the samples of a group's recordings one after another, in the order of `by`; only a number per recording of a group meets in one task."""
    rows = df.withColumns({"_g": F.struct(*group), "_r": F.struct(*by)})
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_g", "_r").agg(F.count("*").alias("_m")).withColumn("_before", before).drop("_m")
    own = F.row_number().over(Window.partitionBy("_g", "_r").orderBy(at))
    return rows.join(starts, ["_g", "_r"]).withColumn(place, F.col("_before") + own).drop("_g", "_r", "_before")


def _inside(by: list[str], at: str | Column) -> Window:
    return Window.partitionBy(*by, "_block").orderBy(at)


def _handed(df: DataFrame, by: list[str], summary: Column, chain: Column, name: str) -> DataFrame:
    """df with the column `name`: chain, a window expression over the blocks' summary `_s`, for each block."""
    blocks = df.groupBy(*by, "_block").agg(summary.alias("_s")).withColumn(name, chain).drop("_s")
    return df.join(blocks, [*by, "_block"], "left")


def _blocks_before(by: list[str], ahead: bool = False) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc("_block") if ahead else "_block")


def neighbour(df: DataFrame, by: list[str], at: str, columns: list[str], name: str, ahead: bool = False) -> DataFrame:
    """df with `name`: a struct of the columns of the row before (ahead: after) in the recording, NULL at its end."""
    one = F.struct(*columns)
    w, u = _inside(by, at), _blocks_before(by)
    edge = F.min_by(one, at) if ahead else F.max_by(one, at)
    step = F.lead if ahead else F.lag
    handed = _handed(df, by, edge, step("_s").over(u), "_h")
    return handed.withColumn(name, F.coalesce(step(one).over(w), F.col("_h"))).drop("_h")


def known(df: DataFrame, by: list[str], at: str, columns: list[str], where: str, name: str, ahead: bool = False) -> DataFrame:
    """df with `name`: a struct of the columns of the last row up to (ahead: the first from) this one that has a value in `where`."""
    one = F.when(F.col(where).isNotNull(), F.struct(*columns))
    # in falling order what comes first is what was last: frames up to the end of a block are summed up anew for each row
    w, u = _inside(by, F.desc(at) if ahead else F.col(at)), _blocks_before(by, ahead)
    order = F.when(F.col(where).isNotNull(), F.col(at))
    edge = F.min_by(one, order) if ahead else F.max_by(one, order)
    handed = _handed(df, by, edge, F.last("_s", ignorenulls=True).over(u.rowsBetween(Window.unboundedPreceding, -1)), "_h")
    return handed.withColumn(name, F.coalesce(F.last(one, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_h"))).drop("_h")


def running_sum(df: DataFrame, by: list[str], at: str, x: Column, name: str) -> DataFrame:
    """df with `name`: the sum of x over the rows of the recording up to this one."""
    df = df.withColumn("_x", x)
    handed = _handed(df, by, F.sum("_x"), F.coalesce(F.sum("_s").over(_blocks_before(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_h")
    return handed.withColumn(name, F.col("_h") + F.sum("_x").over(_inside(by, at).rowsBetween(Window.unboundedPreceding, 0))).drop("_h", "_x")


def boolean_runs(df: DataFrame, by: list[str], at: str, flag: str, rows: int | None = None) -> DataFrame:
    """windows.boolean_runs of recordings of any length."""
    flat = ordered_blocks(df.select(*by, at, F.coalesce(F.col(flag), F.lit(False)).alias(flag)), by, at, rows)
    marked = neighbour(flat, by, at, [flag], "_p")
    numbered = running_sum(marked, by, at, (F.col("_p").isNull() | (F.col("_p")[flag] != F.col(flag))).cast("bigint"), "run")
    return numbered.groupBy(*by, "run", flag).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length"))


def interpolate_linear(df: DataFrame, by: list[str], at: str, value: str, max_gap: int | None = None, out: str | None = None, rows: int | None = None) -> DataFrame:
    """windows.interpolate_linear of recordings of any length."""
    placed = filled(numbered(df, by, at, rows), by, at, value, max_gap)
    return placed.withColumn(out or value, F.col("_filled")).drop("_filled", "_n", "_block")


def numbered(df: DataFrame, by: list[str], at: str, rows: int | None = None) -> DataFrame:
    """df in blocks with _n, each row's place in its recording from 1 on."""
    return running_sum(ordered_blocks(df, by, at, rows), by, at, F.lit(1).cast("bigint"), "_n")


def filled(placed: DataFrame, by: list[str], at: str, value: str, max_gap: int | None = None) -> DataFrame:
    """numbered() rows with _filled: the value, or what windows.interpolate_linear puts in its place."""
    v = F.col(value)
    placed = known(known(placed.withColumn("_v", v), by, at, ["_n", "_v"], value, "_p"), by, at, ["_n", "_v"], value, "_q", ahead=True)
    p, q = F.col("_p"), F.col("_q")
    line = p["_v"] + (q["_v"] - p["_v"]) * (F.col("_n") - p["_n"]) / F.when(q["_n"] > p["_n"], q["_n"] - p["_n"])
    found = F.coalesce(v, line, p["_v"], q["_v"])
    if max_gap is not None:
        whole = placed.groupBy(*by).agg(F.max("_n").alias("_last"), F.count(value).alias("_many"))
        placed = placed.join(whole, by)
        gap = F.coalesce(q["_n"], F.col("_last") + 1) - F.coalesce(p["_n"], F.lit(0)) - 1
        found = F.when(v.isNotNull(), v).when((gap <= max_gap) & (F.col("_many") >= 3), found)
        return placed.withColumn("_filled", found).drop("_v", "_p", "_q", "_last", "_many")
    return placed.withColumn("_filled", found).drop("_v", "_p", "_q")


def gradient(df: DataFrame, by: list[str], at: str, value: str, time: str, out: str, rows: int | None = None) -> DataFrame:
    """windows.gradient of recordings of any length."""
    placed = running_sum(ordered_blocks(df, by, at, rows), by, at, F.lit(1).cast("bigint"), "_n").withColumns({"_v": F.col(value), "_time": F.col(time)})
    placed = neighbour(neighbour(placed, by, at, ["_n", "_v", "_time"], "_p"), by, at, ["_n", "_v", "_time"], "_q", ahead=True)
    rises = F.coalesce(F.col(time) > F.col("_p._time"), F.col("_p").isNull())
    whole = placed.groupBy(*by).agg(F.min(rises).alias("_rises"), F.count("*").alias("_many"))
    placed = placed.join(whole, by)
    pick = lambda side: F.when(F.col("_rises"), F.col(f"{side}_time")).otherwise(F.col(f"{side}_n"))
    v, v0, v1 = F.col("_v"), F.col("_p._v"), F.col("_q._v")
    a, b = pick("") - pick("_p."), pick("_q.") - pick("")
    inner = (a * a * v1 + (b * b - a * a) * v - b * b * v0) / (a * b * (a + b))
    slope = F.when(F.col("_p").isNull(), (v1 - v) / b).when(F.col("_q").isNull(), (v - v0) / a).otherwise(inner)
    return placed.withColumn(out, F.when(F.col("_many") >= 3, slope)).drop("_n", "_v", "_time", "_p", "_q", "_rises", "_many", "_block")


def local_extrema(df: DataFrame, by: list[str], at: str, value: str, rows: int | None = None) -> DataFrame:
    """windows.local_extrema of recordings of any length."""
    flat = ordered_blocks(df.where(F.col(value).isNotNull()).select(*by, at, value), by, at, rows)
    marked = neighbour(flat, by, at, [value], "_p")
    placed = running_sum(marked, by, at, F.lit(1).cast("bigint"), "_n")
    placed = running_sum(placed, by, at, (F.col("_p").isNull() | (F.col("_p")[value] != F.col(value))).cast("bigint"), "_run")
    placed = settled(placed.select(*by, at, value, "_block", "_n", "_run"))
    runs = placed.groupBy(*by, "_run").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"), F.min("_block").alias("_block"), F.first(value).alias(value))
    runs = settled(runs.withColumn("_n", F.floor((F.col("_a") + F.col("_b")) / 2)))
    around = neighbour(neighbour(runs, by, "_run", [value], "_p"), by, "_run", [value], "_q", ahead=True)
    x, p, q = F.col(value), F.col("_p")[value], F.col("_q")[value]
    kind = F.when((p < x) & (q < x), "peak").when((p > x) & (q > x), "trough")
    found = around.withColumn("kind", kind).where("kind IS NOT NULL").select(*by, "_n", "kind")
    return found.join(placed.select(*by, "_n", at, value), [*by, "_n"]).select(*by, at, value, "kind")
