"""Statistics over long tables (key, feature, value): quantiles and robust scores; ranks are in quillon.functions.gram.

Values are DOUBLE with NULL for missing; `long_form` turns NaN into NULL. Quantiles are exact and linear between ranks;
`approx` gives percentile_approx instead, which needs no map of all values of a feature but doesn't interpolate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import finite
from quillon.functions.shared import settled

OUTLIER_Z = 3.5
#: Accuracy of the sketch that narrows quantiles, groups that need none, and groups whose ranges are broadcast.
SKETCH = 10_000
SMALL_GROUP = 4096
BROADCAST_GROUPS = 100_000


def long_form(df: DataFrame, key: str | list[str], features: list[str]) -> DataFrame:
    """(key..., feature, value): one row per row and feature, missing values as NULL."""
    keys = [key] if isinstance(key, str) else key
    wide = df.select(*keys, *[finite(F.col(c).cast("double")).alias(c) for c in features])
    return wide.unpivot(keys, features, "feature", "value")


def quantiles(x: str, qs: list[float], approx: bool = False) -> Column:
    """The quantiles of a group as an array."""
    at = F.array(*map(F.lit, qs))
    return F.percentile_approx(x, at, 10_000) if approx else F.percentile(x, at)


def group_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """(by..., q): what quantiles() gives for each group, without a map of a group's values. Groups without a value are left out; NULL in `by` is a group.

    Two passes, whose ranges are narrowed by the data: the first finds by a sketch, for each quantile, two values that lie
    some thousandths of the group's rows below and above it; the second counts the rows between those ranges as one, and
    only what lies within them value by value. Groups of up to SMALL_GROUP rows are one range.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_g"), F.col(value).cast("double").alias("_v"))
    qs, margin = list(qs), 8 / SKETCH
    ends = [min(max(q + side * margin, 0.0), 1.0) for q in sorted(set(qs)) for side in (-1, 1)]
    ranges = rows.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", ends, SKETCH).alias("_e"))
    small = F.col("_n") <= SMALL_GROUP
    pairs = [(F.when(F.lit(ends[k] <= 0.0) | small, F.col("_low")).otherwise(F.col("_e")[k]), F.when(F.lit(ends[k + 1] >= 1.0) | small, F.col("_high")).otherwise(F.col("_e")[k + 1])) for k in range(0, len(ends), 2)]
    ranges = settled(ranges.select("_g", "_n", F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs]).alias("_r")))
    few = F.broadcast(ranges) if ranges.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else ranges
    met = rows.join(few, "_g")
    # written out range by range, which is compiled; functions over an array are not
    spans = [F.col("_r")[k] for k in range(len(pairs))]
    inside = reduce(lambda x, y: x | y, [(F.col("_v") >= r["a"]) & (F.col("_v") <= r["b"]) for r in spans])
    gap = sum(((r["b"] < F.col("_v")).cast("int") for r in spans), F.lit(0))
    cells = met.groupBy("_g", "_n", F.when(inside, F.col("_v")).alias("_x"), F.when(~inside, gap).alias("_gap")).agg(F.count("*").alias("_ties"), F.min("_v").alias("_v"))
    upto = F.sum("_ties").over(Window.partitionBy("_g", "_n").orderBy("_v"))
    ranked = cells.withColumn("_upto", upto)
    places = [F.lit(q) * (F.col("_n") - 1) for q in qs]
    ranks = [r for p in places for r in (F.floor(p), F.ceil(p))]
    at = lambda r: F.max(F.when((r >= F.col("_upto") - F.col("_ties")) & (r < F.col("_upto")), F.col("_x")))
    found = ranked.groupBy("_g", "_n").agg(*[at(r).alias(f"_v{k}") for k, r in enumerate(ranks)])
    there = lambda k: F.coalesce(F.col(f"_v{k}"), F.raise_error(F.lit("a quantile lies outside its range")).cast("double"))
    q = [F.when(there(2 * k) == there(2 * k + 1), there(2 * k)).otherwise((F.ceil(p) - p) * there(2 * k) + (p - F.floor(p)) * there(2 * k + 1)) for k, p in enumerate(places)]
    return found.select("_g.*", F.array(*q).alias("q"))


def spread(long: DataFrame, by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per feature: n, med, q1, q3, iqr, mad."""
    by = by or ["feature"]
    of = lambda df, x, qs: df.groupBy(*by).agg(quantiles(x, qs, True).alias("q")) if approx else group_quantiles(df, by, x, qs)
    first = long.groupBy(*by).agg(F.count("value").alias("n")).join(of(long, "value", [0.25, 0.5, 0.75]), by, "left")
    first = first.select(*by, "n", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("med"), F.get("q", F.lit(2)).alias("q3"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"))
    away = long.join(first.select(*by, "med"), by).withColumn("away", F.abs(F.col("value") - F.col("med")))
    return first.join(of(away, "away", [0.5]).select(*by, F.get("q", F.lit(0)).alias("mad")), by, "left")


def robust_z(value: Column, spread_less: float | None = None) -> Column:
    """0.6745 (x - med) / mad, by iqr / 1.349 where mad is 0, and `spread_less` where both are; from columns med, mad, iqr."""
    away = value - F.col("med")
    return F.when(F.col("mad") > 0, 0.6745 * away / F.col("mad")).when(F.col("iqr") > 0, away / (F.col("iqr") / 1.349)).when(F.lit(spread_less is not None) & F.col("med").isNotNull(), F.lit(spread_less).cast("double"))


def adjusted_skewness(x: str) -> Column:
    """Bias-corrected G1 of a group; Spark's skewness is the population's."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def joined_by(df: DataFrame, other: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """df with other's columns for equal `by`, NULL being equal to NULL; other has one row per group."""
    named = other.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return df.join(named, on, how).drop(*[f"_by_{c}" for c in by])
