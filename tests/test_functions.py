"""Closed forms and the conventions that decide results."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import gram, scalars, stats


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_names_and_truth(spark):
    assert one(spark, scalars.normalize_name(F.col("a")), a="  F0 Mean (Hz) ") == "f0_mean_hz"
    assert one(spark, scalars.truthy(F.col("a")), a=" Included ") is True
    assert one(spark, scalars.usable(F.col("a")), a="NaN") is False


def test_qc_family_order(spark):
    got = {n: one(spark, scalars.qc_family_of(F.col("a")), a=n) for n in ("qgain_x", "Background Noise", "snr_db", "hum_level", "something")}
    assert got == {"qgain_x": "Gain / level dynamics", "Background Noise": "Manual audio QC", "snr_db": "Additive interference", "hum_level": "Additive interference", "something": "unclassified"}


def test_geometry(spark):
    p = {k: float(v) for k, v in {"ax": 0, "ay": 0, "bx": 2, "by": 0, "cx": 0, "cy": 2}.items()}
    c = F.col
    assert one(spark, scalars.triangle_area_xy((c("ax"), c("ay")), (c("bx"), c("by")), (c("cx"), c("cy"))), **p) == 2
    assert math.isclose(one(spark, scalars.ellipse_eccentricity(c("a"), c("b")), a=2.0, b=1.0), math.sqrt(0.75))
    assert one(spark, scalars.safe_ratio(c("a"), c("b")), a=1.0, b=0.0) is None


def test_missing_coordinates(spark):
    df = spark.createDataFrame([(1.0, None, 4.0, 5.0)], "a double, b double, c double, d double")
    a, b = [F.col("a"), F.col("b")], [F.col("c"), F.col("d")]
    row = df.select(scalars.euclid_distance(a, b).alias("x"), scalars.euclid_distance_nullzero(a, b).alias("y")).first()
    assert (row["x"], row["y"]) == (None, 3.0)


@pytest.mark.parametrize(("text", "rate"), [("30000/1001", 30000 / 1001), ("25", 25.0), ("0/0", None), ("abc", None)])
def test_parse_rate(spark, text, rate):
    assert one(spark, scalars.parse_rate(F.col("a")), a=text) == rate


def test_nan_is_missing_and_ranks_share_ties(spark):
    import numpy as np

    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, float("nan"), 5.0])], "k int, v double")
    long = stats.long_form(df, "k", ["v"])
    assert long.where("value IS NULL").count() == 1
    rows = gram.column_rows(long, ["v"], "k", "feature")
    values = {r["row"]: r["xs"][0] for r in rows.collect()}
    ranks = gram.column_ranks(rows, gram.common_counts(rows, 1), np.zeros(1, np.int64)).collect()
    assert sorted((values[r["row"]], np.frombuffer(r["ranks"], np.int64)[0] / 2) for r in ranks) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (5.0, 4.0)]


def test_constant_columns_have_no_correlation(spark):
    long = spark.createDataFrame([(i, c, v) for i in range(9) for c, v in (("x", 1.0), ("y", float(i)))], "record_key int, column string, value double")
    r = gram.rank_correlations(long, ["x", "y"]).first()
    assert r["rho"] is None and (r["n"], r["levels_x"], r["levels_y"]) == (9, 1, 3)


def test_no_group_is_cut_into_quantiles_in_one_piece(spark):
    import random

    rng = random.Random(8)
    draw = {"a": lambda: rng.lognormvariate(8, 2), "b": lambda: rng.choice([-3.5, -0.0, 0.0, 1e-9, 2.0]), "c": lambda: rng.gauss(0, 1e3), "d": lambda: 7.25}
    rows = [(f, draw[f]()) for f in draw for _ in range(400)] + [("one", 5.0), ("none", None), ("a", None)]
    long, qs = spark.createDataFrame(rows, "feature string, value double"), [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = {r["feature"]: r["q"] for r in long.groupBy("feature").agg(stats.quantiles("value", qs).alias("q")).collect()}
    got = stats.group_quantiles(long, ["feature"], "value", qs)
    assert {r["feature"]: r["q"] for r in got.collect()} == {k: v for k, v in want.items() if v is not None}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_large_groups_of_close_or_equal_values_have_exact_quantiles(spark, monkeypatch):
    """Groups beyond SMALL_GROUP: timestamps that lie close together, a value that a third of the rows have, NULL as a group."""
    n = 30_000
    rows = spark.range(n).select(F.explode(F.array(*[F.struct(F.lit(g).alias("g"), x.cast("double").alias("value")) for g, x in (("time", F.col("id") + 1_000_000_000), ("third", F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)))), (None, F.rand(3)), ("same", F.lit(1)))])).alias("x")).select("x.*")
    qs = [0.0, 0.003, 0.05, 0.25, 1 / 3, 0.5, 0.95, 0.999, 1.0]
    want = {r["g"]: r["q"] for r in rows.groupBy("g").agg(stats.quantiles("value", qs).alias("q")).collect()}
    assert {r["g"]: r["q"] for r in stats.group_quantiles(rows, ["g"], "value", qs).collect()} == want


def test_ties_of_variances_and_ranges_go_as_in_duckdb(spark, duck):
    """Ranges of values of four digits, a tie at the third: rounding their decimal form told 138 of 10,000 differently."""
    from quillon.plans.audit_queries import _coarse

    names = ("within_subject_variance", "between_subject_variance", "median_within_subject_range")
    xs = [(k + 10000 * (k % 37) + 5) / 1e4 - (k % 211) / 1e3 for k in range(0, 100_000, 10)]
    df = spark.createDataFrame([(k, x, x, x) for k, x in enumerate(xs)], "k long, " + ", ".join(f"{n} double" for n in names))
    want = [r[0] for r in duck.execute("SELECT round(x, 3) FROM (SELECT unnest(?::DOUBLE[]) AS x, generate_subscripts(?::DOUBLE[], 1) AS k) ORDER BY k", [xs, xs]).fetchall()]
    for r in _coarse(df).collect():
        assert [r[n] for n in names] == [want[r["k"]]] * 3


def test_levels_are_joined_without_shuffling_rows(spark):
    """All rows of a level met in one task where Spark took the levels for a large table: they are few, and are broadcast."""
    from quillon.operators import relations

    long = spark.range(4000).select(F.col("id").alias("record_key"), F.lit("f").alias("feature"), ((F.col("id") * 37) % 101).cast("double").alias("value"))
    groups = spark.range(4000).select(F.col("id").alias("record_key"), F.lit("g").alias("group_variable"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("level"))
    seen, join = [], type(long).join

    def watched(left, right, on=None, how=None):
        out = join(left, right, on, how)
        if on == ["group_variable", "level"]:
            seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        type(long).join = watched
        found = relations.group_screen(long, groups).collect()
    finally:
        type(long).join = join
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 1 and found[0]["n_levels"] == 2 and found[0]["n_pairwise"] == 4000
    assert seen and all("BroadcastHashJoin" in p for p in seen)
