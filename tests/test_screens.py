"""Screens of wide tables against those of long ones, and how often rows are read for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import gram
from quillon.functions.gram import numbered
from quillon.functions.stats import long_form
from quillon.operators import audit, relations
from quillon.plans import audit_queries
from tests.conftest import SF

FEATURES = ["odd", "plain", "rare", "same", "steps", "void"]


@pytest.fixture(scope="module")
def table(spark):
    rng, n = np.random.default_rng(3), 400
    base = rng.normal(size=n).tolist()
    rows = []
    for i in range(n):
        x = {"plain": base[i], "odd": base[i] * 2 + float(rng.normal()) if i % 2 else None, "steps": float(np.floor(base[i] * 2)), "same": 4.0, "rare": float("nan") if i > 20 else base[i], "void": None}
        g = {"three": "abc"[i % 3], "two": None if i % 11 == 0 else "xy"[i % 5 == 0], "one": "z", "many": str(i % 40)}
        rows.append((i, *(x[c] for c in FEATURES), float(rng.normal()) if i % 7 else None, base[i] + float(rng.normal()), *g.values()))
    return numbered(spark.createDataFrame(rows, "record_key long, " + ", ".join(f"{c} double" for c in FEATURES) + ", outcome double, metric double, three string, two string, one string, many string").repartition(3))


def rows_of(df):
    told = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted([{k: told(v) for k, v in r.asDict().items()} for r in df.collect()], key=repr)


@pytest.mark.parametrize("table_ranks", [gram.TABLE_RANKS, 0])
def test_table_screens_equal_those_of_long_tables(spark, monkeypatch, table, table_ranks):
    monkeypatch.setattr(gram, "TABLE_RANKS", table_ranks)
    groups = ["three", "two", "one", "many"]
    found = relations.TableScreens(table, FEATURES, ["outcome"], ["metric"], groups)
    long, metric = long_form(table, "record_key", FEATURES), long_form(table, "record_key", ["metric"])
    outcome = long_form(table, "record_key", ["outcome"]).select("record_key", F.col("feature").alias("outcome_variable"), F.col("value").alias("y"))
    assert rows_of(found.feature_correlation()) == rows_of(relations.feature_correlation(long))
    assert rows_of(found.continuous_screen()) == rows_of(relations.continuous_screen(long, outcome))
    assert rows_of(found.qc_correlation()) == rows_of(audit.feature_qc_correlation(long, metric))
    want = rows_of(relations.group_screen(long, table.select("record_key", *groups).unpivot("record_key", groups, "group_variable", "level")))
    assert rows_of(found.group_screen()) == want and {r["group_variable"] for r in want} == {"three", "two"}


def test_group_screen_divides_by_the_sd_where_the_quartiles_are_equal(spark):
    rows = [(i, "f", 100.0 + (i % 50 == 0) * i) for i in range(200)]
    long = spark.createDataFrame(rows, "record_key long, feature string, value double")
    groups = long.select("record_key", F.lit("g").alias("group_variable"), F.when(F.col("record_key") % 50 == 0, "a").otherwise("b").alias("level"))
    r = relations.group_screen(long, groups).first()
    x = np.array([v for _, _, v in rows])
    assert abs(r["effect"] - (100.0 - np.median(x[::50])) / x.std(ddof=1)) < 1e-12


def test_group_screen_makes_no_row_per_record_feature_and_variable(spark, monkeypatch, table):
    """Rows of all features were joined with those of all variables, and written."""
    seen, join = [], type(table).join
    monkeypatch.setattr(type(table), "join", lambda left, right, on=None, how=None: (seen.append(on), join(left, right, on, how))[1])
    groups = table.select("record_key", "three", "two").unpivot("record_key", ["three", "two"], "group_variable", "level")
    assert relations.group_screen(long_form(table, "record_key", FEATURES), groups).count() == 8
    assert "record_key" not in seen and ["record_key"] not in seen


def _never(*args, **kwargs):
    raise AssertionError("rows in long form")


@pytest.mark.parametrize("name", ["q40_group_screen", "q43_screening_priority"])
def test_screens_read_the_table_as_it_is(spark, monkeypatch, name):
    """Each screen turned the table into long form, and that back into rows by a shuffle of its own."""
    for module in (gram, relations):
        monkeypatch.setattr(module, "column_rows", _never, raising=False)
    assert audit_queries.QUERIES[name](spark, SF).count() > 0
