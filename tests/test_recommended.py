"""Queries that read the recordings as a wide table: what they compute, and how often."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import gram
from quillon.functions.stats import long_form
from quillon.operators import audit, columns, export, relations
from quillon.plans import audit_queries, entries
from tests.conftest import SF
from tests.test_screens import FEATURES, _never, rows_of, table  # noqa: F401


def test_screening_summary_profiles_the_columns_once(spark, monkeypatch):
    for module in (gram, relations):
        monkeypatch.setattr(module, "column_rows", _never, raising=False)
    seen, profile = [], columns.profile_columns
    monkeypatch.setattr(columns, "profile_columns", lambda df: (seen.append(df.columns), profile(df))[1])
    assert entries.QUERIES["q42_screening_summary"](spark, SF).count() == 5
    assert len(seen) == 1


def test_table_distribution_equals_that_of_long_tables(spark, table):
    long = long_form(table, "record_key", FEATURES)
    dist = audit.table_distribution(table, FEATURES)
    want = audit.distribution_summary(long)
    assert rows_of(dist.select(sorted(dist.columns))) == rows_of(want.select(sorted(want.columns)))
    registry = spark.createDataFrame([("plain", "a", -1.0, 1.0), ("void", "a", 0.0, None), ("rare", "b", None, 0.5), ("other", "b", 0.0, 1.0)], "feature string, family string, expected_low double, expected_high double")
    assert rows_of(audit.table_range_flags(table, FEATURES, registry)) == rows_of(audit.expected_range_flags(long, registry))
    assert audit.table_distribution(table.where("false"), FEATURES).count() == audit.table_range_flags(table.where("false"), FEATURES, registry).count() == 0


def test_table_repeatability_equals_that_of_long_tables(spark, table):  # noqa: F811
    registry = spark.createDataFrame([("plain", "a", -1.0, 1.0)], "feature string, family string, expected_low double, expected_high double")
    rows = table.withColumn("unit", F.when(F.col("record_key") % 9 > 0, F.pmod(F.col("record_key") * 7, F.lit(90)).cast("string")))
    want = relations.repeatability(long_form(rows, ["record_key", "unit"], FEATURES), registry)
    got = relations.table_repeatability(rows, "unit", FEATURES, registry)
    assert rows_of(got.select(want.columns)) == rows_of(want)
    assert relations.table_repeatability(rows.where("false"), "unit", FEATURES, registry).count() == 0


def test_units_are_met_without_long_rows(spark, monkeypatch):
    monkeypatch.setattr(relations, "repeatability", _never)
    assert entries.QUERIES["q53_handoff_counts"](spark, SF).count() == 3


def test_task_export_writes_the_recordings_once(spark, monkeypatch):
    seen = []
    for where in (gram, audit_queries):
        was = where.settled
        monkeypatch.setattr(where, "settled", lambda df, was=was: (seen.append(df.columns), was(df))[1])
    assert entries.QUERIES["q54_task_export"](spark, SF).count() > 0
    assert sum("total_price" in c for c in seen) == 1


def test_recommendations_rank_all_columns_in_one_pass(spark, monkeypatch):
    """Four rankings, each from long rows of its own."""
    for module in (gram, relations):
        monkeypatch.setattr(module, "column_rows", _never, raising=False)
    monkeypatch.setattr(audit, "distribution_summary", _never)
    seen, ranked = [], relations.row_correlations
    monkeypatch.setattr(relations, "row_correlations", lambda *args: (seen.append(args[1]), ranked(*args))[1])
    assert entries.QUERIES["q51_recommendations"](spark, SF).count() == 9
    assert len(seen) == 1


@pytest.mark.parametrize(("module", "name", "query"), [("relations", "recommendation_rollups", "q52_recommendation_rollups"), ("export", "priority_review", "q53_priority_review"), ("export", "handoff_counts", "q53_handoff_counts"), ("export", "task_export", "q54_task_export")])
def test_recommendations_are_computed_once_for_what_is_made_of_them(spark, monkeypatch, module, name, query):
    """The rollups computed the whole table three times."""
    of, seen = {"relations": relations, "export": export}[module], []
    was = getattr(of, name)

    def watched(*args, **kwargs):
        seen.append(next(a for a in args if "readiness_recommendation" in a.columns)._jdf.queryExecution().optimizedPlan().toString())
        return was(*args, **kwargs)

    monkeypatch.setattr(of, name, watched)
    for where in (gram, relations):
        monkeypatch.setattr(where, "column_rows", _never, raising=False)
    assert entries.QUERIES[query](spark, SF).count() > 0
    assert len(seen) == 1 and "Join" not in seen[0]
