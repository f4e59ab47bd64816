"""Quality metrics of records, row by row."""

from quillon.operators import audit


def table(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i * i % 11), 1.0 if i % 9 else None, 400.0 if i in (4, 8) else float(i % 3)) for i in range(60)]
    return spark.createDataFrame(rows, "record_key long, qadd_a double, qgain_b double, qadd_flat double, qdist_c double")


METRICS = ["qadd_a", "qgain_b", "qadd_flat", "qdist_c"]


def test_burden_of_rows_needs_no_shuffle_of_records(spark):
    found = audit.qc_row_burden(table(spark), "record_key", METRICS)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.record_key: r for r in found.collect()}
    assert len(got) == 60
    assert {k for k, r in got.items() if r.total_qc_flags} == {4, 8}
    assert got[4].qc_flag_fraction == 0.25 and got[4].top_qc_variable == "qdist_c" and got[4].elevated_qc_families == "Nonlinear distortion"
    assert got[9].max_abs_qc_z is not None and got[9].elevated_qc_families == ""


def test_burden_of_families_groups_shares_not_records(spark):
    found = audit.qc_family_burden(table(spark), "record_key", METRICS)
    assert "record_key" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in line or "Exchange" in line)
    got = {r.artifact_family: r for r in found.collect()}
    assert {f: r.n_qc_metrics for f, r in got.items()} == {"Additive interference": 2, "Gain / level dynamics": 1, "Nonlinear distortion": 1}
    assert all(r.median_row_flag_fraction == 0 for r in got.values())


def test_scores_and_burden_need_no_shuffle_of_records(spark):
    families = {"one": ["qadd_a", "qgain_b"], "two": ["qadd_flat", "qdist_c"]}
    scaled = audit.scaled_metrics(table(spark), "record_key", METRICS)
    scores = audit.qc_family_scores(scaled, families)
    burden = audit.qc_burden(scores, [*families])
    assert "Exchange" not in burden._jdf.queryExecution().executedPlan().toString()
    row = {r.record_key: r for r in scaled.collect()}
    assert len(row) == 60 and all(r.qadd_flat is None for r in row.values()) and row[5].qgain_b is None
    # 0 to 6: the median is 3, the quartiles 1 and 5 (60 values, the last four 0 to 3)
    assert row[3].qadd_a == (3.0 - row_median([i % 7 for i in range(60)])) / iqr([i % 7 for i in range(60)])
    got, sides = {r.record_key: r.burden for r in burden.collect()}, {r.record_key: r for r in scores.collect()}
    assert sides[5].one == row[5].qadd_a and sides[7].one == 0.5 * row[7].qadd_a + 0.5 * row[7].qgain_b
    assert got[7] == 0.5 * abs(sides[7].one) + 0.5 * abs(sides[7].two)
    rows = {(r.record_key, r.family): r for r in audit.qc_family_rows(scaled, "record_key", families).collect()}
    assert rows[5, "one"].n_features == 1 and rows[7, "two"].score == sides[7].two and rows[7, "two"].n_features == 1


def row_median(values):
    x = sorted(values)
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2


def iqr(values):
    x = sorted(map(float, values))
    at = lambda p: x[int(p)] + (x[min(int(p) + 1, len(x) - 1)] - x[int(p)]) * (p - int(p))
    return at(0.75 * (len(x) - 1)) - at(0.25 * (len(x) - 1))


def test_few_rows_are_cut_before_their_quartiles(spark):
    few = spark.createDataFrame([(1, 0.0), (2, 100.0)], "record_key long, qadd_a double")
    low, high = 1.0, 99.0
    q1, q3 = low + 0.25 * (high - low), low + 0.75 * (high - low)
    got = {r.record_key: r.qadd_a for r in audit.scaled_metrics(few, "record_key", ["qadd_a"]).collect()}
    assert abs(got[1] - (low - 50) / (q3 - q1)) < 1e-12 and abs(got[2] - (high - 50) / (q3 - q1)) < 1e-12
