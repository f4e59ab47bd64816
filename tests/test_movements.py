"""Summaries of movements."""

from quillon.operators import landmarks


def test_summary_reads_movements_once(spark):
    moved = spark.createDataFrame([("r", i, i * 0.5, float(i * i) if i != 2 else None, -float(i), 1 if i < 5 else 2 if i < 9 else None, "open" if i < 5 else "close") for i in range(10)], "rec string, frame long, t double, a double, b double, movement_id int, movement_kind string")
    found = landmarks.movement_summary(moved, ["rec"], "frame", "t", ["a", "b"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    got = {(r.movement_id, r.signal): r for r in found.collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    one = got[1, "a"]
    assert (one.n_frames, one.start_frame, one.end_frame, one.duration_s, one.movement_kind) == (5, 0, 4, 2.0, "open")
    assert one.valid_fraction == 0.8 and one.median == 5.0 and got[1, "b"].valid_fraction == 1.0 and got[2, "b"].median == -6.5
