"""Queries of the block scans over three long recordings, which hold a third of all events each."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import scans
from quillon.plans.audit_queries import query
from quillon.plans.signal_queries import BY, EXTREMA, FILL, RUNS, _grad

LONG = "longf AS (SELECT recording_id % 3 AS recording_id, row_number() OVER w AS frame, row_number() OVER w * 4e-2 + row_number() OVER w % 3 * 5e-3 AS time_s, value, detected FROM frames WINDOW w AS (PARTITION BY recording_id % 3 ORDER BY recording_id, frame))"
ROWS = 20_000


def _over(sql: str) -> str:
    return f"{LONG}, " + sql.replace("FROM frames", "FROM longf")


def _long(read):
    rows = read("frames").withColumn("group", F.col("recording_id") % 3)
    placed = scans.end_to_end(rows, ["group"], ["recording_id"], "frame", "at").select(F.col("group").alias("recording_id"), F.col("at").alias("frame"), "value", "detected")
    return placed.withColumn("time_s", F.col("frame") * 0.04 + F.col("frame") % 3 * 0.005)


@query("w01_boolean_runs_long", f"WITH {_over(RUNS)} SELECT * FROM ru")
def _(read):
    return scans.boolean_runs(_long(read), BY, "frame", "detected", ROWS)


@query("w08_interpolate_long", f"WITH {_over(FILL)} SELECT recording_id, frame, round(filled, 6) AS filled FROM fb")
def _(read):
    return scans.interpolate_linear(_long(read), BY, "frame", "value", out="filled", rows=ROWS).select("recording_id", "frame", "filled")


@query("w09_interpolate_gap_long", f"WITH {_over(FILL)} SELECT recording_id, frame, round(CASE WHEN value IS NOT NULL OR (gap <= 2 AND k >= 3) THEN filled END, 6) AS filled FROM fb")
def _(read):
    return scans.interpolate_linear(_long(read), BY, "frame", "value", 2, "filled", ROWS).select("recording_id", "frame", "filled")


@query("w10_gradient_long", f"WITH {_over(FILL)}, {_grad('fb', 'filled', 'velocity', 'g1')} SELECT recording_id, frame, round(velocity, 4) + 0e0 AS velocity FROM g1", digits=4)
def _(read):
    filled = scans.interpolate_linear(_long(read), BY, "frame", "value", out="filled", rows=ROWS)
    return scans.gradient(filled, BY, "frame", "filled", "time_s", "velocity", ROWS).select("recording_id", "frame", "velocity")


@query("w22_local_extrema_long", f"WITH {_over(EXTREMA)} SELECT recording_id, frame, round(value, 6) AS value, kind FROM ex")
def _(read):
    return scans.local_extrema(_long(read), BY, "frame", "value", ROWS)
