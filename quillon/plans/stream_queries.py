"""The streaming operators over the events, which come in files with late and repeated rows, and the same over all events in SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from quillon.functions.shared import shared_folder
from quillon.plans.audit_queries import query
from quillon.streaming import frames as live

#: Files arrive in so many steps, and rows of one step up to a step late; LATE is longer than that.
STEPS = 5
LATE, IDLE = "15 days", "40 days"
ROWS_PER_PARTITION = 200_000


def _arriving(read, copies: bool) -> tuple:
    """(stream, folder, rows): events in files by time; every tenth row comes a step late, with copies every seventh a second time. The last file's row, of no user, lies long after all others."""
    spark, folder = read.spark, shared_folder(read.spark)
    events = read("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_type") != "error").alias("ok"))
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).first()
    at = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(span["a"]))) * STEPS / (F.unix_micros(F.lit(span["b"])) - F.unix_micros(F.lit(span["a"])) + 1))
    own = at + (F.col("event_id") % 10 == 0).cast("int")
    steps = events.withColumn("step", F.explode(F.when(F.lit(copies) & (F.col("event_id") % 7 == 0), F.array(own, at + 1)).otherwise(F.array(own))))
    end = spark.range(1).select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), (F.lit(span["b"]) + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("ok"))
    parts = max(1, -(-span["n"] // (STEPS * ROWS_PER_PARTITION)))
    for k in range(STEPS + 2):
        rows = steps.where(F.col("step") == k).drop("step") if k <= STEPS else end
        rows.repartition(parts if k <= STEPS else 1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", parts).parquet(f"{folder}/in")
    return stream, folder, span["n"]


@contextmanager
def _state_partitions(spark, rows: int):
    """As many partitions of state as the rows need: streams don't merge small ones."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(2, min(int(before), -(-rows // ROWS_PER_PARTITION)))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _run(read, build, copies: bool = False):
    stream, folder, rows = _arriving(read, copies)
    with _state_partitions(read.spark, rows):
        return live.run_to_end(build(stream), folder)


_E = "SELECT event_id, user_id, ts, value, event_type <> 'error' AS ok FROM events"
START = "date_format(start, 'yyyy-MM-dd HH:mm:ss') AS start"


@query("t01_stream_frame_qc", f"""SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_frames, round(avg(ok::INT), 6) AS detected_fraction, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM ({_E}) GROUP BY ALL""")
def _(read):
    found = _run(read, lambda s: live.stream_frame_qc(s, "ts", "user_id", "value", "ok", "1 hour", LATE))
    return found.where("user_id IS NOT NULL").selectExpr("user_id", START, "n_frames", "detected_fraction", "mean", "sd")


@query("t02_stream_rolling_level", f"""SELECT user_id, strftime(date_trunc('hour', ts) - k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 6) AS level FROM ({_E}), (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def _(read):
    found = _run(read, lambda s: live.stream_rolling_level(s, "ts", "user_id", "value", "2 hours", "1 hour", LATE))
    return found.where("user_id IS NOT NULL").selectExpr("user_id", START, "level")


@query("t03_stream_gap_sessions", f"""WITH e AS ({_E}), g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOURS, true) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOURS) AS end_us, count(*) AS n_frames FROM s GROUP BY user_id, k""")
def _(read):
    found = _run(read, lambda s: live.stream_gap_sessions(s, "ts", "user_id", "6 hours", LATE))
    return found.where("user_id IS NOT NULL").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_frames")


@query("t04_stream_file_dedupe", f"SELECT event_id, user_id, value, epoch_us(ts) AS ts_us FROM ({_E})")
def _(read):
    found = _run(read, lambda s: live.stream_dedupe(s, "ts", ["event_id"], LATE), copies=True)
    return found.where("event_id IS NOT NULL").select("event_id", "user_id", "value", F.unix_micros("ts").alias("ts_us"))


@query("t05_stream_metadata_join", f"SELECT event_id, user_id, site FROM ({_E}) LEFT JOIN metadata ON subject_id = user_id")
def _(read):
    metadata = read("metadata").select(F.col("subject_id").alias("user_id"), "site")
    return _run(read, lambda s: live.stream_metadata_join(s, metadata, ["user_id"])).where("event_id IS NOT NULL").select("event_id", "user_id", "site")


@query("t06_stream_run_state", f"""WITH e AS ({_E}), g AS (SELECT *, ok IS DISTINCT FROM lag(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new FROM e), s AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, any_value(ok) AS flag, epoch_us(min(ts)) AS start_us, count(*) AS length FROM s GROUP BY user_id, k""")
def _(read):
    found = _run(read, lambda s: live.stream_run_state(s, "user_id", "ts", "ok", "event_id", LATE, IDLE))
    return found.where("recording IS NOT NULL").select(F.col("recording").alias("user_id"), "flag", F.round(F.col("start") * 1_000_000).cast("bigint").alias("start_us"), "length")
