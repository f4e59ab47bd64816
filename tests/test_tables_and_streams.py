"""Readers and writers, plug-ins, and streams against batch."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import plugins
from quillon.operators.assemble import early_fusion, group_split, leakage_precheck, problem_type
from quillon.operators.windows import boolean_runs, gradient, mask_to_segments
from quillon.plans.views import view
from quillon.sources import tables
from quillon.streaming import frames as live
from tests.conftest import SF


def test_read_table_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" id ,x\n007,1.5\n8,NaN\n")
    df = tables.read_table(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["id", "x"] and df.where("x IS NULL").count() == 1
    assert tables.read_table(spark, f"file://{tmp_path}/a.csv", infer=False).first()["id"] == "007"
    with pytest.raises(ValueError, match="unknown kind"):
        tables.read_table(spark, "a.xlsx")


def test_media_and_handoff(spark, tmp_path):
    for name in ("a.WAV", "b.mp4", "c.txt"):
        (tmp_path / name).write_text("x")
    assert tables.list_media(spark, f"file://{tmp_path}", (".wav", ".mp4")).count() == 2
    values = spark.createDataFrame([("r1", 1.0)], "record_key string, f0 double")
    registry = spark.createDataFrame([("f0", "phonatory", "50")], "feature_name string, subsystem string, low string")
    tables.write_feature_handoff(values, registry, values, f"file://{tmp_path}/out", "acoustic")
    assert tables.read_feature_handoff(spark, f"file://{tmp_path}/out")["registry"].first()["expected_low"] == 50
    tables.write_feature_handoff(values.union(values), registry, values, f"file://{tmp_path}/out", "acoustic")
    assert tables.read_feature_handoff(spark, f"file://{tmp_path}/out")["values"].count() == 2
    assert tuple(spark.read.parquet(f"file://{tmp_path}/out/manifest").drop("version").first()) == ("acoustic", 2, 1, 1)


def test_csv_keeps_headers_and_ids(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5)], "id string, x double")
    tables.write_table(df.where("false"), f"file://{tmp_path}/empty.csv", csv=True)
    tables.write_table(df, f"file://{tmp_path}/some.csv", csv=True)
    assert tables.read_table(spark, f"file://{tmp_path}/empty.csv").columns == ["id", "x"]
    assert tuple(tables.read_table(spark, f"file://{tmp_path}/some.csv", text=("id",)).first()) == ("007", 1.5)
    assert tables.read_table(spark, None) is None
    (tmp_path / "t.txt").write_text("a,b\n1,2\n")
    assert tables.read_table(spark, f"file://{tmp_path}/t.txt", ",").columns == ["a", "b"]


def test_ml_tables(spark, tmp_path):
    df = spark.createDataFrame([("r1", "t", 1.0, 2.0)], "id string, task string, f double, g double")
    tables.write_ml_tables(df, ["id"], ["task"], ["f", "g"], f"file://{tmp_path}/ml", "task")
    read = lambda n: sorted(spark.read.parquet(f"file://{tmp_path}/ml/{n}").columns)
    assert (read("ids_predictors"), read("ids_context_predictors"), read("predictors")) == (["f", "g", "id"], ["f", "g", "id", "task"], ["f", "g"])


def test_plugin_failure_is_a_result(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "rec string, x double")

    def compute(rows):
        if rows["x"].isna().any():
            raise RuntimeError("no samples")
        return {"mean": float(rows["x"].mean())}

    got = {(r["rec"], r["feature"]): (r["value"], r["status"]) for r in plugins.apply_feature_plugin(df, "rec", ["mean", "sd"], compute).collect()}
    assert got == {("a", "mean"): (2.0, "computed"), ("a", "sd"): (None, "missing"), ("b", "mean"): (None, "failed"), ("b", "sd"): (None, "failed")}
    assert df.groupBy("rec").agg(plugins.register_statistic(lambda v: float(len(v)))("x").alias("n")).where("rec = 'a'").first()["n"] == 2


def test_fusion_refuses_many_to_many(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="many to many"):
        early_fusion(a, a, ["k"])


def test_split_keeps_subjects_whole(spark):
    df = spark.createDataFrame([(i % 11, i) for i in range(50)] + [(None, 99)], "subject_id int, row int")
    got = group_split(df, "subject_id").groupBy("subject_id").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in got) and sum(r["s"] == "test" for r in got) == 3
    assert leakage_precheck(df) == "pass" and leakage_precheck(df.drop("subject_id")) == "missing_subject_column"
    assert problem_type(df, "row") == "regression" and problem_type(df, "nothing") == "unconfigured"


def test_gradient_of_a_parabola_with_uneven_steps(spark):
    t = [0.0, 0.5, 1.5, 2.0, 4.0]
    df = spark.createDataFrame([(1, k, x, 0.25 * x * x) for k, x in enumerate(t)], "r int, k int, t double, v double")
    got = [r["g"] for r in gradient(df, ["r"], "k", "v", "t", "g").orderBy("k").collect()]
    assert got[1:4] == pytest.approx([0.25, 0.75, 1.0])
    assert gradient(df.limit(2), ["r"], "k", "v", "t", "g").where("g IS NOT NULL").count() == 0


def test_only_run_of_silence_leads(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, None)], "r int, k int, f boolean")
    row = mask_to_segments(boolean_runs(df, ["r"], "k", "f"), ["r"], "f", 0.1).first()
    assert (row["segment_role"], row["segment_type"]) == ("leading", "nonspeech")


@pytest.mark.parametrize("name", ["qc", "level", "gap"])
def test_streams_equal_batch(spark, tmp_path, name):
    source = view(spark, SF, "events")
    rows = source.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_type") != "error").alias("ok"))
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    run = {"qc": lambda d: live.stream_frame_qc(d, "ts", "user_id", "value", "ok", "1 hour", "3650 days"), "level": lambda d: live.stream_rolling_level(d, "ts", "user_id", "value", "2 hours", "1 hour", "3650 days"), "gap": lambda d: live.stream_gap_sessions(d, "ts", "user_id", "1 hour", "3650 days")}[name]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = run(stream).writeStream.format("memory").queryName(f"t_{name}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    seen = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in d.collect())
    assert seen(spark.table(f"t_{name}")) == seen(run(rows))


def test_stream_dedupe_join_and_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01", "a", True), (2, "2024-01-01 00:00:02", "a", True), (1, "2024-01-01 00:00:03", "a", False), (3, "2024-01-01 00:00:04", "b", True)], "id long, t string, rec string, ok boolean").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    meta = spark.createDataFrame([("a", "site 1"), ("a", "again")], "rec string, site string")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")

    def run(name, df, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name).collect()

    assert sorted(r["id"] for r in run("t_dedupe", live.stream_dedupe(source(), "ts", ["id"]), "append")) == [1, 2, 3]
    assert [r["site"] for r in run("t_join", live.stream_metadata_join(source(), meta, ["rec"]).where("rec = 'b'"), "append")] == [None]
    assert len(spark.table("t_join").collect()) == 1


def test_runs_go_on_from_batch_to_batch_in_the_order_of_time():
    rows = [(t, t, t // 3 % 2 == 0) for t in range(20)]
    waiting, run, ended = [], None, []
    for part, upto in ((rows[10:15], 5.0), (rows[:8], 6.5), (rows[15:] + rows[8:10], 14.0)):
        waiting, run, more = live.next_runs(waiting + [list(r) for r in part], run, upto)
        ended += more
    waiting, run, more = live.next_runs(waiting, run, None)
    assert waiting == [] and [(r[0], r[1], r[2]) for r in [*ended, *more, run]] == [(t // 3 % 2 == 0, t, min(3, 20 - t)) for t in range(0, 20, 3)]


def test_run_state_in_a_stream_with_late_rows(spark, tmp_path):
    """Rows of a step that come with the next one are in place; what lies idle is given out, and the stream's end marker stays."""
    t = lambda s: f"2024-01-01 00:00:{s:02}"
    files = [[(1, "a", t(1), True), (3, "a", t(3), True)], [(2, "a", t(2), False), (4, "a", t(8), True), (5, "b", t(9), False)], [(6, "end", "2024-01-02 00:00:00", True)]]
    for rows in files:
        df = spark.createDataFrame(rows, "id long, rec string, t string, ok boolean").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    found = live.run_to_end(live.stream_run_state(stream, "rec", "ts", "ok", "id", "30 seconds", "5 minutes"), f"file://{tmp_path}/run").collect()
    assert sorted((r["recording"], r["flag"], r["length"]) for r in found) == [("a", False, 1), ("a", True, 1), ("a", True, 2), ("b", False, 1)]
