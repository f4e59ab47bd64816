"""Live frames: windowed quality, sliding levels, gap sessions, de-duplication, metadata and runs of a flag.

Each takes a streaming (or batch) DataFrame; on the same rows the results equal those of batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def stream_frame_qc(frames: DataFrame, ts: str, recording: str, value: str, detected: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Frames, the detected share and the level per recording and tumbling window."""
    windowed = frames.withWatermark(ts, late).groupBy(F.window(ts, every), recording)
    return windowed.agg(F.count("*").alias("n_frames"), F.avg(F.col(detected).cast("int")).alias("detected_fraction"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).select(recording, F.col("window.start").alias("start"), "n_frames", "detected_fraction", "mean", "sd")


def stream_rolling_level(frames: DataFrame, ts: str, recording: str, value: str, width: str = "1 minute", slide: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    windowed = frames.withWatermark(ts, late).groupBy(F.window(ts, width, slide), recording)
    return windowed.agg(F.avg(value).alias("level")).select(recording, F.col("window.start").alias("start"), "level")


def stream_gap_sessions(frames: DataFrame, ts: str, recording: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of frames without a pause of `gap`; rows later than the watermark are dropped."""
    return frames.withWatermark(ts, late).groupBy(F.session_window(ts, gap), recording).agg(F.count("*").alias("n_frames")).select(recording, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_frames")


def stream_dedupe(rows: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stream_metadata_join(rows: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(metadata.dropDuplicates(keys), keys, "left")


#: What a recording keeps between batches: rows that wait for the watermark, and the open run.
_STATE = "waiting string, flag boolean, start double, length long, last double"
_RUNS = "flag boolean, start double, length long"


def next_runs(waiting: list, run: tuple | None, upto: float | None) -> tuple[list, tuple | None, list]:
    """(still waiting, open run, ended runs) after the rows (at, tie, flag) that wait no longer, in the order of their times; upto None: all of them.

    A run is (flag, start, length, last).
    """
    ready = sorted(x for x in waiting if upto is None or x[0] <= upto)
    left, ended = [x for x in waiting if upto is not None and x[0] > upto], []
    for at, _, flag in ready:
        if run is not None and run[0] == flag:
            run = (flag, run[1], run[2] + 1, at)
        else:
            ended += [run] if run is not None else []
            run = (flag, at, 1, at)
    return left, run, ended


def stream_run_state(frames: DataFrame, recording: str, ts: str, flag: str, tie: str, late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """(recording, flag, start, length): every run of equal flags of a recording, when it has ended.

    Rows wait until the watermark has passed them and are then taken in the order of their times (and of `tie`, a number),
    whatever batch brought them; rows later than that are dropped. A run that the watermark leaves behind by `idle` has
    ended, too, and then nothing is kept of the recording: state is bounded by what `late` lets wait. start is in seconds.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = frames.select(F.col(recording).alias("recording"), F.col(ts).alias("ts"), F.col(flag).alias("flag"), F.col(tie).cast("double").alias("tie")).withWatermark("ts", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, run = [], None
        if state.exists:
            kept = state.get
            waiting, run = json.loads(kept[0]), None if kept[1] is None else tuple(kept[1:])
        if state.hasTimedOut:
            waiting, run, ended = next_runs(waiting, run, None)
            ended += [run] if run is not None else []
            state.remove()
        else:
            for rows in batches:
                at = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
                waiting += [[a, t, bool(f)] for a, t, f in zip(at.tolist(), rows["tie"].tolist(), rows["flag"].tolist(), strict=True)]
            watermark = state.getCurrentWatermarkMs()
            waiting, run, ended = next_runs(waiting, run, watermark / 1000)
            state.update((json.dumps(waiting), *(run or (None, None, None, None))))
            last = max([x[0] for x in waiting] + ([run[3]] if run else []), default=watermark / 1000)
            state.setTimeoutTimestamp(max(int(last * 1000) + idle_ms, watermark + 1))
        if ended:
            yield pd.DataFrame({"recording": key[0], "flag": [r[0] for r in ended], "start": [r[1] for r in ended], "length": [r[2] for r in ended]})

    kind = dict(rows.dtypes)["recording"]
    return rows.groupBy("recording").applyInPandasWithState(step, f"recording {kind}, {_RUNS}", _STATE, "append", "EventTimeTimeout")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream has written to files once all its input is read; a run that broke off goes on from its checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
