"""Media columns: 8-bit WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm._batches import small_batches


RATE, FRAME, HOP, PEAKS, FAN_OUT, REACH = 8000, 512, 256, 2, 2, 6
_WINDOW = np.hanning(FRAME).astype(np.float32)
_FRAMES_AT_ONCE = 4096

SCHEMA = "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, media binary, n_frames int, landmarks array<bigint>"


def to_wav(payload: bytes) -> bytes:
    """payload as the samples of a mono WAV file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("a mono WAV file of 8-bit samples is expected")
        return f.readframes(f.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, bin) of the PEAKS strongest local maxima of each frame's spectrum, in time order, and the number of frames; every sample lies in a frame."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    # zeros up to FRAME and a whole number of HOPs, so that the last samples lie in a frame too
    x = np.concatenate([x, np.zeros(FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, len(frames), _FRAMES_AT_ONCE):
        block = frames[at : at + _FRAMES_AT_ONCE]
        power = np.abs(np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * _WINDOW, axis=1))
        inner = power[:, 1:-1]
        tops = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-3), inner, 0)
        best = np.sort(np.argpartition(-tops, PEAKS, axis=1)[:, :PEAKS], axis=1)
        t, k = np.nonzero(np.take_along_axis(tops, best, axis=1))
        times.append(t + at)
        bins.append(best[t, k] + 1)
    return np.concatenate(times), np.concatenate(bins), len(frames)


def landmarks(times: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Each peak paired with the FAN_OUT next ones that start 1 to REACH frames later; time << 32 | bin << 19 | bin << 6 | distance."""
    after = np.searchsorted(times, times, "right")
    out = []
    for k in range(FAN_OUT):
        to = after + k
        ok = to < len(times)
        i, j = np.flatnonzero(ok), to[ok]
        near = times[j] - times[i] <= REACH
        i, j = i[near], j[near]
        out.append(times[i].astype(np.int64) << 32 | bins[i].astype(np.int64) << 19 | bins[j].astype(np.int64) << 6 | (times[j] - times[i]))
    return np.sort(np.concatenate(out))


def fingerprint_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each text as a WAV file, read the samples back and fingerprint them.

    The payload is the text's UTF-8 bytes (none for NULL) with zero bytes appended up to a positive multiple of 64.
    Returns `id` and the columns of SCHEMA, `media` only with keep_media. One row per input row: repeated rows give
    equal rows, NULL ids stay NULL, an empty table gives an empty one, further columns of docs are not read. Every
    value depends on the text alone. landmarks is empty where a spectrum has no peak (e.g. silence).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for text in batch.column(1):
                raw = text.as_py() or b""
                media = to_wav(raw + bytes(-len(raw) % 64 or 64 * (not raw)))
                back = from_wav(media)
                times, bins, n = spectral_peaks(back)
                got = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), media, n, landmarks(times, bins))
                for c, v in zip(every[1:], got, strict=True):
                    if c in out:
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], kinds[c]) for c in names[1:])], names=names)

    every = [x.split()[0] for x in SCHEMA.split(", ")]
    names = [c for c in every if keep_media or c != "media"]
    kinds = dict(zip(every, [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64())], strict=True))
    schema = ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in names)
    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{text_col}` AS BINARY) AS text").mapInArrow(rows, schema)


def op2_media_fingerprints(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fingerprint_media(docs, keep_media=False).selectExpr(
        "id AS doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "concat_ws(':', n_frames, size(landmarks), lower(hex(crc32(CAST(concat_ws(',', CAST(landmarks AS ARRAY<STRING>)) AS BINARY))))) AS feature",
        "landmarks",
    )
