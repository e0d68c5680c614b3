"""Texts as sound: 8-bit WAV by the wave module, short-time Fourier transforms, spectral-peak pairs.

A payload (the text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576) becomes the
samples of a mono 8-bit WAV file of 8000 Hz. The file is read back, and from the samples read the
spectrogram (Hann windows of 576 samples, a frame each 288), its peaks (in each of four frequency
bands the strongest bin of a frame, kept where it exceeds its neighbours in time and the mean of
the band), and pairs of an anchor peak with the next FAN peaks within REACH frames. A pair is the 64-bit code
time << 24 | f1 << 15 | f2 << 6 | dt, kept as an array in order of time.

Frames are transformed BLOCK at a time, so memory is bounded by the text, not by its spectrogram.
Null text is empty: its payload is 576 bytes of 255. Null and repeated ids are rows like others; equal texts have equal
values; of bins of equal strength in a band the lowest is the peak, of equal frames the first; very long texts are
one file, whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

UNIT, RATE, FRAME, HOP, FAN, REACH, BLOCK = 576, 8000, 576, 288, 3, 16, 2048
BANDS = ((4, 24), (24, 72), (72, 144), (144, 288))
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and frequencies (bins) of the spectral peaks, by time, then frequency."""
    x = np.frombuffer(samples, np.uint8)
    n = (len(x) - FRAME) // HOP + 1
    tops, bins, means = [], [], []
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, n, BLOCK):
        spectrum = np.abs(np.fft.rfft((frames[at : at + BLOCK].astype(np.float32) - 128) * _WINDOW, axis=1))
        best = np.stack([spectrum[:, a:b].argmax(1) + a for a, b in BANDS], 1)
        tops.append(np.take_along_axis(spectrum, best, 1))
        bins.append(best)
        means.append(np.stack([spectrum[:, a:b].mean(1) for a, b in BANDS], 1))
    top, best, mean = np.concatenate(tops), np.concatenate(bins), np.concatenate(means)
    edge = np.full((1, len(BANDS)), -1, top.dtype)
    before, after = np.concatenate([edge, top[:-1]]), np.concatenate([top[1:], edge])
    t, band = np.nonzero((top > mean) & (top >= before) & (top > after) & (top > 1e-6))
    return t, best[t, band]


def fingerprint(samples: bytes) -> np.ndarray:
    """Codes of the peak pairs, in order of time."""
    t, f = peaks(samples)
    found = []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k]
        near = (dt <= REACH) & (dt >= 0)
        found.append(((t[:-k] << 24) | (f[:-k] << 15) | (f[k:] << 6) | dt)[near])
    return np.sort(np.concatenate(found)).astype(np.int64)


FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), (
        "fingerprint", pa.list_(pa.int64())
    ),
])
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>"


def described(doc_id: int | None, text: str | None) -> dict:
    n, payload = payload_of(text)
    media = to_wav(payload)
    back = from_wav(media)
    codes = fingerprint(back)
    return {
        "doc_id": doc_id, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"pairs={len(codes)};sha256={hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()}", "fingerprint": codes,
    }


def _batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_pylist(
                [described(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)],
                FIELDS
            )


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")
    ).mapInArrow(common.tidied(_batches), SCHEMA)


def op4(spark, sf_dir: str) -> DataFrame:
    return media_column(common.table(spark, sf_dir, "documents"))
