"""Media columns: bytes stored as WAV, short-time Fourier transforms, spectral-peak pair fingerprints.

A payload becomes a mono WAV of 8-bit samples, written and read by the wave module. Its spectrum is taken over frames of
FRAME samples each HOP samples. In each frame the strongest bin of each band is a peak if it is not weaker than the same
band's strongest bin in the frames beside it. Each peak is paired with the FAN peaks that follow it within REACH frames;
a pair is stored as its time and its code, frequency 1, frequency 2 and distance in 8 bits each: two arrays in time order.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.textkit import slices

RATE, FRAME, HOP, FAN, REACH, BLOCK = 8000, 256, 128, 3, 32, 64
#: First and end bins of the bands in which peaks are sought.
BANDS = ((1, 20), (20, 50), (50, 129))
WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """data with bytes 0 up to a positive multiple of block."""
    return data + b"\0" * (-len(data) % block or (0 if data else block))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum(payload: bytes, frames_each: int = 4096):
    """Blocks of magnitudes (frame, bin), rounded to three digits; the last frame is filled with silence (128)."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, n, frames_each):
        yield np.round(np.abs(np.fft.rfft(frames[at : at + frames_each] * WINDOW)), 3)


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and frequencies (bins) of the peaks, by time and then frequency."""
    best, where = [], []
    for block in spectrum(payload):
        at = np.stack([block[:, a:b].argmax(1) + a for a, b in BANDS], 1)
        where.append(at)
        best.append(np.take_along_axis(block, at, 1))
    strength, at = np.concatenate(best), np.concatenate(where)
    side = np.pad(strength, ((1, 1), (0, 0)), constant_values=-1.0)
    keep = (strength > 0) & (strength >= side[:-2]) & (strength >= side[2:])
    t, band = np.nonzero(keep)
    return t, at[t, band]


def pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint: times and codes of the peak pairs."""
    t, f = peaks(payload)
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        ok = gap <= REACH
        times.append(t[:-k][ok])
        codes.append((f[:-k][ok] << 16) | (f[k:][ok] << 8) | gap[ok])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as UTF-8, padded and made a WAV.

    Repeated rows give a row each, equal texts equal bytes; only doc_id and text are read; an empty table gives an empty result.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, texts in slices(batch, chars=4_000_000):
                raw = [t.encode() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(raw)), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def store(docs: DataFrame, out: str) -> DataFrame:
    """Writes encode()'s rows as a table of media columns and returns the table written."""
    rows = encode(docs)
    rows.write.parquet(out)
    return docs.sparkSession.read.schema(rows.schema).parquet(out)


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, times, codes of encode()'s rows, from the stored bytes.

    Each row is read by itself, so equal media have equal features, also of repeated rows; other columns are not read; an empty
    table gives an empty result. A payload without a peak pair has empty arrays.
    """

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "times", "codes"]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, rows = batch.slice(at, 256), []
                for m in part.column("media"):
                    stored = m.as_py()
                    payload = from_wav(stored)
                    t, c = pairs(payload)
                    rows.append((len(stored), hashlib.sha256(stored).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), t, c))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), *[pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)]], names=["doc_id", "n_bytes", *names]
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, times array<int>, codes array<int>",
    )
