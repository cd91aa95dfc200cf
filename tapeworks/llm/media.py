"""Media columns: bytes as WAV sound, short-time Fourier features, peak-pair fingerprints.

A payload is stored as the 8-bit mono samples of a WAV file and read back with the wave
module.  A short-time Fourier transform of the samples gives a spectrum for each time
step.  The strongest bin of each of a few bands is a peak if it stands out: above the
band's mean and above its neighbours in time, so silence and even noise floors have few.  Each peak
is paired with the next peaks, and a pair and its time make one number of an array.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, utf8

RATE, FRAME, HOP = 8000, 256, 128
#: Steps ahead, and peaks there, that a peak is paired with at most.
REACH, FAN = 12, 3
#: A peak has at least this many times the mean magnitude of its band.
STANDS_OUT = 1.5
#: Bins 1..128 of the spectrum in bands (fixed values).
BANDS = (1, 9, 17, 33, 65, 129)
_HANN = np.hanning(FRAME)


def padded(payload: bytes) -> bytes:
    """``payload`` and zero bytes up to a positive multiple of 64."""
    return payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")


def to_wav(payload: bytes) -> bytes:
    file = io.BytesIO()
    with wave.open(file, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(RATE)
        out.writeframes(payload)
    return file.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: bytes, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Time step and bin of each spectral peak, by time.

    Frames of ``FRAME`` samples start every ``HOP``; silence fills up the last one, so
    every sample is in a frame.  Spectra are taken ``block`` steps at a time, so memory for them does
    not grow with the length.
    """
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    best, strength, floor = (np.empty((n, len(BANDS) - 1), t) for t in (np.int64, np.float64, np.float64))
    for a in range(0, n, block):
        part = x[a * HOP : (a + block - 1) * HOP + FRAME].astype(np.float64) - 128
        size = min(block, n - a)
        part = np.pad(part, (0, (size - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.round(np.abs(np.fft.rfft(frames * _HANN, axis=1)), 3)  # ties go to the lower bin
        for j, (low, high) in enumerate(zip(BANDS[:-1], BANDS[1:], strict=True)):
            band = power[:, low:high]
            best[a : a + size, j], strength[a : a + size, j], floor[a : a + size, j] = band.argmax(axis=1) + low, band.max(axis=1), band.mean(axis=1)
    around = np.pad(strength, ((1, 1), (0, 0)), constant_values=-1)
    stands = (strength > STANDS_OUT * floor) & (strength >= around[:-2]) & (strength > around[2:])
    time, band = np.nonzero(stands)
    return time, best[time, band]


def peak_pairs(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs: time step << 20 | first bin << 12 | second bin << 4 | steps apart.

    A peak is paired with the next ``FAN`` later peaks that are up to ``REACH`` steps away.
    Where no peak has a partner, each stands alone (second bin and steps 0).
    """
    time, bins = peaks(samples)
    first = np.searchsorted(time, time, side="right")  # the first later peak
    codes = []
    for k in range(FAN):
        at = first + k
        near = np.flatnonzero(at < len(time))
        near = near[time[at[near]] - time[near] <= REACH]
        second = at[near]
        codes.append(time[near] << 20 | bins[near] << 12 | bins[second] << 4 | (time[second] - time[near]))
    found = np.concatenate(codes)
    return np.sort(found if len(found) else time << 20 | bins << 12).astype(np.int64)


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("pairs", pa.list_(pa.int64()))])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _features(media: bytes) -> tuple:
    payload = from_wav(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), peak_pairs(payload)


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the WAV file of each row's text in UTF-8 (null: empty)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            yield batch_of(_MEDIA, batch.column("doc_id"), [len(t) for t in texts], [to_wav(padded(t)) for t in texts])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(table: DataFrame, digest: bool = False) -> DataFrame:
    """Features of stored media (doc_id, n_bytes, media), from the bytes read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and pairs, the time-coded array; if ``digest``, feature in its place:
    how many pairs, and the sha-256 of the array.  Null and empty texts are 64 zero bytes;
    equal texts have equal values; a null doc_id stays null; no row is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _DIGESTS if digest else pa.schema([*list(_DIGESTS)[:2], *_FEATURES])
        for batch in batches:
            found = [_features(x) for x in batch.column("media").to_pylist()]
            columns = [list(x) for x in zip(*found, strict=True)] or [[] for _ in range(6)]
            if digest:
                columns[5] = [f"{len(p)}:{hashlib.sha256(p.astype('<i8').tobytes()).hexdigest()}" for p in columns[5]]
            yield batch_of(schema, batch.column("doc_id"), batch.column("n_bytes"), *columns)

    last = "feature string" if digest else "pairs array<long>"
    return table.mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, {last}")
