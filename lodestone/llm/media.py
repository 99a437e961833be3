"""Media columns: WAV bytes in a column, short-time Fourier transforms and spectral-peak pair fingerprints.

A recording is stored as 8-bit mono WAV and read by the wave module. Overlapping Hann-windowed frames are
transformed; in each frequency band a frame's largest magnitude is a peak if no neighbouring frame exceeds it there.
Each peak is paired with the next few; a pair is coded as (bin, later bin, frames between) and stored in an array
beside the array of its times, so that a shift in time moves the times and leaves the codes.

Defined results. A null or empty text is a payload of 64 zero bytes. Silence and constant signals have no peaks and
empty arrays. Transforms run over blocks of frames, so a long recording needs memory for its samples and one block.
WAV allows under 4 GiB of samples; a longer payload raises. A null media value gives null arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow import map_slices, text_bytes
from .workspace import documents

BLOCK, RATE = 64, 8000
FRAME, HOP = 256, 128
#: First bins of the frequency bands; bin 0 is the mean and left out.
BANDS = np.array([1, 12, 32, 64, 96])
PARTNERS, MOST_APART = 3, 63
#: Peaks below this share of the signal's largest magnitude are rounding noise.
FLOOR = 1e-4
FRAMES_AT_ONCE = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: bytes) -> bytes:
    """The text, padded with bytes 0 to a positive multiple of BLOCK."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def to_wav(samples: bytes) -> bytes:
    """8-bit mono WAV of the samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as file:
        if file.getnchannels() != 1 or file.getsampwidth() != 1:
            raise ValueError("not 8-bit mono")
        return file.readframes(file.getnframes())


def magnitudes(samples: bytes) -> np.ndarray:
    """Of each frame (row) and bin; the last frame is filled up with silence."""
    signal = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    count = 1 + max(0, -(-(len(signal) - FRAME) // HOP))
    signal = np.pad(signal, (0, FRAME + HOP * (count - 1) - len(signal)))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    parts = [np.abs(np.fft.rfft(frames[i : i + FRAMES_AT_ONCE] * _WINDOW, axis=1)).astype(np.float32) for i in range(0, count, FRAMES_AT_ONCE)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def peaks(spectrum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and bins of the spectral peaks, by time and then by bin."""
    high = np.maximum.reduceat(spectrum[:, : BANDS[-1] + 32], BANDS, axis=1)
    edges = np.r_[BANDS, BANDS[-1] + 32]
    at = np.stack([a + spectrum[:, a:b].argmax(axis=1) for a, b in zip(edges[:-1], edges[1:])], axis=1)
    fits = high > FLOOR * max(float(spectrum.max(initial=0)), 1.0)
    fits[1:] &= high[1:] >= high[:-1]
    fits[:-1] &= high[:-1] > high[1:]
    times, bands = np.nonzero(fits)
    return times, at[times, bands]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of the peak pairs, by time."""
    times, bins = peaks(magnitudes(samples))
    found = []
    for k in range(1, PARTNERS + 1):
        apart = times[k:] - times[:-k]
        near = apart <= MOST_APART
        code = bins[:-k] << 14 | bins[k:] << 6 | apart
        found.append(np.stack([times[:-k][near], code[near]], axis=1))
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].astype(np.int32)
    return pairs[:, 0], pairs[:, 1]


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as WAV."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = text_bytes(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "media": [to_wav(payload_of(t)) for t in texts]}

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def fingerprint_media(stored: DataFrame) -> DataFrame:
    """(doc_id, times, codes) of a media column."""

    def run(batch: pa.RecordBatch) -> dict:
        made = [None if x is None else fingerprint(from_wav(x)) for x in batch.column("media").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "times": [m and m[0] for m in made], "codes": [m and m[1] for m in made]}

    return map_slices(stored.select("doc_id", "media"), run, "doc_id long, times array<int>, codes array<int>")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads each stored recording back; feature: counts and a digest of the time-coded arrays."""

    def run(batch: pa.RecordBatch) -> dict:
        media = batch.column("media").to_pylist()
        read = [from_wav(x) for x in media]
        features = []
        for samples in read:
            times, codes = fingerprint(samples)
            digest = hashlib.blake2b(times.tobytes() + codes.tobytes(), digest_size=16).hexdigest()
            features.append(f"pairs={len(codes)};span={int(times[-1]) + 1 if len(times) else 0};digest={digest}")
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "payload_bytes": [len(x) for x in read],
            "payload_sha256": [hashlib.sha256(x).hexdigest() for x in read],
            "tail_crc32": [zlib.crc32(x[-BLOCK:]) for x in read],
            "media_bytes": [len(x) for x in media],
            "media_sha256": [hashlib.sha256(x).hexdigest() for x in media],
            "feature": features,
        }

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_slices(store_media(documents(spark, sf_dir)), run, schema)
