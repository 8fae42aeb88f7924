"""Tuning and pitch classes of tracks, from the peaks of their spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stft import frames

# Ranges in hertz, the reference pitch, frames that tuning looks at, and how far off a note may be.
TUNING_RANGE, CHROMA_RANGE = (100.0, 4000.0), (55.0, 3000.0)
A4, TUNING_FRAMES, FARTHEST = 440.0, 2000, 0.33


def _peaks(block: np.ndarray, rate: int, window: int, low: float, high: float, clamp: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, hertz, magnitude) of the strict local maxima between two frequencies, placed by a parabola."""
    width = rate / window
    first, end = max(1, int(np.ceil(low / width))), min(int(high // width), block.shape[1] - 2)
    if end <= first:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.float32)
    left, here, right = (block[:, first + d : end + d] for d in (-1, 0, 1))
    frame, at = np.nonzero((here > left) & (here > right))
    a, b, c = (x[frame, at] for x in (left, here, right))
    curve = a - 2 * b + c
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = np.float32(0.5) * (a - c) / curve
    if clamp:
        shift = np.where(np.abs(curve) > np.finfo(np.float32).eps, np.clip(shift, -0.5, 0.5), np.float32(0))
    return frame, (at + first + shift.astype(np.float64)) * width, b


def _nearest(x: np.ndarray) -> np.ndarray:
    """Rounded with halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def tuning_histogram(block: np.ndarray, rate: int, window: int) -> np.ndarray:
    """Peak magnitudes by whole cents off the nearest semitone, from -50 on."""
    _, hz, weight = _peaks(block, rate, window, *TUNING_RANGE, clamp=False)
    hz, weight = hz[hz > 0], weight[hz > 0]
    semitones = 12 * np.log2(hz / A4)
    bucket = np.clip(np.floor((semitones - _nearest(semitones)) * 100 + 50).astype(np.int64), 0, 99)
    return np.bincount(bucket, weight, 100).astype(np.float64)  # numpy counts nothing in integers


def tuning_cents(histogram: np.ndarray) -> float:
    """The last fullest bucket, refined by its neighbours around the circle; 0 for an empty histogram."""
    if histogram.sum() <= 0:
        return 0.0
    mode = 99 - int(np.argmax(histogram[::-1]))
    near = np.arange(mode - 1, mode + 2)
    weights = histogram[near % 100]
    return float(weights @ near / weights.sum() - 49.5)


def pitch_classes(block: np.ndarray, rate: int, window: int, cents: float) -> np.ndarray:
    """The sum over a block's frames of their peak energies by pitch class from C, each frame's scaled to 1."""
    frame, hz, weight = _peaks(block, rate, window, *CHROMA_RANGE, clamp=True)
    semitones = 12 * np.log2(hz / (A4 * 2 ** (cents / 1200)))
    note = _nearest(semitones)
    good = np.abs(semitones - note) <= FARTHEST
    cell = frame[good] * 12 + ((note[good].astype(np.int64) + 9) % 12)
    energy = np.bincount(cell, weight[good].astype(np.float64) ** 2, len(block) * 12).astype(np.float64).reshape(-1, 12)
    total = energy.sum(axis=1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 0).sum(axis=0)


def track_chroma(tracks: DataFrame, window: int = 2048, hop: int = 512, cents: float | None = None) -> DataFrame:
    """(path, tuning_cents, chroma, spectrum) of every track of read_wav that has samples.

    chroma has 12 shares from C (all 0 without notes); spectrum is the mean magnitude of each bin. Tuning is measured
    on at most about 2 * TUNING_FRAMES evenly spaced frames unless `cents` gives it; the fold and the mean take all. Spectra
    stay in the worker: 12 numbers and one spectrum a track leave it.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, rate, samples = (batch.column(c)[i].as_py() if c != "samples" else batch.column(c)[i] for c in ("path", "sample_rate", "samples"))
                if not samples.is_valid or len(samples.values) < window:
                    continue
                x = samples.values.to_numpy(zero_copy_only=False).astype(np.float32)
                count = (len(x) - window) // hop + 1
                tuning = cents
                if tuning is None:
                    every = max(1, count // TUNING_FRAMES)
                    tuning = tuning_cents(sum(tuning_histogram(block, rate, window) for block in frames(x, window, hop * every)))
                chroma, spectrum = np.zeros(12), np.zeros(window // 2 + 1)
                for block in frames(x, window, hop):
                    chroma += pitch_classes(block, rate, window, tuning)
                    spectrum += block.sum(axis=0, dtype=np.float64)
                chroma /= max(chroma.sum(), np.finfo(np.float64).tiny)
                doubles = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([float(tuning)]), pa.array([chroma], doubles), pa.array([spectrum / count], doubles)], names=["path", "tuning_cents", "chroma", "spectrum"])

    return tracks.select("path", "sample_rate", "samples").mapInArrow(folded, "path string, tuning_cents double, chroma array<double>, spectrum array<double>")
