"""Short-time spectra of tracks, reduced to band energies and chroma as they are made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .spectrum import log_band_edges


def frames(samples: np.ndarray, window: int = 2048, hop: int = 512, step: int = 4096) -> Iterator[np.ndarray]:
    """Blocks of magnitude spectra under a periodic Hann window, scaled so that a sine's peak is its amplitude; no padding."""
    if len(samples) < window:
        return
    hann = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)).astype(np.float32)
    views = np.lib.stride_tricks.sliding_window_view(samples, window)[::hop]
    for at in range(0, len(views), step):
        yield (np.abs(np.fft.rfft(views[at : at + step] * hann, axis=1)) * (2 / hann.sum())).astype(np.float32)


def band_frames(tracks: DataFrame, bands: int = 8, low: float = 30.0, high: float = 16000.0, window: int = 2048, hop: int = 512) -> DataFrame:
    """(path, frame, energies): mean magnitude of each log band in every frame of every track.

    Spectra never leave the worker; one track is in memory at a time, in blocks of frames.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rate, samples = batch.column("sample_rate")[i].as_py(), batch.column("samples")[i]
                if not samples.is_valid:
                    continue
                path, at = batch.column("path")[i].as_py(), 0
                edges = log_band_edges(bands, low, high, rate, window)
                for block in frames(samples.values.to_numpy(zero_copy_only=False), window, hop):
                    means = np.stack([block[:, a:b].mean(axis=1) for _, _, _, a, b in edges], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(block)), pa.array(np.arange(at, at + len(block), dtype=np.int32)), pa.array(list(means), pa.list_(pa.float32()))], names=["path", "frame", "energies"])
                    at += len(block)

    return tracks.select("path", "sample_rate", "samples").mapInArrow(reduced, "path string, frame int, energies array<float>")
