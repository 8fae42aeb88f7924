"""The columns a player draws of a track: a height, and the balance of three bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Crossovers in hertz, columns of the whole-track previews, and columns a second of the detail view.
CROSSOVERS = (200.0, 2000.0, 10_000.0)
PREVIEW, MONO_PREVIEW, DETAIL_RATE = 1200, 400, 150
_BLOCK = 64
#: Samples that the filters run over at once.
_STRETCH = 1 << 17


def _decayed_sums(u: np.ndarray, b: float, before: float = 0.0) -> np.ndarray:
    """s[i] = u[i] + b * s[i - 1] with s[-1] = before: blocks by one triangular product, then the blocks' ends by the
    same rule."""
    count = -(-len(u) // _BLOCK)
    blocks = np.zeros((count, _BLOCK))
    blocks.ravel()[: len(u)] = u
    blocks[0, 0] += b * before
    age = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
    out = blocks @ np.where(age >= 0, b ** np.maximum(age, 0.0), 0.0).T
    if count > 1:
        ends = _decayed_sums(out[:-1, -1], b**_BLOCK)
        out[1:] += ends[:, None] * b ** np.arange(1, _BLOCK + 1.0)
    return out.ravel()[: len(u)]


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(np.uint8)


def render(samples: np.ndarray, rate: int, columns: int) -> np.ndarray:
    """(columns, 4) of height 0-31 and low, mid, high 0-7; see renders."""
    return renders(samples, rate, (columns,))[0]


def renders(samples: np.ndarray, rate: int, counts: tuple[int, ...]) -> list[np.ndarray]:
    """(columns, 4) of height 0-31 and low, mid, high 0-7, for several numbers of columns in one pass.

    Heights are peaks against the 99th percentile of the peaks that are not 0, so one stray transient does not
    flatten the rest. Bands are energies between one-pole low-passes, against the column's loudest band. The filters
    run over _STRETCH samples at a time, so beside a track only a few of those are in memory.
    """
    n, counts = len(samples), [max(1, c) for c in counts]
    found = [(np.zeros(c, np.float32), np.zeros((3, c))) for c in counts]
    firsts = [-(-np.arange(c, dtype=np.int64) * n // c) for c in counts]  # a column's first sample
    states = [0.0] * len(CROSSOVERS)
    for at in range(0, n, _STRETCH):
        raw = samples[at : at + _STRETCH]
        x, below, bands = raw.astype(np.float64), 0.0, []
        for i, hz in enumerate(CROSSOVERS):
            keep = float(np.exp(-2 * np.pi * hz / rate))
            passed = _decayed_sums(x * (1 - keep), keep, states[i])
            states[i] = passed[-1]
            bands.append((passed - below) ** 2)
            below = passed
        bands[2] += (x - below) ** 2
        loud = np.abs(raw)
        for (peaks, energy), first, c in zip(found, firsts, counts, strict=True):
            own = np.arange(at * c // n, (at + len(raw) - 1) * c // n + 1)
            starts = np.maximum(first[own] - at, 0)
            some = np.diff(np.r_[starts, len(raw)]) > 0  # more columns than samples leave some without any
            own, starts = own[some], starts[some]
            peaks[own] = np.maximum(peaks[own], np.maximum.reduceat(loud, starts))
            for band, values in zip(energy, bands, strict=True):
                band[own] += np.add.reduceat(values, starts)
    out = []
    for peaks, energy in found:
        loud = np.sort(peaks[peaks > 0])
        top = np.float32(max(1e-6, loud[min(len(loud) * 99 // 100, len(loud) - 1)] if len(loud) else 1.0))
        most = energy.max(axis=0, keepdims=True)
        levels = np.divide(energy, most, out=np.zeros_like(energy), where=most > 0).T
        out.append(np.concatenate([_half_up(np.clip(peaks / top, 0, 1) * 31)[:, None], _half_up(np.clip(levels, 0, 1) * 7)], axis=1))
    return out


def pack(columns: np.ndarray) -> bytes:
    """Two bytes a column from the low bit up: 5 bits of height, then 3 each of low, mid and high."""
    height, low, mid, high = np.minimum(columns, (31, 7, 7, 7)).astype(np.uint16).T
    return (height | low << 5 | mid << 8 | high << 11).astype("<u2").tobytes()


def heights(peaks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., col, height) of rows (by..., col, peak): peaks against the 99th percentile (a nearest rank) of those that
    are not 0, as 0 to 31."""
    from pyspark.sql import Window as W

    ordered = F.array_sort(F.collect_list(F.when(F.col("peak") > 0, F.col("peak"))).over(W.partitionBy(*by)))
    place = F.least(F.floor(F.size("ordered_") * 99 / 100), F.size("ordered_") - 1).cast("int")
    top = F.coalesce(F.get("ordered_", place), F.lit(1.0))
    share = F.least(F.greatest(F.col("peak") / top, F.lit(0.0)), F.lit(1.0))
    return peaks.withColumn("ordered_", ordered).select(*by, "col", F.round(share * 31).cast("int").alias("height"))


def waveforms(tracks: DataFrame, columns: int | None = None) -> DataFrame:
    """(path, columns_per_second, columns): packed columns of every track of read_wav; `columns` of them, or
    DETAIL_RATE a second. Tracks without samples have none. One track is in memory at a time."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, rate, samples = (batch.column(c)[i] for c in ("path", "sample_rate", "samples"))
                per_second, packed = None, None
                if samples.is_valid and len(samples.values):
                    x = samples.values.to_numpy(zero_copy_only=False).astype(np.float32)
                    seconds = len(x) / rate.as_py()
                    count = max(1, int(seconds * DETAIL_RATE + 0.5) if columns is None else columns)
                    per_second = float(DETAIL_RATE) if columns is None else count / seconds
                    packed = pack(render(x, rate.as_py(), count))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([per_second], pa.float64()), pa.array([packed], pa.binary())], names=["path", "columns_per_second", "columns"])

    return tracks.select("path", "sample_rate", "samples").mapInArrow(drawn, "path string, columns_per_second double, columns binary")


def unpacked(columns: Column) -> Column:
    """Packed columns as an array of struct<height, low, mid, high>; empty for no columns."""

    def one(i: Column) -> Column:
        byte = lambda at: F.conv(F.hex(F.substring(columns, i * 2 + at, F.lit(1))), 16, 10).cast("int")
        value = byte(1) + byte(2) * 256
        return F.struct(value.bitwiseAND(31).alias("height"), *[F.shiftright(value, shift).bitwiseAND(7).alias(name) for name, shift in (("low", 5), ("mid", 8), ("high", 11))])

    places = F.when(F.length(columns) >= 2, F.sequence(F.lit(0), F.floor(F.length(columns) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, one)


def shade(mid: Column, high: Column) -> Column:
    """The brightness of a monochrome column: the top of its spectrum."""
    return F.greatest(high, mid - 2, F.lit(0))


def resampled(columns: Column, count: int) -> Column:
    """An array of unpacked columns as `count` of them, keeping peaks: of each stretch the highest, the last on ties."""

    def best(c: Column) -> Column:
        first = F.floor(c * F.size(columns) / count).cast("int")
        end = F.greatest(F.floor((c + 1) * F.size(columns) / count).cast("int"), first + 1)
        ranked = F.transform(F.slice(columns, first + 1, end - first), lambda x, i: F.struct(x["height"].alias("height"), i.alias("i"), x.alias("x")))
        none = F.struct(*[F.lit(0).alias(name) for name in ("height", "low", "mid", "high")])
        return F.coalesce(F.array_max(ranked)["x"], none)

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), best)
