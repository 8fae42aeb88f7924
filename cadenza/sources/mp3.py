"""Frames of MP3 files and the seek tables that players want of them."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# How many points a table has; kilobits a second by code, and hertz by code, of each version; samples a frame.
POINTS = 400
KBPS = {
    3: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {3: 1152, 2: 576, 0: 576}


def frame_at(data: bytes, at: int) -> tuple[int, int] | None:
    """(bytes, samples) of the layer III frame whose header stands at `at`, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] < 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, data[at + 1] >> 1 & 3
    code, rate, padding = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if version == 1 or layer != 1 or not 0 < code < 15 or rate == 3:
        return None
    samples = SAMPLES[version]
    size = samples // 8 * KBPS[3 if version == 3 else 2][code] * 1000 // RATES[version][rate] + padding
    return size, samples


def tag_bytes(data: bytes) -> int:
    """How many bytes an ID3 tag takes at the file's start."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    size = sum((b & 127) << 7 * (3 - i) for i, b in enumerate(data[6:10]))
    return min(len(data), 10 + size + (10 if data[5] & 16 else 0))


def audio_frames(data: bytes) -> list[tuple[int, int]]:
    """(place, samples) of the file's whole frames but for a leading one that describes the file; bytes that are no
    frame are passed over one by one."""
    at, found = tag_bytes(data), []
    while at + 4 <= len(data):
        frame = frame_at(data, at)
        if frame and at + frame[0] <= len(data):
            found.append((at, *frame))
            at += frame[0]
        else:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                break
    if len(found) > 1:
        place, size, _ = found[0]
        head = data[place : place + min(size, 51)]
        if b"Xing" in head or b"Info" in head:
            found = found[1:]
    return [(place, samples) for place, _, samples in found]


def seek_table(data: bytes) -> list[int] | None:
    """POINTS byte offsets from the first frame, of the first frames that begin at or after the middles of as many equal
    stretches (else of the last frame), and the number of samples; None for a file without frames."""
    frames = audio_frames(data)
    if not frames:
        return None
    starts = np.concatenate([[0], np.cumsum([s for _, s in frames])]).tolist()
    total, base = starts.pop(), frames[0][0]
    if total >= 1 << 32:
        return None
    return [frames[min(bisect_left(starts, (2 * i + 1) * total // (2 * POINTS)), len(frames) - 1)][0] - base for i in range(POINTS)] + [total]


def with_seek_tables(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `seek_table`: the words of seek_table, null for content that is null or has no frames."""
    place = files.columns.index(content)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data = one.column(place)[0].as_py()
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([seek_table(data) if data else None], pa.list_(pa.int64()))], names=[*one.schema.names, "seek_table"])

    from pyspark.sql import types as T

    return files.mapInArrow(rows, T.StructType(list(files.schema.fields)).add("seek_table", T.ArrayType(T.LongType())))
