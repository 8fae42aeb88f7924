"""A track's three analysis files for players: paths, seek tables, beat grids, cues, phrases and waveforms."""

from __future__ import annotations

import struct

import numpy as np

from cadenza.operators.waveform import PREVIEW

from .entities import MASK, PHRASES

# Fixed values of the format: columns of the previews, the mood of phrases, bytes of a phrase, words of a seek table.
MONO_COLUMNS, TINY_COLUMNS, COLOUR_COLUMNS, MOOD, PHRASE_BYTES, SEEK_WORDS = 400, 100, PREVIEW, 1, 24, 401


def _section(kind: bytes, header: int, body: bytes) -> bytes:
    return kind + struct.pack(">II", header, 12 + len(body)) + body


def _file(*sections: bytes) -> bytes:
    body = b"".join(sections)
    return b"PMAI" + struct.pack(">6I", 0x1C, 0x1C + len(body), 1, 0x10000, 0x10000, 0) + body


def _wide(text: str) -> bytes:
    return (text + "\0").encode("utf-16-be")


def path_section(path: str) -> bytes:
    text = _wide(path)
    return _section(b"PPTH", 0x10, struct.pack(">I", len(text)) + text)


def seek_section(words: list[int] | None) -> bytes:
    padded = ([*(words or [])] + [0] * SEEK_WORDS)[:SEEK_WORDS]
    return _section(b"PVBR", 0x10, struct.pack(f">{SEEK_WORDS + 1}I", 0, *padded))


def _half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def micros(beat: dict) -> int:
    return max(0, _half_up(beat["time_seconds"] * 1_000_000))


def _beat(beat: dict) -> bytes:
    return struct.pack(">HHI", beat["number_in_bar"], min(65535, max(0, _half_up(beat["bpm"] * 100))), micros(beat) // 1000)


def grid_section(beats: list[dict]) -> bytes:
    return _section(b"PQTZ", 0x18, struct.pack(">3I", 0, 0x80000, len(beats)) + b"".join(map(_beat, beats)))


def fine_grid_section(beats: list[dict]) -> bytes:
    """The first and last beat, and what whole milliseconds leave of each beat's time."""
    ends = _beat(beats[0]) + _beat(beats[-1]) if beats else bytes(16)
    head = struct.pack(">IBBHI", 0, 1, 0, 2, 0) + ends + struct.pack(">4I", len(beats), 0, 0, 0)
    return _section(b"PQT2", 0x38, head + b"".join(struct.pack(">H", micros(b) % 1000) for b in beats))


def _milliseconds(cue: dict) -> int:
    return max(0, _half_up(cue["time_seconds"] * 1000))


def cue_section(cues: list[dict], kind: str) -> bytes:
    own, hot = [c for c in cues if c["kind"] == kind], kind == "hot"
    body = struct.pack(">IHHI", int(hot), 0, len(own), 0xFFFFFFFF)
    for n, cue in enumerate(own):
        entry = struct.pack(">3IHHBBHII16x", cue["number"] if hot else 0, 0, 0x100000, 0xFFFF if n == 0 else n - 1, n + 1, 1, 0, 1000, _milliseconds(cue), 0xFFFFFFFF)
        body += _section(b"PCPT", 0x1C, entry)
    return _section(b"PCOB", 0x18, body)


def named_cue_section(cues: list[dict], kind: str) -> bytes:
    """Cues with their comments."""
    own, hot = [c for c in cues if c["kind"] == kind], kind == "hot"
    body = struct.pack(">IHH", int(hot), len(own), 0)
    for cue in own:
        text = _wide(cue["comment"]) if cue["comment"] else b""
        entry = struct.pack(">IBBHIIBBHIHH", cue["number"] if hot else 0, 1, 0, 1000, _milliseconds(cue), 0, 0, 1, 0, 0, 0, 0)
        body += _section(b"PCP2", 0x10, entry + struct.pack(">I", len(text)) + text + bytes(24))
    return _section(b"PCO2", 0x14, body)


def _beat_number(beats: list[dict], seconds: float) -> int:
    if not beats:
        return 1
    return min(65535, int(np.abs(np.array([b["time_seconds"] for b in beats]) - seconds).argmin()) + 1)


def phrase_section(sections: list[dict], beats: list[dict]) -> bytes:
    """Sections as phrases, the whole list masked by bytes that depend on its length."""
    body = struct.pack(">HIHHHBB", MOOD, 0, 0, _beat_number(beats, sections[-1]["end_seconds"]) if sections else 0, 0, 0, 0)
    for n, s in enumerate(sections, 1):
        body += struct.pack(">3H18x", n, _beat_number(beats, s["start_seconds"]), PHRASES[s["label"]])
    raw = np.frombuffer(body, np.uint8)
    mask = (np.resize(np.array(MASK), len(raw)) + len(sections)).astype(np.uint8)
    return _section(b"PSSI", 0x20, struct.pack(">IH", PHRASE_BYTES, len(sections)) + (raw ^ mask).tobytes())


def unpacked(columns: bytes) -> np.ndarray:
    """[column, (height, low, mid, high)] of packed display columns."""
    x = np.frombuffer(columns[: len(columns) // 2 * 2], "<u2").astype(np.int64)
    return np.stack([x & 31, x >> 5 & 7, x >> 8 & 7, x >> 11 & 7], axis=1)


def resampled(columns: np.ndarray, count: int) -> np.ndarray:
    """`count` columns, each the highest of its stretch, the last one on ties."""
    n = len(columns)
    if not n:
        return np.zeros((count, 4), np.int64)
    first = np.arange(count) * n // count
    end = np.maximum((np.arange(count) + 1) * n // count, first + 1)
    rank = columns[:, 0] * n + np.arange(n)
    return columns[[int(a + rank[a:b].argmax()) for a, b in zip(first.tolist(), end.tolist(), strict=True)]]


def _mono(columns: np.ndarray) -> bytes:
    """A byte of height and shade each."""
    shade = np.maximum(np.maximum(columns[:, 3], columns[:, 2] - 2), 0)
    return (columns[:, 0] | shade << 5).astype(np.uint8).tobytes()


def _levels(columns: np.ndarray) -> np.ndarray:
    """Low, mid and high of 0 to 127, scaled by height."""
    return np.floor(columns[:, 1:] / 7 * (columns[:, :1] / 31) * 127 + 0.5).astype(np.uint8)


def _wave(kind: bytes, header: int, *numbers: int, data: bytes) -> bytes:
    return _section(kind, header, struct.pack(f">{len(numbers)}I", *numbers) + data)


def dat(t: dict) -> bytes:
    preview = unpacked(t["preview"])
    mono, tiny = _mono(resampled(preview, MONO_COLUMNS)), (resampled(preview, TINY_COLUMNS)[:, 0] // 2).astype(np.uint8).tobytes()
    return _file(
        path_section(t["device_path"]), seek_section(t.get("seek_table")), grid_section(t["beats"]),
        _wave(b"PWAV", 0x14, len(mono), 0x10000, data=mono), _wave(b"PWV2", 0x14, len(tiny), 0x10000, data=tiny),
        cue_section(t["cues"], "hot"), cue_section(t["cues"], "memory"),
    )


def ext(t: dict) -> bytes:
    detail, preview = unpacked(t["detail"]), resampled(unpacked(t["preview"]), COLOUR_COLUMNS)
    colour = (detail[:, 1] << 13 | detail[:, 2] << 10 | detail[:, 3] << 7 | detail[:, 0] << 2).astype(">u2").tobytes()
    height, levels = np.floor(preview[:, 0] / 31 * 127 + 0.5).astype(np.uint8), _levels(preview)
    six = np.stack([height, 255 - height, levels.max(axis=1), *levels.T], axis=1).tobytes()
    return _file(
        path_section(t["device_path"]), _wave(b"PWV3", 0x18, 1, len(detail), 0x960000, data=_mono(detail)),
        cue_section(t["cues"], "hot"), cue_section(t["cues"], "memory"), named_cue_section(t["cues"], "hot"), named_cue_section(t["cues"], "memory"),
        fine_grid_section(t["beats"]), _wave(b"PWV5", 0x18, 2, len(detail), 0x960305, data=colour), _wave(b"PWV4", 0x18, 6, len(preview), 0, data=six),
        phrase_section(t["sections"], t["beats"]),
    )


def two_ex(t: dict) -> bytes:
    detail, preview = _levels(unpacked(t["detail"])), _levels(resampled(unpacked(t["preview"]), COLOUR_COLUMNS))
    loudest = detail.max(axis=0) if len(detail) else np.zeros(3, np.uint8)
    return _file(
        path_section(t["device_path"]), _wave(b"PWV7", 0x18, 3, len(detail), 0x960000, data=detail.tobytes()),
        _wave(b"PWV6", 0x14, 3, len(preview), data=preview.tobytes()), _section(b"PWVC", 0x0E, struct.pack(">4H", 0, *loudest.tolist())),
    )
