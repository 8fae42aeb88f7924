"""A FLAC encoder in numpy that works on many frames in step, and media columns of it and of the decoder."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.sources import flac as codec
from cadenza.sources.flac import FlacError
from cadenza.sources.flac import crc8 as _crc8
from cadenza.sources.flac import crc16 as _crc16

from .common import as_bytes, chunks, lean, picked, stash

BLOCK = 1024
_ORDER, _PRECISION, _SHIFT = 4, 12, 10
_CHUNK = 1 << 20
#: Frames that are encoded at once.
_FRAMES = 1024


def _coded_number(n: int) -> bytes:
    """The format's UTF-8 like code of a frame or sample number of up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


def _lpc(samples: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients [frame, order] from the autocorrelation's normal equations."""
    x = samples.astype(np.float64)
    lags = np.stack([np.einsum("ij,ij->i", x[:, i:], x[:, : x.shape[1] - i]) for i in range(_ORDER + 1)], 1)
    index = np.abs(np.arange(_ORDER)[:, None] - np.arange(_ORDER)[None, :])
    matrix = lags[:, index] + np.eye(_ORDER) * (lags[:, :1, None] * 1e-6 + 1)
    solved = np.linalg.solve(matrix, lags[:, 1:, None])[:, :, 0]
    limit = 1 << (_PRECISION - 1)
    return np.clip(np.rint(solved * (1 << _SHIFT)), -limit, limit - 1).astype(np.int32)


def _placed(at: np.ndarray, value: np.ndarray, width: np.ndarray, size: int) -> np.ndarray:
    """`size` bytes with each value's `width` (up to 17) bits from bit `at` on; no two overlap, so sums are unions."""
    first = at >> 3
    value = value.astype(np.int64) << (24 - width - (at & 7))
    total = sum(np.bincount(first + j, value >> (16 - 8 * j) & 255, size + 2) for j in range(3))
    return total[:size].astype(np.uint8)


def encode(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """A complete FLAC stream (8 bits, mono, blocks of 1024, a seek point a frame) of each nonempty payload.

    Frames are encoded _FRAMES at once, so a very long payload takes no more memory than its bytes and those.
    """
    lengths = [len(p) for p in payloads]
    per = [-(-n // BLOCK) for n in lengths]
    sizes = np.concatenate([[BLOCK] * (k - 1) + [n - BLOCK * (k - 1)] for n, k in zip(lengths, per, strict=True)]).astype(np.int64)
    raw = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.arange(len(sizes)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    parts = [_frames(raw[starts[i] : starts[min(len(sizes), i + _FRAMES)]], sizes[i : i + _FRAMES], numbers[i : i + _FRAMES]) for i in range(0, len(sizes), _FRAMES)]
    data, frame_bytes = (np.concatenate(x) for x in zip(*parts, strict=True))
    frame_at = np.concatenate([[0], np.cumsum(frame_bytes)])
    out, i = [], 0
    for n, frames in zip(lengths, per, strict=True):
        own = slice(i, i + frames)
        info = min(BLOCK, n).to_bytes(2, "big") * 2 + int(frame_bytes[own].min()).to_bytes(3, "big") + int(frame_bytes[own].max()).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(raw[starts[i] : starts[i + frames]].tobytes()).digest()
        points = np.zeros(frames, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
        points["sample"], points["offset"], points["size"] = np.arange(frames) * BLOCK, frame_at[own] - frame_at[i], sizes[own]
        # a table's length has 24 bits: streams of more frames than fit have a point every few frames
        every = -(-frames // 900_000)
        table = points[::every].tobytes()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + data[frame_at[i] : frame_at[i + frames]].tobytes())
        i += frames
    return out


def _frames(raw: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all frames in a row, bytes of each) of consecutive blocks of the samples `raw`."""
    count = len(sizes)
    mask = np.arange(BLOCK)[None, :] < sizes[:, None]
    x = np.zeros((count, BLOCK), np.int32)
    x[mask] = raw
    coefs = _lpc(x)
    tries = [x]
    for _ in range(2):
        tries.append(np.diff(tries[-1], axis=1, prepend=0))
    pred = np.zeros((count, BLOCK), np.int32)
    for i in range(_ORDER):
        pred[:, i + 1 :] += coefs[:, i : i + 1] * x[:, : BLOCK - i - 1]
    pred >>= _SHIFT
    tries.append(x - pred)
    orders = np.array([0, 1, 2, _ORDER])
    cost = np.stack([np.abs(t).sum(1) + o * 16 + (120 if k == 3 else 0) for k, (t, o) in enumerate(zip(tries, orders, strict=True))])
    kind = cost.argmin(0)
    residual = tries[0].copy()
    for j in (1, 2, 3):
        residual[kind == j] = tries[j][kind == j]
    order = orders[kind]
    coded = mask & (np.arange(BLOCK)[None, :] >= order[:, None])
    u = ((residual << 1) ^ (residual >> 31)) * coded
    # full blocks have 4 Rice partitions, others one
    parts = np.where(sizes == BLOCK, 4, 1)
    quarter = BLOCK // 4
    sums, held = u.reshape(count, 4, quarter).sum(2), coded.reshape(count, 4, quarter).sum(2)
    whole = parts == 1
    sums[whole], held[whole] = sums[whole].sum(1, keepdims=True), held[whole].sum(1, keepdims=True)
    k = np.clip(np.floor(np.log2(np.maximum(sums / np.maximum(held, 1) * 0.69, 1))), 0, 14).astype(np.int32)
    k_each = np.repeat(k, quarter, axis=1)
    bits = ((u >> k_each) + 1 + k_each) * coded
    heads, head_bits = [], np.empty(count, np.int64)
    param_at = np.zeros((count, 4), np.int64)  # bits of Rice parameters before each partition's codes
    for i in range(count):
        size, o = int(sizes[i]), int(order[i])
        head = bytes([0xFF, 0xF8, (0xA4 if size == BLOCK else 0x74), 0x02]) + _coded_number(int(numbers[i]))
        head += b"" if size == BLOCK else (size - 1).to_bytes(2, "big")
        head += bytes([_crc8(head)])
        value, n = (0x20 | o - 1 if kind[i] == 3 else 0x08 | o) << 1, 8
        for s in x[i, :o].tolist():
            value, n = value << 8 | s & 0xFF, n + 8
        if kind[i] == 3:
            value, n = value << 9 | (_PRECISION - 1) << 5 | _SHIFT, n + 9
            for c in coefs[i].tolist():
                value, n = value << _PRECISION | c & ((1 << _PRECISION) - 1), n + _PRECISION
        value, n = value << 6 | (2 if size == BLOCK else 0), n + 6
        heads.append(head + (value << (-n % 8)).to_bytes((n + 7) // 8, "big"))
        head_bits[i] = len(head) * 8 + n
    param_at[:] = 4 * np.arange(1, 5)
    param_at[whole] = 4
    body = bits.sum(1) + 4 * parts
    frame_bytes = (head_bits + body + 7) // 8 + 2
    frame_at = np.concatenate([[0], np.cumsum(frame_bytes)])
    before = np.cumsum(bits, axis=1) - bits
    codes_at = frame_at[:-1] * 8 + head_bits
    at = codes_at[:, None] + before + np.repeat(param_at, quarter, axis=1)
    part_at = codes_at[:, None] + before[:, ::quarter] + param_at - 4
    used = np.arange(4)[None, :] < parts[:, None]
    at, u, k_each = at[coded], u[coded], k_each[coded]
    at += u >> k_each
    tail = (1 << k_each) | (u & ((1 << k_each) - 1))
    data = _placed(np.concatenate([at, part_at[used]]), np.concatenate([tail, k[used]]), np.concatenate([k_each + 1, np.full(int(used.sum()), 4, np.int32)]), int(frame_at[-1]))
    for i, head in enumerate(heads):
        own = np.frombuffer(head, np.uint8)
        a = int(frame_at[i])
        full = int(head_bits[i]) // 8
        data[a : a + full] = own[:full]
        if full < len(own):
            data[a + full] |= own[full]
    crc = _crc16(data, frame_at[:-1], frame_at[1:] - 2)
    data[frame_at[1:] - 2], data[frame_at[1:] - 1] = crc >> 8, crc & 0xFF
    return data, frame_bytes


def decode(streams: list[bytes]) -> list[tuple[list[int], list[np.ndarray]]]:
    """(first sample of each block, PCM of each block) of mono streams of up to 16 bits; raises FlacError on damage
    and on other streams."""
    out = []
    for info, offsets, blocks in codec.decode(streams):
        if info.channels != 1 or info.bits > 16:
            raise FlacError("not a mono stream of up to 16 bits")
        out.append((offsets, [x[0].astype(np.int8 if info.bits <= 8 else np.dtype("<i2")) for x in blocks]))
    return out


def payload_of(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def encode_flac(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text's padded UTF-8 bytes as 8-bit samples of one FLAC stream.

    Null text is empty: 64 zero samples. Every row gives one row; equal texts give equal media.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in chunks([len(t) + 64 for t in texts], _CHUNK):
                media = encode([payload_of(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    rows = picked(df, key=key, text=text)
    return rows.mapInArrow(lean(encoded), rows.select("key").schema.add("n_bytes", "long").add("media", "binary"))


def decode_flac(df: DataFrame, media: str = "media") -> DataFrame:
    """df with `blocks`: the stream's PCM blocks as (sample_offset, samples, pcm), seekable by sample_offset.

    pcm is signed, one byte a sample up to 8 bits and two (little-endian) up to 16. Null media: no blocks.
    A damaged stream fails the job with FlacError. Other columns pass through.
    """
    block = pa.struct([("sample_offset", pa.int64()), ("samples", pa.int32()), ("pcm", pa.binary())])
    place = df.columns.index(media)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            for a, b in chunks([len(x.as_buffer() or b"") if x.is_valid else 0 for x in column], _CHUNK):
                streams = column.slice(a, b - a).to_pylist()
                found = iter(decode([s for s in streams if s is not None]))
                ends, offsets, sizes, raw = [0], [], [], []
                for s in streams:
                    own, blocks = next(found) if s is not None else ([], [])
                    offsets += own
                    sizes += [len(x) for x in blocks]
                    raw += [x.tobytes() for x in blocks]
                    ends.append(len(offsets))
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(offsets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], fields=list(block)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, rows], names=[*part.schema.names, "blocks"])

    schema = T.StructType(list(df.schema.fields)).add("blocks", T.ArrayType(T.StructType().add("sample_offset", "long").add("samples", T.IntegerType()).add("pcm", "binary")))
    return df.mapInArrow(lean(decoded), schema)


def pcm_blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media_bytes, media_sha256, blocks) of every row of df, written: each text's stream of
    encode_flac, decoded again, as PCM blocks that are seekable by sample_offset.

    Null text is empty: 64 zero samples. Every row gives one row, repeated ones and null keys too; no rows give none.
    """
    stored = decode_flac(encode_flac(df, key, text))
    return stash(stored.select("key", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "blocks"))


def media_digests(df: DataFrame) -> DataFrame:
    """The digests of pcm_blocks' rows: what their stored blocks hold, in the order of their offsets, and what it sounds
    like. Blocks are read one after the other: besides a row's blocks only one is in memory."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blocks in batch.column("blocks"):
                found = blocks.values
                offsets, own = found.field("sample_offset").to_numpy(), found.field("pcm")
                sha, tail, total, peak, level, power, crossings, last, at = hashlib.sha256(), b"", 0, 0, 0, 0, 0, None, 0
                for i in np.argsort(offsets, kind="stable").tolist():
                    samples = np.frombuffer(own[i].as_buffer(), np.int8)
                    if offsets[i] != at:
                        raise FlacError("a block is missing")
                    payload = (samples.view(np.uint8) ^ 0x80).tobytes()
                    sha.update(payload)
                    tail = (tail + payload)[-64:]
                    wide = samples.astype(np.int64)
                    peak, level, power = max(peak, int(np.abs(wide).max())), level + int(wide.sum()), power + int(wide @ wide)
                    below = np.concatenate([[wide[0] < 0 if last is None else last], wide < 0])
                    crossings, last, at = crossings + int((below[1:] != below[:-1]).sum()), below[-1], at + len(wide)
                feature = f"blocks={len(offsets)} peak={peak} mean={level / at:.4f} rms={np.sqrt(power / at):.4f} crossings={crossings}"
                rows.append((at, sha.hexdigest(), zlib.crc32(tail), feature))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
            a, b, c, d = (pa.array([r[i] for r in rows], t) for i, t in enumerate(types))
            columns = [batch.column("key"), batch.column("n_bytes"), a, b, c, batch.column("media_bytes"), batch.column("media_sha256"), d]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = df.select("key", "n_bytes").schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    return df.select("key", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(lean(digested), schema)
