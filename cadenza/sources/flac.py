"""A FLAC decoder in numpy that advances many frames in step."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: its fixed predictors, and sample rates and depths by code in a frame's header.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Bytes of frames that are decoded at once.
GROUP_BYTES = 1 << 20


class FlacError(ValueError):
    """A stream that breaks the format or fails a checksum."""


@functools.cache
def crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x & top else 0)) & mask
        out.append(x)
    return np.array(out, np.uint32)


@functools.cache
def _crc8_list() -> list[int]:
    return crc_table(8, 0x07).tolist()


def crc8(data: bytes) -> int:
    table, crc = _crc8_list(), 0
    for x in data:
        crc = table[crc ^ x]
    return crc


@functools.cache
def _crc16_steps(size: int) -> np.ndarray:
    """Row d: what each byte value adds to the checksum if d bytes follow it (the checksum is linear)."""
    table = crc_table(16, 0x8005)
    out = np.empty((size, 256), np.uint16)
    row = table
    for d in range(size):
        out[d] = row
        row = (row << 8 ^ table[row >> 8]) & 0xFFFF
    return out


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksums of the byte ranges of data; all are nonempty and ascending."""
    lengths = ends - starts
    steps = _crc16_steps(1 << int(max(2048, lengths.max()) - 1).bit_length())
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    return np.bitwise_xor.reduceat(steps[np.repeat(lengths, lengths) - 1 - within, data[at]], first)


@dataclass(frozen=True)
class Info:
    """What a stream's first block says, its seek points (sample, byte, samples) and where its frames begin."""

    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: tuple
    at: int


def stream_info(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, last, first, points = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("the stream ends in its headers")
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        own = data[at + 4 : at + 4 + n]
        if kind == 0 and n >= 34:
            packed = int.from_bytes(own[10:18], "big")
            first = (int.from_bytes(own[:2], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, own[18:34])
        elif kind == 3:
            points = [(int.from_bytes(own[i : i + 8], "big"), int.from_bytes(own[i + 8 : i + 16], "big"), int.from_bytes(own[i + 16 : i + 18], "big")) for i in range(0, n - 17, 18)]
        at += 4 + n
    if first is None:
        raise FlacError("no stream information")
    return Info(*first, tuple(points), at)


def frame_header(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(samples, channel code, depth code, bytes) of the frame header at `at`, or None if none stands there."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] not in (0xF8, 0xF9):
        return None
    code, rate, lead = data[at + 2] >> 4, data[at + 2] & 15, data[at + 4]
    p = at + 5 + (0 if lead < 0x80 else next((i + 1 for i in range(5) if not lead << (i + 2) & 0x80), 6))
    if code in (6, 7):
        size, p = int.from_bytes(data[p : p + code - 5], "big") + 1, p + code - 5
    else:
        size = {0: 0, 1: 192}.get(code) if code < 2 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    return size, data[at + 3] >> 4, data[at + 3] >> 1 & 7, p + 1 - at


def frame_starts(data: bytes, info: Info) -> list[int]:
    """Where the stream's frames begin: by the seek table if it has them all, else by sync codes and both checksums."""
    real = [p for p in info.points if p[0] != 2**64 - 1]
    if real and sum(p[2] for p in real) == info.samples:
        return [info.at + p[1] for p in real]
    starts, view = [info.at], np.frombuffer(data, np.uint8)
    while starts[-1] < len(data):
        nxt = starts[-1]
        while True:
            nxt = data.find(b"\xff", nxt + 1)
            if nxt < 0:
                return starts
            if nxt - starts[-1] > 8 and frame_header(data, nxt):
                a, b = starts[-1], nxt
                if int(crc16(view, np.array([a]), np.array([b - 2]))[0]) == int.from_bytes(data[b - 2 : b], "big"):
                    break
        starts.append(nxt)
    return starts


def _signed(v: int, n: int) -> int:
    return v - (1 << n) if n and v >> (n - 1) else v


def _subframes(joined: bytes, window: np.ndarray, p: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pcm [sample, frame], bit positions behind) of one subframe of each frame, which begin at bit positions p.

    Frames come with falling size and advance in step, one sample at a time: a 64-bit window at each frame's position
    gives the unary part by its leading zeros and the Rice remainder behind it, and the linear predictor adds to it
    from the samples before.
    """
    count, longest = len(size), int(size[0])
    pcm = np.zeros((longest, count), np.int64)
    order, shift, porder, wide, rice, wasted = (np.zeros(count, np.int64) for _ in range(6))
    coefs = np.zeros((32, count), np.int64)
    p, live = p.copy(), np.ones(count, bool)
    for i in range(count):
        bits, at, skip = int(depth[i]), int(p[i]) >> 3, int(p[i]) & 7
        some = joined[at : at + 240]
        value, left = int.from_bytes(some, "big"), len(some) * 8 - skip
        whole = left

        def take(n: int) -> int:
            nonlocal left
            left -= n
            return value >> left & (1 << n) - 1

        kind = take(8)
        if kind & 1:  # the samples' low bits that are all 0, counted in unary, aren't in the subframe
            wasted[i] = 1
            while wasted[i] < bits and not take(1):
                wasted[i] += 1
            bits -= int(wasted[i])
            if bits < 1:
                raise FlacError("no bits are left of the samples")
        kind >>= 1
        if kind == 0:
            pcm[: size[i], i], live[i] = _signed(take(bits), bits), False
        elif kind == 1:
            start = int(p[i]) + whole - left
            end = start + int(size[i]) * bits
            raw = int.from_bytes(joined[start >> 3 : (end + 7) >> 3], "big") >> (-end % 8)
            pcm[: size[i], i] = [_signed(raw >> bits * j & (1 << bits) - 1, bits) for j in range(int(size[i]) - 1, -1, -1)]
            live[i], left = False, left - int(size[i]) * bits
        elif kind >= 32 or 8 <= kind <= 12:
            order[i] = o = kind - 31 if kind >= 32 else kind - 8
            if o > size[i]:
                raise FlacError("a predictor longer than its block")
            for j in range(o):
                pcm[j, i] = _signed(take(bits), bits)
            if kind >= 32:
                precision = take(4) + 1
                shift[i] = take(5)
                for j in range(o):
                    coefs[j, i] = _signed(take(precision), precision)
            else:
                coefs[:o, i] = FIXED[o]
            wide[i] = 4 + take(2)
            porder[i] = take(4)
        else:
            raise FlacError("reserved subframe")
        p[i] += whole - left
    part = size >> porder
    following = order.copy()
    depths = int(order.max())
    actives = np.searchsorted(-size, -np.arange(longest), side="left")  # frames with more than j samples come first
    escaped = np.zeros(count, np.int64) - 1
    settled = bool(live.all())
    one, low = np.uint64(1), np.uint64(63)
    for j in range(longest):
        m = int(actives[j])
        turn = np.flatnonzero((following[:m] == j) & live[:m])
        if len(turn):
            width = wide[turn]
            peek = window[p[turn] >> 3] << (p[turn] & 7).astype(np.uint64)
            got = (peek >> (64 - width).astype(np.uint64)).astype(np.int64)
            p[turn] += width
            rice[turn] = got
            raw = got == (1 << width) - 1
            escaped[turn] = -1
            if raw.any():
                which = turn[raw]
                peek = window[p[which] >> 3] << (p[which] & 7).astype(np.uint64)
                escaped[which] = (peek >> np.uint64(59)).astype(np.int64)
                p[which] += 5
                rice[which] = 0
            following[turn] = (j // part[turn] + 1) * part[turn]
        if j < depths or not settled or (escaped[:m] >= 0).any():
            sel = np.flatnonzero(live[:m] & (order[:m] <= j))
            if not len(sel):
                continue
        else:
            sel = slice(0, m)
        q_at = p[sel]
        k = rice[sel]
        peek = window[q_at >> 3] << (q_at & 7).astype(np.uint64)
        zeros = 53 - np.frexp((peek >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        if int(zeros.max()) + max(2, int(k.max())) > 54:  # 53: no end of the unary part in the window
            zeros, rest = _long_codes(window, q_at, k, zeros, peek)
        else:
            rest = ((peek << (zeros + 1).astype(np.uint64)) >> one) >> (low - k.astype(np.uint64))
        u = zeros << k | rest.astype(np.int64)
        used = zeros + 1 + k
        residual = (u >> 1) ^ -(u & 1)
        if (esc := escaped[sel] >= 0).any():
            for t in np.flatnonzero(esc).tolist():
                n, at = int(escaped[sel][t]), int(q_at[t])
                v = int.from_bytes(joined[at >> 3 : (at >> 3) + 8], "big") >> (64 - n - (at & 7)) & (1 << n) - 1 if n else 0
                residual[t], used[t] = _signed(v, n), n
        p[sel] = q_at + used
        total = np.zeros(len(residual), np.int64)
        for i in range(min(j, depths)):
            total += coefs[i, sel] * pcm[j - 1 - i, sel]
        pcm[j, sel] = residual + (total >> shift[sel])
    if wasted.any():
        pcm <<= wasted
    return pcm, p


def _long_codes(window, at, k, zeros, peek):
    """Unary parts and remainders where a code may be longer than one window."""
    zeros, start = zeros.copy(), at.copy()
    for t in np.flatnonzero(peek >> np.uint64(11) == 0).tolist():
        n, place = 0, int(at[t])
        while True:
            if place >> 3 >= len(window):
                raise FlacError("the stream ends in a code")
            w = int(window[place >> 3]) << (place & 7) & (2**64 - 1)
            w >>= 16
            if w:
                n += 48 - w.bit_length()
                break
            n, place = n + 48, place + 48
        zeros[t] = n
    after = start + zeros + 1
    again = window[after >> 3] << (after & 7).astype(np.uint64)
    return zeros, (again >> np.uint64(1)) >> (np.uint64(63) - k.astype(np.uint64))


def _group(parts: list[bytes], heads: list[tuple[int, int, int, int]], depths: list[int]) -> list[np.ndarray]:
    """The PCM [channel, sample] of each frame; the frames have the same number of channels."""
    joined = b"".join(parts) + bytes(16)
    buf = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    begin = ends - [len(x) for x in parts]
    if (crc16(buf, begin, ends - 2) != (buf[ends - 2].astype(np.uint16) << 8 | buf[ends - 1])).any():
        raise FlacError("bad frame CRC-16")
    window = np.zeros(len(buf) - 8, np.uint64)
    for j in range(8):
        window |= buf[j : j + len(window)].astype(np.uint64) << np.uint64(56 - 8 * j)
    size, code = np.array([h[0] for h in heads]), np.array([h[1] for h in heads])
    rank = np.argsort(-size, kind="stable")
    size, code, depth = size[rank], code[rank], np.array(depths)[rank]
    p = ((begin + [h[3] for h in heads]) * 8)[rank]
    channels = 2 if code[0] > 7 else int(code[0]) + 1
    found = []
    for c in range(channels):
        side = (code == 9) if c == 0 else (code == 8) | (code == 10)
        pcm, p = _subframes(joined, window, p, size, depth + side)
        found.append(pcm)
    out: list[np.ndarray] = [np.empty(0)] * len(heads)
    for i, place in enumerate(rank.tolist()):
        block = np.stack([x[: size[i], i] for x in found])
        if code[i] == 8:
            block[1] = block[0] - block[1]
        elif code[i] == 9:
            block[0] += block[1]
        elif code[i] == 10:
            mid = (block[0] << 1) | (block[1] & 1)
            block = np.stack([(mid + block[1]) >> 1, (mid - block[1]) >> 1])
        out[place] = block
    return out


def _stored(x: np.ndarray, bits: int) -> bytes:
    """PCM [channel, sample] as the checksum reads it: interleaved, in whole bytes, the low one first."""
    if bits <= 16:
        return x.T.astype(np.int8 if bits <= 8 else "<i2").tobytes()
    wide = np.ascontiguousarray(x.T.astype("<i4")).view(np.uint8).reshape(-1, 4)
    return (wide if bits > 24 else np.ascontiguousarray(wide[:, :3])).tobytes()


def decode(streams: list[bytes]) -> Iterator[tuple[Info, list[int], list[np.ndarray]]]:
    """(information, first sample of each block, PCM [channel, sample] of each block) of every stream.

    Frames of all streams that have the same number of channels are decoded together, about GROUP_BYTES at once.
    Frame header CRC-8, frame CRC-16, the number of samples and the stream's MD5 are verified; damage raises FlacError.
    """
    infos, starts, frames = [stream_info(s) for s in streams], [], []
    for n, (data, info) in enumerate(zip(streams, infos, strict=True)):
        starts.append(frame_starts(data, info))
        for a, b in zip(starts[-1], [*starts[-1][1:], len(data)], strict=True):
            head = frame_header(data, a)
            if head is None:
                if info.samples == 0:
                    continue
                raise FlacError("bad frame header or CRC-8")
            if head[1] > 10:
                raise FlacError("reserved channels")
            frames.append((n, a, b, head))
    blocks: list[list[np.ndarray]] = [[] for _ in streams]
    at = 0
    while at < len(frames):
        first, total, channels = at, 0, lambda h: 2 if h[1] > 7 else h[1] + 1
        while at < len(frames) and (at == first or total + frames[at][2] - frames[at][1] <= GROUP_BYTES) and channels(frames[at][3]) == channels(frames[first][3]):
            total += frames[at][2] - frames[at][1]
            at += 1
        own = frames[first:at]
        pcm = _group([streams[n][a:b] for n, a, b, _ in own], [h for *_, h in own], [DEPTHS.get(h[2], infos[n].bits) for n, _, _, h in own])
        for (n, *_), block in zip(own, pcm, strict=True):
            blocks[n].append(block)
    for info, own in zip(infos, blocks, strict=True):
        offsets = np.concatenate([[0], np.cumsum([x.shape[1] for x in own])]).astype(np.int64).tolist()
        if info.samples and offsets[-1] != info.samples:
            raise FlacError("samples are missing")
        if info.md5 != bytes(16):
            digest = hashlib.md5()
            for x in own:
                digest.update(_stored(x, info.bits))
            if digest.digest() != info.md5:
                raise FlacError("bad MD5 of the samples")
        yield info, offsets[:-1], own
