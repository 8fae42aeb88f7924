"""Audio files as rows of samples, cuts of them, and synthetic tracks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac

SCHEMA = "path string, sample_rate int, channels int, samples array<float>, error string"


class AudioError(ValueError):
    """A file that can't be read as audio."""


def pcm(body: bytes, code: int, bits: int, big: bool = False) -> np.ndarray:
    """Interleaved samples in [-1, 1) of integer (code 1) or float (code 3) PCM."""
    order = ">" if big else "<"
    if code == 3 and bits in (32, 64):
        return np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"{order}f{bits // 8}").astype(np.float32)
    if code == 1 and bits == 8:
        return np.frombuffer(body, np.int8) / np.float32(128) if big else (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    if code == 1 and bits in (16, 32):
        return (np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"{order}i{bits // 8}") / np.float64(1 << (bits - 1))).astype(np.float32)
    if code == 1 and bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        raw = raw[:, ::-1] if big else raw
        return ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / np.float32(1 << 23)
    raise AudioError(f"format {code} of {bits} bits")


def mono(x: np.ndarray, channels: int) -> np.ndarray:
    """The mean of the channels; samples that don't fill a frame are left out."""
    if channels < 1:
        raise AudioError("no channels")
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1, dtype=np.float32).astype(np.float32)
    if not len(x):
        raise AudioError("empty")
    return x


def _chunks(data: bytes, at: int, order: str) -> Iterator[tuple[bytes, int, int]]:
    """(name, place, size) of a container's chunks, padded to even sizes; sizes end with the data."""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(order + "I", data, at + 4)[0]
        yield name, at + 8, min(size, len(data) - at - 8)
        at += 8 + size + size % 2


def decode_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, mono samples in [-1, 1]) of a RIFF file with integer or float PCM."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise AudioError("not a WAV file")
    kind, body = None, None
    for name, at, size in _chunks(data, 12, "<"):
        if name == b"fmt " and size >= 16:
            kind = struct.unpack_from("<HHIIHH", data, at)
            if kind[0] == 0xFFFE and size >= 26:
                kind = (struct.unpack_from("<H", data, at + 24)[0], *kind[1:])
        elif name == b"data" and body is None:
            body = data[at : at + size]
    if kind is None or not body:
        raise AudioError("empty")
    return kind[2], kind[1], mono(pcm(body, kind[0], kind[5]), kind[1])


def _extended(x: bytes) -> float:
    """An 80-bit float."""
    exponent, mantissa = struct.unpack(">HQ", x)
    return float(mantissa) * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def decode_aiff(data: bytes) -> tuple[int, int, np.ndarray]:
    """As decode_wav, of an AIFF or AIFC file with PCM that isn't compressed."""
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise AudioError("not an AIFF file")
    kind, body, code = None, None, b"NONE"
    for name, at, size in _chunks(data, 12, ">"):
        if name == b"COMM" and size >= 18:
            kind = (*struct.unpack_from(">hIh", data, at), _extended(data[at + 8 : at + 18]))
            code = data[at + 18 : at + 22] if size >= 22 else b"NONE"
        elif name == b"SSND" and size >= 8:
            body = data[at + 8 + struct.unpack_from(">I", data, at)[0] : at + size]
    if kind is None or not body:
        raise AudioError("empty")
    channels, _, bits, rate = kind
    if code not in (b"NONE", b"twos", b"sowt", b"fl32", b"FL32", b"fl64", b"FL64"):
        raise AudioError(f"compressed AIFC ({code.decode('latin-1')})")
    return int(rate + 0.5), channels, mono(pcm(body, 3 if code.lower()[:2] == b"fl" else 1, (bits + 7) // 8 * 8, big=code != b"sowt"), channels)


def decode_flac(data: bytes) -> tuple[int, int, np.ndarray]:
    """As decode_wav, of a FLAC stream."""
    try:
        info, _, blocks = next(flac.decode([data]))
    except flac.FlacError as error:
        raise AudioError(str(error)) from error
    if not blocks:
        raise AudioError("empty")
    scale = np.float64(1 << (info.bits - 1))
    return info.rate, info.channels, np.concatenate([(x / scale).astype(np.float32).mean(axis=0, dtype=np.float32) for x in blocks])


def decode(name: str, data: bytes) -> tuple[int, int, np.ndarray]:
    """Decodes a file by its name's extension. There is no MP3 decoder here: AudioError."""
    ext = name.rsplit(".", 1)[-1].lower()
    known = {"wav": decode_wav, "aiff": decode_aiff, "aif": decode_aiff, "flac": decode_flac}
    if ext not in known:
        raise AudioError("MP3 needs a decoder that is not installed" if ext == "mp3" else f"no audio format .{ext}")
    return known[ext](data)


def encode_wav(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """16-bit PCM; samples [frame] or [frame, channel]."""
    return wav_file(np.clip(np.rint(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes(), rate, channels, 16)


def wav_file(body: bytes, rate: int, channels: int, bits: int) -> bytes:
    """A file of the body behind a plain 44-byte header."""
    width = channels * ((bits + 7) // 8)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * width, width, bits) + b"data" + struct.pack("<I", len(body)) + body


def trim_wav(data: bytes, seconds: float) -> bytes:
    """The file without its first seconds, sample for sample, behind a new header; data that is shorter than it says
    is taken as it is."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise AudioError("not a WAV file")
    kind = None
    for name, at, size in _chunks(data, 12, "<"):
        if name == b"fmt " and size >= 16:
            _, channels, rate, _, _, bits = kind = struct.unpack_from("<HHIIHH", data, at)
        elif name == b"data":
            if kind is None or not channels or not rate or not bits:
                raise AudioError("the data come before the format")
            skip = int(max(seconds, 0.0) * rate + 0.5) * channels * ((bits + 7) // 8)
            return wav_file(data[at + min(skip, size) : at + size], rate, channels, bits)
    raise AudioError("not a WAV file")


def audio_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("wav",), contents: bool = True) -> DataFrame:
    """(path, file_name, length[, content]) of the folder's own files (not below it) with the extensions, in any case,
    by path. A file's bytes are one value, so a file may have 2 GB."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -1)
    return files.select("path", name.alias("file_name"), "length", *["content"] * contents).orderBy("path")


def read_audio(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("wav", "aiff", "aif", "flac")) -> DataFrame:
    """One row an audio file of the folder, of SCHEMA; a file that can't be read has its reason in `error`."""
    return decoded(audio_files(spark, folder, extensions).select("path", "content"))


def decoded(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of SCHEMA from rows with a file's name and bytes, such as an archive's entries; one track a batch (Spark bounds
    the bytes of the batches that come in)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    if data is None:
                        raise AudioError("no content")
                    rate, channels, x = decode(name or "", data)
                    row = [[name], [rate], [channels], [x], [None]]
                except (ValueError, struct.error) as error:
                    row = [[name], [None], [None], [None], [str(error)]]
                types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["path", "sample_rate", "channels", "samples", "error"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(rows, SCHEMA)


def read_wav(spark: SparkSession, folder: str) -> DataFrame:
    """read_audio of the folder's .wav files."""
    return read_audio(spark, folder, ("wav",))


def click_train(bpm: float, seconds: float, rate: int = 44100) -> np.ndarray:
    """Clicks of noise that decays by a 20 ms time constant over 80 ms, one a beat; every beat has its own noise."""
    out = np.zeros(int(seconds * rate), np.float32)
    decay = rate * 0.02
    size = int(decay * 4)
    # fixed values: the seed and the constants of the generator, whose n'th state is linear in the seed
    factor, step, seed = 6364136223846793005, 1442695040888963407, 0x2545F4914F6CDD1D
    power, offset, powers, offsets = 1, 0, [], []
    for _ in range(size):
        power, offset = power * factor % 2**64, (offset * factor + step) % 2**64
        powers.append(power)
        offsets.append(offset)
    powers, offsets, shape = np.array(powers, np.uint64), np.array(offsets, np.uint64), np.exp(-np.arange(size) / decay).astype(np.float32)
    beats = int(np.ceil(len(out) / (60 / bpm * rate))) + 1
    for beat in range(beats):
        start = int(beat * (60 / bpm * rate) + 0.5)
        if start >= len(out):
            break
        with np.errstate(over="ignore"):
            state = powers * np.uint64(seed ^ beat) + offsets
        white = (state >> np.uint64(40)).astype(np.float32) / np.float32(8_388_608) - np.float32(1)
        n = min(size, len(out) - start)
        out[start : start + n] += (white * shape * np.float32(0.8))[:n]
    return out


def sine(hz: float, seconds: float, rate: int = 44100) -> np.ndarray:
    return np.sin(np.arange(int(seconds * rate)) * (2 * np.pi * hz / rate)).astype(np.float32)


def chord(notes: list[int], seconds: float, rate: int = 44100) -> np.ndarray:
    """MIDI notes with partials at once, twice and three times their pitch, halving in strength, scaled to a peak of 1."""
    time = np.arange(int(seconds * rate)) * (2 * np.pi / rate)
    out = sum((np.sin(time * (440.0 * 2 ** ((note - 69) / 12) * k)) * gain).astype(np.float32) for note in notes for k, gain in ((1, 1.0), (2, 0.5), (3, 0.25)))
    return (out / max(float(np.abs(out).max()), 1e-9)).astype(np.float32)


def mix(a: np.ndarray, b: np.ndarray, gain: float = 1.0) -> np.ndarray:
    """a with gain times b, as long as the shorter one."""
    n = min(len(a), len(b))
    return a[:n] + b[:n] * np.float32(gain)


def tracks(spark: SparkSession, signals: dict[str, np.ndarray], rate: int = 44100) -> DataFrame:
    """Signals as rows of SCHEMA, one batch each."""
    types = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
    rows = [pa.array(list(signals)), pa.array([rate] * len(signals), pa.int32()), pa.array([1] * len(signals), pa.int32()), pa.array(list(signals.values()), pa.list_(pa.float32())), pa.nulls(len(signals), pa.string())]
    return spark.createDataFrame(pa.Table.from_arrays(rows, schema=types), SCHEMA).repartition(max(1, len(signals)))


def excerpt(df: DataFrame, start: float, seconds: float | None = None) -> DataFrame:
    """The samples from `start` seconds on, `seconds` of them at most. A row whose track ends before `start` has no
    samples and says so in `error`."""
    first = F.round(F.lit(max(start, 0.0)) * F.col("sample_rate")).cast("int")
    count = F.size("samples") if seconds is None else F.round(F.lit(max(seconds, 0.0)) * F.col("sample_rate")).cast("int")
    beyond = F.col("samples").isNotNull() & (first >= F.size("samples"))
    said = F.format_string(f"an excerpt from {start:g} s, the track has %.2f s", F.size("samples") / F.col("sample_rate"))
    out = df.withColumn("beyond_", beyond).withColumn("error", F.when(F.col("beyond_"), said).otherwise(F.col("error")))
    return out.withColumn("samples", F.when(~F.col("beyond_"), F.slice("samples", first + 1, count))).drop("beyond_")


def lead_in_seconds(samples: np.ndarray, rate: int) -> float:
    """How long a track stays over 60 dB below its peak, in windows of 10 ms; 0 if it starts at once or is silent."""
    window = max(1, int(rate * 0.01))
    if not len(samples):
        return 0.0
    levels = np.maximum.reduceat(np.abs(samples), np.arange(0, len(samples), window))
    loud = np.flatnonzero(levels >= levels.max() * np.float32(1e-3)) if levels.max() > 0 else []
    return int(loud[0]) * window / rate if len(loud) else 0.0


def lead_in(samples: DataFrame, by: list[str], rate: Column, value: str = "v", order: str = "i") -> DataFrame:
    """(by..., lead_in_seconds) as lead_in_seconds, from one row a sample: windows are a grouping, the first loud one a
    minimum, so a track of any length spreads over tasks."""
    from pyspark.sql import Window as W

    window = F.greatest(F.floor(rate * 0.01).cast("int"), F.lit(1))
    levels = samples.withColumn("rate_", rate).withColumn("size_", window).groupBy(*by, "rate_", "size_", F.floor(F.col(order) / F.col("size_")).alias("w_")).agg(F.max(F.abs(value)).alias("level_"))
    peak = F.max("level_").over(W.partitionBy(*by))
    loud = F.when((F.col("peak_") > 0) & (F.col("level_") >= F.col("peak_") * 1e-3), F.col("w_") * F.col("size_") / F.col("rate_"))
    return levels.withColumn("peak_", peak).groupBy(*by).agg(F.coalesce(F.min(loud), F.lit(0.0)).alias("lead_in_seconds"))
