"""From tracks to one report row each.

What reads samples is one narrow pass: a track's reductions leave its task, spectra and samples never do. Keys, cues,
findings and the report itself are columns over that row, so nothing is shuffled and a track is measured once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cadenza.operators import chroma, energy, findings, onset, spectrum, structure, waveform
from cadenza.operators.stft import band_frames, frames
from cadenza.sources.audio import click_train, lead_in_seconds
from cadenza.sources.audio import tracks as as_tracks

from . import structure as sections
from . import tempo
from .options import Options

TOOL, VERSION = "cadenza", "0.2"
#: A track must have this many seconds of frames: two windows of the tempo trace.
LEAST_SECONDS = 30.0
#: Rows and columns of a spectrogram, its range in hertz and how many decibels below its peak it shows.
IMAGE_ROWS, IMAGE_COLUMNS, IMAGE_HZ, IMAGE_DB = 440, 1600, (20.0, 20_000.0), 80.0

_CANDIDATES = "array<struct<bpm:double,salience:double,weighted_salience:double,autocorrelation:double,fourier_salience:double>>"
TEMPO = f"""struct<bpm:double,bpm_measured:double,salience:double,octave_shift:struct<from_bpm:double,to_bpm:double,from_salience:double,to_salience:double>,
 candidates:{_CANDIDATES},candidates_unweighted:{_CANDIDATES},bpm_unweighted:double,
 octave_relatives:array<struct<label:string,bpm:double,salience:double,fourier_salience:double,matched_fraction:double,pulse_ratio:double>>,
 grid:struct<bpm:double,offset_seconds:double,beats_seconds:array<double>,pulse_ratio:double,matched_fraction:double,mean_absolute_error_ms:double,tolerance_ms:double>,
 bar:struct<beats_per_bar:int,phase:int,contrast:double>,over_time:array<struct<start_seconds:double,bpm:double,salience:double>>,
 stability:struct<median_bpm:double,interquartile_range_bpm:double,agreeing_fraction:double,octave_split_fraction:double>,fourier_bpm:double,
 curve:struct<bpm:array<double>,comb:array<double>,fourier:array<double>>>""".replace("\n ", "")
_ENERGY = "struct<score:double,band:string,centre_bpm:double,brightness:double,crest_db:double,onset_density:double,high_share:double>"
_SPECTRUM = "struct<peak_hz:double,centroid_hz:double,rolloff_95_hz:double,high_cutoff_hz:double,low_share:double,mid_share:double,high_share:double>"
_SECTIONS = "array<struct<idx:int,label:string,confidence:double,start_seconds:double,end_seconds:double,start_bar:int,bars:int,low_db:double,broadband_db:double,rise_db:double>>"
_BARS = f"struct<bar_starts:array<double>,bar_count:int,boundaries:array<struct<bar:int,time_seconds:double,strength:double>>,sections:{_SECTIONS}>"
_WAVES = "struct<columns_per_second:double,columns:binary>"
MEASURES = f"""path string, sample_rate int, channels int, duration_seconds double, lead_in_seconds double, analysed_seconds double, frame_rate double,
 tuning_cents double, chroma array<double>, average_spectrum array<double>, novelty array<float>, tempo {TEMPO}, bars {_BARS},
 band_tempi array<struct<band:int,low_hz:double,high_hz:double,bpm:double,salience:double>>, energy {_ENERGY}, spectrum {_SPECTRUM}, preview {_WAVES}, detail {_WAVES}, error string""".replace("\n ", " ")


def _novelty(energies: np.ndarray, rate: float, o: Options) -> np.ndarray:
    """[band, frame] onset novelty of [frame, band] energies: the rise of the compressed energy above its moving mean."""
    level = np.log1p(np.float32(o.gamma) * np.maximum(energies.T, 0)).astype(np.float32)
    flux = np.maximum(np.diff(level, axis=1, prepend=level[:, :1]), 0)
    n, half = flux.shape[1], max(1, int(tempo.half_up(o.local_mean_seconds * rate / 2)))
    sums = np.concatenate([np.zeros((len(flux), 1)), np.cumsum(flux, axis=1, dtype=np.float64)], axis=1)
    low, high = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return np.maximum(flux - (sums[:, high] - sums[:, low]) / (high - low), 0).astype(np.float32)


def _together(curves: np.ndarray) -> np.ndarray:
    """The sum of curves, each divided by its mean."""
    mean = curves.mean(axis=1, dtype=np.float32, keepdims=True)
    return np.divide(curves, mean, out=np.zeros_like(curves), where=mean > np.finfo(np.float32).tiny).sum(axis=0, dtype=np.float32)


def measured_energy(x: np.ndarray, hz: np.ndarray, amplitude: np.ndarray, curve: np.ndarray, rate: float) -> dict:
    """One track's energy record; the operators of cadenza.operators.energy do the same for rows."""
    between = lambda low, high: float(amplitude[(hz >= low) & (hz < high)].mean()) if ((hz >= low) & (hz < high)).any() else 0.0
    top, low = between(*energy.TOP), max(between(*energy.LOW_MID), np.finfo(float).tiny)
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0
    peaks = int(((curve[1:-1] > curve[:-2]) & (curve[1:-1] >= curve[2:]) & (curve[1:-1] > curve.mean(dtype=np.float64))).sum())
    power = amplitude**2
    found = {
        "brightness": float(np.log10(top / low)) if top > 0 else None, "crest_db": float(20 * np.log10(np.abs(x).max() / rms)) if rms > 0 else None,
        "onset_density": peaks / (len(curve) / rate), "high_share": float(power[hz >= energy.HIGH_HZ].sum() / power.sum()) if power.sum() > 0 else 0.0,
    }
    score = None if None in found.values() else sum((found[k] - mean) / deviation * w for k, (mean, deviation, w) in energy.WEIGHTS.items())
    band = None if score is None else "calm" if score < energy.CALM_BELOW else "club" if score < energy.CLUB_BELOW else "hard"
    return {"score": score, "band": band, "centre_bpm": energy.CENTRES.get(band), **found}


def summarised(hz: np.ndarray, amplitude: np.ndarray) -> dict:
    """Peak, centroid, rolloff, upper cutoff and shares of one average spectrum."""
    db = 20 * np.log10(np.maximum(amplitude.astype(np.float32), np.float32(1e-10))).astype(np.float64)
    power = 10 ** (db / 10)
    total, audible = power.sum(), np.flatnonzero(hz >= 20)
    share = lambda low, high: float(power[(hz >= low) & (hz < high)].sum() / total)
    return {
        "peak_hz": float(hz[audible[tempo.last_max(db[audible])]]) if len(audible) else 0.0, "centroid_hz": float((hz * power).sum() / total),
        "rolloff_95_hz": float(hz[np.flatnonzero(np.cumsum(power) / total >= 0.95 - 1e-12)[0]]), "high_cutoff_hz": float(hz[np.flatnonzero(db >= db.max() - 40)[-1]]),
        "low_share": share(0, 200), "mid_share": share(200, 4000), "high_share": share(4000, np.inf),
    }


def measure(path: str, rate: int, channels: int, samples: np.ndarray, o: Options) -> dict:
    """Every measurement of one track that reads its samples or its frames, a row of MEASURES."""
    row = {"path": path, "sample_rate": rate, "channels": channels, "duration_seconds": len(samples) / rate}
    lead = lead_in_seconds(samples, rate) if o.trim_lead_in else 0.0
    x = samples[int(lead * rate) :]
    count = 0 if len(x) < o.window else (len(x) - o.window) // o.hop + 1
    frame_rate = rate / o.hop
    row |= {"lead_in_seconds": lead, "analysed_seconds": len(x) / rate, "frame_rate": frame_rate}
    if count / frame_rate < LEAST_SECONDS:
        return row | {"error": f"need at least {LEAST_SECONDS:.0f} seconds of audio, got {count / frame_rate:.1f}"}
    cents = o.tuning_cents
    if cents is None:
        every = max(1, count // chroma.TUNING_FRAMES)
        cents = chroma.tuning_cents(sum(chroma.tuning_histogram(block, rate, o.window) for block in frames(x, o.window, o.hop * every)))
    edges = spectrum.log_band_edges(o.bands, o.low_hz, o.high_hz, rate, o.window)
    notes, sums, energies = np.zeros(12), np.zeros(o.window // 2 + 1), []
    for block in frames(x, o.window, o.hop):
        energies.append(np.stack([block[:, a:b].mean(axis=1) for *_, a, b in edges], axis=1))
        notes += chroma.pitch_classes(block, rate, o.window, cents)
        sums += block.sum(axis=0, dtype=np.float64)
    energies = np.concatenate(energies)
    curves = _novelty(energies, frame_rate, o)
    broad, low = _together(curves), _together(curves[:2])
    hz, amplitude = np.arange(1, len(sums)) * rate / o.window, sums[1:] / count
    energetic = measured_energy(x, hz, amplitude, broad, frame_rate)
    mine = o.weighted(energetic["centre_bpm"])
    slot = np.floor(np.arange(count) / max(1.0, frame_rate * structure.SLOT_SECONDS)).astype(np.int64)
    held = np.maximum(np.bincount(slot), 1)
    slots = np.stack([np.bincount(slot, energies[:, k].astype(np.float64)) for k in range(o.bands)], axis=1) / held[:, None]
    record = tempo.analyse(broad, low, frame_rate, mine)
    best = [tempo.best_bpm(c, frame_rate, mine) for c in curves]
    seconds = len(x) / rate
    preview, detail = map(waveform.pack, waveform.renders(x, rate, (waveform.PREVIEW, int(seconds * waveform.DETAIL_RATE + 0.5))))
    return row | {
        "tuning_cents": float(cents), "chroma": (notes / notes.sum() if notes.sum() > 0 else notes).tolist(), "average_spectrum": amplitude.tolist(),
        "novelty": broad.tolist(), "tempo": record, "bars": sections.analyse(slots, sections.bar_starts(record["grid"]["beats_seconds"], record["bar"]["phase"])) if record["grid"] else None,
        "band_tempi": [{"band": i, "low_hz": a, "high_hz": b, "bpm": bpm, "salience": s} for (i, a, b, *_), (bpm, s) in zip(edges, best, strict=True)],
        "energy": energetic, "spectrum": summarised(hz, amplitude),
        "preview": {"columns_per_second": waveform.PREVIEW / seconds, "columns": preview},
        "detail": {"columns_per_second": float(waveform.DETAIL_RATE), "columns": detail},
    }


def measures(tracks: DataFrame, options: Options = Options()) -> DataFrame:
    """A row of MEASURES for every track of read_audio; one that can't be read or is too short has its `error` alone."""
    schema = T.StructType.fromDDL(MEASURES)
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, rate, channels, said = (batch.column(c)[i].as_py() for c in ("path", "sample_rate", "channels", "error"))
                samples = batch.column("samples")[i]
                if said is None and samples.is_valid and rate:
                    row = measure(path, rate, channels, samples.values.to_numpy(zero_copy_only=False).astype(np.float32), options)
                else:
                    row = {"path": path, "error": said or "no samples"}
                yield pa.RecordBatch.from_pylist([{name: row.get(name) for name in arrow.names}], schema=arrow)

    return tracks.select("path", "sample_rate", "channels", "samples", "error").mapInArrow(rows, schema)


def with_key(df: DataFrame, profile: str) -> DataFrame:
    """df with `key`, the record of its chroma and tuning_cents: 24 rotated profiles ranked by correlation, the best
    key's names, its relative and its margin over the second. Each step is a column of its own, worked out once."""
    best, second = (lambda name: F.get("ranked_", F.lit(0))[name]), F.get("ranked_", F.lit(1))
    key = F.struct(
        F.lit(profile).alias("profile"), "chroma", "tuning_cents", best("key").alias("key"), best("camelot").alias("camelot"), best("name").alias("name"),
        spectrum.margin(best("correlation"), second["correlation"]).alias("margin"), second["camelot"].alias("runner_up"),
        spectrum.relative_camelot(best("camelot")).alias("relative"), F.col("ranked_").alias("ranked"),
    )
    return df.withColumn("ranked_", spectrum.ranked_keys(F.col("chroma"), profile)).withColumn("key", F.when(F.col("chroma").isNotNull(), key)).drop("ranked_")


def with_structure(df: DataFrame, options: Options = Options()) -> DataFrame:
    """df, rows of MEASURES, with `structure`: sections, cues, missing pads and boundaries, null without a beat grid."""
    o = options
    rows = df.withColumns({"sections": F.col("bars.sections"), "bar_starts": F.col("bars.bar_starts"), "duration_seconds_": F.col("duration_seconds")}).withColumn("duration_seconds", F.col("analysed_seconds"))
    placed = structure.place_cues(rows, o.memory_offset_bars, o.loop_bars, o.drop_after_fraction).withColumn("duration_seconds", F.col("duration_seconds_"))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in (("phrase_bars", structure.PHRASE_BARS), ("minimum_section_bars", structure.SECTION_BARS), ("memory_offset_bars", o.memory_offset_bars), ("loop_bars", o.loop_bars), ("drop_after_fraction", o.drop_after_fraction))])
    record = F.struct("sections", "cues", "missing_pads", F.col("bars.boundaries").alias("boundaries"), "drop_rule_relaxed", F.col("bars.bar_count").alias("bar_count"), settings.alias("settings"))
    return placed.withColumn("structure", F.when(F.col("bars").isNotNull(), record)).drop("sections", "bar_starts", "cues", "missing_pads", "drop_rule_relaxed", "duration_seconds_")


def analyze(tracks: DataFrame, options: Options = Options()) -> DataFrame:
    """One report row a track of read_audio, by path: tool, version, source, settings, tempo, key, bands, energy,
    spectrum, structure, waveforms, findings and, where nothing could be measured, error.

    Every track is measured at its own sample rate.
    """
    o = options
    report = with_key(with_structure(measures(tracks, o), o), o.profile)
    tempo_found = findings.tempo_findings(F.col("tempo"), o.floor_bpm, o.snap_bpm, o.min_bpm, o.max_bpm)
    opening = findings.opening_findings(F.col("lead_in_seconds"), F.col("energy"))
    listed = findings.merged(opening, tempo_found, findings.key_findings(F.col("key")), F.when(F.col("structure").isNotNull(), findings.structure_findings(F.col("structure"), o.drop_after_fraction)).otherwise(F.expr("cast(array() as array<struct<code:string,severity:string,message:string>>)")))
    began = F.lit(o.start_seconds) + F.col("lead_in_seconds")
    source = F.struct("path", "sample_rate", "channels", "duration_seconds", began.alias("analysed_start_seconds"), "analysed_seconds", "lead_in_seconds", (began + F.col("tempo.grid.offset_seconds")).alias("trim_to_first_beat_seconds"))
    settings = F.struct(F.lit(o.window).alias("window_size"), F.lit(o.hop).alias("hop"), "frame_rate", F.lit(o.bands).alias("onset_bands"), F.lit(o.gamma).alias("flux_compression"), F.lit(o.local_mean_seconds).alias("local_mean_seconds"))
    weighting = F.when(F.col("energy.centre_bpm").isNotNull(), F.struct(F.col("energy.centre_bpm").alias("centre_bpm"), F.lit(o.width_octaves).alias("width_octaves")))
    floor = F.struct(F.lit(o.floor_bpm).alias("bpm"), F.lit(o.floor_ratio).alias("min_salience_ratio")) if o.floor_bpm > 0 else F.lit(None).cast("struct<bpm:double,min_salience_ratio:double>")
    asked = F.struct(*[F.lit(v).alias(k) for k, v in (("min_bpm", o.min_bpm), ("max_bpm", o.max_bpm), ("resolution_bpm", o.resolution), ("pulses", o.pulses), ("penalty", o.penalty), ("integer_snap_bpm", o.snap_bpm))], weighting.alias("weighting"), floor.alias("floor"))
    return report.select(
        "path", F.lit(TOOL).alias("tool"), F.lit(VERSION).alias("version"), source.alias("source"), settings.alias("settings"), F.col("tempo").withField("settings", asked).alias("tempo"),
        "key", F.col("band_tempi").alias("bands"), "energy", "spectrum", "structure", F.struct("preview", "detail").alias("waveforms"), F.when(F.col("error").isNull(), listed).alias("findings"),
        "average_spectrum", "novelty", "error",
    )


def novelty_curves(tracks: DataFrame, options: Options = Options()) -> DataFrame:
    """(path, frame, v): broadband onset novelty as windows over (path, band, frame), for rows at one sample rate a
    call; `measures` has the same curve in one narrow pass."""
    o = options
    bands = band_frames(tracks, o.bands, o.low_hz, o.high_hz, o.window, o.hop).select("path", "frame", F.posexplode("energies").alias("band", "energy"))
    rates = [r[0] for r in tracks.where("sample_rate is not null").select("sample_rate").distinct().limit(2).collect()]
    if len(rates) > 1:
        raise ValueError("tracks of several sample rates: one call each")
    half = max(1, int(tempo.half_up(o.local_mean_seconds * (rates[0] if rates else 44100) / o.hop / 2)))
    return onset.broadband(onset.novelty(onset.spectral_flux(bands, ["path", "band"], o.gamma), ["path", "band"], half), ["path"])


def spectrograms(tracks: DataFrame, options: Options = Options(), rows: int = IMAGE_ROWS, columns: int = IMAGE_COLUMNS) -> DataFrame:
    """(path, height, width, values, floor_db, ceiling_db, seconds, low_hz, high_hz): decibels of log-spaced rows, the
    highest first, over at most `columns` stretches of the track; values row by row. Tracks shorter than a window have none."""
    o, schema = options, "path string, height int, width int, values array<float>, floor_db double, ceiling_db double, seconds double, low_hz double, high_hz double"

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, rate, samples = batch.column("path")[i].as_py(), batch.column("sample_rate")[i].as_py(), batch.column("samples")[i]
                if not samples.is_valid or len(samples.values) < o.window:
                    continue
                x = samples.values.to_numpy(zero_copy_only=False).astype(np.float32)
                count = (len(x) - o.window) // o.hop + 1
                edges = spectrum.log_band_edges(rows, *IMAGE_HZ, rate, o.window)
                first, end = np.array([e[3] for e in edges]), np.array([e[4] for e in edges])
                width = min(columns, count)
                sums, at = np.zeros((width, rows)), 0
                for block in frames(x, o.window, o.hop):
                    running = np.concatenate([np.zeros((len(block), 1)), np.cumsum(block, axis=1, dtype=np.float64)], axis=1)
                    np.add.at(sums, np.arange(at, at + len(block)) * width // count, (running[:, end] - running[:, first]) / (end - first))
                    at += len(block)
                held = np.bincount(np.arange(count) * width // count, minlength=width)
                db = 20 * np.log10(np.maximum((sums / held[:, None]).T[::-1], 1e-10))
                row = [[path], [rows], [width], [db.astype(np.float32).ravel()], [db.max() - IMAGE_DB], [db.max()], [count * o.hop / rate], [edges[0][1]], [edges[-1][2]]]
                types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["path", "height", "width", "values", "floor_db", "ceiling_db", "seconds", "low_hz", "high_hz"])

    return tracks.select("path", "sample_rate", "samples").mapInArrow(drawn, schema)


def synthetic(spark: SparkSession, tempi: list[float], seconds: float = 40.0, rate: int = 44100) -> DataFrame:
    """Click trains as tracks."""
    return as_tracks(spark, {f"click-{bpm:g}": click_train(bpm, seconds, rate) for bpm in tempi}, rate)


def selftest(spark: SparkSession, tempi: list[float], seconds: float = 60.0) -> DataFrame:
    """(path, wanted, bpm, bpm_measured, passed): generated click trains and whether they were measured within 0.5 %."""
    wanted = F.regexp_extract("path", "click-(.*)", 1).cast("double")
    off = F.abs(F.col("tempo.bpm_measured") - wanted) / wanted
    return analyze(synthetic(spark, tempi, seconds)).select("path", wanted.alias("wanted"), "tempo.bpm", "tempo.bpm_measured", F.coalesce(off <= 0.005, F.lit(False)).alias("passed"))
