import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import chroma, energy, waveform
from cadenza.operators.stft import frames
from cadenza.sources.archive import is_audio, read_archives
from cadenza.sources.audio import SCHEMA

RATE = 44100


def _sine(hz, seconds=2.0, rate=RATE):
    return (np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate) * 0.8).astype(np.float32)


def _tracks(spark, **signals):
    return spark.createDataFrame([(name, RATE, 1, None if x is None else x.tolist(), None) for name, x in signals.items()], SCHEMA)


@pytest.mark.parametrize(("b", "n"), [(0.2, 1), (0.97, 63), (0.97, 64), (0.9999, 9000)])
def test_decayed_sums_are_the_plain_recurrence(b, n):
    u, state, want = np.random.default_rng(n).normal(size=n), 0.0, []
    for x in u:
        state = x + b * state
        want.append(state)
    assert np.allclose(waveform._decayed_sums(u, b), want)


@pytest.mark.parametrize(("hz", "band"), [(60, 1), (800, 2), (8000, 3)])
def test_the_loudest_band_follows_the_frequency(hz, band):
    found = waveform.render(_sine(hz), RATE, 100)
    assert found.shape == (100, 4) and (found[:, band] == 7).all() and (found[:, 0] >= 30).all()
    assert (found[:, [i for i in (1, 2, 3) if i != band]] < 7).all()


def test_render_of_silence_nothing_and_more_columns_than_samples():
    assert not waveform.render(np.zeros(1000, np.float32), RATE, 10).any()
    assert not waveform.render(np.zeros(0, np.float32), RATE, 10).any()
    assert waveform.render(np.ones(3, np.float32), RATE, 9)[:, 0].tolist() == [31, 0, 0, 31, 0, 0, 31, 0, 0]


def test_columns_round_trip_and_resample(spark):
    df = waveform.waveforms(_tracks(spark, a=_sine(60), none=None, empty=np.zeros(0, np.float32)), 40)
    rows = {r.path: r for r in df.withColumn("c", waveform.unpacked(F.col("columns"))).withColumn("r", waveform.resampled(F.col("c"), 8)).withColumn("up", waveform.resampled(F.col("c"), 80)).collect()}
    want = waveform.render(_sine(60), RATE, 40)
    assert [tuple(c) for c in rows["a"].c] == [tuple(c) for c in want.tolist()]
    assert rows["a"].columns_per_second == pytest.approx(20)
    assert [c.height for c in rows["a"].r] == [int(want[i * 5 : i * 5 + 5, 0].max()) for i in range(8)]
    assert [tuple(c) for c in rows["a"].up] == [tuple(c) for c in np.repeat(want, 2, axis=0).tolist()]
    assert rows["none"]["columns"] is None and rows["empty"]["columns"] is None
    assert waveform.waveforms(_tracks(spark, a=_sine(60))).first().columns_per_second == 150
    shades = spark.createDataFrame([(7, 1), (1, 0), (3, 4)], "mid int, high int").select(waveform.shade(F.col("mid"), F.col("high")))
    assert [r[0] for r in shades.collect()] == [5, 0, 4]


def test_resampling_keeps_the_last_highest(spark):
    df = spark.createDataFrame([([(3, 1, 0, 0), (9, 2, 0, 0), (9, 3, 0, 0), (1, 4, 0, 0)],), ([],)], "c array<struct<height:int,low:int,mid:int,high:int>>")
    rows = [r[0] for r in df.select(waveform.resampled(F.col("c"), 1)).collect()]
    assert [tuple(x[0]) for x in rows] == [(9, 3, 0, 0), (0, 0, 0, 0)]


def test_tuning_of_a_raised_sine():
    x = _sine(440 * 2 ** (30 / 1200), 4)
    total = sum(chroma.tuning_histogram(b, RATE, 4096) for b in frames(x, 4096, 1024))
    assert abs(chroma.tuning_cents(total) - 30) <= 6
    assert chroma.tuning_cents(np.zeros(100)) == 0
    assert abs(chroma.tuning_cents(np.eye(100)[99] + np.eye(100)[0])) > 49  # a seam is not the middle


def test_chroma_of_a_chord(spark):
    x = sum(_sine(440 * 2 ** ((note - 69) / 12)) for note in (60, 64, 67)) / 3
    rows = {r.path: r for r in chroma.track_chroma(_tracks(spark, chord=x, silent=np.zeros(RATE, np.float32), short=x[:100], none=None), 4096, 1024, 0.0).collect()}
    assert set(rows) == {"chord", "silent"}
    found = rows["chord"].chroma
    assert sum(found) == pytest.approx(1) and all(found[i] > 0.15 for i in (0, 4, 7)) and found[1] < 0.05 and found[6] < 0.05
    assert sum(rows["silent"].chroma) == 0 and len(rows["chord"].spectrum) == 2049


def test_energy_orders_hot_above_calm(spark):
    spectra, crests, curves = [], [], []
    for name, top, gap in (("hot", 0.5, 4), ("cold", 0.001, 40)):
        spectra += [(name, float(hz), 1.0 if hz < 300 else top) for hz in range(30, 18000, 30)]
        x = _sine(100, 1) if name == "hot" else np.concatenate([_sine(100, 0.1), np.zeros(RATE, np.float32)])
        crests.append((name, x.tolist()))
        curves += [(name, i, 1.0 if i % gap == 2 else 0.0) for i in range(860)]
    crest = spark.createDataFrame(crests, "path string, s array<float>").select("path", energy.crest_db(F.col("s")).alias("crest_db"))
    out = energy.energy(spark.createDataFrame(spectra, "path string, hz double, amplitude double"), crest, spark.createDataFrame(curves, "path string, frame int, v double"), ["path"], 86.0)
    rows = {r.path: r for r in out.collect()}
    assert rows["hot"].band == "hard" and rows["hot"].centre_bpm is None
    assert rows["cold"].band == "calm" and rows["cold"].centre_bpm == 115
    assert rows["hot"].onset_density == pytest.approx(215 / 10) and rows["hot"].crest_db == pytest.approx(20 * math.log10(2**0.5), abs=1e-3)
    assert rows["hot"].brightness == pytest.approx(math.log10(0.5))


def test_energy_of_silence_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([],), (None,)], "s array<float>").select(energy.crest_db(F.col("s")))
    assert [r[0] for r in df.collect()] == [None] * 3
    spectrum = spark.createDataFrame([("a", 3000.0, 0.0)], "path string, hz double, amplitude double")
    row = energy.spectral_measures(spectrum, ["path"]).first()
    assert row.brightness is None and row.high_share == 0


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("x/", "x/A - B.WAV", "x/cover.jpg", "__MACOSX/x/A.wav", "x/._A.wav", "b.aif", "wav"):
            z.writestr(name, name.encode())
    (tmp_path / "one.ZIP").write_bytes(data.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    rows = read_archives(spark, str(tmp_path)).orderBy("archive", "position").collect()
    assert [(r.position, r.file_name, r.content and bytes(r.content)) for r in rows] == [(None, None, None), (1, "A - B.WAV", b"x/A - B.WAV"), (5, "b.aif", b"b.aif")]
    assert rows[0].error and not rows[1].error
    assert read_archives(spark, str(tmp_path), contents=False).where("content is not null").count() == 0
    assert is_audio("d/x.flac") and not is_audio("flac")
