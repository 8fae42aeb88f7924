import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from cadenza.operators import naming, onset, spectrum, tempo
from cadenza.plans.analysis import analyze, selftest, synthetic
from cadenza.queries import catalogue
from cadenza.sources.audio import SCHEMA, click_train, decode_wav, encode_wav, excerpt, read_wav
from cadenza.sources.audio import tracks as as_tracks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(pdf):
    cell = lambda v: "null" if pd.isna(v) else repr(float(v)) if not isinstance(v, str) else v
    return sorted(tuple(cell(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_self_test_tempi(spark):
    tempi = [128.0, 150.0, 174.0, 127.5]
    rows = {r.path: r for r in analyze(synthetic(spark, tempi, 60)).collect()}
    assert len(rows) == 4
    for bpm in tempi:
        r = rows[f"click-{bpm:g}"]
        codes = {f.code for f in r.findings}
        assert abs(r.tempo.bpm_measured - bpm) < 0.1 and r.tempo.bpm == math.floor(r.tempo.bpm_measured + 0.5)
        assert ("non-integer-tempo" in codes) == (bpm == 127.5)
        assert len(r.bands) == 8 and len(r.key.ranked) == 24 and r.error is None
    clean = rows["click-150"].tempo
    assert clean.grid.matched_fraction > 0.9 and clean.grid.pulse_ratio > 2 and clean.stability.interquartile_range_bpm < 1
    checked = selftest(spark, [174.0, 200.0], 45).collect()
    assert [r.passed for r in checked] == [True, True]


def test_every_track_has_its_own_rate(spark):
    tracks = as_tracks(spark, {"a": click_train(128, 60, 48000)}, 48000).unionByName(as_tracks(spark, {"b": click_train(128, 60)}))
    rows = {r.path: r for r in analyze(tracks).collect()}
    assert rows["a"].tempo.bpm == rows["b"].tempo.bpm == 128 and rows["a"].source.sample_rate == 48000
    assert rows["a"].settings.frame_rate == 93.75


def test_short_silent_and_missing_tracks(spark):
    silent = np.zeros(40 * 44100, np.float32)
    tracks = as_tracks(spark, {"short": click_train(128, 10), "silent": silent, "lead": np.concatenate([np.zeros(22050, np.float32), click_train(140, 45)])})
    tracks = tracks.unionByName(spark.createDataFrame([("lost", None, None, None, "not a WAV file")], SCHEMA))
    rows = {r.path: r for r in analyze(tracks).collect()}
    assert "30 seconds" in rows["short"].error and rows["lost"].error == "not a WAV file" and rows["short"].findings is None
    assert {"no-candidate", "flat-chroma"} <= {f.code for f in rows["silent"].findings} and rows["silent"].tempo.bpm is None
    assert rows["lead"].source.lead_in_seconds == pytest.approx(0.5, abs=0.011) and "lead-in-trimmed" in {f.code for f in rows["lead"].findings}
    assert rows["lead"].tempo.bpm == 140
    severities = [f.severity for f in rows["lead"].findings]
    assert severities == sorted(severities, reverse=True)


def test_wav_round_trip_and_errors(spark, tmp_path):
    x = np.sin(np.arange(4000) / 20).astype(np.float32) * 0.5
    (tmp_path / "a.WAV").write_bytes(encode_wav(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    (tmp_path / "c.txt").write_bytes(b"")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_wav(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.WAV", "b.wav"} and rows["b.wav"].error
    assert np.allclose(rows["a.WAV"].samples, x, atol=1e-4)
    part = excerpt(read_wav(spark, str(tmp_path)).where("error is null"), 0.1, 0.2).first().samples
    assert np.allclose(part, x[800:2400], atol=1e-4)
    with pytest.raises(ValueError):
        decode_wav(encode_wav(x[:0], 8000))


def test_camelot_and_names(spark):
    cases = [(0, False, "8B"), (9, True, "8A"), (11, False, "1B"), (6, True, "11A"), (3, False, "5B")]
    df = spark.createDataFrame(cases, "t int, m boolean, want string")
    assert all(r.got == r.want for r in df.select(spectrum.camelot(F.col("t"), F.col("m")).alias("got"), "want").collect())
    names = spark.createDataFrame([(127.6, "8A", "x.wav"), (0.5, "8A", "x.wav"), (1000.0, "8A", "x.wav"), (90.0, "13A", "x.wav"), (127.5, "08B", "128_08A_a.b.mp3"), (99.0, "1C", "x"), (99.4, "1A", "x"), (None, "1A", "x")], "bpm double, key string, name string")
    got = [r[0] for r in names.select(naming.target_name(F.col("bpm"), F.col("key"), F.col("name"))).collect()]
    assert got == ["128_08A_x.wav", None, None, None, "128_08B_a.b.mp3", None, "099_01A_x", None]


def test_profiles_rank_their_own_key_first(spark):
    rows = [(t * 2 + m, p, w[(p - t) % 12]) for m, w in enumerate(spectrum.PROFILES["temperley"]) for t in range(12) for p in range(12)]
    ranked = spectrum.rank_keys(spark.createDataFrame(rows, "track int, pitch int, x double"), ["track"]).where("rank = 1").collect()
    assert len(ranked) == 24 and all(r.track == r.tonic * 2 + int(r.minor) for r in ranked)


def test_flux_first_frame_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 0.0)], "band string, frame int, energy double")
    assert [round(r.flux, 6) for r in onset.spectral_flux(df, ["band"], 1.0).orderBy("frame").collect()] == [0.0, round(float(np.log(2)), 6), 0.0]
    assert onset.spectral_flux(df.limit(0), ["band"]).count() == 0


def test_nearest_rank_rounds_half_away(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "a array<double>")
    assert [r[0] for r in df.select(tempo.nearest_rank(F.col("a"), 0.5)).collect()] == [3.0, None]
