"""Tempo, beat grids and curves in numpy and as arrays, on generated signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import series, tempo as columns
from cadenza.plans import tempo
from cadenza.plans.analysis import measure
from cadenza.plans.options import Options
from cadenza.sources.audio import click_train

RATE = 44100 / 512


def _record(bpm, o=Options(), seconds=60):
    return measure("x", 44100, 1, click_train(bpm, seconds), o)["tempo"]


def test_the_floor_doubles_and_says_so():
    bpm = 60 + 0.1 * np.arange(1601)
    salience = np.exp(-0.5 * ((bpm - 70) / 0.6) ** 2) + 0.8 * np.exp(-0.5 * ((bpm - 140) / 0.6) ** 2)
    raised, shift = tempo.floored(bpm, salience, 70.0, Options(floor_bpm=90))
    assert abs(raised - 140) <= 0.2 and shift["from_bpm"] == 70 and shift["to_bpm"] == raised and shift["to_salience"] == pytest.approx(0.8, abs=1e-3)
    assert tempo.floored(bpm, salience, 70.0, Options(floor_bpm=0)) == (70.0, None)
    assert tempo.floored(bpm, salience, 70.0, Options(floor_bpm=90, floor_ratio=0.9)) == (70.0, None)


def test_half_tempo_is_told_apart():
    for bpm in (160, 80):
        novelty = np.asarray(measure("x", 44100, 1, click_train(bpm, 60), Options(floor_bpm=0))["novelty"], np.float32)
        assert abs(tempo.best_bpm(novelty, RATE, Options(penalty=1.0))[0] - bpm) < 0.5


def test_a_forced_level_fits_worse():
    found = _record(120, Options(min_bpm=175, max_bpm=185))
    level = {r["label"]: r for r in found["octave_relatives"]}
    assert level["two-thirds"]["matched_fraction"] > level["candidate"]["matched_fraction"]
    assert level["two-thirds"]["pulse_ratio"] > level["candidate"]["pulse_ratio"] * 1.05


def test_rounding_is_always_done_unless_off():
    assert tempo.snapped(127.5, Options()) == 128 and tempo.snapped(122.66, Options()) == 123 and tempo.snapped(122.66, Options(snap_bpm=0)) == 122.66


def test_weighting_moves_the_ranking_and_keeps_the_other():
    found = tempo.analyse(np.tile(np.r_[1.0, np.zeros(21), 0.6, np.zeros(20)], 120).astype(np.float32), np.ones(5160, np.float32), RATE, Options(floor_bpm=0, centre_bpm=115.0))
    assert found["candidates_unweighted"] and found["bpm_unweighted"] is not None
    assert all(c["weighted_salience"] <= c["salience"] for c in found["candidates"])


def test_curves_of_numpy_and_columns_agree(spark):
    v = np.asarray(_record(150)["curve"]["comb"])[:200]
    x = np.array([-1.0, 0.0, 0.3, 0.5, 7.25, 198.6, 199.0, 199.4, 200.0])
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>").withColumn("x", F.explode(F.array(*[F.lit(float(i)) for i in x])))
    got = df.select(series.quadratic_at(F.col("v"), F.col("x")), series.linear_at(F.col("v"), F.col("x"))).collect()
    assert np.allclose([r[0] for r in got], tempo.at(v, x)) and np.allclose([r[1] for r in got], tempo.value_at(v, x))
    acf = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(series.acf(F.col("v"), 60)).first()[0]
    assert np.allclose(acf, tempo.acf(v, 60), atol=1e-6)
    omega = np.array([0.1, 0.37])
    row = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(*[series.magnitude(F.col("v"), F.lit(w)) for w in omega.tolist()]).first()
    assert np.allclose(list(row), tempo.magnitudes(v, omega))


def test_magnitudes_between_bins_are_the_direct_sum():
    x, omega = np.random.default_rng(1).normal(size=300), np.linspace(0.05, 3, 40)
    direct = [abs(sum(v * np.exp(-1j * w * i) for i, v in enumerate(x))) for w in omega]
    assert np.allclose(tempo.magnitudes(x, omega), direct, rtol=1e-9)


def test_stability_of_windows():
    found = tempo.stability([128.0, 128.5, 64.0, 256.0, 100.0], 128.0)
    assert found == {"median_bpm": 128.0, "interquartile_range_bpm": 28.5, "agreeing_fraction": 0.4, "octave_split_fraction": 0.4}
    assert tempo.stability([], 128.0)["median_bpm"] is None


def test_nearest_in_both_directions(spark):
    points = spark.createDataFrame([("a", float(i)) for i in (0, 4, 9, 20)] + [("b", 1.0)], "k string, frame double")
    targets = spark.createDataFrame([("a", 4.0), ("a", 12.0)], "k string, frame double")
    got = {(r.k, r.frame): r.distance for r in columns.nearest(points, targets, ["k"]).collect()}
    assert got == {("a", 0.0): 4.0, ("a", 4.0): 0.0, ("a", 9.0): 3.0, ("a", 20.0): 8.0, ("b", 1.0): None}
