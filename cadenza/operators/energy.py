"""How energetic a track is, from its average spectrum, its samples and its onsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Mean, deviation and weight of each measure; ranges in hertz; the bands' upper scores and tempo centres.
WEIGHTS = {"brightness": (-1.1877, 0.1940, 0.5828), "crest_db": (10.1017, 1.5277, -0.3495), "onset_density": (11.4666, 1.7940, 0.5096), "high_share": (0.0437, 0.0320, 0.5277)}
LOW_MID, TOP, HIGH_HZ = (100.0, 276.0), (2101.0, 16000.0), 4000.0
CALM_BELOW, CLUB_BELOW = -0.5, 1.0
CENTRES = {"calm": 115.0, "club": 140.0}
_TINY = 2.2250738585072014e-308


def spectral_measures(spectrum: DataFrame, by: list[str]) -> DataFrame:
    """(by..., brightness, high_share) from rows (by..., hz, amplitude) of average spectra.

    brightness is null where the top has no energy at all, high_share 0 for a silent track."""
    hz, a = F.col("hz"), F.col("amplitude")
    mean = lambda low, high: F.coalesce(F.avg(F.when((hz >= low) & (hz < high), a)), F.lit(0.0))
    total = F.sum(a * a)
    share = F.when(total > 0, F.sum(F.when(hz >= HIGH_HZ, a * a).otherwise(0.0)) / total).otherwise(0.0)
    found = spectrum.groupBy(*by).agg(mean(*TOP).alias("top"), F.greatest(mean(*LOW_MID), F.lit(_TINY)).alias("low"), share.alias("high_share"))
    return found.select(*by, F.when(F.col("top") > 0, F.log10(F.col("top") / F.col("low"))).alias("brightness"), "high_share")


def crest_db(samples: Column) -> Column:
    """Peak over RMS of an array of samples in decibels; null for silence and for no samples."""
    wide = samples.cast("array<double>")
    peak = F.array_max(F.transform(wide, F.abs))
    power = F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x) / F.nullif(F.size(wide), F.lit(0))
    return F.when(peak > 0, 20 * F.log10(peak / F.sqrt(power)))


def onset_density(novelty: DataFrame, by: list[str], frame_rate: float) -> DataFrame:
    """(by..., onset_density): peaks above a curve's own mean a second, from rows (by..., frame, v)."""
    order = W.partitionBy(*by).orderBy("frame")
    v = F.col("v")
    marked = novelty.withColumn("before", F.lag("v").over(order)).withColumn("after", F.lead("v").over(order)).withColumn("mean", F.avg("v").over(W.partitionBy(*by)))
    peak = (v > F.col("before")) & (v >= F.col("after")) & (v > F.col("mean"))
    return marked.groupBy(*by).agg((F.count_if(peak) / F.count("*") * frame_rate).alias("onset_density"))


def score() -> Column:
    """The weighted sum of the standardised measures; null if one of them is."""
    return sum((F.col(name) - mean) / deviation * weight for name, (mean, deviation, weight) in WEIGHTS.items())


def band(value: Column) -> Column:
    return F.when(value < CALM_BELOW, "calm").when(value < CLUB_BELOW, "club").when(value.isNotNull(), "hard")


def weighting_centre(name: Column) -> Column:
    """The tempo that a band expects; null for `hard`, which is not weighted."""
    return F.when(name == "calm", CENTRES["calm"]).when(name == "club", CENTRES["club"])


def energy(spectrum: DataFrame, crest: DataFrame, novelty: DataFrame, by: list[str], frame_rate: float) -> DataFrame:
    """(by..., four measures, score, band, centre_bpm) of every track in spectrum; crest has (by..., crest_db)."""
    found = spectral_measures(spectrum, by).join(crest, by, "left").join(onset_density(novelty, by, frame_rate), by, "left")
    found = found.withColumn("score", score()).withColumn("band", band(F.col("score")))
    return found.withColumn("centre_bpm", weighting_centre(F.col("band")))
