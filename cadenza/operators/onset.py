"""Onset novelty of banded energy series, as windows and aggregates over (by..., frame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spectral_flux(df: DataFrame, by: list[str], gamma: float = 1000.0, value: str = "energy") -> DataFrame:
    """Adds `flux`: the rise of ln(1 + gamma * energy) since the frame before, 0 for falls and the first frame."""
    level = F.log1p(F.lit(gamma) * F.greatest(F.col(value), F.lit(0.0)))
    rise = level - F.lag(level).over(W.partitionBy(*by).orderBy("frame"))
    return df.withColumn("flux", F.greatest(F.coalesce(rise, F.lit(0.0)), F.lit(0.0)))


def novelty(df: DataFrame, by: list[str], half: int, value: str = "flux") -> DataFrame:
    """Adds `v`: value above its centred moving mean over 2 * half + 1 frames, cut at the series' ends."""
    near = W.partitionBy(*by).orderBy("frame").rowsBetween(-half, half)
    return df.withColumn("v", F.greatest(F.col(value) - F.avg(value).over(near), F.lit(0.0)))


def broadband(df: DataFrame, by: list[str], band: str = "band") -> DataFrame:
    """(by..., frame, v): bands summed after each is divided by its mean (bands without energy add nothing)."""
    mean = df.groupBy(*by, band).agg(F.avg("v").alias("mean"))
    scaled = df.join(mean, [*by, band]).withColumn("v", F.when(F.col("mean") > 0, F.col("v") / F.col("mean")).otherwise(0.0))
    return scaled.groupBy(*by, "frame").agg(F.sum("v").alias("v"))


def peaks(df: DataFrame, by: list[str], value: str = "v", order: str = "frame", floor: Column | None = None) -> DataFrame:
    """Rows higher than the one before, no lower than the one after, and above `floor` (0 by default)."""
    w = W.partitionBy(*by).orderBy(order)
    marked = df.withColumn("before_", F.lag(value).over(w)).withColumn("after_", F.lead(value).over(w))
    if floor is not None:
        marked = marked.withColumn("floor_", floor)
    here = F.col(value)
    return marked.where((here > F.col("before_")) & (here >= F.col("after_")) & (here > (F.col("floor_") if floor is not None else 0))).drop("before_", "after_", "floor_")


def autocorrelation(df: DataFrame, by: list[str], max_lag: int) -> DataFrame:
    """(by..., lag, r): zero-mean products averaged over the overlap and divided by lag 0's, for lags 0..max_lag.

    A track's curve is gathered once, with one shuffle by track, and all its lags come from that array."""
    from .series import acf, gathered

    return gathered(df, by).select(*by, F.posexplode(acf(F.col("values"), max_lag)).alias("lag", "r"))
