"""Tempo curves, octave rules and beat grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def comb_salience(acf: DataFrame, periods: tuple[int, int], pulses: int, penalty: float = 0.0) -> DataFrame:
    """(period, salience): 1/k-weighted mean of the autocorrelation at the period's first `pulses` multiples, beyond the
    last lag 0; less `penalty` times its value half a period before each, for even periods alone."""
    grid = acf.sparkSession.range(periods[0], periods[1] + 1).select(F.col("id").cast("int").alias("period"), F.explode(F.sequence(F.lit(1), F.lit(pulses))).alias("k"))
    joined = grid.join(acf.select("lag", "r"), F.col("lag") == F.col("period") * F.col("k"), "left")
    if penalty:
        gap = acf.select(F.col("lag").alias("gap"), F.col("r").alias("g"))
        joined = joined.join(gap, F.col("gap") * 2 == F.col("period") * (2 * F.col("k") - 1), "left").withColumn("r", F.coalesce("r", F.lit(0.0)) - penalty * F.coalesce("g", F.lit(0.0)))
    weights = sum(1 / k for k in range(1, pulses + 1))
    return joined.groupBy("period").agg((F.sum(F.coalesce("r", F.lit(0.0)) / F.col("k")) / F.lit(weights)).alias("salience"))


def tempo_weight(bpm: Column, centre: float, width: float) -> Column:
    """A log-normal preference of tempi near centre."""
    return F.exp(-0.5 * F.pow(F.log2(bpm / centre) / width, 2))


def snapped(bpm: Column, snap: float) -> Column:
    """The whole number nearest to bpm, halves away from zero, however far it is; bpm itself if snap is 0 or it is not
    finite. How far rounding may move it decides only whether that is found worth saying."""
    finite = bpm.isNotNull() & ~F.isnan(bpm) & (F.abs(bpm) < float("inf"))
    return F.when(F.lit(snap > 0) & finite, F.round(bpm)).otherwise(bpm)


def bar_phase(df: DataFrame, by: list[str], beats: int = 4) -> DataFrame:
    """(by..., phase, contrast): the beat of the bar with the greatest mean, and that over the mean of the others."""
    means = df.groupBy(*by, (F.col("beat") % beats).alias("phase")).agg(F.avg("v").alias("mean"))
    w = W.partitionBy(*by)
    rest = (F.sum("mean").over(w) - F.col("mean")) / (F.count("*").over(w) - 1)
    rank = F.row_number().over(w.orderBy(F.desc("mean"), F.desc("phase")))
    return means.withColumn("contrast", F.when(rest == 0, 0.0).otherwise(F.col("mean") / rest)).withColumn("rank", rank).where("rank = 1").select(*by, "phase", "contrast")


def nearest(points: DataFrame, targets: DataFrame, by: list[str], on: str = "frame") -> DataFrame:
    """Adds `distance` to the nearest target of the same group: an as-of join to both sides by one union. Each side is a
    running last value, forwards and backwards, so the work grows with the rows; null without targets."""
    both = points.select(*by, on, F.lit(None).cast("double").alias("t")).unionByName(targets.select(*by, on, F.col(on).cast("double").alias("t")))
    w, upto = W.partitionBy(*by), (W.unboundedPreceding, 0)
    before = F.last("t", ignorenulls=True).over(w.orderBy(F.asc(on), F.asc_nulls_last("t")).rowsBetween(*upto))
    after = F.last("t", ignorenulls=True).over(w.orderBy(F.desc(on), F.asc_nulls_last("t")).rowsBetween(*upto))
    marked = both.withColumn("before_", before).withColumn("after_", after).where("t is null")
    return marked.select(*by, on, F.least(F.col(on) - F.col("before_"), F.col("after_") - F.col(on)).alias("distance"))


def matched(beats: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """(by..., matched_fraction, mean_error) of nearest()'s rows: the share within the tolerance and their mean distance,
    null if there are none."""
    near = F.col("distance") <= tolerance
    return beats.groupBy(*by).agg((F.count_if(near) / F.count("*")).alias("matched_fraction"), F.avg(F.when(near, F.col("distance"))).alias("mean_error"))


def hops(df: DataFrame, window: int, hop: int, frames: Column) -> DataFrame:
    """Each row once for every full window [start, start + window) of `frames` frames that holds it, as `start`."""
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - window + 1) / hop)).cast("int")
    last = F.least(F.floor(F.col("frame") / hop), F.floor((frames - window) / hop)).cast("int")
    return df.where(first <= last).withColumn("start", F.explode(F.transform(F.sequence(first, last), lambda i: i * hop)))


def stability(lists: DataFrame, by: list[str], values: str, reference: Column, within: float = 0.01) -> DataFrame:
    """(by..., median, iqr, agreeing, split) of sorted arrays: nearest-rank median and quartile range, and the shares
    within a fraction of the reference and of its double or half. Empty arrays have null, null, 0, 0."""
    rows = lists.withColumn("ref_", reference)
    a, ref = F.col(values), F.col("ref_")
    near = lambda x, to: F.abs(x - to) / to < within
    share = lambda test: F.when(F.size(a) > 0, F.size(F.filter(a, test)) / F.size(a)).otherwise(0.0)
    iqr = nearest_rank(a, 0.75) - nearest_rank(a, 0.25)
    return rows.select(*by, nearest_rank(a, 0.5).alias("median"), iqr.alias("iqr"), share(lambda x: near(x, ref)).alias("agreeing"), share(lambda x: near(x, 2 * ref) | near(x, ref / 2)).alias("split"))


def nearest_rank(values: Column, q: float) -> Column:
    """The element of a sorted array at round((n - 1) * q), halves away from zero; null if it is empty."""
    return F.when(F.size(values) > 0, F.try_element_at(values, F.greatest(F.lit(1), (F.round((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))))
