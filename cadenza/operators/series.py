"""Curves kept as one array a track: lookups between their points, autocorrelation, combs, candidates and beat grids.

An array is one track's curve, some ten thousand numbers at most; all of this is columns of a row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def gathered(rows: DataFrame, by: list[str], order: str = "frame", value: str = "v") -> DataFrame:
    """(by..., values): each track's rows as one array in order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return rows.groupBy(*by).agg(F.transform(pairs, lambda x: x["v"]).alias("values"))


def linear_at(values: Column, x: Column) -> Column:
    """The curve at a fractional index: linear, its last value up to one step beyond, 0 outside."""
    low = F.floor(x).cast("int")
    a = F.get(values, low)
    return F.when((x < 0) | a.isNull(), 0.0).otherwise(a + (F.coalesce(F.get(values, low + 1), a) - a) * (x - low))


def quadratic_at(values: Column, x: Column) -> Column:
    """The curve at a fractional index by the parabola through the nearest three points, linear at the ends, 0 outside."""
    near = F.floor(x + 0.5).cast("int")
    a, b, c, t = F.get(values, near - 1), F.get(values, near), F.get(values, near + 1), x - near
    bent = b + 0.5 * t * (c - a) + 0.5 * t * t * (c - 2 * b + a)
    return F.when(x < 0, 0.0).when((near >= 1) & (near + 1 < F.size(values)), bent).otherwise(linear_at(values, x))


def acf(values: Column, max_lag: int) -> Column:
    """Zero-mean products over lags 0..max_lag, averaged over the overlap and divided by lag 0's; 0 beyond the curve."""

    def of(centred: Column) -> Column:
        def product(lag: Column) -> Column:
            n = F.size(centred) - lag
            return F.when(n <= 0, 0.0).otherwise(total(F.zip_with(F.slice(centred, 1, n), F.slice(centred, lag + 1, n), lambda p, q: p * q)) / n)

        return let(F.transform(F.sequence(F.lit(0), F.lit(max_lag)), product), lambda raw: F.transform(raw, lambda r: F.when(F.get(raw, F.lit(0)) > 0, r / F.get(raw, F.lit(0))).otherwise(r)))

    return let(total(values) / F.size(values), lambda mean: let(F.transform(values, lambda v: v - mean), of))


def comb(curve: Column, lag: Column, pulses: int, penalty: float = 0.0) -> Column:
    """1/k-weighted mean of the autocorrelation at the first `pulses` multiples of a lag, less `penalty` times its value
    half a lag before each."""
    teeth = [(quadratic_at(curve, lag * k) - (penalty * quadratic_at(curve, lag * (k - 0.5)) if penalty else F.lit(0.0))) / k for k in range(1, pulses + 1)]
    return sum(teeth[1:], teeth[0]) / sum(1 / k for k in range(1, pulses + 1))


def vertex(a: Column, b: Column, c: Column) -> Column:
    """How far from the middle of three points their parabola peaks, within half a step."""
    bend = a - 2 * b + c
    return F.when(F.abs(bend) > 2.220446049250313e-16, F.least(F.greatest(0.5 * (a - c) / bend, F.lit(-0.5)), F.lit(0.5))).otherwise(0.0)


def candidates(places: Column, values: Column, step: float, weight: Callable[[Column], Column], apart: float = 1.0, most: int = 5) -> Column:
    """The peaks of a curve as an array of struct<place, value, weighted> by falling weighted value: places refined by a
    parabola, none within `apart` of one before, at most `most`."""
    v = lambda i: F.get(values, i)
    inner = F.filter(F.sequence(F.lit(1), F.size(values) - 2), lambda i: (v(i) > v(i - 1)) & (v(i) >= v(i + 1)) & (v(i) > 0))
    placed = F.transform(inner, lambda i: F.struct((F.get(places, i) + vertex(v(i - 1), v(i), v(i + 1)) * step).alias("place"), v(i).alias("value"), i.alias("i")))
    ranked = F.array_sort(F.transform(placed, lambda p: F.struct((-p["value"] * weight(p["place"])).alias("rank"), p["i"].alias("i"), p["place"].alias("place"), p["value"].alias("value"))))
    none = F.expr("cast(array() as array<struct<place:double,value:double,weighted:double>>)")
    one = lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value"), (-x["rank"]).alias("weighted"))
    kept = F.aggregate(ranked, none, lambda kept, x: F.when(F.exists(kept, lambda k: F.abs(k["place"] - x["place"]) < apart), kept).otherwise(F.concat(kept, F.array(one(x)))))
    return F.when(F.size(values) >= 3, F.slice(kept, 1, most)).otherwise(none)


def aligned(values: Column, lag: Column) -> Column:
    """struct<offset, beats, pulse_ratio> of the best phase of beats `lag` frames apart: offsets a tenth of a frame apart
    or less, the first one on ties, scored by the curve on all beats; the ratio is their mean over the curve's."""
    beats = F.greatest(F.floor((F.size(values) - 1) / lag), F.lit(0)).cast("int")
    steps = F.greatest(F.ceil(lag * 10).cast("int"), F.lit(1))

    def scored(step: Column) -> Column:
        offset = step * lag / steps
        score = total(F.transform(F.sequence(F.lit(0), beats), lambda k: linear_at(values, offset + k * lag)))
        return F.struct(score.alias("score"), (-step).alias("order"), offset.alias("offset"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), steps - 1), scored))
    mean = total(values) / F.size(values)
    return let(best, lambda b: F.struct(b["offset"].alias("offset"), (beats + 1).alias("beats"), F.when(mean > 0, b["score"] / (beats + 1) / mean).otherwise(0.0).alias("pulse_ratio")))


def magnitude(values: Column, omega: Column) -> Column:
    """|sum of values[i] * exp(-j * omega * i)|: a spectrum's magnitude at a frequency between its bins."""
    at = lambda f: total(F.transform(values, lambda x, i: x * f(omega * i)))
    return F.hypot(at(F.cos), at(F.sin))


def windows(values: Column, window: int, hop: int) -> Column:
    """The full stretches of `window` points, `hop` apart, as struct<start, values>; none if the curve is shorter."""
    starts = F.when(F.size(values) >= window, F.sequence(F.lit(0), F.size(values) - window, F.lit(hop))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(values, s + 1, window).alias("values")))


def hann(values: Column) -> Column:
    n = F.size(values)
    return F.transform(values, lambda x, i: x * (0.5 - 0.5 * F.cos(2 * F.pi() * i / n)))
