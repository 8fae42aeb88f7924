"""Tempo, beat and spectrum operators on curves kept as arrays, over the event signal of `catalogue`."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import findings, series, structure, tempo

from .catalogue import GRID_SQL, band_novelty, broad, one
from .registry import query, r6, table

LAGS = 120

#: From GRID_SQL: band curves (bl), their autocorrelation (ar: band, lag, r), a comb over periods 6, 6.5 .. 36 (cs).
_QUAD = """CASE WHEN {x} < 0 THEN 0 WHEN floor({x} + 0.5) >= 1 AND floor({x} + 0.5) + 1 < len({l}) THEN
 {l}[(floor({x} + 0.5))::INT + 1] + 0.5 * ({x} - floor({x} + 0.5)) * ({l}[(floor({x} + 0.5))::INT + 2] - {l}[(floor({x} + 0.5))::INT])
 + 0.5 * pow({x} - floor({x} + 0.5), 2) * ({l}[(floor({x} + 0.5))::INT + 2] - 2 * {l}[(floor({x} + 0.5))::INT + 1] + {l}[(floor({x} + 0.5))::INT])
 WHEN floor({x})::INT >= len({l}) THEN 0 WHEN floor({x})::INT + 1 >= len({l}) THEN {l}[floor({x})::INT + 1]
 ELSE {l}[floor({x})::INT + 1] + ({l}[floor({x})::INT + 2] - {l}[floor({x})::INT + 1]) * ({x} - floor({x})) END"""


def _quad(array: str, x: str) -> str:
    return _QUAD.replace("{l}", array).replace("{x}", f"({x})")


_COMB = (
    GRID_SQL
    + f""", ac AS (SELECT band, frame, v - avg(v) OVER (PARTITION BY band) AS p FROM n),
aa AS (SELECT a.band, l.lag, sum(a.p * b.p) / count(*) AS r FROM (SELECT unnest(range({LAGS + 1})) AS lag) l JOIN ac a ON true JOIN ac b ON b.band = a.band AND b.frame = a.frame + l.lag GROUP BY ALL),
ar AS (SELECT band, list(CASE WHEN z > 0 THEN r / z ELSE r END ORDER BY lag) AS l FROM (SELECT *, max(CASE WHEN lag = 0 THEN r END) OVER (PARTITION BY band) AS z FROM aa) GROUP BY band),
pe AS (SELECT i, 6 + i * 0.5 AS period FROM (SELECT unnest(range(61)) AS i)),
cs AS (SELECT band, i, period, ("""
    + " + ".join(f"({_quad('l', f'period * {k}')} - 0.25 * {_quad('l', f'period * {k - 0.5}')}) / {k}" for k in (1, 2, 3))
    + """) / (1 + 1/2 + 1/3) AS salience FROM ar CROSS JOIN pe)
"""
)


def curves(spark, sf_dir):
    """(band, values, acf): each band's novelty curve and its autocorrelation."""
    rows = series.gathered(band_novelty(spark, sf_dir), ["band"])
    return rows.withColumn("acf", series.acf(F.col("values"), LAGS))


def combs(spark, sf_dir):
    """(band, periods, saliences): a comb of three pulses with a penalty over periods 6 to 36, half a frame apart."""
    periods = F.array(*[F.lit(6 + i * 0.5) for i in range(61)])
    rows = curves(spark, sf_dir).withColumn("periods", periods)
    each = rows.select("band", "acf", F.posexplode("periods").alias("i", "period")).withColumn("salience", series.comb(F.col("acf"), F.col("period"), 3, 0.25))
    pairs = F.sort_array(F.collect_list(F.struct("i", "period", "salience")))
    return each.groupBy("band").agg(pairs.alias("c")).select("band", F.transform("c", lambda x: x["period"]).alias("periods"), F.transform("c", lambda x: x["salience"]).alias("saliences"))


@query(_COMB + "SELECT band, period::DOUBLE AS period, round(salience, 6) AS salience FROM cs")
def comb_with_penalty(spark, sf_dir):
    rows = combs(spark, sf_dir).select("band", F.arrays_zip("periods", "saliences").alias("z")).select("band", F.explode("z").alias("z"))
    return rows.select("band", F.col("z.periods").alias("period"), F.round("z.saliences", 6).alias("salience"))


@query(
    _COMB
    + """, pk0 AS (SELECT band, i, period, salience AS b, lag(salience) OVER w AS a, lead(salience) OVER w AS c FROM cs WINDOW w AS (PARTITION BY band ORDER BY i)),
pk1 AS (SELECT band, i, b AS value, period + (CASE WHEN abs(a - 2 * b + c) > 2.3e-16 THEN least(greatest(0.5 * (a - c) / (a - 2 * b + c), -0.5), 0.5) ELSE 0 END) * 0.5 AS place FROM pk0 WHERE b > a AND b >= c AND b > 0),
pk2 AS (SELECT *, value * exp(-0.5 * pow(log2(place / 16.0) / 0.7, 2)) AS weighted FROM pk1),
pk3 AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY weighted DESC, i) AS k FROM pk2),
nm(band, k, kept) AS (SELECT DISTINCT band, 0::BIGINT, []::DOUBLE[] FROM pk3 UNION ALL SELECT nm.band, nm.k + 1, CASE WHEN len(list_filter(nm.kept, lambda x: abs(x - p.place) < 1.0)) > 0 THEN nm.kept ELSE list_append(nm.kept, p.place) END
 FROM nm JOIN pk3 p ON p.band = nm.band AND p.k = nm.k + 1),
fin AS (SELECT band, arg_max(kept, k) AS kept FROM nm GROUP BY band)
SELECT band, r.rank::INT AS rank, round(p.place, 6) AS period, round(p.value, 6) AS salience, round(p.weighted, 6) AS weighted FROM
 (SELECT band, unnest(kept) AS place, generate_subscripts(kept, 1) AS rank FROM fin) r JOIN pk3 p USING (band, place) WHERE r.rank <= 5"""
)
def tempo_candidates(spark, sf_dir):
    found = series.candidates(F.col("periods"), F.col("saliences"), 0.5, lambda p: tempo.tempo_weight(p, 16.0, 0.7))
    rows = combs(spark, sf_dir).select("band", F.posexplode(found).alias("i", "c"))
    return rows.select("band", (F.col("i") + 1).alias("rank"), F.round("c.place", 6).alias("period"), F.round("c.value", 6).alias("salience"), F.round("c.weighted", 6).alias("weighted"))


@query(_COMB + "SELECT band, arg_max(period, struct_pack(s := salience, i := i))::DOUBLE AS period, round(max(salience), 6) AS salience FROM cs GROUP BY band")
def best_period_per_band(spark, sf_dir):
    best = F.array_max(F.arrays_zip("saliences", "periods"))
    return combs(spark, sf_dir).select("band", best.alias("b")).select("band", F.col("b.periods").alias("period"), F.round("b.saliences", 6).alias("salience"))


@query(
    _COMB
    + f""", bl AS (SELECT band, list(salience ORDER BY i) AS l, arg_max(period, struct_pack(s := salience, i := i)) AS best FROM cs GROUP BY band),
lv AS (SELECT * FROM (VALUES ('half', 0.5::DOUBLE), ('two-thirds', 2/3::DOUBLE), ('candidate', 1.0), ('three-halves', 1.5), ('double', 2.0)) AS t(label, ratio))
SELECT band, label, round(best / ratio, 6) AS period, round({_quad('l', '(best / ratio - 6) / 0.5')}, 6) AS salience FROM bl CROSS JOIN lv"""
)
def octave_relatives(spark, sf_dir):
    levels = F.array(*[F.struct(F.lit(name).alias("label"), F.lit(ratio).alias("ratio")) for name, ratio in (("half", 0.5), ("two-thirds", 2 / 3), ("candidate", 1.0), ("three-halves", 1.5), ("double", 2.0))])
    rows = combs(spark, sf_dir).withColumn("best", F.array_max(F.arrays_zip("saliences", "periods"))["periods"]).select("band", "saliences", "best", F.explode(levels).alias("x"))
    period = F.col("best") / F.col("x.ratio")
    return rows.select("band", "x.label", F.round(period, 6).alias("period"), F.round(series.quadratic_at(F.col("saliences"), (period - 6) / 0.5), 6).alias("salience"))


@query(
    GRID_SQL
    + """, wl AS (SELECT list(v ORDER BY frame) AS l FROM w), ws AS (SELECT s.start, i.i, l[s.start + i.i + 1] * (0.5 - 0.5 * cos(2 * pi() * i.i / 240)) AS x FROM wl, (SELECT unnest(range(0, 100000, 120)) AS start) s, (SELECT unnest(range(240)) AS i) i WHERE s.start + 240 <= len(l)),
fr AS (SELECT unnest(range(5, 61)) AS cycles), mg AS (SELECT start, cycles, sqrt(pow(sum(x * cos(2 * pi() * cycles / 240.5 * i)), 2) + pow(sum(x * sin(2 * pi() * cycles / 240.5 * i)), 2)) AS m FROM ws CROSS JOIN fr GROUP BY ALL),
av AS (SELECT cycles, avg(m) AS m FROM mg GROUP BY cycles)
SELECT cycles::INT AS cycles, round(m / max(m) OVER (), 6) AS salience FROM av"""
)
def fourier_tempogram(spark, sf_dir):
    rows = series.gathered(one(broad(spark, sf_dir)), ["track"]).select("track", F.explode(series.windows(F.col("values"), 240, 120)).alias("w"))
    rows = rows.select("track", series.hann(F.col("w.values")).alias("x"), F.explode(F.sequence(F.lit(5), F.lit(60))).alias("cycles"))
    mean = rows.withColumn("m", series.magnitude(F.col("x"), 2 * F.pi() * F.col("cycles") / 240.5)).groupBy("track", "cycles").agg(F.avg("m").alias("m"))
    from pyspark.sql import Window as W

    return mean.withColumn("salience", F.round(F.col("m") / F.max("m").over(W.partitionBy("track")), 6)).select("cycles", "salience")


@query(
    GRID_SQL
    + """, wn AS (SELECT w.frame - s.start AS i, s.start, v FROM w JOIN (SELECT unnest(range(0, 100000, 120)) AS start) s ON w.frame >= s.start AND w.frame < s.start + 240 WHERE s.start + 240 <= (SELECT max(frame) + 1 FROM w)),
wc AS (SELECT start, i, v - avg(v) OVER (PARTITION BY start) AS p FROM wn), wa AS (SELECT a.start, l.lag, sum(a.p * b.p) / count(*) AS r FROM (SELECT unnest(range(49)) AS lag) l JOIN wc a ON true JOIN wc b ON b.start = a.start AND b.i = a.i + l.lag GROUP BY ALL),
wz AS (SELECT start, lag, CASE WHEN z > 0 THEN r / z ELSE r END AS r FROM (SELECT *, max(CASE WHEN lag = 0 THEN r END) OVER (PARTITION BY start) AS z FROM wa)),
wk AS (SELECT start, p.period, (max(r) FILTER (lag = p.period) + max(r) FILTER (lag = 2 * p.period) / 2) / 1.5 AS salience FROM wz JOIN (SELECT unnest(range(6, 25)) AS period) p ON lag = p.period OR lag = 2 * p.period GROUP BY ALL)
SELECT start::INT AS start, arg_max(period, struct_pack(s := salience, p := period))::INT AS period, round(max(salience), 6) AS salience FROM wk GROUP BY start"""
)
def tempo_over_time(spark, sf_dir):
    rows = series.gathered(one(broad(spark, sf_dir)), ["track"]).select(F.explode(series.windows(F.col("values"), 240, 120)).alias("w"))
    rows = rows.select("w.start", series.acf(F.col("w.values"), 48).alias("acf")).select("start", "acf", F.explode(F.sequence(F.lit(6), F.lit(24))).alias("period"))
    best = F.max(F.struct(series.comb(F.col("acf"), F.col("period").cast("double"), 2).alias("s"), "period"))
    return rows.groupBy("start").agg(best.alias("b")).select("start", "b.period", F.round("b.s", 6).alias("salience"))


@query(
    """WITH c AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS a FROM orders GROUP BY o_custkey), m AS (SELECT *, a[round((len(a) - 1) * 0.5)::INT + 1] AS mid FROM c)
SELECT o_custkey, mid AS median, a[round((len(a) - 1) * 0.75)::INT + 1] - a[round((len(a) - 1) * 0.25)::INT + 1] AS iqr, len(list_filter(a, lambda x: abs(x - mid) / mid < 0.1)) / len(a) AS agreeing,
 len(list_filter(a, lambda x: abs(x - 2 * mid) / (2 * mid) < 0.1 OR abs(x - mid / 2) / (mid / 2) < 0.1)) / len(a) AS split FROM m"""
)
def stability_shares(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_totalprice")).alias("a"))
    return tempo.stability(lists, ["o_custkey"], "a", tempo.nearest_rank(F.col("a"), 0.5), 0.1)


@query(
    GRID_SQL
    + """, bl AS (SELECT band, list(v ORDER BY frame) AS l, avg(v) AS mean FROM n GROUP BY band), st AS (SELECT unnest(range(245)) AS step), bt AS (SELECT band, l, mean, step, step * 24.5 / 245 AS o, unnest(range(0, floor((len(l) - 1) / 24.5)::INT + 1)) AS k FROM bl CROSS JOIN st),
pt AS (SELECT band, mean, step, o, o + k * 24.5 AS x, l FROM bt), sc AS (SELECT band, step, o, any_value(mean) AS mean, count(*) AS beats, sum(CASE WHEN floor(x)::INT >= len(l) THEN 0 ELSE l[floor(x)::INT + 1] + (coalesce(l[floor(x)::INT + 2], l[floor(x)::INT + 1]) - l[floor(x)::INT + 1]) * (x - floor(x)) END) AS score FROM pt GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY round(score, 9) DESC, step) AS k FROM sc)
SELECT band, round(o, 6) AS offset_frames, beats::INT AS beats, round(CASE WHEN mean > 0 THEN score / beats / mean ELSE 0 END, 6) AS pulse_ratio FROM rk WHERE k = 1"""
)
def beat_align(spark, sf_dir):
    rows = curves(spark, sf_dir).select("band", series.aligned(F.col("values"), F.lit(24.5)).alias("g"))
    return rows.select("band", F.round("g.offset", 6).alias("offset_frames"), "g.beats", F.round("g.pulse_ratio", 6).alias("pulse_ratio"))


@query(
    GRID_SQL
    + """, be AS (SELECT b.band, k * 24.5 + 3.25 AS beat FROM (SELECT DISTINCT band FROM n) b, (SELECT unnest(range(29)) AS k)),
d AS (SELECT be.band, be.beat, min(abs(pk.frame - be.beat)) AS distance FROM be LEFT JOIN pk USING (band) GROUP BY ALL)
SELECT band, round(count(*) FILTER (distance <= 2) / count(*), 6) AS matched_fraction, round(avg(distance) FILTER (distance <= 2), 6) AS mean_error FROM d GROUP BY band"""
)
def beat_matches(spark, sf_dir):
    from .catalogue import peaks_of_bands

    bands = band_novelty(spark, sf_dir).select("band").distinct()
    beats = bands.select("band", F.explode(F.transform(F.sequence(F.lit(0), F.lit(28)), lambda k: k * 24.5 + 3.25)).alias("frame"))
    near = tempo.nearest(beats, peaks_of_bands(spark, sf_dir).select("band", F.col("frame").cast("double").alias("frame")), ["band"])
    return tempo.matched(near, ["band"], 2.0).select("band", r6("matched_fraction"), r6("mean_error"))


@query("SELECT t.phase::INT AS phase, (i.i - t.phase) // 4 AS bar, (i.i * 0.5)::DOUBLE AS start_seconds FROM (SELECT unnest(range(4)) AS phase) t, (SELECT unnest(range(17)) AS i) i WHERE i.i >= t.phase AND (i.i - t.phase) % 4 = 0")
def bar_starts(spark, sf_dir):
    beats = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: k * 0.5)
    return spark.range(4).select(F.col("id").cast("int").alias("phase"), F.posexplode(structure.bar_starts(beats, F.col("id"))).alias("bar", "start_seconds"))


@query("SELECT o_orderkey, CASE WHEN abs(b - round(b)) < 1e-9 THEN printf('%.0f', b) ELSE printf('%.2f', b) END AS bpm FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN round(60 + (o_totalprice / 1000) % 160) ELSE floor((60 + (o_totalprice / 1000) % 160) * 8) / 8 + 0.001 END AS b FROM orders)")
def format_bpm(spark, sf_dir):
    raw = 60 + (F.col("o_totalprice") / 1000) % 160
    bpm = F.when(F.col("o_orderkey") % 3 == 0, F.round(raw)).otherwise(F.floor(raw * 8) / 8 + 0.001)
    return table(spark, sf_dir, "orders").select("o_orderkey", findings.format_bpm(bpm).alias("bpm"))


@query(GRID_SQL + "SELECT band, round(count(*) FILTER (v > b AND v >= a AND v > m) / count(*) * 24, 6) AS per_day FROM (SELECT band, v, lag(v) OVER o AS b, lead(v) OVER o AS a, avg(v) OVER (PARTITION BY band) AS m FROM n WINDOW o AS (PARTITION BY band ORDER BY frame)) GROUP BY band")
def onset_density(spark, sf_dir):
    from cadenza.operators import energy

    return energy.onset_density(band_novelty(spark, sf_dir), ["band"], 24.0).select("band", F.round("onset_density", 6).alias("per_day"))


@query(
    GRID_SQL
    + """, pl AS (SELECT frame, v, CASE WHEN frame + 0.4 >= (SELECT max(frame) + 1 FROM w) THEN 0 ELSE v + (coalesce(lead(v) OVER (ORDER BY frame), v) - v) * 0.4 END AS x FROM w) SELECT frame, round(x, 6) AS v FROM pl"""
)
def fractional_lookup(spark, sf_dir):
    rows = series.gathered(one(broad(spark, sf_dir)), ["track"]).select("values", F.posexplode("values").alias("frame", "own"))
    return rows.select("frame", F.round(series.linear_at(F.col("values"), F.col("frame") + F.lit(0.4)), 6).alias("v"))

