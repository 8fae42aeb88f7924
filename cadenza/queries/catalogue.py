"""The relational form of the engine's operators over the driver's tables, with equivalent SQL.

Signal model: a band is an event type, a frame an hour since 2024 began, energy the sum of values; embeddings
stand in for magnitude spectra of 64 bins, orders for tracks, and parts, pages and documents for files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import onset, spectrum, tempo

from .registry import QUERIES, SQL, query, r6
from .registry import table as _t


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- the event signal ----
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(band, frame, energy) over every hour from the first event's to the last one's, 0 where a band has no event."""
    frame = F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) as int)")
    sums = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("band"), frame.alias("frame")).agg(F.sum("value").alias("energy"))
    ends = sums.groupBy("band").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))  # one row a band
    every = W.partitionBy(F.lit(0))
    ends = ends.select("band", F.min("first").over(every).alias("first"), F.max("last").over(every).alias("last"))
    dense = ends.select("band", F.explode(F.sequence("first", "last")).alias("frame"))
    return dense.join(sums, ["band", "frame"], "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))


def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onset.spectral_flux(grid(spark, sf_dir), ["band"], gamma=1.0)


def band_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onset.novelty(flux(spark, sf_dir), ["band"], 3)


def broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onset.broadband(band_novelty(spark, sf_dir), [])


def one(df: DataFrame) -> DataFrame:
    """A constant track key, for operators that work per track."""
    return df.withColumn("track", F.lit(0))


GRID_SQL = """WITH RECURSIVE g AS (SELECT b.band, f.frame::INT AS frame, coalesce(e.energy, 0) AS energy
 FROM (SELECT DISTINCT event_type AS band FROM events) b CROSS JOIN (SELECT unnest(range(min(h), max(h) + 1)) AS frame FROM (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS h FROM events)) f
 LEFT JOIN (SELECT event_type AS band, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS frame, sum(value) AS energy FROM events GROUP BY ALL) e
 ON e.band = b.band AND e.frame = f.frame),
x AS (SELECT *, coalesce(greatest(ln(1 + energy) - lag(ln(1 + energy)) OVER (PARTITION BY band ORDER BY frame), 0), 0) AS flux FROM g),
n AS (SELECT *, greatest(flux - avg(flux) OVER (PARTITION BY band ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) AS v FROM x),
w AS (SELECT frame, sum(CASE WHEN m > 0 THEN v / m ELSE 0 END) AS v FROM (SELECT *, avg(v) OVER (PARTITION BY band) AS m FROM n) GROUP BY frame),
c AS (SELECT frame, v - avg(v) OVER () AS p FROM w),
ra AS (SELECT l.lag, sum(a.p * b.p) / count(*) AS r FROM (SELECT unnest(range(49)) AS lag) l JOIN c a ON true JOIN c b ON b.frame = a.frame + l.lag GROUP BY l.lag),
r AS (SELECT lag, CASE WHEN z > 0 THEN r / z ELSE r END AS r FROM (SELECT *, max(CASE WHEN lag = 0 THEN r END) OVER () AS z FROM ra)),
s AS (SELECT p.period, sum(coalesce(r.r, 0) / k.k) / (1 + 1/2 + 1/3 + 1/4) AS salience FROM (SELECT unnest(range(2, 49)) AS period) p CROSS JOIN (SELECT unnest(range(1, 5)) AS k) k
 LEFT JOIN r ON r.lag = p.period * k.k GROUP BY p.period),
pk AS (SELECT band, frame, v FROM (SELECT *, lag(v) OVER o AS b, lead(v) OVER o AS a, avg(v) OVER (PARTITION BY band) AS m FROM n WINDOW o AS (PARTITION BY band ORDER BY frame)) WHERE v > b AND v >= a AND v > m)
"""


@query(GRID_SQL + "SELECT band, frame, round(energy, 6) AS energy FROM g")
def band_energy_grid(spark, sf_dir):
    return grid(spark, sf_dir).select("band", "frame", r6("energy"))


@query(GRID_SQL + "SELECT band, frame, round(flux, 6) AS flux FROM x")
def spectral_flux(spark, sf_dir):
    return flux(spark, sf_dir).select("band", "frame", r6("flux"))


@query(GRID_SQL + "SELECT band, frame, round(v, 6) AS v FROM n")
def novelty_moving_mean(spark, sf_dir):
    return band_novelty(spark, sf_dir).select("band", "frame", r6("v"))


@query(GRID_SQL + "SELECT frame, round(v, 6) AS v FROM w")
def broadband_novelty(spark, sf_dir):
    return broad(spark, sf_dir).select("frame", r6("v"))


def _acf(spark, sf_dir):
    return onset.autocorrelation(one(broad(spark, sf_dir)), ["track"], 48)


@query(GRID_SQL + "SELECT lag::INT AS lag, round(r, 6) AS r FROM r")
def autocorrelation(spark, sf_dir):
    return _acf(spark, sf_dir).select("lag", r6("r"))


@query(GRID_SQL + "SELECT period::INT AS period, round(salience, 6) AS salience FROM s")
def comb_salience(spark, sf_dir):
    return tempo.comb_salience(_acf(spark, sf_dir), (2, 48), 4).select("period", r6("salience"))


@query("SELECT bpm::INT AS bpm, round(exp(-0.5 * pow(log2(bpm / 115.0) / 0.7, 2)), 6) AS weight FROM (SELECT unnest(range(60, 221)) AS bpm)")
def tempo_weighting(spark, sf_dir):
    return spark.range(60, 221).select(F.col("id").cast("int").alias("bpm"), F.round(tempo.tempo_weight(F.col("id").cast("double"), 115.0, 0.7), 6).alias("weight"))


def peaks_of_bands(spark, sf_dir):
    return onset.peaks(band_novelty(spark, sf_dir), ["band"], floor=F.avg("v").over(W.partitionBy("band")))


@query(GRID_SQL + "SELECT band, frame, round(v, 6) AS v FROM pk")
def novelty_peaks(spark, sf_dir):
    return peaks_of_bands(spark, sf_dir).select("band", "frame", r6("v"))


@query(GRID_SQL + "SELECT g.band, g.frame, min(abs(g.frame - pk.frame))::DOUBLE AS distance FROM g LEFT JOIN pk USING (band) WHERE g.frame % 12 = 0 GROUP BY g.band, g.frame")
def nearest_peak_asof(spark, sf_dir):
    beats = grid(spark, sf_dir).where("frame % 12 = 0").select("band", "frame")
    return tempo.nearest(beats, peaks_of_bands(spark, sf_dir).select("band", "frame"), ["band"])


@query(GRID_SQL + "SELECT band, phase, round(CASE WHEN rest = 0 THEN 0 ELSE mean / rest END, 6) AS contrast FROM (SELECT *, (sum(mean) OVER (PARTITION BY band) - mean) / 3 AS rest, row_number() OVER (PARTITION BY band ORDER BY mean DESC, phase DESC) AS k FROM (SELECT band, frame % 4 AS phase, avg(v) AS mean FROM n GROUP BY ALL)) WHERE k = 1")
def bar_phase(spark, sf_dir):
    rows = band_novelty(spark, sf_dir).withColumnRenamed("frame", "beat")
    return tempo.bar_phase(rows, ["band"]).select("band", "phase", r6("contrast"))


@query("""SELECT i::INT AS band, round(a, 6) AS low_hz, round(b, 6) AS high_hz, floor(a / h)::INT AS first_bin, greatest(floor(a / h) + 1, ceil(b / h))::INT AS end_bin FROM
 (SELECT i, 44100 / 2048.0 AS h, 30.0 * pow(16000 / 30.0, i / 8.0) AS a, 30.0 * pow(16000 / 30.0, (i + 1) / 8.0) AS b FROM (SELECT unnest(range(8)) AS i))""")
def log_bands(spark, sf_dir):
    rows = spark.createDataFrame(spectrum.log_band_edges(8, 30.0, 16000.0, 44100, 2048), "band int, low_hz double, high_hz double, first_bin int, end_bin int")
    return rows.select("band", r6("low_hz"), r6("high_hz"), "first_bin", "end_bin")


@query(GRID_SQL + "SELECT band, frame * 30 // (SELECT max(frame) + 1 FROM g) AS cell, round(max(energy), 6) AS top FROM g GROUP BY ALL")
def max_pool(spark, sf_dir):
    frames = F.max("frame").over(W.partitionBy("band")) + 1
    rows = grid(spark, sf_dir).withColumn("cell", F.floor(F.col("frame") * 30 / frames).cast("int"))
    return rows.groupBy("band", "cell").agg(F.round(F.max("energy"), 6).alias("top"))


# ---- spectra ----
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", "i", (F.col("i") * 100 + 50).cast("double").alias("hz"), F.pow(F.col("x").cast("double"), 2).alias("p"), F.abs(F.col("x").cast("double")).alias("a"))


_BINS = "WITH e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT vec_id, i, i * 100.0 + 50 AS hz, x * x AS p, abs(x) AS a FROM e)\n"


@query(_BINS + "SELECT i, round(avg(a), 6) AS mean FROM b GROUP BY i")
def average_spectrum(spark, sf_dir):
    return bins(spark, sf_dir).groupBy("i").agg(F.round(F.avg("a"), 6).alias("mean"))


@query(_BINS + """, t AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY hz) AS run, sum(p) OVER (PARTITION BY vec_id) AS total, max(CASE WHEN hz >= 20 THEN p END) OVER (PARTITION BY vec_id) AS top FROM b)
SELECT vec_id, max(hz) FILTER (p = top)::DOUBLE AS peak_hz, round(sum(hz * p) / sum(p), 6) AS centroid_hz, min(hz) FILTER (run >= 0.95 * total)::DOUBLE AS rolloff_95_hz, max(hz) FILTER (p >= top * 1e-4)::DOUBLE AS high_cutoff_hz FROM t GROUP BY vec_id""")
def spectrum_summary(spark, sf_dir):
    return spectrum.summary(bins(spark, sf_dir), ["vec_id"]).withColumn("centroid_hz", F.round("centroid_hz", 6))


# ---- collections ----
@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def pair_by_stem(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_reports(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


from . import collection, exports, sections, signal, spectra  # noqa: E402, F401  the other queries enter the registry
