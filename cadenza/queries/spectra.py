"""Spectra, keys, energy and waveforms over embeddings as magnitude spectra, and over plain ranges."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import energy, spectrum, tempo, waveform
from cadenza.sources import audio

from .catalogue import GRID_SQL, bins, broad, grid
from .registry import query, r6, table

BINS_SQL = "WITH e AS (SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT vec_id, label, i, i * 100.0 + 50 AS hz, x * x AS p, abs(x) AS a, x FROM e)\n"


@query("SELECT o_orderkey, round(60 + (o_totalprice / 1000) % 160) AS bpm, 60 + (o_totalprice / 1000) % 160 AS unsnapped FROM orders")
def integer_snap(spark, sf_dir):
    bpm = 60 + (F.col("o_totalprice") / 1000) % 160
    return table(spark, sf_dir, "orders").select("o_orderkey", tempo.snapped(bpm, 0.25).alias("bpm"), tempo.snapped(bpm, 0.0).alias("unsnapped"))


@query(GRID_SQL + "SELECT s.start::INT AS start, round(avg(w.v), 6) AS mean_v, round(max(w.v), 6) AS top_v, count(*) AS frames FROM w JOIN (SELECT unnest(range(0, 100000, 24)) AS start) s ON w.frame >= s.start AND w.frame < s.start + 48 WHERE s.start + 48 <= (SELECT max(frame) + 1 FROM w) GROUP BY s.start")
def hopping_window_stats(spark, sf_dir):
    last = F.max("frame").over(W.partitionBy(F.lit(0)))
    rows = tempo.hops(broad(spark, sf_dir).withColumn("n", last + 1), 48, 24, F.col("n"))
    return rows.groupBy("start").agg(F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.max("v"), 6).alias("top_v"), F.count("*").alias("frames"))


@query(
    BINS_SQL
    + """, s AS (SELECT vec_id, i, x * CASE WHEN i < vec_id % 40 THEN 1e-5 ELSE 1 END AS v FROM b), l AS (SELECT vec_id, i // 4 AS w, max(abs(v)) AS level FROM s GROUP BY ALL),
m AS (SELECT *, max(level) OVER (PARTITION BY vec_id) AS peak FROM l)
SELECT vec_id, coalesce(min(CASE WHEN peak > 0 AND level >= peak * 1e-3 THEN w * 4 / 400.0 END), 0)::DOUBLE AS lead_in_seconds FROM m GROUP BY vec_id"""
)
def lead_in(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    rows = rows.withColumn("v", F.col("x").cast("double") * F.when(F.col("i") < F.col("vec_id") % 40, 1e-5).otherwise(1.0))
    return audio.lead_in(rows, ["vec_id"], F.lit(400))


@query(BINS_SQL + "SELECT vec_id, round(sum(CASE WHEN hz < 200 THEN p ELSE 0 END) / sum(p), 6) AS low_share, round(sum(CASE WHEN hz >= 200 AND hz < 4000 THEN p ELSE 0 END) / sum(p), 6) AS mid_share, round(sum(CASE WHEN hz >= 4000 THEN p ELSE 0 END) / sum(p), 6) AS high_share FROM b GROUP BY vec_id")
def band_shares(spark, sf_dir):
    share = lambda test, name: F.round(F.sum(F.when(test, F.col("p")).otherwise(0.0)) / F.sum("p"), 6).alias(name)
    hz = F.col("hz")
    return bins(spark, sf_dir).groupBy("vec_id").agg(share(hz < 200, "low_share"), share((hz >= 200) & (hz < 4000), "mid_share"), share(hz >= 4000, "high_share"))


@query(
    BINS_SQL
    + """, lb AS (SELECT r.r, greatest(floor(lo / 100), 0)::INT AS first, greatest(floor(lo / 100) + 1, ceil(hi / 100))::INT AS stop FROM (SELECT unnest(range(12)) AS r) r, LATERAL (SELECT 100 * pow(64.0, r.r / 12.0) AS lo, 100 * pow(64.0, (r.r + 1) / 12.0) AS hi)),
f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, count(*) OVER (PARTITION BY label) AS frames FROM embeddings),
c AS (SELECT f.label, 11 - lb.r AS row, f.frame * least(7, f.frames) // f.frames AS col, f.vec_id, lb.r, avg(b.a) AS e FROM f JOIN b USING (vec_id) JOIN lb ON b.i >= lb.first AND b.i < lb.stop GROUP BY ALL),
m AS (SELECT label, row, col, 20 * log10(greatest(avg(e), 1e-10)) AS db FROM c GROUP BY ALL)
SELECT label, row::INT AS row, col::INT AS col, round(greatest(db, max(db) OVER (PARTITION BY label) - 12), 6) AS db FROM m"""
)
def spectrogram_cells(spark, sf_dir):
    rows, columns = 12, 7
    order = W.partitionBy("label")
    frames = table(spark, sf_dir, "embeddings").withColumn("frame", F.row_number().over(order.orderBy("vec_id")) - 1).withColumn("frames", F.count("*").over(order))
    return spectrum.spectrogram(frames, ["label"], F.transform("embedding", lambda x: F.abs(x.cast("double"))), [(100 * 64 ** (r / rows), 100 * 64 ** ((r + 1) / rows)) for r in range(rows)], 100.0, columns, 12.0).withColumn("db", F.round("db", 6))


def _profile_sql() -> str:
    rows = [(t, m, p, w[(p - t) % 12]) for m, w in enumerate(spectrum.PROFILES["temperley"]) for t in range(12) for p in range(12)]
    return "(VALUES " + ", ".join(f"({t}, {m} = 1, {p}, {w}::DOUBLE)" for t, m, p, w in rows) + ") AS q(tonic, minor, pitch, w)"


_KEYS = (
    BINS_SQL
    + f""", ch AS (SELECT vec_id, i % 12 AS pitch, sum(p) AS x FROM b GROUP BY ALL), sh AS (SELECT vec_id, pitch, x / sum(x) OVER (PARTITION BY vec_id) AS x FROM ch),
s AS (SELECT vec_id, tonic, minor, sum(x) AS sx, sum(w) AS sw, sum(x * w) AS sxw, sum(x * x) AS sxx, sum(w * w) AS sww FROM sh JOIN {_profile_sql()} USING (pitch) GROUP BY ALL),
k AS (SELECT vec_id, tonic, minor, round(CASE WHEN 12 * sxx - sx * sx > 1e-12 THEN (12 * sxw - sx * sw) / sqrt((12 * sxx - sx * sx) * (12 * sww - sw * sw)) ELSE 0 END, 9) AS correlation FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY correlation DESC, minor, tonic) AS rank FROM k)
"""
)


def _shares(spark, sf_dir):
    notes = bins(spark, sf_dir).groupBy("vec_id", (F.col("i") % 12).alias("pitch")).agg(F.sum("p").alias("x"))
    return notes.withColumn("x", F.col("x") / F.sum("x").over(W.partitionBy("vec_id")))


@query(_KEYS + "SELECT vec_id, tonic, minor, correlation, rank::INT AS rank FROM r")
def key_rank_24(spark, sf_dir):
    return spectrum.rank_keys(_shares(spark, sf_dir), ["vec_id"])


@query(
    _KEYS
    + """, n AS (SELECT vec_id, rank, correlation, (((CASE WHEN minor THEN (tonic + 3) % 12 ELSE tonic END) * 7) % 12 + 7) % 12 + 1 AS num, minor, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][tonic + 1] || CASE WHEN minor THEN ' minor' ELSE ' major' END AS name FROM r WHERE rank <= 2)
SELECT a.vec_id, a.num || CASE WHEN a.minor THEN 'A' ELSE 'B' END AS camelot, a.name, a.num || CASE WHEN a.minor THEN 'B' ELSE 'A' END AS relative, round((a.correlation - b.correlation) / abs(a.correlation), 5) AS margin FROM n a JOIN n b ON b.vec_id = a.vec_id AND a.rank = 1 AND b.rank = 2"""
)
def key_and_margin(spark, sf_dir):
    pairs = F.sort_array(F.collect_list(F.struct("pitch", "x")))
    rows = _shares(spark, sf_dir).groupBy("vec_id").agg(F.transform(pairs, lambda p: p["x"]).alias("chroma")).withColumn("k", spectrum.ranked_keys(F.col("chroma")))
    best, second = F.get("k", F.lit(0)), F.get("k", F.lit(1))
    return rows.select("vec_id", best["camelot"].alias("camelot"), best["name"].alias("name"), spectrum.relative_camelot(best["camelot"]).alias("relative"), F.round(spectrum.margin(best["correlation"], second["correlation"]), 5).alias("margin"))


@query("SELECT t::INT AS tonic, m, (((CASE WHEN m THEN (t + 3) % 12 ELSE t END) * 7) % 12 + 7) % 12 + 1 || CASE WHEN m THEN 'A' ELSE 'B' END AS camelot, ((t + CASE WHEN m THEN 3 ELSE 9 END) % 12)::INT AS relative, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][t + 1] || CASE WHEN m THEN ' minor' ELSE ' major' END AS name FROM (SELECT unnest(range(12)) AS t) CROSS JOIN (VALUES (true), (false)) AS x(m)")
def camelot_wheel(spark, sf_dir):
    keys = spark.range(12).select(F.col("id").cast("int").alias("tonic"), F.explode(F.array(F.lit(True), F.lit(False))).alias("m"))
    t, m = F.col("tonic"), F.col("m")
    return keys.select("tonic", "m", spectrum.camelot(t, m).alias("camelot"), spectrum.relative_tonic(t, m).alias("relative"), spectrum.key_name(t, m).alias("name"))


@query("SELECT n || l AS camelot, (CASE WHEN n BETWEEN 1 AND 12 THEN ((n - 8 + 12) % 12) * 2 + CASE l WHEN 'A' THEN 1 ELSE 0 END END)::INT AS number FROM (SELECT unnest(range(0, 15)) AS n) CROSS JOIN (VALUES ('A'), ('B')) AS x(l)")
def engine_key_number(spark, sf_dir):
    names = spark.range(0, 15).select("id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("letter")).select(F.concat(F.col("id").cast("string"), "letter").alias("camelot"))
    return names.select("camelot", spectrum.camelot_number(F.col("camelot")).cast("int").alias("number"))


@query(
    BINS_SQL
    + """, t AS (SELECT vec_id, log10(avg(a) FILTER (hz >= 2101 AND hz < 16000) / avg(a) FILTER (hz >= 100 AND hz < 276)) AS brightness, sum(p) FILTER (hz >= 4000) / sum(p) AS high_share, 20 * log10(max(a) / sqrt(avg(p))) AS crest_db, (vec_id % 7) * 2.5 AS onset_density FROM b GROUP BY vec_id),
s AS (SELECT *, (brightness + 1.1877) / 0.1940 * 0.5828 + (crest_db - 10.1017) / 1.5277 * -0.3495 + (onset_density - 11.4666) / 1.7940 * 0.5096 + (high_share - 0.0437) / 0.0320 * 0.5277 AS score FROM t)
SELECT vec_id, round(brightness, 6) AS brightness, round(crest_db, 6) AS crest_db, round(high_share, 6) AS high_share, round(score, 5) AS score, CASE WHEN score < -0.5 THEN 'calm' WHEN score < 1 THEN 'club' ELSE 'hard' END AS band, CASE WHEN score < -0.5 THEN 115.0 WHEN score < 1 THEN 140.0 END::DOUBLE AS centre_bpm FROM s"""
)
def energy_bands(spark, sf_dir):
    spectra = bins(spark, sf_dir).select("vec_id", "hz", F.col("a").alias("amplitude"))
    crest = table(spark, sf_dir, "embeddings").select("vec_id", energy.crest_db(F.col("embedding")).alias("crest_db"))
    found = energy.spectral_measures(spectra, ["vec_id"]).join(crest, "vec_id").withColumn("onset_density", (F.col("vec_id") % 7) * 2.5).withColumn("score", energy.score())
    found = found.withColumn("band", energy.band(F.col("score")))
    return found.select("vec_id", r6("brightness"), r6("crest_db"), r6("high_share"), F.round("score", 5).alias("score"), "band", energy.weighting_centre(F.col("band")).alias("centre_bpm"))


@query(
    GRID_SQL
    + """, hc AS (SELECT band, frame * 50 // (SELECT max(frame) + 1 FROM g) AS col, max(energy) AS peak FROM g GROUP BY ALL), l AS (SELECT band, list_sort(list(peak) FILTER (peak > 0)) AS s FROM hc GROUP BY band)
SELECT band, col::INT AS col, round(least(greatest(peak / coalesce(s[least(len(s) * 99 // 100, len(s) - 1) + 1], 1), 0), 1) * 31)::INT AS height FROM hc JOIN l USING (band)"""
)
def waveform_heights(spark, sf_dir):
    last = F.max("frame").over(W.partitionBy("band")) + 1
    rows = grid(spark, sf_dir).withColumn("col", F.floor(F.col("frame") * 50 / last).cast("int"))
    return waveform.heights(rows.groupBy("band", "col").agg(F.max("energy").alias("peak")), ["band"])


@query(
    """WITH c AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, (vec_id % 32)::INT AS height, (vec_id % 8)::INT AS low FROM embeddings), n AS (SELECT label, count(*) AS n FROM c GROUP BY label),
q AS (SELECT n.label, k.c, k.c * n // 6 AS first, greatest((k.c + 1) * n // 6, k.c * n // 6 + 1) AS stop FROM n, (SELECT unnest(range(6)) AS c) k)
SELECT q.label, q.c::INT AS c, max(c.height)::INT AS height, arg_max(c.low, struct_pack(h := c.height, i := c.i))::INT AS low FROM q JOIN c ON c.label = q.label AND c.i >= q.first AND c.i < q.stop GROUP BY ALL"""
)
def waveform_resample(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    column = F.struct((F.col("vec_id") % 32).cast("int").alias("height"), (F.col("vec_id") % 8).cast("int").alias("low"), F.lit(0).alias("mid"), F.lit(0).alias("high"))
    lists = rows.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", column.alias("c")))), lambda x: x["c"]).alias("columns"))
    out = lists.select("label", F.posexplode(waveform.resampled(F.col("columns"), 6)).alias("c", "x"))
    return out.select("label", "c", "x.height", "x.low")


@query("SELECT p_partkey, (p_size % 32 + (p_partkey % 8) * 32 + (p_size % 8) * 256 + (p_partkey % 5) * 2048)::INT AS packed, base64(encode(p_name)) AS coded, greatest(p_partkey % 5, p_size % 8 - 2, 0)::INT AS shade FROM part")
def column_pack(spark, sf_dir):
    from cadenza.operators import naming

    size, key = F.col("p_size"), F.col("p_partkey").cast("int")
    coded = F.base64(F.unbase64(F.base64(F.col("p_name").cast("binary"))))
    return table(spark, sf_dir, "part").select("p_partkey", naming.packed_column(size % 32, key % 8, size % 8, key % 5).alias("packed"), coded.alias("coded"), waveform.shade(size % 8, key % 5).alias("shade"))


@query(
    BINS_SQL
    + """, n AS (SELECT *, lag(a) OVER w AS l, lead(a) OVER w AS r FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY i)), pk AS (SELECT vec_id, i, a, (i + 0.5 * (l - r) / (l - 2 * a + r)) * 100 AS hz FROM n WHERE a > l AND a > r AND i * 100 >= 100 AND i * 100 <= 4000),
s AS (SELECT *, 12 * log2(hz / 440) AS st FROM pk WHERE hz > 0), bk AS (SELECT vec_id, least(greatest(floor((st - (sign(st) * floor(abs(st) + 0.5))) * 100 + 50), 0), 99)::INT AS bucket, a FROM s)
SELECT bucket, round(sum(a), 4) AS weight FROM bk GROUP BY bucket"""
)
def tuning_histogram(spark, sf_dir):
    return spectrum.tuning_buckets(bins(spark, sf_dir).select("vec_id", "i", "a"), ["vec_id"], 100.0).groupBy("bucket").agg(F.round(F.sum("a"), 4).alias("weight"))


@query(
    BINS_SQL
    + """, n AS (SELECT *, lag(a) OVER w AS l, lead(a) OVER w AS r FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY i)), pk AS (SELECT vec_id, a, (i + least(greatest(0.5 * (l - r) / (l - 2 * a + r), -0.5), 0.5)) * 100 AS hz FROM n WHERE a > l AND a > r AND i * 100 >= 55 AND i * 100 <= 3000),
s AS (SELECT vec_id, a, 12 * log2(hz / 440) AS st FROM pk), g AS (SELECT vec_id, a * a AS e, sign(st) * floor(abs(st) + 0.5) AS note FROM s WHERE abs(st - sign(st) * floor(abs(st) + 0.5)) <= 0.33),
c AS (SELECT vec_id, ((note + 9)::INT % 12 + 12) % 12 AS pitch, sum(e) AS e FROM g GROUP BY ALL)
SELECT vec_id, pitch::INT AS pitch, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS share FROM c"""
)
def chroma_fold(spark, sf_dir):
    return spectrum.pitch_shares(bins(spark, sf_dir).select("vec_id", "i", "a"), ["vec_id"], 100.0).withColumn("share", F.round("share", 6))
