"""The arithmetic of device files: string lengths, beat times, phrases, entity ids, overviews and seek points."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import collection, naming, series
from cadenza.exports import entities

from .catalogue import GRID_SQL, grid
from .registry import query, table

_TEXTS = "WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN repeat(p_name, 12) WHEN 2 THEN p_name || ' é日' ELSE p_name || chr(128512) || chr(128513) END AS s FROM part)\n"


def _texts(spark, sf_dir):
    p, k = F.col("p_name"), F.col("p_partkey") % 4
    text = F.when(k == 0, p).when(k == 1, F.repeat(p, 12)).when(k == 2, F.concat(p, F.lit(" é日"))).otherwise(F.concat(p, F.lit("\U0001f600\U0001f601")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.alias("s"))


@query(
    _TEXTS
    + """SELECT k, (CASE WHEN k % 4 < 2 AND length(s) <= 126 THEN 2 * (length(s) + 1) + 1 WHEN k % 4 < 2 THEN 64 ELSE 144 END)::INT AS lead, (CASE WHEN k % 4 < 2 AND length(s) <= 126 THEN length(s) + 1 WHEN k % 4 < 2 THEN length(s) + 4 WHEN k % 4 = 2 THEN 2 * length(s) + 4 ELSE 2 * (length(s) + 2) + 4 END)::INT AS size FROM t"""
)
def devicesql_length(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", naming.device_string_size(F.col("s")).alias("d")).select("k", "d.lead", "d.size")


@query("SELECT l_orderkey, l_linenumber, floor(us / 1000)::BIGINT AS ms, (us % 1000)::INT AS rest, round(l_quantity * 100)::BIGINT AS centi FROM (SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * 1000)::BIGINT AS us FROM lineitem)")
def beat_micros(spark, sf_dir):
    split = collection.beat_micros(F.col("l_extendedprice") / 1000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", split["ms"].alias("ms"), split["rest"].alias("rest"), collection.centi_bpm(F.col("l_quantity")).alias("centi"))


@query("WITH b AS (SELECT i, i * 0.5 AS t FROM (SELECT unnest(range(40)) AS i)), q AS (SELECT o_orderkey, (o_orderkey % 97) * 0.25 - 1 AS s FROM orders) SELECT o_orderkey, (arg_min(i, struct_pack(d := abs(t - s), i := i)) + 1)::INT AS beat FROM q CROSS JOIN b GROUP BY o_orderkey")
def nearest_beat(spark, sf_dir):
    times = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i * 0.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", collection.beat_at(times, (F.col("o_orderkey") % 97) * 0.25 - 1).alias("beat"))


@query(
    """WITH m AS (SELECT [203, 225, 238, 250, 229, 238, 173, 238, 233, 210, 233, 235, 225, 233, 243, 232, 233, 244, 225] AS p)
SELECT o_orderkey, CASE ['intro', 'build', 'steady', 'breakdown', 'drop', 'outro'][(o_orderkey % 6)::INT + 1] WHEN 'intro' THEN 1 WHEN 'build' THEN 2 WHEN 'steady' THEN 2 WHEN 'breakdown' THEN 3 WHEN 'drop' THEN 5 ELSE 6 END AS kind,
 xor((o_orderkey % 256)::INT, ((p[(o_orderkey % 19)::INT + 1] + o_orderkey % 50) % 256)::INT)::INT AS masked FROM orders, m"""
)
def phrase_kind_mask(spark, sf_dir):
    k = F.col("o_orderkey")
    label = F.get(F.array(*map(F.lit, ("intro", "build", "steady", "breakdown", "drop", "outro"))), (k % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", entities.phrase_kind(label).alias("kind"), entities.masked((k % 256).cast("int"), k, (k % 50).cast("int")).alias("masked"))


_PATHS = "WITH t AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || 'é日' ELSE url END AS u FROM pages)"


@query(
    _PATHS.replace("WITH t", "WITH RECURSIVE t")
    + """, p AS (SELECT page_id, list_transform(range(1, length(u) + 1), lambda i: unicode(u[i])::BIGINT) AS u FROM t),
h(page_id, u, i, h) AS (SELECT page_id, u, 1, 0::HUGEINT FROM p UNION ALL SELECT page_id, u, i + 1, (((h * 23497 + u[i]) % 4294967296) * 37813 + u[i]) % 4294967296 FROM h WHERE i <= len(u)), f AS (SELECT page_id, (h % 200003)::BIGINT AS hash FROM h WHERE i = len(u) + 1)
SELECT page_id, hash, '/PIONEER/USBANLZ/P' || printf('%03X', (hash & 1) + ((hash >> 2) & 1) * 2 + ((hash >> 6) & 1) * 4 + ((hash >> 7) & 1) * 8 + ((hash >> 9) & 1) * 16 + ((hash >> 13) & 1) * 32 + ((hash >> 16) & 1) * 64) || '/' || printf('%08X', hash) AS folder FROM f"""
)
def analysis_path_hash(spark, sf_dir):
    path = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("é日"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", naming.path_hash(path).alias("hash"), naming.analysis_folder(path).alias("folder"))


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, row_number() OVER w - 1 AS i, sum(l_quantity::INT) OVER w - l_quantity::INT AS first, sum(l_quantity::INT) OVER (PARTITION BY l_orderkey) AS total, l_partkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT l_orderkey, any_value(total) AS total, unnest(range(10)) AS k FROM f GROUP BY l_orderkey), s AS (SELECT m.l_orderkey, k, min(first) FILTER (first >= (2 * k + 1) * m.total // 20) AS hit, max(first) AS last FROM m JOIN f USING (l_orderkey) GROUP BY m.l_orderkey, k, m.total)
SELECT l_orderkey, k::INT AS k, coalesce(hit, last)::BIGINT AS first_sample FROM s"""
)
def seek_midpoints(spark, sf_dir):
    before = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(W.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "lineitem").withColumn("samples", F.col("l_quantity").cast("int")).withColumn("first", F.coalesce(F.sum("samples").over(before), F.lit(0)))
    return entities.seek_points(rows, ["l_orderkey"], 10)


@query(
    GRID_SQL
    + """, oc AS (SELECT band, frame // 24 AS i, round(max(energy) / max(max(energy)) OVER (PARTITION BY band) * 31)::INT AS h, (frame // 24) % 8 AS low FROM g GROUP BY band, frame // 24)
SELECT band, i::INT AS i, round((low / 7.0) * (h / 31.0) * 255)::INT AS level, round(avg(low / 7.0 * h / 31.0) OVER (PARTITION BY band), 6) AS loudness FROM oc"""
)
def overview_levels(spark, sf_dir):
    peaks = grid(spark, sf_dir).groupBy("band", F.floor(F.col("frame") / 24).cast("int").alias("i")).agg(F.max("energy").alias("peak"))
    w = W.partitionBy("band")
    rows = peaks.withColumn("h", F.round(F.col("peak") / F.max("peak").over(w) * 31).cast("int")).withColumn("low", F.col("i") % 8)
    level, share = entities.overview_level(F.col("low"), F.col("h")), F.col("low") / 7.0 * F.col("h") / 31.0
    return rows.select("band", "i", level.alias("level"), F.round(F.avg(share).over(w), 6).alias("loudness"))


@query(
    """WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_brand END AS artist, p_type AS key FROM part), a AS (SELECT artist AS name, row_number() OVER (ORDER BY min(id)) AS id FROM t WHERE artist <> '' GROUP BY artist), k AS (SELECT key AS name, row_number() OVER (ORDER BY min(id)) AS id FROM t GROUP BY key)
SELECT t.id, coalesce(a.id, 0)::INT AS artist_id, k.id::INT AS key_id FROM t LEFT JOIN a ON a.name = t.artist LEFT JOIN k ON k.name = t.key"""
)
def entity_ids(spark, sf_dir):
    artist = F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), artist.alias("artist"), F.col("p_type").alias("key"))
    return entities.with_ids(rows, "id", ["artist", "key"]).select("id", "artist_id", "key_id")


@query(
    _TEXTS
    + """, f AS (SELECT k, s, (k * 7919) % 211 * 20 + 60 AS bytes FROM t), r AS (SELECT k, bytes, row_number() OVER (ORDER BY k) - 1 AS i FROM f) SELECT k, bytes::INT AS bytes, (((bytes + 3) // 4) * 4)::INT AS aligned FROM r"""
)
def row_alignment(spark, sf_dir):
    size = ((F.col("k") * 7919) % 211 * 20 + 60).cast("int")
    return _texts(spark, sf_dir).select("k", size.alias("bytes"), entities.aligned_size(size, 4).alias("aligned"))


@query(
    """WITH e AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), f AS (SELECT unnest(range(8)) AS k)
SELECT vec_id, k::INT AS k, round(sqrt(pow(sum(x * cos((0.1 + k * 0.37) * i)), 2) + pow(sum(x * sin((0.1 + k * 0.37) * i)), 2)), 5) AS magnitude FROM e CROSS JOIN f GROUP BY ALL"""
)
def off_bin_dft(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return rows.select("vec_id", "k", F.round(series.magnitude(F.col("x"), 0.1 + F.col("k") * F.lit(0.37)), 5).alias("magnitude"))
