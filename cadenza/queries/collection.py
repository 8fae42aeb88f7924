"""Collections, names and playlists over parts, pages, documents, orders and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import collection, naming

from .registry import query, table

_NAMES = """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN '128_08A_' || p_name || '.wav' WHEN 1 THEN '12 - ' || replace(p_name, ' ', ' - ') || '.mp3' WHEN 2 THEN replace(p_name, ' ', '-') || '.flac' WHEN 3 THEN replace(p_name, ' ', '_') || '.AIF'
 WHEN 4 THEN '99_08A_' || p_name || '.wav' WHEN 5 THEN '128_8A_' || p_name WHEN 6 THEN '007_99B_a - b - ' || p_name || '.x.aiff' ELSE '03-' || replace(p_name, ' ', '-') || '.ogg' END AS name, p_retailprice AS bpm, p_size FROM part)
"""


def names(spark, sf_dir):
    """File names of many shapes, with and without prefixes, extensions, numbers and hyphens."""
    p, k = F.col("p_name"), F.col("p_partkey") % 8
    rep = lambda to: F.replace(p, F.lit(" "), F.lit(to))
    shapes = [F.concat(F.lit("128_08A_"), p, F.lit(".wav")), F.concat(F.lit("12 - "), rep(" - "), F.lit(".mp3")), F.concat(rep("-"), F.lit(".flac")), F.concat(rep("_"), F.lit(".AIF")), F.concat(F.lit("99_08A_"), p, F.lit(".wav")), F.concat(F.lit("128_8A_"), p), F.concat(F.lit("007_99B_a - b - "), p, F.lit(".x.aiff")), F.concat(F.lit("03-"), rep("-"), F.lit(".ogg"))]
    name = shapes[7]
    for i, shape in enumerate(shapes[:7]):
        name = F.when(k == i, shape).otherwise(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), name.alias("name"), F.col("p_retailprice").alias("bpm"), "p_size")


@query("WITH f AS (SELECT p_type AS value, min(p_partkey) AS p FROM part WHERE p_type <> '' GROUP BY 1) SELECT value, (row_number() OVER (ORDER BY p) - 1)::INT AS code FROM f")
def dictionary_encode(spark, sf_dir):
    return naming.dictionary(table(spark, sf_dir, "part"), "p_partkey", "p_type").withColumnRenamed("p_type", "value")


@query("WITH r AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN '' ELSE p_brand END AS brand FROM part), f AS (SELECT brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM r WHERE brand <> '' GROUP BY brand) SELECT r.p_partkey, f.code::INT AS brand_index FROM r LEFT JOIN f ON f.brand = r.brand")
def index_by_column(spark, sf_dir):
    brand = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_brand"))
    _, rows = collection.index_by(table(spark, sf_dir, "part").select("p_partkey", brand.alias("brand")), "p_partkey", "brand")
    return rows.select("p_partkey", "brand_index")


@query(
    _NAMES
    + """, s AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '(\\.[^.]*)$', 1) AS ext FROM p)
SELECT k, CASE WHEN bpm >= 1 AND bpm < 1000 AND p_size BETWEEN 1 AND 12 THEN lpad(round(bpm)::INT::VARCHAR, 3, '0') || '_' || lpad(p_size::VARCHAR, 2, '0') || CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END || '_' || regexp_replace(stem, '^[0-9]{3}_[0-9]{2}[AB]_', '') || ext END AS target FROM s"""
)
def target_name(spark, sf_dir):
    camelot = F.concat(F.col("p_size").cast("string"), F.when(F.col("k") % 2 == 0, "A").otherwise("B"))
    return names(spark, sf_dir).select("k", naming.target_name(F.col("bpm"), camelot, F.col("name")).alias("target"))


@query(_NAMES + "SELECT k, CASE WHEN length(name) >= 8 AND name SIMILAR TO '[0-9][0-9][0-9]_[0-9][0-9][AB]_.*' THEN substr(name, 9) ELSE name END AS stripped FROM p")
def strip_prefix(spark, sf_dir):
    return names(spark, sf_dir).select("k", naming.strip_prefix(F.col("name")).alias("stripped"))


@query(
    _NAMES
    + """, s AS (SELECT k, replace(CASE WHEN regexp_replace(name, '\\.[^.]*$', '') SIMILAR TO '[0-9][0-9][0-9]_[0-9][0-9][AB]_.*' THEN substr(regexp_replace(name, '\\.[^.]*$', ''), 9) ELSE regexp_replace(name, '\\.[^.]*$', '') END, '_', ' ') AS t FROM p),
m AS (SELECT *, CASE WHEN contains(t, ' - ') THEN ' - ' ELSE '-' END AS mark FROM s),
b AS (SELECT k, mark, CASE WHEN strpos(t, mark) > 0 AND regexp_full_match(trim(substr(t, 1, strpos(t, mark) - 1)), '[0-9]+') THEN substr(t, strpos(t, mark) + length(mark)) ELSE t END AS body FROM m)
SELECT k, CASE WHEN strpos(body, mark) > 0 THEN trim(substr(body, 1, strpos(body, mark) - 1)) ELSE '' END AS artist, CASE WHEN strpos(body, mark) > 0 THEN trim(substr(body, strpos(body, mark) + length(mark))) ELSE trim(body) END AS title FROM b"""
)
def artist_title_split(spark, sf_dir):
    return names(spark, sf_dir).select("k", collection.artist_title(F.col("name")).alias("t")).select("k", "t.artist", "t.title")


@query(
    _NAMES
    + """, e AS (SELECT k, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS x FROM p), f AS (SELECT k, CASE WHEN x IN ('wav', 'flac', 'mp3', 'aiff') THEN x WHEN x = 'aif' THEN 'aiff' END AS fmt FROM e)
SELECT k, fmt, fmt <> 'mp3' AS lossless, fmt = 'mp3' AS seek FROM f"""
)
def format_domain(spark, sf_dir):
    fmt = collection.file_format(F.col("name"))
    return names(spark, sf_dir).select("k", fmt.alias("fmt")).select("k", "fmt", collection.lossless(F.col("fmt")).alias("lossless"), collection.needs_seek_index(F.col("fmt")).alias("seek"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 44100 * 16 * 2 // 1000 WHEN doc_id % 11 = 0 THEN 0 WHEN n_chars > 0 THEN round(octet_length(encode(text)) * 8.0 / n_chars / 1000) ELSE 0 END::BIGINT AS kbps FROM documents")
def bitrate_case(spark, sf_dir):
    ext = F.when(F.col("doc_id") % 3 == 0, "wav").otherwise("mp3")
    seconds = F.when((F.col("doc_id") % 3 != 0) & (F.col("doc_id") % 11 == 0), 0).otherwise(F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", naming.bitrate(ext, F.lit(44100), F.lit(2), F.octet_length("text"), seconds).alias("kbps"))


_GRIDS = """WITH t AS (SELECT c_custkey AS k, (c_custkey % 7) * 0.25 AS start, (c_custkey % 5) * 0.5 AS trim, c_custkey % 4 AS phase, c_custkey % 3 + 2 AS bpb, c_custkey % 6 AS n FROM customer),
b AS (SELECT k, start, trim, phase, bpb, i FROM t, LATERAL (SELECT unnest(range(n)) AS i))
"""


def _grids(spark, sf_dir):
    k = F.col("c_custkey")
    times = F.when(k % 6 > 0, F.transform(F.sequence(F.lit(0), (k % 6 - 1).cast("int")), lambda i: i * 0.5)).otherwise(F.expr("cast(array() as array<double>)"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), ((k % 7) * 0.25).alias("start"), ((k % 5) * 0.5).alias("trim"), (k % 4).cast("int").alias("phase"), (k % 3 + 2).cast("int").alias("bpb"), times.alias("times"))


@query(_GRIDS + "SELECT k, i::INT AS i, (i * 0.5 + start)::DOUBLE AS kept, (i * 0.5 + start - trim)::DOUBLE AS cut, ((i + bpb - phase % bpb) % bpb + 1)::INT AS number FROM b")
def beat_number_in_bar(spark, sf_dir):
    rows = _grids(spark, sf_dir)
    kept, cut = (collection.time_shift(F.col("start"), F.col("trim"), first)[0] for first in (False, True))
    rows = rows.withColumn("a", collection.beats(F.col("times"), F.lit(120.0), F.col("phase"), F.col("bpb"), kept)).withColumn("b", collection.beats(F.col("times"), F.lit(120.0), F.col("phase"), F.col("bpb"), cut))
    each = rows.select("k", "b", F.posexplode("a").alias("i", "x"))
    return each.select("k", "i", F.col("x.time_seconds").alias("kept"), F.get("b", F.col("i"))["time_seconds"].alias("cut"), F.col("x.number_in_bar").alias("number"))


@query(
    _GRIDS
    + """SELECT k, 'hot' AS kind, 1::INT AS number, 'Drop' AS comment, (8 + start)::DOUBLE AS time_seconds FROM t WHERE k % 2 = 0 UNION ALL SELECT k, 'memory', 3, 'Outro', (16 + start)::DOUBLE FROM t WHERE k % 2 = 0
UNION ALL SELECT k, 'memory', 1, '', start::DOUBLE FROM t WHERE k % 2 = 1 AND n > 0"""
)
def cue_fallback(spark, sf_dir):
    given = F.array(F.struct(F.lit("hot").alias("kind"), F.lit(1).alias("number"), F.lit("Drop").alias("name"), F.lit(8.0).alias("time_seconds")), F.struct(F.lit("point").alias("kind"), F.lit(3).alias("number"), F.lit("Outro").alias("name"), F.lit(16.0).alias("time_seconds")))
    rows = _grids(spark, sf_dir).withColumn("found", F.when(F.col("k") % 2 == 0, given).otherwise(F.slice(given, 1, 0)))
    grid = collection.beats(F.col("times"), F.lit(120.0), F.col("phase"), F.col("bpb"), F.col("start"))
    return rows.withColumn("beats", grid).select("k", F.explode(collection.cues(F.col("found"), F.col("beats"), F.col("start"))).alias("c")).select("k", "c.*")


@query("SELECT o_orderkey, label, (o_orderkey % 10 + 1.5)::DOUBLE AS start_seconds FROM (SELECT o_orderkey, ['intro', 'vocal', 'drop', 'Outro', 'steady', 'build'][(o_orderkey % 6)::INT + 1] AS label FROM orders) WHERE label IN ('intro', 'build', 'drop', 'breakdown', 'outro', 'steady')")
def known_sections(spark, sf_dir):
    label = F.get(F.array(*map(F.lit, ("intro", "vocal", "drop", "Outro", "steady", "build"))), (F.col("o_orderkey") % 6).cast("int"))
    start = (F.col("o_orderkey") % 10).cast("double")
    found = F.array(F.struct(label.alias("label"), start.alias("start_seconds"), (start + 1).alias("end_seconds")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(collection.sections(found, F.lit(1.5))).alias("s"))
    return rows.select("o_orderkey", "s.label", "s.start_seconds")


@query("SELECT o_orderkey, greatest(round(s), 0)::BIGINT AS seconds, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE s END AS first_beat, strftime(DATE '1970-01-01' + (o_orderkey % 40000)::INT, '%Y-%m-%d') AS day FROM (SELECT o_orderkey, (o_orderkey % 1000 - 10) / 2.0 AS s FROM orders)")
def track_times(spark, sf_dir):
    s = (F.col("o_orderkey") % 1000 - 10) / 2.0
    beats = F.when(F.col("o_orderkey") % 4 == 0, F.expr("cast(array() as array<struct<time_seconds:double>>)")).otherwise(F.array(F.struct(s.alias("time_seconds"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", collection.duration_rounded(s).alias("seconds"), collection.first_beat_seconds(beats).alias("first_beat"), collection.civil_date(F.col("o_orderkey") % 40000).alias("day"))


@query("SELECT o_custkey * 1000000 + row_number() OVER w AS entry, o_orderkey, coalesce(lead(o_custkey * 1000000 + 1) OVER w + row_number() OVER w, 0) AS next_entry FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def playlist_linked_list(spark, sf_dir):
    rows = collection.linked_entries(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return rows.select(F.col("entity_id").alias("entry"), "o_orderkey", F.col("next_entity_id").alias("next_entry"))


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS entry, 'All tracks' AS playlist FROM nation")
def playlist_of_all(spark, sf_dir):
    return collection.playlist_entries(table(spark, sf_dir, "nation"), "n_nationkey").withColumn("entry", F.col("entry").cast("long"))


# regions are lists of the topmost level, nations lists in them, and every third nation holds a list of its own
_LISTS = """WITH RECURSIVE l0 AS (SELECT r_regionkey + 1 AS id, 0 AS parent, r_name AS title FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name FROM nation UNION ALL SELECT n_nationkey + 200, n_nationkey + 100, n_name || ' b' FROM nation WHERE n_nationkey % 3 = 0),
l AS (SELECT id, parent, title, coalesce(lead(id) OVER (PARTITION BY parent ORDER BY id), 0) AS next FROM l0)
"""


def lists(spark, sf_dir):
    from pyspark.sql import Window as W

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    rows = region.select((F.col("r_regionkey") + 1).alias("id"), F.lit(0).alias("parent"), F.col("r_name").alias("title"))
    rows = rows.unionByName(nation.select((key + 100).alias("id"), (F.col("n_regionkey") + 1).alias("parent"), F.col("n_name").alias("title")))
    rows = rows.unionByName(nation.where(key % 3 == 0).select((key + 200).alias("id"), (key + 100).alias("parent"), F.concat("n_name", F.lit(" b")).alias("title")))
    return rows.withColumn("next", F.coalesce(F.lead("id").over(W.partitionBy("parent").orderBy("id")), F.lit(0)))


@query(_LISTS + ", u(id, parent) AS (SELECT id, parent FROM l UNION ALL SELECT u.id, p.parent FROM l p JOIN u ON u.parent = p.id) SELECT id, parent FROM u")
def playlist_all_parents(spark, sf_dir):
    return collection.ancestors(lists(spark, sf_dir))


@query(_LISTS + ", u(id, child) AS (SELECT id, id FROM l UNION ALL SELECT u.id, p.id FROM l p JOIN u ON u.child = p.parent) SELECT id, child FROM u WHERE id <> child")
def playlist_all_children(spark, sf_dir):
    return collection.descendants(lists(spark, sf_dir))


@query(
    _LISTS
    + """, h(id, parent, title, depth) AS (SELECT id, parent, title, 1 FROM l UNION ALL SELECT h.id, p.parent, p.title, h.depth + 1 FROM l p JOIN h ON h.parent = p.id),
o(id, place) AS (SELECT id, 1 FROM l WHERE next = 0 UNION ALL SELECT l.id, o.place + 1 FROM l JOIN o ON l.next = o.id), n AS (SELECT id, string_agg(title, ';' ORDER BY depth DESC) || ';' AS path, count(*) AS depth FROM h GROUP BY id)
SELECT l.id, n.path, (row_number() OVER (ORDER BY n.depth DESC, o.place NULLS FIRST, l.id))::INT AS position FROM l JOIN n USING (id) LEFT JOIN o USING (id)"""
)
def playlist_path_recursive(spark, sf_dir):
    return collection.playlist_paths(lists(spark, sf_dir))


@query("SELECT o_orderkey AS \"trackId\", o_orderkey % 2 = 0 AS \"isAnalyzed\", o_orderstatus AS \"trackData\", NULL::VARCHAR AS \"overviewWaveFormData\", o_orderpriority AS \"beatData\", NULL::VARCHAR AS \"quickCues\", NULL::VARCHAR AS loops, 0 AS \"thirdPartySourceId\", 0 AS \"activeOnLoadLoops\" FROM orders")
def performance_data(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_orderkey") % 2 == 0).alias("isAnalyzed"), F.col("o_orderstatus").alias("trackData"), none.alias("overviewWaveFormData"), F.col("o_orderpriority").alias("beatData"), none.alias("quickCues"), none.alias("loops"), F.lit(0).alias("thirdPartySourceId"), F.lit(0).alias("activeOnLoadLoops"))
    return collection.performance_data(rows)


@query('SELECT 0 AS id, 0 AS "trackId" WHERE false')
def change_log(spark, sf_dir):
    return collection.change_log(spark)


@query(
    """SELECT 'unique' AS rule, c_nationkey || '/' || c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'foreign', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY o_custkey"""
)
def constraint_violations(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    twice = collection.violations(customer, ["c_nationkey", "c_mktsegment"]).select(F.lit("unique").alias("rule"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"), "n")
    lost = collection.orphans(table(spark, sf_dir, "orders"), "o_custkey", customer.where("c_custkey % 10 <> 0"), "c_custkey")
    return twice.unionByName(lost.groupBy("o_custkey").agg(F.count("*").alias("n")).select(F.lit("foreign").alias("rule"), F.col("o_custkey").cast("string").alias("value"), "n"))


@query("SELECT o_custkey AS path, arg_max(o_orderpriority, o_orderkey) AS bytes, min(o_orderkey) AS write_order FROM orders GROUP BY o_custkey")
def latest_files(spark, sf_dir):
    return collection.latest_files(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("bytes"), F.col("o_orderkey").alias("seq")))


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def duplicate_names_keep_first(spark, sf_dir):
    return collection.keep_first(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")
