"""The structure chain over embeddings: a label is a track, its vectors by id are its bars of two seconds, and their
first eight components, scaled by a pattern of 16 bars each, the bars' band energies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import findings, structure

from .catalogue import GRID_SQL, grid
from .registry import query, r6, table

SCALES = (0.3, 1.0, 0.02, 0.6)

BARS_SQL = """WITH RECURSIVE b0 AS (SELECT label AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bar, embedding FROM embeddings),
b AS (SELECT track, bar, list_transform(range(1, 9), lambda i: abs(embedding[i]::DOUBLE) * CASE (bar // 16) % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.02 ELSE 0.6 END) AS e FROM b0),
x AS (SELECT track, bar, band, ln(1 + 1000 * v) AS x FROM (SELECT track, bar, unnest(range(8)) AS band, unnest(e) AS v FROM b)),
u AS (SELECT track, bar, band, CASE WHEN s > 0 THEN x / s ELSE 0 END AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY track, bar)) AS s FROM x)),
d AS (SELECT track, bar, CASE WHEN list_sum(e) <= 0 THEN -120 ELSE greatest(20 * log10(list_sum(e)), -120) END AS broad, CASE WHEN e[1] + e[2] <= 0 THEN -120 ELSE greatest(20 * log10(e[1] + e[2]), -120) END AS low FROM b),
k AS (SELECT track, bar, band, sum(x) OVER p AS b, sum(x) OVER f AS a, count(x) OVER p = 8 AND count(x) OVER f = 8 AS ok FROM u
 WINDOW p AS (PARTITION BY track, band ORDER BY bar ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY track, band ORDER BY bar ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
nv AS (SELECT track, bar, round(CASE WHEN bool_and(ok) THEN greatest(sum((b * b + a * a) / 2 - a * b) / 64, 0) ELSE 0 END, 9) AS novelty FROM k GROUP BY track, bar),
z AS (SELECT *, count(*) OVER t AS bars, CASE WHEN stddev_pop(novelty) OVER t > 1e-12 THEN (novelty - avg(novelty) OVER t) / stddev_pop(novelty) OVER t ELSE 0 END AS strength, lag(novelty) OVER o AS pv, lead(novelty) OVER o AS nx FROM nv WINDOW t AS (PARTITION BY track), o AS (PARTITION BY track ORDER BY bar)),
pk AS (SELECT track, bar, novelty, round(strength, 9) AS strength, bars, CASE WHEN bar - bar // 4 * 4 <= bar // 4 * 4 + 4 - bar THEN bar // 4 * 4 ELSE bar // 4 * 4 + 4 END AS place FROM z WHERE coalesce(novelty >= pv, true) AND coalesce(novelty >= nx, true) AND strength >= 0.8),
rk AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY strength DESC, bar) AS i FROM pk WHERE place > 0 AND place < bars),
nm(track, i, kept, ids) AS (SELECT DISTINCT track, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM rk UNION ALL SELECT nm.track, nm.i + 1,
 CASE WHEN len(list_filter(nm.kept, lambda y: abs(y - r.place) < 8)) > 0 THEN nm.kept ELSE list_append(nm.kept, r.place) END, CASE WHEN len(list_filter(nm.kept, lambda y: abs(y - r.place) < 8)) > 0 THEN nm.ids ELSE list_append(nm.ids, r.i) END
 FROM nm JOIN rk r ON r.track = nm.track AND r.i = nm.i + 1),
bd AS (SELECT f.track, r.place AS bar, r.novelty, r.strength FROM (SELECT track, unnest(arg_max(ids, i)) AS i FROM nm GROUP BY track) f JOIN rk r USING (track, i)),
eg AS (SELECT track, bar FROM bd UNION SELECT track, 0 FROM b UNION SELECT track, max(bar) + 1 FROM b GROUP BY track),
sp AS (SELECT track, bar AS start_bar, lead(bar) OVER w - bar AS bars, row_number() OVER w - 1 AS idx FROM eg WINDOW w AS (PARTITION BY track ORDER BY bar)),
ms AS (SELECT sp.track, sp.idx, sp.start_bar, sp.bars, avg(d.low) AS low_db, avg(d.broad) AS broadband_db, avg(d.broad) FILTER (d.bar - sp.start_bar >= sp.bars - greatest(sp.bars // 4, 1)) - avg(d.broad) FILTER (d.bar - sp.start_bar < greatest(sp.bars // 4, 1)) AS rise_db
 FROM sp JOIN d ON d.track = sp.track AND d.bar >= sp.start_bar AND d.bar < sp.start_bar + sp.bars WHERE sp.bars IS NOT NULL GROUP BY ALL),
mm AS (SELECT *, max(low_db) OVER t - low_db AS lo, max(broadband_db) OVER t - broadband_db AS br, max(idx) OVER t AS last FROM ms WINDOW t AS (PARTITION BY track)),
lb AS (SELECT *, CASE WHEN idx = 0 THEN 'intro' WHEN idx = last THEN 'outro' WHEN lo <= 3 AND br <= 3 THEN 'drop' WHEN rise_db >= 4 AND lo > 3 THEN 'build' WHEN lo >= 9 THEN 'breakdown' ELSE 'steady' END AS l0,
 least(1, CASE WHEN idx = 0 OR idx = last THEN bars / 8.0 WHEN lo <= 3 AND br <= 3 THEN least(abs(3 - lo) / 3, abs(3 - br) / 3) WHEN rise_db >= 4 AND lo > 3 THEN abs(rise_db - 4) / 4 WHEN lo >= 9 THEN abs(lo - 9) / 9 ELSE least(abs(3 - lo), abs(lo - 9), abs(rise_db - 4)) / 3 END) AS c0 FROM mm),
un AS (SELECT *, l0 = 'build' AND NOT coalesce(bool_or(l0 = 'drop') OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS undone FROM lb),
sc AS (SELECT track, idx, start_bar, bars, low_db, broadband_db, rise_db, CASE WHEN undone THEN 'steady' ELSE l0 END AS label, CASE WHEN undone THEN 0 ELSE c0 END AS confidence FROM un)
"""


def bar_rows(spark, sf_dir):
    """(track, bar, start_seconds, end_seconds, energies)."""
    bar = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("track"), bar.alias("bar"), "embedding")
    scale = F.get(F.array(*map(F.lit, SCALES)), F.floor(F.col("bar") / 16).cast("int") % 4)
    energies = F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")) * scale)
    return rows.select("track", "bar", (F.col("bar") * 2.0).alias("start_seconds"), (F.col("bar") * 2.0 + 2).alias("end_seconds"), energies.alias("energies"))


def novelty(spark, sf_dir):
    cells = bar_rows(spark, sf_dir).select("track", "bar", F.posexplode(structure.bar_shape(F.col("energies"))).alias("band", "x"))
    return structure.checkerboard(cells, ["track"]).withColumn("novelty", F.round("novelty", 9))


def edges(spark, sf_dir):
    return structure.boundaries(novelty(spark, sf_dir), ["track"])


def spans(spark, sf_dir):
    counts = bar_rows(spark, sf_dir).groupBy("track").agg((F.max("bar") + 1).alias("bar_count"))
    return structure.section_spans(edges(spark, sf_dir), counts, ["track"])


def sections(spark, sf_dir):
    levels = bar_rows(spark, sf_dir).select("track", "bar", "start_seconds", "end_seconds", structure.level_db(F.col("energies"), 2).alias("low_db"), structure.level_db(F.col("energies")).alias("broadband_db"))
    return structure.section_labels(structure.section_measures(levels, spans(spark, sf_dir), ["track"]), ["track"])


def cued(spark, sf_dir):
    """A row a track with its sections, bar starts and duration, and its cues."""
    listed = sections(spark, sf_dir).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("idx", "label", "start_bar", "broadband_db", "confidence", "start_seconds"))).alias("sections"))
    starts = bar_rows(spark, sf_dir).groupBy("track").agg(F.sort_array(F.collect_list("start_seconds")).alias("bar_starts"))
    rows = starts.join(listed, "track").withColumn("duration_seconds", F.size("bar_starts") * 2.0)
    return structure.place_cues(rows)


@query(
    GRID_SQL
    + """, sl AS (SELECT band, frame // 4 AS slot, avg(energy) AS m FROM g GROUP BY ALL), br AS (SELECT k AS bar, k * 1.37::DOUBLE AS s, (k + 1) * 1.37::DOUBLE AS e FROM (SELECT unnest(range(12)) AS k)),
n0 AS (SELECT max(slot) + 1 AS slots FROM sl)
SELECT br.bar::INT AS bar, sl.band, round(avg(sl.m), 6) AS energy FROM br JOIN sl ON sl.slot >= floor(br.s / 0.1::DOUBLE) AND sl.slot < least(ceil(br.e / 0.1::DOUBLE), (SELECT slots FROM n0)) GROUP BY ALL"""
)
def bar_means(spark, sf_dir):
    rows = grid(spark, sf_dir).groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("band", "energy"))).alias("b"))
    names = rows.select("frame", F.transform("b", lambda x: x["band"]).alias("names"), F.transform("b", lambda x: x["energy"]).alias("energies")).withColumn("track", F.lit(0))
    slots = structure.slot_means(names, ["track"], 5, F.lit(40.0))
    starts = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: k * F.lit(1.37))
    spans_ = structure.bars(spark.range(1).select(F.lit(0).alias("track"), starts.alias("bar_starts")), ["track"])
    means = structure.bar_means(slots, spans_, ["track"], 5)
    bands = grid(spark, sf_dir).select("band").distinct().withColumn("k", F.row_number().over(W.orderBy("band")) - 1)  # one row a band
    return means.select("bar", F.posexplode("energies").alias("k", "energy")).join(bands, "k").select("bar", "band", r6("energy"))


@query(BARS_SQL + "SELECT u.track, u.bar::INT AS bar, u.band::INT AS band, round(u.x, 6) AS x, round(d.low, 6) AS low_db, round(d.broad, 6) AS broadband_db FROM u JOIN d USING (track, bar)")
def bar_shape_db(spark, sf_dir):
    rows = bar_rows(spark, sf_dir).withColumn("low_db", structure.level_db(F.col("energies"), 2)).withColumn("broadband_db", structure.level_db(F.col("energies")))
    return rows.select("track", "bar", r6("low_db"), r6("broadband_db"), F.posexplode(structure.bar_shape(F.col("energies"))).alias("band", "x")).withColumn("x", F.round("x", 6))


@query(BARS_SQL + "SELECT track, bar::INT AS bar, round(novelty, 6) AS novelty FROM nv")
def self_similarity_novelty(spark, sf_dir):
    return novelty(spark, sf_dir).select("track", "bar", r6("novelty"))


@query(BARS_SQL + "SELECT track, bar::INT AS bar, round(novelty, 6) AS novelty, round(strength, 5) AS strength FROM bd")
def section_boundaries(spark, sf_dir):
    return edges(spark, sf_dir).select("track", "bar", r6("novelty"), F.round("strength", 5).alias("strength"))


@query(BARS_SQL + "SELECT track, idx::INT AS idx, start_bar::INT AS start_bar, bars::INT AS bars FROM sp WHERE bars IS NOT NULL")
def section_spans(spark, sf_dir):
    return spans(spark, sf_dir).select("track", "idx", "start_bar", "bars")


@query(BARS_SQL + "SELECT track, idx::INT AS idx, round(low_db, 5) AS low_db, round(broadband_db, 5) AS broadband_db, round(rise_db, 5) AS rise_db FROM ms")
def section_measures(spark, sf_dir):
    return sections(spark, sf_dir).select("track", "idx", *[F.round(c, 5).alias(c) for c in ("low_db", "broadband_db", "rise_db")])


@query(BARS_SQL + "SELECT track, idx::INT AS idx, label, round(confidence, 5)::DOUBLE AS confidence FROM sc")
def section_labels(spark, sf_dir):
    return sections(spark, sf_dir).select("track", "idx", "label", F.round("confidence", 5).alias("confidence"))


_CUES = (
    BARS_SQL
    + """, tr AS (SELECT track, max(bar) + 1 AS n, ceil((max(bar) + 1) * 2.0 * 0.2 / 2.0) AS early FROM b GROUP BY track),
dr AS (SELECT tr.track, coalesce(min(idx) FILTER (label = 'drop' AND start_bar >= early), min(idx) FILTER (label = 'drop')) AS d, min(idx) FILTER (label = 'drop' AND start_bar >= early) IS NULL AND count(*) FILTER (label = 'drop') > 0 AS relaxed FROM tr JOIN sc USING (track) GROUP BY tr.track),
p0 AS (SELECT sc.track, any_value(d) AS d, max(idx) FILTER (label = 'build' AND idx < d) AS c, min(idx) FILTER (label = 'breakdown') AS e, max(idx) FILTER (label = 'outro') AS g, coalesce(min(start_bar) FILTER (label IN ('drop', 'steady')), min(start_bar)) AS loop_bar FROM sc JOIN dr USING (track) GROUP BY sc.track),
f0 AS (SELECT sc.track, arg_max(idx, struct_pack(v := broadband_db, i := idx)) AS f FROM sc JOIN p0 USING (track) WHERE idx > 0 AND label <> 'intro' AND idx IS DISTINCT FROM d AND idx IS DISTINCT FROM c AND idx IS DISTINCT FROM e AND idx IS DISTINCT FROM g GROUP BY sc.track),
pl AS (SELECT p0.track, x.number, x.pad, x.lead, CASE WHEN x.number = 1 THEN 0 WHEN x.number = 2 THEN loop_bar WHEN x.number = 8 THEN loop_bar + 4 ELSE s.start_bar END AS bar, CASE WHEN x.number BETWEEN 3 AND 7 THEN s.idx END AS from_section
 FROM p0 LEFT JOIN f0 USING (track) CROSS JOIN (VALUES (1, 'A', false), (2, 'B', false), (3, 'C', true), (4, 'D', true), (5, 'E', true), (6, 'F', true), (7, 'G', true), (8, 'H', false)) AS x(number, pad, lead)
 LEFT JOIN sc s ON s.track = p0.track AND s.idx = CASE x.number WHEN 3 THEN c WHEN 4 THEN d WHEN 5 THEN e WHEN 6 THEN f WHEN 7 THEN g END),
ok AS (SELECT pl.*, pl.bar IS NOT NULL AND pl.bar < n AS placed, greatest(pl.bar - CASE WHEN lead THEN 16 ELSE 0 END, 0) AS memory FROM pl JOIN tr USING (track)),
hm AS (SELECT *, row_number() OVER (PARTITION BY track, memory ORDER BY number) = 1 AS fresh FROM ok WHERE placed)
"""
)


@query(
    _CUES
    + """SELECT track, 'hot' AS kind, number::INT AS number, bar::INT AS bar, (bar * 2.0)::DOUBLE AS time_seconds, from_section::INT AS from_section FROM hm
UNION ALL SELECT track, 'memory', (row_number() OVER (PARTITION BY track ORDER BY number))::INT, memory::INT, (memory * 2.0)::DOUBLE, from_section::INT FROM hm WHERE fresh"""
)
def cue_pads(spark, sf_dir):
    return cued(spark, sf_dir).select("track", F.explode("cues").alias("c")).select("track", "c.kind", "c.number", "c.bar", "c.time_seconds", "c.from_section")


@query(_CUES + "SELECT track, coalesce(string_agg(pad, '' ORDER BY number) FILTER (NOT placed), '') AS missing, any_value(relaxed) AS drop_rule_relaxed FROM ok JOIN dr USING (track) GROUP BY track")
def missing_pads(spark, sf_dir):
    return cued(spark, sf_dir).select("track", F.array_join("missing_pads", "").alias("missing"), "drop_rule_relaxed")


@query(
    _CUES
    + """, st AS (SELECT track, any_value(bars) AS bars, count(bd.bar) AS edges FROM (SELECT track, max(bar) + 1 AS bars FROM b GROUP BY track) LEFT JOIN bd USING (track) GROUP BY track),
fi AS (SELECT track, 'no-section-boundaries' AS code, 'warning' AS severity FROM st WHERE edges = 0 AND bars >= 24 UNION ALL SELECT DISTINCT track, 'weak-section-label', 'warning' FROM sc JOIN st USING (track) WHERE confidence < 0.35 AND st.bars >= 24
 UNION ALL SELECT track, 'no-drop-found', 'info' FROM st WHERE bars >= 24 AND track NOT IN (SELECT track FROM sc WHERE label = 'drop') UNION ALL SELECT track, 'drop-rule-relaxed', 'warning' FROM dr JOIN st USING (track) WHERE relaxed AND bars >= 24
 UNION ALL SELECT DISTINCT track, 'cue-pads-empty', 'info' FROM ok JOIN st USING (track) WHERE NOT placed AND bars >= 24 UNION ALL SELECT track, 'track-too-short-to-segment', 'warning' FROM st WHERE bars < 24)
SELECT track, code, severity FROM fi"""
)
def structure_findings(spark, sf_dir):
    counts = bar_rows(spark, sf_dir).groupBy("track").agg(F.count("*").cast("int").alias("bar_count"))
    found = edges(spark, sf_dir).groupBy("track").agg(F.collect_list("bar").alias("boundaries"))
    rows = cued(spark, sf_dir).join(counts, "track").join(found, "track", "left").withColumn("boundaries", F.coalesce("boundaries", F.expr("cast(array() as array<int>)")))
    record = F.struct("sections", "boundaries", "drop_rule_relaxed", "missing_pads", "bar_count")
    return rows.withColumn("s", record).select("track", F.explode(findings.structure_findings(F.col("s"), 0.2)).alias("f")).select("track", "f.code", "f.severity")


# every rule's columns as numbers made of a customer's key, so that each rule holds for some customers and not for others
_TEMPO = """WITH r AS (SELECT c_custkey AS k, c_custkey % 13 = 0 AS none, 60 + c_custkey % 160 + 0.0 AS bpm, (c_custkey % 10) * 0.1 - 0.44 AS off, (c_custkey % 17) / 16.0 AS half_s, (c_custkey % 11) / 10.0 AS third_s, (c_custkey % 7) / 6.0 AS third_m, (c_custkey % 5) * 0.6 AS third_p,
 (c_custkey % 19) / 18.0 AS second, 60 + (c_custkey * 7) % 160 + 0.0 AS second_bpm, 60 + c_custkey % 160 + (c_custkey % 3) * 2.0 AS fourier, (c_custkey % 9) * 0.5 AS pulse, (c_custkey % 21) / 20.0 AS matched, (c_custkey % 6) * 1.0 AS iqr, (c_custkey % 8) * 0.1 AS split, (c_custkey % 4) * 0.75 AS moved, 0.85 + (c_custkey % 12) * 0.1 AS contrast, c_custkey % 14 = 0 AS shifted,
 (c_custkey % 5) * 0.02 AS margin, c_custkey % 2 = 0 AS related, (c_custkey % 41) - 20.0 AS cents, c_custkey % 16 AS sharp, (c_custkey % 3) * 0.5 AS lead FROM customer),
f AS (SELECT k, 0 AS s, 'lead-in-trimmed' AS code, 'info' AS severity FROM r WHERE lead > 0 UNION ALL SELECT k, 1, 'energy-band-applied', 'info' FROM r UNION ALL SELECT k, 2, 'no-candidate', 'warning' FROM r WHERE none
 UNION ALL SELECT k, 3, 'octave-ambiguity', 'warning' FROM r WHERE NOT none AND bpm / 2 >= 80 AND half_s >= 0.85 UNION ALL SELECT k, 3.1, 'octave-ambiguity', 'warning' FROM r WHERE NOT none AND bpm * 2 / 3 >= 80 AND third_s >= 0.85
 UNION ALL SELECT k, 4, 'level-fits-better', 'warning' FROM r WHERE NOT none AND third_m > matched AND third_p > pulse * 1.05 UNION ALL SELECT k, 5, 'non-integer-tempo', 'warning' FROM r WHERE NOT none AND abs(off) > 0.25
 UNION ALL SELECT k, 6, 'metrical-floor-applied', 'info' FROM r WHERE NOT none AND shifted UNION ALL SELECT k, 7, 'close-runner-up', 'warning' FROM r WHERE NOT none AND second >= 0.85 AND NOT (abs(second_bpm - bpm) < 1 OR abs(second_bpm - bpm * 0.5) < 1 OR abs(second_bpm - bpm * (2/3)) < 1 OR abs(second_bpm - bpm * 1.5) < 1 OR abs(second_bpm - bpm * 2) < 1)
 UNION ALL SELECT k, 8, 'estimators-disagree', 'warning' FROM r WHERE NOT none AND abs(fourier - bpm) / bpm > 0.01 UNION ALL SELECT k, 9, 'weak-pulse', 'warning' FROM r WHERE NOT none AND pulse < 1.5 UNION ALL SELECT k, 10, 'grid-misfit', 'warning' FROM r WHERE NOT none AND matched < 0.5
 UNION ALL SELECT k, 11, 'loose-grid', 'warning' FROM r WHERE NOT none AND matched >= 0.5 AND matched < 0.8 UNION ALL SELECT k, 12, 'unstable-tempo', 'warning' FROM r WHERE NOT none AND iqr > 2 UNION ALL SELECT k, 13, 'octave-split-windows', 'info' FROM r WHERE NOT none AND split > 0.15
 UNION ALL SELECT k, 14, 'weighting-changed-answer', 'warning' FROM r WHERE NOT none AND moved > 1 UNION ALL SELECT k, 15, 'range-edge', 'warning' FROM r WHERE NOT none AND (bpm - 60 < 2 OR 220 - bpm < 2) UNION ALL SELECT k, 16, 'flat-bar-phase', 'info' FROM r WHERE NOT none AND contrast < 1.1
 UNION ALL SELECT k, 17, CASE WHEN related THEN 'relative-key-tie' ELSE 'key-tie' END, 'warning' FROM r WHERE margin < 0.05 UNION ALL SELECT k, 18, 'tuning-offset', 'info' FROM r WHERE abs(cents) > 15 UNION ALL SELECT k, 19, 'flat-chroma', 'warning' FROM r WHERE sharp * sqrt(11) / (12 + sharp) < 0.25)
SELECT k, (row_number() OVER (PARTITION BY k ORDER BY severity DESC, s) - 1)::INT AS pos, code, severity FROM f"""


@query(_TEMPO)
def tempo_and_key_findings(spark, sf_dir):
    k = F.col("c_custkey")
    bpm, matched, pulse = 60 + k % 160 + 0.0, (k % 21) / 20.0, (k % 9) * 0.5
    level = lambda label, ratio, s, m, p: F.struct(F.lit(label).alias("label"), (bpm * ratio).alias("bpm"), s.cast("double").alias("salience"), m.cast("double").alias("matched_fraction"), p.cast("double").alias("pulse_ratio"))
    zero, third = F.lit(0.0), (k % 11) / 10.0
    relatives = F.array(level("half", 0.5, (k % 17) / 16.0, zero, zero), level("two-thirds", 2 / 3, third, (k % 7) / 6.0, (k % 5) * 0.6), level("candidate", 1.0, F.lit(1.0), matched, pulse), level("double", 2.0, zero, zero, zero))
    candidate = lambda b, w: F.struct(b.cast("double").alias("bpm"), w.cast("double").alias("weighted_salience"))
    pair = F.array(candidate(bpm, F.lit(1.0)), candidate(60 + (k * 7) % 160 + 0.0, (k % 19) / 18.0))
    shift = F.when(k % 14 == 0, F.struct(*[F.lit(1.0).alias(c) for c in ("from_bpm", "to_bpm", "from_salience", "to_salience")]))
    tempo = F.struct(
        bpm.alias("bpm"), (F.round(bpm) + (k % 10) * 0.1 - 0.44).alias("bpm_measured"), F.lit(1.0).alias("salience"), shift.alias("octave_shift"), F.when(k % 13 == 0, F.slice(pair, 1, 0)).otherwise(pair).alias("candidates"),
        (bpm + (k % 4) * 0.75).alias("bpm_unweighted"), relatives.alias("octave_relatives"), F.struct(matched.alias("matched_fraction"), pulse.alias("pulse_ratio"), F.lit(50.0).alias("tolerance_ms")).alias("grid"),
        F.struct((0.85 + (k % 12) * 0.1).alias("contrast")).alias("bar"), F.struct(((k % 6) * 1.0).alias("interquartile_range_bpm"), bpm.alias("median_bpm"), ((k % 8) * 0.1).alias("octave_split_fraction")).alias("stability"),
        (bpm + (k % 3) * 2.0).alias("fourier_bpm"),
    )
    chroma = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i == 0, 1.0 + (k % 16)).otherwise(1.0))
    key = F.struct(((k % 5) * 0.02).alias("margin"), F.lit("8A").alias("runner_up"), F.when(k % 2 == 0, "8A").otherwise("9A").alias("relative"), F.lit("8B").alias("camelot"), ((k % 41) - 20.0).alias("tuning_cents"), chroma.alias("chroma"))
    energy = F.struct(F.lit(0.5).alias("score"), F.lit("club").alias("band"), F.lit(140.0).alias("centre_bpm"))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), tempo.alias("t"), key.alias("key"), energy.alias("e"), ((k % 3) * 0.5).alias("lead"))
    every = findings.merged(findings.opening_findings(F.col("lead"), F.col("e")), findings.tempo_findings(F.col("t"), 80.0, 0.25, 60.0, 220.0), findings.key_findings(F.col("key")))
    return rows.select("k", F.posexplode(every).alias("pos", "f")).select("k", "pos", "f.code", "f.severity")
