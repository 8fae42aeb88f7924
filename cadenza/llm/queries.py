"""The operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, flac, licenses, line_dedup, mixing, ngram_join, packing, quality, secrets, sharding

SHARDS = 8
TOKENIZER = "word_bpe_49k.json"
KEEP = 0.7


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(_table(spark, sf_dir, "documents"))
    return drawn.select(F.col("key").alias("doc_id"), "source", "copies", "tokens", "epoch", "block", "start_token", "quota", F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.shingle_components(_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("doc", "doc_id")


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(flac.pcm_blocks(_table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("key", "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, _table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return quality.score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return secrets.secret_digests(found).withColumnRenamed("key", "doc_id")


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("vec", "vec_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_mixing, op3_ngram_join, op4_flac, op5_packing, op6_line_dedup, op7_quality, op8_secrets, op9_embed_dedup, op10_licenses)}


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS name,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))) AS tok,
         md5(concat_ws('|', 'mix', doc_id::VARCHAR, md5(coalesce(text, '')))) AS mark
  FROM documents),
light AS (SELECT name, source, doc_id, mark, sum(tok)::BIGINT AS tokens, count(*) AS copies FROM d GROUP BY ALL),
tot AS (SELECT name, sum(tokens)::BIGINT AS total FROM light GROUP BY name),
p AS (SELECT name, total, total::DOUBLE / (sum(total) OVER ())::DOUBLE AS share FROM tot),
e AS (SELECT *, CASE WHEN max(share) OVER () / min(share) OVER () <= 2.0 THEN 0.0
             ELSE 1 - ln(2.0) / ln(max(share) OVER () / min(share) OVER ()) END AS exponent FROM p),
w AS (SELECT *, pow(share, exponent) / sum(pow(share, exponent)) OVER () AS weight FROM e),
q AS (SELECT name, total, exponent, weight,
             greatest(floor(max(total / weight) OVER () * weight + 1e-6)::BIGINT, total) AS quota,
             greatest(1, total // 1048576) AS blocks FROM w),
dealt AS (SELECT l.*, ('0x' || substr(mark, 1, 8))::BIGINT % q.blocks AS block FROM light l JOIN q USING (name)),
pb AS (SELECT name, block, sum(tokens)::BIGINT AS block_size FROM dealt GROUP BY ALL),
ep AS (SELECT name, block, block_size, total, quota, weight, exponent, unnest(range(0, (quota - 1) // total + 1)) AS epoch FROM pb JOIN q USING (name)),
st AS (SELECT *, epoch * total + coalesce(sum(block_size) OVER (PARTITION BY name, epoch
             ORDER BY md5(concat_ws('|', 'mix', name, epoch::VARCHAR, block::VARCHAR)), block
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start FROM ep),
ins AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY name, block ORDER BY mark
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM dealt)
SELECT i.doc_id, i.source, i.copies, i.tokens, s.epoch::BIGINT AS epoch, i.block, (s.block_start + i.inside)::BIGINT AS start_token,
       s.quota, round(s.weight, 9) AS weight, round(s.exponent, 9) AS exponent
FROM ins i JOIN st s USING (name, block) WHERE s.block_start + i.inside < s.quota
"""

_SHINGLES = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all("""
    + _FOLD.format("coalesce(text, '')")
    + r""", '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
)

_LINES = (
    r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, """
    + _FOLD.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")
    + r""" AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
)


def _secret_sql() -> str:
    parts = []
    for i, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, source, {i} AS no, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM (SELECT doc_id, source,
          regexp_extract_all(t, {quoted}, 0) AS m, regexp_extract_all(t, {quoted}, {group}) AS v, string_split_regex(t, {quoted}) AS g FROM d)""")
    parts = " UNION ALL ".join(f"SELECT doc_id, source, no, kind, i, m, v[i] AS v, g FROM ({p}) WHERE length(v[i]) >= {k[3]}" for p, k in zip(parts, secrets.KINDS, strict=True))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, source, no, kind, v, i, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS a, length(m[i]) AS n FROM ({parts})),
o AS (SELECT v, count(*) AS owners, sum(n)::BIGINT AS repositories FROM (SELECT v, source, count(*) AS n FROM (SELECT DISTINCT v, source, doc_id FROM s) GROUP BY v, source) GROUP BY v),
j AS (SELECT s.*, owners, repositories, CASE WHEN owners >= 3 OR repositories >= 16 THEN 'example' WHEN owners = 1 AND len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[0-9]') THEN 'live' END AS verdict FROM s JOIN o USING (v)),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, no) AS base, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example, max(owners) AS most_owners, max(repositories) AS most_repositories FROM j GROUP BY doc_id),
u AS (SELECT doc_id, a, no, kind, n, v FROM j UNION ALL SELECT doc_id, a, CASE verdict WHEN 'live' THEN 3 ELSE 4 END, verdict, n, v FROM j WHERE verdict IS NOT NULL),
x AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, no, n) AS spans FROM u GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)
"""


_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def _license_sql() -> str:
    """Blocks are looked at in documents that hold a label's required words; each begins at a template's word."""
    words = ", ".join(f"({i}, '{label}', '{text}', '{' '.join(licenses.REQUIRED[label])}')" for i, (label, text) in enumerate(licenses.TEMPLATES))
    top, low = licenses.THRESHOLD.numerator, licenses.THRESHOLD.denominator
    phrases = " UNION ALL ".join(
        f"SELECT a.doc_id, a.pos AS pos, '{label}' AS label FROM k a " + " ".join(f"JOIN k b{j} ON b{j}.doc_id = a.doc_id AND b{j}.pos = a.pos + {j} AND b{j}.word = '{word}'" for j, word in enumerate(phrase.split()) if j) + f" WHERE a.word = '{phrase.split()[0]}'"
        for phrase, label in licenses.PHRASES.items()
    )
    return (
        r"""
WITH d AS (SELECT doc_id, regexp_extract_all("""
        + _FOLD.format("coalesce(text, '')")
        + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
k AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM d),
p AS ("""
        + phrases
        + f"""),
x AS (SELECT no, label, list_distinct(string_split(txt, ' ')) AS own, string_split(must, ' ') AS must FROM (VALUES {words}) AS x(no, label, txt, must)),
t AS (SELECT no, label, unnest(own) AS word, len(own) AS size, len(must) AS musts, must FROM x),
h AS (SELECT k.doc_id, t.no, t.label, t.size, t.musts, k.word, k.pos, list_contains(t.must, k.word) AS needed FROM k JOIN t USING (word)),
c AS (SELECT doc_id, no FROM h GROUP BY ALL HAVING count(DISTINCT CASE WHEN needed THEN word END) = max(musts) AND count(DISTINCT word) * {low} >= max(size) * {top}),
g0 AS (SELECT h.* FROM h JOIN c USING (doc_id, no)),
g1 AS (SELECT doc_id, no, word, pos, needed, pos // (2 * size) AS bucket FROM g0 UNION ALL SELECT doc_id, no, word, pos, needed, pos // (2 * size) - 1 FROM g0),
f AS (SELECT a.doc_id, a.label, count(DISTINCT b.word) / a.size AS share FROM g0 a JOIN g1 b ON b.doc_id = a.doc_id AND b.no = a.no AND b.bucket = a.pos // (2 * a.size) AND b.pos >= a.pos AND b.pos < a.pos + 2 * a.size
 GROUP BY a.doc_id, a.no, a.label, a.size, a.musts, a.pos HAVING count(DISTINCT b.word) * {low} >= a.size * {top} AND count(DISTINCT CASE WHEN b.needed THEN b.word END) = a.musts),
g AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT doc_id, label, share FROM f UNION ALL SELECT doc_id, label, 1.0 FROM p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id)
"""
    )


def oracle_sql() -> dict[str, str]:
    """Sharding needs checksums, packing a tokenizer, the codec and the classifier their own code: no SQL for those."""
    return {
        "op2_mixing": _MIX, "op3_ngram_join": _SHINGLES, "op6_line_dedup": _LINES,
        "op8_secrets": _secret_sql(), "op9_embed_dedup": _VECTORS, "op10_licenses": _license_sql(),
    }
