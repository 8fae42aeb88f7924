"""Secret spans and what the corpus says about who owns them, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import picked, split_join, stash

# Fixed values: (kind, pattern, group that must be long enough, its least length), in listed order.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
_SPAN = "struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>"
_PARTS = "array<struct<kind_no:int,kind:string,pos:int,gap:bigint,n:bigint,value:string>>"


def _parts(number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All of a pattern's matches in `text`, each with the length of the gap since the one before: matches and gaps
    alternate, so running sums of their lengths give every place. Texts without the pattern are read once."""
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    value = f"regexp_extract(x.`0`, {quoted}, {group})" if group else "x.`0`"
    matches = f"regexp_extract_all(text, {quoted}, 0)"
    found = f"""transform(arrays_zip({matches}, split(text, {quoted}, -1)), (x, i) -> struct({number} as kind_no, '{kind}' as kind, i as pos,
        cast(length(x.`1`) as bigint) as gap, cast(length(x.`0`) as bigint) as n, {value} as value))"""
    return F.expr(f"if(rlike(text, {quoted}), cast({found} as {_PARTS}), cast(array() as {_PARTS}))")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def base_spans(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, spans), both written: (rid, key) of every row, and (rid, key, owner, start, kind_no, kind, end, value,
    secret) of every span of KINDS. Places are running sums over a row's matches of a kind, so a text's work grows
    with its matches and not with their square."""
    docs = picked(df, key=key, text=text, owner=owner).withColumn("text", F.coalesce("text", F.lit("")))
    every = F.concat(*[_parts(i, *kind) for i, kind in enumerate(KINDS)])
    rows = stash(docs.select(F.monotonically_increasing_id().alias("rid"), "key", "owner", every.alias("parts")))
    each = rows.select("rid", "key", "owner", F.explode("parts").alias("p")).select("rid", "key", "owner", "p.*").where("n is not null")
    end = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy("rid", "kind_no").orderBy("pos"))
    long_enough = F.expr("case " + " ".join(f"when kind_no = {i} then length(value) >= {least}" for i, (*_, least) in enumerate(KINDS)) + " end")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).where(long_enough)
    return rows, stash(placed.select("rid", "key", "owner", "start", "kind_no", "kind", "end", "value", F.sha2("value", 256).alias("secret")))


def ownership(spans: DataFrame) -> DataFrame:
    """(secret, n_owners, n_repositories) of every distinct candidate value, over the whole corpus.

    A repository is a document of an owner. Values are first reduced to one row a repository and then counted
    owner by owner, so a value that a third of all documents hold is pre-aggregated before each shuffle.
    """
    repositories = spans.groupBy("secret", "owner", "key").agg(F.lit(1).alias("one"))
    owners = repositories.groupBy("secret", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("secret").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", copied_owners: int = 3, copied_repositories: int = 16, varied: int = 8) -> DataFrame:
    """(key, base, spans, n_live, n_example, most_owners, most_repositories) of every row of df.

    base holds the spans of KINDS, in code points, end exclusive. The method then asks the whole corpus in how many
    repositories (documents) of how many owners each candidate value stands. One of at least copied_owners owners
    or copied_repositories repositories is a widely copied example. One of a single owner and fewer repositories is
    owner-specific; if it is live-looking (at least `varied` different characters, a digit among them), it is a
    credential. What two owners share in few repositories is neither. Each such verdict adds a span of kind
    `example` or `live` over the base span; base spans stay. most_owners and most_repositories are the greatest
    counts of the row's values, 0 without any.

    Nulls: null text is empty, a null owner is one more owner, a null key one more repository. Every row of df,
    repeated ones too, gives one row. Very long texts and texts of very many spans are worked through in time that
    grows with their length. A value that very many documents hold is split over tasks. Empty tables give none.
    """
    rows, each = base_spans(df, key, text, owner)
    judged = split_join(each, ownership(each), ["secret"])
    value = F.col("value")
    live_looking = (F.size(F.array_distinct(F.split(value, ""))) >= varied) & value.rlike("[0-9]")
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    verdict = F.when(copied, "example").when((F.col("n_owners") == 1) & live_looking, "live")
    judged = judged.withColumn("verdict", verdict)
    number = F.when(F.col("verdict") == "live", len(KINDS)).otherwise(len(KINDS) + 1)
    span = lambda no, kind: F.struct("start", no.alias("kind_no"), kind.alias("kind"), "end", "value")
    added = F.when(F.col("verdict").isNotNull(), span(number, F.col("verdict")))
    per_row = judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(span(F.col("kind_no"), F.col("kind")))).alias("base"), F.collect_set(added).alias("added"),
        F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
    )
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    both = rows.select("rid", "key").join(per_row, "rid", "left").withColumn("base", F.coalesce("base", none)).withColumn("added", F.coalesce("added", none))
    zero = F.lit(0).cast("long")
    return both.select(
        "key", "base", F.array_sort(F.concat("base", "added")).alias("spans"), *[_count("added", kind) for kind in ("live", "example")],
        F.coalesce("most_owners", zero).alias("most_owners"), F.coalesce("most_repositories", zero).alias("most_repositories"),
    )


def secret_digests(found: DataFrame) -> DataFrame:
    """One row a document: base counts, the base spans' checksum and all spans as text."""
    counts = [_count("base", kind) for kind, *_ in KINDS]
    return found.select("key", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example", "most_owners", "most_repositories")
