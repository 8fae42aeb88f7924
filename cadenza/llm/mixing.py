"""Mixing sources to temperature weights, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stash

TOKENS = r"greatest(1L, cast(size(regexp_extract_all({text}, '[^ \\t\\n\\x0B\\f\\r]+', 0)) as bigint))"
#: Rounds of the bisection and points a round tries at once: 60 halvings.
ROUNDS, POINTS = 12, 32


def source_weights(totals: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None) -> DataFrame:
    """(source, tokens, share, exponent, weight, quota) of every source in totals (source, tokens).

    weight is share ** exponent, normalised. The exponent is bisected in [0, 1] (as 60 halvings): the least one whose
    largest oversampling, relative to the least sampled source, stays within max_repeats; or the greatest one whose
    weights' entropy, as a share of the greatest possible, still reaches target_entropy. quota is a source's part
    of the smallest budget that shows every document once; the least sampled source gets exactly its tokens. Totals
    have one row a source. Sources stay rows: only aggregates of all of them (a count, sums, extremes, and a bisection
    round's chosen point) reach the driver. An empty table gives no rows.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")
    totals = stash(totals.where("tokens > 0").select("source", "tokens"))
    count, total, least, most = totals.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    share = F.col("tokens").cast("double") / F.lit(float(total or 1))
    lo, hi = 0.0, 1.0
    if max_repeats is not None:
        # oversampling of a source is share ** (a - 1) up to a factor: its extremes belong to the extreme shares
        for _ in range(ROUNDS * 5 if count else 0):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (least / most) ** (mid - 1) <= max_repeats else (mid, hi)
        exponent = hi
    else:
        for _ in range(ROUNDS if count and count > 1 else 0):
            step = (hi - lo) / POINTS
            tried = F.explode(F.expr(f"transform(sequence(1, {POINTS - 1}), i -> {lo!r}D + i * {step!r}D)"))
            part = totals.select(share.alias("p"), tried.alias("a")).groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("m"))
            reach = F.log("z") - F.col("a") * F.col("m") / F.col("z") >= F.lit(target_entropy) * F.log(F.lit(float(count)))
            good = part.where(reach).agg(F.max("a")).first()[0]
            lo, hi = (lo, lo + step) if good is None else (good, good + step)
        exponent = lo if count and count > 1 else 1.0
    raised = totals.select("*", share.alias("share"), F.pow(share, F.lit(exponent)).alias("raised"))
    norm = float(raised.agg(F.sum("raised")).first()[0] or 1)
    weighed = raised.select("source", "tokens", "share", F.lit(exponent).alias("exponent"), (F.col("raised") / F.lit(norm)).alias("weight"))
    budget = float(weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0)
    quota = F.floor(F.lit(budget) * F.col("weight") + F.lit(1e-6)).cast("long")
    return weighed.withColumn("quota", F.greatest(quota, F.col("tokens")))


def running_sums(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df, written, with `name`: the sum of `value` over the rows of the same group that come before in `order`.

    Rows are range-partitioned by group and order, so a group that holds most rows spreads over many partitions.
    Each partition sums up its own rows; what the partitions before hold of a group comes from a table of one row a
    partition and group. No window is larger than a partition or than their number.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *by, *order).withColumn("part_", F.spark_partition_id())
    ranged = stash(ranged)
    here = W.partitionBy("part_", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("part_", *by).agg(F.sum(value).alias("sum_"))
    sums = sums.select("part_", *by, F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("earlier_"))
    out = ranged.withColumn("here_", F.coalesce(F.sum(value).over(here), F.lit(0))).join(sums, ["part_", *by])
    return out.withColumn(name, F.col("here_") + F.col("earlier_")).drop("part_", "here_", "earlier_")


def _marked(df: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    """df's rows as `whole`, with the name of their source and a mark of key and text that orders them at random."""
    rows = df.select(df[source].alias("source"), df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"), F.struct(*[df[c] for c in df.columns]).alias("whole"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    return rows.withColumn("name", name).withColumn("mark", F.md5(F.concat_ws("|", F.lit(seed), F.col("key").cast("string"), F.md5("text"))))


def draw(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float | None = 2.0, target_entropy: float | None = None, block_tokens: int = 1 << 20, seed: str = "mix") -> DataFrame:
    """(name, key, source, mark, copies, tokens, epoch, block, start_token, quota, weight, exponent): every drawn row.

    Every source's rows are dealt by a hash of key and text into blocks of about block_tokens tokens. An epoch goes through a source's blocks in a permutation of its
    own, and through a block's rows in hash order; a source with quota q and T tokens gets floor(q / T) whole
    epochs, and of the next one the rows that begin before its q'th token. start_token is the row's place in its
    source's stream, so start_token / quota orders the mixed stream with all sources evenly interleaved. Under the
    budget of source_weights every row is drawn at least once.

    Tokens are runs between ASCII spaces, one at least. A null source is one more source, null text has one token.
    Rows that agree in source, key and text are drawn as one of `copies` rows. Places are running sums over range
    partitions, so neither a source nor a block that holds most rows falls to one task. An empty table gives no rows.
    """
    rows = _marked(df, key, text, source, seed).select("name", "source", "key", "mark", F.expr(TOKENS.format(text="text")).alias("tokens"))
    light = stash(rows.groupBy("name", "source", "key", "mark").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies")))
    totals = light.groupBy("name").agg(F.sum("tokens").alias("tokens")).select(F.col("name").alias("source"), "tokens")
    weights = stash(source_weights(totals, max_repeats, target_entropy))
    blocks = F.expr(f"greatest(1L, tokens div {block_tokens})")
    sources = weights.select(F.col("source").alias("name"), F.col("tokens").alias("total"), "quota", blocks.alias("blocks"), "weight", "exponent")
    block = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % F.col("blocks")
    dealt = light.join(sources.select("name", "blocks"), "name").withColumn("block", block).drop("blocks")
    per_block = dealt.groupBy("name", "block").agg(F.sum("tokens").alias("block_size"))
    epochs = per_block.join(sources.drop("blocks"), "name").withColumn("epoch", F.explode(F.expr("sequence(0L, (quota - 1) div total)")))
    turn = F.md5(F.concat_ws("|", F.lit(seed), "name", F.col("epoch").cast("string"), F.col("block").cast("string")))
    epochs = running_sums(epochs.withColumn("turn", turn), ["name", "epoch"], ["turn", "block"], "block_size", "before")
    epochs = epochs.withColumn("block_start", F.col("epoch") * F.col("total") + F.col("before"))
    epochs = epochs.where("block_start < quota").select("name", "block", "epoch", "block_start", "quota", "weight", "exponent")
    uses = running_sums(dealt, ["name", "block"], ["mark", "key"], "tokens", "inside").join(epochs, ["name", "block"])
    return uses.withColumn("start_token", F.col("block_start") + F.col("inside")).where("start_token < quota").drop("block_start", "inside")


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """df's rows, each as often as draw() draws it; the columns stay as they are. See draw for the parameters."""
    drawn = draw(df, key, text, source, **how).select("name", "mark")
    rows = _marked(df, key, text, source, how.get("seed", "mix")).select("name", "mark", "whole")
    return rows.join(drawn, ["name", "mark"]).select("whole.*")
