"""The relational side of device exports: ids of names, phrase codes, seek points and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import collection

# A phrase's code by its section's label, the bytes that mask phrases, and the device's colours.
PHRASES = {"intro": 1, "build": 2, "steady": 2, "breakdown": 3, "drop": 5, "outro": 6}
MASK = (0xCB, 0xE1, 0xEE, 0xFA, 0xE5, 0xEE, 0xAD, 0xEE, 0xE9, 0xD2, 0xE9, 0xEB, 0xE1, 0xE9, 0xF3, 0xE8, 0xE9, 0xF4, 0xE1)
COLOURS = ("Pink", "Red", "Orange", "Yellow", "Green", "Aqua", "Blue", "Purple")


def phrase_kind(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair]), label)


def masked(byte: Column, position: Column, phrases: Column) -> Column:
    """A byte of a phrase list at a position of it, masked by a byte that depends on the number of phrases."""
    pattern = F.get(F.array(*map(F.lit, MASK)), (position % len(MASK)).cast("int"))
    return byte.bitwiseXOR((pattern + phrases) % 256)


def overview_level(band: Column, height: Column) -> Column:
    """A band's level, 0 to 255, of a display column."""
    return F.round(band / 7.0 * (height / 31.0) * 255).cast("int")


def aligned_size(size: Column, to: int) -> Column:
    return F.ceil(size / to).cast("int") * to


def with_ids(tracks: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Adds <column>_id: names numbered from 1 as they first appear, 0 for null and empty ones."""
    for column in columns:
        _, tracks = collection.index_by(tracks, position, column)
        tracks = tracks.withColumn(f"{column}_id", F.coalesce(F.col(f"{column}_index") + 1, F.lit(0))).drop(f"{column}_index")
    return tracks


def seek_points(frames: DataFrame, by: list[str], points: int) -> DataFrame:
    """(by..., k, first_sample): of `points` equal stretches, the first frame that begins at or after the middle of each,
    else the last one; from rows (by..., first, samples).

    A lower-bound join by one union: middles and frames in one order, with the frames' first samples run backwards.
    """
    total = frames.groupBy(*by).agg(F.sum("samples").alias("total_"), F.max("first").alias("last_"))
    k = total.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    middles = k.select(*by, F.floor((2 * F.col("k") + 1) * F.col("total_") / (2 * points)).cast("long").alias("at_"), "k", "last_")
    both = middles.withColumn("f_", F.lit(None).cast("long")).unionByName(frames.select(*by, F.col("first").cast("long").alias("at_"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("last_"), F.col("first").cast("long").alias("f_")))
    order = W.partitionBy(*by).orderBy(F.desc("at_"), F.asc_nulls_last("f_")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("next_", F.last("f_", ignorenulls=True).over(order)).where("k is not null")
    return found.select(*by, "k", F.coalesce("next_", "last_").alias("first_sample"))
