"""Contiguous shards of near equal bytes, cut from a global prefix sum."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_of, partitions, picked, stash


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and, within it, the bytes and rows before each row."""
    import numpy as np

    part, total, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        before = total + np.cumsum(sizes) - sizes
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(before), pa.array(rows + np.arange(len(sizes)))],
            names=[*batch.schema.names, "part", "before", "nth"],
        )
        total, rows = total + int(sizes.sum()), rows + len(sizes)


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, crc, shard, slot) of every row: shards are contiguous in key order and near equal in bytes.

    Rows are range-partitioned and sorted by key; each partition reports its total bytes and rows, the totals (one
    row a partition, the only thing the driver sees) are prefix-summed, and a row whose first byte stands at
    global position p of T goes to shard floor(p * shards / T). No shard then exceeds T / shards by more than one
    row's size. slot counts a shard's rows from 0 without gaps. Texts never move: only sizes are shuffled.

    Null text has size 1 (0 bytes plus 1), as has empty text. Null keys come first. Equal keys and repeated rows
    are separate rows in a fixed order by checksum and size; wholly equal ones may swap slots. An empty table
    gives no rows. A hot key is split over partitions by the range partitioner's other columns and then by rows.
    """
    spark = df.sparkSession
    rows = picked(df, key=key, text=text)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = rows.select("key", size.alias("size"), crc32_of(F.col("text")).alias("crc"))
    # rows that are wholly equal are told apart by their place, so that even those are split over partitions
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    order = ["key", "crc", "size", "place"]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("nth", T.LongType())])
    placed = stash(ranged.mapInArrow(_running, schema))
    ends = sorted(placed.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())
    starts, total, count = [], 0, 0
    for part, bytes_, n in ends:
        starts.append((part, total, count))
        total, count = total + bytes_, count + n
    offsets = spark.createDataFrame(starts, "part int, bytes_at long, rows_at long")
    # decimals: exact at any size, where a double could move a row that stands right at a cut
    shard = F.least(F.lit(shards - 1), F.expr(f"cast(cast(before + bytes_at as decimal(20, 0)) * {shards} div {max(1, total)} as int)"))
    placed = placed.join(F.broadcast(offsets), "part").withColumn("shard", shard).withColumn("row", F.col("nth") + F.col("rows_at"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("key", "size", "crc", "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """The rows of df as one folder a shard, each file sorted by slot; assigned comes from assign_shards on unique keys."""
    names = assigned.select(F.col("key").alias(key), "shard", "slot")
    df.join(names, key).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
