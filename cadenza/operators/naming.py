"""Names, codes and packed values of a track collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_name(bpm: Column, camelot: Column, name: Column) -> Column:
    """BPM_key_name.ext with padded numbers, the name without such a prefix of its own; null unless 1 <= bpm < 1000 and
    the key is 1A to 12B."""
    number = F.regexp_extract(camelot, "^([0-9]+)[AB]$", 1)
    value = F.when(F.length(number).between(1, 9), number.cast("int"))
    good = (bpm >= 1) & (bpm < 1000) & value.between(1, 12)
    stem, ext = F.regexp_replace(name, r"(?s)\.[^.]*$", ""), F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1)
    return F.when(good, F.concat(F.lpad(F.round(bpm).cast("int").cast("string"), 3, "0"), F.lit("_"), F.lpad(value.cast("string"), 2, "0"), F.right(camelot, F.lit(1)), F.lit("_"), strip_prefix(stem), ext))


def strip_prefix(name: Column) -> Column:
    """name without a leading BPM_key_; the key's number may be any two digits."""
    return F.regexp_replace(name, "^[0-9]{3}_[0-9]{2}[AB]_", "")


def device_string_size(text: Column) -> Column:
    """struct<lead, size>: the first byte and the length of a device string: short ASCII has its length in the first
    byte, long ASCII and everything else four bytes before it, the latter two bytes a UTF-16 unit."""
    ascii_, n = ~text.rlike(r"[^\x00-\x7F]"), F.length(text)
    units = n + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    short = ascii_ & (n <= 126)
    return F.struct(F.when(short, F.shiftleft(n + 1, 1).bitwiseOR(1)).when(ascii_, 0x40).otherwise(0x90).alias("lead"), F.when(short, n + 1).when(ascii_, n + 4).otherwise(2 * units + 4).alias("size"))


def bitrate(ext: Column, rate: Column, channels: Column, size: Column, seconds: Column) -> Column:
    """kbit/s: of 16-bit PCM for lossless formats, of the file for others, 0 without a duration."""
    lossless = F.lower(ext).isin("wav", "aiff", "aif", "flac")
    return F.when(lossless, F.floor(rate * 16 * channels / 1000)).when(seconds > 0, F.round(size * 8 / seconds / 1000)).otherwise(0).cast("long")


def path_hash(path: Column) -> Column:
    """The analysis folder's index: two multiply-adds a UTF-16 unit modulo 2^32, then modulo 200003."""
    wrap = lambda x: F.pmod(x, F.lit(4294967296))
    step = lambda h, c: wrap(wrap(h * 23497 + c) * 37813 + c)
    digits = F.hex(F.encode(path, "UTF-16BE"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(4))).otherwise(F.expr("cast(array() as array<int>)"))
    units = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(0).cast("long"), step) % 200003


def analysis_folder(path: Column) -> Column:
    """Where a track's analysis files lie on the device."""
    index = path_hash(path)
    return F.format_string("/PIONEER/USBANLZ/P%03X/%08X", path_bucket(index).cast("long"), index)


def path_bucket(index: Column) -> Column:
    """Seven scattered bits of the index, packed."""
    return sum((F.shiftright(index, bit).bitwiseAND(1) * (1 << place) for place, bit in enumerate((0, 2, 6, 7, 9, 13, 16))), F.lit(0))


def packed_column(height: Column, low: Column, mid: Column, high: Column) -> Column:
    """A display column's two bytes as one number: five bits of height and three of each band."""
    return height.bitwiseAND(31).bitwiseOR(F.shiftleft(low.bitwiseAND(7), 5)).bitwiseOR(F.shiftleft(mid.bitwiseAND(7), 8)).bitwiseOR(F.shiftleft(high.bitwiseAND(7), 11))


def dictionary(df: DataFrame, position: str, column: str) -> DataFrame:
    """(column, code): distinct non-empty values numbered from 0 as they first appear.

    First positions are pre-aggregated; the values are then range-partitioned by them, numbered within each partition,
    and moved up by what the partitions before hold, a table of one row a partition. No task holds all values. The
    ranged values stay cached, since ranges are cut anew in every run, until spark.catalog.clearCache().
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    first = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.min(position).alias("first_"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the partition is fixed before the two uses: ranges are cut from a sample, which may differ between runs
    ranged = first.repartitionByRange(parts, "first_", column).withColumn("part_", F.spark_partition_id()).persist()
    counts = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    earlier = counts.select("part_", F.coalesce(F.sum("n_").over(W.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    place = F.row_number().over(W.partitionBy("part_").orderBy("first_", column)) - 1
    return ranged.withColumn("place_", place).join(F.broadcast(earlier), "part_").select(column, (F.col("place_") + F.col("before_")).cast("int").alias("code"))
