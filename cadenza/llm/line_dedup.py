"""Lines that occur in several documents, kept only in the first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, partitions, picked, stash

_STRIP = " \t\n\x0b\x0c\r"
_LEAST = -(2**63)


def _line_rows(least: int):
    """The keyed lines of each document and text; rows that repeat both are looked at once a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sent: set[tuple[int, int]] = set()
        for batch in batches:
            high, low, docs, texts, positions = [], [], [], [], []
            for doc, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "text_hash", "text")), strict=True):
                if (doc, text_hash) in sent:
                    continue
                sent.add((doc, text_hash))
                for i, line in enumerate((text or "").split("\n")):
                    key = line.strip(_STRIP)
                    if len(key) >= least:
                        digest = xxhash.xxh3_128_intdigest(key.encode().lower())
                        high.append((digest >> 64) - 2**63)
                        low.append((digest & (2**64 - 1)) - 2**63)
                        docs.append(doc)
                        texts.append(text_hash)
                        positions.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((high, pa.int64()), (low, pa.int64()), (docs, pa.int64()), (texts, pa.int64()), (positions, pa.int32()))], names=["high", "low", "doc", "text_hash", "at"])

    return rows


def _with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a sorted partition: each row gets its key's first document in this partition, and the partition's number."""
    part = TaskContext.get().partitionId()
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, doc = (batch.column(c).to_numpy() for c in ("high", "low", "doc"))
        new = np.ones(len(doc), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))].copy()
        if carry and carry[:2] == (high[0], low[0]):
            upto = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(doc)
            first[:upto] = carry[2]
        carry = (high[-1], low[-1], first[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(np.full(len(doc), part, np.int32))], names=[*batch.schema.names, "first", "part"])


def _bitmap(positions) -> bytes:
    """A compressed bitmap in which the bits of dropped lines are 0 and all other bits up to the last dropped line 1."""
    import zlib

    bits = np.ones(-(-(int(np.max(positions)) + 1) // 8) * 8, bool)  # whole bytes: packing pads with 0
    bits[positions] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def keep_mask(bitmap: bytes | None, lines: int) -> np.ndarray:
    """Whether each of a document's lines stays; no bitmap: all do."""
    import zlib

    mask = np.ones(lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)[:lines]
        mask[: len(bits)] = bits
    return mask


def line_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10) -> DataFrame:
    """(doc, text_hash, bitmap, n_dropped) of the documents that lose lines; all others keep all.

    A line's key is the line stripped of ASCII spaces with A-Z lower-cased. Keys of at least least_chars code points
    that several documents hold stay in the smallest document alone, all its copies included. 128-bit key hashes
    are range-partitioned with document and position as secondary sort, so a line that a third of all documents
    share spreads over many partitions; each sorted partition is streamed once for its keys' first documents, and
    what crosses a partition's edge comes from one summary row a partition. Only dropped positions are regrouped,
    into one compressed bitmap a document.

    Null and empty text are one empty line. Null keys count as the smallest document. Rows that share a key are one
    document for the rule, but each text keeps its own bitmap. Empty tables give no rows.
    """
    spark = df.sparkSession
    docs = _keyed(df, key, text)
    lines = docs.mapInArrow(lean(_line_rows(least_chars)), "high long, low long, doc long, text_hash long, at int")
    order = ["high", "low", "doc", "text_hash", "at"]
    ranged = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    streamed = stash(ranged.mapInArrow(lean(_with_part), "high long, low long, doc long, text_hash long, at int, first long, part int"))
    edge = F.struct("high", "low", "first")
    ends = sorted(streamed.groupBy("part").agg(F.min(edge).alias("lo"), F.max(edge).alias("hi")).collect())
    carried, open_key, open_first = [], None, None
    for part, lo, hi in ends:  # one row a partition
        if open_key == tuple(lo)[:2]:
            carried.append((part, lo[0], lo[1], open_first))
        if open_key != tuple(hi)[:2]:
            open_key, open_first = tuple(hi)[:2], hi[2]
    edges = spark.createDataFrame(carried, "part int, high long, low long, earlier long")
    dropped = streamed.join(F.broadcast(edges), ["part", "high", "low"], "left").where(F.col("doc") != F.coalesce("earlier", "first")).select("doc", "text_hash", "at")
    # a document's positions come in runs of 65536 lines, so no array outgrows that
    parts = dropped.groupBy("doc", "text_hash", F.shiftright("at", 16).alias("run")).agg(F.collect_set(F.col("at").bitwiseAND(65535)).alias("ats"))
    sized = parts.groupBy("doc", "text_hash").agg(F.sum(F.size("ats")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("run", "ats"))).alias("runs"))
    return sized.mapInArrow(lean(_bitmaps), "doc long, text_hash long, bitmap binary, n_dropped long")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for runs in batch.column("runs"):
            found = runs.values
            number, ats = found.field("run").to_numpy(), found.field("ats")
            sizes = np.diff(ats.offsets.to_numpy())
            made.append(_bitmap(np.repeat(number.astype(np.int64) << 16, sizes) + ats.flatten().to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), pa.array(made, pa.binary()), batch.column("n_dropped")], names=["doc", "text_hash", "bitmap", "n_dropped"])


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = picked(df, doc=key, text=text)
    return rows.select(F.coalesce(F.col("doc").cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, drops, kept = [], [], []
        for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            mask = keep_mask(bitmap, len(lines))
            counts.append(len(lines))
            drops.append(int(len(lines) - mask.sum()))
            kept.append("\n".join([x for x, keep in zip(lines, mask.tolist(), strict=True) if keep]))
        names = [n for n in batch.schema.names if n not in ("text", "bitmap")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts, pa.int64()), pa.array(drops, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _apply(batches):
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(sha, pa.string())], names=["key", "n_lines", "n_dropped", "kept_sha256"])


def _matched(df: DataFrame, bitmaps: DataFrame, key: str, text: str) -> DataFrame:
    """Every row of df as one struct column, with its text and bitmap."""
    whole = F.struct(*[df[c] for c in df.columns]).alias("whole")
    rows = df.select(whole, df[key].alias("key"), df[text].alias("text"))
    rows = rows.withColumn("doc", F.coalesce(F.col("key").cast("long"), F.lit(_LEAST))).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(bitmaps.select("doc", "text_hash", "bitmap"), ["doc", "text_hash"], "left")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10) -> DataFrame:
    """df with n_lines, n_dropped and text without the dropped lines; the other columns stay as they are.

    Columns of df that have those names already stay too: ours are then called n_lines_ and n_dropped_. For nulls,
    repeated keys and empty tables see line_bitmaps; repeated rows stay repeated, each without the same lines. A text
    that loses no line stays as it is, null too.
    """
    rows = _matched(df, line_bitmaps(df, key, text, least_chars), key, text).select("whole", "text", "bitmap")
    schema = rows.select("whole").schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    out = rows.mapInArrow(lean(_apply), schema)
    thinned = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("whole")[text])
    columns = [thinned.alias(c) if c == text else F.col("whole")[c].alias(c) for c in df.columns]
    return out.select(*columns, *[F.col(c).alias(name) for c, name in zip(("n_lines", "n_dropped"), fresh(df, "n_lines", "n_dropped"), strict=True)])


def line_digests(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10) -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256) of every row of df."""
    rows = _matched(df.select(df[key].alias("k"), df[text].alias("t")), line_bitmaps(df, key, text, least_chars), "k", "t")
    return rows.select("key", "text", "bitmap").mapInArrow(lean(_digest), "key long, n_lines long, n_dropped long, kept_sha256 string")
