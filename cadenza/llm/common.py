"""Lineage cuts, connected components and Arrow helpers that the operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_stashes: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of
    its own; on a cluster nothing but the setting can name a folder that all machines see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut and a lost executor costs no recomputation.

    The plan runs once (checkpoint() may run its narrow part twice) and the copy is compressed. Folders go with
    spent(), or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _stashes.append((spark, path, None))
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def stash_buckets(df: DataFrame, column: str) -> DataFrame:
    """As stash, in shuffle.partitions hash buckets of `column`: joins by it then shuffle the other side alone.

    Rows that already lie in the partition of their bucket are written as one file a task.
    """
    spark, name = df.sparkSession, f"cadenza_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/cadenza/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), column).saveAsTable(name)
    _stashes.append((spark, path, name))
    return spark.table(name)


def spent(*frames: DataFrame | None) -> None:
    """Deletes the folders of stash()'s frames that no later plan reads."""
    for df in frames:
        if path := getattr(df, "stashed_at", None):
            discard(df.sparkSession, path)


def stash_folder(spark: SparkSession, path: str) -> str:
    """path, which goes when the process ends."""
    _stashes.append((spark, path, None))
    return path


def discard(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_stashes() -> None:
    for spark, path, table in _stashes:
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            discard(spark, path)
        except Exception:  # the session may be gone; its folder is then the cluster's to clear
            return


def give_back() -> None:
    """Returns memory that this process no longer uses to the machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """rows for mapInArrow, after which the worker gives back the memory it no longer uses: workers stay for later
    tasks, and an executor's idle ones would otherwise keep their peaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of texts that a Python worker gets at once, at most; Spark's own 10,000 long texts would fill its memory.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS if it is larger or unlimited."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns under our own names, so extra or clashing columns never matter."""
    bounded_batches(df.sparkSession)
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def crc32_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes sum to about `most`; a single larger item gets a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


#: A key of fewer rows is never split.
SPLIT_LEAST = 20_000


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], least: int | None = None) -> DataFrame:
    """rows joined with table, which has one row a key; a key with many of the rows is split over several tasks.

    rows is a stash or a filter of one, since it is read up to four times. Keys with more than an even partition's share of it, at most as many as there are partitions
    and so safe to broadcast, are joined apart: their rows are salted and their one row of table is repeated for each
    salt. All other keys are joined as they are, so a table in buckets stays where it is.
    """
    least, total, count = SPLIT_LEAST if least is None else least, rows.count(), partitions(rows.sparkSession)
    share = max(least, total // count)
    if total <= share:
        return rows.join(table, keys)
    hot = stash(rows.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") > share).select(*keys, F.ceil(F.col("n_") / share).alias("salts_")))
    if hot.isEmpty():
        return rows.join(table, keys)
    salted = rows.join(F.broadcast(hot), keys).withColumn("salt_", F.pmod(F.xxhash64(*rows.columns), F.col("salts_")).cast("int")).drop("salts_")
    repeated = table.join(F.broadcast(hot), keys).withColumn("salt_", F.explode(F.sequence(F.lit(0), F.col("salts_").cast("int") - 1))).drop("salts_")
    cold = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys)
    return cold.unionByName(salted.join(repeated, [*keys, "salt_"]).drop("salt_"))


#: Edges that one task of components() takes: some tens of MB.
TASK_EDGES = 1_000_000


def _merged(kind: pa.DataType):
    """A partition's edges as stars: each node with the smallest node it reaches within the partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        both = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks], type=kind).combine_chunks()
        codes = both.dictionary_encode()
        names, codes = codes.dictionary, codes.indices.to_numpy()
        order = pa.compute.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b = np.split(rank[codes], 2)
        label = np.arange(len(order))
        while True:  # hook roots to smaller neighbours' roots, then halve all paths
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
        ordered = names.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([ordered, ordered.take(pa.array(label))], names=["a", "b"])

    return rows


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node it reaches.

    Partitions first shrink their own edges to stars, one edge a node. If all that is left fits one task
    (task_edges, a fixed bound), that task finishes. Else large-star and small-star steps alternate until no edge
    changes; their groups are map-side minima, so a node with very many neighbours is one partial aggregate. No
    edge list, node or label reaches the driver. Self loops keep lone nodes. The result is written.
    """
    spark, schema = edges.sparkSession, edges.select("a", "b").schema
    kind = pa.binary() if schema["a"].dataType.typeName() == "binary" else pa.int64()
    now = stash(edges.select("a", "b").mapInArrow(_merged(kind), schema))
    if now.count() <= task_edges:
        return stash(now.coalesce(1).mapInArrow(_merged(kind), schema)).toDF("node", "component")
    a, b = F.col("a"), F.col("b")
    nodes = now.select(a.alias("node")).unionByName(now.select(b.alias("node"))).distinct()
    now = now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct()
    before = None
    while before != (before := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(a, F.min("b")).alias("m"))
        now = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        now = stash(small.unionByName(low.select("a", F.col("m").alias("b"))).where(a != b).distinct())
    found = nodes.join(now.select(a.alias("node"), b.alias("component")), "node", "left")
    return stash(found.select("node", F.coalesce("component", "node").alias("component")))
