"""Embedding near-duplicates by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, picked, split_join, stash

_TILE = 4096
#: Rows of a tile that are multiplied with another tile at once.
_STRIP = 512


def _usable(kind: str):
    """Each vector's bytes, or null where it is null, zero, empty or holds null or non-finite components."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            x = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)  # nulls become nan; -0.0 becomes 0.0, so equal vectors have equal bytes
            ends = np.cumsum(sizes)
            wrong, some = (np.concatenate([[0], np.cumsum(test)]) for test in (~np.isfinite(x), x != 0))
            good = (wrong[ends] == wrong[ends - sizes]) & (some[ends] > some[ends - sizes])
            data, width = x.tobytes(), x.itemsize
            out = [data[(e - n) * width : e * width] if ok else None for e, n, ok in zip(ends.tolist(), sizes.tolist(), good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array(out, pa.binary())], names=["vec", "bytes"])

    return rows


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and errors: |unit - scale * code| <= error in the 2-norm, per vector."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + 1e-9) + 1e-12


def tile_links(a: np.ndarray, b: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of unit vectors a[i], b[j] with cosine >= least, a strip of a's rows at a time; b None: pairs
    i < j within a.

    The product of the int8 codes is exact in float32 (64 * 127 * 127 < 2 ** 24; longer vectors go in slices).
    With x = x' + e, |x.y - x'.y'| <= |e_x| + (1 + |e_x|) |e_y| for unit x, y, so a pair whose scaled product is
    below least by more than that is surely no link; all others are recomputed in double precision.
    """
    qa, sa, ea = quantised(a)
    qb, sb, eb = (qa, sa, ea) if b is None else quantised(b)
    other = a if b is None else b
    slices = [slice(d, d + 1024) for d in range(0, qa.shape[1], 1024)]
    right = [qb[:, d].astype(np.float32).T for d in slices]
    # per row and column: least - bound <= scale_a * scale_b * product, a little wider for float32 rounding
    slack = ea.max() + (1 + ea.max()) * eb.max() + 1e-5
    for at in range(0, len(qa), _STRIP):
        rows = slice(at, at + _STRIP)
        product = np.zeros((len(qa[rows]), len(qb)), np.float64 if len(slices) > 1 else np.float32)
        for d, part in zip(slices, right, strict=True):
            product += qa[rows, d].astype(np.float32) @ part
        product *= (sa[rows, None]).astype(np.float32)
        product *= (sb[None, :]).astype(np.float32)
        i, j = np.nonzero(product >= np.float32(least - slack))
        close = product[i, j] >= least - (ea[rows][i] + (1 + ea[rows][i]) * eb[j]) - 1e-5
        i, j = i[close] + at, j[close]
        if b is None:
            i, j = i[i < j], j[i < j]
        keep = np.empty(len(i), bool)
        for s in range(0, len(i), 1 << 18):
            part = slice(s, s + (1 << 18))
            keep[part] = np.einsum("ij,ij->i", a[i[part]], other[j[part]]) >= least
        yield i[keep], j[keep]


def _hooked(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label, in which each index points to its component's smallest one, with the pairs (x, y) joined."""
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return label
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while (label[label] != label).any():
            label = label[label]


def _tile(column: pa.Array, i: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, sizes, unit vectors) of a tile's rows."""
    found = column[i].values
    return found.field("node").to_numpy(), found.field("size").to_numpy(), _unit(found.field("bytes").to_pylist(), kind)


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, tile: int = _TILE) -> DataFrame:
    """(vec, n_links, component_id, kept) of every row of df.

    Two vectors link when their cosine in double precision is at least `least`. Equal vectors are one class that is
    compared once and weighs its rows. Classes are dealt into tiles, and every pair of tiles is one task's matrix
    product on int8 codes (see tile_links): exact, and quadratic in the number of different vectors by nature. A
    tile pair goes through its links a strip at a time and returns one row a linked vector, with the number of its
    links and the first vector it reaches there, never the links: a dense group costs no more rows or memory than any
    other, and time for its products and links.

    A row whose vector is null, empty, zero or holds null or non-finite components links with nothing and is its
    own component. Vectors of different length never link. Null keys count as rows but are the smallest of a
    component only if alone. kept says whether the row's key is its component's. Empty tables give no rows.
    """
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    rows = stash(picked(df, vec=key, vector=vector).select(F.col("vec").cast("long").alias("vec"), F.col("vector")).mapInArrow(_usable(kind), "vec long, bytes binary"))
    good = rows.where("bytes is not null")
    classes = good.groupBy("bytes").agg(F.min("vec").alias("least_vec"), F.count("*").alias("size"))
    count = classes.count()
    tiles = max(1, -(-count // tile))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.length("bytes")).withColumn("tile", F.pmod(F.xxhash64("bytes"), F.lit(tiles)).cast("int")))
    packed = stash(classes.groupBy("width", "tile").agg(F.collect_list(F.struct("node", "size", "bytes")).alias("rows")))
    left = packed.select("width", F.col("tile").alias("i"), F.col("rows").alias("a"))
    right = packed.select("width", F.col("tile").alias("j"), F.col("rows").alias("b"))
    pairs = left.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(tiles - 1)))).join(right, ["width", "j"])
    pairs = pairs.repartition(max(1, min(4096, tiles * (tiles + 1) // 2)), "i", "j")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                nodes, weights, a = _tile(batch.column("a"), row, kind)
                own, b = batch.column("i")[row].as_py() == batch.column("j")[row].as_py(), None
                at = 0  # where the other tile's nodes stand among all
                if not own:
                    other, other_weights, b = _tile(batch.column("b"), row, kind)
                    at, nodes, weights = len(nodes), np.concatenate([nodes, other]), np.concatenate([weights, other_weights])
                total, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                for p, q in tile_links(a, b, least):
                    q = q + at
                    total += np.bincount(p, weights[q], len(nodes)).astype(np.int64) + np.bincount(q, weights[p], len(nodes)).astype(np.int64)
                    label = _hooked(label, p, q)
                linked = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(total[linked]), pa.array(nodes[label[linked]])], names=["node", "links", "to"])

    found = stash(pairs.select("i", "j", "a", "b").mapInArrow(compared, "node long, links long, to long"))
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = classes.join(counts, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least_vec").alias("component_id"))
    named = named.join(smallest, "component").select("bytes", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = split_join(good, named, ["bytes"]).select("vec", "n_links", "component_id")  # a class may hold a third of all rows
    out = out.unionByName(rows.where("bytes is null").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id")))
    return out.select("vec", "n_links", "component_id", F.coalesce(F.col("vec") == F.col("component_id"), F.lit(False)).alias("kept"))
