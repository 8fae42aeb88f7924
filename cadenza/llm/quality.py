"""A supervised subword-embedding classifier of document quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, fresh, give_back, lean, picked, spent, stash
from .shingles import SPACES, Words, splitmix

BUCKETS = 1 << 17
_IDENTITY = np.arange(256, dtype=np.uint8)
_CHUNK = 1 << 19


@dataclass(frozen=True)
class Model:
    """Bucket vectors and the softmax layer, folded into one weight a bucket.

    The text vector is the mean of its buckets' vectors and the logit difference is linear in it, so the mean of
    `weights` over a text's n-grams plus `bias` is exactly that difference.
    """

    weights: np.ndarray
    bias: float


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of all texts, and the number of the text that each belongs to.

    Byte 3-grams of the text as it stands, words, and pairs of neighbouring words; a pair's hash is that of the
    difference of its words' hashes, so any word that directly repeats falls into one bucket.
    """
    is_word = np.ones(256, bool)
    is_word[list(SPACES)] = False
    words = Words(texts, is_word, _IDENTITY)
    data = words.data.astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words.text_starts))
    grams = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(15)
    inside = owner[:-2] == owner[2:]  # the third byte may be the text's closing space
    word_owner = np.repeat(np.arange(len(texts), dtype=np.int32), words.counts())
    shift = np.uint64(64 - 17)
    single = (words.hashes >> shift).astype(np.uint32)
    with np.errstate(over="ignore"):
        pairs = (splitmix(words.hashes[1:] - words.hashes[:-1] + np.uint64(77)) >> shift).astype(np.uint32)
    same = word_owner[1:] == word_owner[:-1]
    return np.concatenate([grams[inside], single, pairs[same]]), np.concatenate([owner[:-2][inside], word_owner, word_owner[1:][same]])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shares = [], []
        for text in as_bytes(batch.column("text")):
            buckets, _ = _buckets([text])
            unique, counts = np.unique(buckets, return_counts=True)
            ids.append(unique.astype(np.int32).tobytes())
            shares.append((counts / max(1, counts.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["rank", "label", "ids", "shares"])


def sgd(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 8, steps: int = 40_000, rate: float = 0.6, seed: int = 7) -> Model:
    """Plain stochastic gradient descent, one document a step, on the bucket vectors and the softmax layer together.

    The rate falls linearly to 0. Bucket vectors move by the document's share of each bucket times its size, as
    where every n-gram's vector takes the whole gradient of the mean.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    epochs = min(60, max(3, steps // len(rows)))
    done, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            label, ids, shares = rows[i]
            own = vectors[ids]
            hidden = shares @ own
            logits = hidden @ layer + bias
            probs = np.exp(logits - logits.max())
            probs /= probs.sum()
            probs[label] -= 1
            now = np.float32(rate * (1 - done / total))
            back = layer @ probs
            layer -= now * np.outer(hidden, probs)
            bias -= np.float32(0.1) * now * probs
            vectors[ids] = own - now * 30 * shares[:, None] * back
            done += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _stretches(sizes: list[tuple[int, int]], most: int, each: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of ascending ranks that hold about `each` shares, as far as `most` shares reach; equal ranks stay together."""
    out: list[tuple[int, int]] = []
    held = total = 0
    for rank, n in sizes:
        total += n
        if total > most:
            return [r for r in out if r[1] < rank] if out and out[-1][1] == rank else out
        if out and (held + n <= each or out[-1][1] == rank):
            out[-1], held = (out[-1][0], rank), held + n
        else:
            out.append((rank, rank))
            held = n
    return out


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = 6000, most_shares: int = 16_000_000) -> Model:
    """The model fitted on at most most_rows labelled rows, the first in the order of their keys' hash.

    Those bounds are the only sample: its rows' bucket shares (not texts) come to the driver, 8 bytes each, and no more
    than most_shares in all: rows are taken in their order as far as that reaches, so very long texts can't fill the
    driver. Texts of usual length stay far below it. Rows whose crc32(key as text) mod 4 is 2 are never used, nor null keys or
    labels; a key with several labels takes the least, one with several texts that of the least hash. No labels: a
    model that scores 0.5 everywhere.
    """
    marks = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).dropna()
    marks = marks.where(F.crc32(F.col("key").cast("string").cast("binary")) % 4 != 2).groupBy("key").agg(F.min("label").alias("label"))
    chosen = marks.withColumn("rank", F.xxhash64("key")).orderBy("rank", "key").limit(most_rows)
    texts = picked(df, key=key, text=text).join(F.broadcast(chosen), "key")
    texts = texts.withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.groupBy("rank", "label", "key").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")).select("rank", "label", F.col("one.text").alias("text"))
    rows = stash(texts.mapInArrow(lean(_features), "rank long, label int, ids binary, shares binary"))
    sizes = rows.select("rank", (F.length("ids") / 4).cast("long").alias("n")).orderBy("rank").collect()
    taken = []
    for low, high in _stretches([(r.rank, r.n) for r in sizes], most_shares):
        # a few MB at a time, as arrays at once: the driver never holds the rows twice
        taken += [(r.rank, r.label, bytes(r.ids), np.frombuffer(r.shares, np.float32)) for r in rows.where(F.col("rank").between(low, high)).collect()]
    spent(rows)
    taken.sort(key=lambda r: r[:3])
    model = sgd([(int(label > 0), np.frombuffer(ids, np.int32), shares) for _, label, ids, shares in taken])
    del taken
    give_back()
    return model


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """The probability of label 1 for each text; a text without n-grams has that of the bias alone."""
    out = np.empty(len(texts))
    for a, b in chunks([len(t) + 1 for t in texts], _CHUNK):
        buckets, owner = _buckets(texts[a:b])
        sums = np.bincount(owner, model.weights[buckets], b - a)
        out[a:b] = sums / np.maximum(np.bincount(owner, minlength=b - a), 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """df with a double column `name`: the probability of label 1 of each whole text.

    Null text counts as empty. Only the text is an input; all columns pass through unchanged, so extra ones,
    nulls and repeated rows do no harm, and equal texts get equal scores. Where df has a column of that name already,
    ours is the one with underscores behind it. Very long texts are scored whole. An empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0)
            yield pa.RecordBatch.from_arrays([whole, pa.array(scores(as_bytes(batch.column(1)), model))], names=["whole", "score_"])

    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("whole"), df[text].alias("text_"))
    out = rows.mapInArrow(lean(scored), rows.select("whole").schema.add("score_", "double"))
    return out.select(*[F.col("whole")[c].alias(c) for c in df.columns], F.col("score_").alias(fresh(df, name)[0]))
