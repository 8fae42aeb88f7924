"""Best-fit packing of token pieces into sequences by a linear grouping scheme on the length histogram."""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, picked, stash
from .word_ids import WordTokens

_PIECE = "key {key}, piece int, start long, length long, ids_crc32 long, part int, nth long"


@functools.cache
def _tokens(path: str, words: int) -> WordTokens:
    """One a Python worker, so that a worker's later tasks find the words of earlier ones."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(path, words)


def token_pieces(df: DataFrame, tokenizer: str, room: int = 2048, key: str = "doc_id", text: str = "text", closing: int = 0, words: int = 1_500_000) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, nth): every document's ids and one closing id, cut at `room`.

    Null text is empty: the closing id alone. part and nth number the pieces of each length within a partition,
    as ranks for the packing; the result must be written before it is used twice. A worker keeps the ids of up to
    `words` words, some 30 bytes each: more memory for less time, with the same ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, part = _tokens(tokenizer, words), [0] * (room + 1), TaskContext.get().partitionId()
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            encoded = ((a + j, ids) for a, b in chunks([len(t) for t in texts], 1 << 20) for j, ids in enumerate(tokens.encode(texts[a:b])))
            for i, ids in encoded:
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * room)):
                    own = ids[at : at + 4 * room]
                    n = len(own) // 4
                    rows.append((i, piece, at // 4, n, zlib.crc32(own), seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:5], types, strict=True)), pa.array([part] * len(rows), pa.int32()), pa.array(columns[5], pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    rows = picked(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lean(cut), _PIECE.format(key=kind))


#: (what share of a bin is large, how many groups), as best_plan tries them.
CHOICES = [(1 / 3, 48), (1 / 3, 24), (1 / 4, 48), (1 / 4, 96)]


def _configurations(sizes: list[int], counts: list[int], room: int) -> list[tuple[dict[int, int], int]]:
    """(members by group, times): whole configurations of a near-optimal fractional packing of a few sizes.

    Gilmore-Gomory column generation: a revised simplex whose pricing is an unbounded knapsack over `room`.
    Times are rounded down; what is left over is packed greedily by the caller.
    """
    n = len(sizes)
    demand = np.array(counts, float)
    columns = [np.eye(n)[i] * (room // sizes[i]) for i in range(n)]
    basis = np.array(columns).T
    level = np.linalg.solve(basis, demand)
    for _ in range(40 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        best, take = np.zeros(room + 1), np.full(room + 1, -1)
        for i, size in enumerate(sizes):
            if price[i] <= 1e-12:
                continue
            for _ in range(room // size):
                gain = best[:-size] + price[i]
                better = gain > best[size:] + 1e-12
                if not better.any():
                    break
                best[size:][better], take[size:][better] = gain[better], i
        at = int(best.argmax())
        if best[at] <= 1 + 1e-9:
            break
        column = np.zeros(n)
        while at > 0 and take[at] >= 0:
            column[take[at]] += 1
            at -= sizes[take[at]]
        if (column * sizes).sum() > room or column @ price <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        level = level - step * direction
        level[out] = step
        basis[:, out] = column
    return [({i: int(c) for i, c in enumerate(basis[:, j]) if c > 0.5}, int(level[j] + 1e-9)) for j in range(n) if level[j] >= 1]


def best_plan(histogram: dict[int, int], room: int = 2048) -> list[tuple[int, dict[int, int]]]:
    """The plan with the fewest bins among a few choices of what is large and how fine the groups are; each costs
    about a second or less, and the first one that needs no more bins than the tokens fill is taken."""
    total = sum(n * c for n, c in histogram.items())
    best, best_count = [], float("inf")
    for large, groups in CHOICES:
        plan = plan_bins(histogram, room, large, groups)
        if (count := sum(c for c, _ in plan)) < best_count:
            best, best_count = plan, count
        if best_count <= -(-total // room):
            break
    return best


def plan_bins(histogram: dict[int, int], room: int = 2048, large: float = 1 / 3, groups: int = 48) -> list[tuple[int, dict[int, int]]]:
    """(count, {length: how many}) of bin kinds that pack the histogram's pieces into near-fewest bins of `room`.

    Lengths over large * room are split into `groups` groups of equal cardinality and rounded up to their group's
    greatest; the few sizes' configurations are optimised. Real lengths then replace the rounded ones: each member but
    the last by the longest piece left that its size takes, the last one by the longest that the bin still takes,
    which is longer than its own group's where rounding left room, so most bins become quite full. What is left,
    small pieces and large ones of configurations of one piece or of fractions, goes in falling length where it fits
    best. The work and the result depend on the number of distinct lengths, not of pieces: runs of equal bins are
    handled as one kind with a count.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    bins: list[tuple[int, dict[int, int]]] = []
    if left.get(room):
        bins.append((left.pop(room), {room: 1}))
    bigs = sorted((n for n in left if n > large * room), reverse=True)
    total = sum(left[n] for n in bigs)
    open_by_space: dict[int, list[list]] = defaultdict(list)
    spaces: list[int] = []

    def put(count: int, inside: dict[int, int]) -> None:
        space = room - sum(n * k for n, k in inside.items())
        if not open_by_space[space]:
            insort(spaces, space)
        open_by_space[space].append([count, inside])

    if total:
        # groups of equal cardinality over falling lengths; a length may straddle groups, whose sizes are then equal
        quota, seen, demand = -(-total // groups), 0, defaultdict(int)
        for n in bigs:
            c = left[n]
            while c:
                if seen % quota == 0:
                    size = n
                now = min(c, quota - seen % quota)
                demand[size] += now
                seen, c = seen + now, c - now
        sizes, stock = list(demand), bigs[::-1]  # stock ascends

        def longest(most: int, use: dict[int, int]) -> int | None:
            """The longest large piece of at most `most` that is left beside those in use."""
            for i in range(bisect_right(stock, most) - 1, -1, -1):
                if left[stock[i]] > use.get(stock[i], 0):
                    return stock[i]
            return None

        for members, times in _configurations(sizes, [demand[s] for s in sizes], room):
            wanted = [sizes[g] for g in sorted(members) for _ in range(members[g])]
            while times > 0 and len(wanted) > 1:
                use: dict[int, int] = {}
                for i, size in enumerate(wanted):
                    n = longest(size if i < len(wanted) - 1 else room - sum(m * k for m, k in use.items()), use)
                    if n is None:
                        break
                    use[n] = use.get(n, 0) + 1
                if sum(use.values()) < len(wanted):
                    break
                run = min(times, min(left[n] // k for n, k in use.items()))
                put(run, use)
                times -= run
                for n, k in use.items():
                    left[n] -= run * k
                    if not left[n]:
                        stock.remove(n)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            i = bisect_left(spaces, n)
            if i == len(spaces):
                per = room // n
                if c >= per:
                    put(c // per, {n: per})
                    c %= per
                if c:
                    put(1, {n: c})
                    c = 0
                break
            space = spaces[i]
            kind = open_by_space[space].pop()
            if not open_by_space[space]:
                spaces.pop(i)
            count, inside = kind
            per = min(space // n, max(1, c // count))  # several of a length at once where all such bins get them
            now = min(count, c // per)
            if now < count:
                put(count - now, inside)
            put(now, {**inside, n: inside.get(n, 0) + per})
            c -= now * per
    for space in spaces:
        bins.extend((count, inside) for count, inside in open_by_space[space])
    return bins


def placements(bins: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_lo, rank_hi, first sequence, per sequence, offset): which ranks of a length stand where."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, inside in bins:
        offset = 0
        for n, k in sorted(inside.items(), reverse=True):
            rows.append((n, used[n], used[n] + count * k, sequence, k, offset))
            used[n] += count * k
            offset += n * k
        sequence += count
    return rows


def pack(pieces: DataFrame, room: int = 2048) -> DataFrame:
    """Written token_pieces with sequence_id and offset: near-fewest sequences of at most `room` tokens.

    Only the length histogram (at most `room` rows) reaches the driver, and the plan that goes out again has a row
    per bin kind and length, a number that depends on `room` and not on the corpus. A piece finds its place by its
    rank among the pieces of its length: its number within its partition plus that length's count in the
    partitions before. A length that a third of all pieces share is thus neither sorted nor gathered anywhere.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = placements(best_plan(histogram, room))
    table = spark.createDataFrame(plan, "length_ long, lo long, hi long, first long, per long, at long")
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("length_")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    sequence = F.col("first") + F.floor(step / F.col("per")).cast("long")
    return placed.select("key", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("at") + step % F.col("per") * F.col("length")).alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, room: int = 2048, key: str = "doc_id", text: str = "text", words: int = 1_500_000) -> DataFrame:
    """Tokenises, cuts and packs every row of df; see token_pieces and pack.

    Null text: one piece of the closing id. Null keys and repeated rows are rows of their own. No rows give none.
    """
    return pack(stash(token_pieces(df, tokenizer, room, key, text, words=words)), room)
