"""An exact Jaccard join of documents' word n-gram sets that skips by set relations, and its components."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, chunks, components, lean, partitions, picked, spent, split_join, stash, stash_buckets
from .shingles import shingle_sets

_CHUNK = 1 << 19
_HEAVY_SHARE, _HEAVY_LEAST = 0.01, 64
#: Bytes of tokens that a reducer's task works on at once.
_AT_ONCE = 1 << 26


def _digest(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def _classes(width: int, marked: bool = False):
    """Per text: its set's size and 128-bit digest, and its mark if marked; per chunk: the tokens that many of its sets
    hold, and as a row without a token the number of its sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in chunks([len(t) + 1 for t in texts], _CHUNK):
                sets = shingle_sets(texts[a:b], width)
                digests = [_digest(s) if len(s) else None for s in sets]
                own = {d: s for d, s in zip(digests, sets, strict=True) if d}
                heavy = counts = np.empty(0, np.int64)
                if own:
                    tokens, counts = np.unique(np.concatenate(list(own.values())), return_counts=True)
                    much = counts >= max(3, _HEAVY_SHARE / 2 * len(own))
                    heavy, counts = tokens[much].view(np.int64), counts[much]
                n, h = b - a, len(heavy) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column("doc").slice(a, n), pa.nulls(h, pa.int64())]),
                        pa.array([len(s) for s in sets] + [None] * h, pa.int64()),
                        pa.array(digests + [None] * h, pa.binary()),
                        pa.concat_arrays([pa.nulls(n + 1, pa.int64()), pa.array(heavy, pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([len(own)], pa.int64()), pa.array(counts.astype(np.int64), pa.int64())]),
                        *([pa.concat_arrays([batch.column("mark").slice(a, n), pa.nulls(h, pa.int64())])] if marked else []),
                    ],
                    names=["doc", "n", "sig", "heavy", "held", *["mark"] * marked],
                )

    return rows


def _token_blocks(width: int, keys: list[int], subs: int, heavy: np.ndarray):
    """Per task, set and range of token values: the set's tokens in that range, as one row a chunk and range.

    Each reducer has `subs` neighbouring ranges. Sets are sent once a task, however many copies it has. Heavy tokens
    go along in rows of their own (negative ranges), to the reducer of their set, since nothing needs to be counted
    about them.
    """
    ranges = len(keys) * subs

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in chunks([len(t) + 1 for t in texts], _CHUNK):
                own: dict[bytes, np.ndarray] = {}
                for s in shingle_sets(texts[a:b], width):
                    if len(s) and (d := _digest(s)) not in sent:
                        own[d] = s
                        sent.add(d)
                if not own:
                    continue
                sizes = np.array([len(s) for s in own.values()], np.uint32)
                sigs = np.concatenate([np.frombuffer(b"".join(own), np.uint8).reshape(-1, 16), sizes.view(np.uint8).reshape(-1, 4)], axis=1)
                tokens = np.concatenate(list(own.values()))
                owner = np.repeat(np.arange(len(own), dtype=np.uint32), sizes)
                part = ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges < 65536 else np.uint32)
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
                    light = heavy[place] != tokens
                    yield from _by_set(keys, subs, sigs, owner[~light], tokens[~light])
                    part, owner, tokens = part[light], owner[light], tokens[light]
                order = np.argsort(part, kind="stable")
                part, owner, tokens = part[order], owner[order], tokens[order]
                cuts = np.searchsorted(part, np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    yield from _packed(r, keys[r // subs], sigs, owner[cuts[r] : cuts[r + 1]], tokens[cuts[r] : cuts[r + 1]])

    return rows


_ROW = "to long, part int, sigs binary, counts binary, tokens binary, held binary"
_ALWAYS = 0xFFFFFFFF


def _packed(part: int, key: int, sigs: np.ndarray, owner: np.ndarray, tokens: np.ndarray, held: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """owner and tokens, grouped by owner, as one row: digests with set sizes, counts, token values, how many sets hold them."""
    if not len(tokens):
        return
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    counts = np.diff(np.concatenate([first, [len(owner)]])).astype(np.uint32)
    columns = [x.tobytes() for x in (sigs[owner[first]], counts, tokens)] + [None if held is None else held.tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], names=["to", "part", "sigs", "counts", "tokens", "held"])


def bucket_of(sigs: np.ndarray, count: int) -> np.ndarray:
    """The hash partition that Spark gives 16-byte digests among `count` (its 32-bit Murmur3 with seed 42)."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint32(by) | x >> np.uint32(32 - by)

    h = np.full(len(sigs), 42, np.uint32)
    with np.errstate(over="ignore"):
        for word in np.ascontiguousarray(sigs[:, :16]).view("<u4").T:
            h ^= turned(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(16)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % count


def _by_set(keys: list[int], subs: int, sigs: np.ndarray, owner: np.ndarray, tokens: np.ndarray, held: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """As _packed, one row for each reducer of sets and each of its `subs` parts, numbered from -1 down; a set's place
    follows from its digest, and its reducer is the partition that Spark's hash of the digest names."""
    held = np.full(len(tokens), _ALWAYS, np.uint32) if held is None else held
    part = (sigs[:, 8].astype(np.int64) << 8 | sigs[:, 9]) * subs >> 16
    cell = (bucket_of(sigs, len(keys)) * subs + part)[owner]
    order = np.argsort(cell, kind="stable")
    cell, owner, tokens, held = cell[order], owner[order], tokens[order], held[order]
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(cell) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        to, sub = divmod(int(cell[a]), subs)
        yield from _packed(-1 - sub, keys[to], sigs, owner[a:b], tokens[a:b], held[a:b])


def _unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests of the distinct sets, owner, token, held) of packed rows; owner points to a digest."""
    sigs = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 20)
    counts = np.frombuffer(b"".join(r[1] for r in rows), np.uint32)
    tokens = np.frombuffer(b"".join(r[2] for r in rows), np.uint64)
    held = np.frombuffer(b"".join(r[3] or b"" for r in rows), np.uint32)
    _, first, which = np.unique(np.ascontiguousarray(sigs).view("V20").ravel(), return_index=True, return_inverse=True)
    return sigs[first], np.repeat(which.astype(np.int64), counts), tokens, held


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("part", "sigs", "counts", "tokens", "held")), strict=True)


def _repeated(keys: list[int], subs: int):
    """Per range: the tokens that at least two different sets hold, packed again for the reducers of sets.

    Rows come sorted by range, so one range is in memory at a time. Rows of heavy tokens pass through.
    """

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sigs, owner, tokens, _ = _unpacked(rows)
        order = np.lexsort((owner, tokens))
        owner, tokens = owner[order], tokens[order]
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])  # copies from other tasks go
        owner, tokens = owner[fresh], tokens[fresh]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        number = np.diff(np.concatenate([start, [len(tokens)]]))
        number = np.repeat(number, number)
        some = number >= 2
        owner, tokens, number = owner[some], tokens[some], number[some].astype(np.uint32)
        order = np.argsort(owner, kind="stable")
        yield from _by_set(keys, subs, sigs, owner[order], tokens[order], number[order])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            passing = batch.filter(pa.compute.less(batch.column("part"), 0))
            if passing.num_rows:
                yield passing
            for part, *row in _rows(batch):
                if part < 0:
                    continue
                if part != at and held:
                    yield from done(held)
                    held = []
                at = part
                held.append(row)
        if held:
            yield from done(held)

    return rows


_MAPS = ["m0", "m1", "m2", "m3"]


def _parities(tokens: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of how many of the tokens fall on it: where two such maps differ, their sets do."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SETS = "sig binary, n long, need long, tokens binary, prefix array<long>, alone long, m0 long, m1 long, m2 long, m3 long"


def _ordered(percent: int):
    """Each set's shared tokens from all ranges in the global order: rarest first, then by value; prefix has those of
    them that its prefix of n - need + 1 tokens reaches. Sets that hold too few to reach any other go.

    Rows come sorted by part, so one part of the reducer's sets is in memory at a time.
    """

    def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sigs, owner, tokens, number = _unpacked(held)
        order = np.lexsort((tokens, number, owner))
        owner, tokens = owner[order], tokens[order]
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
        owner, tokens = owner[fresh], tokens[fresh]
        cuts = np.searchsorted(owner, np.arange(len(sigs) + 1)).tolist()
        sizes = np.ascontiguousarray(sigs[:, 16:]).view(np.uint32).ravel().astype(np.int64)
        needs = -(-sizes * percent // 100)
        able = np.flatnonzero(np.diff(cuts) >= needs)
        for at in range(0, len(able), 1000):
            kept = able[at : at + 1000].tolist()
            own = [tokens[cuts[i] : cuts[i + 1]] for i in kept]
            alone = sizes[kept] - [len(x) for x in own]
            reach = (sizes[kept] - needs[kept] + 1 - alone).tolist()
            maps = np.array([_parities(x) for x in own], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sigs[i, :16].tobytes() for i in kept], pa.binary()), pa.array(sizes[kept]), pa.array(needs[kept]),
                    pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x[:k].view(np.int64) for x, k in zip(own, reach, strict=True)], pa.list_(pa.int64())),
                    pa.array(alone), *(pa.array(maps[:, j]) for j in range(4)),
                ],
                names=["sig", "n", "need", "tokens", "prefix", "alone", *_MAPS],
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, *row in _rows(batch):
                if part != at and held:
                    yield from done(held)
                    held = []
                at = part
                held.append(row)
        if held:
            yield from done(held)

    return rows


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.isin(a, b, assume_unique=True).sum()) if len(a) else 0


def _need(nx: int, ny: int, percent: int) -> int:
    """The least overlap with which sets of nx and ny tokens link."""
    return -(-percent * (nx + ny) // (100 + percent))


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


_LINKS = "x binary, y binary, jaccard double, less binary, more binary"


def _linked(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 5
    types = (pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["x", "y", "jaccard", "less", "more"])


def _compared(percent: int):
    """Of the pairs (x, y) with both sets' tokens, those that link, with less = y - x and more = x - y."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, nx, own, y, ny, other in _columns(batch, "x", "nx", "base", "y", "ny", "other"):
                mine, against = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                shared = np.isin(mine, against, assume_unique=True)
                overlap = int(shared.sum())
                if overlap >= _need(nx, ny, percent):
                    out.append((x, y, overlap / (nx + ny - overlap), against[~np.isin(against, mine, assume_unique=True)].tobytes(), mine[~shared].tobytes()))
            yield _linked(out)

    return rows


def _leaders_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """|lead & y| of pairs with both sets' tokens, and y's tokens for the leader's followers."""
    for batch in batches:
        out = [(lead, y, ny, other, _common(np.frombuffer(base, np.uint64), np.frombuffer(other, np.uint64))) for lead, base, y, ny, other in _columns(batch, "lead", "base", "y", "ny", "other")]
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lead", "y", "ny", "other", "got"])


def _derived(percent: int):
    """The pairs (x, y) that link, from the answer of x's leader L for y: |x & y| = |L & y| - |(L - x) & y| + |(x - L) & y|.

    The sizes of the differences settle many pairs without even those.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, nx, less, more, y, ny, other, got in _columns(batch, "x", "nx", "less", "more", "y", "ny", "other", "got"):
                gone, come = np.frombuffer(less, np.uint64), np.frombuffer(more, np.uint64)
                need = _need(nx, ny, percent)
                if got + len(come) < need:
                    continue
                against = np.frombuffer(other, np.uint64)
                overlap = got - _common(gone, against) + _common(come, against)
                if overlap >= need:
                    out.append((x, y, overlap / (nx + ny - overlap), b"", b""))
            yield _linked(out)

    return rows


def _verified(pairs: DataFrame, sets: DataFrame, leaders: DataFrame | None, percent: int) -> DataFrame:
    """(x, y, jaccard, less, more) of the pairs (x, nx, y) that link; pairs is a stash.

    Without leaders every pair is compared, and less and more are y - x and x - y over shared tokens. With them a
    set's answers follow from its leader's: the tokens of y travel once for a leader and y, however many followers
    ask, and a follower brings no more than its differences from the leader. A set without a leader is its own.
    """
    other = sets.select(F.col("sig").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("other"))
    if leaders is None:
        base = sets.select(F.col("sig").alias("x"), F.col("tokens").alias("base"))
        return split_join(pairs, other, ["y"]).join(base, "x").mapInArrow(_compared(percent), _LINKS)
    empty = F.lit(b"").cast("binary")
    led = pairs.join(leaders, "x", "left").select("x", "nx", "y", F.coalesce("lead", "x").alias("lead"), F.coalesce("less", empty).alias("less"), F.coalesce("more", empty).alias("more"))
    led = stash(led)
    asked = stash(led.select("lead", "y").distinct())
    base = sets.select(F.col("sig").alias("lead"), F.col("tokens").alias("base"))
    answers = split_join(asked, other, ["y"]).join(base, "lead").mapInArrow(_leaders_answers, "lead binary, y binary, ny long, other binary, got long")
    return split_join(led, answers, ["lead", "y"]).mapInArrow(_derived(percent), _LINKS)


def _even_keys(spark: SparkSession, count: int) -> list[int]:
    """A key for each of `count` hash partitions, so that ranges of tokens spread evenly."""
    rows = spark.range(40 * count + 400).groupBy(F.expr(f"pmod(hash(id), {count})").alias("p")).agg(F.min("id").alias("id")).collect()
    found = {r.p: r.id for r in rows}
    return [found.get(p, p) for p in range(count)]


def text_mark(text: Column) -> Column:
    """A 64-bit hash of a text; key and mark tell a row's text from others of its key."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _prepared(df: DataFrame, key: str, text: str, width: int, percent: int, marked: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps 1 to 3 of shingle_components: rows (doc, n, sig), classes (sig, least, n), sets that can reach others.

    If marked, rows have a mark too, and classes their number of rows and their first (no key, doc, mark)."""
    spark = df.sparkSession
    docs = picked(df, doc=key, text=text).select(F.col("doc").cast("long").alias("doc"), "text")
    marks = docs.withColumn("mark", text_mark(F.col("text"))) if marked else docs
    first = stash(marks.mapInArrow(lean(_classes(width, marked)), "doc long, n long, sig binary, heavy long, held long" + ", mark long" * marked))
    rows = first.where("n is not null").select("doc", "n", "sig", *["mark"] * marked)
    lead = [F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")).alias("lead"), F.count("*").alias("rows")] if marked else []
    classes = stash(rows.where("sig is not null").groupBy("sig").agg(F.min("doc").alias("least"), F.first("n").alias("n"), *lead))
    total = classes.agg(F.sum("n")).first()[0] or 0
    # tokens of 1 % of the sets, counted once a chunk that holds them: at most 100 times the mean set size
    appearances = first.where("n is null and heavy is null").agg(F.sum("held")).first()[0] or 0
    often = max(_HEAVY_LEAST, int(_HEAVY_SHARE * appearances))
    heavy = first.where("heavy is not null").groupBy("heavy").agg(F.sum("held").alias("held")).where(F.col("held") >= often).select("heavy").toPandas()["heavy"].to_numpy(np.int64)
    heavy = np.sort(heavy.view(np.uint64))
    count = partitions(spark)
    keys, subs = _even_keys(spark, count), max(1, min(1 << 16, -(-8 * total // (count * _AT_ONCE))))
    blocks = docs.mapInArrow(lean(_token_blocks(width, keys, subs, heavy)), _ROW)
    shared = blocks.repartition(count, "to").sortWithinPartitions("part").mapInArrow(lean(_repeated(keys, subs)), _ROW)
    sets = shared.repartition(count, "to").sortWithinPartitions("part").mapInArrow(lean(_ordered(percent)), _SETS)
    return rows, classes, stash_buckets(sets, "sig")


def _postings(sets: DataFrame) -> DataFrame:
    """(sig, at, token): each set's prefix but for the tokens it holds alone, with positions in the global order."""
    return sets.select("sig", "alone", F.posexplode("prefix").alias("i", "token")).select("sig", (F.col("alone") + F.col("i")).alias("at"), "token")


def _class_labels(sets: DataFrame, percent: int, rounds: int, centres: int) -> DataFrame:
    """Steps 4 and 5 of shingle_components: (node, component) of the classes that link with others."""
    live, labels, leaders, links = _postings(sets), None, None, None
    for turn in range(rounds):
        listed = _labelled(live, sets, labels, "n", "alone")
        # later rounds have several centres: lists elect theirs by the token's remainder, each by an order of its own
        rank = -F.col("alone") / F.col("n") if turn == 0 else F.xxhash64(F.lit(turn), F.pmod("token", F.lit(centres)), "sig")
        who = F.struct(rank.alias("rank"), "n", "sig", *["component"] * (turn > 0))
        several = F.count("*") > 1 if turn == 0 else F.min("component") != F.max("component")
        centre = listed.groupBy("token").agg(F.max(who).alias("c"), several.alias("several")).where("several").select("token", "c")
        own = [F.col("component"), F.col("c.component").alias("cy")] if turn else [F.col("sig").alias("component"), F.col("c.sig").alias("cy")]
        before, live = live, stash(listed.join(centre, "token").select("token", "sig", "at", "n", *own, F.col("c.sig").alias("y"), F.col("c.n").alias("ny")))
        near = F.least("n", "ny") * 100 >= F.greatest("n", "ny") * percent
        pairs = live.where((F.col("component") != F.col("cy")) & near).select(F.col("sig").alias("x"), F.col("n").alias("nx"), "y", "ny").distinct()
        spent(before)
        # the maps join the few distinct pairs, so that the lists are shuffled without them
        for side in "xy":
            pairs = pairs.join(sets.select(F.col("sig").alias(side), *[F.col(m).alias(f"{side}{m}") for m in ("alone", *_MAPS)]), side)
        pairs = stash(pairs.where(_alike("nx", "ny", *([f"{side}{m}" for m in ("alone", *_MAPS)] for side in "xy"), percent)).select("x", "nx", "y"))
        found = stash(_verified(pairs, sets, leaders, percent))
        if turn == 0:
            best = F.max_by(F.struct("y", "less", "more"), F.struct("jaccard", "y"))
            leaders = stash(found.groupBy("x").agg(best.alias("b")).select("x", F.col("b.y").alias("lead"), F.col("b.less").alias("less"), F.col("b.more").alias("more")))
        new = found.select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    apart = stash(_across(_labelled(live, sets, labels, "n", "alone", *_MAPS), percent))
    found = _verified(apart, sets, leaders, percent).select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(links.unionByName(found))
    spent(live, apart, leaders)
    return labels


def _named(classes: DataFrame, labels: DataFrame) -> DataFrame:
    return classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def shingle_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, rounds: int = 3, centres: int = 8) -> DataFrame:
    """(doc, n_shingles, component_id) of every row of df: which documents reach each other by links.

    Words are runs between ASCII spaces, A-Z folded. Two rows link when 100 * |intersection| >= percent * |union| of
    their sets of distinct `width`-word shingles (a text of fewer words is one shingle). The join is exact:

    1. Equal sets are one class, by 128-bit digest; from here on, a class is one set.
    2. Shingle hashes, sent once a class and task, are range-partitioned to count the sets that hold each. Tokens
       that over 1 % of all sets hold, a set counted once in each chunk of texts that has it (a bounded list: no more
       than 100 times the mean set size), need no count and stay with their sets. Sets with too few shared tokens to
       reach any other are done. The rest lie in hash buckets of their digests, where pairs find them without moving
       them again.
    3. Tokens are ordered by frequency; two linked sets share a token of their prefixes of n - need + 1 tokens.
       The prefixes form the inverted index.
    4. Star rounds: in each index list every set is compared with one central set alone (first that with the fewest
       tokens of its own, and the best match becomes a set's leader; then one of `centres` random ones, so that a
       group without a middle is tried from several sides). Links found join sets to components, and lists of one
       component are left out from then on. Pairs that the parity maps of step 5 rule out are not compared. Each posting
       meets its list's one centre, a join that Spark's own skew handling splits where a list is very long; a centre
       that very many sets are compared with is split by split_join.
    5. The rest exactly: index lists that still span several components are joined, only across components. Lists
       are cut into blocks by set size, and a posting visits only the blocks that its own position can still
       reach (index-level skipping); positions bound what is left of both sets, and
       parity maps of 256 bits how many tokens they can't share. Answers for a set are derived from
       those of its leader (answer-level skipping), from round two on. A group of thousands of near copies is thus one component
       after step 4 and emits no pairs here.

    component_id is the smallest key reachable, the row's own included. Null and empty texts have no shingles and
    link with nothing. A null key is never the smallest unless alone (its component_id is then null); rows that
    share a key are rows of their own. Empty tables give no rows.
    """
    rows, classes, sets = _prepared(df, key, text, width, percent)
    named = _named(classes, _class_labels(sets, percent, rounds, centres))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "component").select("sig", "component_id")
    lone = rows.where("sig is null").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    found = split_join(rows.where("sig is not null"), of, ["sig"])  # a class may hold a third of all rows
    return found.select("doc", F.col("n").alias("n_shingles"), "component_id").unionByName(lone)


def copy_marks(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, rounds: int = 3, centres: int = 8) -> DataFrame:
    """(doc, mark, kept, n) of the rows in components of several rows: n rows have that key and text_mark.

    kept is true for one (doc, mark) of each component of shingle_components: the smallest key, nulls last, and
    of its texts there the one with the least mark.
    """
    rows, classes, sets = _prepared(df, key, text, width, percent, True)
    named = _named(classes, _class_labels(sets, percent, rounds, centres))
    lead = named.groupBy("component").agg(F.min("lead").alias("lead"), F.sum("rows").alias("rows")).where("rows > 1")
    of = named.select("sig", "component").join(lead, "component").select("sig", "lead")
    found = split_join(rows.where("sig is not null"), of, ["sig"])
    kept = F.col("doc").eqNullSafe(F.col("lead.doc")) & (F.col("mark") == F.col("lead.mark"))
    return stash(found.select("doc", "mark", kept.alias("kept")).groupBy("doc", "mark", "kept").agg(F.count("*").alias("n")))


def shingle_links(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the join of shingle_components, with every link, also inside components.

    links has (x, y, jaccard) of each pair of different classes that links, once; members has (doc, n_shingles, sig,
    n_links) of every row of df. A class is all rows of one shingle set, sig its digest, x and y are such digests.
    The rows of a class link with each other; n_links counts the other rows that a row links with, of its class
    and of those linked with it. Rows without shingles have a null sig and no links. The number of links can grow
    with the square of a group of near copies, and so does this; shingle_components avoids that.
    """
    rows, _, sets = _prepared(df, key, text, width, percent)
    apart = stash(_across(_labelled(_postings(sets), sets, None, "n", "alone", *_MAPS), percent))
    links = stash(_verified(apart, sets, None, percent).select("x", "y", "jaccard"))
    sizes = rows.where("sig is not null").groupBy("sig").agg(F.count("*").alias("size"))
    ends = links.select(F.col("x").alias("sig"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("sig"), F.col("x").alias("other")))
    reached = ends.join(sizes.select(F.col("sig").alias("other"), "size"), "other").groupBy("sig").agg(F.sum("size").alias("reached"))
    counts = sizes.join(reached, "sig", "left").select("sig", (F.col("size") - 1 + F.coalesce("reached", F.lit(0))).alias("n_links"))
    return links, rows.join(counts, "sig", "left").select("doc", F.col("n").alias("n_shingles"), "sig", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _labelled(live: DataFrame, sets: DataFrame, labels: DataFrame | None, *columns: str) -> DataFrame:
    """(token, sig, at, columns..., component) of the postings `live`; the columns are those of their sets."""
    named = sets.select("sig", *columns)
    if labels is None:
        named = named.withColumn("component", F.col("sig"))
    else:
        named = named.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    return live.select("token", "sig", "at").join(named, "sig")


def _alike(nx: str, ny: str, x: list[str], y: list[str], percent: int) -> Column:
    """Whether two sets of nx and ny tokens can link; x and y name their columns `alone` and the parity maps.

    Tokens that one set holds alone and bits in which the maps differ are tokens that the two don't share.
    """
    unlike = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(x[1:], y[1:], strict=True)), F.col(x[0]) + F.col(y[0]))
    return unlike * (100 + percent) <= (F.col(nx) + F.col(ny)) * (100 - percent)


def _across(listed: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (x, nx, y) of different components that share a prefix token and pass all bounds."""
    mixed = listed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    listed = listed.join(mixed, "token")
    ratio = percent / 100
    # blocks by size: a partner of n or more tokens has at most n / ratio, so it is in the same block or the next
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(ratio)) + F.lit(1e-9)).cast("int")
    index = listed.select("token", block.alias("block"), F.col("sig").alias("y"), F.col("n").alias("ny"), F.col("at").alias("aty"), F.col("component").alias("cy"), F.col("alone").alias("ay"), *[F.col(m).alias(f"y{m}") for m in _MAPS])
    least = F.greatest(F.col("n").cast("double"), F.pow(F.lit(1 / ratio), F.col("block") - F.lit(1e-6)))
    reach = (F.col("n") - F.col("at")) * (100 + percent) >= (F.col("n") + F.floor(least)) * percent
    probes = listed.withColumn("block", F.explode(F.array(block - 0, block + 1))).where(reach)
    probes = probes.select("token", "block", F.col("sig").alias("x"), F.col("n").alias("nx"), F.col("at").alias("atx"), F.col("component").alias("cx"), F.col("alone").alias("ax"), *[F.col(m).alias(f"x{m}") for m in _MAPS])
    rest = F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty"))
    able = rest * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    able = able & _alike("nx", "ny", ["ax", *(f"x{m}" for m in _MAPS)], ["ay", *(f"y{m}" for m in _MAPS)], percent)
    order = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    near = F.col("nx") * 100 >= F.col("ny") * percent
    return probes.join(index, ["token", "block"]).where((F.col("cx") != F.col("cy")) & order & near & able).select("x", "nx", "y").distinct()
