"""Very long texts, dense groups, ties, repeated keys and empty tables, operator by operator."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import common, embed_dedup, flac, licenses, line_dedup, mixing, ngram_join, packing, quality, secrets, sharding
from cadenza.llm.queries import tokenizer_path

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "théta"]


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(11)
    return "\n".join(" ".join(rng.choice(WORDS) + str(rng.randrange(10**4)) for _ in range(rng.randrange(1, 12))) for _ in range(70_000))


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    rows = [(1, long_text, "a"), (2, "short text of no weight", "b"), (3, long_text, "a"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)


def test_a_long_text_through_every_operator(spark, long_docs, long_text):
    data = long_text.encode()
    payload = data + bytes(-len(data) % 64)
    stored = {r.key: r for r in flac.media_digests(flac.pcm_blocks(long_docs)).collect()}
    assert stored[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and stored[1].tail_crc32 == zlib.crc32(payload[-64:])
    assert (stored[1].media_sha256, stored[1].feature) == (stored[3].media_sha256, stored[3].feature) and stored[None].payload_bytes == 64

    shards = {r.key: r for r in sharding.assign_shards(long_docs, 4).collect()}
    assert shards[1]["size"] == len(data) + 1

    found = {r.doc: r.component_id for r in ngram_join.shingle_components(long_docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1, None: None}

    lines = {r.key: r for r in line_dedup.line_digests(long_docs).collect()}
    every = long_text.split("\n")
    keys = Counter(x.strip() for x in every)
    assert lines[1].n_lines == 70_000 and lines[1].n_dropped == 0
    assert lines[3].n_dropped == sum(n for k, n in keys.items() if len(k) >= 10) and max(i for i, x in enumerate(every) if len(x.strip()) >= 10) > 65_536
    kept = "\n".join(x for x in every if len(x.strip()) < 10)
    assert lines[3].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()

    from tokenizers import Tokenizer

    ids = len(Tokenizer.from_file(tokenizer_path()).encode(long_text, add_special_tokens=False).ids) + 1
    pieces = Counter()
    for r in packing.pack_documents(long_docs, tokenizer_path()).collect():
        pieces[r.key] += r.length
    assert pieces[1] == pieces[3] == ids and pieces[None] == 1

    drawn = mixing.draw(long_docs).collect()
    assert {r.key for r in drawn} == {1, 2, 3, None} and {r.tokens for r in drawn if r.key == 1} == {len(long_text.split())}

    assert secrets.scan_secrets(long_docs).count() == licenses.scan_licenses(long_docs).count() == 4
    model = quality.Model(np.zeros(quality.BUCKETS, np.float32), 0.0)
    assert {r.score for r in quality.score(long_docs, model).collect()} == {0.5}


def test_a_dense_group_of_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    rows = [(i, (centre + rng.normal(size=24) * 0.01).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(5000 + i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(20)] + [(6000 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec: r for r in embed_dedup.near_vectors(df, tile=400).collect()}
    assert {got[i].n_links for i in [*range(1500), *range(6000, 6030)]} == {1529} and {got[i].component_id for i in range(1500)} == {0}
    assert all(got[5000 + i].kept and got[5000 + i].n_links == 0 for i in range(20))


def test_ties_and_odd_totals_of_sources(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), (None, 100)], "source string, tokens long")
    for how in ({"max_repeats": 2.0}, {"target_entropy": 0.9}):
        rows = mixing.source_weights(totals, **how).collect()
        assert {round(r.weight, 12) for r in rows} == {0.25} and {r.quota for r in rows} == {100}
        assert mixing.source_weights(totals.limit(0), **how).count() == 0
        assert [r.weight for r in mixing.source_weights(totals.limit(1), **how).collect()] == [1.0]
    zero = spark.createDataFrame([("a", 0), ("b", 7)], "source string, tokens long")
    assert [(r.source, r.quota) for r in mixing.source_weights(zero, max_repeats=2.0).collect()] == [("b", 7)]


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(("hot" if i % 4 else f"g{i % 7}"), rng.randrange(1000), i, rng.randrange(1, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v long").repartition(5)
    got = {r.i: r.before for r in mixing.running_sums(df, ["g"], ["o", "i"], "v", "before").collect()}
    sums, want = Counter(), {}
    for g, _, i, v in sorted(rows):
        want[i] = sums[g]
        sums[g] += v
    assert got == want
    assert mixing.running_sums(df.limit(0), ["g"], ["o"], "v", "before").count() == 0


def test_repeated_keys_while_fitting(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(200)] + [(2, "another text"), (4, "one more text"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (4, None), (5, 1), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias)
    bounded = quality.train(docs, labels, most_shares=1)
    assert not bounded.weights.any()


def test_bitmaps_of_runs():
    rng = random.Random(2)
    for size in (1, 65_536, 65_537, 200_000):
        gone = sorted(rng.sample(range(size), min(size, 300)) + [size - 1])
        mask = line_dedup.keep_mask(line_dedup._bitmap(np.array(gone)), size)
        assert np.flatnonzero(~mask).tolist() == sorted(set(gone))


def test_the_shared_folder_is_named_or_local(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://there:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Far)
    assert common.shared_dir(spark)


def test_spent_folders_are_gone(spark):
    import os

    df = common.stash(spark.range(5))
    path = df.stashed_at
    assert df.count() == 5 and os.path.isdir(path)
    common.spent(df, None, spark.range(1))
    assert not os.path.exists(path)
