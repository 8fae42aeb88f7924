"""The n-gram join's parts: word hashes, hash buckets, split keys, large groups of near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import common, ngram_join
from cadenza.llm.shingles import SPACES, Words, tables


def _thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


def test_words_of_equal_polynomial_hash_differ(spark):
    a = _thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"one {a} two three four five"), (4, f"one {b} two three four five"), (5, b)]
    got = {r.doc: r.component_id for r in ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}


def test_word_hashes_depend_on_the_words_bytes_alone():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 40, 63, 64, 65, 66, 130) for _ in range(6)})
    one = dict(zip(words, Words([w.encode() for w in words], *tables(SPACES)).hashes.tolist(), strict=True))
    assert len(set(one.values())) == len(words)
    rng.shuffle(words)
    assert Words([" ".join(words).encode()], *tables(SPACES)).hashes.tolist() == [one[w] for w in words]


@pytest.mark.parametrize("count", [1, 4, 211])
def test_buckets_are_sparks_own(spark, count):
    digests = np.random.default_rng(1).integers(0, 256, (200, 20), np.uint8)
    df = spark.createDataFrame([(i, bytes(d[:16])) for i, d in enumerate(digests)], "i int, sig binary")
    want = [r.p for r in df.select("i", F.expr(f"pmod(hash(sig), {count})").alias("p")).orderBy("i").collect()]
    assert ngram_join.bucket_of(digests, count).tolist() == want


def test_hot_keys_are_split_and_lose_nothing(spark):
    rows = common.stash(spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)] + [(0, 7), (0, 7), (5, -1)], "x int, y int"))
    table = spark.createDataFrame([(i, i * 10) for i in range(300)], "y int, v int")
    got = sorted(tuple(r) for r in common.split_join(rows, table, ["y"], least=20).select("x", "y", "v").collect())
    assert got == sorted(tuple(r) for r in rows.join(table, "y").select("x", "y", "v").collect()) and len(got) == 302
    plan = common.split_join(rows, table, ["y"], least=20)._jdf.queryExecution().toString()
    assert "salt_" in plan and "CartesianProduct" not in plan


def _near_group(rng, name, size, words=80, changes=12):
    """Copies of a text with a few changed words each: most pairs link, some don't."""
    base = [f"{name}{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = base.copy()
        for _ in range(rng.randrange(0, changes) // 5):
            own[rng.randrange(words)] = f"z{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_large_near_group_in_parts_with_hot_centres(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_AT_ONCE", 1 << 12)  # many parts a reducer
    monkeypatch.setattr(common, "SPLIT_LEAST", 10)  # every centre is hot
    rng = random.Random(3)
    texts = _near_group(rng, "a", 220) + _near_group(rng, "b", 30) + [f"lone text number {i} with words of its own w{i} v{i} u{i}" for i in range(40)]
    texts += texts[:1] * 40  # and so is this class of copies
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc: r.component_id for r in ngram_join.shingle_components(df).collect()}
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    label = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {d: low if x == high else x for d, x in label.items()}
    assert got == label
