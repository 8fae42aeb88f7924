"""Token ids by merging words in step, and plans made of configurations of several large pieces."""

import random
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import packing, word_ids
from cadenza.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokens():
    return word_ids.WordTokens(tokenizer_path())


@pytest.mark.parametrize("alphabet", ["abcdefgh", "thereonsia", "".join(map(chr, range(0xA1, 0x100))) + "aeiou.,'", "abcz,.!?'-0189"])
def test_random_words_have_the_tokenizers_ids(tokens, alphabet):
    rng = random.Random(alphabet)
    texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 27))) for _ in range(60)) for _ in range(40)]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)]
    assert got == [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_of_the_vocabulary_with_marks(tokens):
    rng = random.Random(4)
    known = [k.replace("</w>", "") for k in tokens.tokenizer.get_vocab()]
    texts = [" ".join(rng.choice(known) + rng.choice(["", ",", ".", "'s", "!", ".,"]) + rng.choice(["", rng.choice(known)]) for _ in range(100)) for _ in range(60)] + ["", " ", ".", ",,", "a.", "é,", "\t\r\n"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)]
    assert got == [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_small_table_starts_anew_and_a_very_long_text_is_whole():
    small = word_ids.WordTokens(tokenizer_path(), 50)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(20)) for _ in range(30)]
    long = " ".join(texts) * 60
    want = [e.ids for e in small.tokenizer.encode_batch([*texts, long], add_special_tokens=False)]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for t in texts for x in small.encode([t])] + [np.frombuffer(small.encode([long])[0], "<u4").tolist()]
        assert got == want


def _uniform(count, seed):
    rng = random.Random(seed)
    return Counter(min(2048, 1 + int(2600 * rng.random() ** 1.5)) for _ in range(count))


@pytest.mark.parametrize("count", [500, 5000, 60_000])
def test_plans_reach_the_bound_by_configurations_of_several_large_pieces(count):
    histogram = _uniform(count, count)
    plan = packing.best_plan(dict(histogram))
    got = Counter()
    for times, inside in plan:
        assert sum(n * k for n, k in inside.items()) <= 2048
        got.update({n: k * times for n, k in inside.items()})
    assert got == histogram
    bound = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert sum(c for c, _ in plan) <= bound + max(1, bound // 1000)
    large = packing.CHOICES[0][0] * 2048
    several = sum(c for c, inside in plan if sum(k for n, k in inside.items() if n > large) > 1)
    assert several > bound / 8


def test_odd_histograms():
    assert packing.best_plan({}) == []
    assert packing.best_plan({2048: 7}) == [(7, {2048: 1})]
    assert sum(c for c, _ in packing.best_plan({1: 3})) == 1
    assert sum(c for c, _ in packing.best_plan({1024: 10**9})) == 5 * 10**8
    assert sum(c for c, _ in packing.best_plan({1025: 10})) == 10
    assert sum(c for c, _ in packing.best_plan({700: 4, 1348: 4})) == 4
