"""The pipeline's stages on the smallest tables, each against a brute-force version on its own input."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
from cadenza.llm import quality
from cadenza.llm.queries import KEEP, tokenizer_path

SF = "/root/testdata/sf0.001"


def _fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _stage(spark, tmp_path, i, docs):
    corpus_pipeline.STAGES[i][1](spark, docs, SF).write.parquet(str(tmp_path / str(i)))
    return spark.read.parquet(str(tmp_path / str(i)))


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.scores([r.text.encode() for r in given.values()], model)
    one = _stage(spark, tmp_path, 0, docs)
    kept = {r.doc_id: r for r in one.collect()}
    assert one.columns == docs.columns and kept == {d: r for (d, r), s in zip(given.items(), scores, strict=True) if s >= KEEP}
    assert 0 < len(kept) < len(given)

    two = _stage(spark, tmp_path, 1, one)
    key = lambda line: _fold(line.strip(" \t\n\x0b\x0c\r"))
    least: dict[str, int] = {}
    for d in sorted(kept):
        for line in kept[d].text.split("\n"):
            least.setdefault(key(line), d)
    want = {}
    for d, r in kept.items():
        lines = [x for x in r.text.split("\n") if len(key(x)) < 10 or least[key(x)] == d]
        if lines:
            want[d] = "\n".join(lines)
    thinned = {r.doc_id: r for r in two.collect()}
    assert two.columns == docs.columns and {d: r.text for d, r in thinned.items()} == want
    assert all(r.n_chars == len(r.text) for r in thinned.values() if r.text != kept[r.doc_id].text)

    three = _stage(spark, tmp_path, 2, two)
    sets = {}
    for d, text in want.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", _fold(text))
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    single = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns and single == {d for d, x in label.items() if d == x}

    four = _stage(spark, tmp_path, 3, three)
    copies = Counter(r.doc_id for r in four.collect())
    assert four.columns == docs.columns and set(copies) == single and set(copies.values()) <= {1, 2}

    from tokenizers import Tokenizer

    rows = _stage(spark, tmp_path, 4, four).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.doc_id] += r.length
    found = Tokenizer.from_file(tokenizer_path()).encode_batch([want[d] for d in copies], add_special_tokens=False)
    assert sizes == {d: n * (len(e.ids) + 1) for (d, n), e in zip(copies.items(), found, strict=True)}
    places = Counter()
    for r in rows:
        places[r.sequence_id] += r.length
    assert max(places.values()) <= 2048 and len(places) <= np.ceil(sum(places.values()) / 2048) + 2


def test_the_entry_holds_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_near_copies_with_repeated_and_null_keys(spark):
    same, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59)) + " end"
    lone, other = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(1, same, "a"), (2, near, "a"), (2, lone, "a"), (3, other, "b"), (3, other, "a"), (3, other, "b"), (None, near, "a"), (None, "n " + lone, "a"), (9, None, "a"), (9, None, "a"), (None, "", "a"), (9, " ", "b")]
    rows += [(None, f"z z1 z2 z3 {i} z4 z5", "a") for i in (1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == Counter([(1, same, "a"), (2, lone, "a"), (3, other, "a"), (9, None, "a"), (9, None, "a"), (None, "", "a"), (9, " ", "b"), (None, "z z1 z2 z3 1 z4 z5", "a")])
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0
    distinct = docs.where("doc_id < 3").dropDuplicates(["doc_id"])
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, distinct.where("doc_id = 1"), SF).collect()} == {1}


ODD = [("n_dropped", 1), ("n_lines", 1), ("score_", 0.1), ("score", 0.2), ("mark_", "m"), ("doc_", 5), ("row", "r"), ("whole", "w"), ("name", "n"), ("mark", "k"), ("key", 3), ("tokens", 4), ("kept", "x"), ("n", 9)]


def _odd_documents(spark):
    """Documents with columns that clash with names used inside, shared and repeated and null ids, odd and long texts."""
    prose = lambda seed, n: " ".join(f"w{(seed * 7919 + i * 104729) % 9973}" for i in range(n))
    line = "A line that two documents and a third one share"
    texts = [(1, f"{prose(1, 60)}\n{line}"), (2, f"{prose(2, 60)}\n{line}"), (2, f"{prose(3, 40)}\n{line.upper()}"), (3, line), (4, prose(4, 30)), (4, prose(4, 30)), (5, None), (6, ""), (7, " \n\t"), (None, prose(8, 25)), (None, prose(9, 25)), (None, f"{prose(1, 60)} end"), (8, prose(10, 60_000)), (9, "one two")]
    rows = [(d, t, "en", s, None if t is None else len(t), *[v for _, v in ODD]) for (d, t), s in zip(texts, ["a", "b", None, "a"] * 4, strict=False)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for n, v in ODD)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = _odd_documents(spark)
    given = docs.collect()
    as_tuple = lambda r: tuple("" if x is None else str(x) for x in r)
    one = corpus_pipeline.judge_quality(spark, docs, SF)
    assert one.columns == docs.columns and Counter(map(as_tuple, one.collect())) <= Counter(map(as_tuple, given))

    two = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert two.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in two.collect())
    # document 3 goes with its only line, 2 loses its second one, both by document 1
    want = Counter((r.doc_id, r.text.split("\n")[0] if r.doc_id == 2 else r.text) for r in given if r.doc_id != 3)
    assert got == want

    three = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert three.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in three.collect())
    first = next(r.text for r in given if r.doc_id == 1)
    assert all(n == 1 for k, n in left.items() if k[1] and k[1].strip()) and (1, first) in left and sum(1 for k in left if k[0] == 4) == 1

    four = corpus_pipeline.mix(spark, docs, SF)
    drawn = Counter(map(as_tuple, four.collect()))
    assert four.columns == docs.columns and set(drawn) == set(map(as_tuple, given))

    five = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sum(1 for r in five if r.piece == 0) == len(given) and all(r.length == 1 for r in five if r.doc_id in (5, 6))


def test_stages_of_empty_tables(spark, tmp_path):
    docs = _odd_documents(spark).limit(0)
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
    assert corpus_pipeline.judge_quality(spark, _odd_documents(spark), str(tmp_path)).count() == 0  # no labels: nothing is known to be good
