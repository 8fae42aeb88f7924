"""Who owns a secret, and texts with very many spans."""

import random
import time

from cadenza.llm import common, secrets


def _verdicts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {}
    for r in secrets.scan_secrets(df).collect():
        out.setdefault(r.key, set()).update(s.kind for s in r.spans if s.kind in ("live", "example"))
        assert (r.n_live, r.n_example) == tuple(sum(s.kind == k for s in r.spans) for k in ("live", "example"))
    return out


def test_owners_and_repositories_decide(spark):
    value = lambda i: f"password=Zx{i}cV8bN1mQ5w"
    rows = [(1, value(1), "a"), (2, value(2), "a"), (3, value(2), "b"), (4, value(3), "a"), (5, value(3), "b"), (6, value(3), "c"), (7, value(4), "a"), (7, value(4), "a")]
    rows += [(100 + i, value(5), "a") for i in range(15)] + [(200 + i, value(6), "a") for i in range(16)] + [(300, value(7), None), (301, value(7), "a")]
    got = _verdicts(spark, rows)
    assert got[1] == got[7] == got[100] == {"live"}  # one owner
    assert got[2] == got[3] == got[300] == set()  # two; null is an owner
    assert got[4] == got[5] == got[6] == {"example"}  # three
    assert got[200] == {"example"}  # one owner, sixteen repositories
    counts = {r.key: (r.most_owners, r.most_repositories) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert counts[4] == (3, 3) and counts[7] == (1, 1) and counts[100] == (1, 15) and counts[301] == (2, 2)


def test_a_value_in_very_many_documents_is_split(spark, monkeypatch):
    rows = [(i, "token: AAAA1111bbbb2222", f"s{i % 2}") for i in range(200)] + [(1000, "token: only0once9here7", "s0"), (1001, None, "s0")]
    want = _verdicts(spark, rows)
    monkeypatch.setattr(common, "SPLIT_LEAST", 10)
    assert _verdicts(spark, rows) == want and want[0] == {"example"} and want[1000] == {"live"} and want[1001] == set()


def test_tens_of_thousands_of_spans_in_one_text(spark):
    rng = random.Random(1)
    text = " ".join(f"{rng.getrandbits(64):016x}" for _ in range(40_000))
    df = spark.createDataFrame([(1, text, "a"), (2, "none", "a")], "doc_id long, text string, source string")
    secrets.secret_digests(secrets.scan_secrets(df)).collect()  # starts the engine
    begun = time.perf_counter()
    rows = {r.key: r for r in secrets.secret_digests(secrets.scan_secrets(df)).collect()}
    assert time.perf_counter() - begun < 20
    assert rows[1].n_hex == 40_000 and rows[2].n_hex == 0
    places = [s.split(":") for s in rows[1].spans.split(",") if s.startswith("hex")]
    assert [int(p[1]) for p in places] == [17 * i for i in range(40_000)]
