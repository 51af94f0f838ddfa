import numpy as np
import pytest

from lustrum.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, every, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q_id, q in ok:
        if q_id % every == 0:
            scored = sorted((-float((v * q).sum()), i) for i, v in ok if i != q_id)
            out[q_id] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(n, seed=0, dims=32):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    x = centers[rng.integers(12, size=n)] + rng.normal(size=(n, dims)) * 0.7
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]


def run(spark, rows, **more):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in ann.search(table, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_scores(spark):
    rows = vectors(3000)
    got, want = run(spark, rows), exact(rows, 20, 20)
    assert got.keys() == want.keys()
    vec = {i: np.array(v) for i, v in rows}
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0])) and q not in dict(found)
        assert all(s == pytest.approx(float(vec[q] @ vec[i]), abs=1e-9) for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.95


def test_split_lists_find_the_same(spark, monkeypatch):
    rows = vectors(800, 1)
    whole = run(spark, rows)
    monkeypatch.setattr(ann, "CHUNK", 7)
    monkeypatch.setattr(ann, "QUERIES", 3)
    split = run(spark, rows)
    same = sum(len({i for i, _ in whole[q]} & {i for i, _ in split[q]}) for q in whole)
    assert same / (20 * len(whole)) > 0.97


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(200)] + [(200 + i, [0.0, 1.0, 0.1 * i]) for i in range(30)]
    got, want = run(spark, rows), exact(rows, 20, 20)
    for q in range(0, 200, 20):
        assert got[q] == want[q]


def test_odd_rows(spark):
    bad = [(20, None), (21, []), (22, [0.0, 0.0]), (23, [float("nan"), 1.0]), (24, [None, 1.0]), (40, [float("inf"), 1.0]), (60, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0]), (80, [0.3, 0.1])]
    got = run(spark, bad + good)
    assert got == {q: [(i, pytest.approx(s)) for i, s in f] for q, f in exact(good, 20, 20).items()}
    assert run(spark, bad[:3]) == {} and run(spark, []) == {} and run(spark, good[:1]) == {}
    twice = run(spark, [*good, (1, [0.5, 0.5])])
    assert [i for i, _ in twice[0]] == [1, 1, 80, 2]
