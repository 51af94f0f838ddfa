import random
import zlib

import numpy as np
import pytest

from lustrum.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = Q.classify(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[x.doc_id].predicted, x.quality, got[x.doc_id].score) for x in labels.collect() if got[x.doc_id].held_out]
    assert sum(p == q for p, q, _ in held) / len(held) >= 0.93
    good, poor = [s for _, q, s in held if q], [s for _, q, s in held if not q]
    wins = sum((g > p) + 0.5 * (g == p) for g in good for p in poor) / (len(good) * len(poor))
    assert wins >= 0.95


def test_only_text_and_unheld_labels_count(spark, make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["fine", "words", "here"]) for _ in range(30)) if i % 2 else "BAD!! STUFF!! " * 12) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "fine words " * 10_000), (3, rows[3][1]), (None, "fine words here")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    wrong = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    docs = make_docs(rows, extra=True)
    a = sorted(str(tuple(r)) for r in Q.classify(docs, labels).collect())
    assert a == sorted(str(tuple(r)) for r in Q.classify(docs, wrong).collect())
    by = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert all(by[i].predicted == i % 2 for i in range(120)) and by[502].predicted == 1 and len(a) == len(rows)
    assert by[500].score == by[501].score


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None)]])
def test_without_both_labels(spark, make_docs, labels):
    got = Q.classify(make_docs([(1, "a"), (2, None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)] * 2


def test_empty_table(spark, make_docs):
    assert Q.classify(make_docs([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_newton_steps_against_plain_descent():
    rng = np.random.default_rng(2)
    d = rng.normal(size=(400, 6)) + np.array([0.5, 0, -0.3, 0, 1, 0])
    penalty = np.array([1e-2] * 3 + [1e-1] * 3)
    w = np.zeros(6)
    for _ in range(20_000):
        w -= 0.5 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) / len(d) + penalty * w)
    pairs = np.vstack([d, np.zeros((1, 6))])
    assert np.allclose(Q.bradley_terry(pairs, np.arange(400), np.full(400, 400), penalty), w, atol=1e-5)


def test_words_count(spark, make_docs):
    """Texts that no shape tells apart: words of equal length, one of each pair is poor."""
    rng = random.Random(4)
    good, poor = ["alpha", "gamma", "delta", "kappa"], ["omega", "theta", "sigma", "zetas"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else poor) for _ in range(40))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = [r for r in Q.classify(make_docs(rows), labels).collect() if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in got) / len(got) >= 0.97


def test_features_are_those_of_the_whole_text():
    text = "one two three " * 30_000 + "Four!"
    assert len(Q.features(text)) == Q.WIDTH and not np.allclose(Q.features(text), Q.features(text[: len(text) // 2] + "Five Six"))
    assert np.isfinite(Q.features(None)).all() and np.isfinite(Q.features("x")).all()


def test_every_learning_row_counts(spark, make_docs, monkeypatch):
    """All pairs within the groups against the same pairs in one array; groups take in every row, the rarer label's too."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["fine", "words", "BAD!!", "x9"]) for _ in range(rng.randint(3, 30)))) for i in range(400)]
    table = spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    learn = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    for group in (16, 5):  # 5: more groups than poor rows
        monkeypatch.setattr(Q, "GROUP", group)
        seen = []
        deal = Q._deal
        monkeypatch.setattr(Q, "_deal", lambda r, n, deal=deal, seen=seen: seen.append(deal(r, n)) or seen[-1])
        model = Q.fit(make_docs(rows), table)
        monkeypatch.setattr(Q, "_deal", deal)
        got = seen[0].collect()
        assert sum(r.own for r in got) == len(learn) and all({r.good for r in got if r.grp == g} == {True, False} for g in {r.grp for r in got})
        x = np.stack([np.frombuffer(r.x, "<f4").astype(float) for r in got])
        own = x[[r.own for r in got]]
        scale = np.where(own.std(axis=0) > 1e-9, own.std(axis=0), 1.0)
        pairs = [(a, b) for a, g in enumerate(got) if g.good for b, p in enumerate(got) if not p.good and p.grp == g.grp]
        penalty = np.repeat([1e-3, 0.03], [Q.SHAPES, Q.WIDTH - Q.SHAPES])
        w = Q.bradley_terry(x / scale, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), penalty)
        assert np.allclose(model.mean, own.mean(axis=0)) and np.allclose(model.scale, scale) and np.allclose(model.weights, w, atol=1e-5)
        z = np.sort(((own - model.mean) / model.scale) @ model.weights)
        poor = sum(i % 9 == 0 for i in learn)
        assert np.isclose(model.threshold, (z[poor - 1] + z[poor]) / 2)
        assert np.allclose(model.low, own.min(axis=0)) and np.allclose(model.high, own.max(axis=0))


def test_scores_of_a_rank(spark, monkeypatch):
    """Bins that hold too much are taken apart, ties too."""
    monkeypatch.setattr(Q, "BINS", 3)
    monkeypatch.setattr(Q, "SORTED", 2)
    values = [0.0, 1.0, 1.0, 1.0, 1.0, 1.5, 1.5000001, 2.0, 900.0, 900.0, 900.0]
    x = lambda v: np.full(Q.WIDTH, v, "<f4").tobytes()
    rows = spark.createDataFrame([(k // 4, k % 2 == 0, True, x(v)) for k, v in enumerate(values)] + [(9, True, False, x(5.0))], "grp long, good boolean, own boolean, x binary")
    dealt = rows.repartition(2, "grp").sortWithinPartitions("grp")
    score = lambda x: x[:, 0].astype(float)
    assert [Q._ranked(dealt, score, k, 0.0, 900.0) for k in range(len(values))] == [float(np.float32(v)) for v in values]
