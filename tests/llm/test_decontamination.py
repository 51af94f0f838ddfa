import hashlib
import random
import re

import pytest

from lustrum.llm import decontamination as D


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def slow(docs, items, span=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def run(spark, make_docs, docs, items, **more):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(make_docs(docs, extra=True), table, **more).drop("th")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.fixture(scope="module")
def items():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["Élan", "über", "x9"]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 30)))) for i in range(12)] + [(12, None), (13, "..."), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]


@pytest.fixture(scope="module")
def docs(items):
    rng = random.Random(9)
    out = []
    for i in range(80):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            piece = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(piece) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece[a : a + rng.randint(5, 25)]
        out.append((i, rng.choice([" ", ", ", "\n"]).join(w).replace("w1", rng.choice(["w1", "W1"]))))
    return [*out, (90, None), (91, ""), (92, " .. "), (5, out[5][1]), (93, " ".join(["w1"] * 20_000)), (None, items[0][1]), (94, "  " + items[1][1] + " !"), (95, items[3][1].upper())]


def test_against_sets(spark, make_docs, docs, items):
    assert run(spark, make_docs, docs, items) == slow(docs, items)


def test_short_items_and_joins_without_broadcast(spark, make_docs, docs, items, monkeypatch):
    more = [*items, (20, "w3 w4"), (21, "w7"), (22, "w1 w1 w1"), (23, "Élan über x9")]
    assert run(spark, make_docs, docs, more) == slow(docs, more)
    monkeypatch.setattr(D, "BROADCAST", 0)
    assert run(spark, make_docs, docs, more) == slow(docs, more)


def test_empty_tables(spark, make_docs, docs, items):
    assert run(spark, make_docs, [], items) == []
    assert run(spark, make_docs, docs[:3], []) == slow(docs[:3], [])


@pytest.mark.parametrize("k", [1, 4, 8, 10])
def test_any_gram_length(spark, make_docs, docs, items, k):
    assert run(spark, make_docs, docs, items, k=k) == slow(docs, items)


def test_clashing_columns_of_the_benchmark(spark, make_docs, docs, items):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(items, "item_id long, text string")
    for name in ("words", "each", "g5", "place", "s", "at", "w", "fp", "doc_id", "th"):
        table = table.withColumn(name, F.lit("x"))
    got = D.decontaminate(make_docs(docs), table).drop("th")
    assert sorted(str(tuple(r)) for r in got.collect()) == slow(docs, items)


def test_windows_are_thinned(spark, make_docs):
    rng = random.Random(3)
    text = " ".join(f"v{rng.randrange(10**6)}" for _ in range(3000))
    win = D._Winnow(10, D.K, [10])
    at = win.placed(win.hashed(D._words(make_docs([(1, text)]), []), []).withColumn("place", D.F.explode(win.places(10))))
    assert 0.25 < at.where(win.fresh()).count() / at.count() < 0.42
