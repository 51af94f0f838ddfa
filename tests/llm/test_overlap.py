import random
from collections import defaultdict
from itertools import combinations

import numpy as np

import corpus_pipeline as P
from lustrum.llm import overlap, simhash


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_components(rows):
    sets, up = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8:
            up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)].append(doc_id)
    return sorted(str((doc_id, min(least[top(i)], default=None))) for i, (doc_id, _) in enumerate(rows))


def near_texts():
    """Pairs of texts with similarity from 0.6 to 1, some of exactly 0.8."""
    rng, rows = random.Random(8), []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))]
        rows.append((1000 + 2 * k, " ".join(words)))
        words[: rng.randint(0, len(words) // 4)] = []
        rows.append((1001 + 2 * k, " ".join(words)))
    words = [f"v{k}" for k in range(104)]
    return [*rows, (2000, " ".join(words)), (2001, " ".join(words[:84]))]


def test_components(make_docs, corpus, monkeypatch):
    rows = [*corpus, *near_texts()]
    for chunk in (overlap.CHUNK, 2):
        monkeypatch.setattr(overlap, "CHUNK", chunk)
        got = overlap.near_copies(make_docs(rows, extra=True)).collect()
        assert sorted(str((r.doc_id, r.component_id)) for r in got) == slow_components(rows)


def test_alike_links():
    sets = [overlap.shingles(t) for _, t in near_texts()]
    a, b = overlap.alike_links(np.arange(len(sets)), sets)
    assert (len(sets) - 2, len(sets) - 1) in {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert all(len(np.intersect1d(sets[i], sets[j])) * 10 >= len(np.union1d(sets[i], sets[j])) * 8 for i, j in zip(a, b, strict=True))


def test_stage_drops_near_copies_whose_fingerprints_differ(spark, make_docs):
    rows = near_texts()
    far = [(i, j) for (i, s), (j, t) in zip(rows[::2], rows[1::2], strict=True) if bin(simhash.fingerprint(s) ^ simhash.fingerprint(t)).count("1") > 4 and len(slow_set(s) & slow_set(t)) * 10 >= len(slow_set(s) | slow_set(t)) * 8]
    assert len(far) > 5
    kept = {r.doc_id for r in P.near_stage(spark, make_docs(rows), "").collect()}
    assert all(i in kept and j not in kept for i, j in far)


def test_empty_table(make_docs):
    assert overlap.near_copies(make_docs([])).collect() == []


def test_candidates_come_from_anchors(spark):
    """Sets of similarity 0.8 meet through the fingerprints' anchors; a large group of near copies needs few links."""
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(150):
        own = rng.integers(0, 2**63, 100, dtype=np.uint64)
        sets += [own, own[:80]]
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for k in range(300):
        own = base.copy()
        own[k % 200 : k % 200 + 1 + k // 200] = rng.integers(0, 2**63)
        sets.append(own)
    words = [simhash.words_of(s) for s in sets]
    codes = [simhash.code_of(w) for w in words]
    df = spark.createDataFrame([(w.view(np.int64).tolist(),) for w in words], "words array<long>")
    got = {frozenset(r) for r in simhash.candidates(df).distinct().collect()}
    far = sum(bin(simhash.words_of(sets[2 * k])[2] ^ simhash.words_of(sets[2 * k + 1])[2]).count("1") > 4 for k in range(150))
    assert far > 120 and sum(frozenset(codes[2 * k : 2 * k + 2]) in got for k in range(150)) >= 148
    near = set(codes[300:])
    assert len({c for pair in got for c in pair} & near) == len(near) and sum(pair <= near for pair in got) < 12 * len(near)


def test_wide_links_of_large_groups():
    rng = np.random.default_rng(10)
    fp = np.concatenate([np.uint64(5) ^ np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64), rng.integers(0, 2**63, 150, dtype=np.uint64)])
    key = np.zeros(len(fp), np.uint64)
    for size in (350, 40):
        group = np.arange(len(fp)) // size
        a, b = simhash._wide_links(group, key, fp)
        up = {i: i for i in range(len(fp))}

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in combinations(range(len(fp)), 2):
            if group[i] == group[j] and bin(int(fp[i] ^ fp[j])).count("1") <= simhash.APART:
                up[max(top(i), top(j))] = min(top(i), top(j))
        assert {int(i): int(j) for i, j in zip(a, b, strict=True)} == {i: top(i) for i in up if top(i) != i}
