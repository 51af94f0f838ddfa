from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lustrum.llm import simhash


def slow_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(corpus):
    for _, text in corpus:
        if not text or len(text) < 20_000:
            assert simhash.fingerprint(text) == slow_fingerprint(text)
    long = "w1 w2 w3 w4 w5 " * 30_000  # more shingles than one block of counts
    assert simhash.fingerprint(long) == slow_fingerprint(long)


def components(rows):
    """doc ids by brute force."""
    fps = [simhash.fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)].append(doc_id)
    return sorted(str((doc_id, fps[i], min(least[top(i)], default=None))) for i, (doc_id, _) in enumerate(rows))


def test_near_duplicates(make_docs, corpus):
    got = simhash.near_duplicates(make_docs(corpus, extra=True)).collect()
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == components(corpus)


def test_split_anchors(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 2)
    got = simhash.near_duplicates(make_docs(corpus)).collect()
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == components(corpus)
    monkeypatch.setattr(simhash, "BROADCAST", 0)
    got = simhash.near_duplicates(make_docs(corpus)).collect()
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == components(corpus)


@pytest.mark.parametrize("most", [(3, 10**10), (3, 4)])
def test_finer_codes(make_docs, corpus, monkeypatch, most):
    monkeypatch.setattr(simhash, "GOLAY_MOST", most[0])
    monkeypatch.setattr(simhash, "HAMMING_MOST", most[1])
    got = simhash.near_duplicates(make_docs(corpus)).collect()
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == components(corpus)


def test_codes_follow_the_table():
    assert [simhash.CODES.index(simhash.code_for(n)) for n in (0, 10**8, 10**8 + 1, 3 * 10**10, 10**12)] == [0, 0, 1, 1, 2]


def test_codes_cover_within_their_radius():
    """Words with one name differ in at most twice the radius."""
    words = np.random.default_rng(5).permutation(1 << 22)[:60_000].astype(np.uint32)
    for code, radius in zip(simhash.CODES, (3, 1, 0), strict=True):
        names = code.name(words)
        assert names.max() < 1 << code.bits
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        assert (np.bitwise_count(words[order][1:] ^ words[order][:-1])[same] <= 2 * radius).all()


@pytest.mark.parametrize("code", simhash.CODES)
def test_anchors_cover_every_link(code):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, size=4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, size=4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    held = [defaultdict(set), defaultdict(set)]
    for side, x in enumerate((a, b)):
        row, anchor = simhash.anchors(x, code)
        for r, c in zip(row.tolist(), anchor.tolist(), strict=True):
            held[side][r].add(c)
    assert all(held[0][i] & held[1][i] for i in range(len(a)))


def test_large_groups():
    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([np.bitwise_xor(np.uint64(12345), np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), rng.integers(0, 2**63, size=300, dtype=np.uint64)]))
    a, b = simhash._links(np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int8), fp, 4)
    assert len(a) == 63 or len(a) == len({*a.tolist()})
    assert all(bin(int(x)).count("1") <= 64 for x in a)
    near = {int(x) for x in fp if bin(int(x) ^ 12345).count("1") <= 1}
    assert {int(x) for x in a} | {int(x) for x in b} >= near


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
