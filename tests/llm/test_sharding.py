import zlib
from collections import Counter

from lustrum.llm import sharding


def test_law_of_keys(make_docs, corpus):
    rows = [*corpus, *[(1000 + i, f"text {i}") for i in range(3000)]]
    got = sharding.shard(make_docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.shard == {x.shard for x in got if x.doc_id == r.doc_id}.pop() if r.doc_id in (42, None) else True
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    moved = sum(r.grown_shard == 24 for r in got)
    assert 0.5 < moved / (len(rows) / 25) < 1.6
    assert max(map(len, shards.values())) < 2 * len(rows) / 24


def test_weights_and_confined_movement(spark, make_docs):
    docs = make_docs([(i, "x") for i in range(6000)]).selectExpr("doc_id", "cast(doc_id as string) as k")
    before = {"a": {"a/1": {0: 1.0, 1: 1.0}, "a/2": {2: 2.0}}, "b": {"b/1": {3: 1.0, 4: 3.0}}}
    after = {"a": before["a"], "b": {"b/1": {3: 1.0, 4: 5.0}}}
    got = sharding.descend(sharding.descend(docs, docs["k"], before, "s"), docs["k"], after, "t").collect()
    n = Counter(r.s for r in got)
    assert abs(n[4] / n[3] - 3) < 0.6 and abs(n[2] / n[0] - 2) < 0.4
    # rows only move into the subtree that grew, and within it only into the leaf that grew
    assert {(r.s, r.t) for r in got if r.s != r.t and r.s in (3, 4)} <= {(3, 4)}
    assert all(r.t in (3, 4) for r in got if r.s != r.t)


def test_empty_table(make_docs):
    assert sharding.shard(make_docs([])).collect() == []
