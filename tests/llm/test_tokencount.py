import numpy as np
import pytest

from lustrum.llm import tokencount as T
from lustrum.llm.tokens import default_path, encoder


def test_counts(make_docs, corpus):
    rows = [*corpus, (900, "a <|endoftext|> b")]
    got = T.count_tokens(make_docs(rows, extra=True)).collect()
    enc = encoder(default_path())
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == sorted(str((i, len(enc.plain_ids(t or "")))) for i, t in rows)


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_raw_files(spark, tmp_path, width, block):
    rng = np.random.default_rng(4)
    want = []
    for f in range(6):
        lengths = [int(x) for x in rng.integers(0, 12, size=rng.integers(0, 9))] + ([25] if f % 2 else [])
        ids = [x for n in lengths for x in [*rng.integers(0, 50_000, size=n), T.END]]
        tail = [1, 2, 3] if f == 2 else []
        (tmp_path / f"{f}.bin").write_bytes(np.array(ids + tail, f"<u{width}").tobytes())
        want += [(f"{f}.bin", k, n, False) for k, n in enumerate(lengths)] + [(f"{f}.bin", len(lengths), 3, True)] * bool(tail)
    got = T.scan(T.read_files(spark, f"file://{tmp_path}"), width=width, block=block).collect()
    assert sorted((r.file.rsplit("/")[-1], r.ordinal, r.n_tokens, r.open) for r in got) == sorted(want)


def test_segments(make_docs, corpus):
    files = T.flat(make_docs(corpus), segment=50, part=16).cache()
    parts, owners = files.where("ids is not null"), files.where("doc_ids is not null")
    assert owners.count() > 20 and owners.select("file").distinct().count() == owners.count() < parts.count()
    assert parts.where("octet_length(ids) > 16 or doc_ids is not null").count() == 0
    n_docs = {r.file: len(r.doc_ids) for r in owners.collect()}
    got = T.scan(parts, block=3).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in got} == n_docs


def test_empty_table(make_docs):
    assert T.count_tokens(make_docs([])).collect() == []


@pytest.mark.parametrize("width", [2, 4])
def test_ranges_of_bytes(spark, tmp_path, width):
    rng = np.random.default_rng(5)
    ids = np.where(rng.random(5000) < 0.02, T.END, rng.integers(0, 50_000, size=5000))
    (tmp_path / "a.bin").write_bytes(ids.astype(f"<u{width}").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    whole = T.scan(T.read_files(spark, f"file://{tmp_path}"), width=width)
    split = T.read_files(spark, f"file://{tmp_path}", part=72)
    assert split.count() > 100
    rows = lambda df: sorted((r.ordinal, r.n_tokens, r.open) for r in df.collect())
    assert rows(T.scan(split, width=width, block=7)) == rows(whole)


def test_what_does_not_fit_fails(spark, make_docs, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number of ids"):
        T.scan(T.read_files(spark, f"file://{tmp_path}")).collect()
    with pytest.raises(ValueError, match="fit"):
        T.flat(make_docs([(1, "a")]), end=70_000)
    assert T.width_of() == 2 and T.width_of(end=70_000) == 4
