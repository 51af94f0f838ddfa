import zlib
from collections import defaultdict

import numpy as np
import pytest

from lustrum.llm import packing, tokens


def test_ids_are_the_tokenizers(corpus):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokens.default_path())
    texts = [t for _, t in corpus if t] + ["<|endoftext|>", "a<|endoftext|> b", "  x  \n\n y", "naïve 漢字 😀 don't", "a" * 500]
    enc = tokens.Encoder(tokens.default_path())
    for text in texts:
        assert enc.ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def check_packing(got, docs, capacity):
    enc = tokens.Encoder(tokens.default_path())
    want = []
    for doc_id, text in docs:
        ids = np.append(enc.ids(text or ""), 0).astype("<u4")
        parts = [ids[max(0, k - capacity) : k] for k in range(len(ids), 0, -capacity)][::-1]
        at = 0
        for k, part in enumerate(parts):
            want.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            at += len(part)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(make_docs, corpus, capacity):
    got = packing.pack(make_docs(corpus, extra=True), capacity).collect()
    n = check_packing(got, corpus, capacity)
    least = -(-sum(r.length for r in got) // capacity)
    assert n <= least + 1 + least // 200


def test_empty_table(make_docs):
    assert packing.pack(make_docs([])).collect() == []


def test_only_empty_texts(make_docs):
    got = packing.pack(make_docs([(i, None) for i in range(3000)])).collect()
    assert len({r.sequence_id for r in got}) == 2


def test_plan_places_everything():
    rng = np.random.default_rng(1)
    for counts in ({1: 10_000_000}, {2048: 5, 1: 3}, {1500: 7, 700: 3}, {int(k): int(rng.integers(1, 500)) for k in rng.integers(1, 2049, size=900)}):
        left = dict(counts)
        used = total = 0
        for parts, times in packing.plan(counts):
            assert sum(parts) <= 2048 and times > 0
            used += times
            for p in parts:
                left[p] -= times
            total += sum(parts) * times
        assert not any(left.values())
        assert used >= -(-total // 2048)
    assert used <= total / 2048 * 1.02 + 2


def test_exact_complements_come_first():
    assert packing.plan({2000: 1, 48: 1, 40: 1, 8: 1, 1000: 1, 600: 1, 448: 1}) == [([2000, 48], 1), ([1000, 600, 448], 1), ([40, 8], 1)]
