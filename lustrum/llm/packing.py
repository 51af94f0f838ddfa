"""Best-fit packing by exact-complement hashing.

Documents become runs of token ids (each ends with id 0); a run over the capacity
is cut into pieces.  Which pieces share a sequence depends on lengths alone, and a
length is at most the capacity, so the plan is made from a histogram that has at
most ``capacity`` rows however many documents there are.  The plan indexes single,
pair and triple sums of the lengths still available, consumes the combinations that
exactly fill a gap as often as the counts allow, and gives what is left to best fit.
Rows then look their place up by (length, rank within the length).

Defined results: a null or empty text is one piece of length 1 (id 0); repeated rows
are packed once each; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, gapless_rank
from .tokens import default_path, encoder

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (little-endian uint32 ids).

    Of a document that is cut, all pieces but the first have ``capacity`` ids.
    """
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids_of, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids_of, batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), 0).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


class _Stock:
    """Counts of the lengths still to place, with the index of their sums."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self._index()

    def _index(self) -> None:
        self.desc = sorted(self.n, reverse=True)
        self.single = sum(1 << k for k in self.n)
        self.pair = 0
        for k in self.n:
            self.pair |= self.single << k

    def fits(self, parts: tuple[int, ...]) -> int:
        """How often ``parts`` can be taken."""
        return min(self.n.get(p, 0) // parts.count(p) for p in set(parts))

    def take(self, parts: list[int], times: int) -> None:
        gone = False
        for p in parts:
            self.n[p] -= times
            if not self.n[p]:
                del self.n[p]
                gone = True
        if gone:
            self._index()

    def exact(self, held: tuple[int, ...], gap: int, most: int) -> tuple[int, ...] | None:
        """One, two or three lengths (at most ``most``) that fill ``gap`` next to what is held."""
        if self.single >> gap & 1 and self.fits((*held, gap)):
            return (gap,)
        if most > 1 and self.pair >> gap & 1 and (two := self._two(held, gap)):
            return two
        for a in self.desc if most > 2 else ():
            if a < gap and self.pair >> (gap - a) & 1 and (two := self._two((*held, a), gap - a)):
                return (a, *two)
        return None

    def _two(self, held: tuple[int, ...], gap: int) -> tuple[int, int] | None:
        for a in self.desc:
            if 2 * a < gap:
                return None
            if a < gap and self.single >> (gap - a) & 1 and self.fits((*held, a, gap - a)):
                return a, gap - a
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), all of ``counts`` placed.

    Triples fill gaps that pairs can't, but where long lengths abound they use up short
    ones that would each complete one; so the plans that consume up to triples, pairs and
    singles are made, and that of the fewest sequences is taken.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda entries: sum(times for _, times in entries))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[list[int], int]]:
    """Every entry uses up a length or the longest one's share, so the number of entries
    grows with the distinct lengths and not with the documents."""
    stock, out = _Stock(counts), []
    while stock.n:
        held: tuple[int, ...] = (stock.desc[0],)
        gap = capacity - held[0]
        while gap:
            if rest := stock.exact(held, gap, most):
                held, gap = (*held, *rest), 0
                break
            best = next((k for k in stock.desc if k <= gap and stock.fits((*held, k))), 0)
            if not best:
                break
            held, gap = (*held, best), gap - best
            more = min(gap // best, stock.n[best] - held.count(best))
            if more > 8:  # a long run of one short length is laid at once
                held, gap = (*held, *[best] * (more - 4)), gap - best * (more - 4)
        times = stock.fits(held)
        stock.take(list(held), times)
        out.append((sorted(held, reverse=True), times))
    return out


def _places(entries: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): arrays sorted for a binary search."""
    rows, used, sequence = [], {}, 0
    for parts, times in entries:
        offset = 0
        for length in sorted(set(parts), reverse=True):
            k = parts.count(length)
            lo = used.get(length, 0)
            rows.append((length << 40 | lo, lo, k, sequence, offset))
            used[length] = lo + k * times
            offset += k * length
        sequence += times
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("key", "lo", "k", "sequence", "offset"), cols, strict=True))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Every piece with its place: sequence_id, and offset (gapless from 0)."""
    cut = durable(pieces(docs, capacity, tokenizer))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    at = _places(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(at["key"], n << 40 | r, side="right") - 1
        r = r - at["lo"][i]
        return pd.DataFrame({"sequence_id": at["sequence"][i] + r // at["k"][i], "offset": at["offset"][i] + r % at["k"][i] * n})

    # buckets enough that the most frequent length has at most some 250,000 rows in each
    buckets = max(64, max(counts.values(), default=0) // 250_000)
    ranked = gapless_rank(cut, ["length"], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)), [F.col(c) for c in ("doc_id", "piece", "ids_crc32")], "__r")
    placed = ranked.withColumn("__at", place("length", "__r"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset")
