"""Quality classifier: Bradley-Terry ranking from preference pairs.

Each pair of a good and a poor document is a comparison that the good one wins with
probability sigmoid(score difference); the weights minimise the logistic loss on feature
differences.  Every learning row takes part: the rows are dealt into groups of about
``GROUP`` with both labels in each, and all pairs within a group are compared, so that
pairs grow with the rows.  The threshold is the quantile of all learning rows' scores that
splits them as their labels do.  A document's score is the sigmoid of its distance from
the threshold, so it is 0.5 or more from the threshold on.

Features come from the text alone: shares of byte classes, word shapes and repeats, and
the frequencies of hashed words and pairs of words, which a stronger penalty holds back.
Rows stay with the executors: a Newton step, a moment or a count of scores brings one
array a task to the driver, from at most ``TASKS`` tasks.  Every document is scored, over
its whole text.

Defined results: a null text counts as the empty text; without labels of both kinds all
scores are 0.5 (nothing is rejected); repeated rows get the same score each; a null
doc_id isn't held out; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, few_broadcast, gapless_rank

#: learning rows that are compared with each other, and tasks that the groups are dealt over at most
GROUP, TASKS = 256, 64
#: learning rows' ids that are broadcast at most (16 bytes each)
BROADCAST = 1_000_000
#: bins of the scores, and scores of one bin that the driver sorts at most
BINS, SORTED = 4096, 10_000
#: shape features, and hashed features of words and of pairs of words
SHAPES, HASHED = 21, 64
WIDTH = SHAPES + 2 * HASHED


@functools.cache
def _classes() -> np.ndarray:
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 stop, 6 loud, 7 symbol, 8 beyond ASCII."""
    kind = np.full(256, 7)
    for k, s in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:'\"()-", "!?")):
        kind[list(s.encode())] = k
    kind[128:] = 8
    return kind


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_classes(), weights=seen, minlength=9) / max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    distinct, shouted = set(words), sum(map(bytes.isupper, words))
    ends = np.fromiter((w[-1] for w in words), np.uint8, len(words))
    odd = int(np.isin(_classes()[ends], (6, 7)).sum())
    extra = [
        np.log1p(len(words)), sizes.mean(), sizes.std(), np.log(max(1, len(distinct))) / np.log(n + 1.0), len(distinct) / n,
        shouted / n, odd / n, len(set(lines)) / max(1, len(lines)), np.log1p(len(raw) / max(1, len(lines))),
    ]
    return np.concatenate([shares, np.sqrt(shares[5:8]), extra, _hashed(words)])


def _hashed(words: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed words and pairs of words."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) >> np.uint64(7)
    return np.concatenate([np.sqrt(np.bincount(x % np.uint64(HASHED), minlength=HASHED) / max(1, len(x))) for x in (h, pairs)])


def _newton(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], penalty: np.ndarray, steps: int) -> np.ndarray:
    """Weights that minimise a penalised mean loss; ``sums``: pairs, slope and curvature of the loss over them."""
    w = np.zeros(len(penalty))
    for _ in range(steps):
        n, slope, curve = sums(w)
        step = np.linalg.solve(np.diag(penalty) + curve / n, penalty * w + slope / n)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def bradley_terry(x: np.ndarray, winner: np.ndarray, loser: np.ndarray, penalty: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights that minimise the mean logistic loss on the given pairs' feature differences, by Newton steps."""

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d = (x[winner] - x[loser]).astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        return len(winner), d.T @ (p - 1), (d.T * (p * (1 - p))) @ d

    return _newton(sums, penalty, steps)


@dataclass(frozen=True)
class Rows:
    """Some learning rows, whole groups of them: labels and own (false: here again) beside the features."""

    group: np.ndarray
    good: np.ndarray
    own: np.ndarray
    x: np.ndarray


def compared(rows: Rows, w: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Of all pairs within each group: their number, slope and the upper half of the curvature."""
    z = rows.x / scale
    s, width = z @ w, len(w)
    n, slope, curve = 0, np.zeros(width), np.zeros((width, width))
    cuts = np.flatnonzero(np.diff(rows.group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)], strict=True):
        good = rows.good[a:b]
        won, lost = z[a:b][good], z[a:b][~good]
        p = 1 / (1 + np.exp(-np.clip(s[a:b][good][:, None] - s[a:b][~good][None, :], -30, 30)))
        q = p * (1 - p)
        cross = won.T @ q @ lost
        n += p.size
        slope += won.T @ (p - 1).sum(axis=1) - lost.T @ (p - 1).sum(axis=0)
        curve += (won.T * q.sum(axis=1)) @ won + (lost.T * q.sum(axis=0)) @ lost - cross - cross.T
    return np.concatenate([[n], slope, curve[np.triu_indices(width)]])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    held = None
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<f4").reshape(-1, WIDTH)
        cols = [*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)), x]
        cols = [np.concatenate(c) for c in zip(held, cols, strict=True)] if held else cols
        cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if cut:
            yield Rows(*(c[:cut] for c in cols))
        held = [c[cut:] for c in cols]
    if held and len(held[0]):
        yield Rows(*held)


def _total(dealt: DataFrame, of: Callable[[Rows], np.ndarray], add: np.ufunc | Callable = np.add) -> np.ndarray:
    """The arrays of all tasks put together, always in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [of(rows) for rows in _whole_groups(batches)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([functools.reduce(add, parts).tobytes()])], names=["part", "sums"])

    got = sorted(dealt.mapInArrow(run, "part int, sums binary").collect())
    return functools.reduce(add, [np.frombuffer(r.sums) for r in got])


def _deal(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """Learning rows (group, good, own, x) in groups, each with both labels.

    Rows of a label with fewer rows than there are groups stand in several groups; they
    are their own in the first.
    """
    groups = -(-sum(n.values()) // GROUP)
    rank = gapless_rank(rows, ["label"], F.pmod(F.xxhash64("doc_id", "x"), F.lit(256)), [F.xxhash64("doc_id"), F.col("doc_id"), F.col("x")], "rank")
    here = F.when(F.col("label") == 1, F.lit(n[1])).otherwise(F.lit(n[0]))
    at = F.when(here >= groups, F.array(F.col("rank") % groups)).otherwise(F.sequence(F.col("rank"), F.lit(groups - 1).cast("long"), here.cast("long")))
    dealt = rank.select((F.col("label") == 1).alias("good"), "x", "rank", F.explode(at).alias("grp"))
    dealt = dealt.select("grp", "good", ((F.col("rank") % groups) == F.col("grp")).alias("own"), "x")
    tasks = min(TASKS, -(-groups * GROUP // 2048))
    return durable(dealt.repartition(tasks, "grp").sortWithinPartitions("grp", "good", "own", "x"))


def _split(dealt: DataFrame, score: Callable[[np.ndarray], np.ndarray], poor: int) -> float:
    """Halfway between the scores of rank poor - 1 and poor (from 0) among all learning rows."""
    low, high = _total(dealt, lambda r: np.array([(z := score(r.x)).min(), -z.max()]), np.minimum) * (1, -1)
    return (_ranked(dealt, score, poor - 1, low, high) + _ranked(dealt, score, poor, low, high)) / 2


def _ranked(dealt: DataFrame, score: Callable[[np.ndarray], np.ndarray], rank: int, low: float, high: float) -> float:
    """The score of a rank among all learning rows: the bin that holds it is taken apart until it can be sorted."""
    while True:
        edges = np.unique(np.linspace(low, high, BINS + 1))
        if len(edges) == 1:
            return low

        def counts(r: Rows, edges=edges) -> np.ndarray:
            at = np.searchsorted(edges, score(r.x[r.own]), side="right")  # 0: below; the last edge is counted apart
            return np.bincount(at, minlength=len(edges) + 1).astype(float)

        n = _total(dealt, counts)
        before = np.cumsum(n)
        k = int(np.searchsorted(before, rank, side="right"))
        if k >= len(edges):
            return float(edges[-1])
        low, last = edges[k - 1], edges[k]
        if n[k] <= SORTED:
            inside = _total(dealt, lambda r: (z := score(r.x[r.own]))[(z >= low) & (z < last)], lambda a, b: np.concatenate([a, b]))
            return float(np.sort(inside)[rank - int(before[k - 1])])
        high = np.nextafter(last, low)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    low: np.ndarray
    high: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Features count up to what the learning rows reached: the fit says nothing beyond."""
        z = ((np.clip(x, self.low, self.high) - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, penalty: float = 1e-3, held_back: float = 0.03, steps: int = 25) -> Model:
    """The model learnt from all labelled rows that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    marked = few_broadcast(usable.groupBy("doc_id").agg(F.max("quality").alias("label")).select(F.col("doc_id").alias("__id"), "label"), BROADCAST)

    @F.pandas_udf("binary")
    def featured(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(t).astype("<f4").tobytes())

    learn = durable(docs.select("doc_id", "text").join(marked, F.col("doc_id") == F.col("__id")).select("doc_id", "label", featured("text").alias("x")))
    n = {0: 0, 1: 0} | {r.label: r["n"] for r in learn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n[0] or not n[1]:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, np.zeros(WIDTH), np.zeros(WIDTH))
    dealt, every = _deal(learn, n), n[0] + n[1]
    low, high = (_total(dealt, lambda r: np.concatenate([r.x.min(axis=0), -r.x.max(axis=0)]).astype(float), np.minimum) * np.repeat([1, -1], WIDTH)).reshape(2, -1)
    mean = _total(dealt, lambda r: r.x[r.own].sum(axis=0, dtype=np.float64)) / every
    scale = np.sqrt(_total(dealt, lambda r: ((r.x[r.own] - mean) ** 2).sum(axis=0)) / every)
    scale = np.where(scale > 1e-9, scale, 1.0)
    upper = np.triu_indices(WIDTH)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        got = _total(dealt, lambda r: compared(r, w, scale))
        curve = np.zeros((WIDTH, WIDTH))
        curve[upper] = got[1 + WIDTH :]
        return got[0], got[1 : 1 + WIDTH], curve + np.triu(curve, 1).T

    w = _newton(sums, np.repeat([penalty, held_back], [SHAPES, WIDTH - SHAPES]), steps)
    threshold = _split(dealt, lambda x: ((x - mean) / scale) @ w, n[0])
    return Model(mean, scale, w, threshold, low, high)


def scored(model: Model, text: Column) -> Column:
    """The score of ``text`` as a column."""

    @F.pandas_udf("double")
    def of(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([features(x) for x in t])) if len(t) else [], dtype="float64")

    return of(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
