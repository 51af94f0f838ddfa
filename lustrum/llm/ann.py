"""Approximate nearest neighbours: inverted lists, scanned dimension by dimension.

Vectors get one more coordinate that makes them equally long, so that the largest inner
product is the least distance, and are rotated at random, so that every share of the
coordinates tells as much about a distance as any other.  They are dealt to the lists of
centroids (fit on a bounded sample; every row is indexed).  A query first scans its
nearest lists, which gives a k-th best score, then probes further lists with that bound:
candidates are read in blocks of columns, and after each block a hypothesis test abandons
those whose partial distance, scaled up to all coordinates, exceeds the bound by more than
its error allows.  What survives is scored exactly, in double precision, on the original
vectors.

How many lists are probed is measured, not guessed: for a bounded number of queries the
true neighbours are found among all rows, and as many lists are probed as hold the aimed-at
share of them.  Data without clusters need many.

Lists of any size are split: a list is dealt into chunks of vectors and chunks of
queries, and each pair of chunks is a task of bounded memory.  The driver holds the
centroids, the lists' sizes and the measured queries' neighbours only.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither as query nor as candidate, nor do those whose length
differs from the most frequent one; rows with the query's own id aren't candidates;
repeated rows are candidates each, and one query (that with the least vector); ties go to
the smaller id; fewer candidates than k are all returned; an empty table gives no rows;
extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: rows that centroids are fit on at most; lists at most; vectors and queries a task at most (on average)
SAMPLE, LISTS, CHUNK, QUERIES = 20_000, 4096, 4096, 1024
#: queries whose true neighbours are found to set the probes, and the share of them to be in probed lists
MEASURED, AIM = 128, 0.97
#: columns read between tests, and how many standard errors a test allows
BLOCK, EPSILON = 16, 1.7
_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    longest: float
    rotation: np.ndarray
    centroids: np.ndarray

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Rotated vectors, made equally long."""
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]]) @ self.rotation

    def turned_queries(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))]) @ self.rotation

    def near(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less the vectors' own lengths."""
        return (self.centroids**2).sum(axis=1)[None, :] - 2 * (x @ self.centroids.T)

    def order(self, q: np.ndarray) -> np.ndarray:
        """The lists, nearest first, of each query."""
        return np.argsort(self.near(self.turned_queries(q)), axis=1, kind="stable")


def usable(table: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (most[0] if most else 0))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 1))


def fit(rows: DataFrame, n: int, sample: int = SAMPLE, most_lists: int = LISTS) -> Index:
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    got = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"])
    rng = np.random.default_rng(11)
    turn = np.linalg.qr(rng.normal(size=(got.shape[1] + 1,) * 2))[0]
    index = Index(float(np.sqrt(longest)), turn, np.zeros((1, got.shape[1] + 1)))
    x = index.turned(got)
    k = int(min(most_lists, max(1, round(np.sqrt(n))), len(x)))
    centers = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(8):
        index = Index(index.longest, turn, centers)
        own = index.near(x).argmin(axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centers)
    return Index(index.longest, turn, centers)


def exact_scores(x: np.ndarray, vi: np.ndarray, q: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """Inner products of the pairs x[vi], q[qi], each summed the same way wherever it stands."""
    step = max(1, 4_000_000 // x.shape[1])  # pairs at a time, for bounded memory
    parts = [(x[vi[a : a + step]] * q[qi[a : a + step]]).sum(axis=1) for a in range(0, len(vi), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def measured_probes(dealt: DataFrame, queries: DataFrame, index: Index, k: int, aim: float = AIM) -> int:
    """How many lists hold the aimed-at share of the true neighbours of some queries."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).toPandas()
    if not len(asked):
        return 1
    q, ids = _matrix(asked["v"]), asked["vec_id"].to_numpy()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = q @ _matrix(batch["v"]).T
            s[ids[:, None] == batch["vec_id"].to_numpy()[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(q)), top.shape[1])
            yield pd.DataFrame({"at": at, "list": batch["list"].to_numpy()[top.ravel()], "score": s[at, top.ravel()]})

    near = Window.partitionBy("at").orderBy(F.desc("score"), "list")
    met = dealt.select("vec_id", "v", "list").mapInPandas(best, "at int, list int, score double")
    true = met.where(F.col("score") > float("-inf")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).toPandas()
    place = np.argsort(index.order(q), axis=1)  # of each list in each query's order
    needed = np.sort(place[true["at"], true["list"]]) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) if len(needed) else 1


def _cell(index: Index, k: int, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a chunk of vectors for a chunk of queries that beat their bounds."""
    if not len(vectors) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    ids, x, q_ids, q = vectors["vec_id"].to_numpy(), _matrix(vectors["v"]), queries["vec_id"].to_numpy(), _matrix(queries["v"])
    least = queries["least"].to_numpy(np.float64)  # the k-th best score so far; nan: none yet
    out = []
    for a in range(0, len(q), 256):
        part = slice(a, a + 256)
        qi, vi = _survivors(index, x, q[part], ids, q_ids[part], least[part])
        scores = exact_scores(x, vi, q[part], qi)
        order = np.lexsort((ids[vi], -scores, qi))
        qi, vi, scores = qi[order], vi[order], scores[order]
        starts = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1]))) if len(qi) else np.zeros(0, int)
        rank = np.arange(len(qi)) - np.repeat(starts, np.diff(np.append(starts, len(qi))))
        keep = rank < k
        out.append((q_ids[part][qi[keep]], ids[vi[keep]], scores[keep]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _survivors(index: Index, x: np.ndarray, q: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no test abandons; all of a query's without a bound."""
    xt, qt = index.turned(x), index.turned_queries(q)
    bound = np.where(np.isnan(least), np.inf, (q * q).sum(axis=1) + index.longest**2 - 2 * least)
    alive = q_ids[:, None] != ids[None, :]
    dims = xt.shape[1]
    partial = np.zeros(alive.shape)
    pairs = None
    for a in range(0, dims, BLOCK):
        b = min(dims, a + BLOCK)
        allowed = bound * ((1 + EPSILON / np.sqrt(b)) ** 2 if b < dims else 1 + 1e-9) * (b / dims) + 1e-9
        if pairs is None:
            xb, qb = xt[:, a:b], qt[:, a:b]
            partial += (qb * qb).sum(axis=1)[:, None] + (xb * xb).sum(axis=1)[None, :] - 2 * (qb @ xb.T)
            alive &= partial <= allowed[:, None]
            if np.count_nonzero(alive) < 0.2 * alive.size:  # few are left: go on pair by pair
                pairs = np.nonzero(alive)
                partial = partial[pairs]
        else:
            diff = qt[pairs[0], a:b] - xt[pairs[1], a:b]
            partial = partial + np.einsum("ij,ij->i", diff, diff)
            keep = partial <= allowed[pairs[0]]
            pairs, partial = (pairs[0][keep], pairs[1][keep]), partial[keep]
    return np.nonzero(alive) if pairs is None else pairs


def _scan(index: Index, k: int, dealt: DataFrame, asked: DataFrame, sizes: np.ndarray) -> DataFrame:
    """The k best candidates of each query (vec_id, v, list, least) in its lists."""
    asked = durable(asked)
    wanted = np.zeros(len(sizes), np.int64)
    for r in asked.groupBy("list").count().collect():  # a row a list
        wanted[r[0]] = r[1]
    v_chunks = F.array(*[F.lit(int(x)) for x in np.maximum(1, -(-sizes // CHUNK))])
    q_chunks = F.array(*[F.lit(int(x)) for x in np.maximum(1, -(-wanted // QUERIES))])

    def own_chunk(chunks: Column) -> Column:  # vectors are dealt by id and value, so that rows that share an id part
        return F.pmod(F.xxhash64("vec_id", "v"), F.get(chunks, F.col("list"))).cast("int")

    def all_chunks(chunks: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), F.get(chunks, F.col("list")) - 1))

    cells = ["list", "vc", "qc"]
    used = F.get(F.array(*[F.lit(bool(w)) for w in wanted]), F.col("list"))
    left = dealt.where(used).withColumn("vc", own_chunk(v_chunks)).withColumn("qc", all_chunks(q_chunks))
    right = asked.withColumn("qc", own_chunk(q_chunks)).withColumn("vc", all_chunks(v_chunks))
    met = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(lambda v, q: _cell(index, k, v, q), _FOUND)
    return _top(met, k).drop("rank")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; Spark limits the groups before and after the shuffle."""
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, every: int = 20, k: int = 20, probes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose id ``every`` divides.

    ``probes`` lists are probed a query, at least as many as hold k candidates; by default
    their number is measured.
    """
    rows = durable(usable(table))
    n = rows.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], _FOUND).withColumn("rank", F.lit(0)).select("query_id", "rank", "vec_id", "score")
    index = fit(rows, n)

    @F.pandas_udf("int")
    def own_list(v: pd.Series) -> pd.Series:
        return pd.Series(index.near(index.turned(_matrix(v))).argmin(axis=1), dtype="int32")

    dealt = durable(rows.select("vec_id", "v", own_list("v").alias("list")))
    queries = durable(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    probes = measured_probes(dealt, queries, index, k) if probes is None else probes
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in dealt.groupBy("list").count().collect():  # a row a list
        sizes[r[0]] = r[1]

    @F.pandas_udf("first array<int>, rest array<int>")
    def probed(v: pd.Series) -> pd.DataFrame:
        order = index.order(_matrix(v)).astype("int32")
        held = np.cumsum(sizes[order], axis=1)
        # the nearest lists that hold k candidates beside the query itself come first
        enough = np.where(held[:, -1] > k, (held > k).argmax(axis=1) + 1, order.shape[1])
        return pd.DataFrame({"first": [o[:e] for o, e in zip(order, enough, strict=True)], "rest": [o[e : max(probes, e)] for o, e in zip(order, enough, strict=True)]})

    asked = durable(queries.select("vec_id", "v", probed("v").alias("p")).select("vec_id", "v", "p.first", "p.rest"))
    none = F.lit(None).cast("double")
    first = durable(_scan(index, k, dealt, asked.select("vec_id", "v", F.explode("first").alias("list"), none.alias("least")), sizes))
    least = first.groupBy(F.col("query_id").alias("__q")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    more = asked.join(least, asked["vec_id"] == F.col("__q"), "left").select("vec_id", "v", F.explode("rest").alias("list"), "least")
    return _top(first.unionByName(_scan(index, k, dealt, more, sizes)), k)
