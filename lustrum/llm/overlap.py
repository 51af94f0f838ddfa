"""Near copies by shared word shingles: SimHash anchors propose, exact Jaccard similarity decides.

A text is the set of its runs of five words, as 64-bit digests.  Texts with the same set
are one class.  Classes whose fingerprints meet under an anchor of the covering code are
candidates (``simhash.candidates``; of pairs with similarity 0.8, 99.9 % are).
Within each component of candidates the sets themselves are compared, and
classes link whose similarity is 0.8 or more.  Components that hold many classes are
split into pairs of chunks, each compared in a task of bounded memory, which returns a
spanning forest of its links.

Defined results: words are separated by the bytes 20 and 09-0D, and A-Z are lower-cased;
a text of fewer words than a shingle has one shingle, its whole word sequence; a null text
is like one without words; rows with a null doc_id are linked but lend no id (component_id
is null if no row of the component has one); an empty table gives no rows; extra columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, few_broadcast
from .components import connected_components
from .simhash import SEED, _Forest, candidates, code_of, words_of

SHINGLE, ALIKE = 5, 0.8
#: classes of a component of candidates that are compared in one task
CHUNK = 512
#: classes that are broadcast at most (24 bytes each)
BROADCAST = 200_000

def shingles(text: str | None) -> np.ndarray:
    """The sorted digests (uint64) of a text's distinct shingles; at least one."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    one = xxhash.xxh64_intdigest
    h = [one(joined[a:b], SEED) for a, b in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    return np.unique(np.array(h, dtype=np.uint64))


def _set_digest(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(2)]
        digests = pa.array(np.array([_set_digest(s) for s in sets], np.uint64).view(np.int64))
        words = [words_of(s) for s in sets]
        codes = pa.array([code_of(w) for w in words], pa.int64())
        words = pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), digests, codes, words], names=["doc_id", "th", "sh", "code", "words"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of picked texts; of copies in one task, the first."""
    met: set[int] = set()
    for batch in batches:
        group, own, text = (batch.column(k) for k in range(3))
        fresh = []
        for k, sh in enumerate(own.to_pylist()):
            if sh not in met:
                met.add(sh)
                fresh.append(k)
        for k in range(0, len(fresh), 256):
            at = pa.array(fresh[k : k + 256], pa.int64())
            sets = pa.array([shingles(t.as_py()).view(np.int64) for t in text.take(at)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([group.take(at), own.take(at), sets], names=["grp", "sh", "own"])


def alike_links(names: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (similarity of ALIKE or more) among the sets, as pairs of names."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    names, sets = names[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    starts = ends - size
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    last = np.searchsorted(size, np.floor(size / ALIKE + 1e-9), side="right")  # sets beyond are too large to be alike
    forest, mark = _Forest(len(sets)), np.zeros(len(vocabulary), bool)
    for i in range(len(sets)):
        if last[i] <= i + 1 or (forest.up[i + 1 : last[i]] == forest.up[i]).all():
            continue
        mark[flat[starts[i] : ends[i]]] = True
        shared = np.add.reduceat(mark[flat[starts[i + 1] : ends[last[i] - 1]]], starts[i + 1 : last[i]] - starts[i + 1], dtype=np.int64)
        mark[flat[starts[i] : ends[i]]] = False
        j = i + 1 + np.flatnonzero(shared * 10 >= (size[i] + size[i + 1 : last[i]] - shared) * 8)  # in whole numbers, so that 0.8 itself links
        forest.link(np.full(len(j), i), j)
    child = np.flatnonzero(forest.up != np.arange(len(sets)))
    return names[child], names[forest.up[child]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups of sorted rows (grp, c1, c2, sh, own)."""

    def settled(names: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        a, b = alike_links(np.array(names, np.int64), sets)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    at, names, sets = None, [], []
    for batch in batches:
        groups = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
        for k, (grp, c1, c2, sh) in enumerate(groups):
            if (grp, c1, c2) != at:
                if len(names) > 1:
                    yield settled(names, sets)
                at, names, sets = (grp, c1, c2), [], []
            if not names or names[-1] != sh:  # copies from several tasks follow each other
                names.append(sh)
                sets.append(batch.column(4)[k].values.to_numpy())
    if len(names) > 1:
        yield settled(names, sets)


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same classes as all pairs of similarity ALIKE do.

    classes: sh, th (the hash of one of its texts), code and words (of its fingerprints).
    """
    found = connected_components(candidates(classes))
    twins = classes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("code").alias("node"), F.col("code").alias("root"))
    nodes = found.select("node", "root").unionByName(found.select(F.col("root").alias("node"), "root")).unionByName(twins)
    member = durable(nodes.groupBy("node").agg(F.min("root").alias("root")))
    picked = durable(classes.select("sh", "th", "code").join(member, F.col("code") == F.col("node")).select("th", "sh", F.col("root").alias("grp")))
    chunks = picked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("n_chunks"))
    many = few_broadcast(chunks.where("n_chunks > 1").withColumnRenamed("grp", "__grp"), BROADCAST)

    texts = docs.select(F.xxhash64("text").alias("__th"), "text")
    held = texts.join(few_broadcast(picked, BROADCAST), F.col("__th") == F.col("th")).select("grp", "sh", "text")
    sets = held.mapInArrow(_sets, "grp long, sh long, own array<long>")
    met = sets.join(many, sets["grp"] == F.col("__grp"), "left").select("grp", "sh", "own", F.coalesce("n_chunks", F.lit(1)).alias("chunks"))
    met = met.withColumn("__c", F.pmod(F.xxhash64("sh"), F.col("chunks")).cast("int"))
    # a chunk meets each other one; what stands within it is compared along with them
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("__c")))
    dealt = met.withColumn("__o", F.explode(other)).select("grp", F.least("__c", "__o").alias("c1"), F.greatest("__c", "__o").alias("c2"), "sh", "own")
    at = ["grp", "c1", "c2"]
    return dealt.repartition(*at).sortWithinPartitions(*at, "sh").mapInArrow(_compared, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), component_id (smallest doc_id reachable over links)."""
    own = durable(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_classified, "doc_id long, th long, sh long, code long, words array<long>"))
    classes = durable(own.groupBy("sh").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.min("code").alias("code"), F.min("words").alias("words")))
    found = connected_components(links(docs, classes))
    labelled = durable(classes.join(found.select("node", "root"), F.col("sh") == F.col("node"), "left").select("sh", F.coalesce("root", "sh").alias("root"), "least"))
    lowest = durable(labelled.groupBy("root").agg(F.min("least").alias("component_id")))  # kept, so that the join's sides can be split
    named = labelled.join(lowest, "root").select(F.col("sh").alias("__sh"), "component_id")
    return own.join(named, own["sh"] == F.col("__sh")).select("doc_id", "th", "component_id")
