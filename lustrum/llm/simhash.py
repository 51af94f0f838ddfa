"""SimHash near-dedup over anchor points of a covering code.

Fingerprints of 64 bits link when they differ in at most 4.  The word is laid out as
three blocks, and the anchors of a block are the words of a covering code.  Two linked
fingerprints differ in at most 2 bits over some two blocks, so some word between them
is at most 1 bit from each: replicating every fingerprint to the anchors of all words
within 1 bit of it, for each two blocks, puts the two under one anchor (radius plus the
threshold's share on both sides, so an anchor holds all pairs within radius plus
threshold of it).  That holds for any code; which one is taken follows the number of
distinct fingerprints, so that an anchor's share doesn't grow with the table: the Golay
code (radius 3, about 11 of 16.8 million anchors for each two blocks), a shortened
Hamming code (radius 1, about 29 of 2^34 and more), or all words (radius 0, 43 to 45 of
2^42 and more).

Only distinct fingerprints are replicated: copies share one.  Anchors that hold many are
split into pairs of chunks, each compared in a task of bounded memory, and every comparison returns a spanning forest
of its links instead of all of them.  Components then join up over the anchors.

Texts of similar shingle sets (similarity 0.8, as a stage has to find) differ in some 10 of
64 bits, beyond any single fingerprint's anchors.  ``candidates`` therefore gives each set
several independent fingerprints and replicates each to its anchors as above: two sets of
similarity 0.8 meet under the anchors of one fingerprint in 47 of 100 cases, so under those
of 12 in 99.9 %.  Sets that meet are candidates if they differ in at most 27 of 97 other bits,
which travel with the replicas; an exact comparison has to follow.

Defined results: words are separated by the bytes 20 and 09-0D; a text of fewer words
than a shingle has one shingle, its whole word sequence; a null text or one without
words has fingerprint zero, which links like any other; rows with a null doc_id are
linked but lend no id (component_id is null if no row of the component has one); an
empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import connected_components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: first bit and width of each block
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: fingerprints an anchor may hold before it is split into pairs of chunks
CHUNK = 2048
#: split anchors that are broadcast at most (12 bytes each)
BROADCAST = 100_000
#: distinct fingerprints up to which the Golay and the Hamming code are taken: about 64 an anchor
GOLAY_MOST, HAMMING_MOST = 10**8, 3 * 10**10
_POLY = 0b101011100011  # fixed value: generator of the Golay code, x^11+x^9+x^7+x^6+x^5+x+1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, len(words) - shingle + 1)
    one = xxhash.xxh64_intdigest
    h = [one(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[-m:].tolist(), strict=True)]
    h = np.array(h, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, m, 65_280):
        bits = np.unpackbits(h[k : k + 65_280].view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > m).view(np.uint64)[0])


_FACTORS, _TERMS = (np.random.default_rng(11).integers(0, 2**63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def many_fingerprints(h: np.ndarray, n: int) -> np.ndarray:
    """``n`` independent fingerprints (uint64) of the shingles with digests ``h``: each mixes the digests in its own way."""
    ones = np.zeros(n * 64, np.int64)
    for k in range(0, len(h), 255):
        x = (h[k : k + 255, None] ^ _TERMS[:n]) * _FACTORS[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h)).view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), fp (the fingerprint as a signed long)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(of, "doc_id long, th long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    r = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ np.uint32(_POLY << (bit - 11)), r)
    return r


@functools.cache
def _nearest() -> np.ndarray:
    """For each remainder, the error of at most 3 bits that leaves it."""
    errors = np.array([0] + [sum(1 << b for b in c) for k in (1, 2, 3) for c in combinations(range(23), k)], dtype=np.uint32)
    table = np.zeros(2048, np.uint32)
    table[_syndrome(errors)] = errors
    return table


def _golay(words: np.ndarray) -> np.ndarray:
    """The 12 bits that name the word of the Golay code nearest to each word of up to 23 bits."""
    return (words.astype(np.uint32) ^ _nearest()[_syndrome(words)]) >> np.uint32(11)


@functools.cache
def _flips() -> tuple[np.ndarray, np.ndarray]:
    """Of the Hamming code of 31 bits, each bit's remainder, and for each remainder the bit that leaves it.

    The five bits that check the others come first, so that a word's other bits name it.
    """
    columns = np.array(sorted(range(1, 32), key=lambda c: (c.bit_count() > 1, c)), np.uint32)
    errors = np.zeros(32, np.uint32)
    errors[columns] = np.uint32(1) << np.arange(31, dtype=np.uint32)
    return columns, errors


def _hamming(words: np.ndarray) -> np.ndarray:
    """The 26 bits that name the word of the Hamming code nearest to each word of up to 31 bits."""
    columns, errors = _flips()
    words, r = words.astype(np.uint32), np.zeros(words.shape, np.uint32)
    for bit, column in enumerate(columns):
        r ^= np.where(words >> np.uint32(bit) & np.uint32(1), column, np.uint32(0))
    return (words ^ errors[r]) >> np.uint32(5)


@dataclass(frozen=True)
class Code:
    """A covering code of a block's words: the name of the nearest anchor, and how many bits a name has."""

    name: Callable[[np.ndarray], np.ndarray]
    bits: int


CODES = (Code(_golay, 12), Code(_hamming, 26), Code(lambda words: words.astype(np.uint32), 22))


def code_for(n: int) -> Code:
    """The code whose anchors hold few of ``n`` distinct fingerprints."""
    return CODES[(n > GOLAY_MOST) + (n > HAMMING_MOST)]


def anchors(fp: np.ndarray, code: Code = CODES[0]) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each replica of the fingerprints ``fp`` (uint64)."""
    own, near = [], []
    for first, width in BLOCKS:
        word = (fp >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.uint32)
        own.append(code.name(word))
        near.append(np.stack([code.name(word ^ np.uint32(1 << b)) for b in range(width)], axis=1))
    out = []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a = own[i][:, None].astype(np.int64) << code.bits
        key = np.concatenate([a | own[j][:, None], near[i].astype(np.int64) << code.bits | own[j][:, None], a | near[j]], axis=1)
        key = np.sort(key | (k << 2 * code.bits), axis=1)
        fresh = np.ones(key.shape, bool)
        fresh[:, 1:] = key[:, 1:] != key[:, :-1]
        row = np.nonzero(fresh)[0]
        out.append((row, key[fresh]))
    return np.concatenate([r for r, _ in out]), np.concatenate([a for _, a in out])


def _replicas(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(fp), 4096):
            row, anchor = anchors(fp[k : k + 4096], code)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[k : k + 4096][row].view(np.int64))], names=["anchor", "fp"])


def _group(at: list[np.ndarray]) -> np.ndarray:
    """The number of the group of each of some sorted rows."""
    changes = np.zeros(len(at[0]), bool)
    for c in at:
        changes[1:] |= c[1:] != c[:-1]
    return np.cumsum(changes)


class _Forest:
    """Union by smallest index, over whole arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.up[i], self.up[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(short := self.up[self.up], self.up):
                self.up = short


def _links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within groups of sorted rows, as pairs of fingerprints.

    side 1 and 2 are the two chunks of a split anchor, compared with each other only.
    """
    n, forest = len(fp), _Forest(len(fp))
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes))  # rows from here to the group's end
    small = np.repeat(sizes, sizes) <= 64
    at = np.flatnonzero(small & (left > 1))
    d = 1
    while len(at):
        near = np.bitwise_count(fp[at] ^ fp[at + d]) <= threshold
        mixed = (side[at] == 0) | (side[at] != side[at + d])
        forest.link(at[near & mixed], at[near & mixed] + d)
        d += 1
        at = at[left[at] > d]
    for s, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        rows = np.arange(s, s + size)
        ones, twos = (rows, rows) if not side[rows].any() else (rows[side[rows] == 1], rows[side[rows] == 2])
        for k in range(0, len(ones), 256):
            part = ones[k : k + 256]
            i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[twos][None, :]) <= threshold)
            forest.link(part[i], twos[j])
    child = np.flatnonzero(forest.up != np.arange(n))
    return fp[child], fp[forest.up[child]]


def links(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all links of ``classes.fp`` do."""
    code = code_for(classes.count())
    every = classes.select("fp").mapInArrow(lambda batches: _replicas(batches, code), "anchor long, fp long")
    full = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    full = durable(full.select(F.col("anchor").alias("full"), F.ceil(F.col("n") / CHUNK).cast("int").alias("n_chunks")))
    met = every.join(F.broadcast(full) if full.count() <= BROADCAST else full, every["anchor"] == F.col("full"), "left")
    met = met.select("anchor", "fp", F.coalesce("n_chunks", F.lit(1)).alias("chunks"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = met.select("anchor", "fp", "own", other.alias("other")).select(
        "anchor",
        F.least("own", "other").alias("c1"),
        F.greatest("own", "other").alias("c2"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
        "fp",
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            group = _group(cols[:3])
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            held = [c[cut:] for c in cols]
            if cut:
                a, b = _links(group[:cut], cols[3][:cut], cols[4][:cut].view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        if held and len(held[0]):
            a, b = _links(_group(held[:3]), held[3], held[4].view(np.uint64), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    at = ["anchor", "c1", "c2"]
    return dealt.repartition(*at).sortWithinPartitions(*at).mapInArrow(compared, "a long, b long")


#: fingerprints whose anchors a set goes to: sets of few shingles, whose bits hang on single ones, have more
WORDS, WORDS_OF_FEW, FEW = 12, 24, 20
#: other bits of a set that travel with its replicas (33 and 64 of two more fingerprints), and how many of candidates differ at most
LOW, APART = 33, 27


def words_of(own: np.ndarray) -> np.ndarray:
    """The fingerprints (uint64) of a set of digests: two that travel, then those that lead to anchors."""
    return many_fingerprints(own, 2 + (WORDS_OF_FEW if len(own) <= FEW else WORDS))


def _code(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """One signed long for the bits that travel."""
    return (fp ^ (key & np.uint64((1 << LOW) - 1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def code_of(words: np.ndarray) -> int:
    return int(_code(words[:1], words[1:2])[0])


def _wide_replicas(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[pa.RecordBatch]:
    """(key, fp): the number of the fingerprint, the anchor and the low bits in one long, the other bits."""
    for batch in batches:
        size = batch.column(0).value_lengths().to_numpy()
        flat = batch.column(0).flatten().to_numpy().view(np.uint64)
        starts = np.cumsum(size) - size
        for n in np.unique(size):
            words = flat[starts[size == n][:, None] + np.arange(n)]
            low = words[:, 0] & np.uint64((1 << LOW) - 1)
            for i in range(0, len(words), 4096):
                for k in range(2, n):
                    row, anchor = anchors(words[i : i + 4096, k], code)
                    name = (anchor | (k - 2) << 26).astype(np.uint64) << np.uint64(LOW)
                    key, fp = name | low[i : i + 4096][row], words[i : i + 4096, 1][row]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])


def _wide_links(group: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates within groups of sorted rows, as pairs of row numbers.

    Rows of a group share the upper bits of their keys.  Of large groups, each row meets
    only those that no row met before, so that copies by the thousand stay cheap.
    """
    n, forest = len(key), _Forest(len(key))
    if not n:
        return forest.up, forest.up
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes))
    at, d = np.flatnonzero((np.repeat(sizes, sizes) <= 64) & (left > 1)), 1
    while len(at):
        near = at[np.bitwise_count(key[at] ^ key[at + d]) + np.bitwise_count(fp[at] ^ fp[at + d]) <= APART]
        forest.link(near, near + d)
        d += 1
        at = at[left[at] > d]
    for s, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        unseen = np.arange(s, s + size)
        while len(unseen) > 1:
            front, unseen = unseen[:1], unseen[1:]
            while len(front) and len(unseen):
                k = max(1, (1 << 20) // len(unseen))
                some, front = front[:k], front[k:]
                met = (np.bitwise_count(key[some][:, None] ^ key[unseen]) + np.bitwise_count(fp[some][:, None] ^ fp[unseen]) <= APART).any(axis=0)
                forest.link(np.full(int(met.sum()), some[0]), unseen[met])
                front, unseen = np.concatenate([front, unseen[met]]), unseen[~met]
    child = np.flatnonzero(forest.up != np.arange(n))
    return child, forest.up[child]


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of codes that connect the same sets as all pairs of candidates do; ``sets.words`` as by ``words_of``.

    Finer codes aren't needed: replicas are told apart by the bits that travel, and an
    anchor of 16.8 million holds few sets that aren't alike.
    """
    every = sets.select("words").mapInArrow(lambda batches: _wide_replicas(batches, CODES[0]), "key long, fp long")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's links as one forest under smallest codes, so that tasks that see the same sets say the same."""
        met = np.empty(0, np.int64), np.empty(0, np.int64)
        held = np.empty(0, np.uint64), np.empty(0, np.uint64)

        def linked(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = _wide_links(key >> np.uint64(LOW), key, fp)
            code = _code(key, fp)
            names, at = np.unique(np.concatenate([met[0], code[a], met[1], code[b]]), return_inverse=True)
            forest = _Forest(len(names))
            forest.link(*np.split(at, 2))
            child = np.flatnonzero(forest.up != np.arange(len(names)))
            return names[child], names[forest.up[child]]

        for batch in batches:
            key, fp = (np.concatenate([h, batch.column(k).to_numpy().view(np.uint64)]) for k, h in enumerate(held))
            before = np.flatnonzero(key >> np.uint64(LOW) != key[-1:] >> np.uint64(LOW))  # rows of groups that have ended
            cut = int(before[-1]) + 1 if len(before) else 0
            held = key[cut:], fp[cut:]
            if cut:
                met = linked(key[:cut], fp[:cut])
        met = linked(*held)
        for k in range(0, len(met[0]), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(met[0][k : k + 65_536]), pa.array(met[1][k : k + 65_536])], names=["a", "b"])

    return every.repartition(F.shiftright("key", LOW)).sortWithinPartitions("key").mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, th (hash of the text), fp, component_id (smallest doc_id reachable over links)."""
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors cover links of at most {THRESHOLD} bits")
    own = durable(fingerprints(docs, shingle))
    classes = durable(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(classes, threshold))
    labelled = durable(classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    lowest = durable(labelled.groupBy("root").agg(F.min("least").alias("component_id")))  # kept, so that the join's sides can be split
    named = labelled.join(lowest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return own.join(named, own["fp"] == F.col("__fp")).select("doc_id", "th", "fp", "component_id")
