"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids (little-endian, 2 or 4 bytes), each document's followed
by the end-of-document id.  It is read in parts, cut anywhere between two ids, and these
in blocks; in each block the separators are found by one vectorised comparison.  A block
then says how many separators it has, how many ids lie before its first and after its
last, and which whole documents lie between; a prefix scan over the blocks of a file
adds the separators before a block (the ordinal of its first document) and the ids that
earlier blocks left open.

Files are read whole by Spark (any store, up to 2 GB a file) or by ranges of bytes (any
size, one task a range), or come from a table that holds their parts.  ``flat`` writes
such a table; which document is which of a file's is told by rows of its own, which the
scan doesn't read.

Defined results: a null or empty text has 0 tokens; ids after a file's last separator
are a document of their own (``open`` is true), none is reported for a file that ends
with a separator or is empty; a part that isn't a whole number of ids, and a vocabulary
with ids that the width can't hold, fail; repeated rows are documents each; an empty
table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, fresh_path, remove
from .tokens import default_path, encoder

#: end of a document, bytes an id, ids a block, ids of a flat file before a new one begins, bytes of its parts
END, WIDTH, BLOCK, SEGMENT, PART = 50256, 2, 1 << 18, 1 << 22, 1 << 22


def width_of(tokenizer: str | None = None, end: int = END) -> int:
    """The bytes that every id of a vocabulary and the end id fit in."""
    return 2 if max(encoder(tokenizer or default_path()).largest, end) < 1 << 16 else 4


def flat(docs: DataFrame, tokenizer: str | None = None, end: int = END, width: int = WIDTH, segment: int = SEGMENT, part: int = PART) -> DataFrame:
    """file, part, ids: flat files in parts of ``part`` bytes; and rows (file, doc_ids) on whose documents they hold, in order.

    ``file`` numbers the files by partition; the end id in a text's own ids (the text
    spells the special token out) is written as the ids of its letters.
    """
    path = tokenizer or default_path()
    if width_of(path, end) > width:
        raise ValueError(f"ids of {path} don't fit in {width} bytes")
    kind = np.dtype(f"<u{width}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, k = encoder(path), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            name, raw = f"{task:06d}-{k:06d}", np.concatenate(held).tobytes()
            for at, start in enumerate(range(0, len(raw), part)):
                yield row(name, at, None, raw[start : start + part])
            yield row(name, None, ids, None)

        def row(name: str, at: int | None, owners: list | None, raw: bytes | None) -> pa.RecordBatch:
            cols = [pa.array([name]), pa.array([at], pa.int64()), pa.array([owners], pa.list_(pa.int64())), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["file", "part", "doc_ids", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = enc.plain_ids(text.as_py() or "").astype(kind)
                ids.append(doc_id)
                held += [own, np.array([end], kind)]
                size += len(own) + 1
                if size >= segment:
                    yield from out()
                    ids, held, size, k = [], [], 0, k + 1
        if ids:
            yield from out()

    return docs.select("doc_id", "text").mapInArrow(of, "file string, part long, doc_ids array<long>, ids binary")


def blocks(files: DataFrame, end: int = END, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row a block of ``files`` (file, part, ids): its separators, head, tail and inner documents."""
    kind = np.dtype(f"<u{width}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at_part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = raw.as_buffer() if raw.is_valid else b""
                if len(data) % width:
                    raise ValueError(f"part {at_part} of {name} has {len(data)} bytes, no whole number of ids of {width} bytes")
                every = np.frombuffer(data, kind)
                rows = []
                for b, a in enumerate(range(0, len(every), block)):
                    some = every[a : a + block]
                    at = np.flatnonzero(some == end)
                    head, tail = (int(at[0]), len(some) - int(at[-1]) - 1) if len(at) else (len(some), len(some))
                    rows.append((name, at_part, b, len(at), head, tail, (np.diff(at) - 1).tolist()))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                types = (pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "part", "block", "ends", "head", "tail", "inner"])

    return files.select("file", "part", "ids").mapInArrow(of, "file string, part long, block long, ends long, head long, tail long, inner array<long>")


def scan(files: DataFrame, end: int = END, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, ordinal (from 0), n_tokens, open of every document in ``files`` (file, part, ids)."""
    found = durable(blocks(files, end, width, block))
    before = Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, 0)
    # blocks after the same separator form a run; the ids left open are summed within it
    run = F.coalesce(F.sum("ends").over(before), F.lit(0))
    edges = found.select("file", "part", "block", "ends", "head", "tail").withColumn("first", run).withColumn("last", F.sum("ends").over(to_here))
    carried = Window.partitionBy("file", "last").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, 0)
    # of a run, the block that holds its separator gives its tail, the blocks without one their whole length
    edges = edges.withColumn("open_ids", F.sum("tail").over(carried))
    left = Window.partitionBy("file").orderBy("part", "block")
    edges = edges.withColumn("carry", F.coalesce(F.lag("open_ids").over(left), F.lit(0)))
    first = edges.where("ends > 0").select("file", F.col("first").alias("ordinal"), (F.col("carry") + F.col("head")).alias("n_tokens"), F.lit(False).alias("open"))
    inner = found.where(F.size("inner") > 0).join(edges.select("file", "part", "block", "first"), ["file", "part", "block"])
    inner = inner.select("file", "first", F.posexplode("inner").alias("at", "n_tokens")).select("file", (F.col("first") + F.col("at") + 1).alias("ordinal"), "n_tokens", F.lit(False).alias("open"))
    end_of_file = edges.groupBy("file").agg(F.max_by(F.struct("last", "open_ids"), F.struct("part", "block")).alias("x")).where("x.open_ids > 0")
    rest = end_of_file.select("file", F.col("x.last").alias("ordinal"), F.col("x.open_ids").alias("n_tokens"), F.lit(True).alias("open"))
    return first.unionByName(inner).unionByName(rest)


def read_files(spark: SparkSession, path: str, part: int | None = None) -> DataFrame:
    """Token files under ``path`` as (file, part, ids): whole, or in ranges of ``part`` bytes (a multiple of 4).

    Ranges are read through Arrow's file systems (local and shared folders, and the stores
    that Arrow knows by their URI), a task or more of them each.
    """
    files = spark.read.format("binaryFile").load(path)
    if part is None:
        return files.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("part"), F.col("content").alias("ids"))
    if part <= 0 or part % 4:
        raise ValueError("a range is a multiple of 4 bytes")
    ranges = files.select(F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / part))).alias("part"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, length, k in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                store, at = fs.FileSystem.from_uri("file:///" + name[5:].lstrip("/") if name.startswith("file:/") else name)
                with store.open_input_file(at) as f:
                    raw = f.read_at(min(part, length - k * part), k * part) if length else b""
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([raw], pa.binary())], names=["file", "part", "ids"])

    return ranges.repartition("file", "part").mapInArrow(of, "file string, part long, ids binary")


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, file, ordinal, n_tokens: ``docs`` written flat to the shared folder, then scanned."""
    spark, width = docs.sparkSession, width_of(tokenizer)
    path = fresh_path(spark, "tokens")
    made = flat(docs, tokenizer, width=width)
    try:
        made.write.parquet(path)
        files = spark.read.schema(made.schema).parquet(path)
        found = scan(files.where("ids is not null").select("file", "part", "ids"), width=width)
        owners = files.where("doc_ids is not null").select("file", F.posexplode("doc_ids").alias("at", "doc_id"))
        met = found.join(owners, (found["file"] == owners["file"]) & (found["ordinal"] == owners["at"]))
        return durable(met.select("doc_id", found["file"], "ordinal", "n_tokens"))
    finally:
        remove(spark, path)  # the counts are kept, the tokens aren't needed any more
