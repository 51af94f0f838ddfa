"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is a window.  A window that occurs more than
once in the corpus is kept where it occurs first (smallest doc_id, then position);
the lines that its later occurrences cover are removed, overlaps merged.

Only hashes and positions are shuffled to find repeats: a partial count a window and
task, then an equality join that Spark can split where one window is very common.  Of
the texts, those with lines to remove are brought to their positions; the others stay
where they are, as long as the digests of the former can be broadcast.

Defined results: a null text stays null with no lines; a text of fewer than three
lines has no window and stays as it is; windows of blank lines only don't count; rows
alike in doc_id and text are one document that doesn't repeat itself, so each stays;
a null doc_id comes before all others; an empty table gives no rows; columns of any
name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, quoted, unused

WINDOW = 3
#: digests of texts with lines to remove that are broadcast at most (8 bytes each)
BROADCAST = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """key (doc_id, text hash), pos, and two hashes of the window's lines."""
    split = docs.select("doc_id", "text", _lines(F.col("text")).alias("lines")).where(F.size("lines") >= window)
    at = split.select("doc_id", F.xxhash64("text").alias("th"), "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - window)).alias("pos"))
    part = [F.element_at("lines", F.col("pos") + 1 + i) for i in range(window)]
    blank = F.trim(F.concat(*part)) == ""
    return at.where(~blank).select("doc_id", "th", "pos", F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit("second"), *reversed(part)).alias("h2"))


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), pos of every window that repeats an earlier one."""
    every = _windows(docs, window)
    place = F.struct("doc_id", "th", "pos")
    first = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return every.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "th", "pos")


def line_dedup(docs: DataFrame, window: int = WINDOW, names: tuple[str, str] = ("__n_lines", "__n_removed")) -> DataFrame:
    """``docs`` with ``text`` cleaned, and the numbers of its lines and of those removed beside its columns."""
    gone = durable(later_windows(docs, window).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("starts")))
    mark = unused(docs, "__mark")[0]
    hit = durable(gone.select(F.xxhash64("doc_id", "th").alias(mark)).distinct())
    if hit.count() > BROADCAST:
        return _without(docs, gone, window, names)
    # a digest that two texts share only sends a text without lines to remove along
    here = F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"])) == F.col(mark)
    touched, rest = docs.join(F.broadcast(hit), here, "left_semi"), docs.join(F.broadcast(hit), here, "left_anti")
    n_lines = F.when(rest["text"].isNull(), 0).otherwise(F.size(_lines(rest["text"])))
    return _without(touched, gone, window, names).unionByName(rest.select(*[quoted(rest, c) for c in rest.columns], n_lines.alias(names[0]), F.lit(0).alias(names[1])))


def _without(docs: DataFrame, gone: DataFrame, window: int, names: tuple[str, str]) -> DataFrame:
    """``docs`` without the lines that the windows at ``gone`` (doc_id, th, starts) cover."""
    gone_id, gone_th, starts, lines, covered = unused(docs, "__id", "__th", "__starts", "__lines", "__covered")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th), F.col("starts").alias(starts))
    own = [quoted(docs, c) for c in docs.columns]
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_th)), "left")
    reach = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + window - 1))))
    # the lines are a column of their own, used more than once above, so that they are split once a row
    work = joined.select(*own, _lines(docs["text"]).alias(lines), reach.alias(covered))
    hit = F.col(covered).isNotNull()
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    text = F.when(hit, rest).otherwise(quoted(work, "text")).alias("text")
    n_lines = F.when(quoted(work, "text").isNull(), 0).otherwise(F.size(lines)).alias(names[0])
    removed = F.when(hit, F.size(covered)).otherwise(0).alias(names[1])
    return work.select(*[text if c == "text" else quoted(work, c) for c in docs.columns], n_lines, removed)
