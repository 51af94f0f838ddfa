"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents`` (and whatever columns stand beside them, of any name); the last
returns the packed pieces.  Every stage takes null ids and texts, empty and very long
texts, repeated rows and empty tables, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustrum.llm import decontamination, linededup, overlap, packing, quality
from lustrum.llm.common import durable, few_broadcast, fresh_path, quoted, remove, table, unused

#: ids of rows to drop that are broadcast at most (16 bytes each); more are joined by shuffle
DROPPED = 200_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts (score of 0.5 or more), as they are.

    A null text is scored like an empty one; repeated rows stay or go together; without
    labels of both kinds among the documents all stay; an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scored(model, docs["text"]) >= 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of repeated windows; n_chars follows the text.

    A text of which no line is left is empty; a null text stays null; rows alike in id and
    text are one document and get the same lines; an empty table stays empty.
    """
    names = unused(docs, "__n_lines", "__n_removed")
    out = linededup.line_dedup(docs, names=tuple(names))
    n_chars = F.when(quoted(out, names[1]) > 0, F.char_length(out["text"])).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[n_chars if c == "n_chars" else quoted(out, c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word Jaccard similarity of 0.8 or more), the document with the smallest id.

    Rows alike in id and text are one document, of which one row stays; rows that share the
    smallest id but not the text are documents of their own, and all stay.  A row without
    an id goes if its component has one with, and else stays.  Null texts are like texts
    without words; an empty table stays empty.
    """
    found = durable(overlap.near_copies(docs))
    at_id, at_th = unused(docs, "__id", "__th")
    here = docs["doc_id"].eqNullSafe(F.col(at_id)) & (F.xxhash64(docs["text"]) == F.col(at_th))
    key = [F.col("doc_id").alias(at_id), F.col("th").alias(at_th)]
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*key).distinct()
    kept = docs.join(few_broadcast(gone, DROPPED), here, "left_anti")
    again = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "th").count().where("count > 1").select(*key)
    again = few_broadcast(again, DROPPED)
    one_each = kept.join(again, here, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, here, "left_anti").unionByName(one_each)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay; rows alike in id and text stay or go together;
    an empty benchmark drops nothing; an empty table stays empty.
    """
    at_id, at_th = unused(docs, "__id", "__th")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    gone = found.select(F.col("doc_id").alias(at_id), F.col("th").alias(at_th)).distinct()
    return docs.join(few_broadcast(gone, DROPPED), docs["doc_id"].eqNullSafe(F.col(at_id)) & (F.xxhash64(docs["text"]) == F.col(at_th)), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences.

    A null or empty text is one piece of length 1; repeated rows are packed once each; an
    empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the fitted classifier, the similarity of shingle sets or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    The last one's table stays, for the result reads it; of a run that fails, none does.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            remove(spark, path)
            raise
        finally:
            if before:
                remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
