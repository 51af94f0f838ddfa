"""Edits on sanitised views carried back onto files: a join of edits and files, then an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import anchors, secrets
from ..functions.rows import arrow
from ..functions.secrets import Config

_FIELDS = ("file_path", "old_string", "new_string", "content", "new_source")


@arrow("array<struct<start:int,deleted:string>>")
def align_deletions(content: pd.Series, cleaned: pd.Series) -> pd.Series:
    """The runs that were deleted from ``content``, by their offsets in ``cleaned``."""
    rows = zip(content, cleaned, strict=True)
    return pd.Series([None if c is None or k is None else [{"start": a, "deleted": d} for a, d in anchors.deletions(c, k)] for c, k in rows])


def occurrences(text: Column, part: Column) -> Column:
    """Offsets of a part's non-overlapping occurrences, without leaving Spark."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    at = F.aggregate(pieces, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p) + F.length(part))))
    ends = F.transform(F.slice(at, 2, F.size(pieces) - 1), lambda x: x - F.length(part))
    return F.when(part == "", F.array().cast("array<int>")).otherwise(F.when(F.size(pieces) > 1, ends).otherwise(F.array().cast("array<int>")))


def rehydrate_edits(edits: DataFrame, files: DataFrame, config: Config = Config(), hint: str = K.HINT) -> DataFrame:
    """``edits`` (tool, file_path, old_string, new_string, replace_all, content, new_source) against
    ``files`` (file_path, content), with result struct(updated map, context, deny), null where nothing is to do."""

    @F.pandas_udf("updated map<string,string>, context string, deny string")
    def of(tool: pd.Series, given: pd.DataFrame, disk: pd.Series) -> pd.DataFrame:
        rows = []
        for t, (_, g), d in zip(tool, given.iterrows(), disk, strict=True):
            call = {k: g[k] for k in _FIELDS if isinstance(g[k], str)} | {"replace_all": bool(g["replace_all"]) if pd.notna(g["replace_all"]) else False}
            got = anchors.rehydrate(t, call, d, lambda x: secrets.respond(x, True, config), lambda x: secrets.redact(x, config)[0], hint) or {}
            updated = {k: str(v) for k, v in got["updated"].items() if k != "replace_all"} if "updated" in got else None
            rows.append((updated, got.get("context"), got.get("deny")))
        return pd.DataFrame(rows, columns=["updated", "context", "deny"])

    on_disk = files.select(F.col("file_path").alias("__path"), F.col("content").alias("__disk"))
    met = edits.join(on_disk, edits["file_path"] == F.col("__path"), "left")
    given = F.struct(*_FIELDS, "replace_all")
    return met.withColumn("result", of(F.col("tool"), given, F.col("__disk"))).select(*edits.columns, "result")
