"""Requests as newline-delimited JSON, answered one row a line.

A line is {op, text, html, exfilScan}; ``op`` defaults to ``sanitize``.  Two ops are about
files instead, of a folder that the executors see: {op: scanInstructionFiles, globs, cwd} and
{op: cleanFile, path}, which changes a file at most once, so a repeated task answers that
nothing was left to change.  A line that is
no request, names an unknown op, lacks its text or is longer than the limit is answered
with an error and doesn't stop the others.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import api
from ..functions.rows import arrow, settled
from ..operators import output, prompt

REQUEST = "op string, text variant, html variant, exfilScan variant, globs variant, cwd variant, path variant, _corrupt_record string"
#: values that flags read as false
_FALSE = ("false", "null", "0", "-0", "0.0", "-0.0", '""')
TEXT_OPS, SCAN, CLEAN = ("sanitize", "sanitizeText", "classifyPrompt"), "scanInstructionFiles", "cleanFile"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def parse(lines: DataFrame, limit: int = K.MAX_REQUEST_BYTES) -> DataFrame:
    """``lines`` (line) with op, text, html, exfil_scan, globs, cwd, path, error; text, globs and path are null where there is an error."""
    size = F.octet_length("line")
    small = F.when(size <= limit, F.col("line"))
    df = lines.where(F.trim("line") != "").withColumn("__r", F.from_json(small, REQUEST, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    op = F.coalesce(F.col("__r.op"), F.lit("sanitize"))
    kind = lambda c, *kinds: F.coalesce(F.schema_of_variant(f"__r.{c}").isin(*kinds), F.lit(False))
    error = (
        F.when(size > limit, F.concat(F.lit("request too large: "), size.cast("string"), F.lit(f" bytes exceeds the {limit}-byte limit")))
        .when(F.col("__r").isNull() | F.col("__r._corrupt_record").isNotNull(), "request is not a JSON object")
        .when(~op.isin(*TEXT_OPS, SCAN, CLEAN), F.concat(F.lit("unknown op: "), op))
        .when(op.isin(*TEXT_OPS) & ~kind("text", "STRING"), "request.text must be a string")
        .when((op == SCAN) & ~kind("globs", "ARRAY<STRING>", "ARRAY<VOID>"), "request.globs must be an array of strings")
        .when((op == CLEAN) & ~kind("path", "STRING"), "request.path must be a string")
    )
    flag = lambda c: F.coalesce(~F.to_json(F.col(f"__r.{c}")).isin(*_FALSE), F.lit(False))
    out = df.withColumns({"op": op, "html": flag("html"), "exfil_scan": flag("exfilScan"), "error": error})
    given = lambda c, type_, *ops: F.when(F.col("error").isNull() & F.col("op").isin(*ops), F.try_variant_get(f"__r.{c}", "$", type_))
    cwd = F.when(kind("cwd", "STRING"), given("cwd", "string", SCAN))
    return out.withColumns({"text": given("text", "string", *TEXT_OPS), "globs": given("globs", "array<string>", SCAN), "cwd": cwd, "path": given("path", "string", CLEAN)}).drop("__r")


@arrow("response string, error string")
def _on_files(globs: pd.Series, cwd: pd.Series, path: pd.Series) -> pd.DataFrame:
    rows = []
    for g, c, p in zip(globs, cwd, path, strict=True):
        try:
            if p is not None:
                rows.append((json.dumps({"changed": api.clean_file(p)}), None))
            elif g is not None:
                found = [{"file": f, "findings": x} for f, x in api.scan_instruction_files(list(g), "." if c is None else c)]
                rows.append((json.dumps({"findings": found}, ensure_ascii=False, separators=(",", ":")), None))
            else:
                rows.append((None, None))
        except (OSError, ValueError) as e:
            rows.append((json.dumps({"error": str(e)}, ensure_ascii=False), str(e)))
    return pd.DataFrame(rows, columns=["response", "error"])


def answer(lines: DataFrame, limit: int = K.MAX_REQUEST_BYTES) -> DataFrame:
    """``lines`` (with whatever columns beside) and op, error and ``response``, a JSON object each.

    The texts of both cleaning ops go through the layers together, as each row's flags say.
    """
    df = parse(lines, limit)
    op, html = F.col("op"), F.col("html")
    df = df.withColumns({"__t": F.when(op.isin(*TEXT_OPS[:2]), F.col("text")), "__prompt": F.when(op == "classifyPrompt", F.col("text"))})
    whole = op == "sanitize"
    df = output.layers(df, "__t", html, F.when(whole, html).otherwise(F.col("exfil_scan")))
    df = settled(df, __f=_on_files(F.col("globs"), F.col("cwd"), F.col("path")))
    df = settled(df, __e=F.when(F.col("__prompt").isNotNull(), prompt.classify_prompt(F.col("__prompt"))))
    warnings, cut = output.text_warnings(True, True, F.lit(False))
    cleaned = F.when(cut, F.col("__l2.text")).otherwise(F.col("__l1.cleaned"))
    told = F.filter(F.array(*warnings), lambda w: w.isNotNull() & (w != ""))
    text = F.struct(cleaned.alias("cleaned"), told.alias("warnings"), (cut | (F.size("__l1.found") > 0)).alias("modified"), F.lit(False).alias("sgrNote"))
    response = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).when(op.isin(SCAN, CLEAN), F.col("__f.response")).when(whole, F.to_json(output.sanitized())).when(op == "sanitizeText", F.to_json(text)).otherwise(F.to_json("__e"))
    return df.select(*lines.columns, "op", F.coalesce("error", "__f.error").alias("error"), response.alias("response"))


def write_answers(answers: DataFrame, path: str) -> None:
    answers.select(F.col("response").alias("value")).write.text(path)
