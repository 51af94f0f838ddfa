"""Verdicts on prompts: pass, note (colours only) or block, with a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import patterns as P
from . import layer1 as L

ADVICE = "Resubmit the prompt with invisible/ANSI characters removed. If you pasted this from a webpage, the source may be carrying a prompt-injection payload."


def code_point(ch: Column) -> Column:
    """U+XXXX of a character."""
    digits = F.hex(F.ascii(ch))
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def format_reason(labels: Column, count: Column, sample: Column) -> Column:
    points = F.array_join(F.transform(F.slice(F.split(sample, ""), 1, 16), code_point), " ")
    parts = F.array(
        F.concat(F.lit("Detected: "), F.array_join(labels, ", "), F.lit(".")),
        F.concat(F.lit("Invisible char count: "), count.cast("string"), F.lit(f" (long-run threshold: {K.LONG_RUN}, scattered threshold: {K.SCATTERED}).")),
        F.when(sample.isNotNull(), F.concat(F.lit("Long-run sample (first 16 code points): "), points, F.lit("."))),
        F.lit(ADVICE),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")


def classify_prompt(prompt: Column) -> Column:
    """struct(action, reason)."""
    escapes = prompt.rlike(P.STRAY)
    de_ansi = L.strip_escapes(prompt)
    sample, count = L.first_long_run(de_ansi), L.payload_count(de_ansi)
    quiet = sample.isNull() & (count < K.SCATTERED)
    codes = F.concat(L.found_codes(de_ansi), F.when(escapes, F.array(F.lit(K.ANSI))).otherwise(F.array().cast("array<string>")))
    labels = F.transform(codes, lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in K.LABELS.items() for x in kv]), c))
    passes = prompt.isNull() | (prompt == "") | (~escapes & quiet)
    action = F.when(passes, "pass").when(quiet & L.colour_only(prompt), "note").otherwise("block")
    return F.struct(action.alias("action"), F.when(action == "block", format_reason(labels, count, sample)).alias("reason"))
