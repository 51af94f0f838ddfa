"""Look-alike glyphs folded to ASCII, in named fields of tool calls.

Which glyphs stand for which letters is the caller's: a map, or a column of findings
(index in UTF-16 units, char, latin) from a scanner of theirs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rows import arrow
from .prompt import code_point

#: The fields of each tool that hold paths, patterns or commands.
FIELDS: dict[str, tuple[str, ...]] = {
    "Bash": ("command",),
    "Edit": ("file_path",),
    "Write": ("file_path",),
    "Read": ("file_path",),
    "MultiEdit": ("file_path",),
    "NotebookEdit": ("notebook_path",),
    "Grep": ("pattern", "path"),
    "Glob": ("pattern", "path"),
    "LS": ("path",),
}
FINDINGS = "array<struct<index:int,char:string,latin:string>>"


def has_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def _checked(glyphs: Mapping[str, str]) -> Mapping[str, str]:
    for glyph, latin in glyphs.items():
        if not latin:
            raise ValueError(f"the glyph {glyph!r} has an empty canon")
        if not latin.isascii():
            raise ValueError(f"the canon {latin!r} of {glyph!r} isn't ASCII")
        if len(glyph) != 1:
            raise ValueError(f"{glyph!r} isn't one character")
    return glyphs


def fold_map(text: Column, glyphs: Mapping[str, str]) -> Column:
    """Every glyph of the map replaced by its canon; ASCII text is left as it is."""
    glyphs = _checked(glyphs)
    single = {g: c for g, c in glyphs.items() if len(c) == 1}
    out = F.translate(text, "".join(single), "".join(single.values())) if single else text
    for glyph, latin in glyphs.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(glyph), F.lit(latin))
    return F.when(has_non_ascii(text), out).otherwise(text)


def find_map(text: Column, glyphs: Mapping[str, str]) -> Column:
    """Findings of a map's glyphs: array of struct(index, char, latin) in order."""
    glyphs = _checked(glyphs)
    table = F.create_map(*[F.lit(x) for kv in glyphs.items() for x in kv])
    chars = F.split(text, "")
    units = F.aggregate(chars, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + F.when(F.ascii(c) > 0xFFFF, 2).otherwise(1))))
    every = F.transform(chars, lambda c, i: F.struct(F.get(units, i).alias("index"), c.alias("char"), F.element_at(table, c).alias("latin")))
    none = F.array().cast(FINDINGS)
    return F.when(has_non_ascii(text), F.filter(every, lambda f: f["latin"].isNotNull())).otherwise(none)


def apply_findings(text: str, findings: Sequence) -> str:
    """The text with each finding folded, last first; a finding that doesn't fit raises."""
    units = text.encode("utf-16-le", "surrogatepass")
    for f in sorted(findings, key=lambda f: -f["index"]):
        at, char, latin = f["index"], f["char"], f["latin"]
        raw = char.encode("utf-16-le", "surrogatepass")
        if at is None or at < 0:
            raise ValueError(f"a finding has an out-of-range index {at}")
        if not units.startswith(raw, 2 * at):
            raise ValueError(f"a finding doesn't match the input at index {at}: expected {char!r}")
        if not latin:
            raise ValueError(f"the finding for {char!r} at index {at} has an empty canon")
        if not latin.isascii():
            raise ValueError(f"the canon {latin!r} isn't ASCII")
        units = units[: 2 * at] + latin.encode("utf-16-le") + units[2 * at + len(raw) :]
    return units.decode("utf-16-le", "surrogatepass")


@arrow("string")
def _apply(text: pd.Series, findings: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else apply_findings(t, fs) if fs is not None and len(fs) else t for t, fs in zip(text, findings, strict=True)])


def fold_findings(text: Column, findings: Column) -> Column:
    """The text with a scanner's findings folded; a bad finding fails the task."""
    return F.coalesce(_apply(F.when(F.size(findings) > 0, text), findings), text)


def describe_folds(findings: Column) -> Column:
    """The distinct folds, of which the first eight are shown."""
    shown = F.array_distinct(F.transform(findings, lambda f: F.concat(code_point(f["char"]), F.lit(' → "'), f["latin"], F.lit('"'))))
    text = F.array_join(F.slice(shown, 1, K.MAX_FOLDS), ", ")
    return F.when(F.size(shown) > K.MAX_FOLDS, F.concat(text, F.lit(", …"))).otherwise(text)


def normalize_context(touched: Column) -> Column:
    return F.concat(F.lit("Confusable characters normalized in: "), F.array_join(touched, ", "), F.lit(". If a path now fails to resolve, the on-disk name itself contains the look-alike glyph shown."))


def normalize_calls(calls: DataFrame, glyphs: Mapping[str, str], fields: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``calls`` (tool, input map<string,string>) with updated_input and normalized, null where nothing changes."""
    named = FIELDS if fields is None else fields
    table = F.create_map(*[x for tool, keys in named.items() for x in (F.lit(tool), F.array(*[F.lit(k) for k in keys]))])
    keys = F.coalesce(F.element_at(table, F.col("tool")), F.array().cast("array<string>"))
    held = F.filter(keys, lambda k: F.coalesce(has_non_ascii(F.element_at(F.col("input"), k)), F.lit(False)))
    each = F.transform(held, lambda k: F.struct(k.alias("k"), find_map(F.element_at(F.col("input"), k), glyphs).alias("f")))
    df = calls.withColumn("__each", F.filter(each, lambda e: F.size(e["f"]) > 0))
    hit = F.size("__each") > 0
    changed = F.map_from_entries(F.transform("__each", lambda e: F.struct(e["k"], fold_map(F.element_at(F.col("input"), e["k"]), glyphs))))
    kept = F.map_filter("input", lambda k, v: ~F.array_contains(F.transform(F.col("__each"), lambda e: e["k"]), k))
    touched = F.transform("__each", lambda e: F.concat(e["k"], F.lit(" ("), describe_folds(e["f"]), F.lit(")")))
    return df.select(*calls.columns, F.when(hit, F.map_concat(kept, changed)).alias("updated_input"), F.when(hit, touched).alias("normalized"))
