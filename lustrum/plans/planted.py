"""Payloads planted in the driver's tables, said alike in Spark and in SQL.

The tables hold no invisible character, so queries plant one kind a row by its id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESC, CSI, BEL = "\x1b", "\x9b", "\x07"
#: (what stands before the text, what stands behind it) by id modulo 8
KINDS = (
    ("", ""),
    ("​", "‎"),
    ("", f"{ESC}[31mred{ESC}[0m"),
    ("", "​" * 12),
    ("﻿", "­"),
    (f"{ESC}]0;title{BEL}", ""),
    ("", "ㅤ⠀︀"),
    ("", f"{CSI}2J\U000e0041\U000e0042"),
)


def planted(text: Column, key: Column) -> Column:
    out = F.lit("")
    kind = key % len(KINDS)
    for k, (before, behind) in enumerate(KINDS):
        out = F.when(kind == k, F.concat(F.lit(before), text, F.lit(behind))).otherwise(out)
    return out


def sql_string(text: str) -> str:
    """A SQL expression of a string, control and invisible characters by number."""
    parts, plain = [], ""
    for ch in text:
        if ch.isascii() and ch.isprintable():
            plain += ch
            continue
        if plain:
            parts.append("'" + plain.replace("'", "''") + "'")
            plain = ""
        parts.append(f"chr({ord(ch)})")
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def planted_sql(text: str, key: str) -> str:
    whens = " ".join(f"when {k} then {sql_string(a)} || {text} || {sql_string(b)}" for k, (a, b) in enumerate(KINDS))
    return f"(case {key} % {len(KINDS)} {whens} end)"
