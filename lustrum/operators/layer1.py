"""Invisible characters and terminal escapes, as columns.

The common path is one chain of Java regexes inside Spark.  A text that holds a joiner
or a presentation selector needs its neighbours looked at, so it goes through an Arrow
UDF; all other texts reach the UDF as null, which costs nothing there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import charset, plain
from ..functions import patterns as P
from ..functions.rows import arrow, let, present

_REPORT = "cleaned string, found array<string>"
LAYER1 = "cleaned string, de_ansi string, found array<string>"


def classify(ch: Column) -> Column:
    """The category of a one-character string, or null for a visible one."""
    out = F.lit(None).cast("string")
    for code, body in reversed(charset.java_classes().items()):
        out = F.when(ch.rlike(rf"\A[{body}]\z"), code).otherwise(out)
    return out


def found_codes(text: Column) -> Column:
    """Categories that occur, in reporting order."""
    return present(*[(text.rlike(charset.quick(body)), code) for code, body in charset.java_classes().items()])


def bulk_strip(text: Column) -> Column:
    """Every invisible character deleted."""
    return F.regexp_replace(text, charset.quick(charset.java_invisible()), "")


def strip_charset(text: Column, points: frozenset[int] | None = None) -> Column:
    """Every code point of a set deleted (by default all invisible ones)."""
    points = charset.invisible_points() if points is None else points
    return F.regexp_replace(text, f"[{charset.java_class(points)}]", "") if points else text


def needs_carve(text: Column) -> Column:
    joiners = [text.contains(ch) for ch in (charset.ZWNJ, charset.ZWJ, charset.TEXT_STYLE, charset.EMOJI_STYLE)]
    return joiners[0] | joiners[1] | joiners[2] | joiners[3]


def dirty(text: Column) -> Column:
    """Whether the first layer may act on the text; an ASCII text needs an escape character for that."""
    plain_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(plain_ascii, text.contains("\x1b")).otherwise(text.rlike(f"[{charset.quick(charset.java_invisible())}\\x1b\\x{{80}}-\\x{{9f}}]"))


@arrow("int")
def _carve_payload(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else plain.payload_count(t)).astype("Int32")


def payload_count(text: Column) -> Column:
    """Invisible characters that do no work between their neighbours."""
    native = F.regexp_count(text, F.lit(charset.quick(charset.java_invisible())))
    return F.coalesce(_carve_payload(F.when(needs_carve(text), text)), native)


def _pick(rows: list, fields: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame({f: [None if r is None else r[k] for r in rows] for k, f in enumerate(fields)})


@arrow(_REPORT)
def _carve_strip(text: pd.Series) -> pd.DataFrame:
    return _pick([None if t is None else plain.drop_invisible(t) for t in text], ("cleaned", "found"))


def _without_mark(text: Column, body) -> Column:
    """``body`` of the text behind one leading byte-order mark, which stays."""
    return F.when(text.startswith(charset.BOM), F.concat(F.lit(charset.BOM), body(F.substring(text, 2, 2**31 - 1)))).otherwise(body(text))


def strip_invisible(text: Column) -> Column:
    """struct(cleaned, found): invisible characters deleted but where they do work."""
    body = F.when(text.startswith(charset.BOM), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    native = F.when(text.isNotNull(), F.struct(_without_mark(text, bulk_strip).alias("cleaned"), found_codes(body).alias("found")))
    carved = _carve_strip(F.when(needs_carve(text), text))
    return F.when(needs_carve(text), carved).otherwise(native)


def long_run(text: Column) -> Column:
    return text.rlike(f"{charset.quick(charset.java_invisible())}{{{K.LONG_RUN},}}")


def first_long_run(text: Column) -> Column:
    """The first long run, or null."""
    run = F.regexp_extract(text, f"{charset.quick(charset.java_invisible())}{{{K.LONG_RUN},}}", 0)
    return F.when(run != "", run)


def colour_only(text: Column) -> Column:
    """Whether nothing is left of the escapes once colours are taken out."""
    return ~F.regexp_replace(text, P.COLOUR, "").rlike(P.STRAY)


def strip_escapes(text: Column) -> Column:
    """Escape sequences deleted until none is left.

    Each round that changes the text uses up an introducer, so their number bounds the
    rounds; a text without any takes none.
    """
    rounds = F.sequence(F.lit(1), F.regexp_count(text, F.lit(P.INTRODUCERS)) + 1)
    stripped = F.aggregate(rounds, text, lambda t, _: F.regexp_replace(t, P.ESCAPES, ""))
    return F.when(text.rlike(P.INTRODUCERS), stripped).otherwise(text)


def sweep(text: Column) -> Column:
    return F.regexp_replace(text, P.STRAY, "")


def _native_layer1(text: Column) -> Column:
    def whole(de_ansi: Column) -> Column:
        return let(_without_mark(de_ansi, bulk_strip), lambda cleaned: again(de_ansi, cleaned))

    def again(de_ansi: Column, cleaned: Column) -> Column:
        return let(F.when(cleaned == de_ansi, cleaned).otherwise(strip_escapes(cleaned)), lambda twice: let(sweep(twice), lambda swept: report(de_ansi, cleaned, twice, swept)))

    def report(de_ansi: Column, cleaned: Column, twice: Column, swept: Column) -> Column:
        body = F.when(de_ansi.startswith(charset.BOM), F.substring(de_ansi, 2, 2**31 - 1)).otherwise(de_ansi)
        escapes = (de_ansi != text) | (twice != cleaned) | (swept != twice)
        found = F.concat(found_codes(body), F.when(escapes, F.array(F.lit(K.ANSI))).otherwise(F.array().cast("array<string>")))
        return F.struct(swept.alias("cleaned"), de_ansi.alias("de_ansi"), found.alias("found"))

    clean = F.struct(text.alias("cleaned"), text.alias("de_ansi"), F.array().cast("array<string>").alias("found"))
    return F.when(text.isNull(), F.lit(None)).when(dirty(text), let(strip_escapes(text), whole)).otherwise(clean)


@arrow(LAYER1)
def _carve_layer1(text: pd.Series) -> pd.DataFrame:
    rows = [None if t is None else plain.layer1(t) for t in text]
    return _pick([None if r is None else (r.cleaned, r.de_ansi, r.found) for r in rows], ("cleaned", "de_ansi", "found"))


def layer1(text: Column) -> Column:
    """struct(cleaned, de_ansi, found) of a text; null for null."""
    return F.when(needs_carve(text), _carve_layer1(F.when(needs_carve(text), text))).otherwise(_native_layer1(text))


@arrow("cleaned string, de_ansi string, found array<string>, mended boolean")
def _binary_layer1(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for b in raw:
        if b is None:
            rows.append(None)
            continue
        one = plain.layer1(plain.decoded(bytes(b)))
        whole = plain.mend_surrogates(one.cleaned)
        lone = plain.has_lone_surrogate(one.cleaned)
        rows.append((whole, plain.mend_surrogates(one.de_ansi), one.found + [K.SURROGATES] * lone, lone))
    return _pick(rows, ("cleaned", "de_ansi", "found", "mended"))


def layer1_binary(raw: Column) -> Column:
    """The first layer over bytes that may spell lone surrogates, which become U+FFFD, as other malformed bytes do."""
    return _binary_layer1(raw)


def describe_stripped(found: Column, de_ansi: Column) -> Column:
    labels = F.transform(found, lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in K.LABELS.items() for x in kv]), c))
    return F.concat(F.lit("Stripped: "), F.array_join(labels, ", "), F.when(long_run(de_ansi), K.LONG_RUN_NOTE).otherwise(""), F.lit(K.HEX_DUMP_NOTE))
