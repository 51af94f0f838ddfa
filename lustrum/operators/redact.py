"""Secret redaction as columns. Only texts with a hint of a secret reach the Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import secrets
from ..functions.rows import let
from ..functions.secrets import Config

PAIRS = "array<struct<placeholder:string,original:string,start:int>>"


#: what token shapes spell out, and the shapes that spell nothing rare
_PARTS = (
    "AKIA", "A3T", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA", "ABIA", "ACCA", "AKC", "AccountKey=", "_authToken", "T3BlbkFJ", "pypi-AgE", "SG.", "xox", "sq0csp-", "_live_",
    "sk-", "AIza", "_v1_", "v1.0-", "hvs.", "hvb.", ".atlasv1.", "github_pat_", "gsk_", "xai-", "r8_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyJ",
)
_SHAPES = r"[MNO][A-Za-z0-9_-]{23,25}\.|[0-9]{8}:[0-9A-Za-z_-]{35}|(?:AC|SK)[a-z0-9]{32}|[0-9a-z]{32}-us|gl[a-z]{2,12}-[0-9A-Za-z_-]{20}"
#: fields that count for some services even where a blank is all that assigns them
_SERVICE_FIELD = r"""(?iu)(?:key|pwd?|password|pass|token)["']?\]?(?: *+(?::=|=>|::|[=:]) *+| ++)["']?[a-z0-9_-]{24}"""
_WORDS = ("key", "pass", "pwd", "secret", "contrase", "token", "bearer", "auth")
#: one run of name signs that holds a word, an assignment behind it; \w and \s as in Python, which takes more for them than Java
_RUN = r"[\w\p{N}-]"
_ASSIGNED = rf"(?iuU)(?<!{_RUN})(?={_RUN}*?(?:" + "|".join(_WORDS) + rf")){_RUN}*+[\"'\]]{{0,2}}[\s\x1c-\x1f]*+[:=!]"


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def hinted(text: Column, config: Config) -> Column:
    """A superset of the texts that redaction changes, told by cheap searches first.

    Tokens spell a rare part out or have a long run of signs, line breaks aside; fields have
    a word and an assignment; web addresses with a password, key blocks and exact values are
    looked for as they are.
    """

    def flat_hint(flat: Column) -> Column:
        shaped = flat.rlike("(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20}") & flat.rlike(_SHAPES)
        return _any(flat, _PARTS) | shaped | (flat.contains("AP") & flat.rlike("AP[0-9A-F][A-Za-z0-9]{8}"))

    token = let(F.replace(text, F.lit("\n"), F.lit("")), flat_hint)
    named = let(F.translate(F.lower(text), "ſ", "s"), lambda low: _any(low, _WORDS)) & text.rlike(_ASSIGNED)  # (?i) takes ſ for s
    address = text.contains("://") & (text.contains("@") | text.contains("softlayer"))
    service = text.rlike(_SERVICE_FIELD)
    out = token | named | address | service | text.contains("-----")
    for value in config.values.values():
        out = out | text.contains(value[0])
    return out


def redact(text: Column, config: Config = Config()) -> Column:
    """struct(text, found): found lists the labels in the order of redaction."""

    @F.pandas_udf("text string, found array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(None, None) if t is None else secrets.redact(t, config) for t in batch]
            yield pd.DataFrame({"text": [r[0] for r in rows], "found": [r[1] for r in rows]})

    got = of(F.when(hinted(text, config), text))
    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))
    return F.when(text.isNull(), F.lit(None)).when(got["text"].isNotNull(), got).otherwise(none)


def redact_map(text: Column, config: Config = Config()) -> Column:
    """struct(text, pairs, found, unmappable): originals at their offsets rebuild the input."""

    @F.pandas_udf(f"text string, pairs {PAIRS}, found array<string>, unmappable string")
    def of(t: pd.Series) -> pd.DataFrame:
        rows = [{} if x is None else secrets.respond(x, True, config) for x in t]
        return pd.DataFrame({k: [r.get(k) for r in rows] for k in ("text", "pairs", "found", "unmappable")})

    acts = hinted(text, config) | text.contains(secrets.OPEN) | text.contains(secrets.CLOSE)
    empty = F.array()
    same = F.struct(text.alias("text"), empty.cast(PAIRS).alias("pairs"), empty.cast("array<string>").alias("found"), F.lit(None).cast("string").alias("unmappable"))
    got = of(F.when(acts, text))
    return F.when(text.isNotNull(), F.when(got["text"].isNotNull() | got["unmappable"].isNotNull(), got).otherwise(same))


def reconstruct(text: Column, pairs: Column) -> Column:
    """The input of a redaction map, from its text and pairs."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda a, p: F.struct((p["start"] + 1 + F.length(p["placeholder"])).alias("at"), F.concat(a["out"], F.substring(text, a["at"], p["start"] + 1 - a["at"]), p["original"]).alias("out"))
    return F.aggregate(pairs, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"], F.lit(2**31 - 1))))


def previews(text: Column, config: Config = Config()) -> Column:
    """Masked lines that hold secrets, distinct, in order."""

    @F.pandas_udf("array<string>")
    def of(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else secrets.previews(x, config))

    return F.coalesce(of(F.when(hinted(text, config), text)), F.when(text.isNotNull(), F.array().cast("array<string>")))


def key_blocks(text: Column) -> Column:
    """Private key blocks collapsed, without leaving Spark."""
    pattern = r"(?i)-----BEGIN ([A-Z0-9 ]{0,40}?PRIVATE KEY[A-Z0-9 ]{0,40}?)-----[\s\S]*?(?:-----END \1-----|(?=-----BEGIN )|\z)"
    return F.when(text.contains("-----"), F.regexp_replace(text, pattern, "[REDACTED: Private Key]")).otherwise(text)
