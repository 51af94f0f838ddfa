"""Small helpers for column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(*pairs: tuple[Column, Column | str]) -> Column:
    """The values whose conditions hold, in order."""
    items = [F.when(cond, value if isinstance(value, Column) else F.lit(value)) for cond, value in pairs]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: astral characters count twice."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def arrow(result: str):
    """A pandas UDF with a DDL result type, made when it is first applied.

    Spark parses the type in a session, and modules are imported before there is one.
    """

    def of(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def apply(*columns: Column) -> Column:
            return F.pandas_udf(f, result)(*columns)

        return apply

    return of


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns computed here, once a row.

    Spark would otherwise copy a column into every use further up; an Arrow UDF over such
    a copy that itself holds a UDF and a lambda can't be planned.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df
