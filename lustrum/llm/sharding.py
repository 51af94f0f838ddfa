"""Sharding down a weighted hash tree: region, rack, shard.

At each level the children draw for the row: child c with weight w draws
``-ln(u) / w`` with u a hash of (row id, child) in (0, 1), and the least draw wins.
A child wins in proportion to its weight, and a child whose weight grows takes rows
from its siblings while no two other siblings exchange any, so movement stays within
the subtrees whose weights change.

``tree(n)`` lays the first ``base`` shards out as regions of racks; each shard beyond
opens a region of its own, so that one more shard takes rows only into itself.

Defined results: a null text has size 8 and the checksum of no bytes; a null doc_id is
hashed as the word ``null``; repeated rows land in one shard, in slots of their own; an
empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def tree(n: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> Tree:
    out: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(n):
        region = f"g{s // (racks * per_rack)}" if s < base else f"g+{s}"
        rack = f"{region}/k{s // per_rack % racks if s < base else 0}"
        out.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return out


def _unit(key: Column, node: Column) -> Column:
    """48 hash bits of (key, node), as a number in (0, 1)."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), node)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _winner(key: Column, children: Column) -> Column:
    """The name, among ``children`` (name, weight), with the least draw."""
    drawn = F.transform(children, lambda c: F.struct((-F.ln(_unit(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(drawn)["name"]


def _children(level: Mapping[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for name, w in sorted(level.items())])


def descend(df: DataFrame, key: Column, shape: Tree, name: str) -> DataFrame:
    """``df`` with column ``name``: the shard of ``key`` in ``shape``, drawn level by level."""
    weight = {region: {rack: sum(leaves.values()) for rack, leaves in racks.items()} for region, racks in shape.items()}
    leaves = {rack: {str(s): w for s, w in below.items()} for racks in shape.values() for rack, below in racks.items()}

    def step(node: Column, below: Mapping[str, Mapping[str, float]]) -> Column:
        out = F.lit(None)
        for at, level in below.items():
            out = F.when(node == at, _children(level)).otherwise(out)
        return _winner(key, out)

    top = {region: sum(racks.values()) for region, racks in weight.items()}
    df = df.withColumn("__region", _winner(key, _children(top)))
    df = df.withColumn("__rack", step(F.col("__region"), weight))
    return df.withColumn(name, step(F.col("__rack"), leaves).cast("int")).drop("__region", "__rack")


def shard(docs: DataFrame, n: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in the shard), grown_shard (with ``n`` + 1).

    Law ``key``: doc_id and the number of shards decide.  No text is shuffled: its size
    and checksum are taken where it is read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__key"),
    )
    rows = descend(descend(rows, F.col("__key"), tree(n), "shard"), F.col("__key"), tree(n + 1), "grown_shard")
    bucket = F.conv(F.substring(F.md5(F.concat(F.col("__key"), F.lit("|"), F.col("text_crc32").cast("string"))), 1, 3), 16, 10).cast("int")  # rows that share an id part
    out = gapless_rank(rows, ["shard"], bucket, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
