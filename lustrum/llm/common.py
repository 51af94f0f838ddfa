"""Helpers the operators share: durable intermediates, gapless ranks, digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the setting is absent in local mode, as in tests, a folder of our own is
    set; a cluster without the setting has no folder that all executors see, and fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='lustrum-')}")
    return named or spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut.

    The files outlive any executor; Spark removes them with the reference when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df``, kept, and hinted for broadcast if it has at most ``rows`` rows; else joined by shuffle."""
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours from whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def gapless_rank(df: DataFrame, by: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within the groups of ``by``, without a task per group.

    Rows are dealt by (``by``, ``bucket``) and numbered there; a prefix sum over the
    groups' bucket counts, which has a row per bucket at most, gives each bucket its
    base.  The order is by bucket, then ``order``.
    """
    tagged = df.withColumn("__bucket", bucket)
    keys = [*by, "__bucket"]
    base = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy(*keys).orderBy(*order)
    numbered = tagged.withColumn("__rank", F.row_number().over(own) - 1)
    out = numbered.join(base.select(*[F.col(k).alias(f"__b_{k}") for k in keys], "__base"), _same(keys))
    return out.select(*df.columns, (F.col("__base") + F.col("__rank")).cast("long").alias(name))


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
    return cond


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quoted(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
