"""The request worker as a stream: lines in, answers out, stateless and without end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import layer1 as L
from ..sources import requests


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    return spark.readStream.text(path).select(F.col("value").alias("line"))


def serve(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Answers what is in ``source`` now and stops; called again, what has come since."""
    answers = requests.answer(read_requests(spark, source)).select(F.col("response").alias("value"))
    return answers.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def findings_by_window(events: DataFrame, text: str, at: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Findings of the first layer by category and window of event time; works on streams and tables."""
    found = events.withWatermark(at, late) if events.isStreaming else events
    found = found.select(F.window(at, width).alias("window"), F.explode(L.layer1(F.col(text))["found"]).alias("code"))
    return found.groupBy("window", "code").agg(F.count(F.lit(1)).alias("n"))
