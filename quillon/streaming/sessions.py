"""Gap islands over a stream: the streaming form of layout.gap_islands, where rows come by time and a gap ends an island."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Rows of a key no more than gap apart form a session: key, start, end (of the last row plus gap), n.

    Rows later than `late` behind the newest are dropped, and a session is given out once the watermark has passed it, so
    state holds open sessions only. Partial sessions merge map-side.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = timed.groupBy(F.col(key), F.session_window(F.col(time), gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
