"""Trace logs as streams: new traces taken up once, verified ones appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.traces import normal_status, promoted
from ..runtime import path_exists
from ..sources.logs import TRACE, read_lines


def successes(stream: DataFrame, key: str = "image_id", watermark: str | None = None, at: str = "written_at") -> DataFrame:
    """The first successful trace of each key. With a watermark the state of old keys is
    dropped, so a key may come again after that; without one it is kept for good."""
    good = stream.where((normal_status(F.col("status")) == "unverified") & F.col(key).isNotNull())
    if watermark:
        return good.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])
    return good.dropDuplicates([key])


def promote(spark: SparkSession, log: str, verified: str, checkpoint: str, verdict: Column) -> StreamingQuery:
    """Take up what is new in the log, append what the verdict passes to the verified
    log. A batch that is run again after a failure appends nothing twice, as it is held
    against the verified log first."""

    def batch(df: DataFrame, _: int) -> None:
        done = spark.read.json(verified, schema=TRACE) if path_exists(spark, verified) else spark.createDataFrame([], TRACE)
        promoted(df, done, verdict).write.mode("append").json(verified)

    source = read_lines(spark, log, TRACE, stream=True)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
