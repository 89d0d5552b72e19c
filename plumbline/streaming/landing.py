"""Landing new files once each: a file stream that stops when it has caught up."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def land_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, kind: str = "json") -> StreamingQuery:
    """Append the rows of files that weren't there before; files that were are skipped, also after a restart."""
    stream = spark.readStream.schema(schema).format(kind).load(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
