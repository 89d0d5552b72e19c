"""JSON arrays, NDJSON and registries, with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType


def read_json(spark: SparkSession, path: str, schema: str | StructType, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


#: Raw API responses, one a line (gzip is read by its file name); the body stays text until it is reduced.
RESPONSE = "ori string, offense string, http_status int, url string, fetched_at string, body string"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RESPONSE).where("body is not null")


def registry_df(spark: SparkSession, records: Sequence[dict], schema: StructType) -> DataFrame:
    """A small declared registry: lists are joined by ' | ', missing booleans are false."""
    def value(record, field):
        v = record.get(field.name)
        if isinstance(v, (list, tuple)):
            return " | ".join(map(str, v))
        return False if v is None and isinstance(field.dataType, BooleanType) else v

    return spark.createDataFrame([tuple(value(r, f) for f in schema.fields) for r in records], schema)


def gate_metric(registry: DataFrame, metric: str, use: str) -> None:
    """Raise unless the registry allows the metric for use ('comparison' or 'ranking')."""
    row = registry.where(F.col("metric_id") == metric).select(f"{use}_allowed").first()
    if row is None or not row[0]:
        raise ValueError(f"{metric} may not be used for {use}")
