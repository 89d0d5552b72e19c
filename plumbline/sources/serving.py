"""The serving extract: allow-listed tables in buckets of the keys that they are joined by, so a join reads bucket by bucket and shuffles nothing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import landing_folder


@dataclass(frozen=True)
class Extract:
    """The tables of an extract by name, and its manifest: table_name, published, rows."""

    names: dict[str, str]
    manifest: DataFrame
    spark: SparkSession

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.names[table])

    def join(self, tables: Sequence[str], keys: Sequence[str], how: str = "inner") -> DataFrame:
        """The tables joined by the keys that they are bucketed by, merged bucket by bucket."""
        out = self.read(tables[0])
        for t in tables[1:]:
            out = out.join(self.read(t).hint("merge"), list(keys), how)
        return out

    def drop(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def publish_buckets(tables: dict[str, DataFrame], allow: dict[str, Sequence[str]], buckets: int, folder: str | None = None) -> Extract:
    """Write the tables that `allow` lists with their keys, each in `buckets` sorted buckets; a table that isn't there is an error.

    The rows of a bucket are brought together before they are written, so a
    bucket is one file; a bucket holds a share of the keys, so choose their
    number by the size of the largest table.  Null keys share a bucket.  Rows
    are counted where they were written.  Tables are named by a new prefix, so
    extracts don't meet.
    """
    missing = sorted(set(allow) - set(tables))
    if missing:
        raise ValueError(f"missing tables: {missing}")
    spark = next(iter(tables.values())).sparkSession
    folder, mark = folder or landing_folder(spark), uuid.uuid4().hex[:12]
    names, counts = {}, []
    for t, keys in allow.items():
        names[t] = f"extract_{mark}_{t}"
        dealt = tables[t].repartition(buckets, *keys)
        dealt.write.mode("overwrite").format("parquet").option("path", f"{folder}/{t}").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(names[t])
        counts.append(spark.table(names[t]).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), F.lit(True).alias("published"), "rows"))
    left_out = spark.createDataFrame([(t, False, None) for t in sorted(set(tables) - set(allow))], "table_name string, published boolean, rows long")
    for one in counts:
        left_out = left_out.unionByName(one)
    return Extract(names, left_out, spark)
