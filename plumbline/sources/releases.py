"""Releases as slices: what belongs to one release is one folder of each table, which a second run of the release replaces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from .sinks import release_manifest

RELEASE = re.compile(r"release_\d{4}_\d{2}_\d{2}_\d{3}")
TABLES = ("manifest", "validation", "data_quality_log")


def replace_release(df: DataFrame, path: str, release_id: str) -> None:
    """Make df the whole of a release's slice; also where df has no rows, so nothing of an earlier run is left."""
    if not RELEASE.fullmatch(release_id):
        raise ValueError(f"no release id: {release_id}")
    df.drop("release_id").write.mode("overwrite").parquet(f"{path}/release_id={release_id}")


def validation_summary(log: DataFrame) -> DataFrame:
    """severity, findings, checks of a log, for each severity there is; without findings of a severity, zeros."""
    every = log.sparkSession.createDataFrame([("error",), ("warning",), ("info",)], "severity string")
    found = log.groupBy("severity").agg(F.count("*").alias("findings"), F.count_distinct("check_id").alias("checks"))
    return every.join(found, "severity", "left").fillna(0, ["findings", "checks"])


def write_release(base: str, release_id: str, tables: dict[str, DataFrame], found: DataFrame, loaded: DataFrame | None = None) -> None:
    """Write a release's manifest, log and validation summary under base.

    found are the findings of this run's checks, loaded those of the loaders.
    If no loaders ran, the release's earlier load-time findings stay, while
    those of its checks are replaced.
    """
    spark = found.sparkSession
    kept = loaded if loaded is not None else load_time_findings(spark, base, release_id, found)
    log = found.unionByName(kept.select(found.columns)) if kept is not None else found
    replace_release(log, f"{base}/next_log", release_id)  # the old slice is read while the new one is written
    log = spark.read.schema(found.schema).parquet(f"{base}/next_log/release_id={release_id}")
    replace_release(log, f"{base}/data_quality_log", release_id)
    replace_release(validation_summary(log), f"{base}/validation", release_id)
    replace_release(release_manifest(tables, release_id), f"{base}/manifest", release_id)


def load_time_findings(spark: SparkSession, base: str, release_id: str, like: DataFrame) -> DataFrame | None:
    """What the loaders found in an earlier run of the release; none if there was no run."""
    path = f"{base}/data_quality_log/release_id={release_id}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(like.schema).parquet(path).where(F.col("check_id").isin(*quality.LOAD_TIME))


def read_releases(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The slices of all releases, with their release_id."""
    if table not in TABLES:
        raise ValueError(f"no table of releases: {table}")
    return spark.read.option("basePath", f"{base}/{table}").parquet(f"{base}/{table}").withColumn("release_id", F.col("release_id").cast("string"))


def source_fingerprints(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Per source of the registry (source_id, folder): artifacts, bytes, digest; files of no source have a null source_id.

    folder is the first folder below path that a source's files lie in.  The
    digest is made of the sorted SHA-256 of the files, so it changes with any of
    them, but not with their names, order or times; a source without files has 0
    artifacts and no digest.  Digests are sorted within 4,096 groups by their
    first letters, so no task holds all of a source.
    """
    root = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.regexp_extract("path", f"/{root}/([^/]+)/", 1).alias("folder"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    named = files.join(registry.select("folder", "source_id"), "folder", "left")
    parts = named.groupBy("source_id", F.substring("sha256", 1, 3).alias("group")).agg(F.count("*").alias("artifacts"), F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("sha256"))).cast("binary"), 256).alias("part"))
    whole = parts.groupBy("source_id").agg(F.sum("artifacts").alias("artifacts"), F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("group", "part"))), lambda x: x["part"])).cast("binary"), 256).alias("digest"))
    listed = registry.select("source_id").join(whole, "source_id", "left").unionByName(whole.where("source_id is null"))
    return listed.fillna(0, ["artifacts", "bytes"]).select("source_id", "artifacts", "bytes", "digest")
