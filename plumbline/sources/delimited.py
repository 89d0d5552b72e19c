"""Delimited files, all columns as strings; measures are cast afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trimmed(df: DataFrame) -> DataFrame:
    """Headers and values without surrounding blanks and byte-order marks."""
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.replace("﻿", "").strip()) for c in df.columns])


def sniff(spark: SparkSession, path: str) -> str:
    """Pipe if the header has more pipes than tabs, else tab; one line is read."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0]["value"] if head else ""
    return "|" if line.count("|") > line.count("\t") else "\t"


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    return trimmed(spark.read.option("header", True).option("encoding", encoding).option("sep", sep or sniff(spark, path)).option("inferSchema", False).csv(path))


def read_yearly_csv(spark: SparkSession, path: str, year_regex: str = r"([0-9]{4})[^/]*$") -> DataFrame:
    """The union of files of several years, with the year that year_regex finds in each file's path (in its name, if not told)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("file_year", F.regexp_extract(F.col("_metadata.file_path"), year_regex, 1).try_cast("int"))
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.replace("\ufeff", "").strip()) if c != "file_year" else F.col(c) for c in df.columns])


def pad_codes(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    from ..functions.codes import pad

    return df.withColumns({c: pad(F.col(c), w) for c, w in widths.items()})
