"""Writers: declared tables, slices, allow-listed extracts, exports, manifests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landing_folder(spark: SparkSession) -> str:
    """A new folder for files that driver and executors share: in the session's spark.checkpoint.dir, on one machine else a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/landing-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """df, computed once: written to a shared folder and read back; survives lost executors."""
    path = f"{landing_folder(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, schema: StructType, mode: str = "overwrite") -> None:
    """Exactly the declared columns, cast to their types; another set of columns is an error."""
    if sorted(df.columns) != sorted(schema.names):
        raise ValueError(f"columns {df.columns} are not {schema.names}")
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode(mode).parquet(path)


def replace_slice(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Replace the partitions that df has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def publish(tables: dict[str, DataFrame], allow: Sequence[str], out: str, sort: Sequence[str] = ("entity_id", "data_year")) -> DataFrame:
    """Write the allow-listed tables, all of which must be there: table, rows, and what was left out."""
    missing = [t for t in allow if t not in tables]
    if missing:
        raise ValueError(f"missing tables: {missing}")
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for t in allow:
        by = [c for c in sort if c in tables[t].columns]
        df = tables[t].sortWithinPartitions(*by) if by else tables[t]
        df.write.mode("overwrite").parquet(f"{out}/{t}")
        rows.append((t, True, spark.read.parquet(f"{out}/{t}").count()))
    rows += [(t, False, None) for t in sorted(set(tables) - set(allow))]
    return spark.createDataFrame(rows, "table string, published boolean, rows long")


def export_csv(df: DataFrame, allowed: dict[str, str], out: str, notes: dict[str, str]) -> None:
    """CSV whose rates (rate column: flag column) are null where withheld, and a manifest of notes beside it."""
    spark = df.sparkSession
    df.withColumns({rate: F.when(F.col(flag), F.col(rate)) for rate, flag in allowed.items()}).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(f"{out}/data")
    spark.createDataFrame(sorted(notes.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(f"{out}/manifest")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "modificationTime")


def release_manifest(tables: dict[str, DataFrame], release_id: str) -> DataFrame:
    """Rows of each table, counted where they are."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(release_id).alias("release_id"), F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def next_release_id(existing: Sequence[str], day: str) -> str:
    """release_YYYY_MM_DD_NNN, numbered on from those of the day."""
    base = f"release_{day.replace('-', '_')}_"
    taken = [int(r[len(base) :]) for r in existing if r.startswith(base) and r[len(base) :].isdigit()]
    return f"{base}{max(taken, default=0) + 1:03d}"


def dictionary_columns(df: DataFrame, least: int = 64, share: float = 1 / 200) -> DataFrame:
    """column_name, n_distinct and coded for each string column: few enough distinct values for a dictionary.

    One aggregate over the table; Parquet's writer then encodes such columns by itself.
    """
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    counts = df.agg(F.count("*").alias("_rows"), *(F.count_distinct(c).alias(c) for c in strings))
    found = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct")) for c in strings))).alias("x")
    return counts.select("_rows", found).select("x.*", (F.col("x.n_distinct") <= F.greatest(F.lit(float(least)), F.col("_rows") * share)).alias("coded"))


def export_bundle(tables: dict[str, DataFrame], log: DataFrame, out: str, most: int = 200) -> None:
    """Each table as Parquet, sorted for its readers, and the log's first `most` rows of each check."""
    w = Window.partitionBy("check_id").orderBy(F.desc_nulls_last("data_year"), "entity_id", "observed")
    some = log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    for name, df in {**tables, "data_quality_log": some}.items():
        by = [c for c in ("entity_id", "data_year") if c in df.columns]
        (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(f"{out}/{name}")
