"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    A session on one machine (master local) that names none gets a temporary
    folder; any other is an error, for its executors couldn't read such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erased(*tables: DataFrame) -> None:
    """Delete the tables (results of written) that the frames read; nothing may read them afterwards."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the value's text, modulo n; null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def chance(share: float, seed: int, *columns: str) -> Column:
    """True for about this share of rows, told by a hash of the columns; fine enough for any number of rows."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 1) < F.lit(int(share * 2**63))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hot_values(df: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """The keys of an already grouped df (one row a key, `weight` rows each) that hold over HOT_SHARE of the rows.

    At most 1 / HOT_SHARE rows come out, whatever the input, so the result may be broadcast.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0
    return df.where(F.col(weight) > max(total * HOT_SHARE, 100)).select(*keys)
