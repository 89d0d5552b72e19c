"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame; all but the last keep the columns of docs.

docs has the columns of `documents` (doc_id, text, lang, source, n_chars), and
may have more.  Every row is judged by itself, whatever its id: rows with null
ids, with one id and different texts, and repeated rows go through every stage.
Null and empty texts are clean, copies of nothing, and become one token each.
An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written
from .decontamination import decontaminate
from .jaccard import jaccard_join
from .packing import pack
from .pii import automaton, find, redact, KINDS
from .toxicity import score_toxicity


def kept(docs: DataFrame, judge: Callable[[DataFrame, list[str]], DataFrame], condition: str) -> DataFrame:
    """The rows of docs whose judgement meets the condition; judge(docs, columns to carry along) may give columns of any names."""
    carried = {c: c if c in ("doc_id", "text") else f"carried_{k}" for k, c in enumerate(docs.columns)}
    given = docs.select(*(F.col(c).alias(x) for c, x in carried.items()))
    return judge(given, [x for x in carried.values() if x != "doc_id"]).where(condition).select(*(F.col(x).alias(c) for c, x in carried.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose toxicity score is 0.3 or more."""
    labels = table(spark, sf_dir, "labels")
    return kept(docs, lambda given, carried: score_toxicity(given, labels, keep=carried), "predicted = 0")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that with the smallest id, null ids last (five-word shingles, Jaccard 0.8).

    Rows are told apart by a number of their own, so of rows repeated under one id, or without any, one stays too.
    """
    (row,) = fresh(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_join(rows, id_col=row, k=5, percent=80)
    ranked = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    return rows.join(ranked.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold ten consecutive words of a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return kept(docs, lambda given, carried: decontaminate(given, benchmark, keep=carried), "NOT contaminated")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, <email> for example; n_chars follows the text."""
    def run(batches):
        a = automaton()
        for batch in (b.slice(begin, 1000) for b in batches for begin in range(0, b.num_rows, 1000)):
            k = batch.schema.get_field_index("text")
            out = []
            for t in batch.column(k):
                t = t.as_py()
                if t:
                    marks = [{"kind": KINDS[x], "begin": b, "until": e} for b, x, e in find(t, a)[1]]
                    t = redact(t, marks) if marks else t
                out.append(t)
            yield batch.set_column(k, "text", pa.array(out, pa.string()))

    clean = docs.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in packed sequences."""
    return pack(docs)
