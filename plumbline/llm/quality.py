"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - weights . features): one vector of
weights for all grades, thresholds in order.  Features are shares of a text's
tokens, by the hash of their word and of their shape, and a few hashed facts on
the whole text, so a text's score is a mean over tokens.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chance, crc_mod, erased, written
from .tokens import process_memory

#: Hash slots, strength of the penalty, steps.
SLOTS, PENALTY, STEPS = 1 << 13, 1e-4, 250
#: Labelled rows that the model is fitted on, about, and features that they hold together, at most: what reaches the driver.
SAMPLE, FEATURES = 20_000, 1_500_000
#: Shares are small numbers; this brings them to the size of the other features.
SCALE = 8.0


def slot(text: str) -> int:
    return zlib.crc32(text.encode()) & (SLOTS - 1)


def shape(token: str) -> str:
    out = ""
    for c in token:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if not out.endswith(k) and not out.endswith(k + "+"):
            out += k
        elif not out.endswith("+"):
            out += "+"
    return out[:12]


def token_slots(token: str) -> tuple[int, int]:
    return slot("w " + token.lower()), slot("s " + shape(token))


def text_facts(tokens: list[str]) -> list[int]:
    n = len(tokens)
    again = sum(map(str.__eq__, tokens, tokens[1:])) if n > 1 else 0
    return [slot(f"n {int(math.log2(n + 1))}"), slot(f"u {int(10 * len(set(tokens)) / n) if n else -1}"), slot(f"r {int(10 * again / n) if n else -1}")]


def features(text: str, known: dict) -> dict[int, float]:
    tokens = text.split()
    out: dict[int, float] = {}
    share = SCALE / max(len(tokens), 1)
    for t in tokens:
        got = known.get(t)
        if got is None:
            got = known[t] = token_slots(t)
        for s in got:
            out[s] = out.get(s, 0.0) + share
    for s in text_facts(tokens):
        out[s] = out.get(s, 0.0) + 1.0
    return out


class Ordinal:
    """Fits weights and thresholds for grades 0 to top on sparse rows (begin of each row, slots, values)."""

    def __init__(self, begins: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, top: int):
        n = len(y)
        row = np.repeat(np.arange(n), np.diff(np.r_[begins, len(at)]))
        share = np.array([(y <= k).mean() for k in range(top)])
        cuts = np.log((share + 1e-3) / (1 - share + 1e-3))
        params = np.r_[np.zeros(SLOTS), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))]
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            w, theta = params[:SLOTS], self.thresholds(params[SLOTS:])
            score = np.bincount(row, value * w[at], n)
            upper = np.where(y < top, self.sigmoid(np.r_[theta, 0.0][y] - score), 1.0)
            lower = np.where(y > 0, self.sigmoid(np.r_[0.0, theta][y] - score), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = np.where(y < top, upper * (1 - upper), 0.0) / p, np.where(y > 0, lower * (1 - lower), 0.0) / p
            g_score = (du - dl) / n  # of the loss, by score
            g_theta = np.array([-(du[y == k].sum()) + dl[y == k + 1].sum() for k in range(top)]) / n
            g = np.r_[np.bincount(at, value * g_score[row], SLOTS) + PENALTY * w, g_theta.sum(), g_theta[::-1].cumsum()[::-1][1:] * np.exp(params[SLOTS + 1 :])]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            params -= 0.1 * (1 - step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.theta = params[:SLOTS], self.thresholds(params[SLOTS:])

    @staticmethod
    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    @staticmethod
    def thresholds(raw: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])


def fit(docs: DataFrame, grades: DataFrame, id_col: str, text_col: str, grade_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from a sample of graded rows that aren't held out; the lower median counts for ids graded often."""
    one = grades.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.percentile_approx(F.col(grade_col), 0.5).cast("int").alias("y"))
    one = one.where(crc_mod("id", 4) != 2)
    n, top = one.agg(F.count("*"), F.max("y")).first()
    if not n or not top:
        return np.zeros(SLOTS), np.zeros(top or 1)
    sample = one.where(chance(SAMPLE / n, 11, "id"))

    def run(batches):
        known = {}
        for batch in (b.slice(begin, 200) for b in batches for begin in range(0, b.num_rows, 200)):
            if len(known) > 200_000:
                known.clear()
            got = [features(t or "", known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array([len(g) for g in got], pa.int64()), pa.array([np.fromiter(g, np.int32).tobytes() for g in got], pa.binary()), pa.array([np.fromiter(g.values(), np.float32).tobytes() for g in got], pa.binary())], ["y", "h", "n", "at", "value"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").select("id", "text", "y", F.xxhash64("id", "text").alias("h"))
    ready = written(rows.mapInArrow(run, "y int, h long, n long, at binary, value binary"), "features")
    order = sorted((r["h"], r["n"]) for r in ready.select("h", "n").collect())  # two numbers for each of about SAMPLE rows
    held, last = 0, None
    for h, n in order:
        held += n
        if held > FEATURES:
            break
        last = h
    got = ready.where(F.col("h") <= last).select("y", "at", "value").collect() if last is not None else []
    erased(ready)
    if not got:
        return np.zeros(SLOTS), np.zeros(top)
    got.sort(key=lambda r: (r["y"], r["at"], r["value"]))
    at = [np.frombuffer(r["at"], np.int32) for r in got]
    begins = np.cumsum([0, *map(len, at)])[:-1]
    model = Ordinal(begins, np.concatenate(at), np.concatenate([np.frombuffer(r["value"], np.float32) for r in got]).astype(float), np.array([r["y"] for r in got]), top)
    return model.weights, model.theta


def grade_quality(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", at_least: int = 1, threshold: float = 0.5) -> DataFrame:
    """Per row: id, held_out, expected_grade, tail_probability (of at_least or more), keep (tail_probability >= threshold).

    grades: id and whole numbers from 0.  Rows whose crc32(id) mod 4 is 2 are
    held out: their grades are not read.  Null and empty texts have no tokens,
    texts of any length all of theirs; repeated rows and ties stay and have the
    same score; an empty table gives no rows; without at least two grades every
    weight is 0.  Columns other than the two are not read, so their names don't
    matter.  The driver holds at most FEATURES features of about SAMPLE rows.
    """
    weights, theta = fit(docs, grades, id_col, text_col, grade_col)
    shared, run_id = docs.sparkSession.sparkContext.broadcast((weights, theta)), uuid.uuid4().hex

    def run(batches):
        weights, theta = shared.value
        known = process_memory(("quality", run_id))
        for batch in batches:
            scores = []
            for t in batch.column(2).to_pylist():
                tokens = (t or "").split()
                if len(known) > 300_000:
                    known.clear()
                for w in set(tokens):
                    if w not in known:
                        a, b = token_slots(w)
                        known[w] = float(weights[a] + weights[b])
                mean = SCALE * sum(map(known.__getitem__, tokens)) / len(tokens) if tokens else 0.0
                scores.append(mean + sum(float(weights[s]) for s in text_facts(tokens)))
            above = 1 - Ordinal.sigmoid(theta[None] - np.array(scores, float)[:, None])  # P(grade > k)
            tail = above[:, at_least - 1] if 0 < at_least <= len(theta) else np.full(len(scores), float(at_least <= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(above.sum(1)), pa.array(tail)], ["id", "held_out", "expected_grade", "tail_probability"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), crc_mod(id_col, 4).eqNullSafe(2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = given.mapInArrow(run, f"id {kind}, held_out boolean, expected_grade double, tail_probability double")
    return out.withColumnRenamed("id", id_col).withColumn("keep", F.col("tail_probability") >= threshold)
