"""Best-fit packing of token sequences by patterns of few documents.

One pass over the texts makes the pieces; only their lengths matter after
that.  The histogram of lengths (at most `size` numbers) goes to the driver.
There, patterns of up to three lengths that fill a sequence exactly are
enumerated, repeat counts are fitted to the histogram by non-negative least
squares, rounded, and what is left over is packed best-fit into holes and new
sequences, still as counts by length.  The plan that comes out says, for the
r-th piece of a length, its sequence and its place there; pieces find their
rank by counting in their own task and adding the counts of earlier tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import VOCABULARY, TextCoder, text_blocks

SIZE = 2048
#: The share of the fitted repeats that is used; the rest leaves lengths of all kinds for the best-fit step.
FITTED = 0.8


def exact_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All of one, two or three of the lengths, largest first, that add up to size; 0 fills up."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    out = [np.array([[size, 0, 0]], np.int32)] if there[size] else []
    for a in np.flatnonzero(there)[::-1]:
        rest = size - int(a)
        if 0 < rest <= a and there[rest]:
            out.append(np.array([[a, rest, 0]], np.int32))
        b = np.arange((rest + 1) // 2, min(int(a), rest - 1) + 1)
        c = rest - b
        good = there[b] & there[c] & (c > 0)
        if good.any():
            out.append(np.stack([np.full(good.sum(), a), b[good], c[good]], 1).astype(np.int32))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int32)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that make sum over lengths of (A x - h)^2 / h least.

    Multiplicative steps keep x non-negative and never raise that sum.
    """
    h = np.maximum(histogram.astype(float), 1e-9)
    h[0] = 1.0
    width = (patterns > 0).sum(1).astype(float)
    x = h[patterns].min(1, where=patterns > 0, initial=np.inf) / 100
    for _ in range(rounds):
        made = sum(np.bincount(patterns[:, k], x, len(h)) for k in range(3)) / h
        made[0] = 0
        x *= width / np.maximum(made[patterns].sum(1), 1e-12)
    return x


def round_repeats(patterns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole counts whose running sums stay within one of those of FITTED * x."""
    run = np.floor(np.cumsum(x * FITTED) + 0.5).astype(np.int64)
    return np.diff(run, prepend=0)


def plan(histogram: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """From counts by length (index 0 to size): keys (length << 40 | first rank), first sequence, offset; sequences in all.

    The entry with the greatest key not above (length << 40 | rank) tells:
    sequence = first sequence + rank - first rank, and the offset.
    """
    histogram = histogram.astype(np.int64)
    patterns = exact_patterns(np.flatnonzero(histogram), size)
    counts = round_repeats(patterns, fit_repeats(patterns, histogram)) if len(patterns) else np.zeros(0, np.int64)
    left = histogram.copy()
    groups: list[tuple[int, tuple[int, ...]]] = []  # how many sequences, their lengths
    open_: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]  # by free room
    room = 0  # bit f is set where open_[f] is not empty

    def put(n: int, held: tuple[int, ...], free: int) -> None:
        nonlocal room
        if n <= 0:
            return
        if free and free < size:
            open_[free].append((n, held))
            room |= 1 << free
        elif held:
            groups.append((n, held))

    for row, n in zip(patterns[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
        parts, done = [k for k in row if k], 0
        while done < n:  # runs of repeats for which the same lengths are still there
            want = {k: parts.count(k) for k in parts}
            whole = min(left[k] // m for k, m in want.items())
            if not whole:
                break
            take, held = int(min(n - done, whole)), tuple(parts)
            for k in held:
                left[k] -= take
            put(take, held, size - sum(held))
            done += take
    for k in range(size, 0, -1):
        while (n := int(left[k])) > 0:
            fits = room >> k
            if fits:
                free = k + (fits & -fits).bit_length() - 1
                m, held = open_[free].pop()
                if not open_[free]:
                    room &= ~(1 << free)
                take = min(m, n)
                put(m - take, held, free)
                put(take, (*held, k), free - k)
            else:
                each = min(size // k, n)
                take = n // each * each
                put(n // each, (k,) * each, size - k * each)
            left[k] -= take
    for free in range(1, size):
        groups += open_[free]
    rows, first = [], 0
    seen = np.zeros(size + 1, np.int64)
    for n, held in groups:
        offset = 0
        for k in held:
            rows.append((k << 40 | int(seen[k]), first, offset))
            seen[k] += n
            offset += k
        first += n
    rows.sort()
    assert (seen == histogram).all(), "the plan holds every piece once"
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), first


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = SIZE) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32; task and rank tell the pieces of one length in a task apart.

    A document is its ids and a 0; one of over `size` ids is cut into pieces of
    `size`, of which the first may be shorter.
    """
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        coder = TextCoder(vocabulary)
        seen = [0] * (size + 1)
        end = b"\0\0\0\0"
        for batch in batches:
            at, piece, start, length, crc, rank = [], [], [], [], [], []
            for begin, texts in text_blocks(batch.column(1)):
                for row, found in enumerate(coder.ids(texts), begin):
                    ids = found.astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    where, k = 0, 0
                    while where < n:
                        m = (n - where) % size or size
                        at.append(row)
                        piece.append(k)
                        start.append(where)
                        length.append(m)
                        crc.append(zlib.crc32(ids[4 * where : 4 * (where + m)]))
                        rank.append(seen[m])
                        seen[m] += 1
                        where, k = where + m, k + 1
            ids_of_rows = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of_rows, pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array([task] * len(at), pa.int32()), pa.array(rank, pa.int64())], ["id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = SIZE) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id 0.  Repeated rows, also with one id,
    are documents of their own.  An empty table gives no rows.  Only the id and
    the text are read, so other columns may have any name.

    The driver holds `size` counts and a plan of at most a few hundred thousand
    rows, whatever the number of documents; tasks get the plan as a broadcast.
    """
    spark = docs.sparkSession
    made = written(pieces(docs, id_col, text_col, vocabulary, size), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[r["length"]] = r["n"]
    keys, firsts, offsets, _ = plan(histogram, size)
    shared = spark.sparkContext.broadcast((keys, firsts, offsets))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))

    def place(batches):
        keys, firsts, offsets = shared.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            i = np.searchsorted(keys, length << 40 | rank, "right") - 1
            sequence = firsts[i] + rank - (keys[i] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offsets[i])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = made.join(before, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    out = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
