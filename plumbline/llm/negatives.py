"""Hard negatives by maximum inner product search in cover trees.

Every piece of the candidates (PIECE rows) has a cover tree.  Vectors get one
more component that brings all of a piece to one norm, so they lie on a sphere
and the order of inner products is the order of distances.  Nodes of a level
cover their points by a radius half of the level above; the angle between query
and centre, with the angle that the radius spans, bounds the inner products of
all points below from both sides.  The descent takes the node with the greatest
upper bound first, leaves out what lies outside all windows or below what is
found already, and scores the points of leaves exactly, as integers.

Where vectors fill their space evenly, a ball holds hardly more than its
centre; a node whose balls would hold fewer than FEW points on average stays a
leaf, so building a tree never costs all pairs of points.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows with one cover tree; one task holds a piece's vectors, as doubles.
PIECE = 65_536
#: Points that a node keeps without balls of its own.
LEAF = 64
#: Points that a ball has to hold on average, judged after every 64 balls.
FEW = 8
#: Share of a bound that rounding may cost.
SLACK = 1e-9
#: Integers up to this are exact as doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


class CoverTree:
    """vectors: integers as doubles, one row each.  Nodes are ranges of the reordered points with a centre and the angle that covers them."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.sphere = float(self.norms.max(initial=0.0))
        lifted = np.c_[vectors, np.sqrt(np.maximum(self.sphere**2 - self.norms**2, 0))] / (self.sphere or 1.0)
        self.order = np.arange(n)
        centre, angle, begin, end, first, many = [], [], [], [], [], []

        def node(a: int, b: int, c: int, radius: float) -> int:
            for held, x in ((centre, c), (angle, 2 * math.asin(min(1.0, radius / 2))), (begin, a), (end, b), (first, 0), (many, 0)):
                held.append(x)
            return len(centre) - 1

        todo = []
        if n:
            far = float(np.linalg.norm(lifted - lifted[0], axis=1).max())
            todo = [(node(0, n, 0, far), far)]
        while todo:
            k, radius = todo.pop()
            a, b = begin[k], end[k]
            if b - a <= LEAF or radius <= 1e-6:
                continue
            parts = self.balls(lifted, self.order[a:b], centre[k], radius / 2)
            if not parts:
                continue
            at, first[k], many[k] = a, len(centre), len(parts)
            for c, mine, reach in parts:
                self.order[at : at + len(mine)] = mine
                todo.append((node(at, at + len(mine), c, reach), radius / 2))
                at += len(mine)
        self.centre, self.angle = np.array(centre, np.int64), np.array(angle)
        self.begin, self.end, self.first, self.many = (np.array(x, np.int64) for x in (begin, end, first, many))
        self.centres = vectors[self.centre] if n else vectors

    @staticmethod
    def balls(lifted: np.ndarray, points: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray, float]]:
        """Centres further than radius from one another, the points that each covers and how far these are; nothing if they cover too few."""
        left, parts, c = points, [], centre
        while len(left):
            far = np.linalg.norm(lifted[left] - lifted[c], axis=1)
            near = (far <= radius) | (left == c)
            parts.append((c, left[near], float(far[near].max())))
            left = left[~near]
            if len(left):
                c = int(left[0])
                if len(parts) % 64 == 0 and len(points) - len(left) < FEW * len(parts):
                    return []
        return parts

    def bounds(self, nodes: np.ndarray, query: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """What the inner products of each node's points with the query are at most and at least."""
        size = norm * self.sphere
        if not size:
            return np.zeros(len(nodes)), np.zeros(len(nodes))
        between = np.arccos(np.clip(self.centres[nodes] @ query / size, -1, 1))
        high = np.cos(np.maximum(between - self.angle[nodes] - 1e-7, 0))
        low = np.cos(np.minimum(between + self.angle[nodes] + 1e-7, math.pi))
        return size * high + size * SLACK, size * low - size * SLACK


class Piece:
    """A piece's rows with their tree, in its order."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, ids: pa.Array, labels: list):
        self.tree = CoverTree(vectors)
        order = self.tree.order
        self.vectors, self.rows, self.width = vectors[order], rows[order], vectors.shape[1]
        rank = np.empty(len(rows), np.int64)
        rank[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(rows))
        self.rank, self.ids = rank[order], ids.take(pa.array(order))
        self.known = {label: k for k, label in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.known[label] for label in labels], np.int64)[order]
        self.scored = 0  # points that were scored, for tests and reports

    def scores(self, a: int, b: int, query: np.ndarray, norm: float) -> np.ndarray:
        """Exact inner products, LONG or -LONG for those beyond."""
        self.scored += b - a
        if norm * self.tree.sphere < EXACT:
            return (self.vectors[a:b] @ query).astype(np.int64)
        whole = [int(x) for x in query]
        return np.array([max(-LONG, min(LONG, sum(int(x) * y for x, y in zip(v, whole, strict=True)))) for v in self.vectors[a:b]], np.int64)

    def best(self, query: np.ndarray, label, same: bool, row: int, windows: list[tuple[float, float]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, greatest score) its first k points as (score, place), greater scores first, then smaller ids.

        Points have the label, but aren't the row (same), or another label.
        """
        tree, own = self.tree, self.known.get(label, -1)
        query = np.r_[query[: self.width], np.zeros(max(0, self.width - len(query)))]
        norm = float(np.sqrt(query @ query))
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]  # score, -rank, place
        floor = [low for low, _ in windows]
        if not len(self.rows) or same and own < 0:
            return [[] for _ in windows]

        def wanted(high: float, low: float) -> bool:
            return any(high >= f and low <= top for f, (_, top) in zip(floor, windows, strict=True))

        (high,), (low,) = tree.bounds(np.zeros(1, np.int64), query, norm)
        heap = [(-high, 0, low)]
        while heap:
            high, node, low = heapq.heappop(heap)
            if -high < min(floor):
                break
            if not wanted(-high, low):
                continue
            if tree.many[node]:
                below = np.arange(tree.first[node], tree.first[node] + tree.many[node])
                for n, up, down in zip(below.tolist(), *(x.tolist() for x in tree.bounds(below, query, norm)), strict=True):
                    if wanted(up, down):
                        heapq.heappush(heap, (-up, n, down))
                continue
            a, b = int(tree.begin[node]), int(tree.end[node])
            score = self.scores(a, b, query, norm)
            right = (self.labels[a:b] == own) & (self.rows[a:b] != row) if same else self.labels[a:b] != own
            right &= (score >= min(floor)) & (score <= max(top for _, top in windows))
            at = np.flatnonzero(right)
            if not len(at):
                continue
            at = at[np.lexsort((self.rank[a:b][at], -score[at]))]
            falling = -score[at]
            for w, (least, top) in enumerate(windows):
                i, j = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -floor[w], "right")
                if mine := at[i : min(j, i + k)].tolist():
                    found[w] = heapq.nlargest(k, found[w] + [(int(score[p]), -int(self.rank[a + p]), a + p) for p in mine])
                    if len(found[w]) == k:
                        floor[w] = max(least, found[w][-1][0])
        return [[(s, place) for s, _, place in f] for f in found]


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of numbers as rows of doubles; shorter ones end with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def met(candidates: DataFrame, queries: DataFrame, pieces: int, run, schema: str) -> DataFrame:
    """run(piece, batches of queries) for each piece of the candidates and all queries; the piece's rows come first, the queries follow as a stream.

    candidates: row, id, label, v; queries: the same and `given`.
    """
    one = candidates.select(F.pmod(F.xxhash64("row"), F.lit(pieces)).alias("piece"), F.lit(0).alias("kind"), "row", "id", "label", "v", F.lit(None).cast(queries.schema["given"].dataType).alias("given"))
    all_pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long")))
    both = one.unionByName(queries.select(all_pieces.alias("piece"), F.lit(1).alias("kind"), "row", "id", "label", "v", "given"))

    def task(batches):
        at, held, piece = None, [], None
        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch.column(0).to_numpy()) | np.diff(batch.column(1).to_numpy())) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                mine, kind = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if mine != at:
                    at, held, piece = mine, [], None
                if kind == 0:
                    held.append(part)
                elif held:
                    if piece is None:
                        t = pa.Table.from_batches(held)
                        piece, held = Piece(matrix(t.column(5)), t.column(2).to_numpy(), t.column(3).combine_chunks(), t.column(4).to_pylist()), [part]
                    yield from run(piece, part)

    return both.repartition(pieces, "piece").sortWithinPartitions("piece", "kind", "row").mapInArrow(task, schema)


def first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantized(vectors: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """row, id, label, anchor and v (floor of scale times each component, as doubles) of the rows whose label and components are all there and finite."""
    good = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  doubles beyond are integers
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: whole(x * scale))
    return vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), v.alias("v"))


def mine_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors is a condition on the rows.  Components are floored after scaling,
    a score is the integer inner product with the anchor, higher scores come
    first, ties by smaller id.  An anchor's positives are its first rows of the
    same label, itself left out; for each, the negatives are the first rows of
    other labels whose score lies between least and most percent of the
    positive's (of a negative score nothing does).

    Rows with a null label or vector, or a component that is null or not
    finite, take no part.  A null id comes behind all others; repeated rows are
    rows of their own, anchors and candidates alike.  Shorter vectors count as
    ending with zeros; a score beyond +-(2^63 - 1) counts as that.  An
    empty table gives no rows, an anchor alone in its label none either.  Other
    columns aren't read, so their names don't matter.

    Candidates are dealt to pieces by a hash, so no label or group of equal
    vectors decides a piece's size; anchors pass through each piece as a
    stream.  All candidates are indexed, all answers are exact.
    """
    spark = vectors.sparkSession
    rows = written(quantized(vectors, anchors, id_col, vector_col, label_col, scale), "vectors")
    n = rows.count()
    pieces = max(1, -(-n // PIECE), min(4 * spark.sparkContext.defaultParallelism, -(-n // 512)))  # a few rows make no piece of their own
    ids = rows.schema["id"].dataType.simpleString()
    given = f"array<struct<id:{ids},row:bigint,score:bigint>>"
    candidates, asked = rows.drop("anchor"), rows.where("anchor").drop("anchor")

    def nearest(piece, part):
        out = ([], [], [])
        for row, label, query in zip(part.column(2).to_pylist(), part.column(4).to_pylist(), matrix(part.column(5)), strict=True):
            for score, place in piece.best(query, label, True, row, [(-math.inf, math.inf)], positives)[0]:
                for held, x in zip(out, (row, place, score), strict=True):
                    held.append(x)
        places = pa.array(out[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), piece.ids.take(places), pa.array(piece.rows[out[1]] if out[1] else [], pa.int64()), pa.array(out[2], pa.int64())], ["anchor", "id", "row", "score"])

    found = met(candidates, asked.withColumn("given", F.lit(None).cast(given)), pieces, nearest, f"anchor long, id {ids}, row long, score long")
    chosen = first(found, ["anchor"], positives).groupBy("anchor").agg(F.collect_list(F.struct("id", "row", "score")).alias("given"))
    queries = written(asked.join(chosen, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")

    def between(piece, part):
        out = ([], [], [], [], [])
        for row, label, query, pairs in zip(part.column(2).to_pylist(), part.column(4).to_pylist(), matrix(part.column(5)), part.column(6).to_pylist(), strict=True):
            windows = [(-(-least * p["score"] // 100), most * p["score"] // 100) for p in pairs]
            for k, places in enumerate(piece.best(query, label, False, row, windows, negatives)):
                for score, place in places:
                    for held, x in zip(out, (row, pairs[k]["row"], pairs[k]["score"], place, score), strict=True):
                        held.append(x)
        anchor, positive, own, places, score = (pa.array(x, pa.int64()) for x in out)
        yield pa.RecordBatch.from_arrays([anchor, positive, own, piece.ids.take(places), pa.array(piece.rows[out[3]] if out[3] else [], pa.int64()), score], ["anchor", "positive", "positive_score", "id", "row", "score"])

    hits = first(met(candidates, queries, pieces, between, f"anchor long, positive long, positive_score long, id {ids}, row long, score long"), ["anchor", "positive"], negatives)
    names = queries.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("given").alias("p")).select("anchor", "anchor_id", F.col("p.row").alias("positive"), F.col("p.id").alias("positive_id"))
    out = hits.join(names, ["anchor", "positive"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
