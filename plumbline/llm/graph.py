"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, erased, written


#: Edges that one task may hold: it gives out what it has beyond that, and so few are settled by one task.
HELD = 400_000


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, at most one fewer than nodes from each task: later steps carry less."""
    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        held = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    held += 1
            if held > HELD:  # what a task holds stays bounded: give out what is known so far and start anew
                yield flat(root, find)
                root, held = {}, 0
        yield flat(root, find)

    def flat(root, find):
        nodes = list(root)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def with_least(rows: DataFrame, total: int, own: bool) -> tuple[DataFrame, DataFrame]:
    """rows (a, b) with m, the least b of each a (own: or a itself), and the table of a and m.

    A star's centre may hold any share of the rows, so its m is not joined by
    key: the few centres of over HOT_SHARE of `total` rows are broadcast.
    """
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", (F.least("a", "m") if own else F.col("m")).alias("m"), "n")
    hot = F.broadcast(least.where(F.col("n") > max(total * HOT_SHARE, 100)).select("a", F.col("m").alias("hot")))  # at most 2 / HOT_SHARE rows
    marked = rows.join(hot, "a", "left")
    cold = marked.where(F.col("hot").isNull()).select("a", "b").join(least.select("a", "m"), "a")
    return marked.where(F.col("hot").isNotNull()).select("a", "b", F.col("hot").alias("m")).unionByName(cold), least.select("a", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of an edge; rounds of stars until nothing changes.

    Each round links every node to the smallest node around it: first for
    larger neighbours, then for smaller ones.  Once no more than HELD edges are
    left, one task settles them all.  The counts of rows are all that reaches
    the driver.
    """
    def stars(found: DataFrame) -> DataFrame:
        roots = found.select(F.col("b").alias("node")).distinct()
        return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))

    now = written(forest(edges).where("a <> b"), "edges")
    while True:
        total = now.count()
        if total <= HELD:
            last = written(forest(now.coalesce(1)), "edges")
            erased(now)
            return stars(last)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node go to the smallest one around it
        around, _ = with_least(both, total, True)
        larger = around.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        down, low = with_least(larger.where("a > b").distinct(), total, False)
        star = down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = written(star, "edges")
        erased(now)
        # done when each node has one edge and no node of the left side is on the right side
        left = after.select("a")
        many = after.groupBy("a").count().where("count > 1").limit(1).count()
        chain = 0 if many else after.select(F.col("b").alias("a")).distinct().join(left, "a", "left_semi").limit(1).count()
        if not many and not chain:
            return stars(after)
        now = after


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """left join right on keys, where right has one row a key and `hot` (keys; bounded) names keys that crowd the left side.

    Hot keys meet a broadcast of their right rows, all others the usual join.
    """
    mark = hot.select(*keys).distinct().withColumn("_hot", F.lit(True))
    tagged = left.join(F.broadcast(mark), keys, "left")
    some = right.join(F.broadcast(mark), keys, "left_semi")
    a = tagged.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(some), keys, how)
    b = tagged.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, how)
    return a.unionByName(b)
