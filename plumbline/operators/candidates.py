"""Pairs of alike names without comparing all with all: an index over words and character pairs, by bounds that token_set_ratio obeys.

With a threshold t, two names of lengths m and n (sorted words, single blanks)
that reach it do so in one of two ways:

* Common words make up most of one of them: at least t / (200 - t) of its
  length.  Then one of its rarest words, as many as the rest may weigh and one
  more, is a word of the other.
* The joined words are alike: a common subsequence of at least t (m + n) / 200
  characters.  What is left out of one name spoils at most two of its character
  pairs, what is left out of the other at most one, so enough pairs are common,
  and one of the rarest of either is among the rarest of the other.  Where that
  bound asks for no common pair at all (short names, low thresholds), names of
  fitting lengths meet.

Every pair found is then scored, so the answer is that of comparing all.

Words and pairs of characters are many times the names that their files hold,
so no side of a join is broadcast by the size of those files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import let, name_words, token_set_ratio
from ..sources.sinks import settled


def _lost(most: int, least: float) -> list[int]:
    """For each length up to most: how many character pairs of such a name may have no partner in one that is alike."""
    share, out = least / 200, [0]
    for m in range(1, most + 1):
        worst = 0
        for n in range(math.ceil(m * least / (200 - least) - 1e-9), math.floor(m * (200 - least) / least + 1e-9) + 1):
            common = math.ceil(share * (m + n) - 1e-9)
            worst = max(worst, 2 * (m - common) + (n - common)) if common <= min(m, n) else worst
        out.append(worst)
    return out


def _pairs_of_characters(words: Column) -> Column:
    """Each two neighbours inside a word, numbered where they repeat."""
    two = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2))))
    return let(F.array_sort(two), lambda s: F.transform(s, lambda g, i: F.concat(g, F.lit("#"), (i + 2 - F.array_position(s, g)).cast("string"))))


def _profiles(names: DataFrame, name: str) -> DataFrame:
    """block, name, words, size of the joined words, grams; names without words are alike to nothing."""
    words = names.select("block", F.col(name).alias("name"), name_words(F.col(name)).alias("words")).where(F.size("words") > 0).distinct()
    return words.withColumns({"size": F.length(F.array_join("words", " ")), "grams": _pairs_of_characters(F.col("words"))})


def _ranked(left: DataFrame, right: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """The exploded words or grams of both sides with how many names have each."""
    one = left.select("block", "name", "size", F.explode(what).alias("key"))
    other = right.select("block", "name", "size", F.explode(what).alias("key"))
    n = one.select("block", "key").unionByName(other.select("block", "key")).groupBy("block", "key").agg(F.count("*").alias("n"))
    return one.join(n.hint("merge"), ["block", "key"]), other.join(n.hint("merge"), ["block", "key"])


def _rarest(keys: DataFrame, weight: Column, spare: Column) -> DataFrame:
    """The rarest keys of each name, until those before weigh more than spare."""
    order = Window.partitionBy("block", "name").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1)
    return keys.withColumn("before", F.coalesce(F.sum(weight).over(order), F.lit(0))).where(F.col("before") <= spare).select("block", "name", "size", "key")


def candidate_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """block, l_name, r_name of all pairs that may reach `least` (over 0, under 100), once each, and a share of those that don't."""
    a, b = settled(_profiles(left, "l_name"), "names"), settled(_profiles(right, "r_name"), "names")
    cover = least / (200 - least)
    # what doesn't belong to the common words may weigh (1 - cover) of the name; a little more for rounding
    spare = F.col("size") * (1 - cover) + 1e-9
    met = lambda x, y: x.withColumnRenamed("name", "l_name").withColumnRenamed("size", "l_size").join(y.select("block", F.col("name").alias("r_name"), F.col("size").alias("r_size"), "key").hint("merge"), ["block", "key"])
    words_a, words_b = _ranked(a, b, "words")
    weight = F.length("key") + 1
    covered = met(_rarest(words_a, weight, spare), words_b).unionByName(met(words_a.drop("n"), _rarest(words_b, weight, spare))).select("block", "l_name", "r_name").distinct()
    # alike as texts
    most = a.select("size").unionByName(b.select("size")).agg(F.max("size")).first()[0] or 0
    lost = F.array(*map(F.lit, _lost(most, least))) if most <= 500 else F.transform(F.sequence(F.lit(0), F.lit(most)), lambda m: F.ceil(2 * m * (1 - cover) + 3).cast("int"))
    fits = (F.col("r_size") <= F.col("l_size") / cover + 1e-9) & (F.col("l_size") <= F.col("r_size") / cover + 1e-9)
    x, y = (p.withColumn("lost", F.element_at(lost, F.col("size") + 1)) for p in (a, b))
    sure = F.size("grams") > F.col("lost")
    grams_a, grams_b = _ranked(x.where(sure), y.where(sure), "grams")
    spared = F.element_at(lost, F.col("size") + 1)
    texts = met(_rarest(grams_a, F.lit(1), spared), _rarest(grams_b, F.lit(1), spared)).where(fits).select("block", "l_name", "r_name").distinct()
    # of the characters that stand in two names' rarest pairs, enough have to be common
    g = lambda p, side: p.select("block", F.col("name").alias(f"{side}_name"), F.col("grams").alias(f"{side}_grams"), F.col("size").alias(f"{side}_size"))
    common = F.size(F.array_intersect("l_grams", "r_grams"))
    needed = let(F.ceil(F.lit(least / 200) * (F.col("l_size") + F.col("r_size")) - 1e-9), lambda k: F.greatest(F.size("l_grams") - 2 * (F.col("l_size") - k) - (F.col("r_size") - k), F.size("r_grams") - 2 * (F.col("r_size") - k) - (F.col("l_size") - k)))
    texts = texts.join(g(a, "l").hint("merge"), ["block", "l_name"]).join(g(b, "r").hint("merge"), ["block", "r_name"]).where(common >= needed).select("block", "l_name", "r_name")
    # too short for a pair of characters to be sure
    span = lambda c: F.sequence(F.ceil(c * cover - 1e-9), F.floor(c / cover + 1e-9))
    ends = lambda p, side: p.select("block", F.col("name").alias(f"{side}_name"), F.col("size"))
    short_a = ends(x.where(~sure), "l").withColumn("at", F.explode(span(F.col("size")))).drop("size")
    short_b = ends(y.where(~sure), "r").withColumn("at", F.explode(span(F.col("size")))).drop("size")
    short = short_a.join(ends(b, "r").withColumnRenamed("size", "at").hint("merge"), ["block", "at"]).select("block", "l_name", "r_name").unionByName(ends(a, "l").withColumnRenamed("size", "at").join(short_b.hint("merge"), ["block", "at"]).select("block", "l_name", "r_name"))
    return covered.unionByName(texts).unionByName(short).distinct()


def alike_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """block, l_name, r_name, like: all pairs of a block's distinct names whose token_set_ratio is at least `least`.

    left has block and l_name, right block and r_name.  Null names and names
    without words are alike to nothing; a null block meets no other.
    """
    # scoring is dear and pairs are small, so they are dealt to a fixed number of tasks, not to as few as their bytes would fill
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = candidate_pairs(left, right, least).repartition(tasks, "block", "l_name", "r_name")
    like = token_set_ratio(F.col("l_name"), F.col("r_name"))
    return some.select("block", "l_name", "r_name", F.explode(F.filter(F.array(like), lambda x: x >= least)).alias("like"))  # scored once
