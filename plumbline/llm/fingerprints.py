"""Merkle fingerprints of documents: leaves, sections, root.  DataFrame functions only.

A text is cut behind line breaks, sentence ends and some word ends (so that a
paragraph without punctuation has several leaves too) into leaves.  A section
is a run of leaves that ends behind a leaf whose digest ends in 0, so that an
edit moves section ends near itself only.  The root is the digest of the
sections' digests and of the text's own.  A fingerprint writes the tree down:
the root, then each section's digest and its leaves' short digests.  Equal
roots say that texts are equal; else sections whose digests the other tree
lacks are descended into, and their leaves say where the texts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chance

#: Hex digits of a leaf's digest in a fingerprint.
SHORT = 6
#: Rows alike in id and text that are more than this are counted instead of dealt; and so many such groups at most.
OFTEN = 1000
#: Rows that are looked at for each bound between buckets of consecutive rows.
LOOKED_AT = 20


def leaf_digests(text: Column) -> Column:
    """Short digests of a text's leaves, in order; the empty text has one leaf."""
    parts = F.split(text, r"(?<=\n)|(?<=[nt\p{Punct}] )")
    return F.transform(parts, lambda p: F.substring(F.lpad(F.hex(F.xxhash64(p)), 16, "0"), 17 - SHORT, SHORT))


def fingerprint(text: Column, digests: Column) -> Column:
    """root:section=leaf,leaf/section=leaf,..."""
    sections = F.split(F.regexp_replace(F.array_join(digests, ","), "0,", "0/"), "/")
    branches = F.transform(sections, lambda s: F.concat(F.substring(F.sha2(s.cast("binary"), 256), 1, 16), F.lit("="), s))
    whole = F.sha2(text.cast("binary"), 256)  # short digests alone would let two texts share a root
    roots = F.array_join(F.transform(branches, lambda s: F.substring_index(s, "=", 1)), "")
    return F.concat(F.substring(F.sha2(F.concat(roots, whole).cast("binary"), 256), 1, 32), F.lit(":"), F.array_join(branches, "/"))


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct leaves over all distinct leaves of two texts."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)


def differing(a: Column, b: Column) -> Column:
    """From two fingerprints: positions (from 0) of the leaves of a that b lacks, empty where the roots agree.

    Sections that b has too are passed over whole; only the leaves of the
    others are compared, with those of b's sections that a lacks.
    """
    def digest(s):
        return F.substring_index(s, "=", 1)

    def leaves(s):
        return F.split(F.substring_index(s, "=", -1), ",")

    own, other = (F.split(F.substring_index(x, ":", -1), "/") for x in (a, b))
    own_only, other_only = F.array_except(F.transform(own, digest), F.transform(other, digest)), F.array_except(F.transform(other, digest), F.transform(own, digest))
    there = F.flatten(F.transform(F.filter(other, lambda s: F.array_contains(other_only, digest(s))), leaves))
    gone = F.flatten(F.transform(own, lambda s: F.when(F.array_contains(own_only, digest(s)), F.transform(leaves(s), lambda x: ~F.array_contains(there, x))).otherwise(F.transform(leaves(s), lambda x: F.lit(False)))))
    at = F.filter(F.sequence(F.lit(0), F.size(gone) - 1), lambda i: F.get(gone, i))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<int>")).otherwise(at)


def following_texts(docs: DataFrame, id_col: str, text_col: str, rows_a_bucket: int = 2000) -> DataFrame:
    """id, text, following (the text of the row behind by id, and of the first row for the last); times, how often the row stands, if any does more than OFTEN times.

    Ids may be of any type with an order.  Rows with one id go by a hash of
    their texts; null ids come first.  Rows are dealt into buckets of
    consecutive rows, between bounds that are quantiles of a sample of (id,
    hash), so ids may lie however they like.  Each bucket also gets the first
    row of the next one.  The texts are shuffled once; there are at most 4 *
    shuffle partitions buckets, and the driver holds LOOKED_AT rows of (id,
    hash) a bucket.  Of the rows that are alike in id and text more than OFTEN
    times (the OFTEN most frequent, if there are more) one goes on, with their
    number: all but the last are followed by themselves.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"))
    n = base.count()
    buckets = max(1, min(n // rows_a_bucket, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = base.schema["id"].dataType.simpleString()
    looked = [] if buckets == 1 else base.select("id", "h").where(chance(buckets * LOOKED_AT / max(n, 1), 5, "h", "id")).orderBy(F.asc_nulls_first("id"), "h").collect()
    step = max(1, len(looked) // buckets)
    bounds = spark.createDataFrame([([tuple(r) for r in looked[step::step]],)], f"bounds array<struct<id:{kind},h:bigint>>").scalar()
    key = F.struct("id", "h")

    def further(at, jump):  # a binary search: at bounds are known not to lie above the key
        return F.when(F.get("bounds", at + jump - 1) <= key, at + jump).otherwise(at)

    jumps = [1 << k for k in reversed(range(max(1, len(looked) // step).bit_length()))]
    bucket = F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), further)
    often = base.groupBy("id", "h").agg(F.count("*").alias("c")).where(F.col("c") > OFTEN).orderBy(F.desc("c"), "h").limit(OFTEN).collect()
    base = base.withColumn("times", F.lit(1).cast("long"))
    if often:
        listed = F.broadcast(spark.createDataFrame([(r["id"], r["h"]) for r in often], f"o_id {kind}, o_h long"))
        alike = F.col("id").eqNullSafe(F.col("o_id")) & (F.col("h") == F.col("o_h"))
        met = base.join(listed.withColumn("often", F.lit(True)), alike, "left")
        base = met.where("often is null").select(base.columns).unionByName(met.where("often").groupBy("id", "text", "h").agg(F.count("*").alias("times")))
    placed = base.withColumn("bounds", bounds).withColumn("bucket", bucket).drop("bounds")
    firsts = sorted((tuple(r) for r in placed.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("f")).select("bucket", "f.id", "f.h").collect()), key=lambda r: r[0])
    guests = spark.createDataFrame([(r[1], r[2], firsts[k - 1][0]) for k, r in enumerate(firsts)], f"g_id {kind}, g_h long, to_bucket int")
    met = placed.join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left")
    own = F.struct(F.lit(False).alias("guest"), F.col("bucket"))
    guest = F.struct(F.lit(True).alias("guest"), F.col("to_bucket").alias("bucket"))
    dealt = met.select("id", "text", "h", "times", F.explode(F.when(F.col("to_bucket").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at")).select("id", "text", "h", "times", "at.*")
    order = Window.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("id"), "h", "text")
    found = dealt.select("id", "text", "times", "guest", F.lead("text").over(order).alias("following")).where(~F.col("guest")).drop("guest")
    if not often:
        return found.drop("times")
    last = F.struct("following", F.lit(1).cast("long").alias("times"))
    own = F.struct(F.col("text").alias("following"), (F.col("times") - 1).alias("times"))
    return found.select("id", "text", F.explode(F.when(F.col("times") > 1, F.array(own, last)).otherwise(F.array(last))).alias("at")).select("id", "text", "at.*")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the row behind.  Null counts as the empty text,
    a table of one row follows itself, repeated rows stay, an empty table gives
    no rows; columns other than the two are not read.
    """
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - cut), F.substring("following", 1, cut))
    rows = following_texts(docs, id_col, text_col).withColumns({"n_chars": n.cast("long"), "edited": edited})
    rows = rows.withColumns({"own": leaf_digests(F.col("text")), "edit": leaf_digests(F.col("edited")), "next": leaf_digests(F.col("following"))})
    out = rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("own")).alias("fingerprint"), fingerprint(F.col("edited"), F.col("edit")).alias("edited_fingerprint"),
        F.when(F.col("text") == F.col("edited"), 1.0).otherwise(likeness(F.col("own"), F.col("edit"))).alias("near_edited"),
        F.when(F.col("text") == F.col("following"), 1.0).otherwise(likeness(F.col("own"), F.col("next"))).alias("near_next"), *(["times"] if "times" in rows.columns else []),
    )
    return out if "times" not in out.columns else out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("again", "times")
