"""Katz backoff language model over words: Good-Turing discounted bigrams, exactly normalised backoff weights.

Documents are gathered into blocks, whose distinct words and bigrams are the
unit of exchange, as packed arrays:

1. blocks:   words of each block with their counts in training documents;
2. unigrams: by hash bucket, totals of each word; each block gets back a number
             and a total for each of its words;
3. bigrams:  by context bucket, totals of each bigram and, by context, how many
             bigrams have 1 to 5 occurrences, the occurrences of the others, and
             the unigram mass of its successors; each block gets its own back;
4. scores:   each block evaluates its documents' tokens: the bigram's
             discounted probability if it was seen, else the context's backoff
             weight times the word's.

Contexts over HOT_SHARE of all tokens are spread over buckets by the whole
bigram, and their (at most 1 / HOT_SHARE) sums are added up afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, crc_mod, written
from .words import WordHasher

#: Characters of text in a block, about.
BLOCK = 6_000_000
#: Counts up to this are discounted; counts of counts up to SPAN tell by how much.
TOP, SPAN = 5, 64
END, START = np.uint64(0x1B873593CC9E2D51), -1


def packed(a: np.ndarray) -> bytes:
    """An array of integers or floats, by byte planes, compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(b: bytes, kind) -> np.ndarray:
    import zstandard

    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def good_turing(n: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 to TOP from n[r], the numbers of types with count r (1 to SPAN).

    A factor comes from the counts of counts as they are where that gives a
    number between 0 and 1, else from the line fitted through their logarithms
    by r's.  Where even the line falls too slowly to discount anything (a
    corpus with hardly any rare types), half an occurrence is taken off.
    """
    d = np.array([1.0, *((r - 0.5) / r for r in range(1, TOP + 1))])
    there = np.array([r for r in range(1, SPAN + 1) if n[r]])
    slope = np.polyfit(np.log(there), np.log(np.array(n, float)[there]), 1)[0] if len(there) > 1 else 0.0

    def factor(more: float, cut: float) -> float | None:  # more: discounted count over count
        got = (more - cut) / (1 - cut) if 0 < cut < 1 else 0.0
        return got if 0 < got < 1 else None

    for r in range(1, TOP + 1):
        raw = factor((r + 1) * n[r + 1] / n[r] / r, (TOP + 1) * n[TOP + 1] / n[1]) if n[r] and n[1] else None
        fitted = factor((1 + 1 / r) ** (slope + 1), (TOP + 1.0) ** (slope + 1))
        d[r] = raw or fitted or d[r]
    return d


class Unigrams:
    """Probabilities of words by their training count; the mass that discounting frees is the unknown word's."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types, self.d = total, types, good_turing(n)
        seen = sum(r * n[r] * (1 - self.d[r]) for r in range(1, TOP + 1))
        self.unknown = seen / total if seen > 0 else 1 / (total + 1)
        self.scale = 1.0 if seen > 0 else total / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))  # no training text: one class of unknown words
        return np.where(c > 0, self.d[np.minimum(c, TOP) * (c <= TOP)] * c / self.total * self.scale, self.unknown)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def make_blocks(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows (block, ids, held, ends, tokens, place, words, counts): documents as ranks of the block's words by frequency.

    words and counts go by hash bucket, then hash; place tells where a rank's word stands there.
    """
    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        hasher = WordHasher()
        held: list[tuple[object, bool, np.ndarray]] = []

        def done():
            nonlocal k, held
            ends = np.cumsum([len(h) + 1 for _, _, h in held])
            flat = np.concatenate([x for _, _, h in held for x in (h, [END])])
            words, local, often = np.unique(flat, return_inverse=True, return_counts=True)
            train = np.repeat([not h for _, h, _ in held], np.diff(ends, prepend=0))
            counts = np.bincount(local[train], minlength=len(words))
            by_bucket = np.argsort(bucket_of(words, buckets), kind="stable")
            at = np.empty(len(words), np.uint32)
            at[by_bucket] = np.arange(len(words))
            by_rank = np.argsort(-often, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_rank] = np.arange(len(words))
            row = [(task << 32) + k, [i for i, _, _ in held], [h for _, h, _ in held], packed(ends), packed(rank[local]), packed(at[by_rank]), words[by_bucket].tobytes(), packed(counts[by_bucket])]
            k, held = k + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["block", "ids", "held", "ends", "tokens", "place", "words", "counts"])

        size, types = 0, None
        for batch in batches:
            types = [pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.bool_()), *[pa.binary()] * 5]
            for begin in range(0, batch.num_rows, 200):
                some = batch.slice(begin, 200)
                texts = [(t or "").encode() for t in some.column(2).to_pylist()]
                for i, h, text, hashes in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts, hasher.texts(texts), strict=True):
                    held.append((i, bool(h), hashes.copy()))
                    size += len(text) + 100
                    if size > BLOCK:
                        yield done()
                        size = 0
        if held:
            yield done()

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), crc_mod(id_col, 5).eqNullSafe(1).alias("held"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, ends binary, tokens binary, place binary, words binary, counts binary")


def grouped(df: DataFrame, key: str, order: list[str], work, schema: str) -> DataFrame:
    """work(rows of one key, as dicts) for each key, which gives rows; rows are small packed arrays, keys spread evenly."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if row[key] != now:
                    if held:
                        yield from table(work(held))
                    now, held = row[key], []
                held.append(row)
        if held:
            yield from table(work(held))

    def table(rows):
        for begin in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[begin : begin + 2000]], t) for i, t in enumerate(kinds)], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def unigram_replies(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, numbers, totals) for a block's words of a bucket; rows with block -1 count the types by count."""
    def ask(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h, c = np.frombuffer(words, np.uint64), unpacked(counts, np.int64)
                cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
                some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                parts = [slice(cuts[b], cuts[b + 1]) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array([h[p].tobytes() for p in parts], pa.binary()), pa.array([packed(c[p]) for p in parts], pa.binary())], ["bucket", "block", "words", "counts"])

    def work(rows):
        words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate([unpacked(r["counts"], np.int64) for r in rows]))
        number = np.empty(len(every), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(every))  # frequent words get small numbers
        number = number * buckets + rows[0]["bucket"]
        out, begin = [], 0
        for r, w in zip(rows, words, strict=True):
            mine = at[begin : begin + len(w)]
            begin += len(w)
            out.append((r["block"], r["bucket"], packed(number[mine]), packed(total[mine])))
        tail = np.bincount(np.minimum(total, SPAN + 1), minlength=SPAN + 2)
        tail[0] = total.sum()  # in the place of words without occurrences, which nothing asks for
        out.append((-1, r["bucket"], packed(tail), b""))
        return out

    asked = blocks.select("block", "words", "counts").mapInArrow(ask, "bucket long, block long, words binary, counts binary")
    return grouped(asked, "bucket", ["block"], work, "block long, bucket long, a binary, b binary")


def word_table(block: dict, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and totals of a block's words, by rank."""
    place = unpacked(block["place"], np.uint32)
    return tuple(np.concatenate([unpacked(r[c], np.int64) for r in replies])[place] for c in ("a", "b"))


def bigrams(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ends, tokens, distinct bigrams (context + 1) << 32 | word (context 0: a document's start), place of each token's bigram, training tokens."""
    ends, tokens = unpacked(block["ends"], np.int64), unpacked(block["tokens"], np.uint32).astype(np.uint64)
    before = np.r_[np.uint64(0), tokens[:-1] + np.uint64(1)]
    before[np.r_[0, ends[:-1]]] = 0
    pairs, at = np.unique(before << np.uint64(32) | tokens, return_inverse=True)
    train = np.repeat(~np.array(block["held"], bool), np.diff(ends, prepend=0))
    return ends, tokens.astype(np.int64), pairs, at, train


def deal(pairs: np.ndarray, number: np.ndarray, total: np.ndarray, hot: float, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context number (START: -1), word number, bucket, whether the context is hot, and order (by bucket, context, word) of a block's bigrams."""
    context, word = (pairs >> np.uint64(32)).astype(np.int64) - 1, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    c = np.where(context >= 0, number[context], START)
    w = number[word]
    crowded = (context < 0) | (total[context] > hot)
    mix = (c + 2) * 0x9E3779B1 + np.where(crowded, w * 0x85EBCA6B, 0)
    bucket = ((mix ^ mix >> 15) & 0x7FFFFFFFFFFFFFFF) % buckets
    return c, w, bucket, crowded, np.lexsort((w, c, bucket))


def bigram_replies(both: DataFrame, words: Unigrams, hot: float, buckets: int) -> DataFrame:
    """(block, bucket, a: training totals of the block's bigrams, b: sums of the contexts c that need them) and rows of block -1 (counts of counts) and -2 (hot contexts' sums)."""
    def ask(rows):
        block, replies = rows[-1], rows[:-1]
        number, total = word_table(block, replies)
        _, _, pairs, at, train = bigrams(block)
        count = np.bincount(at[train], minlength=len(pairs))
        c, w, bucket, crowded, order = deal(pairs, number, total, hot, buckets)
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            p = order[cuts[b] : cuts[b + 1]]
            if len(p):
                out.append((b, block["block"], packed(np.diff(c[p], prepend=START)), packed(w[p]), packed(count[p].astype(np.int32)), packed(total[(pairs[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)]), packed(np.unique(c[p][crowded[p]]))))
        return out

    def work(rows):
        c = [np.cumsum(unpacked(r["c"], np.int64)) + START for r in rows]
        contexts, ci = np.unique(np.concatenate(c), return_inverse=True)
        w = np.concatenate([unpacked(r["w"], np.int64) for r in rows])
        names, wi = np.unique(w, return_inverse=True)
        pairs, first, at = np.unique(ci.astype(np.uint64) << np.uint64(32) | wi.astype(np.uint64), return_index=True, return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, at, np.concatenate([unpacked(r["n"], np.int32) for r in rows]))
        mass = words.p(np.concatenate([unpacked(r["t"], np.int64) for r in rows])[first])
        of = (pairs >> np.uint64(32)).astype(np.int64)
        sums = np.zeros((len(contexts), TOP + 2))
        seen = count > 0
        np.add.at(sums, (of[seen], np.where(count[seen] > TOP, 0, count[seen])), np.where(count[seen] > TOP, count[seen], 1))
        sums[:, TOP + 1] = np.bincount(of[seen], mass[seen], len(contexts))
        bare = sums[:, 1 : TOP + 1].sum(1) == 0  # nothing to discount: its occurrences alone don't tell the probabilities
        out, begin = [], 0
        for r, mine in zip(rows, c, strict=True):
            place = at[begin : begin + len(mine)]
            begin += len(mine)
            asked = np.unique(mine[(count[place] == 0) | bare[ci[begin - len(mine) : begin]]])
            out.append((r["block"], r["bucket"], packed(count[place]), packed(sums[np.searchsorted(contexts, asked)].ravel()), packed(asked)))
        out.append((-1, r["bucket"], packed(np.bincount(np.minimum(count, SPAN + 1), minlength=SPAN + 2)), b"", b""))
        crowded = np.unique(np.concatenate([unpacked(r["x"], np.int64) for r in rows]))
        out.append((-2, r["bucket"], packed(crowded), packed(sums[np.searchsorted(contexts, crowded)].ravel()), b""))
        return out

    asked = grouped(both, "block", ["kind", "bucket"], ask, "bucket long, block long, c binary, w binary, n binary, t binary, x binary")
    return grouped(asked, "bucket", ["block"], work, "block long, bucket long, a binary, b binary, c binary")


def totals(replies: DataFrame) -> tuple[list[int], dict[int, np.ndarray]]:
    """Sums over all buckets: counts of counts (rows of block -1) and hot contexts' sums (-2), by context.

    Added up in the tasks and again by key, so that at most SPAN + 2 numbers
    and 1 / HOT_SHARE contexts' sums reach the driver.
    """
    def run(batches):
        known: dict[tuple[int, int], float] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] == -1:
                    found = [((START - 1, k), float(v)) for k, v in enumerate(unpacked(row["a"], np.int64).tolist())]
                else:
                    found = [((c, k), v) for c, s in zip(unpacked(row["a"], np.int64).tolist(), unpacked(row["b"], np.float64).reshape(-1, TOP + 2).tolist(), strict=True) for k, v in enumerate(s)]
                for at, v in found:
                    known[at] = known.get(at, 0.0) + v
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in known], pa.int64()), pa.array([k for _, k in known], pa.int32()), pa.array(list(known.values()), pa.float64())], ["c", "k", "v"])

    counts, crowds = [0] * (SPAN + 2), {}
    for r in replies.where("block < 0").select("block", "a", "b").mapInArrow(run, "c long, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect():
        if r["c"] < START:
            counts[r["k"]] = int(r["v"])
        else:
            crowds.setdefault(r["c"], np.zeros(TOP + 2))[r["k"]] = r["v"]
    return counts, crowds


def backoff(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context: its occurrences (one more where nothing is discounted, so that unseen words keep some mass) and backoff weight."""
    r = np.arange(1, TOP + 1)
    size = sums[:, 0] + sums[:, 1 : TOP + 1] @ r
    freed = sums[:, 1 : TOP + 1] @ (r * (1 - d[1:]))
    bare = (freed <= 0) & (size > 0)
    size, freed = size + bare, np.where(bare, 1.0, freed)
    weight = np.where(size > 0, freed / np.maximum(size, 1) / np.maximum(1 - sums[:, TOP + 1], 1e-300), 1.0)
    return size, weight


def score_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    Rows whose crc32(id) mod 5 is not 1 are trained on.  Tokens are words and
    one end a text; a text's first token has the start as its context.  Null
    and empty texts have the end alone; repeated rows stay and count as often
    as they are there; an empty table gives no rows; a text of any length is
    one block at most with others.  With no training rows, all words are one
    unknown class.  Other columns are not read, so their names don't matter.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.char_length(F.col(text_col).cast("string")) + 100)).first()[0] or 0
    buckets = max(8, int(chars // BLOCK) * 2)
    blocks = written(make_blocks(docs, id_col, text_col, buckets), "blocks")
    unigrams = written(unigram_replies(blocks, buckets), "unigrams")
    n, _ = totals(unigrams)
    total, n[0] = n[0], 0
    words = Unigrams(total, sum(n[1:]), n)
    hot = max(total * HOT_SHARE, 100.0)
    columns = ("ids", "held", "ends", "tokens", "place")

    def joined(replies):
        """Per block: replies in the order of their buckets, kind by kind, and the block's own row last."""
        parts = blocks.select("block", F.lit(9).alias("kind"), F.lit(0).cast("long").alias("bucket"), *columns, *(F.lit(None).cast("binary").alias(x) for x in "abc"))
        for k, r in enumerate(replies):
            parts = parts.unionByName(r.where("block >= 0").withColumn("kind", F.lit(k)), allowMissingColumns=True)
        return parts

    bi = written(bigram_replies(joined([unigrams]), words, hot, buckets), "bigrams")
    n2, crowds = totals(bi)
    d = good_turing(n2)
    names = np.array(sorted(crowds), np.int64)
    shared = spark.sparkContext.broadcast((words, d, names, np.array([crowds[c] for c in names.tolist()]).reshape(-1, TOP + 2)))

    def work(rows):
        words, d, names, crowd_sums = shared.value
        block, first, second = rows[-1], [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
        number, total = word_table(block, first)
        ends, tokens, pairs, at, _ = bigrams(block)
        c, w, bucket, crowded, order = deal(pairs, number, total, hot, buckets)
        count = np.empty(len(pairs), np.int64)
        count[order] = np.concatenate([unpacked(r["a"], np.int64) for r in second])
        before = (pairs >> np.uint64(32)).astype(np.int64) - 1
        size, weight = total[before].astype(float), np.ones(len(pairs))  # a trained word is a context as often as it occurs
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for r in second:
            p = order[cuts[r["bucket"]] : cuts[r["bucket"] + 1]]
            asked = unpacked(r["c"], np.int64)
            if len(asked):
                s, a = backoff(unpacked(r["b"], np.float64).reshape(-1, TOP + 2), d)
                k = np.minimum(np.searchsorted(asked, c[p]), len(asked) - 1)
                k, p = k[asked[k] == c[p]], p[asked[k] == c[p]]
                size[p], weight[p] = s[k], a[k]
        s, a = backoff(crowd_sums, d)
        if crowded.any():
            k = np.searchsorted(names, c[crowded])
            size[crowded], weight[crowded] = s[k], a[k]
        p1 = words.p(total[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        seen = d[np.minimum(count, TOP) * (count <= TOP)] * count / np.maximum(size, 1)
        score = np.log10(np.where(count > 0, seen, weight * p1))[at]
        base = np.log10((total + 0.5) / (words.total + 0.5 * (words.types + 1)))[tokens]
        known = (total > 0)[tokens]
        begins = np.r_[0, ends[:-1]]
        return list(zip(block["ids"], block["held"], (ends - begins).tolist(), np.add.reduceat(known.astype(np.int64), begins).tolist(), [words.total] * len(ends), np.add.reduceat(base, begins).tolist(), np.add.reduceat(score, begins).tolist(), strict=True))

    kind = docs.schema[id_col].dataType.simpleString()
    out = grouped(joined([unigrams, bi]), "block", ["kind", "bucket"], work, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
