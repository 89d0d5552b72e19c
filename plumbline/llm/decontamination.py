"""Benchmark decontamination by Wu-Manber search for windows of words.

Texts become streams of lower-cased words with single blanks around them, so a
window of words is a byte string with a blank at both ends.  The search looks
at the last three bytes of the place where the shortest test string would
stand: a shift table says how far no test string can end, and where the shift
is 0, the bucket of the last eight bytes names the test strings to compare.
Many places of a stream are searched at once, as lanes of one array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

WINDOW = 10
#: Bytes of benchmark text in one block of test strings; more text makes more blocks, each a search of its own.
BLOCK_BYTES = 4_000_000
LANE = 4096
#: Bytes that are no part of a word become blanks, A-Z become lower case.
CANON = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def canonical(text: str) -> list[bytes]:
    return text.encode().translate(CANON).split()


class WuManber:
    """Searches a byte string for all of a set of byte strings of at least four bytes."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.least = m = min(map(len, strings))
        shift = np.full(1 << 16, m - 2, np.int32)
        for s in strings:
            b = np.frombuffer(s[:m], np.uint8).astype(np.int32)
            h = self.block(b[:-2], b[1:-1], b[2:])
            np.minimum.at(shift, h, np.arange(m - 3, -1, -1, dtype=np.int32))
        self.shift = shift
        self.tail = min(8, m)
        keys = np.array([int.from_bytes(s[m - self.tail : m], "little") for s in strings], np.uint64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    @staticmethod
    def block(a, b, c):
        return (a * 2917 + b * 53 + c) & 0xFFFF

    def search(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where test strings begin in data, and which; no string that begins before data's end - least is missed."""
        m, n = self.least, len(data)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.frombuffer(data, np.uint8)
        wide = text.astype(np.int32)
        begin = np.arange(m - 3, n - 2, LANE)  # a place is where the last block of the first m bytes begins
        end = np.minimum(begin + LANE, n - 2)
        at, found = begin, []
        while len(at):
            step = self.shift[self.block(wide[at], wide[at + 1], wide[at + 2])]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                step = np.where(hit, 1, step)
            at = at + step
            going = at < end
            if not going.all():
                at, end = at[going], end[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = np.sort(np.concatenate(found)) + 3
        key = np.zeros(len(last), np.uint64)
        for k in range(self.tail):
            key |= text[last - self.tail + k].astype(np.uint64) << np.uint64(8 * k)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        where, which = [], []
        for place, a, b in zip((last - m)[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for k in self.order[a:b].tolist():
                if data.startswith(self.strings[k], place):
                    where.append(place)
                    which.append(k)
        return np.array(where, np.int64), np.array(which, np.int64)


def test_strings(items: list[tuple[str, str]], window: int) -> tuple[list[bytes], list[int], list[list[str]]]:
    """Distinct windows, their numbers of words and the items that have them."""
    of: dict[bytes, tuple[int, set[str]]] = {}
    for name, text in items:
        words = canonical(text or "")
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            of.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", (n, set()))[1].add(name)
    return list(of), [n for n, _ in of.values()], [sorted(x) for _, x in of.values()]


def find(docs: DataFrame, text_col: str, carried: list[str], items: list[tuple[str, str]], window: int, keep_text: bool = False) -> DataFrame:
    """The carried columns as c0, c1 and so on, the text if it is kept, n_words, ranges (of hit words, begin and end), items (names) for each row and one block of items."""
    spark = docs.sparkSession
    strings, sizes, names = test_strings(items, window)
    shared = spark.sparkContext.broadcast((strings, sizes, names))

    def run(batches):
        strings, sizes, names = shared.value
        searches = []  # short test strings would shorten every shift, so they are searched for apart
        for pick in ([k for k, s in enumerate(strings) if len(s) >= 24], [k for k, s in enumerate(strings) if len(s) < 24]):
            if pick:
                searches.append((WuManber([strings[k] for k in pick]), np.array(pick)))
        sizes = np.array(sizes, np.int64)

        def block(texts):
            words = [canonical(t) for t in texts]
            streams = [b" " + b" ".join(w) + b" \0" for w in words]
            data = b"".join(streams)
            ranges, items = [[] for _ in texts], [[] for _ in texts]
            found = [(where, pick[which]) for search, pick in searches for where, which in [search.search(data)]]
            where, which = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            if len(where):
                begins = np.cumsum([0, *map(len, streams)])
                blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
                row = np.searchsorted(begins, where, "right") - 1
                word = np.searchsorted(blanks, where) - np.searchsorted(blanks, begins[row])
                order = np.lexsort((word, row))
                for r, a, k in zip(row[order].tolist(), word[order].tolist(), which[order].tolist(), strict=True):
                    b, mine = a + int(sizes[k]), ranges[r]
                    if mine and a <= mine[-1]["until"]:
                        mine[-1]["until"] = max(b, mine[-1]["until"])
                    else:
                        mine.append({"begin": a, "until": b})
                    items[r].append(k)
            return [len(w) for w in words], ranges, [sorted({n for k in set(ks) for n in names[k]}) for ks in items]

        kind = pa.list_(pa.struct([("begin", pa.int32()), ("until", pa.int32())]))
        for batch in batches:
            counts, ranges, items, held, size = [], [], [], [], 0
            for t in [*batch.columns[-1], None]:
                if held and (t is None or size > 1_000_000):
                    for out, x in zip((counts, ranges, items), block(held), strict=True):
                        out += x
                    held, size = [], 0
                if t is not None:
                    held.append(t.as_py() or "")
                    size += len(held[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(ranges, kind), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names[:n], "n_words", "ranges", "items"])

    given = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carried)), F.col(text_col).cast("string").alias("text"))
    n = len(carried) + keep_text
    fields = ", ".join([f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carried)] + ["text string"] * keep_text)
    return given.mapInArrow(run, f"{fields}, n_words long, ranges array<struct<begin:int,until:int>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, items, ranges, and the columns named in keep.

    `ranges` are the runs of hit words (begin, until) and `items` the names of
    the items found, sorted.  Null and empty texts have no words; a null item
    id is named by the empty text; repeated rows of docs stay, items of one id
    count once; texts may be of any length.  With an empty benchmark nothing is
    hit, an empty docs gives no rows.  Columns that aren't named are not read.

    Test strings reach the tasks as a broadcast of at most BLOCK_BYTES of
    benchmark text; a larger benchmark is searched for in several blocks.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, keep = -(-total // BLOCK_BYTES) or 1, keep or []
    carried, keep_text = [id_col, *(c for c in keep if c != text_col)], text_col in keep
    if blocks == 1:
        out = find(docs, text_col, carried, [tuple(r) for r in items.collect()], window, keep_text)
    else:
        (key,) = fresh(docs, "row")
        rows = written(docs.select(F.monotonically_increasing_id().alias(key), text_col, *carried), "rows")
        parts = None
        for k in range(blocks):
            block = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
            part = written(find(rows, text_col, [key], [tuple(r) for r in block], window), "hits")
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("c0").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        given = rows.select(F.col(key).alias("key"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carried)), *([F.col(text_col).cast("string").alias("text")] * keep_text))
        out = given.join(merged.withColumnRenamed("c0", "key"), "key").drop("key")
    hit = F.size(F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["begin"], r["until"] - 1))))).cast("long")
    return out.select(
        F.col("c0").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"), "items", "ranges",
        *(F.col("text" if c == text_col else f"c{carried.index(c)}").alias(c) for c in keep),
    )
