"""Removal of every byte covered by a string of `length` bytes that occurs elsewhere too, exactly.

1. Windows of `length` bytes are cut into segments: runs of windows with one
   minimizer (the least hash of the window's grams; the leftmost of equals).
   Equal windows have equal minimizers at equal places, so windows need
   comparing only within segments that share a minimizer.
2. Segments sorted by minimizer and content: equal contents are repeats as a
   whole; a minimizer with one content only is done; of the other contents one
   representative each goes on with its bytes.
3. Representatives are gathered by minimizer into buffers, whose suffixes are
   sorted in two stages: those smaller than their successor directly, all
   others by scanning the buckets of first bytes.  Neighbours in that order
   with a common prefix of `length` bytes are repeats.  Where a minimizer's
   representatives would fill more than a buffer, their windows are dealt by
   128 bits of hashes and equal ones are repeats: no task holds them together.
4. Documents meet the runs of their repeated windows and lose those bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import BASE, mixed, powers

LENGTH, GRAM = 200, 64
#: Bytes of text handled at once, and of a buffer whose suffixes are sorted.
BLOCK, BUFFER = 2_000_000, 3_000_000
PLACE = 24  # low bits of a gram's hash that hold its place in the block
#: Minimizers that are dealt apart at most, and one text in so many is looked at to find them.
FREQUENT, SAMPLED = 1000, 64


def gram_hashes(t: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the gram at each place of t (one fewer than gram at the end have none)."""
    n = len(t)
    table = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(256 * seed))
    up, down = powers(BASE, n + 1), powers(pow(BASE, -1, 1 << 64), n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(table[t] * down[:n], out=run[1:])
    return mixed((run[gram:] - run[:-gram]) * up[: n - gram + 1])


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours of h, by running minima of blocks from both sides."""
    n = len(h)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = h
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes], length: int, gram: int):
    """For all windows of the texts: text number, minimizer hash, first and last window start of each segment."""
    none = np.zeros(0, np.int64)
    t = np.frombuffer(b"".join(texts), np.uint8)
    if len(t) < length:
        return none, none.view(np.uint64), none, none
    h = gram_hashes(t, gram)
    assert len(h) <= 1 << PLACE, "a block's places must fit their bits"
    low = np.uint64((1 << PLACE) - 1)
    least = window_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    ends = np.cumsum([len(x) for x in texts])
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    good = np.arange(len(least)) + length <= ends[text]
    place = (least & low).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])] & good
    begin = np.flatnonzero(new)
    last = np.flatnonzero(good & np.r_[new[1:] | ~good[1:], True])
    begins = ends - sizes
    of = text[begin]
    return of, h[place[begin]], begin - begins[of], last - begins[of]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """All places of t ordered by the bytes there (zeros behind the end), by `depth` bytes at least.

    Suffixes smaller than their successor are sorted directly, eight bytes at
    a time while there are ties.  A scan over the buckets of first bytes then
    puts every other suffix, when its successor is met, at its bucket's next
    place; a whole bucket is scanned in one step.
    """
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16), append=-1))
    following = np.minimum.accumulate(np.where(step != 0, np.arange(n), n - 1)[::-1])[::-1]
    smaller = step[following] > 0
    wide = np.zeros(n + depth + 8, np.uint64)
    wide[:n] = t
    eight = np.zeros(n + depth, np.uint64)
    for k in range(8):
        eight |= wide[k : k + n + depth] << np.uint64(56 - 8 * k)
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(eight[direct], kind="stable")]
    key = eight[direct]
    same = np.r_[False, key[1:] == key[:-1]]
    for d in range(8, depth, 8):
        tied = same | np.r_[same[1:], False]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        p, group = direct[at], np.cumsum(~same)[at]
        key = eight[p + d]
        order = np.lexsort((key, group))
        direct[at] = p[order]
        key, group = key[order], group[order]
        same[at] = np.r_[False, (key[1:] == key[:-1]) & (group[1:] == group[:-1])]
    bounds = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[t[-1]].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return before
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        own = before[:0]
        for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True):
            if first[a] == c:
                own = before[a:b]
            else:
                waiting[first[a]].append(before[a:b])
        return own

    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(front):
            out.append(front)
            front = induce(front, c)
        front = direct[bounds[c] : bounds[c + 1]]
        if len(front):
            out.append(front)
            induce(front, c)
    return np.concatenate(out) if out else direct


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part: which of its windows (by start) are also elsewhere among the parts."""
    t = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    valid = np.arange(len(t)) + length <= np.repeat(ends, sizes)
    order = suffix_order(t, length)
    order = order[valid[order]]
    wide = np.r_[t, np.zeros(8, np.uint8)]
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for k in range(length):  # common prefixes of neighbours, as far as they matter
        alive = alive[wide[a[alive] + k] == wide[b[alive] + k]]
        if not len(alive):
            break
    hit = np.zeros(len(t), bool)
    hit[a[alive]] = hit[b[alive]] = True
    return [hit[e - s : e - length + 1] for s, e in zip(sizes, ends, strict=True)]


def blocks(texts, length: int):
    """Lists of (number, begin, bytes): the texts' pieces, as many as make a block and no more than PLACE bits tell apart.

    Pieces of very long texts overlap by a window less one.
    """
    held, size, step = [], 0, min(8 * BLOCK, (1 << PLACE) - length + 1)
    for i, text in enumerate(texts):
        if len(text) >= length:
            for begin in range(0, len(text) - length + 1, step):
                piece = text[begin : begin + step + length - 1]
                if held and (size > BLOCK or size + len(piece) > 1 << PLACE):
                    yield held
                    held, size = [], 0
                held.append((i, begin, piece))
                size += len(piece)
    if held:
        yield held


def find_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (least, content, k1, k2, first, last, n): segments, with hashes of their minimizer and of their bytes.

    n is 1, or 2 for the first of several alike in a block of texts; those
    alike, the first too, are there again with n = 0, as repeats already known.
    """
    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for held in blocks(((batch.column(2)[i].as_py() or "").encode() for i in range(batch.num_rows)), length):
                yield from one(batch, held, digest)

    def one(batch, held, digest):
        of, least, first, last = segments([x[2] for x in held], length, gram)
        parts = [memoryview(x[2]) for x in held]
        content = np.fromiter((digest(parts[k][a : b + length]) for k, a, b in zip(of.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(of))
        row, shift = (np.array([x[k] for x in held], np.int64)[of] if len(of) else of for k in (0, 1))
        order = np.lexsort((content, least))
        new = np.r_[True, (least[order][1:] != least[order][:-1]) | (content[order][1:] != content[order][:-1])] if len(order) else np.zeros(0, bool)
        alike = np.diff(np.r_[np.flatnonzero(new), len(order)])
        heads = order[new]
        known = order[np.repeat(alike >= 2, alike)]
        pick = np.r_[heads, known]
        n = np.r_[np.minimum(alike, 2), np.zeros(len(known), np.int64)]
        take = pa.array(row[pick])
        yield pa.RecordBatch.from_arrays(
            [pa.array(least[pick].view(np.int64)), pa.array(content[pick].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array((first + shift)[pick].astype(np.int32)), pa.array((last + shift)[pick].astype(np.int32)), pa.array(n.astype(np.int32))],
            ["least", "content", "k1", "k2", "first", "last", "n"],
        )

    return docs.select("k1", "k2", "text").mapInArrow(run, "least long, content long, k1 long, k2 long, first int, last int, n int")


def settle(found: DataFrame) -> DataFrame:
    """From segments: whole repeats (content null) and representatives to compare (content: 1 if it stands for itself alone)."""
    def run(batches):
        held = np.zeros((0, 9), np.int64)  # the last content's first rows; the last columns: was the row given out, is its minimizer frequent?
        before = False  # has the held content's minimizer another content before it?
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            rows = np.stack([*columns[:7], np.zeros(batch.num_rows, np.int64), columns[7]], 1)
            given = rows[:, 6] == 0
            if given.any():
                yield table(rows[given], rows[:0], None)
            rows = rows[~given]
            rows[:, 7] = rows[:, 6] == 2
            out, held, before = cut(np.r_[held, rows], before, False)
            yield out
        yield cut(held, before, True)[0]

    def table(whole, part, alone):
        flat = np.r_[whole, part]
        mark = np.zeros(len(flat), np.int64)
        if len(part):
            mark[len(whole) :] = alone
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(mark, mask=np.arange(len(flat)) < len(whole)), *(pa.array(flat[:, k]) for k in (2, 3)), *(pa.array(flat[:, k].astype(np.int32)) for k in (4, 5))], ["least", "content", "k1", "k2", "first", "last"])

    def cut(rows, before, final):
        n = len(rows)
        if not n:
            return table(rows, rows, None), rows, before
        least, content = rows[:, 0], rows[:, 1]
        new = np.r_[True, (least[1:] != least[:-1]) | (content[1:] != content[:-1])]
        begin = np.flatnonzero(new)
        size, weight = np.diff(np.r_[begin, n]), np.add.reduceat(rows[:, 6], begin)
        done = len(begin) - (0 if final else 1)  # contents that are complete
        alike = np.r_[before, least[begin[1:]] == least[begin[:-1]]]
        other = (alike | np.r_[alike[1:], False] | (rows[begin, 8] > 0))[:done]
        whole = rows[np.repeat(weight >= 2, size) & (rows[:, 7] == 0)]
        out = table(whole, rows[begin[:done][other]], (weight == 1)[:done][other].astype(np.int64))
        if final:
            return out, rows[:0], before
        keep = rows[begin[-1] : begin[-1] + 2].copy()
        keep[:, 7] |= weight[-1] >= 2  # all rows of several alike have been given out
        return out, keep, bool(alike[-1])

    # segments of a frequent minimizer are dealt by their content too; that they have other contents is taken for granted
    spread = F.when(F.col("n") == 0, F.xxhash64("k1", "k2", "first")).when(F.col("hot"), F.xxhash64("least", "content")).otherwise(F.col("least"))
    return found.repartition(spread).sortWithinPartitions("least", "content").mapInArrow(run, "least long, content long, k1 long, k2 long, first int, last int")


def frequent(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """least: minimizers that hold over 1 / FREQUENT of the segments, as one text in SAMPLED shows; FREQUENT rows at most.

    It only tells how rows are dealt; the results are the same for any answer.
    """
    seen = find_segments(docs.where(F.pmod("k2", F.lit(SAMPLED)) == 0), length, gram).where("n > 0").groupBy("least").agg(F.count("*").alias("n"))
    ranked = seen.where("n >= 8").orderBy(F.desc("n"), "least").limit(FREQUENT).collect()
    return docs.sparkSession.createDataFrame([(r["least"],) for r in ranked], "least long")


def compare(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(k1, k2, first, last): runs of repeated windows of the representatives that stand for themselves alone."""
    def cut(batches):
        before = None
        for batch in batches:
            for i in range(batch.num_rows):
                k1, k2 = (batch.column(k)[i].as_py() for k in (0, 1))
                if (k1, k2) == before:  # a row repeated
                    continue
                before = k1, k2
                text = (batch.column(2)[i].as_py() or "").encode()
                mine = batch.column(3)[i].as_py()
                cold = [x for x in mine if not x["hot"]]
                if cold:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["least"] for x in cold], pa.int64()), pa.array([0] * len(cold), pa.int64()), *(pa.array([k] * len(cold), pa.int64()) for k in (k1, k2)), pa.array([x["first"] for x in cold], pa.int32()), pa.array([x["content"] for x in cold], pa.int64()), pa.array([text[x["first"] : x["last"] + length] for x in cold], pa.binary())],
                        names,
                    )
                for x in mine:
                    if x["hot"]:  # its windows one by one
                        t = np.frombuffer(text[x["first"] : x["last"] + length], np.uint8)
                        n = x["last"] - x["first"] + 1
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(gram_hashes(t, length, seed).view(np.int64)) for seed in (1, 2)), *(pa.array(np.full(n, k, np.int64)) for k in (k1, k2)), pa.array(np.arange(x["first"], x["last"] + 1, dtype=np.int32)), pa.array(np.full(n, x["content"], np.int64)), pa.nulls(n, pa.binary())],
                            names,
                        )

    def run(batches):
        held, size, now, before, again = [], 0, None, None, False
        for batch in batches:
            windows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[6] is None:
                    same = before is not None and row[:2] == before[:2]
                    if same and not again and before[5]:
                        windows.append(before)
                    if same and row[5]:
                        windows.append(row)
                    before, again = row, same
                    continue
                if row[0] != now and size > BUFFER:  # a minimizer's rows stay together
                    yield done(held)
                    held, size = [], 0
                now = row[0]
                held.append(row)
                size += len(row[6])
            if windows:
                yield spans([(r[2], r[3], r[4], r[4]) for r in windows])
        if held:
            yield done(held)

    def done(held):
        out = []
        for (_, _, k1, k2, first, alone, _), hit in zip(held, repeated([r[6] for r in held], length), strict=True):
            if alone and hit.any():
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                out += [(k1, k2, first + a, first + b - 1) for a, b in edge.reshape(-1, 2).tolist()]
        return spans(out)

    def spans(out):
        k1, k2, a, b = zip(*out, strict=True) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["k1", "k2", "first", "last"])

    names = ["least", "second", "k1", "k2", "first", "alone", "bytes"]
    hot = reps.groupBy("least").agg(F.sum(F.col("last") - F.col("first") + length).alias("size")).where(F.col("size") > BUFFER).select("least", F.lit(True).alias("hot"))
    marked = reps.join(hot, "least", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))  # a row of hot stands for more than BUFFER bytes
    by_text = marked.groupBy("k1", "k2").agg(F.collect_set(F.struct("least", "first", "last", "content", "hot")).alias("mine"))
    # merged, so rows with one key stand together and only the first is cut
    pieces = docs.join(by_text.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "mine").mapInArrow(cut, "least long, second long, k1 long, k2 long, first int, alone long, bytes binary")
    return pieces.repartition("least").sortWithinPartitions("least", "second").mapInArrow(run, "k1 long, k2 long, first int, last int")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and 128 bits of hashes of the two (k1, k2): rows alike share a key, as their spans are alike too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    i = F.col(id_col)
    return docs.select(i.alias("id"), text.alias("text"), F.xxhash64(i.isNull(), i, F.lit("1"), text).alias("k1"), F.xxhash64(text, F.lit("2"), i).alias("k2"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, on demand).

    Texts are UTF-8 bytes, null is empty; windows lie within a text; texts
    shorter than a window stay whole, those of any other length are searched
    whole.  Repeated rows are repeats of each other, and so lose the same bytes;
    ids may be of any type, null or shared by texts.  An empty table gives no
    rows.  Columns other than the two are not read, so their names don't matter.
    """
    base = keyed(docs, id_col, text_col)
    often = F.broadcast(frequent(base, length, gram).withColumn("hot", F.lit(True)))
    found = find_segments(base, length, gram).join(often, "least", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    settled = written(settle(found.select("least", "content", "k1", "k2", "first", "last", "n", "hot")), "settled")
    own = settled.where("content is null").select("k1", "k2", "first", "last")
    more = compare(base, settled.where("content is not null"), length)
    spans = own.unionByName(more).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or "").encode()
                runs, until, removed, kept = 0, 0, 0, []
                for x in sorted((x["first"], x["last"] + length) for x in batch.column(2)[i].as_py() or ()):
                    if x[0] > until or not runs:
                        runs += 1
                        kept.append(text[until : x[0]])
                        removed += x[1] - x[0]
                        until = x[1]
                    elif x[1] > until:
                        removed += x[1] - until
                        until = x[1]
                left = b"".join([*kept, text[until:]])
                out.append((len(text), removed, runs, hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = base.join(spans, ["k1", "k2"], "left").select("id", "text", "spans").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return out if keep_bytes else out.drop("kept")
