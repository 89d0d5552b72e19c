"""N-gram Jaccard join over whole documents; pairs are verified exactly.

1. A document's set of shingles becomes a sorted array of 64-bit hashes; equal
   sets are one node from here on.
2. Sizes are cut into bands.  Within a band two linked sets differ in fewer
   than `parts` hashes, so when the hash space is cut into `parts` parts, at
   least one part is equal in both.  A node emits one number for each part
   that holds hashes, for its own band and for the next one that it may reach.
3. Nodes that share a number form candidate groups (linear many edges).
4. The nodes of a group meet in tiles: blocks of one size band against blocks
   of the same and the next one.  Bits that the hashes set bound the overlap of
   a pair from above.  In large groups a first round of tiles compares the bits
   alone and leaves the smaller groups of nodes that may link; in the second
   round pairs that pass are intersected exactly.
5. Links make components; documents take their set's component.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, erased, written
from .graph import components, join_hot
from .words import WordHasher, mixed

#: Hashes and sets in a tile's side, about; a side is one set at least.
BLOCK, ROWS = 1_500_000, 1000
#: Hashes of a dense part: at least and on average; shared dense parts that are expected of sets that just link; sets of fewer hashes have no dense parts.
DENSE, HELD, SURE, SMALL = 5, 6.5, 20.0, 100
#: How often a set is divided into parts at most, until it fills enough of them.
DIVISIONS = 16
MASK = (1 << 64) - 1


class Rule:
    """Linked means 100 * shared >= percent * united; bands of sizes, and the parts that each band needs."""

    def __init__(self, percent: int, exact: bool = False, most: int = 1 << 31):
        self.percent, self.exact = percent, exact
        low, starts = 1, []
        while low < most:
            starts.append(low)
            low = max(low + 1, -(-low * 100 // percent))
        self.starts = np.array([*starts, most], np.int64)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def differ(self, band: int) -> int:
        """The most that two linked sets can differ by when the larger is in the band."""
        return 2 * (int(self.starts[band + 1]) - 1) * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int) -> int:
        """More parts than they can differ by, and some to spare for parts that are empty."""
        return self.differ(band) * 11 // 10 + 1

    def dense(self, band: int) -> tuple[int, int] | None:
        """Parts and divisions where numbers stand for DENSE hashes at least, or None where `parts` is enough.

        Where `parts` leaves few hashes to a part, as for 80 %, texts that share
        a passage meet in parts that hold a hash or two of it.  Larger parts are
        equal less often, so the hash space is divided several times: until sets
        that just link share SURE such parts on average, and none of them with a
        probability of about exp(-SURE).
        """
        low, high = int(self.starts[band]), int(self.starts[band + 1]) - 1
        if self.exact or high < SMALL or high >= DENSE * self.parts(band):
            return None
        parts = max(1, int(high / HELD))

        p = self.percent / 100
        # equal sizes (each lacks apart of the other's) and one within the other, for the smallest and largest of the band
        least = min(f for n in (low, high) for f in (parts * math.exp(-2 * n * (1 - p) / (1 + p) / parts) * self.tail(2 * n * p / (1 + p) / parts), parts * math.exp(-n * (1 - p) / parts) * self.tail(n * p / parts)))
        return parts, math.ceil(SURE / least)

    @staticmethod
    def tail(mean: float) -> float:
        """The probability of DENSE or more where `mean` are expected."""
        return 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(DENSE))

    def reaches(self, n: int, band: int) -> bool:
        """May a set of n link with one of the next band?"""
        return 100 * n >= self.percent * int(self.starts[band + 1])

    def least(self, both: np.ndarray) -> np.ndarray:
        """The least intersection for a link, by the sum of the sizes."""
        return -(-self.percent * both // (100 + self.percent))


def shingle_hashes(texts: list[str | None], k: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text (the whole sequence where there are fewer words)."""
    for h in hasher.texts([(t or "").encode() for t in texts]):
        n = max(1, len(h) - k + 1) if len(h) else 0
        s = np.zeros(n, np.uint64)
        for i in range(min(k, len(h))):
            s = mixed(s + h[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
        yield np.unique(s)


def part_numbers(s: np.ndarray, band: int, rule: Rule) -> np.ndarray:
    """Numbers of the filled parts of the hash space: of the band, the division, the part and a sum over the part's hashes.

    Two linked sets agree on more parts than are empty in both, and so on a
    filled one, if either set fills more parts than they can `differ` by.  A
    set that doesn't is divided anew by other bits, until it does.  Two sets
    share all divisions up to the first in which either fills enough, so no
    link is lost; empty parts are named in the last division alone, which a
    set of random hashes hardly ever reaches.  Where the rule has dense parts,
    there are as many divisions as it says, and parts of fewer hashes are left
    out.
    """
    if found := rule.dense(band):
        return dense_numbers(s, band, *found)
    parts, differ = rule.parts(band), rule.differ(band)
    out = []
    for division in range(DIVISIONS):
        numbers, held = divided(s, band, division, parts)
        out.append(numbers[held > 0])
        if (held > 0).sum() > differ:
            return np.concatenate(out)
    return np.concatenate([*out, numbers[held == 0]])


def divided(s: np.ndarray, band: int, division: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each part of a division, and how many hashes it holds."""
    turned = s if not division else mixed(s + np.uint64(division * 0xA0761D6478BD642F & MASK))
    place = ((turned >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, place, mixed(s ^ np.uint64(0xD6E8FEB86659FD93)))
    sums += np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(sums + np.uint64((band * 1024 + division) * 0xC2B2AE3D27D4EB4F & MASK)).view(np.int64), np.bincount(place, minlength=parts)


def dense_numbers(s: np.ndarray, band: int, parts: int, divisions: int) -> np.ndarray:
    """Numbers of the parts of DENSE hashes or more, in each of the divisions."""
    out = [numbers[held >= DENSE] for numbers, held in (divided(s, band, division, parts) for division in range(divisions))]
    return np.concatenate(out)


def node_of(s: np.ndarray) -> tuple[bytes, int]:
    """The 16-byte key of a set and its node: an even number made of the key's first half."""
    import xxhash

    key = xxhash.xxh3_128_digest(s.tobytes())
    return key, int.from_bytes(key[:8], "little", signed=True) & ~1


def describe(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n, node, set_key for each row."""
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                sizes, keys = [], []
                for s in shingle_hashes(some.column(1).to_pylist(), k, hasher):
                    sizes.append(len(s))
                    keys.append(node_of(s))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array([x[0] for x in keys], pa.binary())], ["id", "n", "node", "set_key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n long, node long, set_key binary")


def part_rows(docs: DataFrame, text_col: str, k: int, percent: int, exact: bool = False) -> DataFrame:
    """(number, who): the part numbers of each set's band (who: its node) and of the next one (node + 1: a guest), once a task."""
    rule = Rule(percent, exact)

    def run(batches):
        given: set[int] = set()
        hasher = WordHasher()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                numbers, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for s in shingle_hashes(batch.column(0).slice(begin, 1000).to_pylist(), k, hasher):
                    n, node = len(s), node_of(s)[1]
                    if not n or node in given:
                        continue
                    given.add(node)
                    b = int(rule.band(np.int64(n)))
                    numbers.append(part_numbers(s, b, rule))
                    who.append(np.full(len(numbers[-1]), node))
                    if rule.reaches(n, b):
                        numbers.append(part_numbers(s, b + 1, rule))
                        who.append(np.full(len(numbers[-1]), node + 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(np.concatenate(who))], ["number", "who"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "number long, who long")


def candidate_edges(parts: DataFrame) -> DataFrame:
    """(a, b): each node with another of its groups, a group being the nodes that share a part number."""
    def run(batches):
        number = leader = None  # of the group at hand
        for batch in batches:
            left, right = [], []
            v, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = np.r_[number is not None and len(v) > 0 and v[0] == number, v[1:] == v[:-1]] if len(v) else np.zeros(0, bool)
            near = np.flatnonzero(same | np.r_[same[1:], True])  # rows alone with their number are passed over
            for i in near.tolist():
                if not same[i]:
                    number, leader = int(v[i]), int(w[i])
                elif leader is not None:
                    if not leader & 1 or not int(w[i]) & 1:  # groups of guests alone link nothing
                        left.append(int(w[i]) & ~1)
                        right.append(leader & ~1)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    # Own nodes (even) sort before guests within a number, so the leader is a guest only in groups of guests alone.
    dealt = parts.repartition("number").sortWithinPartitions("number", F.col("who").bitwiseAND(1), "who")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def bits_of(s: np.ndarray) -> np.ndarray:
    """A bitmap with the hashes' low bits set, of four to eight bits a hash."""
    words = 1 << max(0, (4 * len(s) - 1).bit_length() - 6)
    at = s & np.uint64(64 * words - 1)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


class Tile:
    """Nodes that meet: sizes, bitmaps, and which pairs count (sides 0 and 1 where two blocks meet, else one side)."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], sides: list[int], both: bool, rule: Rule):
        self.rule, self.both = rule, both
        self.order = np.argsort(np.array(sizes, np.int64), kind="stable")
        self.size, self.sides = np.array(sizes, np.int64)[self.order], np.array(sides)[self.order]
        bits = [bits[i] for i in self.order.tolist()]
        width = np.array(list(map(len, bits)))  # ascends, as sizes do
        self.begins = np.flatnonzero(np.r_[True, width[1:] != width[:-1]]).tolist()
        self.ends = [*self.begins[1:], len(bits)]
        self.classes = [np.stack(bits[a:b]) for a, b in zip(self.begins, self.ends, strict=True)]
        self.narrow = {}
        self.root = list(range(len(sizes)))

    def folded(self, c: int, width: int) -> np.ndarray:
        """The bitmaps of a class at a narrower width: a bit falls where it does when the parts are laid together."""
        if (c, width) not in self.narrow:
            bits = self.classes[c]
            self.narrow[c, width] = bits if bits.shape[1] == width else np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), 1)
        return self.narrow[c, width]

    def apart(self, i: int, until: int) -> np.ndarray:
        """How many bits tell i from each place behind it, up to until: no more than hashes do."""
        c = bisect_right(self.begins, i) - 1
        own = self.classes[c][i - self.begins[c]]
        out = []
        while c < len(self.begins) and self.begins[c] < until:
            a, b = max(i + 1, self.begins[c]), min(until, self.ends[c])
            out.append(np.bitwise_count(self.folded(c, len(own))[a - self.begins[c] : b - self.begins[c]] ^ own).sum(1, dtype=np.int64))
            c += 1
        return np.concatenate(out)

    def likely(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each place in the order: the places behind it whose overlap may be enough by the bits, and how much is enough."""
        size = self.size
        for i in range(len(size) - 1):
            until = int(np.searchsorted(size, size[i] * 100 // self.rule.percent, "right"))
            if until > i + 1:
                both = size[i] + size[i + 1 : until]
                need = self.rule.least(both)
                good = (both - self.apart(i, until)) // 2 >= need
                if not self.both:
                    good &= self.sides[i + 1 : until] != self.sides[i]
                at = np.flatnonzero(good)
                if len(at):
                    yield i, at + i + 1, need[at]

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)


def likely_links(tile: Tile, nodes: list[int]) -> list[tuple[int, int]]:
    """(node, another) for the nodes of a tile that may link by their bits: the same groups as all such pairs make."""
    for i, j, _ in tile.likely():
        for x in j.tolist():
            tile.unite(i, x)
    own = [nodes[i] for i in tile.order.tolist()]
    return [(own[i], own[k]) for i in range(len(own)) if (k := tile.find(i)) != i]


def exact_links(tile: Tile, nodes: list[int], hashes: list[np.ndarray], weights: list[int]) -> list[tuple[int, int, int]]:
    """Verified links of a tile: (node, smallest linked node seen, number of documents linked)."""
    own = [(nodes[i], hashes[i], weights[i]) for i in tile.order.tolist()]
    count = np.zeros(len(own), np.int64)
    for i, j, need in tile.likely():
        mine = own[i][1]
        flat = np.concatenate([own[x][1] for x in j.tolist()])
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        shared = np.add.reduceat((mine[at] == flat).astype(np.int64), np.r_[0, np.cumsum(tile.size[j])[:-1]])
        for x in j[shared >= need].tolist():
            count[i] += own[x][2]
            count[x] += own[i][2]
            tile.unite(i, x)
    return [(own[i][0], own[tile.find(i)][0], int(count[i])) for i in range(len(own)) if count[i]]


def member_hashes(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """node, n, hashes for each member (node, n, rep: a document's id, set_key): members' texts alone become arrays again."""
    # members grow with the input, so they are never broadcast
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text")).join(members.hint("merge"), "rep").select("node", "set_key", "n", "text", "rep")

    def run(batches):
        import xxhash

        hasher, now, seen = WordHasher(), None, set()

        def new(row):  # the first of the rows of one id, text and node; rows come in order of id
            nonlocal now
            node, rep, text = row
            if rep != now:
                now = rep
                seen.clear()
            key = (node, xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass")))
            return not (key in seen or seen.add(key))

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                fresh = [i for i, row in enumerate(zip(*(some.column(k).to_pylist() for k in (0, 4, 3)), strict=True)) if new(row)]
                some = some.take(pa.array(fresh, pa.int64())) if len(fresh) < some.num_rows else some
                got = [s.tobytes() for s in shingle_hashes(some.column(3).to_pylist(), k, hasher)]
                good = [i for i, (s, key) in enumerate(zip(got, some.column(1).to_pylist(), strict=True)) if xxhash.xxh3_128_digest(s) == key]  # an id may have several texts
                taken = some.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(2), pa.array([got[i] for i in good], pa.binary())], ["node", "n", "hashes"])

    return texts.mapInArrow(run, "node long, n long, hashes binary")


def blocks_of():
    """How many blocks the sets of a group would fill."""
    return F.greatest(F.sum("n") / BLOCK, F.count("*") / ROWS)


def tiled(grouped: DataFrame, percent: int, payload: str, work, schema: str) -> DataFrame:
    """work(rows of one tile, whether all its pairs count) -> tuples; grouped: group, node, n, weight of the group (in blocks), payload, others.

    Groups of up to BLOCK hashes and ROWS sets are one tile.  Larger ones are
    cut by bands of sizes, and bands by salts of the node, into blocks that meet
    pairwise.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    fine = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / percent))).cast("int")
    banded = grouped.where("weight > 1").groupBy("group", fine.alias("fine")).agg(F.ceil(blocks_of()).cast("int").alias("blocks"))
    maps = banded.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("fine", "blocks"))).alias("blocks"))
    placed = grouped.join(maps, "group", "left").withColumn("fine", fine)
    salt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    own = F.coalesce(F.element_at("blocks", F.col("fine")), F.lit(1))
    up, down = (F.coalesce(F.element_at("blocks", F.col("fine") + d), F.lit(0)) for d in (1, -1))
    mine = salt(own)

    def tile(fine_a, salt_a, fine_b, salt_b, side):
        return F.struct(fine_a.alias("fa"), salt_a.alias("sa"), fine_b.alias("fb"), salt_b.alias("sb"), side.alias("side"))

    def each(n, f):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<fa:int,sa:int,fb:int,sb:int,side:int>>"))

    same = each(own, lambda t: tile(F.col("fine"), F.least(mine, t), F.col("fine"), F.greatest(mine, t), F.when(mine <= t, 0).otherwise(1)))
    above = each(up, lambda t: tile(F.col("fine"), mine, F.col("fine") + 1, t, F.lit(0)))
    below = each(down, lambda t: tile(F.col("fine") - 1, t, F.col("fine"), mine, F.lit(1)))
    alone = F.array(tile(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    keys = ["group", "fa", "sa", "fb", "sb"]
    others = [c for c in grouped.columns if c not in {"group", "weight"}]
    tiles = placed.withColumn("tile", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(same, above, below)))).select("group", *(f"tile.{c}" for c in (*keys[1:], "side")), *others)

    def run(batches):
        key, held = None, {}

        def done():
            got = work(list(held.values()), key[1:3] == key[3:5]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names) if got else None

        for batch in batches:
            columns = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != key:
                    if (out := done()) is not None:
                        yield out
                    key, held = row[:5], {}
                row = dict(zip(columns, row, strict=True))
                row[payload] = np.frombuffer(row[payload], np.uint64)
                held[row["node"]] = row
        if (out := done()) is not None:
            yield out

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def narrowed(groups: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """group, node, weight: large groups cut down to the groups of nodes that may link by their bits; small ones as they are."""
    rule = Rule(percent)

    def weighed(df):
        return df.join(df.groupBy("group").agg(blocks_of().alias("weight")), "group")

    def sketch(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array([bits_of(np.frombuffer(h.as_py(), np.uint64)).tobytes() for h in batch.column(4)], pa.binary())], ["group", "weight", "node", "n", "bits"])

    def work(rows, both):
        tile = Tile([r["n"] for r in rows], [r["bits"] for r in rows], [r["side"] for r in rows], both, rule)
        return likely_links(tile, [r["node"] for r in rows])

    all_ = weighed(groups)
    large = all_.where("weight > 1").select("group", "weight", "node").join(arrays, "node").select("group", "weight", "node", "n", "hashes").mapInArrow(sketch, "group long, weight double, node long, n long, bits binary")
    edges = tiled(large, percent, "bits", work, "a long, b long")
    small = all_.where("weight <= 1").select("group", "node", "weight")
    kept = components(edges).withColumnRenamed("component", "group").join(groups.select("node", "n"), "node")
    return small.unionByName(weighed(kept).select("group", "node", "weight"))


def verified(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """node, other, links from tiles of the candidate groups; members: node, group, n, rep (a document), copies, set_key."""
    rule = Rule(percent)
    arrays = written(member_hashes(members, docs, id_col, text_col, k), "arrays")
    groups = written(narrowed(members.select("group", "node", "n"), arrays, percent), "narrowed")

    def work(rows, both):
        hashes = [r["hashes"] for r in rows]
        tile = Tile([r["n"] for r in rows], [bits_of(h) for h in hashes], [r["side"] for r in rows], both, rule)
        return exact_links(tile, [r["node"] for r in rows], hashes, [r["copies"] for r in rows])

    ready = groups.join(arrays, "node").join(members.select("node", "copies"), "node")
    links = written(tiled(ready, percent, "hashes", work, "node long, other long, links long"), "links")
    erased(arrays, groups)
    return links


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, exact: bool = False) -> DataFrame:
    """Per row: id, n_shingles, component_id, n_links.

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of
    k-word shingles; n_links counts the rows a row links with.  component_id is
    the smallest id reachable by links, the row's own at least.  Null and empty
    texts have an empty set and link with nothing.  Repeated rows link like any
    two; a row with a null id takes the component of its set, if a row with an
    id has that set too, and is not compared otherwise (the pipeline numbers its
    rows first, so that all are compared).  Ties don't matter: a link is a fact
    of two sets.  Texts of any length are read whole; an empty table gives no
    rows; columns other than the two are not read, so their names don't matter.

    At 90 % candidates are found without loss.  Where fewer percent leave a part
    only a few hashes (80 %, sets of SMALL shingles and more), larger parts are
    used instead, and a pair that just links is missed with a probability of
    about exp(-SURE); exact=True keeps to the small parts, which miss none and
    put more texts into one group.
    """
    rows = written(describe(docs, id_col, text_col, k), "sets")
    sets = written(rows.where("n > 0").groupBy("node", "set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")), "nodes")
    groups = components(candidate_edges(part_rows(docs, text_col, k, percent, exact))).withColumnRenamed("component", "group")
    found = groups.join(sets.select("node", "n", "rep", "copies", "set_key"), "node")
    members = written(found, "members")
    links = verified(members, docs, id_col, text_col, k, percent)
    linked = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    own = sets.select("node", "set_key", "rep", "copies")
    parts = own.join(linked, "node").join(counts, "node", "left")
    reps = parts.groupBy("component").agg(F.min("rep").alias("least"))
    linked_sets = parts.join(reps, "component").select("node", "set_key", "copies", "least", "links")
    copied = own.join(linked_sets.select("node"), "node", "left_anti").where("copies > 1").select("node", "set_key", "copies", F.col("rep").alias("least"), F.lit(0).cast("long").alias("links"))
    told = written(linked_sets.unionByName(copied).select("set_key", "copies", "least", "links"), "told")
    erased(sets, groups, members, links, linked)
    total = rows.count()
    hot = told.where(F.col("copies") > F.lit(max(total * HOT_SHARE, 100))).select("set_key")  # at most 1 / HOT_SHARE rows
    out = join_hot(rows.select("id", "n", "set_key"), told, ["set_key"], hot)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"))
