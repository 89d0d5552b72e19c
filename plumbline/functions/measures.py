"""Distances, similarities, bands and guarded arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-open population bands and urbanicity by the size of the urban area.
POPULATION_BANDS = ((10_000, "<10K"), (25_000, "10K-25K"), (50_000, "25K-50K"), (100_000, "50K-100K"), (250_000, "100K-250K"), (500_000, "250K-500K"), (1_000_000, "500K-1M"), (None, "1M+"))
URBANICITY = ((200_000, "Large urban"), (50_000, "Urban"), (5_000, "Small urban"))
EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))))  # least() passes over nulls


def band(c: Column, bands: Sequence[tuple[int | None, str]] = POPULATION_BANDS) -> Column:
    """The band of a number; null and negative numbers have none."""
    out = F.when(c < 0, None)
    for below, name in bands[:-1]:
        out = out.when(c < below, name)
    return out.when(c.isNotNull(), bands[-1][1])


def urbanicity(population: Column) -> Column:
    out = None
    for least, name in URBANICITY:
        out = F.when(population >= least, name) if out is None else out.when(population >= least, name)
    return out.otherwise("Rural")


def safe_ratio(n: Column, d: Column, times: float = 1.0) -> Column:
    """n / d * times where d > 0, else null."""
    return F.when(d > 0, n.cast("double") * F.lit(float(times)) / d)


def rel_divergence(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.abs(a - b).cast("double") / b)


def pct_change(start: Column, end: Column) -> Column:
    return F.when(start != 0, (end - start).cast("double") / F.abs(start) * 100)


def finite(c: Column) -> Column:
    """NaN and infinities are null, never 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


#: The longest text whose characters fit the bits of a number.
BITS = 60


def _chars(c: Column) -> Column:
    return F.split(c, "(?!^)")


def _lcs_bits(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, b no longer than BITS: a row of the table is the bits of one number.

    A bit is 1 where the row doesn't rise; each character of a makes the next
    row by an addition, whose carries move the rises.
    """
    one = F.lit(1).cast("long")
    places = F.transform(_chars(b), lambda c, j: F.struct(c.alias("c"), F.call_function("shiftleft", one, j).alias("bit")))
    full = F.call_function("shiftleft", one, F.length(b)) - 1

    def step(held: Column, x: Column) -> Column:
        row, same = held["row"], F.aggregate(held["places"], F.lit(0).cast("long"), lambda n, p: F.when(p["c"] == x, n + p["bit"]).otherwise(n))
        after = F.transform(F.array(row.bitwiseAND(same)), lambda hit: (row + hit).bitwiseOR(row - hit).bitwiseAND(held["full"]))  # the hits are made once
        return F.struct(after[0].alias("row"), held["places"].alias("places"), held["full"].alias("full"))

    first = F.struct(full.alias("row"), places.alias("places"), full.alias("full"))
    return F.length(b) - F.aggregate(_chars(a), first, step, lambda held: F.bit_count(held["row"]))


def _lcs_rows(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of any texts: one row of the table after another, as folds over characters."""
    empty = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(previous: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            up, left, corner = F.element_at(previous, j + 1), F.element_at(acc, -1), F.element_at(previous, j)
            return F.concat(acc, F.array(F.when(F.substring(b, j, 1) == x, corner + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(_chars(a), empty, row), -1)


def _lcs(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    return F.when(n == 0, F.lit(0)).when(n <= BITS, _lcs_bits(long, short)).otherwise(_lcs_rows(a, b))


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (length of both): 100 for equal texts, 0 for nothing in common."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(100.0)).otherwise(F.lit(200.0) * _lcs(a, b) / both)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def name_words(c: Column) -> Column:
    """The distinct words of a name, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Likeness (0 to 100) of two names as sets of words: order, repeats and words that one has more count little."""

    def score(t: Column) -> Column:
        s, u, v = t["s"], t["u"], t["v"]
        blank = F.when(F.length(s) > 0, 1).otherwise(0)
        n_u, n_v = (F.length(s) + F.when(F.length(w) > 0, blank + F.length(w)).otherwise(0) for w in (u, v))
        # common is a prefix of both joined texts, so its likeness needs no table, and it belongs to the longest common subsequence
        prefix = lambda n: F.lit(200.0) * F.length(s) / (F.length(s) + n)
        joined = lambda: F.lit(200.0) * (F.length(s) + blank + _lcs(u, v)) / F.greatest(n_u + n_v, F.lit(1))
        inside = (F.length(s) > 0) & ((F.length(u) == 0) | (F.length(v) == 0))
        return F.when(inside, F.lit(100.0)).when(F.length(s) > 0, F.greatest(joined(), prefix(n_u), prefix(n_v))).otherwise(joined())

    def split(p: Column) -> Column:
        x, y = p["x"], p["y"]
        parts = F.struct(F.array_join(F.array_sort(F.array_intersect(x, y)), " ").alias("s"), F.array_join(F.array_sort(F.array_except(x, y)), " ").alias("u"), F.array_join(F.array_sort(F.array_except(y, x)), " ").alias("v"))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(let(parts, score))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(name_words(a).alias("x"), name_words(b).alias("y")), split))
