"""Identifier codes as strings: padding, composition, canonical forms, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit state codes and abbreviations.
STATE_FIPS = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08", "CT": "09", "DE": "10", "DC": "11", "FL": "12",
    "GA": "13", "HI": "15", "ID": "16", "IL": "17", "IN": "18", "IA": "19", "KS": "20", "KY": "21", "LA": "22", "ME": "23",
    "MD": "24", "MA": "25", "MI": "26", "MN": "27", "MS": "28", "MO": "29", "MT": "30", "NE": "31", "NV": "32", "NH": "33",
    "NJ": "34", "NM": "35", "NY": "36", "NC": "37", "ND": "38", "OH": "39", "OK": "40", "OR": "41", "PA": "42", "RI": "44",
    "SC": "45", "SD": "46", "TN": "47", "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53", "WV": "54", "WI": "55",
    "WY": "56", "AS": "60", "GU": "66", "MP": "69", "PR": "72", "VI": "78",
}
STATE_ALIASES = {"NB": "NE"}
TRUE_FLAGS = ("Y", "YES", "TRUE", "1")


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The value of a small fixed table, else default (null)."""
    got = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return F.coalesce(got, default) if default is not None else got


def pad(c: Column, width: int) -> Column:
    """Trimmed and zero-filled on the left; longer codes stay as they are, blanks are null."""
    t = F.trim(c.cast("string"))
    return F.when(F.length(t) == 0, None).when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def place_geoid(state: Column, place: Column) -> Column:
    return F.concat(pad(state, 2), pad(place, 5))


def county_geoid(state: Column, county: Column) -> Column:
    return F.concat(pad(state, 2), pad(county, 3))


def cousub_geoid(state: Column, county: Column, cousub: Column) -> Column:
    return F.concat(pad(state, 2), pad(county, 3), pad(cousub, 5))


def strip_geoidfq(c: Column) -> Column:
    """The part behind the first US, or the value itself."""
    return F.when(c.contains("US"), F.regexp_replace(c, "^.*?US", "")).otherwise(c)


def canonical_state_abbr(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return lookup(s, STATE_ALIASES, s)


def state_fips(abbr: Column) -> Column:
    return lookup(canonical_state_abbr(abbr), STATE_FIPS)


def state_abbr(fips: Column) -> Column:
    return lookup(fips, {v: k for k, v in STATE_FIPS.items()})


def to_int(c: Column) -> Column:
    """A whole number; decimals are cut off, anything else is null."""
    return F.trim(c.cast("string")).try_cast("double").try_cast("long")


def to_int_strict(c: Column) -> Column:
    """A whole number written without decimals, else null."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))


def to_flag(c: Column) -> Column:
    """Y, YES, TRUE and 1 in any case are true, all else and null false."""
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin(*TRUE_FLAGS), F.lit(False))


def strip_suffix(c: Column, suffix: str = "#balance") -> Column:
    return F.replace(c, F.lit(suffix), F.lit(""))


def cohort_key(kind: Column, band: Column, urbanicity: Column) -> Column:
    """kind | band | urbanicity with 'unknown' for a null band or urbanicity; a null kind gives null."""
    unknown = F.lit("unknown")
    return F.concat(kind, F.lit(" | "), F.coalesce(band, unknown), F.lit(" | "), F.coalesce(urbanicity, unknown))


def contains_ci(c: Column, part: str) -> Column:
    return F.lower(c).contains(part.lower())


def code_ok(c: Column, width: int) -> Column:
    """Exactly `width` digits; null passes as null."""
    return c.rlike(f"^[0-9]{{{width}}}$")


def freshness(latest: Column, now: int | Column) -> Column:
    age = (now if isinstance(now, Column) else F.lit(now)) - latest
    return F.when(latest.isNull(), None).when(age <= 1, "current").when(age <= 2, "recent").otherwise("stale")
