"""Names: ordered-rule classification and normal forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns on the upper-case name, the first that matches decides.
AGENCY_RULES = (
    (r"\bSHERIFF", "county_sheriff"),
    (r"\b(STATE POLICE|STATE PATROL|HIGHWAY PATROL|DEPARTMENT OF PUBLIC SAFETY)\b", "state_police"),
    (r"\b(UNIVERSITY|COLLEGE|CAMPUS|SCHOOL DISTRICT|BOARD OF EDUCATION)\b", "university_police"),
    (r"\b(TRANSIT|METRO(POLITAN)? TRANSIT|RAIL|RAILROAD|SUBWAY|BUS)\b", "transit_police"),
    (r"\b(AIRPORT|PORT AUTHORITY|SEAPORT|HARBOR|MARITIME)\b", "port_or_airport_police"),
    (r"\b(PARK|FOREST|CONSERVATION|FISH AND WILDLIFE|WILDLIFE|NATURAL RESOURCES)\b", "park_or_conservation_police"),
    (r"\b(TRIBAL|NATION|PUEBLO|BAND OF|RESERVATION|INDIAN)\b", "tribal_police"),
    (r"\b(MARSHAL|CONSTABLE)\b", "marshal_or_constable"),
    (r"\b(HOSPITAL|MEDICAL CENTER|HEALTH)\b", "special_jurisdiction"),
    (r"\b(HOUSING AUTHORITY)\b", "special_jurisdiction"),
)
# Types by the source's own label.
AGENCY_LABELS = {
    "city": "municipal_police",
    "county": "county_sheriff",
    "state police": "state_police",
    "university or college": "university_police",
    "tribal": "tribal_police",
    "federal": "federal",
    "other state agency": "state_special_jurisdiction",
    "other": "special_jurisdiction",
}
# Words that say nothing on which department or place is meant.
DEPARTMENT_WORDS = (
    "POLICE DEPARTMENT", "POLICE DEPT", "DEPARTMENT OF POLICE", "POLICE", "DEPARTMENT", "DEPT", "OFFICE", "BUREAU", "DIVISION", "DIV",
    "PD", "SO", "CO", "COUNTY SHERIFFS?", "SHERIFFS?", "PUBLIC SAFETY", "DPS", "MARSHALS?", "THE", "OF", "CITY OF", "TOWN OF",
    "VILLAGE OF", "BOROUGH OF", "TOWNSHIP OF", "UNIVERSITY OF", "STATE",
)
PLACE_WORDS = (
    "CITY", "TOWN", "VILLAGE", "BOROUGH", "TOWNSHIP", "CDP", "MUNICIPALITY", "PLANTATION", "URBAN COUNTY", "METROPOLITAN GOVERNMENT",
    "CONSOLIDATED GOVERNMENT", "GOVERNMENT", "UT", "CCD", "COUNTY", "PARISH", "CENSUS AREA", "PLANNING REGION", "BALANCE", "METRO",
)


def classify(name: Column, label: Column, rules: Sequence[tuple[str, str]] = AGENCY_RULES, labels: dict[str, str] | None = None) -> Column:
    """The first rule that the upper-case name meets, else the type of the source's label, else 'other'.

    Among entities that are county_sheriff by label, POLICE in the name makes county_police.
    """
    up, given = F.upper(F.coalesce(name, F.lit(""))), F.lower(F.trim(F.coalesce(label, F.lit(""))))
    mapped = None
    for text, kind in (AGENCY_LABELS if labels is None else labels).items():
        typed = F.when(up.contains("POLICE") & ~up.contains("SHERIFF"), "county_police").otherwise(kind) if kind == "county_sheriff" else F.lit(kind)
        mapped = F.when(given == text, typed) if mapped is None else mapped.when(given == text, typed)
    out = None
    for pattern, kind in rules:
        out = F.when(up.rlike(pattern), kind) if out is None else out.when(up.rlike(pattern), kind)
    return out.otherwise(mapped.otherwise("other"))


def normalize(c: Column, stopwords: Sequence[str]) -> Column:
    """Upper case, signs as blanks, stopwords out, single blanks, trimmed."""
    up = F.regexp_replace(F.upper(c), "[^A-Z0-9]", " ")
    bare = F.regexp_replace(up, r"\b(" + "|".join(stopwords) + r")\b", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def normalize_agency(c: Column) -> Column:
    return normalize(c, DEPARTMENT_WORDS)


def normalize_place(c: Column) -> Column:
    return normalize(c, PLACE_WORDS)


def display_name(name: Column, unit: Column) -> Column:
    """name (unit), unless the unit is missing, blank or part of the name."""
    there = unit.isNotNull() & (F.trim(unit) != "") & ~F.lower(name).contains(F.lower(unit))
    return F.when(there, F.concat(name, F.lit(" ("), unit, F.lit(")"))).otherwise(name)
