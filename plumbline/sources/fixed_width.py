"""Fixed-width text: a layout is a dict of half-open slices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import lookup

# Record layouts (0-based, end exclusive).
POLICE_EMPLOYEES = {
    "record_type": (0, 1), "state_code_numeric": (1, 3), "ori7": (3, 10), "population_group": (10, 12), "year2": (13, 15), "sequence": (15, 20),
    "population": (23, 32), "agency_name": (32, 56), "state_name": (56, 62), "male_officers": (62, 67), "male_civilians": (67, 72), "male_total": (72, 77),
    "female_officers": (77, 82), "female_civilians": (82, 87), "female_total": (87, 92), "total_employees": (92, 97), "officer_rate_x10": (97, 100), "employee_rate_x10": (100, 103),
}
POLICE_NUMBERS = ("population", "male_officers", "male_civilians", "male_total", "female_officers", "female_civilians", "female_total", "total_employees", "officer_rate_x10", "employee_rate_x10")
FINANCE_AMOUNTS = {"gov_id": (0, 12), "item": (12, 15), "amount": (15, 27), "data_year": (27, 31), "flag": (31, 32)}
UNIT_DIRECTORY = {"gov_id": (0, 12), "name": (12, 76), "county": (76, 111), "place_code": (111, 116), "population": (116, 125), "fiscal_year_ending": (140, 144), "survey_year2": (144, 146)}

# Kinds of government by the third character of their id.
GOVERNMENT_TYPES = {"0": "State", "1": "County", "2": "City", "3": "Township", "4": "Special District", "5": "Independent School District"}


def parse(lines: DataFrame, layout: dict[str, tuple[int, int]], numbers: Sequence[str] = (), least: int = 0, where: Callable[[Column], Column] | None = None, pad_to: int | None = None, signed: bool = False, line: str = "value") -> DataFrame:
    """Trimmed slices of lines of at least `least` characters; numbers are null unless digits alone."""
    v = F.rpad(F.col(line), pad_to, " ") if pad_to else F.col(line)
    rows = lines.where(F.length(line) >= least)
    rows = rows.where(where(F.col(line))) if where is not None else rows
    out = []
    for name, (a, b) in layout.items():
        c = F.trim(F.substring(v, a + 1, b - a))
        out.append((F.when(c.rlike(r"^[+-]?[0-9]+$" if signed else "^[0-9]+$"), c.try_cast("long")) if name in numbers else c).alias(name))
    return rows.select(*out)


def full_year(two: Column) -> Column:
    """80 to 99 are 19yy, all else 20yy."""
    n = two.try_cast("int")
    return F.when(n >= 80, 1900 + n).otherwise(2000 + n)


def read_fixed_width(spark: SparkSession, path: str, layout: dict[str, tuple[int, int]], encoding: str = "ISO-8859-1", **options) -> DataFrame:
    """Lines of text files under path (encoding by the csv reader, which splits on nothing here)."""
    lines = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    return parse(lines, layout, **options)


def read_police_employees(spark: SparkSession, path: str) -> DataFrame:
    out = read_fixed_width(spark, path, POLICE_EMPLOYEES, numbers=POLICE_NUMBERS, least=103, where=lambda c: c.startswith("5"))
    return out.withColumn("data_year", full_year(F.col("year2")))


def read_finance_amounts(spark: SparkSession, path: str, items: Sequence[str] = ()) -> DataFrame:
    out = read_fixed_width(spark, path, FINANCE_AMOUNTS, numbers=("amount", "data_year"), least=32, signed=True)
    out = out.where(F.col("item").isin(*items)) if items else out
    kind = F.substring("gov_id", 3, 1)
    return out.withColumns({"state_fips": F.substring("gov_id", 1, 2), "gov_type_code": kind, "gov_type": lookup(kind, GOVERNMENT_TYPES), "county_fips": F.substring("gov_id", 4, 3), "pid6": F.substring("gov_id", 7, 6)})


def read_unit_directory(spark: SparkSession, path: str) -> DataFrame:
    return read_fixed_width(spark, path, UNIT_DIRECTORY, numbers=("population",), pad_to=146).where("gov_id <> ''")


def read_members(spark: SparkSession, folder: str, readers: dict[str, Callable[[SparkSession, str], DataFrame]]) -> dict[str, DataFrame]:
    """One DataFrame for each file-name pattern of a landed archive, by its own reader."""
    return {name: reader(spark, f"{folder.rstrip('/')}/{name}") for name, reader in readers.items()}


def render(layout: dict[str, tuple[int, int]], width: int, columns: dict[str, tuple[Column, bool]]) -> Column:
    """A fixed-width line of columns (value, right-aligned?); what no column fills is blank."""
    parts, at = [], 0
    for name, (a, b) in sorted(((n, s) for n, s in layout.items() if n in columns), key=lambda x: x[1]):
        value, right = columns[name]
        if a > at:
            parts.append(F.lit(" " * (a - at)))
        parts.append((F.lpad if right else F.rpad)(F.substring(value.cast("string"), 1, b - a), b - a, " "))
        at = b
    return F.rpad(F.concat(*parts), width, " ")
