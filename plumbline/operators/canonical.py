"""Builders of dimensions and facts; every de-duplication has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def latest_wins(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row a key: the last by the order given (which has to be total)."""
    return _ranked(df, keys, [F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in order])


def first_wins(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    return _ranked(df, keys, [F.asc_nulls_last(c) if isinstance(c, str) else c.asc_nulls_last() for c in order])


def append_missing(spine: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spine, and the rows of other whose key it lacks."""
    return spine.unionByName(other.join(spine.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def dim_time(spark: SparkSession, first: int = 1985, last: int = 2026, cutoff: int = 2025, partial_note: str = "year in progress", census_note: str = "census of governments year") -> DataFrame:
    """One row a year: complete up to the cutoff, census years, notes."""
    y = F.col("data_year")
    done, census = y <= cutoff, y % 5 == 2
    notes = F.concat_ws(" ", F.when(~done, partial_note), F.when(census, census_note))
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("data_year")).select("data_year", done.alias("is_complete"), done.alias("crime_usable"), census.alias("is_cog_year"), F.nullif(notes, F.lit("")).alias("notes"))


def dim_geography(parts: dict[str, DataFrame], urban: DataFrame | None = None, drop_ids: Sequence[str] = ()) -> DataFrame:
    """The union of levels (each with geo code and name), keyed level:code; places take class and urban area from `urban` by code."""
    out = None
    for level, df in parts.items():
        one = df.withColumns({"geo_level": F.lit(level), "geo_id": F.concat(F.lit(level + ":"), F.col("geoid"))})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out = out.where(~F.col("geo_id").isin(*drop_ids)) if drop_ids else out
    return out.join(urban, "geo_id", "left") if urban is not None else out


# Classes of places that are counties too, and of governments that several places share.
INDEPENDENT_CITY = "C7"
CONSOLIDATED = ("C8", "C9")


def geography_levels(counties: DataFrame, places: DataFrame, cousubs: DataFrame, states: DataFrame, classes: DataFrame, urban_parts: DataFrame, urban_areas: DataFrame, drop_ids: Sequence[str] = ()) -> DataFrame:
    """The four levels as one table: geo_id, geo_level, geoid, name, state, state_fips, county_fips, place_fips, cousub_fips, class_code, uace, urban_area, urbanicity, is_independent_city, is_consolidated.

    counties, places and cousubs have geoid (zeros in front may be lost), name
    and state; states code and state.  classes (geoid, class_code) says what a
    place is, urban_parts (geoid, uace, urban_area, land) which urban areas it
    lies in; of several the one with most of its land counts, of equals the
    first by code.  urban_areas (uace, population) give the setting; a place in
    none is rural.  Rows without a geoid and ids in drop_ids are left out.  The
    flags follow from the class, false for the other levels.
    """
    def level(df: DataFrame, name: str, width: int, **cuts: tuple[int, int]) -> DataFrame:
        code = F.lpad(F.trim(F.col("geoid").cast("string")), width, "0")
        own = df.where(F.trim(F.coalesce(F.col("geoid").cast("string"), F.lit(""))) != "").select(code.alias("geoid"), "name", "state")
        return own.select(F.lit(name).alias("geo_level"), F.concat(F.lit(f"{name}:"), "geoid").alias("geo_id"), "geoid", "name", "state", F.substring("geoid", 1, 2).alias("state_fips"), *(F.substring("geoid", *at).alias(c) for c, at in cuts.items()))

    pad = lambda c, n: F.lpad(F.trim(F.col(c).cast("string")), n, "0")
    parts = urban_parts.where(F.trim(F.coalesce(F.col("uace").cast("string"), F.lit(""))) != "").select(pad("geoid", 7).alias("geoid"), pad("uace", 5).alias("uace"), "urban_area", F.coalesce("land", F.lit(0.0)).alias("land"))
    main = argmax_per(parts, ["geoid"], "land", "uace", ["urban_area"])
    sizes = urban_areas.groupBy(pad("uace", 5).alias("uace")).agg(F.max("population").alias("population"))
    place = level(places, "place", 7, place_fips=(3, 5)).join(classes.groupBy(pad("geoid", 7).alias("geoid")).agg(F.min("class_code").alias("class_code")), "geoid", "left").join(main, "geoid", "left").join(sizes, "uace", "left")
    place = place.withColumn("urbanicity", measures.urbanicity(F.coalesce("population", F.lit(0)))).drop("population")
    other = [level(counties, "county", 5, county_fips=(3, 3)), level(cousubs, "cousub", 10, county_fips=(3, 3), cousub_fips=(6, 5)), level(states.select(F.col("code").alias("geoid"), F.col("state").alias("name"), "state"), "state", 2)]
    out = place
    for df in other:
        out = out.unionByName(df, allowMissingColumns=True)
    out = out.where(~F.col("geo_id").isin(*drop_ids)) if drop_ids else out
    flags = {"is_independent_city": F.col("class_code") == INDEPENDENT_CITY, "is_consolidated": F.col("class_code").isin(*CONSOLIDATED)}
    return out.withColumns({c: F.coalesce(f, F.lit(False)) for c, f in flags.items()})


def argmax_per(df: DataFrame, keys: Sequence[str], by: str, tie: str, take: Sequence[str]) -> DataFrame:
    """Per key the row with the largest `by`; of equals the one with the smallest `tie`. Two aggregates, no sort."""
    lead = df.groupBy(*keys).agg(F.max(by).alias("_top"))
    return df.join(lead, list(keys)).where(F.col(by) == F.col("_top")).groupBy(*keys).agg(F.min(F.struct(tie, *take)).alias("b")).select(*keys, "b.*")


def change_events(df: DataFrame, keys: Sequence[str], rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row for each event whose condition holds: event name and detail."""
    events = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("event"), detail.cast("string").alias("detail"))) for name, (cond, detail) in rules.items()]))
    return df.select(*keys, F.explode(events).alias("e")).select(*keys, "e.event", "e.detail")


def staffing(records: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (key, source, data_year, parts and total) on entities whose key is unique: facts and a log.

    A source-year whose totals add up to 0 is rejected as a whole; rows without
    a total are not reported, so they are absent; of two records for an entity
    and year the larger total stays, and the log has the conflict.
    """
    unique = entities.groupBy("key").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"))
    zero = records.groupBy("source", "data_year").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("sum")).where("sum = 0").select("source", "data_year")
    linked = records.join(zero, ["source", "data_year"], "left_anti").where("total is not null").join(unique.where("n = 1").select("key", "entity_id"), "key")
    keys = ["entity_id", "data_year", "source"]
    best = latest_wins(linked, keys, "total", "male", "female")
    sworn = F.when(F.col("male").isNull() & F.col("female").isNull(), None).otherwise(F.coalesce("male", F.lit(0)) + F.coalesce("female", F.lit(0)))
    facts = best.select(*keys, sworn.alias("sworn"), "total")
    log = (
        zero.select(F.lit("zero_filled_year").alias("check_id"), "data_year", F.col("source").alias("entity_id"))
        .unionByName(linked.groupBy(*keys).agg(F.count_distinct("total").alias("n")).where("n > 1").select(F.lit("duplicate_record").alias("check_id"), "data_year", "entity_id"))
        .unionByName(unique.where("n > 1").select(F.lit("ambiguous_key").alias("check_id"), F.lit(None).cast("int").alias("data_year"), F.col("key").alias("entity_id")))
    )
    return facts, log


def pick_source(df: DataFrame, keys: Sequence[str], source: str, precedence: Sequence[str]) -> DataFrame:
    """One source a key, by precedence, so that later joins don't fan out."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, precedence)), F.col(source)), F.lit(len(precedence) + 1))
    return _ranked(df.withColumn("_p", F.when(rank == 0, len(precedence) + 1).otherwise(rank)), keys, [F.asc("_p"), F.asc(source)]).drop("_p")


def append_basis(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of two bases of one measure; a column that one lacks (the margin of an estimate) is null there."""
    return first.unionByName(second, allowMissingColumns=True)


def unpivot_years(df: DataFrame, ids: Sequence[str], prefix: str, value: str = "population") -> DataFrame:
    """Wide year columns (prefix and year) to rows; missing values have no row."""
    wide = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(list(ids), wide, "_name", value)
    return long.where(F.col(value).isNotNull()).withColumn("data_year", F.substring("_name", len(prefix) + 1, 4).cast("int")).drop("_name")


def apportioned_balance(places: DataFrame, counties: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per county and year: its population less that of its incorporated places, each split evenly over its counties.

    places and counties: geo, data_year, population; bridge: place, county, class_code (C* is incorporated).
    """
    spans = bridge.where(F.col("class_code").startswith("C")).select("place", "county").distinct()
    shares = spans.join(spans.groupBy("place").agg(F.count("*").alias("n")), "place")
    inside = shares.join(places, shares["place"] == places["geo"]).groupBy("county", "data_year").agg(F.sum(F.col("population") / F.col("n")).alias("inside"))
    joined = counties.join(inside, (counties["geo"] == inside["county"]) & (counties["data_year"] == inside["data_year"]), "left")
    rest = F.greatest(counties["population"] - F.coalesce("inside", F.lit(0.0)), F.lit(0.0))
    return joined.select(F.concat(counties["geo"], F.lit("#balance")).alias("geo"), counties["data_year"], F.bround(rest, 0).cast("long").alias("population"))


# Meaning of the flag on a reported amount.
AMOUNT_FLAGS = {"R": "reported", "I": "imputed", "S": "alternative_source", "A": "analyst_correction"}


def finance(amounts: DataFrame, units: DataFrame, flags: dict[str, str] = AMOUNT_FLAGS) -> DataFrame:
    """Amounts with their unit of the same file year; flag meaning, census years; the last row of a (unit, year, item) wins."""
    meaning = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in flags.items() for x in kv]), F.col("flag")), F.lit("unknown"))
    out = amounts.join(units, ["gov_id", "file_year"], "left").withColumns({"value_type": meaning, "is_cog_year": F.col("data_year") % 5 == 2, "attribution_level": F.lit("government")})
    return latest_wins(out, ["gov_id", "data_year", "item"], "file_year", "amount", "flag")


def monthly_to_annual(df: DataFrame, keys: Sequence[str], period: str, value: str, need: int = 12, cutoff: int | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """Monthly values (period MM-YYYY) to years: sum, months really there, and reported or partial_year.

    Null months don't count, periods of another form are skipped, a year
    without a month has no row, years behind the cutoff are dropped.  `also`:
    further aggregates of the year, by name.
    """
    year = F.when(F.col(period).rlike("^[0-9]{2}-[0-9]{4}$"), F.substring(period, 4, 4).cast("int"))
    out = df.where(F.col(value).isNotNull()).withColumn("data_year", year).where("data_year is not null")
    out = out.where(F.col("data_year") <= cutoff) if cutoff is not None else out
    out = out.groupBy(*keys, "data_year").agg(F.bround(F.sum(value), 0).cast("long").alias("total"), F.count_distinct(period).cast("int").alias("months_reported"), *(c.alias(name) for name, c in (also or {}).items()))
    return out.withColumn("value_type", F.when(F.col("months_reported") >= need, "reported").otherwise("partial_year"))


def monthly_json(df: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """Rows (keys, series, period, value) of raw bodies {"offenses": {"actuals": {series: {"MM-YYYY": n}}}}; null bodies have none."""
    parsed = F.from_json(F.col(body), "struct<offenses:struct<actuals:map<string,map<string,double>>>>")
    series = df.where(F.col(body).isNotNull()).select(*keys, F.explode(parsed["offenses"]["actuals"]).alias("series", "months"))
    return series.select(*keys, "series", F.explode("months").alias("period", "value"))


def pick_series(df: DataFrame, keys: Sequence[str], ending: str) -> DataFrame:
    """The series that ends so; of several the smallest name (the order of a map is not kept)."""
    some = df.where(F.col("series").endswith(ending))
    return some.join(some.groupBy(*keys).agg(F.min("series").alias("series")), [*keys, "series"], "left_semi")
