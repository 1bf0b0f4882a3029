"""Tables of a feed as files hold them (texts) turned into typed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.durable import numbered

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def filled(c: str) -> Column:
    """The text, or null if it is blank."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def date_of(c: str) -> Column:
    """YYYYMMDD as a date; null if blank or no date (see ``validate.bad_dates``)."""
    return F.when(F.col(c).rlike(r"^\d{8}$"), F.try_to_date(F.col(c), "yyyyMMdd"))


def calendars(raw: DataFrame) -> DataFrame:
    """service_id, days (bits, Monday first; a day runs only if its text is exactly 1), start_date, end_date (null: open)."""
    days = sum((F.when(F.col(d) == "1", 1 << k).otherwise(0) for k, d in enumerate(DAYS)), F.lit(0))
    return raw.select("service_id", days.alias("days"), date_of("start_date").alias("start_date"), date_of("end_date").alias("end_date"))


def routes(raw: DataFrame) -> DataFrame:
    """route_id, short_name, long_name, route_type, code, public_code, mode; rows without an id are skipped, blanks are null."""
    kept = raw.where(filled("route_id").isNotNull()).select("route_id", filled("route_short_name").alias("short_name"), filled("route_long_name").alias("long_name"),
                                                            filled("route_type").try_cast("int").alias("route_type"), filled("route_code").alias("route_code"))
    tram = (F.col("route_type") == 0) | F.col("route_type").between(900, 906)
    public = F.trim(F.coalesce("short_name", "route_code", "route_id"))
    return kept.select("route_id", "short_name", "long_name", "route_type", F.coalesce("route_code", "short_name").alias("code"), public.alias("public_code"), F.when(tram, "tram").otherwise("bus").alias("mode"))


def public_transport(found: DataFrame) -> DataFrame:
    """The routes by bus or tram, or of no stated type."""
    kind = F.col("route_type")
    return found.where(kind.isNull() | kind.isin(0, 3) | kind.between(700, 716) | kind.between(900, 906))


def stops(raw: DataFrame) -> DataFrame:
    """id (dense, by stop_id as text), stop_id, name, lat, lon (null if they can't be read)."""
    number = lambda c: F.col(c).try_cast("double").alias(c.removeprefix("stop_"))
    return numbered(raw.select("stop_id", F.col("stop_name").alias("name"), number("stop_lat"), number("stop_lon")), "id", "stop_id")


def clock_of(text: Column) -> Column:
    """H:M:S as HH:MM:SS; null unless all three are digits, the hours at most 99 and the others below 60."""
    part = lambda k: F.get(F.split(text, ":"), F.lit(k)).try_cast("int")
    good = text.rlike(r"^\d+:\d+:\d+$") & (part(0) <= 99) & (part(1) < 60) & (part(2) < 60)
    return F.when(good, F.concat_ws(":", *(F.lpad(part(k).cast("string"), 2, "0") for k in range(3))))


def first_departures(raw: DataFrame) -> DataFrame:
    """trip_id, departure: the clock at the lowest stop_sequence, the first row of equal ones; null if blank or invalid. raw:
    trip_id, stop_sequence, ordinal, departure_time."""
    first = F.min_by(F.coalesce("departure_time", F.lit("")), F.struct(F.col("stop_sequence").try_cast("int"), "ordinal"))
    return raw.groupBy("trip_id").agg(first.alias("text")).select("trip_id", clock_of(F.trim("text")).alias("departure"))


def services_on(dates: DataFrame, found: DataFrame) -> DataFrame:
    """day, service_id of the services of ``found`` (see ``calendars``) that run on each distinct ``day`` of ``dates``: the
    weekday is in the set and the date between start and end. Services meet dates by weekday."""
    asked = dates.select("day").distinct().withColumn("weekday", F.weekday("day"))
    each = found.withColumn("weekday", F.explode(F.expr("filter(sequence(0, 6), d -> (days & shiftleft(1, d)) <> 0)")))
    met = asked.join(each, "weekday").where("(start_date is null or day >= start_date) and (end_date is null or day <= end_date)")
    return met.select("day", "service_id")


def pattern_tables(trips: DataFrame, calendars: DataFrame, stop_times: DataFrame, ordinal: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``patterns.patterns`` from tables of texts, as ``feed_files.read_table`` gives them. Flags: 1 or 0. ordinal:
    columns of stop_times, and their types, that set rows of one stop_sequence apart. A text that is no number is an error."""
    long = lambda c: F.col(c).cast("long").alias(c)
    runs = trips.select(long("trip_id"), F.col("route_id").cast("int").alias("route_id"), "service_id", F.nullif(F.col("direction"), F.lit("")).alias("direction"), (F.col("flagged") == "1").alias("flagged"))
    order = F.struct(*(F.col(c).cast(kind).alias(c) for c, kind in ordinal.items())).alias("ordinal")
    calls = stop_times.select(long("trip_id"), long("stop_id"), long("stop_sequence"), order, *((F.col(c) == "1").alias(c) for c in ("pickup", "dropoff")))
    return runs, calendars.select("service_id", F.col("days").cast("int").alias("days")), calls
