"""Rules of a feed: what breaks them, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blank_values(table: DataFrame, name: str, column: str, key: str) -> DataFrame:
    """Rows whose required value is blank or missing."""
    return table.where(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "").select(*violation("required", name, key, column))


def repeated_keys(table: DataFrame, name: str, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(*violation("unique", name, key, key))


def dangling(table: DataFrame, name: str, column: str, target: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` that ``target`` doesn't have, each once."""
    known = target.select(F.col(key).alias(column))
    return table.select(column).distinct().join(known, column, "left_anti").select(*violation("foreign", name, column, column))


def bad_coordinates(table: DataFrame, name: str, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coordinates out of range (NaN counts as such); unparsable ones are null and pass."""
    out = (F.abs(F.col(lat).try_cast("double")) > 90) | (F.abs(F.col(lon).try_cast("double")) > 180)
    return table.where(out).select(*violation("coordinate", name, key, lat))


def bad_integers(table: DataFrame, name: str, column: str, key: str) -> DataFrame:
    text = F.col(column).cast("string")
    return table.where(text.try_cast("int").isNull() & (F.coalesce(text, F.lit("")) != "")).select(*violation("integer", name, key, column))


def bad_dates(table: DataFrame, name: str, column: str, key: str) -> DataFrame:
    text = F.col(column).cast("string")
    parsed = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return table.where(parsed.isNull() & (F.coalesce(text, F.lit("")) != "")).select(*violation("date", name, key, column))


def violation(rule: str, table: str, key: str, detail: str) -> list:
    return [F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key"), F.lit(detail).alias("detail")]


def assert_valid(violations: DataFrame) -> None:
    """An error that names the first violation, if there is any."""
    for row in violations.limit(1).collect():
        raise ValueError(f"{row['rule']}: {row['table_name']}.{row['detail']}, {row['key']}")


def usable(patterns: DataFrame, calls: DataFrame, stops: DataFrame) -> DataFrame:
    """One row: has_patterns, has_named_stops (a stop in use with a name). A feed is of use only with both."""
    some = patterns.agg((F.count("*") > 0).alias("has_patterns"))
    named = stops.join(calls.select("stop_id").distinct(), "stop_id", "left_semi").where(F.trim("name") != "")
    return some.crossJoin(named.agg((F.count("*") > 0).alias("has_named_stops")))
