"""Trips grouped into patterns, and the tables of stops that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.durable import numbered


def ordered_trip_stops(stop_times: DataFrame) -> DataFrame:
    """trip_id, calls: (stop_id, pickup, dropoff) by (stop_sequence, ordinal). One shuffle by trip."""
    call = F.struct("stop_sequence", "ordinal", "stop_id", "pickup", "dropoff")
    grouped = stop_times.groupBy("trip_id").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    return grouped.withColumn("calls", F.transform("calls", lambda c: F.struct(c.stop_id.alias("stop_id"), c.pickup.alias("pickup"), c.dropoff.alias("dropoff"))))


def trip_paths(stop_times: DataFrame) -> DataFrame:
    """trip_id, stops, pickups, dropoffs as texts, for narrow grouping keys."""
    bit = lambda b: F.when(b, "1").otherwise("0")
    return ordered_trip_stops(stop_times).select(
        "trip_id",
        F.array_join(F.transform("calls", lambda c: c.stop_id.cast("string")), "-").alias("stops"),
        F.array_join(F.transform("calls", lambda c: bit(c.pickup)), "").alias("pickups"),
        F.array_join(F.transform("calls", lambda c: bit(c.dropoff)), "").alias("dropoffs"),
    )


def patterns(trips: DataFrame, calendars: DataFrame, stop_times: DataFrame) -> DataFrame:
    """pattern_id, route_id, direction, days, stops, pickups, dropoffs, n_trips, n_services, n_plain (trips without a flag).

    Trips without stop times or days are dropped. Ids are dense, by route, direction (none first), shape (none first), stops (as
    numbers, in order), permissions and days (Monday first). trips: trip_id, route_id, service_id, direction, flagged
    (optional), shape_id and headsign (optional: with these, trips of different shapes are of different patterns, and
    ``headsigns`` tells a pattern's distinct ones, sorted; a null or empty one counts as none)."""
    return patterns_of(running_trips(trips, calendars, stop_times))


def running_trips(trips: DataFrame, calendars: DataFrame, stop_times: DataFrame) -> DataFrame:
    """``trips`` that have stop times and days, with flagged, days and their path (see ``trip_paths``)."""
    flagged = F.col("flagged") if "flagged" in trips.columns else F.lit(False)
    return trips.withColumn("flagged", flagged).join(calendars, "service_id").where("days > 0").join(trip_paths(stop_times), "trip_id")


def patterns_of(runs: DataFrame) -> DataFrame:
    """The ``patterns`` of trips that are joined with their days and paths (see ``running_trips``)."""
    shape = [c for c in ("shape_id",) if c in runs.columns]
    keys = ["route_id", "direction", *shape, "days", "stops", "pickups", "dropoffs"]
    told = [F.array_sort(F.collect_set(F.nullif("headsign", F.lit("")))).alias("headsigns")] if "headsign" in runs.columns else []
    grouped = runs.groupBy(*keys).agg(F.count("*").alias("n_trips"), F.countDistinct("service_id").alias("n_services"), F.count_if(~F.col("flagged")).alias("n_plain"), *told)
    path = F.transform(F.split("stops", "-"), lambda x: x.cast("long"))
    days = F.expr("filter(sequence(0, 6), d -> (days & shiftleft(1, d)) <> 0)")
    drawn = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shape]
    found = numbered(grouped, "pattern_id", "route_id", F.coalesce("direction", F.lit("")), *drawn, path, "pickups", "dropoffs", days)
    return found.select("pattern_id", *keys, "n_trips", "n_services", "n_plain", *(["headsigns"] if told else []))


def occurrences(found: DataFrame) -> DataFrame:
    """pattern_id, position, stop_id: every occurrence of a stop, also on loops."""
    split = F.posexplode(F.split("stops", "-"))
    return found.select("pattern_id", split.alias("position", "stop")).select("pattern_id", "position", F.col("stop").cast("long").alias("stop_id"))


def patterns_at_stops(stops: DataFrame, calls: DataFrame) -> DataFrame:
    """stop_id, n_patterns, for all stops."""
    counted = calls.groupBy("stop_id").agg(F.countDistinct("pattern_id").alias("n_patterns"))
    return stops.select("stop_id").join(counted, "stop_id", "left").select("stop_id", F.coalesce("n_patterns", F.lit(0)).alias("n_patterns"))


def positions(calls: DataFrame) -> DataFrame:
    """pattern_id, stop_id, positions (text): sorted positions of each stop of a pattern."""
    return calls.groupBy("pattern_id", "stop_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("position")), lambda p: p.cast("string")), ",").alias("positions"))
