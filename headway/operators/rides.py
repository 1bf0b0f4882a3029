"""Rides between stops of a network, and journeys with one change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Times are counted in ticks of 1/2000 minute, in which all speeds are whole: a metre by bus, by tram, on foot; a hop's
#: stand and the wait for a ride.
TICKS = 2000
BUS, TRAM, WALK, DWELL, WAIT = 6, 5, 25, 500, 10_000


def boardings(calls: DataFrame, **names: str) -> DataFrame:
    """The calls where one may board. calls: pattern_id, route_id, tram, days (bits), position, stop_id, metres, pickup, dropoff."""
    return calls.where("pickup").select("pattern_id", *(F.col(c).alias(n) for c, n in names.items()))


def alightings(calls: DataFrame, **names: str) -> DataFrame:
    """The calls where one may alight."""
    return calls.where("dropoff").select("pattern_id", *(F.col(c).alias(n) for c, n in names.items()))


def forward_reach(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """request_id, pattern_id, board, alight, stop_id, ride_metres, tram, days: all later stops to alight at of what one may
    board at the origin."""
    on = boardings(calls, tram="tram", days="days", stop_id="origin", position="board", metres="from_metres")
    met = requests.join(on, "origin").join(alightings(calls, stop_id="stop_id", position="alight", metres="metres"), "pattern_id").where("alight > board")
    return met.select("request_id", "pattern_id", "board", "alight", "stop_id", (F.col("metres") - F.col("from_metres")).alias("ride_metres"), "tram", "days")


def backward_reach(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """request_id, pattern_id, board, alight, stop_id, ride_metres, tram, days: all earlier stops to board at of what lets one
    alight at the destination."""
    off = alightings(calls, tram="tram", days="days", stop_id="destination", position="alight", metres="to_metres")
    met = requests.join(off, "destination").join(boardings(calls, stop_id="stop_id", position="board", metres="metres"), "pattern_id").where("board < alight")
    return met.select("request_id", "pattern_id", "board", "alight", "stop_id", (F.col("to_metres") - F.col("metres")).alias("ride_metres"), "tram", "days")


def ride_ticks(metres: str, board: str, alight: str, tram: str):
    return (F.greatest(F.col(metres), F.lit(0)) * F.when(F.col(tram), TRAM).otherwise(BUS) + DWELL * (F.col(alight) - F.col(board)) + WAIT).cast("long")


def direct_rides(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """All rides from origin to destination that one may board and alight, with minutes."""
    on = boardings(calls, route_id="route_id", tram="tram", stop_id="origin", position="board", metres="a")
    off = alightings(calls, stop_id="destination", position="alight", metres="b")
    met = requests.join(on, "origin").join(off, ["pattern_id", "destination"]).where("board < alight").withColumn("metres", F.col("b") - F.col("a"))
    return met.select("request_id", "pattern_id", "route_id", "board", "alight", "metres", (ride_ticks("metres", "board", "alight", "tram") / TICKS).alias("minutes"))


def best_distinct(journeys: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The best row of each (request_id, key), and of these the k best of each request, with rank."""
    one = F.row_number().over(Window.partitionBy("request_id", key).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return journeys.withColumn("one", one).where("one = 1").drop("one").withColumn("rank", rank).where(F.col("rank") <= k)


def one_transfer(requests: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """request_id, first_pattern, second_pattern, minutes: pairs of different patterns with a day in common that meet at a stop
    or over a walking edge, with their best minutes. Each side keeps its best ride to a stop first, so that hubs don't
    multiply."""
    best = F.min(ride_ticks("ride_metres", "board", "alight", "tram"))
    ahead = forward_reach(requests, calls).groupBy("request_id", "pattern_id", "stop_id", "days").agg(best.alias("m1")).withColumnsRenamed({"pattern_id": "first_pattern", "days": "d1"})
    back = backward_reach(requests, calls).groupBy("request_id", "pattern_id", "stop_id", "days").agg(best.alias("m2")).withColumnsRenamed({"pattern_id": "second_pattern", "stop_id": "to_stop"})
    here = calls.select("stop_id").distinct().select("stop_id", F.col("stop_id").alias("to_stop"), F.lit(0).cast("long").alias("walk"))
    steps = here.union(edges.select("stop_id", "to_stop", F.col("metres").alias("walk")))
    met = ahead.join(steps, "stop_id").join(back, ["request_id", "to_stop"]).where("first_pattern <> second_pattern and (d1 & days) <> 0")
    total = F.col("m1") + F.col("m2") + F.col("walk") * WALK
    return met.groupBy("request_id", "first_pattern", "second_pattern").agg((F.min(total) / TICKS).alias("minutes"))
