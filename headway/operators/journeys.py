"""Journeys with walks at both ends, with two changes, and what is reported of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.operators.rides import DWELL, TICKS, WAIT, WALK, alightings, backward_reach, boardings, forward_reach, ride_ticks

#: Costs are counted in twentieths of a tick, in which the discount of trams is whole too.
UNITS = 20 * TICKS
#: Fixed values, in units: a metre by bus, by tram, on foot, the bonus for a first tram, a change.
MODES = {
    "fastest": (120, 100, 500, 0, 0),
    "fewest_transfers": (120, 100, 500, 0, 400_000_000),
    "minimal_walking": (120, 100, 2500, 0, 80_000),
    "prefer_tram": (120, 55, 500, 320_000, 80_000),
}
#: In this mode fewer changes come before less cost.
FEWEST = "fewest_transfers"


def walked(pairs: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """``pairs`` with ``<end>_stop`` and ``<end>_walk``: the stop itself, and those one walk away."""
    steps = edges.select(F.col("stop_id").alias(end), F.col("to_stop").alias(f"{end}_stop"), F.col("metres").alias(f"{end}_walk"))
    here = pairs.select("*", F.col(end).alias(f"{end}_stop"), F.lit(0).cast("long").alias(f"{end}_walk"))
    return here.unionByName(pairs.join(steps, end))


def ranked_journeys(requests: DataFrame, calls: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """request_id, mode, rank, route_id, pattern_id, board, alight, walk, cost: for each mode of search the ``k`` lines of
    least cost, each with its best ride; a walk may lead to the ride and from it.

    Requests share few pairs of ends, so each pair is searched once. Ties go to the shorter walk, then to the lower ids."""
    pairs = requests.select("origin", "destination").where("origin <> destination").distinct()
    on = boardings(calls, route_id="route_id", tram="tram", stop_id="origin_stop", position="board", metres="a")
    off = alightings(calls, stop_id="destination_stop", position="alight", metres="b")
    ends = walked(walked(pairs, edges, "origin"), edges, "destination")
    rides = ends.join(on, "origin_stop").join(off, ["pattern_id", "destination_stop"]).where("board < alight")
    rides = rides.withColumn("metres", F.greatest(F.col("b") - F.col("a"), F.lit(0))).withColumn("walk", F.col("origin_walk") + F.col("destination_walk"))

    def cost(bus: int, tram: int, walk: int, bonus: int, change: int) -> Column:
        fixed = F.lit(20 * WAIT) + 20 * DWELL * (F.col("alight") - F.col("board"))
        return (fixed + F.col("metres") * F.when(F.col("tram"), tram).otherwise(bus) + F.col("walk") * walk - F.when(F.col("tram"), bonus).otherwise(0)).cast("long")

    modes = F.array(*(F.struct(F.lit(name).alias("mode"), cost(*v).alias("units")) for name, v in MODES.items()))
    costed = rides.select("origin", "destination", "route_id", "pattern_id", "board", "alight", "walk", F.inline(modes))
    order = ["units", "walk", "pattern_id", "board", "alight"]
    best = costed.groupBy("origin", "destination", "mode", "route_id").agg(F.min(F.struct(*order)).alias("best")).select("origin", "destination", "mode", "route_id", "best.*")
    rank = F.row_number().over(Window.partitionBy("origin", "destination", "mode").orderBy(*order))
    found = best.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("cost", F.col("units") / UNITS)
    return requests.join(found, ["origin", "destination"]).select("request_id", "mode", "rank", "route_id", "pattern_id", "board", "alight", "walk", "cost")


def two_transfers(requests: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """request_id, middle_pattern, minutes: the fastest journeys of three rides, by the ride in the middle, which differs
    from both others (these may be of one pattern); all three share a day. Between rides lies a stop or one walk.

    Each pair of ends is searched once. At a stop only the two best patterns of each set of days can matter on each side, for
    the middle ride rules out one at most; so hubs don't multiply."""
    pairs = requests.select("origin", "destination").distinct().withColumn("request_id", F.struct("origin", "destination"))
    ticks = ride_ticks("ride_metres", "board", "alight", "tram")
    here = calls.select("stop_id").distinct().select("stop_id", F.col("stop_id").alias("to_stop"), F.lit(0).cast("long").alias("walk"))
    steps = here.union(edges.select("stop_id", "to_stop", F.col("metres").alias("walk")))

    def best_two(reach: DataFrame, stop: str, other: str) -> DataFrame:
        rides = reach.groupBy("request_id", "pattern_id", "days", "stop_id").agg(F.min(ticks).alias("ticks")).withColumnRenamed("stop_id", stop)
        met = rides.join(steps, stop).groupBy("request_id", "pattern_id", "days", other).agg(F.min(F.col("ticks") + F.col("walk") * WALK).alias("ticks"))
        place = F.row_number().over(Window.partitionBy("request_id", other, "days").orderBy("ticks", "pattern_id"))
        return met.withColumn("place", place).where("place <= 2").drop("place").withColumnRenamed(other, "at")

    ahead = best_two(forward_reach(pairs, calls), "stop_id", "to_stop").withColumnsRenamed({"pattern_id": "first", "ticks": "m1", "at": "into", "days": "d1"})
    back = best_two(backward_reach(pairs, calls), "to_stop", "stop_id").withColumnsRenamed({"pattern_id": "last", "ticks": "m3", "at": "out", "days": "d3"})
    into = boardings(calls, tram="tram", days="days", stop_id="into", position="board", metres="a").withColumnRenamed("pattern_id", "middle_pattern")
    out = alightings(calls, stop_id="out", position="alight", metres="b").withColumnRenamed("pattern_id", "middle_pattern")
    middle = ahead.join(into, "into").where("first <> middle_pattern").withColumn("d2", F.col("d1").bitwiseAND(F.col("days"))).where("d2 <> 0")
    middle = middle.groupBy("request_id", "middle_pattern", "tram", "board", "a", "d2").agg(F.min("m1").alias("m1"))
    rides = middle.join(out, "middle_pattern").where("alight > board").withColumn("ride_metres", F.col("b") - F.col("a"))
    rides = rides.groupBy("request_id", "middle_pattern", "out", "d2").agg(F.min(F.col("m1") + ticks).alias("m2"))
    met = rides.join(back, ["request_id", "out"]).where("last <> middle_pattern and (d2 & d3) <> 0")
    best = met.groupBy("request_id", "middle_pattern").agg((F.min(F.col("m2") + F.col("m3")) / TICKS).alias("minutes")).select("request_id.*", "middle_pattern", "minutes")
    return requests.join(best, ["origin", "destination"]).select("request_id", "middle_pattern", "minutes")


def interchangeable_lines(legs: DataFrame, calls: DataFrame, days: DataFrame) -> DataFrame:
    """pattern_id, board, alight, lines (text): for each distinct ride of ``legs`` the lines that make the same ride, with
    the same stops and mode, where one may board and alight, on all days of its own pattern; its own line first, then by number. days: pattern_id, days."""
    stops = calls.groupBy("pattern_id", "route_id", "tram").agg(F.array_sort(F.collect_list(F.struct("position", "stop_id", "dropoff"))).alias("at"))
    paths = stops.join(days, "pattern_id").select("pattern_id", "route_id", "tram", "days", F.col("at.stop_id").alias("stops"), F.col("at.dropoff").alias("offs"))
    own = legs.select("pattern_id", "board", "alight").distinct().join(paths, "pattern_id")
    own = own.withColumn("path", F.expr("slice(stops, board + 1, alight - board + 1)")).drop("stops", "offs")
    on = calls.where("pickup").select(F.col("pattern_id").alias("other"), "tram", F.col("stop_id").alias("from_stop"), F.col("position").alias("other_board"))
    met = own.withColumn("from_stop", F.get("path", F.lit(0))).join(on, ["from_stop", "tram"])
    others = paths.select(F.col("pattern_id").alias("other"), F.col("route_id").alias("line"), F.col("stops").alias("other_stops"), F.col("offs").alias("other_offs"), F.col("days").alias("other_days"))
    same = met.join(others, "other").where("slice(other_stops, other_board + 1, size(path)) = path and get(other_offs, other_board + size(path) - 1)")
    codes = same.groupBy("pattern_id", "board", "alight", "route_id", "days", "line").agg(F.bit_or("other_days").alias("all_days")).where("(all_days & days) = days")
    order = F.array_sort(F.collect_list(F.struct((F.col("line") != F.col("route_id")).alias("other"), "line")))
    return codes.groupBy("pattern_id", "board", "alight").agg(F.array_join(F.transform(order, lambda x: x.line.cast("string")), ",").alias("lines"))


def journey_counts(direct: DataFrame, changed: DataFrame, twice: DataFrame) -> DataFrame:
    """request_id, transfers, n: answers by number of changes."""
    kinds = [direct.select("request_id", F.lit(0).alias("transfers")), changed.select("request_id", F.lit(1).alias("transfers")), twice.select("request_id", F.lit(2).alias("transfers"))]
    return kinds[0].union(kinds[1]).union(kinds[2]).groupBy("request_id", "transfers").agg(F.count("*").alias("n"))
