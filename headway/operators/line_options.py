"""The lines that one may take for a leg of a journey, and the next vehicles of any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.durable import durable
from headway.operators.rides import TICKS, alightings, boardings
from headway.operators.similar import RIDE, alike, ride_classes, ride_facts
from headway.operators.timetable import HOUR, arrivals

OTHER = {"pattern_id": "other", "board": "other_board", "alight": "other_alight"}
FIRST = ["first", "first_board", "first_alight"]


def ride_ends(rides: DataFrame, calls: DataFrame) -> DataFrame:
    """``rides`` (pattern_id, board, alight, ...) with tram and the stops a and b of their ends."""
    stop = lambda position, name, *more: calls.select("pattern_id", F.col("position").alias(position), F.col("stop_id").alias(name), *more)
    return rides.join(stop("board", "a", "tram"), ["pattern_id", "board"]).join(stop("alight", "b"), ["pattern_id", "alight"])


def line_options(legs: DataFrame, calls: DataFrame, codes: DataFrame, shapes: DataFrame, usable: DataFrame) -> DataFrame:
    """pattern_id, board, alight, days, place, code, line_days, other, other_board, other_alight: for each distinct ride and set of days
    of ``legs`` (pattern_id, board, alight, days) the rides of the lines that a traveller may take instead: the same mode and ends, where
    one may board and alight, by a way that is the same to a traveller (see ``similar.alike``). A line counts if its rides
    together run on all of the days. place: the leg's own line (by code) comes first, then by code. codes: route_id, code.

    Rides are compared as classes of equal stops and path; only classes with the mode and ends of a leg meet. A ride whose own
    ends don't allow it is no option. Legs without a ride (null) have none."""
    asked = legs.where("pattern_id is not null").select(*RIDE, "days").distinct()
    own = durable(ride_ends(asked.select(*RIDE).distinct(), calls))
    on, off = boardings(calls, tram="tram", stop_id="a", position="board"), alightings(calls, stop_id="b", position="alight")
    open_rides = durable(own.select("tram", "a", "b").distinct().join(on, ["tram", "a"]).join(off, ["pattern_id", "b"]).where("board < alight"))
    facts = durable(ride_facts(own.select(*RIDE).union(open_rides.select(*RIDE)), calls, shapes, usable))
    classes = durable(ride_classes(facts))
    classed = lambda rides: rides.join(classes, RIDE)
    mine, theirs = classed(own), classed(open_rides)
    sides = mine.select("tram", "a", "b", *FIRST).distinct().join(theirs.select("tram", "a", "b", *(F.col(c).alias(f"to_{c}") for c in FIRST)).distinct(), ["tram", "a", "b"])
    to = [f"to_{c}" for c in FIRST]
    pairs = durable(sides.select(*(F.col(c).alias(r) for c, r in zip(FIRST, RIDE, strict=True)), *(F.col(c).alias(o) for c, o in zip(to, OTHER.values(), strict=True))))
    same = F.struct(*RIDE) == F.struct(*OTHER.values())
    linked = pairs.where(same).union(alike(pairs.where(~same), facts))
    linked = linked.select(*(F.col(r).alias(c) for c, r in zip(FIRST, RIDE, strict=True)), *(F.col(o).alias(c) for c, o in zip(to, OTHER.values(), strict=True)))
    members = theirs.select(*(F.col(c).alias(f"to_{c}") for c in FIRST), *(F.col(r).alias(o) for r, o in OTHER.items()))
    found = asked.join(mine.select(*RIDE, *FIRST), RIDE).join(linked, FIRST).join(members, to)

    lines = calls.select("pattern_id", "route_id", F.col("days").alias("runs")).distinct().join(codes.select("route_id", "code"), "route_id").drop("route_id")
    found = found.join(lines.withColumnsRenamed({"pattern_id": "other"}), "other").join(lines.select("pattern_id", F.col("code").alias("own_code")), "pattern_id")
    leg = [*RIDE, "days"]
    counted = found.groupBy(*leg, "own_code", "code").agg(F.bit_or("runs").alias("line_days")).where("(line_days & days) = days")
    place = F.row_number().over(Window.partitionBy(*leg).orderBy(F.col("code") != F.col("own_code"), "code"))
    good = counted.withColumn("place", place).drop("own_code")
    return good.join(found.select(*leg, "code", *OTHER.values()), [*leg, "code"]).select(*leg, "place", "code", "line_days", *OTHER.values())


def upcoming(legs: DataFrame, options: DataFrame, calls: DataFrame, departures: DataFrame, *keys: str, k: int = 3, within: int = HOUR) -> DataFrame:
    """keys, leg, place, code, at (the minute, timestamp), minutes (rounded up, from the start of the journey): of each leg the next
    ``k`` distinct (minute, line) of any line of ``options`` (see ``line_options``) at the stop where the leg begins, in ``within``
    seconds from when the traveller stands there. legs: keys, leg, instant (start of the journey), reach_ticks (from it; rounded up to
    seconds), pattern_id, board, alight, days, board_stop. Walks have none."""
    seconds = F.ceil(F.col("reach_ticks") * 60 / TICKS).cast("long")
    reach = F.timestamp_micros(F.unix_micros(F.date_trunc("second", "instant")) + seconds * 1_000_000)
    stood = legs.where("pattern_id is not null").select(*keys, "leg", "instant", reach.alias("reach"), *RIDE, "days", F.col("board_stop").alias("stop_id"))
    met = stood.join(options.select(*RIDE, "days", "code", "other", "other_board").distinct(), [*RIDE, "days"])
    asked = met.select(F.struct(*keys, "leg", "instant", "reach", "code").alias("request_id"), F.col("reach").alias("instant"), "stop_id", F.col("other").alias("pattern_id"), F.col("other_board").alias("position"))
    found = arrivals(asked.distinct(), calls, departures, within).select("request_id.*", "wait")
    at = F.date_trunc("minute", F.timestamp_micros(F.unix_micros("reach") + F.col("wait") * 1_000_000))
    each = found.select(*keys, "leg", "instant", "code", at.alias("at")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys, "leg").orderBy("at", "code"))
    minutes = F.greatest(F.lit(0), F.ceil((F.unix_micros("at") - F.unix_micros(F.date_trunc("second", "instant"))) / 60_000_000)).cast("long")
    return each.withColumn("place", place).where(F.col("place") <= k).select(*keys, "leg", "place", "code", "at", minutes.alias("minutes"))
