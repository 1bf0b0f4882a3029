"""Where scheduled vehicles are, and which reach a stop next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.clock import is_rush_hour, speed_kmh
from headway.operators.timetable import DAY, HOUR, line_kinds

#: No vehicle is slower, in km/h: bounds how long a trip can last.
SLOWEST = 16


def moving(asked: DataFrame, calls: DataFrame, departures: DataFrame) -> DataFrame:
    """request_id, pattern_id, back (days), departure, along (whole metres), position, permille (of the way to the next stop),
    speed: vehicles on the way on the pattern at the instant of each row of ``asked`` (request_id, instant, pattern_id).

    Departures meet a request in bins of an hour, over the time the pattern's longest trip can take."""
    shape = calls.groupBy("pattern_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "metres"))), lambda x: x.metres).alias("marks")).where("size(marks) >= 2")
    lines = shape.join(line_kinds(calls), "pattern_id").withColumn("last", F.element_at("marks", -1))
    now = F.hour("instant") * HOUR + F.minute("instant") * 60 + F.floor(F.second("instant"))
    asked = asked.select("request_id", "pattern_id", now.cast("long").alias("now"), F.weekday("instant").alias("weekday"))
    asked = asked.join(lines, "pattern_id").withColumn("back", F.explode(F.array(F.lit(0), F.lit(1))))
    asked = asked.withColumn("high", F.col("now") + DAY * F.col("back"))
    low = F.greatest(F.col("high") - F.ceil(F.col("last") * 36 / (SLOWEST * 10)) - 1, F.lit(0))
    asked = asked.withColumn("bin", F.explode(F.sequence(F.floor(low / HOUR), F.floor(F.col("high") / HOUR))))
    met = asked.join(departures.withColumn("bin", F.floor(F.col("departure") / HOUR)), ["pattern_id", "bin"]).where("departure <= high")
    day = (F.col("weekday") - F.col("back") + 7) % 7
    met = met.where((F.col("days").bitwiseAND(F.expr("shiftleft(1, cast((weekday - back + 7) % 7 as int))"))) != 0)
    rush = is_rush_hour((day + F.floor(F.col("departure") / DAY)) % 7, F.col("departure") % DAY)
    met = met.withColumn("speed", speed_kmh(F.col("kind"), rush))
    along = F.floor((F.col("high") - F.col("departure")) * F.col("speed") * 10 / 36).cast("long")
    on = met.withColumn("along", along).where("along <= last").dropDuplicates(["request_id", "pattern_id", "back", "departure"])
    position = F.least(F.size(F.filter("marks", lambda m: m <= F.col("along"))) - 1, F.size("marks") - 2)
    on = on.withColumn("position", position).withColumn("a", F.get("marks", "position")).withColumn("b", F.expr("marks[position + 1]"))
    share = F.when(F.col("b") > F.col("a"), F.floor((F.col("along") - F.col("a")) * 1000 / (F.col("b") - F.col("a")))).otherwise(0).cast("long")
    return on.select("request_id", "pattern_id", "back", "departure", "along", "position", share.alias("permille"), "speed")


def active_vehicles(requests: DataFrame, calls: DataFrame, departures: DataFrame) -> DataFrame:
    """request_id, pattern_id, back, departure, along, position, permille (see ``moving``): vehicles on the way on the patterns
    that call at the stop of a request."""
    asked = requests.select("request_id", "instant", "stop_id").join(calls.select("pattern_id", "stop_id").distinct(), "stop_id")
    return moving(asked, calls, departures).drop("speed")


def vehicles_for_rides(rides: DataFrame, calls: DataFrame, departures: DataFrame, within: int = 30) -> DataFrame:
    """request_id, pattern_id, back, departure, along, minutes_to_board (half-even; null if it has passed), passed_board: for each
    ride (request_id, instant, pattern_id, board, alight) the vehicles that are not past its end and reach its start within
    ``within`` minutes, or have passed it. A request that names a pattern twice gets each vehicle once, for its last ride."""
    found = moving(rides.select("request_id", "instant", "pattern_id").distinct(), calls, departures)
    mark = lambda p, m: calls.select("pattern_id", F.col("position").alias(p), F.col("metres").alias(m))
    spans = rides.select("request_id", "pattern_id", "board", "alight").distinct().join(mark("board", "a"), ["pattern_id", "board"]).join(mark("alight", "b"), ["pattern_id", "alight"])
    met = found.join(spans, ["request_id", "pattern_id"]).where("along <= b")
    minutes = (F.col("a") - F.col("along")) * 36 / (F.col("speed") * 10) / 60
    met = met.withColumn("passed_board", F.col("along") >= F.col("a")).where(F.col("passed_board") | (minutes <= within))
    told = F.struct(F.when(~F.col("passed_board"), F.bround(minutes).cast("long")).alias("minutes_to_board"), "passed_board")
    best = met.groupBy("request_id", "pattern_id", "back", "departure", "along").agg(F.max_by(told, F.struct("board", "alight")).alias("x"))
    return best.select("request_id", "pattern_id", "back", "departure", "along", "x.*")


def next_vehicles(arrivals: DataFrame, k: int = 3) -> DataFrame:
    """request_id, rank, route_id, minutes (rounded up): the next ``k`` distinct (minute, line) at the stop of a request."""
    found = arrivals.select("request_id", "route_id", F.ceil(F.col("wait") / 60).cast("long").alias("minutes")).distinct()
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("minutes", "route_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def markers(arrivals: DataFrame) -> DataFrame:
    """request_id, pattern_id, back, departure, wait: the soonest arrival of each vehicle."""
    return arrivals.groupBy("request_id", "pattern_id", "back", "departure").agg(F.min("wait").alias("wait"))
