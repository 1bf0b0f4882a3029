"""What is reported of journeys: legs with times, totals, signatures, and what would make a journey invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.operators.rides import TICKS, WAIT

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MOST_RIDES, MOST_LEGS = 4, 9


def day_names(days: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(days.bitwiseAND(1 << k) != 0, n) for k, n in enumerate(DAY_NAMES)))), ", ")


def timed_legs(legs: DataFrame, *keys: str) -> DataFrame:
    """``legs`` with reach_ticks: ticks from the start until one stands where the leg begins."""
    order = Window.partitionBy(*keys).orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("ticks") + F.when(F.col("walking"), 0).otherwise(WAIT)
    return legs.withColumn("reach_ticks", F.coalesce(F.sum(spent).over(order), F.lit(0)).cast("long"))


def summaries(journeys: DataFrame, legs: DataFrame, *keys: str) -> DataFrame:
    """keys, n_legs, transfers, is_direct, metres, walk_metres, has_tram, hops, minutes (rounded up), score_transfers,
    score_effort (hops and walking minutes), combination (lines in order), day_names. journeys: keys, days."""
    rides = F.count_if(~F.col("walking"))
    each = legs.groupBy(*keys).agg(
        F.count("*").alias("n_legs"), F.greatest(rides - 1, F.lit(0)).alias("transfers"), (rides == 1).alias("is_direct"), F.sum("metres").alias("metres"),
        F.sum(F.when(F.col("walking"), F.col("metres")).otherwise(0)).alias("walk_metres"), F.bool_or("tram").alias("has_tram"), F.sum("hops").cast("long").alias("hops"),
        F.ceil((F.sum("ticks") + WAIT * rides) / TICKS).cast("long").alias("minutes"), (rides - 1).alias("score_transfers"),
        (F.sum("hops") + F.sum(F.when(F.col("walking"), F.col("metres")).otherwise(0)) / 80).alias("score_effort"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("walking"), F.struct("leg", "route_id")))), lambda x: F.upper(x.route_id.cast("string"))), ">").alias("combination"),
    )
    return journeys.select(*keys, day_names(F.col("days")).alias("day_names")).join(each, list(keys))


def broken(journeys: DataFrame, legs: DataFrame, *keys: str) -> DataFrame:
    """rule, and the keys of journeys that break it: too many rides or legs, legs that don't meet, no common day, a ride that
    ends no later than it starts."""
    order = Window.partitionBy(*keys).orderBy("leg")
    counts = legs.groupBy(*keys).agg(F.count_if(~F.col("walking")).alias("rides"), F.count("*").alias("n"))
    rule = lambda name, rows: rows.select(F.lit(name).alias("rule"), *keys).distinct()
    found = rule("rides", counts.where(F.col("rides") > MOST_RIDES)).union(rule("legs", counts.where(F.col("n") > MOST_LEGS)))
    found = found.union(rule("meet", legs.withColumn("at", F.lag("alight_stop").over(order)).where("at <> board_stop"))).union(rule("days", journeys.where("days = 0")))
    return found.union(rule("order", legs.where("not walking and board >= alight")))


def signatures(legs: DataFrame, calls: DataFrame, *keys: str) -> DataFrame:
    """keys, signature: the mode and stops of every ride, the ends and metres of every walk, in order. Journeys of parallel
    lines have one signature."""
    stops = calls.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("position", "stop_id"))).alias("stops"))
    path = F.array_join(F.transform(F.expr("slice(stops, board + 1, alight - board + 1)"), lambda x: x.stop_id.cast("string")), "-")
    ride = F.concat(F.when(F.col("tram"), "tram ").otherwise("bus "), path)
    walk = F.concat_ws(" ", F.lit("walk"), F.concat_ws("-", "board_stop", "alight_stop"), "metres")
    told = legs.join(stops, "pattern_id", "left").withColumn("part", F.when(F.col("walking"), walk).otherwise(ride))
    return told.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leg", "part"))), lambda x: x.part), " / ").alias("signature"))


def records(journeys: DataFrame, legs: DataFrame, stops: DataFrame, *keys: str) -> DataFrame:
    """One nested row for each journey, ready for JSON or Parquet: its columns, and its legs in order with the names of their
    ends. An unknown stop is an error."""
    name = lambda end: stops.select(F.col("stop_id").alias(end), F.col("name").alias(f"{end}_name"))
    named = legs.join(name("board_stop"), "board_stop", "left").join(name("alight_stop"), "alight_stop", "left")
    known = lambda end: F.coalesce(f"{end}_name", F.raise_error(F.concat(F.lit("unknown stop "), F.col(end).cast("string")))).alias(f"{end}_name")
    leg = F.struct("leg", "walking", "pattern_id", "route_id", "board", "alight", "board_stop", known("board_stop"), "alight_stop", known("alight_stop"), "metres", "reach_ticks")
    return journeys.join(named.groupBy(*keys).agg(F.array_sort(F.collect_list(leg)).alias("legs")), list(keys))


def vehicle_specs(legs: DataFrame) -> DataFrame:
    """pattern_id, board, alight: the distinct rides of journeys, whose vehicles are to be shown."""
    return legs.where("not walking").select("pattern_id", "board", "alight").distinct()
