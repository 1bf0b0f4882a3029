"""Distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIAMETER = 12_742_000
#: A hop with a missing coordinate counts so many metres.
UNKNOWN_HOP = 400
WALK_LIMIT = 500
CELL = 0.005


def haversine(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Great-circle metres; null if a coordinate is."""
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    h = half(b_lat - a_lat) + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * half(b_lon - a_lon)
    return DIAMETER * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))  # least() would turn a null into 1


def chain_metres(pattern_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """``pattern_stops`` (pattern_id, position, stop_id) with ``metres``: whole metres along the stops so far."""
    located = pattern_stops.join(stops.select("stop_id", "lat", "lon"), "stop_id", "left")
    w = Window.partitionBy("pattern_id").orderBy("position")
    hop = F.bround(haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))).cast("long")
    hopped = located.withColumn("hop", F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.coalesce(hop, F.lit(UNKNOWN_HOP))).cast("long"))
    return hopped.withColumn("metres", F.sum("hop").over(w)).drop("hop", "lat", "lon")


def walking_edges(stops: DataFrame, limit: int = WALK_LIMIT) -> DataFrame:
    """(stop_id, to_stop, metres) for stops within ``limit`` metres, both ways. Stops meet in grid cells: one side keeps
    its cell, the other goes to the neighbouring ones (valid to about 63 degrees of latitude)."""
    cell = lambda c: F.floor(F.col(c) / CELL).cast("long")
    here = stops.where("lat is not null and lon is not null").select("stop_id", "lat", "lon", cell("lat").alias("x"), cell("lon").alias("y"))
    around = F.sequence(F.lit(-2), F.lit(2))
    there = here.select(F.col("stop_id").alias("to_stop"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: d + F.col("x"))).alias("x"), "y")
    there = there.withColumn("y", F.explode(F.transform(around, lambda d: d + F.col("y"))))
    metres = F.bround(haversine(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))).cast("long")
    near = here.join(there, ["x", "y"]).where("stop_id < to_stop").withColumn("metres", metres).where(F.col("metres") <= limit).select("stop_id", "to_stop", "metres")
    return near.union(near.select("to_stop", "stop_id", "metres"))
