"""Where one may board and alight, by rules that a landmark stop anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.geo import haversine

#: An anchor may be this many metres from the landmark.
NEAR = 800


def anchors(rules: DataFrame, calls: DataFrame, stops: DataFrame, near: int = NEAR) -> DataFrame:
    """rule_id, pattern_id, side, span, anchor (position): of each pattern of a rule's route and direction the first
    position at the landmark, else the nearest one within ``near`` metres, ties to the lower position; a pattern without
    such a position has no row. rules: rule_id, route_id, direction, landmark, side, span; calls: pattern_id, route_id,
    direction, position, stop_id."""
    place = stops.select(F.col("stop_id").alias("landmark"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    aimed = rules.join(place, "landmark", "left")
    met = calls.join(F.broadcast(aimed) if rules_are_few(rules) else aimed, ["route_id", "direction"]).join(stops.select("stop_id", "lat", "lon"), "stop_id", "left")
    metres = F.bround(haversine(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))).cast("long")
    other = F.col("stop_id") != F.col("landmark")
    ranked = met.withColumn("metres", F.when(other, metres).otherwise(F.lit(0))).where(~other | (F.col("metres") <= near))
    best = ranked.groupBy("rule_id", "pattern_id", "side", "span").agg(F.min(F.struct(other.alias("other"), "metres", "position")).alias("best"))
    return best.select("rule_id", "pattern_id", "side", "span", F.col("best.position").alias("anchor"))


def rules_are_few(rules: DataFrame, limit: int = 100_000) -> bool:
    """Whether the rules may be broadcast."""
    return rules.limit(limit + 1).count() <= limit


def permissions(calls: DataFrame, found: DataFrame) -> DataFrame:
    """pattern_id, position, stop_id, pickup, dropoff: the flags of ``calls`` less what a rule takes away from its side
    (board, alight): all positions before the anchor, through it, from it on, or after it. A null flag allows."""
    span, gap = F.col("span"), F.col("position") - F.col("anchor")
    taken = ((span == "before") & (gap < 0)) | ((span == "through") & (gap <= 0)) | ((span == "from") & (gap >= 0)) | ((span == "after") & (gap > 0))
    hit = calls.select("pattern_id", "position").join(found, "pattern_id").where(taken)
    lost = hit.groupBy("pattern_id", "position").agg(F.bool_or(F.col("side") == "board").alias("b"), F.bool_or(F.col("side") == "alight").alias("a"))
    left = lambda flag, gone: (F.coalesce(F.col(flag), F.lit(True)) & ~F.coalesce(F.col(gone), F.lit(False))).alias(flag)
    return calls.join(lost, ["pattern_id", "position"], "left").select("pattern_id", "position", "stop_id", left("pickup", "b"), left("dropoff", "a"))
