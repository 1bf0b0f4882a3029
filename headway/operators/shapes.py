"""Paths of patterns on the map: distances along shapes, stops on shapes, points and pieces of paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from headway.functions.geo import haversine

#: Metres of a degree, segments searched first, metres off at which the rest is searched too and at which a
#: shape is of no use, and the least part of the distance between two stops that a shape may have between them.
DEGREE, AHEAD, FAR, LOST, SHORT = 111_195, 120, 150, 1_000, 0.8


def shape_metres(points: DataFrame) -> DataFrame:
    """``points`` (shape_id, sequence, lat, lon) with ``metres`` along the shape so far; points of one sequence number
    come by lat and lon. Points with a missing coordinate are left out."""
    order = Window.partitionBy("shape_id").orderBy("sequence", "lat", "lon")
    hop = haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    hopped = points.where("lat is not null and lon is not null").withColumn("hop", F.coalesce(hop, F.lit(0.0)))
    return hopped.withColumn("metres", F.round(F.sum("hop").over(order.rowsBetween(Window.unboundedPreceding, 0)), 3)).drop("hop")


def on_shape(lat: np.ndarray, lon: np.ndarray, chain: np.ndarray, x: np.ndarray, y: np.ndarray, metres: np.ndarray) -> np.ndarray | None:
    """Metres along the shape (x: lat, y: lon) of stops in travel order; None if the shape is of no use. Degrees are metres at
    the stop's own latitude; of equally near places the first counts, errors rounded to a thousandth of a millimetre."""
    if len(x) < 2 or np.isnan(lat).any() or np.isnan(lon).any():
        return None
    found, at = np.zeros(len(lat)), 0
    dx = np.diff(x) * DEGREE
    for k in range(len(lat)):
        across = DEGREE * np.cos(np.radians(lat[k]))
        dy = np.diff(y) * across
        px, py = (x[:-1] - lat[k]) * DEGREE, (y[:-1] - lon[k]) * across
        squared = np.maximum(dx * dx + dy * dy, 1e-12)
        best = None
        for low, high in ((at, at + AHEAD), (at + AHEAD, len(px))):
            part = slice(low, min(high, len(px)))
            if low >= len(px) or (best is not None and best[0] <= FAR**2):
                break
            t = np.clip(-(px[part] * dx[part] + py[part] * dy[part]) / squared[part], 0, 1)
            along = np.round(metres[:-1][part] + t * np.diff(metres)[part], 3)
            off = np.round((px[part] + t * dx[part]) ** 2 + (py[part] + t * dy[part]) ** 2, 6)
            first = np.lexsort((along, off))[0]
            if best is None or off[first] < best[0]:
                best = (off[first], along[first], low + int(first))
        if best is None or best[0] > LOST**2:
            return None
        found[k], at = best[1], best[2]
    return None if (np.diff(found) < SHORT * np.diff(chain)).any() else found


@F.pandas_udf(ArrayType(DoubleType()))
def metres_on_shape(lat: pd.Series, lon: pd.Series, chain: pd.Series, x: pd.Series, y: pd.Series, metres: pd.Series) -> pd.Series:
    as_array = lambda v: np.array(v, dtype=np.float64)
    out = []
    for row in zip(lat, lon, chain, x, y, metres, strict=True):
        found = None if row[3] is None else on_shape(*map(as_array, row))
        out.append(None if found is None else found.tolist())
    return pd.Series(out, dtype=object)


def stops_on_shapes(calls: DataFrame, stops: DataFrame, shapes: DataFrame, shape_of: DataFrame) -> DataFrame:
    """pattern_id, position, stop_id, metres (whole, along the shape if it can be used, else along the stops), usable.

    calls: pattern_id, position, stop_id, metres; shapes: as of ``shape_metres``; shape_of: pattern_id, shape_id. Each
    distinct pair of a shape and a list of stops is placed once."""
    located = calls.join(stops.select("stop_id", "lat", "lon"), "stop_id", "left")
    listed = F.array_sort(F.collect_list(F.struct("position", "stop_id", "metres", "lat", "lon")))
    paths = located.groupBy("pattern_id").agg(listed.alias("at")).join(shape_of, "pattern_id", "left")
    points = shapes.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "lat", "lon", "metres"))).alias("points"))
    keyed = paths.withColumn("key", F.sha2(F.to_json(F.struct("shape_id", F.col("at.stop_id"))), 256))
    once = keyed.where("shape_id is not null").dropDuplicates(["key"]).join(points, "shape_id")
    double = lambda c: F.transform(c, lambda v: v.cast("double"))
    placed = once.select("key", metres_on_shape("at.lat", "at.lon", double("at.metres"), "points.lat", "points.lon", "points.metres").alias("on"))
    each = keyed.join(placed, "key", "left").select("pattern_id", "on", F.posexplode("at").alias("k", "call"))
    metres = F.coalesce(F.round(F.get("on", F.col("k"))).cast("long"), F.col("call.metres"))
    return each.select("pattern_id", "call.position", "call.stop_id", metres.alias("metres"), F.col("on").isNotNull().alias("usable"))


def points_along(places: DataFrame, paths: DataFrame) -> DataFrame:
    """``places`` (path_id, along, ...) with the lat and lon of the point ``along`` metres on its path, held to the path's
    ends. paths: path_id, metres, lat, lon. Each distinct place is found once; one on a path without points has nulls."""
    order = Window.partitionBy("path_id").orderBy("metres", "lat", "lon")
    segments = paths.select(
        "path_id", "metres", "lat", "lon", F.lead("metres").over(order).alias("to_metres"), F.lead("lat").over(order).alias("to_lat"), F.lead("lon").over(order).alias("to_lon")
    )
    asked = places.select("path_id", "along").distinct()
    ends = paths.groupBy("path_id").agg(F.min("metres").alias("low"), F.max("metres").alias("high"))
    held = asked.join(ends, "path_id").withColumn("m", F.greatest("low", F.least("high", F.col("along").cast("double"))))
    met = held.join(segments, "path_id").where("metres <= m and (to_metres > m or m = high and metres = high)")
    part = F.coalesce((F.col("m") - F.col("metres")) / (F.col("to_metres") - F.col("metres")), F.lit(0.0))
    between = lambda a, b: F.round(F.coalesce(F.col(a) + (F.col(b) - F.col(a)) * part, F.col(a)), 7)
    point = F.struct(between("lat", "to_lat").alias("lat"), between("lon", "to_lon").alias("lon"))
    found = met.groupBy("path_id", "along").agg(F.min_by(point, F.struct("metres", "lat", "lon")).alias("p"))
    return places.join(found, ["path_id", "along"], "left").select(*places.columns, "p.lat", "p.lon")


def leg_geometry(legs: DataFrame, placed: DataFrame, stops: DataFrame, shapes: DataFrame, shape_of: DataFrame) -> DataFrame:
    """pattern_id, board, alight, source, place, lat, lon: the points of the path of each distinct ride, in order. They are the
    two end stops and the shape's points between them (source shape), or, where there are none or the shape can't be used, the
    stops from one end to the other (source stops). Points without coordinates are left out. placed: as of
    ``stops_on_shapes``."""
    rides = legs.select("pattern_id", "board", "alight").distinct()
    located = placed.join(stops.select("stop_id", "lat", "lon"), "stop_id", "left")
    end = lambda p, m: placed.select("pattern_id", F.col("position").alias(p), F.col("metres").alias(m), "usable")
    ends = rides.join(end("board", "a"), ["pattern_id", "board"]).join(end("alight", "b").drop("usable"), ["pattern_id", "alight"])
    points = shape_of.join(shapes, "shape_id").select("pattern_id", F.round("metres").cast("long").alias("m"), "sequence", "lat", "lon")
    keys = ["pattern_id", "board", "alight"]
    inside = ends.where("usable").join(points, "pattern_id").where("m between a and b").select(*keys, F.col("m").alias("order"), F.col("sequence").cast("long").alias("next"), "lat", "lon")
    drawn = ends.join(inside.select(*keys).distinct(), keys, "left_semi")
    plain = ends.join(inside.select(*keys).distinct(), keys, "left_anti")
    on = located.select("pattern_id", "position", "lat", "lon")
    tips = drawn.join(on, "pattern_id").where("position in (board, alight)").select(*keys, F.when(F.col("position") == F.col("board"), -1).otherwise(2**62).cast("long").alias("order"), F.lit(0).cast("long").alias("next"), "lat", "lon")
    between = plain.join(on, "pattern_id").where("position between board and alight").select(*keys, F.col("position").cast("long").alias("order"), F.lit(0).cast("long").alias("next"), "lat", "lon")
    every = inside.union(tips).withColumn("source", F.lit("shape")).union(between.withColumn("source", F.lit("stops"))).where("lat is not null and lon is not null")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "next", "lat", "lon"))
    return every.withColumn("place", place).select(*keys, "source", "place", "lat", "lon")


def pattern_geometry(placed: DataFrame, stops: DataFrame, shapes: DataFrame, shape_of: DataFrame) -> DataFrame:
    """pattern_id, source, place, lat, lon: the whole shape of each pattern if it can be used, else its located stops."""
    usable = placed.groupBy("pattern_id").agg(F.bool_or("usable").alias("usable"))
    drawn = usable.where("usable").join(shape_of, "pattern_id").join(shapes, "shape_id").select("pattern_id", F.lit("shape").alias("source"), F.col("sequence").cast("long").alias("order"), "lat", "lon")
    plain = usable.where("not usable").join(placed.drop("usable"), "pattern_id").join(stops.select("stop_id", "lat", "lon"), "stop_id").where("lat is not null and lon is not null")
    every = drawn.union(plain.select("pattern_id", F.lit("stops").alias("source"), F.col("position").cast("long").alias("order"), "lat", "lon"))
    place = F.row_number().over(Window.partitionBy("pattern_id").orderBy("order", "lat", "lon"))
    return every.withColumn("place", place).select("pattern_id", "source", "place", "lat", "lon")
