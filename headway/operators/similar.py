"""Rides and journeys that are the same to a traveller, though their lines differ."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from headway.functions.durable import durable

#: The share of common stops of the longer ride, metres between two paths, the ratio of their lengths, metres
#: between samples, and the most samples.
OVERLAP, NEAR, RATIO, STEP, SAMPLES = 0.90, 35, 1.05, 25, 2000


def common_in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest sequence of stops that both have in this order: an increasing run among the places in ``b``."""
    places: dict[int, list[int]] = {}
    for k in range(len(b) - 1, -1, -1):
        places.setdefault(b[k], []).append(k)
    ends: list[int] = []
    for stop in a:
        for k in places.get(stop, ()):
            at = bisect_left(ends, k)
            ends[at : at + 1] = [k]
    return len(ends)


@F.pandas_udf(IntegerType())
def ordered_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_in_order(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def paths_agree(one: np.ndarray, other: np.ndarray, low: float, high: float, other_low: float, other_high: float) -> bool:
    """Whether two pieces of paths (rows: metres, lat, lon) are of nearly equal length and lie close at equal shares of it."""
    a, b = high - low, other_high - other_low
    if len(one) < 2 or len(other) < 2 or min(a, b) <= 0 or max(a, b) / min(a, b) > RATIO:
        return False
    share = np.linspace(0, 1, min(SAMPLES, max(2, int(np.ceil(max(a, b) / STEP)))) + 1)
    at, to = (np.radians([np.interp(start + share * size, path[:, 0], path[:, k]) for k in (1, 2)]) for start, size, path in ((low, a, one), (other_low, b, other)))
    h = np.sin((to[0] - at[0]) / 2) ** 2 + np.cos(at[0]) * np.cos(to[0]) * np.sin((to[1] - at[1]) / 2) ** 2
    return bool((12_742_000 * np.arcsin(np.minimum(1, np.sqrt(h))) <= NEAR).all())


@F.pandas_udf(BooleanType())
def same_geometry(one: pd.Series, other: pd.Series, low: pd.Series, high: pd.Series, other_low: pd.Series, other_high: pd.Series) -> pd.Series:
    path = lambda x: np.array([[p["metres"], p["lat"], p["lon"]] for p in x], dtype=np.float64) if x is not None else np.zeros((0, 3))
    return pd.Series([paths_agree(path(x), path(y), *ends) for x, y, *ends in zip(one, other, low, high, other_low, other_high, strict=True)], dtype=bool)


def loops(stops: Column) -> Column:
    """Stops that a ride calls at more than once, each as often as it does, sorted."""
    return F.array_sort(F.filter(stops, lambda s: F.size(F.filter(stops, lambda t: t == s)) > 1))


RIDE = ["pattern_id", "board", "alight"]


def ride_facts(rides: DataFrame, calls: DataFrame, shapes: DataFrame, usable: DataFrame) -> DataFrame:
    """The distinct ``rides`` (pattern_id, board, alight) with tram, path (stops), line (points of their path on the map, null if it
    can't be used), low and high (metres of their ends on it). shapes: pattern_id, metres, lat, lon; usable: pattern_id, position, metres of
    the stops placed on shapes that can be used."""
    own = rides.select(*RIDE).distinct()
    stops = calls.groupBy("pattern_id", "tram").agg(F.array_sort(F.collect_list(F.struct("position", "stop_id"))).alias("at"))
    own = own.join(stops, "pattern_id").withColumn("path", F.expr("transform(slice(at, board + 1, alight - board + 1), x -> x.stop_id)")).drop("at")
    drawn = shapes.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("metres", "lat", "lon"))).alias("line"))
    place = lambda p, m: usable.select("pattern_id", F.col("position").alias(p), F.col("metres").cast("double").alias(m))
    own = own.join(place("board", "low"), ["pattern_id", "board"], "left").join(place("alight", "high"), ["pattern_id", "alight"], "left").join(drawn, "pattern_id", "left")
    return own.withColumn("line", F.when(F.col("low").isNotNull(), F.col("line")))


def alike(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (pattern_id, board, alight, other, other_board, other_alight) that are one ride to a traveller: same mode and ends, and
    either equal stops; or equal loops and at least three common stops in order that are all of the shorter ride's, or 90 %
    of the longer one's; or paths on the map that agree."""
    to = {"pattern_id": "other", **{c: f"other_{c}" for c in facts.columns if c != "pattern_id"}}
    met = pairs.join(facts, RIDE).join(facts.withColumnsRenamed(to), ["other", "other_board", "other_alight"])
    ends = lambda path: F.struct(F.get(path, F.lit(0)), F.element_at(path, -1))
    met = met.where((F.col("tram") == F.col("other_tram")) & (ends(F.col("path")) == ends(F.col("other_path"))))
    equal, loop = F.col("path") == F.col("other_path"), loops(F.col("path")) == loops(F.col("other_path"))
    rest = met.where(~equal & loop).withColumn("common", ordered_overlap("path", "other_path"))
    short, long = F.least(F.size("path"), F.size("other_path")), F.greatest(F.size("path"), F.size("other_path"))
    rest = rest.withColumn("close", ((F.col("common") >= 3) & (F.col("common") == short)) | (F.col("common") / long >= OVERLAP))
    drawn = rest.where("not close and line is not null and other_line is not null").where(same_geometry("line", "other_line", "low", "high", "other_low", "other_high"))
    return met.where(equal).select(pairs.columns).union(rest.where("close").select(pairs.columns)).union(drawn.select(pairs.columns))


def ride_classes(facts: DataFrame) -> DataFrame:
    """pattern_id, board, alight, first, first_board, first_alight: the lowest ride with the same mode and stops, and the same path on the map."""
    path = F.xxhash64("line", "low", "high")
    first = facts.groupBy("tram", "path", path.alias("drawn")).agg(F.min(F.struct(*RIDE)).alias("first"))
    return facts.withColumn("drawn", path).join(first, ["tram", "path", "drawn"]).select(*RIDE, *(F.col(f"first.{c}").alias("first" if c == "pattern_id" else f"first_{c}") for c in RIDE))


def similar_rides(rides: DataFrame, calls: DataFrame, shapes: DataFrame, usable: DataFrame) -> DataFrame:
    """pattern_id, board, alight, other, other_board, other_alight: links between the distinct ``rides`` that are one to a traveller (see
    ``alike``): each ride with the first of its class, and the pairs of these firsts that are alike. Classes hold the rides of
    equal stops and path on the map, so a ride that is alike to one of a class is to all of it: members give no pairs among themselves.

    Firsts meet by mode and both ends."""
    facts = durable(ride_facts(rides, calls, shapes, usable))
    members = durable(ride_classes(facts))
    firsts = facts.join(members.where("struct(pattern_id, board, alight) = struct(first, first_board, first_alight)").select(*RIDE), RIDE, "left_semi")
    ends = firsts.select("tram", F.get("path", F.lit(0)).alias("a"), F.element_at("path", -1).alias("b"), *RIDE)
    pairs = ends.join(ends.withColumnsRenamed({"pattern_id": "other", "board": "other_board", "alight": "other_alight"}), ["tram", "a", "b"])
    pairs = pairs.where("struct(pattern_id, board, alight) < struct(other, other_board, other_alight)").select(*RIDE, "other", "other_board", "other_alight")
    own = members.where("struct(pattern_id, board, alight) <> struct(first, first_board, first_alight)")
    return own.select(F.col("first").alias("pattern_id"), F.col("first_board").alias("board"), F.col("first_alight").alias("alight"), F.col("pattern_id").alias("other"), F.col("board").alias("other_board"), F.col("alight").alias("other_alight")).union(alike(pairs, firsts))


def first_groups(legs: DataFrame, facts: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, rank, anchor of the journeys that belong to the first ``k`` groups of their request (keys). In each of k rounds the best
    journey without a group becomes an anchor, and all without a group that are the same to a traveller join it: as many legs,
    walks between the same stops, rides that are alike. So k counts groups, and no journey is compared but with anchors.
    legs: keys, rank, leg, walking, board_stop, alight_stop, pattern_id, board, alight."""
    step = F.struct("walking", "board_stop", "alight_stop", *RIDE)
    open_legs = durable(legs.select(*keys, "rank", "leg", step.alias("x")).withColumn("n", F.count("*").over(Window.partitionBy(*keys, "rank"))))
    found = None
    for _ in range(k):
        anchors = open_legs.groupBy(*keys).agg(F.min("rank").alias("anchor"))
        theirs = open_legs.join(anchors, [*keys]).where("rank = anchor").select(*keys, "anchor", "leg", "n", F.col("x").alias("y"))
        met = durable(open_legs.join(theirs, [*keys, "leg", "n"]))
        both = {"pattern_id": "x.pattern_id", "board": "x.board", "alight": "x.alight", "other": "y.pattern_id", "other_board": "y.board", "other_alight": "y.alight"}
        pairs = met.select(*(F.col(c).alias(name) for name, c in both.items()))
        good = alike(pairs.where("pattern_id is not null and other is not null").distinct(), facts).withColumn("alike", F.lit(True))
        on = [F.col(c) == F.col(f"p.{name}") for name, c in both.items()]
        same = (F.col("x.walking") & F.col("y.walking") & (F.col("x.board_stop") == F.col("y.board_stop")) & (F.col("x.alight_stop") == F.col("y.alight_stop"))) | F.col("p.alike")
        joins = met.join(good.alias("p"), on, "left").where(same).groupBy(*keys, "rank", "anchor", "n").agg(F.count("*").alias("agree")).where("agree = n").select(*keys, "rank", "anchor")
        joins = durable(joins)
        found = joins if found is None else found.union(joins)
        open_legs = durable(open_legs.join(joins, [*keys, "rank"], "left_anti"))
        if open_legs.isEmpty():
            break
    return found
