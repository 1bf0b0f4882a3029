"""Stops for names as people type them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from headway.functions.text import normalised
from headway.operators.name_index import containing, sharing_letters, sharing_words

#: The least score, what may lie between the best score and another, the bonus of the right district, and the
#: weights of a part of a name (0.9 to 0.99) and of shared words.
LEAST, MARGIN, DISTRICT_BONUS, PART, PART_LENGTH, WORDS = 0.70, 0.03, 0.02, 0.9, 0.09, 0.88
PLATFORMS = 16
#: What normalised names are made of.
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789 "


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over the letters of both."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarities(asked: DataFrame, known: DataFrame) -> DataFrame:
    """q, name_key, ratio, score of the pairs of a query ``asked.q`` and a name ``known.name_key`` (both normalised and
    distinct) that can score LEAST less the bonus: one is part of the other, they share words enough, or neither their lengths
    nor the letters they have in common rule it out. They meet by parts, words and letters (see ``name_index``); the ratio
    is computed for these alone."""
    letters = lambda c: F.array(*((F.length(c) - F.length(F.replace(c, F.lit(x)))) for x in SIGNS))
    asked, known = asked.withColumn("_a", letters(F.col("q"))), known.withColumn("_b", letters(F.col("name_key")))
    a, b = F.col("q"), F.col("name_key")
    la, lb = F.length(a), F.length(b)
    least, most = F.least(la, lb), F.greatest(la, lb)
    part: Column = a.contains(b) | b.contains(a)
    words = lambda c: F.array_distinct(F.split(c, " "))
    shared = F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.size(words(b)))
    floor = LEAST - DISTRICT_BONUS
    common = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    asks, names = asked.select("q").where("q <> ''"), known.select("name_key").where("name_key <> ''")
    inside = containing(asks.select(F.col("q").alias("part")), names.select(F.col("name_key").alias("whole"))).select(F.col("part").alias("q"), F.col("whole").alias("name_key"))
    around = containing(names.select(F.col("name_key").alias("part")), asks.select(F.col("q").alias("whole"))).select(F.col("whole").alias("q"), F.col("part").alias("name_key"))
    met = inside.union(around).union(sharing_words(asks, names)).union(sharing_letters(asks, names, floor)).distinct()
    met = met.join(asked, "q").join(known, "name_key")
    met = met.where(part | (WORDS * shared >= floor) | ((2 * least / (la + lb) >= floor) & (2 * common / (la + lb) >= floor))).select("q", "name_key", match_ratio("q", "name_key").alias("ratio"))
    score = F.when(a == b, 1.0).when(part, PART + PART_LENGTH * least / most).otherwise(F.greatest(WORDS * shared, F.col("ratio")))
    return met.withColumn("score", F.round(score, 9))


def resolved(requests: DataFrame, stops: DataFrame, calls: DataFrame, platforms: int = PLATFORMS) -> DataFrame:
    """request_id, place, stop_id, score of the stops that a request (request_id, district, name) may mean: those of its
    district score a bonus; without a district all do. Nothing scores under LEAST; beside the best a stop may be MARGIN
    less, and nothing if the best is exact. Ties go to the stop with more patterns, then to the lower id. Null or empty
    names have no stops."""
    asked = requests.select("request_id", normalised(F.coalesce("district", F.lit(""))).alias("d"), normalised(F.coalesce("name", F.lit(""))).alias("q"))
    served = calls.groupBy("stop_id").agg(F.countDistinct("pattern_id").alias("n_patterns"))
    known = stops.join(served, "stop_id").select("stop_id", "n_patterns", normalised(F.col("name")).alias("name_key"), normalised(F.col("district")).alias("d"))
    scored = similarities(asked.select("q").distinct(), known.select("name_key").distinct())
    queries = asked.select("d", "q").distinct().join(scored, "q")
    bonus = F.lit(DISTRICT_BONUS)
    near = queries.where("d <> ''").join(known, ["d", "name_key"]).select("d", "q", "stop_id", "n_patterns", (F.col("score") + bonus).alias("score"))
    wide = queries.join(known.drop("d"), "name_key").select("d", "q", "stop_id", "n_patterns", (F.col("score") + F.when(F.col("d") == "", bonus).otherwise(0.0)).alias("score"))
    each = near.union(wide).groupBy("d", "q", "stop_id", "n_patterns").agg(F.round(F.max("score"), 9).alias("score"))
    kept = each.withColumn("best", F.max("score").over(Window.partitionBy("d", "q"))).where(F.col("best") >= LEAST)
    kept = kept.where(F.col("score") >= F.when(F.col("best") >= 0.999, F.col("best")).otherwise(F.round(F.col("best") - MARGIN, 9)))
    place = F.row_number().over(Window.partitionBy("d", "q").orderBy(F.desc("score"), F.desc("n_patterns"), "stop_id"))
    top = kept.withColumn("place", place).where(F.col("place") <= platforms)
    return asked.join(top, ["d", "q"]).select("request_id", "place", "stop_id", "score")


def short_name(name: Column, cities: list[str]) -> Column:
    """The name before the first comma, without a city (and "merkez", "merkezi") at its end."""
    head = normalised(F.substring_index(name, ",", 1))
    return F.trim(F.regexp_replace(head, f" ({'|'.join(cities)})( merkezi?)?$", "")) if cities else head


def resolved_with_retry(requests: DataFrame, stops: DataFrame, calls: DataFrame, cities: list[str]) -> DataFrame:
    """As ``resolved``, for names from map searches: first the short name, and if it has no stops the full one."""
    short = short_name(F.coalesce("name", F.lit("")), cities)
    tries = F.array(F.struct(F.lit(0).alias("attempt"), short.alias("tried")), F.struct(F.lit(1).alias("attempt"), F.coalesce("name", F.lit("")).alias("tried")))
    each = requests.select("request_id", "district", F.inline(tries)).select(F.struct("request_id", "attempt").alias("request_id"), "district", F.col("tried").alias("name"))
    found = resolved(each, stops, calls).select("request_id.request_id", "request_id.attempt", "place", "stop_id", "score")
    first = F.min("attempt").over(Window.partitionBy("request_id"))
    return found.withColumn("first", first).where("attempt = first").select("request_id", "place", "stop_id", "score")


def suggestions(requests: DataFrame, stops: DataFrame, calls: DataFrame, k: int = 3) -> DataFrame:
    """request_id, place, name: for requests without a stop the ``k`` names most like theirs, by ratio, LEAST at least."""
    open_requests = requests.join(resolved(requests, stops, calls), "request_id", "left_anti")
    asked = open_requests.select("request_id", normalised(F.substring_index("name", ",", 1)).alias("q"))
    active = stops.join(calls.select("stop_id").distinct(), "stop_id", "left_semi").withColumn("name_key", normalised(F.col("name")))
    known = active.groupBy("name_key").agg(F.min_by("name", "stop_id").alias("name"))
    scored = similarities(asked.select("q").distinct(), known.select("name_key")).where(F.col("ratio") >= LEAST)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("ratio"), F.desc("name_key")))
    top = scored.withColumn("place", place).where(F.col("place") <= k).join(known, "name_key")
    return asked.join(top, "q").select("request_id", "place", "name")
