"""Journeys of which those that are the same to a traveller count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions.durable import durable
from headway.operators.rounds import journeys, legs, set_key, width_for
from headway.operators.similar import first_groups, ride_facts


def grouped_journeys(requests: DataFrame, calls: DataFrame, edges: DataFrame, shapes: DataFrame, usable: DataFrame, k: int = 3, width: int | None = -1, **options) -> DataFrame:
    """request_id, mode, group (from 1), rank, anchor, rides, lines, days, steps, walk, cost: the journeys of the ``k`` best groups of each
    request and mode. A group is a journey, the best of it, and those that are the same to a traveller, leg by leg.

    The search asks for four times as many combinations of lines as groups; requests that these don't fill k groups for, though
    there were as many, are searched again for four times more. Each pair of sets of ends is searched once.
    shapes, usable: see ``ride_facts``; options: see ``journeys``, which is asked without round-about ways unless they say so."""
    options = {"sensible": True} | options
    asked = requests.select("request_id", *(set_key(c).alias(key) for c, key in (("origins", "o"), ("destinations", "d"))))
    pairs = requests.groupBy(set_key("origins").alias("o"), set_key("destinations").alias("d")).agg(F.first("origins").alias("origins"), F.first("destinations").alias("destinations"))
    pairs = durable(pairs.withColumn("request_id", F.monotonically_increasing_id()))
    left, found, most = pairs.select("request_id", "origins", "destinations"), None, 4 * k
    while True:
        answers = durable(journeys(left, calls, edges, most, width=width_for(k) if width == -1 else width, **options))
        parts = durable(legs(answers, calls, "request_id", "mode", "rank"))
        facts = durable(ride_facts(parts.where("not walking"), calls, shapes, usable))
        groups = durable(first_groups(parts, facts, k, "request_id", "mode"))
        full = groups.groupBy("request_id", "mode").agg(F.countDistinct("anchor").alias("n"))
        more = answers.groupBy("request_id", "mode").agg(F.count("*").alias("answers")).join(full, ["request_id", "mode"], "left")
        more = durable(more.where((F.coalesce("n", F.lit(0)) < k) & (F.col("answers") == most)).select("request_id").distinct())
        told = answers.join(groups, ["request_id", "mode", "rank"]).join(more, "request_id", "left_anti")
        found = told if found is None else found.union(told)
        if more.isEmpty():
            break
        left, most = durable(left.join(more, "request_id", "left_semi")), 4 * most
    number = found.groupBy("request_id", "mode").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))  # k at most
    found = found.join(number, ["request_id", "mode"]).withColumn("group", F.array_position("anchors", F.col("anchor")).cast("int")).drop("anchors")
    found = found.join(pairs.select("request_id", "o", "d"), "request_id").drop("request_id")
    return asked.join(found, ["o", "d"]).select("request_id", "mode", "group", "rank", "anchor", "rides", "lines", "days", "steps", "walk", "cost")
