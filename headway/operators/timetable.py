"""Timetables expanded over dates, and arrivals at stops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.clock import is_rush_hour, speed_kmh
from headway.functions.durable import durable
from headway.functions.text import normalised

DAY, HOUR = 86_400, 3_600
DISTRICT_SPACING = 600
#: Days of a term, in which service days and spans of validity meet.
TERM = 91
#: Seconds of a part of the day, in which requests at a place and arrivals there are put in order.
SPAN = 21_600
#: Vehicles that arrive in the same second are told in this order.
ORDER = ["route_id", "pattern_id", "back", "departure", "platform", "position"]
#: Rows that a task takes up at once, and requests that it answers at once.
ROWS, ASKS = 50_000, 4_000


def line_kinds(calls: DataFrame) -> DataFrame:
    """pattern_id, kind: tram, or by the mean distance between stops district or city."""
    spacing = (F.max("metres") - F.min("metres")) / F.nullif(F.count("*") - 1, F.lit(0))
    return calls.groupBy("pattern_id").agg(F.when(F.bool_or("tram"), "tram").when(spacing >= DISTRICT_SPACING, "district").otherwise("city").alias("kind"))


def term(day: Column) -> Column:
    """The number of the stretch of TERM days that a date lies in."""
    return F.floor(F.unix_date(day) / TERM)


def in_terms(services: DataFrame, days: DataFrame) -> DataFrame:
    """``services`` (start_date, end_date, null: open, ...) with first_day and last_day, cut to the range of ``days`` (day) and the day
    before its first, in a row for each term that they reach into; without those that lie outside."""
    span = days.agg(F.date_sub(F.min("day"), 1).alias("least"), F.max("day").alias("most"))  # one row
    cut = services.crossJoin(F.broadcast(span)).withColumn("first_day", F.greatest("start_date", "least")).withColumn("last_day", F.least("end_date", "most"))
    cut = cut.where("first_day <= last_day").drop("least", "most", "start_date", "end_date")
    return cut.withColumn("term", F.explode(F.sequence(term(F.col("first_day")), term(F.col("last_day")))))


def arrivals(requests: DataFrame, calls: DataFrame, departures: DataFrame, within: int = HOUR, detail: tuple[str, ...] = ()) -> DataFrame:
    """request_id, pattern_id, route_id, back, departure, wait (seconds from the instant), and ``detail`` (of position, metres,
    speed, elapsed): vehicles that reach the stop of a request within ``within`` seconds; not where a pattern ends, nor where
    one can't board.

    The service day is that of the instant or the day before. A departure's speed depends on rush hour at departure, so a
    request asks for each speed in turn; departures meet it in bins of an hour, not in a product. Departures with start_date and end_date
    (null: open) count on service days between these, both included; a vehicle after midnight belongs to the day before. Requests with
    pattern_id and position ask for the vehicles of that pattern there alone."""
    at = [c for c in ("pattern_id", "position") if c in requests.columns]
    ends = calls.groupBy("pattern_id").agg(F.max("position").alias("last"))
    stands = calls.join(ends, "pattern_id").where("position < last and pickup").join(line_kinds(calls), "pattern_id").select("pattern_id", "route_id", "stop_id", "position", "metres", "kind")
    now = F.hour("instant") * HOUR + F.minute("instant") * 60 + F.floor(F.second("instant"))
    asked = requests.select("request_id", "stop_id", *at, now.cast("long").alias("now"), F.weekday("instant").alias("weekday"), F.to_date("instant").alias("date")).join(stands, ["stop_id", *at])
    asked = asked.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rush", F.explode(F.array(F.lit(False), F.lit(True))))
    asked = asked.withColumn("weekday", (F.col("weekday") - F.col("back") + 7) % 7)
    offset = F.floor(F.col("metres") * 36 / (speed_kmh(F.col("kind"), F.col("rush")) * 10)).cast("long")
    low = F.col("now") + DAY * F.col("back") - F.col("offset")
    asked = asked.withColumn("offset", offset).withColumn("low", low).where(F.col("low") + within >= 0)
    asked = asked.withColumn("bin", F.explode(F.sequence(F.floor(F.greatest(F.col("low"), F.lit(0)) / HOUR), F.floor((F.col("low") + within) / HOUR))))
    dealt, keys = departures.withColumn("bin", F.floor(F.col("departure") / HOUR)), ["pattern_id", "bin"]
    if "start_date" in departures.columns:
        asked = asked.withColumn("day", F.expr("date_sub(date, back)")).withColumn("term", term(F.col("day")))
        dealt, keys = in_terms(dealt, requests.select(F.to_date("instant").alias("day"))), [*keys, "term"]
    second = F.col("departure") % DAY
    day = (F.col("weekday") + F.floor(F.col("departure") / DAY)) % 7
    met = asked.join(dealt, keys).where(F.col("departure").between(F.col("low"), F.col("low") + within))
    if "start_date" in departures.columns:
        met = met.where(F.col("day").between(F.col("first_day"), F.col("last_day")))
    met = met.where(F.expr("(days & shiftleft(1, cast(weekday as int))) <> 0") & (is_rush_hour(day, second) == F.col("rush")))
    met = met.withColumn("speed", speed_kmh(F.col("kind"), F.col("rush"))).withColumn("elapsed", F.col("now") + DAY * F.col("back") - F.col("departure"))
    return met.select("request_id", "pattern_id", "route_id", "back", "departure", (F.col("departure") - F.col("low")).alias("wait"), *detail).distinct()


def service_days(departures: DataFrame) -> DataFrame:
    """``departures`` with rush, and with the days of service (bits) on which they start in a rush hour, or don't; a row for each of
    both that occurs. Equal departures without dates are one, with the days of all."""
    dated = [c for c in ("start_date", "end_date") if c in departures.columns]
    once = departures.groupBy("pattern_id", "departure", *dated).agg(F.bit_or("days").alias("days"))
    second, later = F.col("departure") % DAY, F.floor(F.col("departure") / DAY)
    each = once.withColumn("rush", F.explode(F.array(F.lit(False), F.lit(True))))
    bits = [F.when(is_rush_hour((F.lit(d) + later) % 7, second) == F.col("rush"), F.col("days").bitwiseAND(1 << d)).otherwise(0) for d in range(7)]
    return each.withColumn("days", sum(bits[1:], bits[0]).cast("int")).where("days <> 0")


def passings(platforms: DataFrame, calls: DataFrame, departures: DataFrame, within: int) -> DataFrame:
    """place, span, at (second of the day of a request), days (bits of the service day; with start_date and end_date if
    departures have these), back, departure, speed, route_id, pattern_id, platform, position: when vehicles reach the ``platforms`` (stop_id,
    place); see ``arrivals``. A row for each span of SPAN seconds whose instants can ask for it."""
    ends = calls.groupBy("pattern_id").agg(F.max("position").alias("last"))
    stands = calls.join(ends, "pattern_id").where("position < last and pickup").join(line_kinds(calls), "pattern_id").join(platforms, "stop_id")
    stands = stands.select("pattern_id", "route_id", F.col("stop_id").alias("platform"), "place", "position", "metres", "kind")
    met = service_days(departures).join(stands, "pattern_id").withColumn("speed", speed_kmh(F.col("kind"), F.col("rush")))
    reached = F.col("departure") + F.floor(F.col("metres") * 36 / (F.col("speed") * 10)).cast("long")
    met = met.withColumn("back", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", reached - DAY * F.col("back")).where(F.col("at").between(0, DAY + within))
    first, last = F.greatest(F.floor((F.col("at") - within) / SPAN), F.lit(0)), F.least(F.floor(F.col("at") / SPAN), F.lit(DAY // SPAN - 1))
    return met.withColumn("span", F.explode(F.sequence(first, last))).drop("metres", "kind", "rush")


def first_passings(asks: DataFrame, rows: DataFrame, limit: int, within: int) -> DataFrame:
    """request_id, now, rank, at, along (metres that the vehicle has gone by now, below 0 before it departs) and ORDER of the first ``limit`` of ``rows`` (see ``passings``) within ``within`` seconds of
    each of ``asks`` (request_id, place, now, weekday, date).

    Passings of a place lie in one order of time, which doesn't depend on the request: they are sorted once, with the requests, and
    each request takes a stretch of them. A task goes through them in order and holds those of ``within`` seconds, and a few batches."""
    dated = "start_date" in rows.columns
    own = F.unix_date("date") if dated else F.col("weekday")
    asked = asks.select("place", F.floor(F.col("now") / SPAN).alias("span"), F.col("now").alias("at"), "request_id", own.alias("own"), F.lit(False).alias("passing")).distinct()
    if dated:
        rows = rows.withColumns({c: F.coalesce(F.unix_date(c), F.lit(open_end)) for c, open_end in (("start_date", -(2**31)), ("end_date", 2**31 - 1))})
    both = rows.withColumn("passing", F.lit(True)).unionByName(asked, allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    told = {"request_id": kinds["request_id"], "now": "long", "rank": "int", "along": "long", **{c: kinds[c] for c in ("at", *ORDER)}}

    def stretches(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Of the requests of one place and span; if not ``last``, of those whose passings are all there."""
        at, passing = (rows[c].to_numpy() for c in ("at", "passing"))
        asking = np.flatnonzero(~passing if last else ~passing & (at + within < at[-1]))
        if not len(asking):
            return
        some = np.flatnonzero(passing)
        number = lambda c: rows[c].take(pa.array(some)).to_numpy()
        back, days, place = number("back"), number("days"), np.stack([at[some], *map(number, ORDER)])
        since, until = (number(c) for c in ("start_date", "end_date")) if dated else (None, None)
        asked_for = rows["own"].take(pa.array(asking)).to_numpy()
        for own in np.unique(asked_for):
            runs = days >> ((own + (3 if dated else 0) - back) % 7) & 1 > 0  # day 0 of dates is a Thursday
            if dated:
                runs &= (since <= own - back) & (own - back <= until)
            here = np.flatnonzero(runs)
            if not len(here):
                continue
            here = here[np.append(True, (place[:, here[1:]] != place[:, here[:-1]]).any(axis=0))]
            mine = asking[asked_for == own]
            for k in range(0, len(mine), ASKS):
                part = mine[k : k + ASKS]
                first = np.searchsorted(place[0, here], at[part])
                n = np.minimum(np.searchsorted(place[0, here], at[part] + within, "right") - first, limit)
                rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found, ask = rows.take(pa.array(some[here[np.repeat(first, n) + rank]])), rows.take(pa.array(np.repeat(part, n)))
                gone = (ask["at"].to_numpy() + DAY * found["back"].to_numpy() - found["departure"].to_numpy()) * found["speed"].to_numpy() * 10 // 36
                columns = {c: found[c] for c in ("at", *ORDER)} | {"request_id": ask["request_id"], "now": ask["at"], "rank": pa.array(rank + 1, "int32"), "along": pa.array(gone)}
                yield from pa.table({c: columns[c] for c in told}).to_batches()

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, come = None, []

        def passed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, come
            rows, come = pa.Table.from_batches([*(held.to_batches() if held else []), *come]).combine_chunks(), []
            group = np.stack([rows[c].to_numpy() for c in ("place", "span")])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1), rows.num_rows]
            for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
                yield from stretches(rows.slice(low, high - low), True)
            rows = rows.slice(cuts[-2])
            yield from stretches(rows, last)
            at = rows["at"].to_numpy()
            held = rows.slice(np.searchsorted(at, at[-1] - within))

        for batch in batches:
            if batch.num_rows:
                come.append(batch)
            if sum(x.num_rows for x in come) > max(ROWS, held.num_rows if held else 0):
                yield from passed(False)
        if come or held:
            yield from passed(True)

    sorted_both = both.repartition("place", "span").sortWithinPartitions("place", "span", "at", "passing", *ORDER)
    return sorted_both.mapInArrow(through, ", ".join(f"{c} {kind}" for c, kind in told.items()))


def name_board(requests: DataFrame, stops: DataFrame, calls: DataFrame, departures: DataFrame, limit: int = 60) -> DataFrame:
    """request_id, rank, platform, route_id, pattern_id, minutes (half-even), remaining (stops still to reach, this one too; null
    before departure), departs_in (seconds; null after departure), near (whether the vehicle is on its way and at most ten
    minutes off): the next ``limit`` arrivals at all platforms of a name; names are compared normalised, one without letter or
    digit has no platforms. requests: request_id, instant, name; stops: stop_id, name. Arrivals are found as ``arrivals`` says."""
    named = stops.select("stop_id", normalised(F.col("name")).alias("key")).where("key <> ''").distinct()
    places = named.groupBy("key").agg(F.min("stop_id").alias("place"))
    platforms = durable(named.join(places, "key").select("stop_id", "place"))
    now = F.hour("instant") * HOUR + F.minute("instant") * 60 + F.floor(F.second("instant"))
    asks = requests.withColumn("key", normalised(F.col("name"))).join(places, "key")
    asks = asks.select("request_id", "place", now.cast("long").alias("now"), F.weekday("instant").alias("weekday"), F.to_date("instant").alias("date"))
    found = first_passings(asks, passings(platforms, calls, departures, HOUR), limit, HOUR)
    marks = calls.groupBy("pattern_id").agg(F.array_sort(F.collect_list("metres")).alias("marks"))  # a row for each pattern
    wait, elapsed = F.col("at") - F.col("now"), F.col("now") + DAY * F.col("back") - F.col("departure")
    if not asks.groupBy("request_id").count().where("count > 1").isEmpty():  # rows of one request are ranked together
        rank = F.row_number().over(Window.partitionBy("request_id").orderBy(wait, *ORDER))
        found = found.drop("rank").withColumn("rank", F.lit(0)).distinct().withColumn("rank", rank).where(F.col("rank") <= limit)
    on_way = elapsed >= 0
    passed = F.least(F.size(F.filter("marks", lambda m: m <= F.col("along"))) - 1, F.size("marks") - 2)
    minutes = F.bround(wait / 60).cast("long")
    return found.join(F.broadcast(marks), "pattern_id").select(
        "request_id", "rank", "platform", "route_id", "pattern_id", minutes.alias("minutes"),
        F.when(on_way, F.col("position") - passed).alias("remaining"), F.when(~on_way, -elapsed).alias("departs_in"), (on_way & (minutes <= 10)).alias("near"),
    )
