"""Operators on small feeds: loops, missing values, ties."""

import pytest
from pyspark.sql import functions as F

from headway.functions import clock, geo, text
from headway.operators import journeys, lines, name_index, names, patterns, rides, timetable, validate


def test_loop_pattern_and_permissions(spark):
    times = spark.createDataFrame(
        [("a", 1, 1, 0, True, True), ("a", 2, 2, 0, True, True), ("a", 1, 3, 0, True, True), ("b", 2, 2, 0, True, True), ("b", 1, 1, 0, True, True), ("b", 1, 2, 1, True, True), ("c", 1, 1, 0, True, False), ("c", 2, 2, 0, True, True)],
        "trip_id string, stop_id long, stop_sequence int, ordinal int, pickup boolean, dropoff boolean",
    )
    trips = spark.createDataFrame([("a", 1, "w", None), ("b", 1, "w", None), ("c", 1, "w", "0"), ("d", 1, "w", "0"), ("a2", 1, "off", None)], "trip_id string, route_id int, service_id string, direction string")
    calendars = spark.createDataFrame([("w", 31), ("off", 0)], "service_id string, days int")
    found = patterns.patterns(trips, calendars, times)
    assert [(r.pattern_id, r.direction, r.stops, r.n_trips) for r in found.orderBy("pattern_id").collect()] == [(0, None, "1-2-1", 2), (1, "0", "1-2", 1)]
    assert {(r.pattern_id, r.stop_id, r.positions) for r in patterns.positions(patterns.occurrences(found)).collect()} == {(0, 1, "0,2"), (0, 2, "1"), (1, 1, "0"), (1, 2, "1")}


def test_unknown_coordinates_count_400_metres(spark):
    calls = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "pattern_id int, position int, stop_id long")
    stops = spark.createDataFrame([(1, 40.0, 29.0), (2, None, None), (3, 40.0, 29.0)], "stop_id long, lat double, lon double")
    assert [r.metres for r in geo.chain_metres(calls, stops).orderBy("position").collect()] == [0, 400, 800]
    assert geo.walking_edges(stops).count() == 2


@pytest.mark.parametrize(("label", "seconds"), [("24:15", 87300), ("48:05:09", 173109), ("24:70:00", None), ("", None), (None, None), ("7:00:00", 25200)])
def test_clock(spark, label, seconds):
    assert spark.createDataFrame([(label,)], "t string").select(clock.clock_seconds(F.col("t"))).first()[0] == seconds


def test_turkish_names(spark):
    assert spark.createDataFrame([("İĞDIR  Şehir-Çarşı!",)], "t string").select(text.normalised(F.col("t"))).first()[0] == "igdir sehir carsi"


def test_violations(spark):
    t = spark.createDataFrame([("1", "x", "20260231", "95.0", "0"), ("1", "7", "20260101", "abc", "0"), (None, "", "", None, None)], "id string, n string, d string, lat string, lon string")
    found = validate.repeated_keys(t, "t", "id").union(validate.bad_integers(t, "t", "n", "id")).union(validate.bad_dates(t, "t", "d", "id")).union(validate.bad_coordinates(t, "t", "id")).union(validate.blank_values(t, "t", "id", "d"))
    assert sorted((r.rule, r.key) for r in found.collect()) == sorted([("unique", "1"), ("integer", "1"), ("date", "1"), ("coordinate", "1"), ("required", "")])
    with pytest.raises(ValueError, match="unique"):
        validate.assert_valid(validate.repeated_keys(t, "t", "id"))


def test_direct_ride_on_loop_needs_later_alighting(spark):
    calls = spark.createDataFrame([(0, 5, 0, 1, 0, False), (0, 5, 1, 2, 1000, False), (0, 5, 2, 1, 2000, False)], "pattern_id int, route_id int, position int, stop_id long, metres long, tram boolean").selectExpr("*", "127 as days", "true as pickup", "true as dropoff")
    asked = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "request_id int, origin long, destination long")
    assert sorted((r.request_id, r.board, r.alight, r.minutes) for r in rides.direct_rides(asked, calls).collect()) == [(1, 1, 2, 8.25), (2, 0, 2, 11.5)]


def test_trip_requests(spark):
    rows = [(1, "Çarşı durağından  Köprü; DURAĞINA lütfen"), (2, None), (3, ""), (4, "durağından B durağına"), (5, "A durağına B durağından"), (6, "A durağından . durağına")]
    got = {r[0]: (r[1], r[2]) for r in names.trip_requests(spark.createDataFrame(rows, "request_id long, message string")).collect()}
    assert got == {1: ("Çarşı", "Köprü"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_cleaned_notes(spark):
    rows = [(1, "Via hill #a1B2c3 "), (2, "Via hill # "), (3, None), (4, "#"), (5, "#12345"), (6, "#123456")]
    got = {r[0]: (r[1], r[2]) for r in lines.cleaned_notes(spark.createDataFrame(rows, "trip_id long, note string")).collect()}
    assert got == {1: (True, "Via hill"), 2: (False, "Via hill"), 3: (False, None), 4: (False, None), 5: (False, "#12345"), 6: (True, None)}


def test_interchangeable_lines(spark):
    """Line 2 makes the same ride on all days, line 3 on too few, line 4 as a tram, line 5 by another way; line 6 lets nobody out."""
    paths = {1: [7, 8, 9], 2: [6, 7, 8, 9], 3: [7, 8, 9], 4: [7, 8, 9], 5: [7, 5, 9], 6: [7, 8, 9]}
    calls = [(p, p, p == 4, i, s) for p, stops in paths.items() for i, s in enumerate(stops)]
    calls = spark.createDataFrame(calls, "pattern_id long, route_id int, tram boolean, position int, stop_id long").selectExpr("*", "true as pickup", "pattern_id <> 6 or position < 2 as dropoff")
    days = spark.createDataFrame([(p, 1 if p == 3 else 31) for p in paths], "pattern_id long, days int")
    legs = spark.createDataFrame([(1, 0, 2), (1, 0, 2)], "pattern_id long, board int, alight int")
    assert [tuple(r) for r in journeys.interchangeable_lines(legs, calls, days).collect()] == [(1, 0, 2, "1,2")]
    assert journeys.interchangeable_lines(legs.limit(0), calls, days).count() == 0


def test_departures_count_on_valid_days(spark):
    """A service day before midnight counts for the vehicle after it; both ends of the span are included, open ends have none."""
    frame = spark.createDataFrame
    calls = frame([(1, 5, False, i, i, 500 * i, True, True, 127) for i in range(4)], "pattern_id long, route_id int, tram boolean, position int, stop_id long, metres long, pickup boolean, dropoff boolean, days int")
    spans = [("2024-03-01", "2024-03-01"), ("2024-02-01", None), (None, "2024-02-29"), ("2024-03-02", "2025-12-31"), (None, None)]
    departures = frame([(1, 127, 86_350 + k, *s) for k, s in enumerate(spans)], "pattern_id long, days int, departure int, start_date string, end_date string")
    departures = departures.withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})
    asked = frame([(d, f"2024-{d} 23:50:00", 1) for d in ("02-29", "03-01", "03-02")] + [("late", "2024-03-02 00:00:10", 1)], "request_id string, instant string, stop_id long").withColumn("instant", F.to_timestamp("instant"))
    got = {}
    for r in timetable.arrivals(asked, calls, departures).collect():
        got.setdefault(r.request_id, set()).add(r.departure - 86_350)
    assert got == {"02-29": {1, 2, 4}, "03-01": {0, 1, 4}, "03-02": {1, 3, 4}, "late": {0, 1, 4}}


def test_parts_and_letters(spark):
    """Joins by grams, words and letters find what comparing all pairs finds."""
    import itertools
    import random

    r = random.Random(4)
    names = ["".join(r.choice("abc ") for _ in range(r.randint(1, 9))).strip() or "a" for _ in range(60)]
    asks = ["".join(r.choice("abcz ") for _ in range(r.randint(1, 6))).strip() or "b" for _ in range(60)]
    q, n = spark.createDataFrame([(x,) for x in set(asks)], "q string"), spark.createDataFrame([(x,) for x in set(names)], "name_key string")
    pairs = list(itertools.product(set(asks), set(names)))
    got = {tuple(x) for x in name_index.containing(q.select(F.col("q").alias("part")), n.select(F.col("name_key").alias("whole"))).collect()}
    assert got == {(a, b) for a, b in pairs if a in b}
    assert {tuple(x) for x in name_index.sharing_words(q, n).collect()} == {(a, b) for a, b in pairs if set(a.split()) & set(b.split())}
    common = lambda a, b: sum(min(a.count(c), b.count(c)) for c in set(a))
    found = {tuple(x) for x in name_index.sharing_letters(q, n, 0.68).collect()}
    assert {(a, b) for a, b in pairs if 2 * common(a, b) >= 0.68 * (len(a) + len(b))} <= found < set(pairs)
    plan = names_search_plan(spark)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def names_search_plan(spark) -> str:
    known = spark.createDataFrame([(1, "14", "bus", 1)], "route_id int, code string, mode string, rank int")
    found = lines.line_search(spark.createDataFrame([("4",)], "query string"), known)
    return found._jdf.queryExecution().toString()
