"""The board of a name, against plain Python."""

from datetime import date, datetime, timedelta

import pytest

from headway.operators import timetable

STOPS = "stop_id long, name string"
CALLS = "pattern_id long, route_id int, tram boolean, days int, position int, stop_id long, metres long, pickup boolean, dropoff boolean"
SPEED = {"city": (16, 23), "district": (25, 35), "tram": (25, 25)}


def plain_board(requests, stops, calls, departures, limit):
    found = {}
    for rid, instant, name in requests:
        now = instant.hour * 3600 + instant.minute * 60 + instant.second
        for platform in {s for s, n in stops if n.strip().lower() == name.lower() and name != "?"}:
            for pattern, route, tram, _, position, stop, metres, pickup, _ in calls:
                own = sorted((c[4], c[6]) for c in calls if c[0] == pattern)
                if stop != platform or not pickup or position == own[-1][0]:
                    continue
                kind = "tram" if tram else "district" if (own[-1][1] - own[0][1]) / (len(own) - 1) >= 600 else "city"
                for p, days, departure, *span in departures:
                    for back in (0, 1):
                        day = instant.date() - timedelta(back)
                        if p != pattern or not days >> day.weekday() & 1 or span and not ((span[0] or day) <= day <= (span[1] or day)):
                            continue
                        start, s = day.weekday() + departure // 86400, departure % 86400
                        rush = start % 7 < 5 and (25200 <= s < 34200 or 59400 <= s < 70200)
                        speed = SPEED[kind][0 if rush else 1]
                        wait = departure + metres * 36 // (speed * 10) - now - 86400 * back
                        if 0 <= wait <= 3600:
                            gone = now + 86400 * back - departure
                            passed = min(sum(m <= gone * speed * 10 // 36 for _, m in own) - 1, len(own) - 2)
                            row = (platform, route, pattern, round(wait / 60), position - passed if gone >= 0 else None, -gone if gone < 0 else None, gone >= 0 and round(wait / 60) <= 10)
                            found.setdefault(rid, {})[wait, route, pattern, back, departure, platform, position, gone] = row
    return sorted((rid, k + 1, *rows[key]) for rid, rows in found.items() for k, key in enumerate(sorted(rows)[:limit]))


def small_feed():
    stops = [(1, "Old Market"), (2, "OLD market "), (3, "Harbour"), (4, "?"), (5, "Mill"), (6, "Harbour")]
    calls = []
    for pattern, (route, tram, at) in enumerate([(7, False, [1, 3, 2, 5]), (8, True, [2, 6, 3]), (9, False, [3, 1, 3, 4, 1])]):
        calls += [(pattern, route, tram, 127, k, s, k * (300, 900, 250)[pattern], (pattern + k) % 4 != 3, True) for k, s in enumerate(at)]
    departures = [(p, days, t * 311 % 100_000) for p in range(3) for days in (31, 32, 127) for t in range(p, 320, 2)] + [(0, 127, 86_395), (1, 64, 0), (1, 31, 25_199), (1, 127, 25_200)]
    first = datetime(2024, 1, 5)
    requests = [(k, first + timedelta(minutes=47 * k, seconds=13 * k), ("Old Market", "harbour", "mill", "?", "nowhere")[k % 5]) for k in range(150)]
    return stops, calls, departures, requests + [(900, datetime(2024, 1, 6, 23, 59, 59), "Harbour"), (901, datetime(2024, 1, 7), "Harbour")]


@pytest.mark.parametrize("rows", [7, 50_000])
def test_board_is_that_of_plain_python(spark, monkeypatch, rows):
    """No row of a request is made but those of its board: requests meet no departures in a join, and no window ranks them. Batches of any size."""
    monkeypatch.setattr(timetable, "ROWS", rows)
    monkeypatch.setattr(timetable, "ASKS", 3)
    stops, calls, departures, requests = small_feed()
    got = timetable.name_board(
        spark.createDataFrame(requests, "request_id long, instant timestamp_ntz, name string"), spark.createDataFrame(stops, STOPS), spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(departures, "pattern_id long, days int, departure long"), 5,
    )
    assert sorted(map(tuple, got.collect())) == plain_board(requests, stops, calls, departures, 5)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_requests_of_one_id_share_a_board(spark):
    stops, calls, departures, requests = small_feed()
    requests = [(k // 3, at, name) for k, at, name in requests] + requests[:4] + [(0, requests[0][1] + timedelta(7), "Old Market")]
    got = timetable.name_board(
        spark.createDataFrame(requests, "request_id long, instant timestamp_ntz, name string"), spark.createDataFrame(stops, STOPS), spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(departures, "pattern_id long, days int, departure long"), 60,
    )
    assert sorted(map(tuple, got.collect())) == plain_board(requests, stops, calls, departures, 60)


def test_board_of_departures_with_dates(spark):
    stops, calls, departures, requests = small_feed()
    spans = [(None, None), (date(2024, 1, 6), None), (date(2024, 1, 4), date(2024, 1, 7)), (date(2023, 1, 1), date(2023, 2, 1)), (None, date(2024, 1, 6))]
    dated = [(*d, *spans[k % 5]) for k, d in enumerate(departures)] + [(*d, *spans[0]) for d in departures[::3]]
    got = timetable.name_board(
        spark.createDataFrame(requests, "request_id long, instant timestamp_ntz, name string"), spark.createDataFrame(stops, STOPS), spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(dated, "pattern_id long, days int, departure long, start_date date, end_date date"), 9,
    )
    assert sorted(map(tuple, got.collect())) == plain_board(requests, stops, calls, dated, 9)
