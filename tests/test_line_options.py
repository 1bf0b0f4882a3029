"""Lines for a leg and their next vehicles against a plain replay."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from math import ceil

from headway.functions import clock
from headway.operators import line_options
from headway.operators.similar import common_in_order
from pyspark.sql import functions as F

MIDDLES = [[2, 3, 4, 5], [2, 3, 4, 5], [2, 3, 4, 5, 6], [2, 7, 4, 5], [8, 9], [2, 3, 4, 5, 2], [2, 3]]


def network(seed):
    """pattern -> (route, tram, days, stops, pickups, dropoffs); some lines have two patterns, some permissions are missing."""
    r = random.Random(seed)
    out = {}
    for p in range(16):
        stops = [*r.choice([[], [0]]), 1, *r.choice(MIDDLES), 10, *r.choice([[], [11]])]
        out[p] = (p // 2 if p % 3 else p, p % 7 == 3, r.choice([31, 96, 127, 64]), stops, [r.random() < 0.9 for _ in stops], [r.random() < 0.9 for _ in stops])
    return out


def same_way(x, y):
    loop = lambda s: sorted(v for v in s if s.count(v) > 1)
    if x == y:
        return True
    n = common_in_order(x, y)
    return loop(x) == loop(y) and (n >= 3 and n == min(len(x), len(y)) or n / max(len(x), len(y)) >= 0.9)


def plain_options(net, leg):
    """code -> rides (pattern, board, alight) of a leg (pattern, board, alight, days), for lines that run on all days."""
    p, board, alight, days = leg
    own = net[p][3][board : alight + 1]
    found = defaultdict(set)
    for q, (route, tram, _, stops, pickups, dropoffs) in net.items():
        for i in range(len(stops)):
            for j in range(i + 1, len(stops)):
                if tram == net[p][1] and stops[i] == own[0] and stops[j] == own[-1] and pickups[i] and dropoffs[j] and same_way(own, stops[i : j + 1]):
                    found[f"L{route}"].add((q, i, j))
    runs = {code: 0 for code in found}
    for code, rides in found.items():
        for q, _, _ in rides:
            runs[code] |= net[q][2]
    return {code: rides for code, rides in found.items() if runs[code] & days == days}


def test_options_and_arrivals(spark):
    frame = spark.createDataFrame
    for seed in (1, 6):
        net, r = network(seed), random.Random(seed)
        rows = [(p, route, tram, days, i, s, 700 * i, pickups[i], dropoffs[i]) for p, (route, tram, days, stops, pickups, dropoffs) in net.items() for i, s in enumerate(stops)]
        calls = frame(rows, "pattern_id long, route_id int, tram boolean, days int, position int, stop_id long, metres long, pickup boolean, dropoff boolean")
        codes = frame([(k, f"L{k}") for k in range(20)], "route_id int, code string")
        rides = [(p, v[3].index(1), v[3].index(10), r.choice([v[2], v[2] & 64 or v[2]])) for p, v in net.items()]
        start = datetime(2024, 3, 1, 23, 20, 7)
        legs = [(k, 1, n, start + timedelta(hours=5 * k), 2000 * 7 * k + 33 * n, *rides[(k + n) % len(rides)], 1) for k in range(6) for n in range(3)]
        legs += [(0, 1, 9, start, 0, None, None, None, 127, 1)]
        told = frame(legs, "request_id long, rank int, leg int, instant timestamp, reach_ticks long, pattern_id long, board int, alight int, days int, board_stop long")
        none = frame([], "pattern_id long, metres double, lat double, lon double"), frame([], "pattern_id long, position int, metres double")
        options = line_options.line_options(told, calls, codes, *none).cache()
        got = defaultdict(lambda: defaultdict(set))
        for o in options.collect():
            got[o.pattern_id, o.board, o.alight, o.days][o.place, o.code].add((o.other, o.other_board, o.other_alight))
        want = {}
        for leg in {x[5:9] for x in legs if x[5] is not None}:
            found, own = plain_options(net, leg), f"L{net[leg[0]][0]}"
            if found:
                want[leg] = {(n, code): found[code] for n, code in enumerate(sorted(found, key=lambda c: (c != own, c)), 1)}
        assert got == want and any(len(v) > 1 for v in want.values())

        departures = [(p, 127, r.randrange(0, 100_000)) for p in net for _ in range(150)]
        kinds = {k.pattern_id: k.kind for k in line_options_kinds(calls)}
        speed = {(x.kind, x.rush): x.v for x in frame([(k, b) for k in ("tram", "city", "district") for b in (True, False)], "kind string, rush boolean").select("*", clock.speed_kmh(F.col("kind"), F.col("rush")).alias("v")).collect()}
        expected = {}
        for k, rank, n, instant, ticks, p, board, alight, days, _ in legs:
            found = set()
            for code, some in (plain_options(net, (p, board, alight, days)) if p is not None else {}).items():
                reach = instant + timedelta(seconds=ceil(ticks * 60 / 2000))
                for q, i, _ in some:
                    for pattern, _, t in departures:
                        for back in (0, 1):
                            day = datetime(reach.year, reach.month, reach.day) - timedelta(days=back)
                            runs_at = day + timedelta(seconds=t)
                            s = t % 86_400
                            rush = runs_at.weekday() < 5 and (25_200 <= s < 34_200 or 59_400 <= s < 70_200)
                            at = runs_at + timedelta(seconds=int(700 * i * 36 // (speed[kinds[q], rush] * 10)))
                            if pattern == q and reach <= at <= reach + timedelta(hours=1):
                                found.add((at.replace(second=0), code))
            for place, (at, code) in enumerate(sorted(found)[:3], 1):
                expected[k, rank, n, place] = (code, at, max(0, ceil((at - instant).total_seconds() / 60)))
        runs = frame(departures, "pattern_id long, days int, departure long")
        result = line_options.upcoming(told, options, calls, runs, "request_id", "rank").collect()
        assert {(x.request_id, x["rank"], x.leg, x.place): (x.code, x["at"], x.minutes) for x in result} == expected and expected
        assert line_options.line_options(told.limit(0), calls, codes, *none).count() == 0


def line_options_kinds(calls):
    from headway.operators.timetable import line_kinds

    return line_kinds(calls).collect()
