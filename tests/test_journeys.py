"""Journeys of small random networks against plain enumeration; round-abouts, similar rides and groups of journeys."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.functions import geo
from headway.operators import feed, grouped, rides, rounds, similar, summaries
from headway.operators.journeys import FEWEST, MODES

CALLS = "pattern_id long, route_id int, tram boolean, position int, stop_id long, metres long, pickup boolean, dropoff boolean, days int"


def network(seed):
    """(calls, edges): six patterns over seven stops, some loops, closed doors and sparse days."""
    r, calls = random.Random(seed), []
    for p in range(6):
        metres, tram, days = 0, p == 4, r.choice([127, 31, 96, 3])
        for i in range(r.randint(3, 5)):
            calls.append((p, p // 2 + 1 if p < 4 else p, tram, i, r.randrange(7), metres, r.random() < 0.85, r.random() < 0.85, days))
            metres += r.randint(200, 3000)
    edges = [(a, b, m) for a, b, m in ((0, 1, 150), (2, 3, 400), (5, 6, 90))]
    return calls, edges + [(b, a, m) for a, b, m in edges]


def every_journey(calls, edges, origins, destinations, mode, most):
    """(rides, lines, days, cost, walk, steps) of all journeys: a walk is never followed by another."""
    bus, tram_metre, on_foot, bonus, change = MODES[mode]
    by_stop, found = {}, []
    for c in calls:
        by_stop.setdefault(c[4], []).append(c)

    def go(stop, done, lines, days, cost, walk, steps, tram, walked):
        if stop in destinations and steps:
            found.append((done, lines, days, cost, walk, steps))
        if not walked:
            for a, b, m in edges:
                if a == stop:
                    go(b, done, lines, days, cost + m * on_foot, walk + m, steps + f"w:{a}:{b}:{m};", tram, True)
        if done == most:
            return
        for p, line, is_tram, i, _, at, pickup, _, runs in by_stop.get(stop, ()):
            if not pickup or f"-{line}-" in lines or not days & runs:
                continue
            for q, _, _, j, out, to, _, dropoff, _ in calls:
                if q == p and j > i and dropoff:
                    ride = 200_000 + 10_000 * (j - i) + max(0, to - at) * (tram_metre if is_tram else bus) - (bonus if is_tram and not tram else 0) + (change if done else 0)
                    go(out, done + 1, lines + f"{line}-", days & runs, cost + ride, walk, steps + f"r:{p}:{i}:{j};", tram or is_tram, False)

    for o in origins:
        go(o, 0, "-", 127, 0, 0, "", False, False)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_every_journey(spark, seed):
    calls, edges = network(seed)
    asked = [(k, [a], [b]) for k, (a, b) in enumerate(itertools.permutations(range(7), 2)) if k % 3 == 0] + [(100, [0, 2], [5, 6]), (101, [0, 1], [1, 4])]
    frame = spark.createDataFrame
    requests = frame(asked, "request_id long, origins array<long>, destinations array<long>")
    out = rounds.journeys(requests, frame(calls, CALLS), frame(edges, "stop_id long, to_stop long, metres long"), rides=3, width=None).collect()
    got = {}
    for r in out:
        got.setdefault((r.request_id, r.mode), []).append((r.rank, r.rides, r.lines, r.cost, r.walk))
    some = 0
    for request, origins, destinations in asked:
        for mode in MODES:
            best = {}
            for done, lines, _, cost, walk, _ in every_journey(calls, edges, origins, destinations, mode, 3) if not set(origins) & set(destinations) else []:
                best[lines] = min(best.get(lines, (cost, walk, done)), (cost, walk, done))
            order = sorted(((max(n - 1, 0) if mode == FEWEST else 0, cost, max(n - 1, 0), walk, lines, n) for lines, (cost, walk, n) in best.items()))[:3]
            want = [(k + 1, n, lines, cost / 40_000, walk) for k, (_, cost, _, walk, lines, n) in enumerate(order)]
            assert sorted(got.get((request, mode), [])) == want
            some += len(want)
    assert some > 50
    pruned = rounds.journeys(requests, frame(calls, CALLS), frame(edges, "stop_id long, to_stop long, metres long"), rides=3)
    assert {tuple(r) for r in pruned.select("request_id", "mode", "rank", "lines", "cost").collect()} == {(r.request_id, r.mode, r.rank, r.lines, r.cost) for r in out}


def is_roundabout(steps, calls, origins, destinations):
    at = {(c[0], c[3]): c for c in calls}
    parts = [s.split(":") for s in steps.rstrip(";").split(";")]
    stops, reached = [], [0]
    for kind, *v in parts:
        x, y, z = map(int, v)
        stops = stops or [x if kind == "w" else at[x, y][4]]
        stops.append(y if kind == "w" else at[x, z][4])
        reached.append(reached[-1] + (z if kind == "w" else max(0, at[x, z][5] - at[x, y][5])))
    if len(set(stops)) < len(stops):
        return True
    for k, (kind, *v) in enumerate(parts):
        if kind == "w":
            continue
        p, board = int(v[0]), int(v[1])
        later = {d: reached[-1] for d in destinations} | {stops[i]: reached[i] for i in range(k + 2, len(stops))}
        earlier = {o: 0 for o in origins} | {stops[i]: reached[i] for i in range(k)}
        for (q, j), c in at.items():
            ride = abs(c[5] - at[p, board][5])
            if q == p and k + 1 < len(parts) and j > board and c[7] and c[4] in later and ride <= (later[c[4]] - reached[k]) * 1.3 + 300:
                return True
            if q == p and k and j < board and c[6] and c[4] in earlier and ride <= (reached[k] - earlier[c[4]]) * 1.3 + 300:
                return True
    return False


def test_roundabouts(spark):
    ways, want = [], set()
    calls, edges = network(3)
    for a, b in [([0], [3]), ([1, 2], [5]), ([4], [0, 6]), ([6], [2]), ([3], [1])]:
        some = {s for *_, s in every_journey(calls, edges, a, b, "fastest", 2)}
        ways += [(a, b, s) for s in some]
        want |= {(tuple(a), tuple(b), s) for s in some if is_roundabout(s, calls, a, b)}
    frame = spark.createDataFrame(ways, "origins array<long>, destinations array<long>, steps string")
    got = {(tuple(r.origins), tuple(r.destinations), r.steps) for r in rounds.roundabouts(frame, spark.createDataFrame(calls, CALLS)).collect()}
    assert got == want and 0 < len(want) < len(ways)


def test_legs_and_summary(spark):
    """A walk of 80 m, a ride of 1,000 m and one hop, a walk of 160 m: 11.25 minutes, shown as 12."""
    calls = spark.createDataFrame([(0, 5, False, 0, 1, 0, True, True, 31), (0, 5, False, 1, 2, 1000, True, True, 31)], CALLS)
    ways = spark.createDataFrame([(1, 1, "w:9:1:80;r:0:0:1;w:2:8:160;", 31)], "request_id int, rank int, steps string, days int")
    legs = summaries.timed_legs(rounds.legs(ways, calls, "request_id", "rank"), "request_id", "rank")
    assert [(r.leg, r.walking, r.board_stop, r.alight_stop, r.reach_ticks) for r in legs.orderBy("leg").collect()] == [(0, True, 9, 1, 0), (1, False, 1, 2, 2000), (2, True, 2, 8, 18_500)]
    s = summaries.summaries(ways, legs, "request_id", "rank").first()
    assert (s.minutes, s.transfers, s.is_direct, s.metres, s.walk_metres, s.combination, s.day_names) == (12, 0, True, 1240, 240, "5", "Monday, Tuesday, Wednesday, Thursday, Friday")
    bad = spark.createDataFrame([(1, 1, "w:9:1:80;r:0:1:0;", 0)], "request_id int, rank int, steps string, days int")
    found = summaries.broken(bad, rounds.legs(bad, calls, "request_id", "rank"), "request_id", "rank")
    assert {r.rule for r in found.collect()} == {"meet", "days", "order"}


def test_common_stops_in_order():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randint(0, 7))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) if any(is_part(c, b) for c in itertools.combinations(a, n)))
        assert similar.common_in_order(a, b) == best


def is_part(some, of):
    rest = iter(of)
    return all(x in rest for x in some)


def test_similar_rides_and_groups(spark):
    """Ride 1 has the stops of 0; 2 leaves one out; 3 has other stops on the same street; 4 goes another way; 5 is a tram."""
    paths = {0: [1, 2, 3, 4], 1: [9, 1, 2, 3, 4], 2: [1, 2, 4], 3: [1, 7, 8, 4], 4: [1, 6, 4], 5: [1, 2, 3, 4]}
    calls = spark.createDataFrame([(p, p, p == 5, i, s, 1000 * i, True, True, 127) for p, stops in paths.items() for i, s in enumerate(stops)], CALLS)
    legs = [(p, stops.index(1), stops.index(4)) for p, stops in paths.items()]
    line = [(p, 1000.0 * i, 40 + 0.01 * i, 30.0 + (0.01 * i * (3 - i) if p == 4 else 0)) for p in (0, 3, 4) for i in range(4)]
    usable = [(p, i, 1000.0 * i * (1 if p != 4 else 1.5)) for p in (0, 3, 4) for i in range(len(paths[p]))]
    frame = spark.createDataFrame
    maps = frame(line, "pattern_id long, metres double, lat double, lon double"), frame(usable, "pattern_id long, position int, metres double")
    pairs = similar.similar_rides(frame(legs, "pattern_id long, board int, alight int"), calls, *maps)
    assert {(r.pattern_id, r.other) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2), (0, 3)}
    steps = [(7, 1, "w:9:1:50;r:0:0:3;"), (7, 2, "w:9:1:50;r:4:0:2;"), (7, 3, "w:9:1:50;r:1:1:4;"), (7, 4, "r:2:0:2;"), (7, 5, "w:9:1:50;r:2:0:2;")]
    ways = frame(steps, "request_id int, rank int, steps string")
    each = rounds.legs(ways, calls, "request_id", "rank")
    facts = similar.ride_facts(each.where("not walking"), calls, *maps)
    assert {(r.rank, r.anchor) for r in similar.first_groups(each, facts, 5, "request_id").collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 1)}


def test_equal_rides_are_a_class(spark):
    """Thirty equal rides give a link each, no pairs; the one that is alike is linked with the first of them."""
    paths = {p: [1, 2, 3, 4] for p in range(30)} | {30: [1, 2, 4], 31: [1, 9, 4]}
    frame = spark.createDataFrame
    calls = frame([(p, p, False, i, s, 1000 * i, True, True, 127) for p, stops in paths.items() for i, s in enumerate(stops)], CALLS)
    none = frame([], "pattern_id long, metres double, lat double, lon double"), frame([], "pattern_id long, position int, metres double")
    found = similar.similar_rides(frame([(p, 0, len(s) - 1) for p, s in paths.items()], "pattern_id long, board int, alight int"), calls, *none)
    assert {(r.pattern_id, r.other) for r in found.collect()} == {(0, p) for p in range(1, 31)}


def replayed(calls, edges, origins, destinations, mode, most):
    """All arrivals at destinations of a search that keeps the cheapest way to each stop by the same lines on the same days."""
    bus, tram_metre, on_foot, bonus, change = MODES[mode]
    offers = []

    def walks(ways):
        return [(b, (lines, days), (cost + m * on_foot, walk + m, steps + f"w:{a}:{b}:{m};", tram)) for (stop, lines, days), (cost, walk, steps, tram) in ways for a, b, m in edges if a == stop]

    def least(rows):
        out = {}
        for stop, key, way in rows:
            at = (stop, *key)
            out[at] = min(out.get(at, way), way)
        return out

    start = [(o, ("-", 127), (0, 0, "", False)) for o in origins]
    on_foot_first = walks([((o, *key), way) for o, key, way in start])
    offers += [(0, stop, key, way) for stop, key, way in on_foot_first]
    ways = least(start + on_foot_first)
    for done in range(most):
        by_pattern = {}
        for (stop, lines, days), (cost, walk, steps, tram) in ways.items():
            for p, line, is_tram, i, at_stop, at, pickup, _, runs in calls:
                if at_stop != stop or not pickup or f"-{line}-" in lines or not days & runs:
                    continue
                for q, _, _, j, out, to, _, dropoff, _ in calls:
                    if q == p and j > i and dropoff:
                        c = cost + 200_000 + 10_000 * (j - i) + max(0, to - at) * (tram_metre if is_tram else bus) - (bonus if is_tram and not tram else 0) + (change if done else 0)
                        key, way = (p, out, lines + f"{line}-", days & runs), (c, walk, steps + f"r:{p}:{i}:{j};", tram or is_tram)
                        by_pattern[key] = min(by_pattern.get(key, way), way)
        rode = [(out, (lines, days), way) for (_, out, lines, days), way in by_pattern.items()]
        offers += [(done + 1, stop, key, way) for stop, key, way in rode + walks([((stop, *key), way) for stop, key, way in rode])]
        kept = least(rode)
        ways = least([(k[0], k[1:], w) for k, w in kept.items()] + walks(list(kept.items())))
    return [(n, key, way) for n, stop, key, way in offers if stop in destinations]


@pytest.mark.parametrize("seed", [4, 11])
def test_search_without_roundabouts(spark, seed):
    """Each arrival is judged before the best of its lines is taken, as in a plain replay; bounds change nothing."""
    calls, edges = network(seed)
    asked = [(k, [a], [b]) for k, (a, b) in enumerate(itertools.permutations(range(7), 2)) if k % 5 == 0] + [(100, [0, 2], [5, 6])]
    frame = spark.createDataFrame
    tables = frame(asked, "request_id long, origins array<long>, destinations array<long>"), frame(calls, CALLS), frame(edges, "stop_id long, to_stop long, metres long")
    modes = ("fastest", FEWEST, "prefer_tram")
    got = {}
    for r in rounds.journeys(*tables, k=2, modes=modes, rides=3, width=None, sensible=True).collect():
        got.setdefault((r.request_id, r.mode), []).append((r.rank, r.rides, r.lines, r.cost, r.walk))
    hidden = 0
    for request, origins, destinations in asked:
        for mode in modes:
            best, first = {}, {}
            for n, (lines, days), (cost, walk, steps, _) in replayed(calls, edges, origins, destinations, mode, 3):
                first[lines] = min(first.get(lines, (cost, walk, days, steps)), (cost, walk, days, steps))
                if not is_roundabout(steps, calls, origins, destinations):
                    best[lines] = min(best.get(lines, (cost, walk, days, steps, n)), (cost, walk, days, steps, n))
            hidden += sum(is_roundabout(first[lines][3], calls, origins, destinations) for lines in best)
            order = sorted((max(n - 1, 0) if mode == FEWEST else 0, cost, max(n - 1, 0), walk, lines, n) for lines, (cost, walk, _, _, n) in best.items())[:2]
            assert sorted(got.get((request, mode), [])) == [(k + 1, n, lines, cost / 40_000, walk) for k, (_, cost, _, walk, lines, n) in enumerate(order)]
    assert hidden > 0


def test_bounds_by_distance(spark):
    """The same answers with straight lines as bounds, from fewer ways."""
    r, frame = random.Random(8), spark.createDataFrame
    stops = frame([(s, 40.7 + 0.01 * (s % 6), 29.8 + 0.01 * (s // 6)) for s in range(36)], "stop_id long, lat double, lon double")
    lines = [(p, p, p % 4 == 0, i, s) for p in range(14) for i, s in enumerate(r.sample(range(36), 7))]
    chain = geo.chain_metres(frame(lines, "pattern_id long, route_id int, tram boolean, position int, stop_id long"), stops)
    calls = chain.withColumns({"pickup": F.lit(True), "dropoff": F.lit(True), "days": F.lit(127)})
    requests = frame([(k, [r.randrange(18)], [18 + r.randrange(18)]) for k in range(12)], "request_id long, origins array<long>, destinations array<long>")
    ask = lambda **more: {tuple(x) for x in rounds.journeys(requests, calls, geo.walking_edges(stops), k=2, rides=3, width=None, **more).collect()}
    want = ask(bounded=False)
    assert ask(stops=stops) == want and len(want) > 60
    modes, pairs = ["fastest"], requests.select("origins", "destinations")
    ways = frame([("fastest", [x], s, "-", 127, 10_000_000, 0, "", False) for s in range(36) for x in range(18)], "mode string, origins array<long>, stop_id long, lines string, days int, cost long, walk long, steps string, tram boolean")
    answers = pairs.select(F.lit("fastest").alias("mode"), "origins", "destinations", F.lit(10_400_000).cast("long").alias("cost"))
    still = rounds.budgets(answers, pairs.distinct(), modes, 1, 1)
    assert 0 < rounds.hopeful(ways, still, stops).count() < rounds.hopeful(ways, still, None).count()


def test_k_counts_groups(spark):
    """Thirty equal lines and one by another way: the second group is the other way, though thirty lines rank before it."""
    paths = {p: [1, 2, 3] for p in range(30)} | {30: [1, 8, 9, 3]}
    frame = spark.createDataFrame
    calls = frame([(p, p, False, i, s, 1000 * i, True, True, 127) for p, stops in paths.items() for i, s in enumerate(stops)], CALLS)
    edges = frame([], "stop_id long, to_stop long, metres long")
    none = frame([], "pattern_id long, metres double, lat double, lon double"), frame([], "pattern_id long, position int, metres double")
    requests = frame([(1, [1], [3]), (2, [1], [3]), (3, [3], [1])], "request_id int, origins array<long>, destinations array<long>")
    got = grouped.grouped_journeys(requests, calls, edges, *none, k=2, modes=("fastest",), rides=2).collect()
    assert {(r.request_id, r.group, r.rank, r.anchor) for r in got} == {(q, *x) for q in (1, 2) for x in [*((1, k, 1) for k in range(1, 31)), (2, 31, 31)]}


def test_equal_and_unequal_paths():
    straight = np.array([[0, 40, 30], [1000, 40.009, 30]])
    assert similar.paths_agree(straight, straight + [0, 0, 0.0003], 0, 1000, 0, 1000) and not similar.paths_agree(straight, straight + [0, 0, 0.0006], 0, 1000, 0, 1000)
    assert not similar.paths_agree(straight, straight, 0, 1000, 0, 900) and not similar.paths_agree(straight, straight, 0, 0, 0, 0)


def test_feed_from_texts(spark):
    frame = spark.createDataFrame
    days = ", ".join(f"{d} string" for d in feed.DAYS)
    rows = [("a", "1", "0", "", "1", " 1", "1", "1", "20240101", ""), ("b", *"0000000", "20240231", "x")]
    got = feed.calendars(frame(rows, f"service_id string, {days}, start_date string, end_date string")).collect()
    assert [(r.days, str(r.start_date), r.end_date) for r in got] == [(1 + 8 + 32 + 64, "2024-01-01", None), (0, "None", None)]
    on = feed.services_on(frame([("2023-12-30",), ("2024-01-06",), ("2024-01-09",)], "d string").select(F.to_date("d").alias("day")), feed.calendars(frame(rows, f"service_id string, {days}, start_date string, end_date string")))
    assert [(str(r.day), r.service_id) for r in on.collect()] == [("2024-01-06", "a")]
    clocks = {"8:5:7": "08:05:07", "24:15:00": "24:15:00", "24:70:00": None, "100:00:00": None, "8:00": None, "": None, "a:b:c": None, "-1:00:00": None}
    assert {r.t: r.c for r in frame([(t,) for t in clocks], "t string").select("t", feed.clock_of(F.col("t")).alias("c")).collect()} == clocks
    times = frame([(1, "2", 5, "07:00:00"), (1, "1", 9, "06:00:00"), (1, "1", 3, "5:00:00"), (2, "1", 1, None)], "trip_id int, stop_sequence string, ordinal int, departure_time string")
    assert {(r.trip_id, r.departure) for r in feed.first_departures(times).collect()} == {(1, "05:00:00"), (2, None)}
    lines = frame([("r1", "", "Long", "900", "C1"), (" ", "x", "", "3", ""), ("r2", " 5 ", "", "", ""), ("r3", "7", "", "1", "")], "route_id string, route_short_name string, route_long_name string, route_type string, route_code string")
    typed = feed.routes(lines)
    assert {(r.route_id, r.code, r.public_code, r.mode) for r in typed.collect()} == {("r1", "C1", "C1", "tram"), ("r2", "5", "5", "bus"), ("r3", "7", "7", "bus")}
    assert {r.route_id for r in feed.public_transport(typed).collect()} == {"r1", "r2"}
    spots = frame([("b", "B", "x", "1"), ("a10", "A", "2", "3"), ("a9", "C", "", "")], "stop_id string, stop_name string, stop_lat string, stop_lon string")
    assert [(r.id, r.stop_id, r.lat) for r in feed.stops(spots).orderBy("id").collect()] == [(0, "a10", 2.0), (1, "a9", None), (2, "b", None)]


def test_permissions_of_direct_rides(spark):
    calls = spark.createDataFrame([(0, 5, False, i, i, 1000 * i, i > 0, i < 2, 127) for i in range(4)], CALLS)
    asked = spark.createDataFrame([(1, 0, 2), (2, 1, 2), (3, 0, 1), (4, 0, 3)], "request_id int, origin long, destination long")
    assert rides.direct_rides(asked, calls).count() == 0
    assert [r.request_id for r in rides.direct_rides(asked, calls.withColumn("dropoff", F.lit(True))).collect()] == [2]
