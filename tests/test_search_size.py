"""The work of a search: ways are judged best first, and bounds by distance meet cells."""

import random

from pyspark.sql import functions as F

from headway.functions.geo import haversine
from headway.operators import rounds

CALLS = "pattern_id long, route_id int, tram boolean, position int, stop_id long, metres long, pickup boolean, dropoff boolean, days int"


def test_ways_are_judged_best_first(spark, monkeypatch):
    """Forty lines each way over one change, of which the short ones lead round about: they ride on past a destination. Only as many ways are judged as k answers need."""
    paths = {p: [1, 50, 9] if p < 12 else [1, 60 + p, 100] for p in range(40)} | {100 + p: [50, 8] if p < 12 else [60 + p, 8] for p in range(40)}
    calls = spark.createDataFrame([(p, p, False, i, s, (1000 + p % 100) * i, True, True, 127) for p, stops in paths.items() for i, s in enumerate(stops)], CALLS)
    edges = spark.createDataFrame([], "stop_id long, to_stop long, metres long")
    requests = spark.createDataFrame([(1, [1, 2], [8, 9]), (2, [1, 2], [8, 9]), (3, [1], [8])], "request_id int, origins array<long>, destinations array<long>")
    judged, judge = [], rounds.roundabouts

    def watched(ways, *more):
        judged.append(ways.count())
        return judge(ways, *more)

    monkeypatch.setattr(rounds, "roundabouts", watched)
    ask = lambda k: {tuple(x) for x in rounds.journeys(requests, calls, edges, k=k, modes=("fastest",), rides=2, width=None, sensible=True).collect()}
    every = ask(500)
    most, judged[:] = sum(judged), []
    assert ask(14) == {x for x in every if x[2] <= 14}
    assert 0 < sum(judged) < most
    judged.clear()
    assert ask(1) == {x for x in every if x[2] <= 1} and sum(judged) < most / 2


def test_round_about_ways_by_numbers_of_sets(spark):
    """The same ways are round-about whether their ends are given as arrays or as numbers of sets."""
    r = random.Random(4)
    calls = spark.createDataFrame([(p, p, False, i, s, 700 * i, r.random() > 0.1, r.random() > 0.1, 127) for p in range(9) for i, s in enumerate(r.choices(range(9), k=6))], CALLS)
    sets = [sorted(r.sample(range(9), n)) for n in (1, 2, 3, 4, 2, 1)]
    steps = [";".join(f"r:{r.randrange(9)}:{(b := r.randrange(5))}:{r.randrange(b + 1, 6)}" if r.random() > 0.2 else f"w:{r.randrange(9)}:{r.randrange(9)}:300" for _ in range(r.randrange(1, 4))) + ";" for _ in range(300)]
    ways = [(o, d, s) for s in steps for o, d in [r.sample(range(6), 2)]]
    numbered = spark.createDataFrame(ways, "origins long, destinations long, steps string")
    arrays = spark.createDataFrame([(sets[o], sets[d], s) for o, d, s in ways], "origins array<long>, destinations array<long>, steps string")
    members = spark.createDataFrame([(k, s) for k, stops in enumerate(sets) for s in stops], "set_id long, stop_id long")
    one = {(*map(tuple, (sets[x.origins], sets[x.destinations])), x.steps) for x in rounds.roundabouts(numbered, calls, members).collect()}
    other = {(tuple(x.origins), tuple(x.destinations), x.steps) for x in rounds.roundabouts(arrays, calls).collect()}
    assert one == other and 0 < len(one) < len(ways)


def test_cells_are_never_farther_than_their_points(spark):
    r = random.Random(1)
    spots = [(lat := r.uniform(-85, 85), r.uniform(-180, 180), lat + r.uniform(-0.06, 0.06), r.uniform(-0.06, 0.06)) for _ in range(3000)]
    frame = spark.createDataFrame([(a, b, c, (b + d + 180) % 360 - 180) for a, b, c, d in spots], "a double, b double, c double, d double")
    cell = lambda c: F.floor(F.col(c) / rounds.BLOCK)
    gap = lambda x: F.greatest(F.abs(x) - 1, F.lit(0))
    turn = F.pmod(cell("d") - cell("b") + 18000, F.lit(36000)) - 18000
    least = rounds.farther(gap(cell("c") - cell("a")), gap(turn), cell("a") * rounds.BLOCK)
    assert frame.where(least > haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")) + 0.001).count() == 0
    assert frame.where(least > 1000).count() > 500
