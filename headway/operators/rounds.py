"""Journeys of up to four rides, searched in rounds from all requested origins at once, in four modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.durable import durable
from headway.functions.geo import DIAMETER
from headway.operators.journeys import FEWEST, MODES, UNITS
from headway.operators.rides import DWELL, WAIT, alightings, boardings

RIDES, ALL_DAYS = 4, 127
KEYS = ["mode", "origins", "stop_id", "lines", "days"]
#: A ride on past where one left it is a shortcut if it is at most so many times the journey's metres, and so many more.
DETOUR, SLACK = 1.3, 300
#: Of a straight line so much, less so many metres, is never more than the whole metres of a journey.
DIRECT, NEAR = 0.98, 100
#: Cells of so many degrees in which stops count as one for bounds by distance, and cells around one that are told apart.
BLOCK, RING = 0.01, 5


def width_for(k: int) -> int:
    """Ways to reach a stop that go on to the next round, for ``k`` answers (fixed values)."""
    return max(10, min(2 * k, 20))


def by_mode(of: int) -> Column:
    """Entry ``of`` of the row's mode in MODES."""
    return F.create_map(*(F.lit(x) for name, v in MODES.items() for x in (name, v[of])))[F.col("mode")].cast("long")


def text(c: str) -> Column:
    return F.col(c).cast("string")


def best_ways(ways: DataFrame, *more: str) -> DataFrame:
    """The cheapest of the ways that reach a stop by the same lines on the same days (and with the same ``more``)."""
    best = F.min(F.struct("cost", "walk", "steps", "tram")).alias("best")
    return ways.groupBy(*KEYS, *more).agg(best).select(*KEYS, *more, "best.*")


def best_of_stop(ways: DataFrame, width: int | None) -> DataFrame:
    if width is None:
        return ways
    place = F.row_number().over(Window.partitionBy("mode", "origins", "stop_id").orderBy("cost", "walk", "lines", "days"))
    return ways.withColumn("place", place).where(F.col("place") <= width).drop("place")


def walked(ways: DataFrame, edges: DataFrame) -> DataFrame:
    """Where one walk leads from where the ways end."""
    step = F.concat_ws(":", F.lit("w"), text("stop_id"), text("to_stop"), text("metres"))
    return ways.join(edges.select("stop_id", "to_stop", "metres"), "stop_id").select(
        "mode", "origins", F.col("to_stop").alias("stop_id"), "lines", "days", (F.col("cost") + F.col("metres") * by_mode(2)).alias("cost"), (F.col("walk") + F.col("metres")).alias("walk"),
        F.concat("steps", step, F.lit(";")).alias("steps"), "tram",
    )


def ridden(ways: DataFrame, calls: DataFrame, first: bool) -> DataFrame:
    """Where one more ride leads, on a line not used before and on days that all rides share: the cheapest way by each pattern."""
    on = boardings(calls, route_id="route_id", tram="by_tram", stop_id="stop_id", position="board", metres="a", days="runs")
    off = alightings(calls, stop_id="out", position="alight", metres="b")
    aboard = ways.join(on, "stop_id").withColumn("days", F.col("days").bitwiseAND(F.col("runs"))).where("days <> 0")
    aboard = aboard.where(~F.col("lines").contains(F.concat(F.lit("-"), text("route_id"), F.lit("-"))))
    bonus = F.when(F.col("by_tram") & ~F.col("tram"), by_mode(3)).otherwise(0)
    aboard = aboard.withColumn("cost", F.col("cost") + 20 * WAIT - bonus + (0 if first else by_mode(4)))
    met = aboard.join(off, "pattern_id").where("alight > board")
    ride = 20 * DWELL * (F.col("alight") - F.col("board")) + F.greatest(F.col("b") - F.col("a"), F.lit(0)) * F.when(F.col("by_tram"), by_mode(1)).otherwise(by_mode(0))
    step = F.concat_ws(":", F.lit("r"), text("pattern_id"), text("board"), text("alight"))
    return best_ways(met.select(
        "mode", "origins", "pattern_id", F.col("out").alias("stop_id"), F.concat("lines", text("route_id"), F.lit("-")).alias("lines"), "days",
        (F.col("cost") + ride).alias("cost"), "walk", F.concat("steps", step, F.lit(";")).alias("steps"), (F.col("tram") | F.col("by_tram")).alias("tram"),
    ), "pattern_id")


ANSWER = ["mode", "origins", "destinations"]


def ranks() -> list[Column]:
    """The order of answers of a mode and pair of ends."""
    changes = F.greatest(F.col("rides") - 1, F.lit(0))
    return [F.when(F.col("mode") == FEWEST, changes).otherwise(0), F.col("cost"), changes, F.col("walk"), F.col("lines")]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best combinations of lines of each mode and pair of sets of ends, each with its best way, and their rank."""
    group = [*ANSWER, "rides", "lines"]
    best = found.groupBy(*group).agg(F.min(F.struct("cost", "walk", "days", "steps")).alias("best")).select(*group, "best.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*ANSWER).orderBy(*ranks()))).where(F.col("rank") <= k)


def budgets(answers: DataFrame, pairs: DataFrame, modes: list[str], k: int, done: int) -> DataFrame:
    """mode, origins, destinations, budget of the pairs that a further ride can still improve: the cost of the kth answer; null
    where there are fewer. With changes first, later rounds are never better than k answers of earlier ones."""
    held = answers.groupBy(*ANSWER).agg(F.count("*").alias("n"), F.max("cost").alias("budget"))
    every = pairs.select(F.explode(F.array(*map(F.lit, modes))).alias("mode"), "origins", "destinations").join(held, ANSWER, "left")
    full, by_changes = F.coalesce(F.col("n") == k, F.lit(False)), F.col("mode") == FEWEST
    closed = full & by_changes & F.lit(done > 0)
    return every.where(~closed).select(*ANSWER, F.when(full & ~by_changes, F.col("budget")).alias("budget"))


def members(pairs: DataFrame, end: str, name: str, sets: DataFrame | None) -> DataFrame:
    """``pairs`` with a row for each stop ``name`` of the set in their column ``end``: an array of stops or, if there are ``sets`` (set_id,
    stop_id), its number there."""
    if sets is None:
        return pairs.withColumn(name, F.explode(end))
    return pairs.join(sets.select(F.col("set_id").alias(end), F.col("stop_id").alias(name)), end)


def farther(rows: Column | int, columns: Column | int, lat: Column) -> Column:
    """Metres that two points at most are apart at least, if so many whole cells lie between them, at latitudes of up to RING + 2 cells beyond ``lat``."""
    half = lambda n: F.pow(F.sin(F.radians(F.lit(BLOCK) * n) / 2), 2)
    high = F.least(F.abs(lat) + (RING + 2) * BLOCK, F.lit(90.0))
    return DIAMETER * F.asin(F.sqrt(F.least(half(rows) + F.pow(F.cos(F.radians(high)), 2) * half(columns), F.lit(1.0))))


def hopeful(ways: DataFrame, open_pairs: DataFrame, stops: DataFrame | None, sets: DataFrame | None = None) -> DataFrame:
    """``ways`` that, after one more ride, can still beat the kth answer of some pair of their origins.

    A further ride costs its wait and change, and the straight line to the nearest destination at the cheapest rate of the
    mode, as no ride or walk is shorter than that (DIRECT and NEAR allow for whole metres). The line is that between cells of BLOCK
    degrees; cells more than RING off count as RING off, so a cell meets those around it alone. stops: stop_id, lat, lon; without them, or
    if a stop has no coordinates, distances count nothing. sets: see ``members``."""
    rate = F.least(by_mode(0), by_mode(1))
    least = F.col("cost") + 20 * WAIT + by_mode(4) - by_mode(3)
    per = open_pairs.groupBy("mode", "origins").agg(F.bool_or(F.col("budget").isNull()).alias("free"), F.max("budget").alias("most"))
    if stops is None:
        return ways.join(per, ["mode", "origins"]).where(F.col("free") | (least <= F.col("most"))).select(ways.columns)
    around = 360 * round(1 / BLOCK)
    cells = stops.select("stop_id", F.floor(F.col("lat") / BLOCK).alias("x"), F.pmod(F.floor(F.col("lon") / BLOCK), F.lit(around)).alias("y"))
    kept = ways.join(per, ["mode", "origins"]).join(cells, "stop_id", "left")
    spots = kept.where("not free and x is not null").select("mode", "origins", "most", "x", "y").distinct()
    ends = members(open_pairs.where("budget is not null"), "destinations", "end", sets).join(cells.withColumnRenamed("stop_id", "end"), "end")
    ends = ends.groupBy("mode", "origins", F.col("x").alias("to_x"), F.col("y").alias("to_y")).agg(F.max("budget").alias("budget"))
    off = F.sequence(F.lit(-RING), F.lit(RING))
    near = spots.withColumn("dx", F.explode(off)).withColumn("dy", F.explode(off)).withColumn("to_x", F.col("x") + F.col("dx")).withColumn("to_y", F.pmod(F.col("y") + F.col("dy"), F.lit(around)))
    between = lambda d: F.greatest(F.abs(F.col(d)) - 1, F.lit(0))
    line = lambda metres: F.greatest(metres * DIRECT - NEAR, F.lit(0.0)) * rate
    lat = F.col("x") * BLOCK
    beyond = F.least(farther(RING, 0, lat), farther(0, RING, lat))
    met = near.join(ends, ["mode", "origins", "to_x", "to_y"]).select("mode", "origins", "x", "y", (F.col("budget") - line(farther(between("dx"), between("dy"), lat))).alias("allowed"))
    met = met.union(spots.select("mode", "origins", "x", "y", F.col("most") - line(beyond)))
    allowed = met.groupBy("mode", "origins", "x", "y").agg(F.max("allowed").alias("allowed"))
    kept = kept.join(allowed, ["mode", "origins", "x", "y"], "left")
    return kept.where(F.col("free") | (least <= F.coalesce("allowed", "most"))).select(ways.columns)


def first_sensible(found: DataFrame, calls: DataFrame, k: int, sets: DataFrame | None) -> DataFrame:
    """Of the ways ``found`` those that the ``k`` best combinations of lines can come from, without round-about ones.

    Ways are judged best first: so many of each pair at a time that k combinations may be among them, then eight times as many of
    the pairs that these don't give k for."""
    order = [*ranks(), "days", "steps"]
    place = F.row_number().over(Window.partitionBy(*ANSWER).orderBy(*order))
    judged, some, left = None, 4 * k, None
    while True:
        part = found if left is None else found.join(left, ANSWER, "left_semi")
        first = durable(part.select("*", place.alias("place")).where(F.col("place") <= some))
        good = durable(first.join(roundabouts(first, calls, sets), ["origins", "destinations", "steps"], "left_anti").select(*found.columns))
        full = good.groupBy(*ANSWER).agg(F.countDistinct("rides", "lines").alias("n")).where(F.col("n") >= k)
        left = durable(first.where(F.col("place") == some).select(*ANSWER).join(full, ANSWER, "left_anti"))
        done = good.join(left, ANSWER, "left_anti")
        judged = done if judged is None else judged.union(done)
        if left.isEmpty():
            return judged
        some *= 8


def best_journeys(pairs: DataFrame, sets: DataFrame, calls: DataFrame, edges: DataFrame, k: int, modes: list[str], rides: int, width: int | None, sensible: bool, stops: DataFrame | None, bounded: bool) -> DataFrame:
    """The ``ranked`` answers of ``pairs`` (origins, destinations: numbers of ``sets``, see ``members``); see ``journeys``."""
    ends = sets.select(F.col("set_id").alias("destinations"), "stop_id")
    plain = {"lines": F.lit("-"), "days": F.lit(ALL_DAYS), "cost": F.lit(0).cast("long"), "walk": F.lit(0).cast("long"), "steps": F.lit(""), "tram": F.lit(False)}
    start = members(pairs.select("origins").distinct(), "origins", "stop_id", sets).withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    start = start.select("mode", "origins", "stop_id", *(v.alias(c) for c, v in plain.items()))
    columns = [*ANSWER, "rides", "lines", "days", "cost", "walk", "steps"]
    harvest = lambda ways, n: ways.join(ends, "stop_id").join(pairs, ["origins", "destinations"]).withColumn("rides", F.lit(n)).select(columns)

    def offered(found: DataFrame, answers: DataFrame | None, still: DataFrame | None) -> DataFrame:
        """The answers with those of ``found`` that they leave room for and that are no round-about ways."""
        if sensible:
            if still is not None:
                found = found.join(still, ANSWER).where("budget is null or cost <= budget").select(columns)
            found = first_sensible(found, calls, k, sets)
        return durable(ranked(found if answers is None else answers.select(columns).union(found), k))

    on_foot = walked(start, edges)
    ways, still = best_ways(start.union(on_foot)), None
    answers = offered(harvest(on_foot, 0), None, None)
    for done in range(1, rides + 1):
        by_pattern = durable(ridden(ways, calls, done == 1))
        rode = best_ways(by_pattern)
        offers = by_pattern.drop("pattern_id") if sensible else rode
        if still is not None:  # no walk makes up for what costs more than the kth answer of every pair
            most = still.groupBy("mode", "origins").agg(F.bool_or(F.col("budget").isNull()).alias("free"), F.max("budget").alias("most"))
            offers = offers.join(most, ["mode", "origins"]).where("free or cost <= most").drop("free", "most")
        answers = offered(harvest(offers, done).union(harvest(walked(offers, edges), done)), answers, still)
        if done == rides:
            break
        kept = best_of_stop(rode, width)
        ways = best_of_stop(best_ways(kept.union(walked(kept, edges))), width)
        if bounded:
            still = durable(budgets(answers, pairs, modes, k, done))
            ways = durable(hopeful(ways, still, stops, sets))
            if ways.isEmpty():
                break
    return answers


def set_key(stops: Column | str) -> Column:
    """What tells a set of stops (sorted array) from others."""
    return F.sha2(F.to_json(stops), 256)


def journeys(
    requests: DataFrame, calls: DataFrame, edges: DataFrame, k: int = 3, modes: tuple[str, ...] = tuple(MODES), rides: int = RIDES, width: int | None = -1,
    sensible: bool = False, stops: DataFrame | None = None, bounded: bool = True,
) -> DataFrame:
    """request_id, mode, rank, rides, lines, days, steps, walk, cost: in each mode the ``k`` best combinations of lines of each
    request (request_id, origins, destinations: sorted arrays of stops), each with its best way; a walk alone counts too.
    steps: "r:pattern:board:alight;" of a ride, "w:from:to:metres;" of a walk.

    The ways from a set of origins don't depend on the destinations, so requests that share it share them: a round is one
    ride from all stops reached, then perhaps a walk. Of the ways to a stop ``width`` go on (-1: as many as ``width_for``
    says; None: all, which makes the search exact). bounded: of these, only ways go on that can still be better than the kth answer found
    so far, of any destination (see ``hopeful``; stops: stop_id, lat, lon sharpens that); the answers are the same without. Walks never follow each other; no line is used twice; all rides share a
    day. sensible: round-about ways (see ``roundabouts``) are no answers; each way that ends with another pattern is judged before
    the best of its lines is taken. Requests whose ends have a stop in common have no journeys. calls: see ``boardings``."""
    calls, edges = durable(calls), durable(edges)
    if stops is not None:
        stops = None if stops.where("lat is null or lon is null").limit(1).count() else durable(stops.select("stop_id", "lat", "lon"))
    asked = requests.select("request_id", *(set_key(c).alias(c) for c in ("origins", "destinations")))
    each = requests.select(F.explode(F.array("origins", "destinations")).alias("stops")).groupBy(set_key("stops").alias("key")).agg(F.first("stops").alias("stops"))
    each = durable(each.withColumn("set_id", F.monotonically_increasing_id()))
    sets = durable(each.select("set_id", F.explode("stops").alias("stop_id")).distinct())
    side = lambda end, number: each.select(F.col("key").alias(end), F.col("set_id").alias(number), F.col("stops").alias(f"{number}_stops"))
    pairs = asked.select("origins", "destinations").distinct().join(side("origins", "o"), "origins").join(side("destinations", "d"), "destinations")
    pairs = durable(pairs.where(~F.arrays_overlap("o_stops", "d_stops")).select("o", "d", "origins", "destinations"))
    numbers = pairs.select(F.col("o").alias("origins"), F.col("d").alias("destinations"))
    top = best_journeys(numbers, sets, calls, edges, k, list(modes), rides, width_for(k) if width == -1 else width, sensible, stops, bounded)
    top = top.withColumn("cost", F.col("cost") / UNITS).withColumnsRenamed({"origins": "o", "destinations": "d"}).join(pairs, ["o", "d"])
    return asked.join(top, ["origins", "destinations"]).select("request_id", "mode", "rank", "rides", "lines", "days", "steps", "walk", "cost")


#: The most changes that a journey may have, told by name.
CHANGES = ["direct", "one_transfer", "two_transfers", "three_transfers"]


def answer_counts(requests: DataFrame, found: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """request_id, mode, direct, one_transfer, two_transfers, three_transfers: how many of the answers ``found`` (see ``journeys``)
    have one, two, three and four rides, for each row of ``requests`` and mode; walks alone aren't counted, requests without
    answers have zeros. request_id is unique."""
    counted = found.groupBy("request_id", "mode").agg(*(F.count_if(F.col("rides") == n).alias(c) for n, c in enumerate(CHANGES, 1)))
    every = requests.select("request_id", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    return every.join(counted, ["request_id", "mode"], "left").select("request_id", "mode", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in CHANGES))


def parsed_steps(ways: DataFrame, *keys: str) -> DataFrame:
    """keys, leg (from 0), kind (r or w), x, y, z: one row for each step of ``ways`` (keys, steps)."""
    each = ways.select(*keys, F.posexplode(F.split(F.rtrim("steps", F.lit(";")), ";")).alias("leg", "step")).where("step <> ''").withColumn("part", F.split("step", ":"))
    return each.select(*keys, "leg", F.get("part", F.lit(0)).alias("kind"), *(F.get("part", F.lit(k)).cast("long").alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z"))))


def legs(ways: DataFrame, calls: DataFrame, *keys: str) -> DataFrame:
    """keys, leg, walking, pattern_id, route_id, board, alight (positions), board_stop, alight_stop, metres, hops, tram, ticks:
    the steps of ``ways`` with what the network says of them."""
    steps = parsed_steps(ways, *keys)
    on = calls.select("pattern_id", F.col("position").alias("board"), "route_id", "tram", F.col("stop_id").alias("board_stop"), F.col("metres").alias("a"))
    off = calls.select("pattern_id", F.col("position").alias("alight"), F.col("stop_id").alias("alight_stop"), F.col("metres").alias("b"))
    number = lambda c: F.col(c).cast("int")
    rides = steps.where("kind = 'r'").select(*keys, "leg", F.col("x").alias("pattern_id"), number("y").alias("board"), number("z").alias("alight")).join(on, ["pattern_id", "board"]).join(off, ["pattern_id", "alight"])
    rides = rides.withColumn("metres", F.greatest(F.col("b") - F.col("a"), F.lit(0))).withColumn("hops", F.col("alight") - F.col("board"))
    ticks = (F.col("metres") * F.when(F.col("tram"), 5).otherwise(6) + DWELL * F.col("hops")).cast("long")
    columns = ["walking", "pattern_id", "route_id", "board", "alight", "board_stop", "alight_stop", "metres", "hops", "tram", "ticks"]
    rides = rides.withColumn("walking", F.lit(False)).withColumn("ticks", ticks).select(*keys, "leg", *columns)
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    walks = steps.where("kind = 'w'").select(
        *keys, "leg", F.lit(True).alias("walking"), none("pattern_id", "long"), none("route_id", "int"), none("board", "int"), none("alight", "int"),
        F.col("x").alias("board_stop"), F.col("y").alias("alight_stop"), F.col("z").alias("metres"), F.lit(0).alias("hops"), F.lit(False).alias("tram"), (F.col("z") * 25).alias("ticks"),
    )
    return rides.union(walks)


def roundabouts(ways: DataFrame, calls: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """origins, destinations, steps of the round-about ones of ``ways``: those that come back to a stop; that leave a ride
    which goes on to a later stop of the way, or to a destination; or that board a ride which had passed an earlier stop, or
    an origin. Riding on (or boarding there) must be possible, and its metres at most DETOUR times those of the way between,
    and SLACK more. A ride meets the stops of its own pattern alone, whatever the number of ends. sets: see ``members``."""
    keys = ["origins", "destinations", "steps"]
    w = durable(ways.select(*keys).distinct().withColumn("way", F.monotonically_increasing_id()))
    order, all_of_it = Window.partitionBy("way").orderBy("leg"), Window.partitionBy("way")
    at = legs(w.select("way", "steps"), calls, "way").withColumn("reached", F.sum("metres").over(order)).withColumn("start", F.first("board_stop").over(order))
    spot = F.struct((F.col("leg") + 1).alias("k"), F.col("alight_stop").alias("stop_id"), "reached")
    at = at.withColumn("passed", F.collect_list(spot).over(all_of_it)).withColumn("total", F.max("reached").over(all_of_it)).withColumn("last", F.max("leg").over(all_of_it))
    at = at.withColumn("passed", F.concat(F.array(F.struct(F.lit(0).alias("k"), F.col("start").alias("stop_id"), F.lit(0).cast("long").alias("reached"))), "passed"))
    at = durable(at.withColumn("twice", F.size(F.array_distinct("passed.stop_id")) < F.size("passed")).select("way", "leg", "walking", "pattern_id", "board", (F.col("reached") - F.col("metres")).alias("before"), "passed", "total", "last", "twice"))
    marks = calls.select("pattern_id", "stop_id", "position", "metres", "pickup", "dropoff")
    if sets is not None:
        marks = marks.join(sets.groupBy("stop_id").agg(F.collect_list("set_id").alias("sets")), "stop_id", "left")
    inside = lambda c, end: F.array_contains(F.col(end), c.stop_id) if sets is None else F.coalesce(F.array_contains(c.sets, F.col(end)), F.lit(False))
    line = marks.groupBy("pattern_id").agg(F.collect_list(F.struct(*(c for c in marks.columns if c != "pattern_id"))).alias("line"))
    rides = at.where("not walking and not twice and last > 0").join(w.select("way", "origins", "destinations"), "way").join(line, "pattern_id")
    rides = rides.withColumn("here", F.get(F.filter("line", lambda c: c.position == F.col("board")), F.lit(0)).metres)
    own = lambda c: F.get(F.filter("passed", lambda p: p.stop_id == c.stop_id), F.lit(0))  # noqa: E731  a stop of the way counts with its own metres
    leg, near = F.col("leg"), lambda c, metres: F.abs(c.metres - F.col("here")) <= metres * DETOUR + SLACK
    on = lambda c: (leg < F.col("last")) & c.dropoff & (c.position > F.col("board")) & F.when(own(c).k > leg + 1, near(c, own(c).reached - F.col("before"))).otherwise(inside(c, "destinations") & near(c, F.col("total") - F.col("before")))
    off = lambda c: (leg > 0) & c.pickup & (c.position < F.col("board")) & F.when(own(c).k < leg, near(c, F.col("before") - own(c).reached)).otherwise(inside(c, "origins") & near(c, F.col("before")))
    found = rides.where(F.exists("line", on) | F.exists("line", off)).select("way")
    return w.join(at.where("twice").select("way").union(found).distinct(), "way", "left_semi").select(*keys)
