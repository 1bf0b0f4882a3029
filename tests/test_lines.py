"""Lines with shapes, headsigns and dates against a plain replay."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from headway.operators import conditions, feed, lines, patterns

CALENDAR = {"w": 31, "s": 96, "all": 127, "off": 0}
DRAWN = {1: "p", 2: "q", 3: "p", 4: None}  # shapes 1 and 3 are one path on the map; 4 has none to use


def small_feed(spark, seed):
    """trips with shapes, headsigns and notes, on paths of which some are beginnings of others, or differ in permissions."""
    r = random.Random(seed)
    paths = [((1, 2, 3, 4), "1111", "1111"), ((1, 2, 3), "111", "111"), ((1, 5, 4), "111", "111"), ((1, 2, 9), "111", "111"), ((1, 2, 3, 4), "1101", "1111"), ((6,), "1", "1")]
    trips, times = [], []
    for k in range(120):
        path = paths[min(r.randrange(12), 5)] if r.random() < 0.7 else paths[0]
        sign = r.choice([None, "", "Otogar", "OTOGAR", "Sahil"])
        trip = (k, r.choice([1, 1, 2]), r.choice(["0", "1", None]), r.choice([*CALENDAR, "lost"]), r.choice([None, 7 * 3600, 9 * 3600, 9 * 3600, 90_000]), sign, r.choice([None, 1, 2, 3, 4]), r.random() < 0.3, r.choice(["Okul", "okul!", None, "Hafta sonu"]))
        trips.append((trip, path))
        times += [(k, s, at, 0, path[1][at] == "1", path[2][at] == "1") for at, s in enumerate(path[0])]
    schema = "trip_id long, route_id int, direction string, service_id string, departure long, headsign string, shape_id long, flagged boolean, note string"
    table = spark.createDataFrame([t for t, _ in trips], schema)
    calls = spark.createDataFrame(times, "trip_id long, stop_id long, stop_sequence int, ordinal int, pickup boolean, dropoff boolean")
    calendars = spark.createDataFrame(list(CALENDAR.items()), "service_id string, days int")
    stops = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three"), (4, "Four"), (9, "Nine")], "stop_id long, name string")
    return trips, table, calls, calendars, stops


def plain_variants(trips):
    """(variant id, trips) by (route, direction, shape, path), and the name of each: patterns numbered in their order, then joined."""
    found = defaultdict(list)
    for t, path in trips:
        if CALENDAR.get(t[3], 0):
            found[t[1], t[2] or "", str(t[6] or ""), path[0], path[1], path[2], tuple(d for d in range(7) if CALENDAR[t[3]] >> d & 1)].append(t)
    out = {}
    for number, key in enumerate(sorted(found)):
        signs = " / ".join(sorted({t[5] for t in found[key]} - {None, ""}))
        entry = out.setdefault(key[:6], {"id": number, "name": signs, "trips": []})
        entry["trips"] += found[key]
    return out


def test_variants_and_timetables(spark):
    trips, table, calls, calendars, stops = small_feed(spark, 3)
    found = patterns.patterns(table, calendars, calls)
    variants = lines.drawn_variants(found, stops)
    want = plain_variants(trips)
    names = {1: "One", 2: "Two", 3: "Three", 4: "Four", 9: "Nine"}
    got = {(r.route_id, r.direction or "", str(r.shape_id or ""), tuple(map(int, r.stops.split("-"))), r.pickups, r.dropoffs): (r.variant_id, r.name, r.n_stops, r.n_plain) for r in variants.collect()}
    assert got == {k: (v["id"], v["name"] or names.get(k[3][-1]), len(k[3]), sum(not t[7] for t in v["trips"])) for k, v in want.items()}

    dated = calendars.select("*", F.to_date(F.lit("2024-01-05")).alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    told = lines.variant_trips(table.join(calendars.where("days > 0"), "service_id", "left_semi"), patterns.trip_paths(calls), variants)
    times = defaultdict(list)
    for v in want.values():
        for t in v["trips"]:
            times[v["id"], t[3]].append(t[4])
    rows = lines.variant_timetables(told, dated).collect()
    assert {(r.variant_id, r.service_id): (r.n_trips, r.n_departures, r.departures, str(r.start_date), r.end_date) for r in rows} == {
        k: (len(v), len(set(v) - {None}), ",".join(map(str, sorted(set(v) - {None}))), "2024-01-05", None) for k, v in times.items()
    }
    assert lines.variant_timetables(told.limit(0), dated).count() == lines.drawn_variants(found.limit(0), stops).count() == 0


def plain_labels(trips):
    """trip_id -> what sets it apart, told as ``trip_conditions`` tells it."""
    sides, out = defaultdict(list), {}
    for key, v in plain_variants(trips).items():
        sides[key[0], key[1] or v["id"]].append((v["id"], key, v["trips"]))
    for group in sides.values():
        group.sort()
        ref = max(group, key=lambda x: (sum(not t[7] for t in x[2]), len(x[1][3]), -x[0]))
        own = sorted([t for t in ref[2] if not t[7]] or ref[2])
        note, sign = (Counter((t[at] or "").lower().strip("!") for t in own).most_common(1)[0][0] for at in (8, 5))
        for option, (_, key, runs) in enumerate(group, 1):
            a, b = DRAWN.get(int(key[2] or 0)), DRAWN.get(int(ref[1][2] or 0))
            line, rights = bool(a and b and a != b), key[4:] != ref[1][4:]
            if key[3] != ref[1][3]:
                path = f"only to {key[3][-1]}" if ref[1][3][: len(key[3])] == key[3] else f"last stop {key[3][-1]}" if key[3][-1] != ref[1][3][-1] else f"other route {option}"
            else:
                path = f"other line and permissions {option}" if line and rights else f"other line {option}" if line else "other permissions" if rights else ""
            for t in runs:
                parts = [t[8] if t[8] and (t[7] or t[8].lower().strip("!") != note) else "", path, f"headsign {t[5]}" if t[5] and t[5].lower() != sign else ""]
                out[t[0]] = " · ".join(p for p in parts if p)
    return out


def test_conditions_tell_other_lines_on_the_map(spark):
    seen = set()
    for seed in (3, 8, 21):
        trips, table, calls, calendars, stops = small_feed(spark, seed)
        found = lines.drawn_variants(patterns.patterns(table, calendars, calls), stops)
        shown = spark.createDataFrame([(k, v) for k, v in DRAWN.items()], "shape_id long, drawn string")
        found = found.join(shown, "shape_id", "left").cache()
        references = lines.reference_variants(found.drop("n_plain"), found.select("variant_id", "n_plain"))
        own = lines.variant_trips(table.join(calendars.where("days > 0"), "service_id", "left_semi"), patterns.trip_paths(calls), found).cache()
        got = {r.trip_id: r.label for r in conditions.trip_conditions(own, lines.variant_conditions(found, references), conditions.common_notes(own, references)).collect()}
        assert got == plain_labels(trips)
        seen |= {w for label in got.values() for w in ("other line", "only to", "last stop", "other route", "permissions", "headsign") if w in label}
    assert len(seen) == 6


def test_lines_by_name(spark):
    """Numbers go first, by value; a line without a long name has its short one, or its id; the mode is no part of the name."""
    raw = spark.createDataFrame(
        [("a", "10", "Harbour - Old Town", "3", ""), ("b", " 9 ", "", "0", ""), ("c", "", "Airport Express", "3", "X1"), ("d", "", "", "700", ""), ("e", "9", "Zoo", "3", ""), ("off", "1", "Never", "3", "")],
        "route_id string, route_short_name string, route_long_name string, route_type string, route_code string",
    )
    used = spark.createDataFrame([(x,) for x in "aabcde"], "route_id string")
    known = lines.named_catalogue(feed.routes(raw), used).cache()
    assert [(r.route_id, r.code, r.name) for r in known.orderBy("rank").collect()] == [("b", "9", "9"), ("e", "9", "Zoo"), ("a", "10", "Harbour - Old Town"), ("c", "X1", "Airport Express"), ("d", "d", "d")]
    asked = spark.createDataFrame([(x,) for x in ("old town", "9", "EXPRESS", "tram", "10 harb", " ", "o")], "query string")
    got = {}
    for r in lines.line_search(asked, known).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append(r.route_id)
    assert got == {"old town": ["a"], "9": ["b", "e"], "EXPRESS": ["c"], "10 harb": ["a"], "o": ["e", "a", "c"]}
