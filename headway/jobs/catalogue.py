"""All registered queries of the schedule jobs, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import clock, geo
from headway.functions.durable import durable, stored
from headway.operators import boarding, conditions, journeys, lines, names, patterns, resolve, rides, rounds, shapes, timetable, validate, vehicles
from headway.sources.demo_feed import FEED_SQL, DemoFeed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of (feed) with the SQL that goes on after the feed's tables (None: SQL can't express it)."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(DemoFeed(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = FEED_SQL + sql
        return f

    return add


PATHS = """, paths AS (
  SELECT trip_id, string_agg(stop_id::VARCHAR, '-' ORDER BY stop_sequence, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS stops,
    string_agg(CASE WHEN pickup THEN '1' ELSE '0' END, '' ORDER BY stop_sequence, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pickups,
    string_agg(CASE WHEN dropoff THEN '1' ELSE '0' END, '' ORDER BY stop_sequence, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dropoffs
  FROM stop_times GROUP BY trip_id)"""
PATTERNS = PATHS + """, clean AS (SELECT trip_id, regexp_matches(rtrim(coalesce(note, '')), '#[0-9A-Fa-f]{6}$') AS flagged,
  nullif(trim(regexp_replace(regexp_replace(rtrim(coalesce(note, '')), '#[0-9A-Fa-f]{6}$', ''), '[# ]+$', '')), '') AS note FROM notes),
patterns AS (
  SELECT row_number() OVER (ORDER BY route_id, coalesce(direction, ''), [x::BIGINT for x in string_split(stops, '-')], pickups, dropoffs, [d for d in range(7) if days & (1 << d::INT) <> 0]) - 1 AS pattern_id, *
  FROM (SELECT route_id, direction, days, stops, pickups, dropoffs, count(*) AS n_trips, count(DISTINCT service_id) AS n_services, count(*) FILTER (NOT flagged) AS n_plain
        FROM trips JOIN calendars USING (service_id) JOIN paths USING (trip_id) JOIN clean USING (trip_id) WHERE days > 0 GROUP BY ALL))"""
HAVERSINE = "12742000 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
ANCHORED = """, near AS (
  SELECT rule_id, side, span, pattern_id, position, c.stop_id <> landmark AS other, CASE WHEN c.stop_id = landmark THEN 0 ELSE round(%s)::BIGINT END AS metres
  FROM network c JOIN boarding_rules USING (route_id, direction) JOIN stops a ON a.stop_id = c.stop_id JOIN stops b ON b.stop_id = landmark),
anchors AS (SELECT rule_id, pattern_id, side, span, position AS anchor FROM near WHERE NOT other OR metres <= 800 QUALIFY row_number() OVER (PARTITION BY rule_id, pattern_id ORDER BY other, metres, position) = 1)""" % HAVERSINE.format(a="a.", b="b.")
PERMITTED = ANCHORED + """, taken AS (SELECT pattern_id, position, side FROM network JOIN anchors USING (pattern_id)
  WHERE CASE span WHEN 'before' THEN position < anchor WHEN 'through' THEN position <= anchor WHEN 'from' THEN position >= anchor ELSE position > anchor END),
permitted AS (
  SELECT pattern_id, position, stop_id, pickup AND NOT coalesce(bool_or(side = 'board'), false) AS pickup, dropoff AND NOT coalesce(bool_or(side = 'alight'), false) AS dropoff
  FROM network n LEFT JOIN taken t USING (pattern_id, position) GROUP BY pattern_id, position, stop_id, pickup, dropoff)"""
CALLS = PERMITTED + """, hops AS (
  SELECT pattern_id, route_id, position, stop_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
  FROM network JOIN stops USING (stop_id) WINDOW w AS (PARTITION BY pattern_id ORDER BY position)),
running AS (SELECT pattern_id, bit_or(days) AS days FROM departures GROUP BY pattern_id),
calls AS (
  SELECT h.pattern_id, route_id, h.position, h.stop_id, route_id %% 10 = 0 AS tram, pickup, dropoff, coalesce(days, 0) AS days,
    sum(CASE WHEN plat IS NULL THEN 0 ELSE round(%s)::BIGINT END) OVER (PARTITION BY h.pattern_id ORDER BY h.position)::BIGINT AS metres
  FROM hops h JOIN permitted p USING (pattern_id, position) LEFT JOIN running USING (pattern_id))""" % HAVERSINE.format(a="p", b="").replace("plat", "h.plat").replace("plon", "h.plon")
EDGES = """, edges AS (
  SELECT a.stop_id, b.stop_id AS to_stop, round(%s)::BIGINT AS metres FROM stops a JOIN stops b
  ON a.stop_id <> b.stop_id AND abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01 WHERE round(%s) <= 500)""" % ((HAVERSINE.format(a="a.", b="b."),) * 2)


def calls(feed: DemoFeed) -> DataFrame:
    """The network's stops with metres, permissions (rules of boarding included), the days of the pattern (bits) and whether the
    line is a tram; kept, as jobs use it several times."""
    network = feed.network()
    allowed = boarding.permissions(network, boarding.anchors(feed.boarding_rules(), network, feed.stops())).select("pattern_id", "position", "pickup", "dropoff")
    days = feed.departures().groupBy("pattern_id").agg(F.bit_or("days").alias("days"))
    on = geo.chain_metres(network.drop("pickup", "dropoff"), feed.stops()).withColumn("tram", F.col("route_id") % 10 == 0)
    return durable(on.join(allowed, ["pattern_id", "position"]).join(days, "pattern_id", "left").withColumn("days", F.coalesce("days", F.lit(0))))


def raw_patterns(feed: DemoFeed) -> DataFrame:
    flags = lines.cleaned_notes(feed.notes()).select("trip_id", "flagged")
    return patterns.patterns(feed.trips().join(flags, "trip_id"), feed.calendars(), feed.stop_times())


@query(PATTERNS + " SELECT (SELECT count(*) FROM stops) AS n_stops, (SELECT count(*) FROM patterns) AS n_patterns")
def feed_summary(feed: DemoFeed) -> DataFrame:
    n_patterns = raw_patterns(feed).agg(F.count("*").alias("n_patterns"))
    return feed.stops().agg(F.count("*").alias("n_stops")).crossJoin(n_patterns)


@query("""
SELECT 'unique' AS rule, 'trips' AS table_name, trip_id::VARCHAR AS key, 'trip_id' AS detail FROM trips GROUP BY trip_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'foreign', 'stop_times', trip_id::VARCHAR, 'trip_id' FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM trips)
UNION ALL SELECT DISTINCT 'foreign', 'stop_times', stop_id::VARCHAR, 'stop_id' FROM stop_times WHERE stop_id NOT IN (SELECT stop_id FROM stops)
UNION ALL SELECT DISTINCT 'foreign', 'trips', service_id, 'service_id' FROM trips WHERE service_id NOT IN (SELECT service_id FROM calendars WHERE days > 0)
UNION ALL SELECT 'required', 'trips', trip_id::VARCHAR, 'direction' FROM trips WHERE direction IS NULL
UNION ALL SELECT 'coordinate', 'stops', stop_id::VARCHAR, 'lat' FROM stops WHERE abs(lat) > 90 OR abs(lon) > 180""")
def violations(feed: DemoFeed) -> DataFrame:
    """What breaks the rules, if a service must run and a trip needs a direction."""
    trips, times = feed.trips(), feed.stop_times()
    found = validate.repeated_keys(trips, "trips", "trip_id")
    found = found.union(validate.dangling(times, "stop_times", "trip_id", trips, "trip_id")).union(validate.dangling(times, "stop_times", "stop_id", feed.stops(), "stop_id"))
    found = found.union(validate.dangling(trips, "trips", "service_id", feed.calendars().where("days > 0"), "service_id"))
    return found.union(validate.blank_values(trips, "trips", "direction", "trip_id")).union(validate.bad_coordinates(feed.stops(), "stops", "stop_id"))


@query(PATHS + " SELECT * FROM paths")
def ordered_trip_stops(feed: DemoFeed) -> DataFrame:
    return patterns.trip_paths(feed.stop_times())


@query(PATTERNS + " SELECT * FROM patterns")
def trip_patterns(feed: DemoFeed) -> DataFrame:
    return raw_patterns(feed)


@query(PATTERNS + """ SELECT pattern_id, generate_subscripts(string_split(stops, '-'), 1) - 1 AS position, unnest(string_split(stops, '-'))::BIGINT AS stop_id FROM patterns""")
def pattern_occurrences(feed: DemoFeed) -> DataFrame:
    return patterns.occurrences(raw_patterns(feed))


@query(" SELECT stop_id, count(DISTINCT pattern_id) AS n_patterns FROM stops LEFT JOIN network USING (stop_id) GROUP BY stop_id")
def patterns_at_stops(feed: DemoFeed) -> DataFrame:
    return patterns.patterns_at_stops(feed.stops(), feed.network())


@query(PATTERNS + """, occ AS (SELECT pattern_id, generate_subscripts(string_split(stops, '-'), 1) - 1 AS position, unnest(string_split(stops, '-'))::BIGINT AS stop_id FROM patterns)
SELECT pattern_id, stop_id, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM occ GROUP BY ALL""")
def stop_positions(feed: DemoFeed) -> DataFrame:
    return patterns.positions(patterns.occurrences(raw_patterns(feed)))


@query(CALLS + " SELECT pattern_id, position, stop_id, metres FROM calls")
def stop_chain_metres(feed: DemoFeed) -> DataFrame:
    return calls(feed).select("pattern_id", "position", "stop_id", "metres")


@query(EDGES + " SELECT * FROM edges")
def walking_edges(feed: DemoFeed) -> DataFrame:
    return geo.walking_edges(feed.stops())


KEYS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f""" SELECT {KEYS.format('name')} AS name_key, {KEYS.format('district')} AS district_key, min_by(name, stop_id) AS name, count(*) AS n_platforms
FROM stops WHERE stop_id IN (SELECT stop_id FROM network) GROUP BY 1, 2""")
def stop_catalogue(feed: DemoFeed) -> DataFrame:
    return names.stop_catalogue(feed.stops(), feed.network())


@query(f""", keyed AS (SELECT stop_id, {KEYS.format('name')} AS name_key, {KEYS.format('district')} AS district_key FROM stops WHERE stop_id IN (SELECT stop_id FROM network))
SELECT district_key, name_key, string_agg(stop_id::VARCHAR, ',' ORDER BY stop_id) AS stop_ids
FROM (SELECT * FROM keyed WHERE district_key <> '' UNION ALL SELECT stop_id, name_key, '' FROM keyed) WHERE name_key <> '' GROUP BY ALL""")
def stop_name_index(feed: DemoFeed) -> DataFrame:
    return names.stop_name_index(feed.stops(), feed.network())


@query(f""", keyed AS (SELECT DISTINCT {KEYS.format('name')} AS name_key, {KEYS.format('district')} AS district_key FROM stops WHERE stop_id IN (SELECT stop_id FROM network)),
asked AS (SELECT DISTINCT p_type AS query, {KEYS.format('p_type')} AS q FROM part UNION SELECT DISTINCT substr(p_name, 1, 3), {KEYS.format('substr(p_name, 1, 3)')} FROM part),
met AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY NOT starts_with(name_key, q), name_key, district_key) AS rank, name_key, district_key
  FROM asked JOIN keyed ON trim(query) = '' OR (q <> '' AND contains(name_key, q)))
SELECT * FROM met WHERE rank <= 12""")
def stop_search(feed: DemoFeed) -> DataFrame:
    part = feed.read("part")
    asked = part.select(F.col("p_type").alias("query")).union(part.select(F.substring("p_name", 1, 3))).distinct()
    return names.search(asked, names.stop_catalogue(feed.stops(), feed.network()))


@query(""" SELECT route_id, short_name AS code, CASE WHEN route_type = 0 THEN 'tram' ELSE 'bus' END AS mode, row_number() OVER (ORDER BY route_id) AS rank
FROM routes WHERE route_id IN (SELECT route_id FROM trips)""")
def line_catalogue(feed: DemoFeed) -> DataFrame:
    return lines.line_catalogue(feed.routes(), feed.trips())


VARIANTS = PATTERNS + """, variants AS (
  SELECT min(pattern_id) AS variant_id, route_id, direction, stops, count(*) AS n_patterns, sum(n_plain)::BIGINT AS n_plain, len(string_split(stops, '-')) AS n_stops,
    string_split(stops, '-')[1]::BIGINT AS origin, string_split(stops, '-')[-1]::BIGINT AS destination
  FROM patterns GROUP BY route_id, direction, stops, pickups, dropoffs)"""


@query(VARIANTS + " SELECT * EXCLUDE (n_plain) FROM variants")
def line_variants(feed: DemoFeed) -> DataFrame:
    return lines.variants(raw_patterns(feed))


@query(VARIANTS + """ SELECT route_id, direction, variant_id, n_plain, n_stops FROM (
  SELECT *, row_number() OVER (PARTITION BY route_id, direction, CASE WHEN direction IS NULL THEN variant_id END ORDER BY n_plain DESC, n_stops DESC, variant_id) AS place FROM variants) WHERE place = 1""")
def reference_variants(feed: DemoFeed) -> DataFrame:
    found = raw_patterns(feed)
    trips_of = found.groupBy("route_id", "direction", "stops", "pickups", "dropoffs").agg(F.min("pattern_id").alias("variant_id"), F.sum("n_plain").alias("n_plain")).select("variant_id", "n_plain")
    return lines.reference_variants(lines.variants(found), trips_of)


@query(" SELECT pattern_id, days, count(DISTINCT departure) AS n_departures, min(departure) AS first, max(departure) AS last FROM departures GROUP BY ALL")
def pattern_timetable(feed: DemoFeed) -> DataFrame:
    return lines.timetable(feed.departures())


@query(""" SELECT pattern_id, category, bit_or(days & mask) AS days_covered, count(DISTINCT departure) AS n_departures
FROM departures, (VALUES ('weekday', 31), ('saturday', 32), ('sunday', 64)) t(category, mask) WHERE days & mask <> 0 GROUP BY ALL""")
def day_categories(feed: DemoFeed) -> DataFrame:
    return lines.day_categories(feed.departures())


@query(""" SELECT trip_id, lpad((departure // 3600)::VARCHAR, 2, '0') || ':' || lpad((departure // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((departure % 60)::VARCHAR, 2, '0') AS clock,
  lpad((departure // 3600 % 24)::VARCHAR, 2, '0') || ':' || lpad((departure // 60 % 60)::VARCHAR, 2, '0') || CASE WHEN departure % 60 > 0 THEN ':' || lpad((departure % 60)::VARCHAR, 2, '0') ELSE '' END
  || CASE WHEN departure >= 86400 THEN ' +' || (departure // 86400)::VARCHAR ELSE '' END AS label, departure AS seconds FROM trips""")
def display_clock(feed: DemoFeed) -> DataFrame:
    """Clock text past 24:00, its wall-clock label, and the seconds read back from the text."""
    text = feed.trips().select("trip_id", clock.clock_text(F.col("departure")).alias("clock"), clock.display_clock(F.col("departure")).alias("label"))
    return text.withColumn("seconds", clock.clock_seconds(F.col("clock")).cast("long"))


@query(""" SELECT request_id, isodow(instant) - 1 AS weekday, isodow(instant) <= 5 AND (s >= 25200 AND s < 34200 OR s >= 59400 AND s < 70200) AS rush
FROM (SELECT *, hour(instant) * 3600 + minute(instant) * 60 + second(instant) AS s FROM arrival_requests)""")
def rush_hours(feed: DemoFeed) -> DataFrame:
    second = F.hour("instant") * 3600 + F.minute("instant") * 60 + F.second("instant")
    return feed.arrival_requests().select("request_id", F.weekday("instant").alias("weekday"), clock.is_rush_hour(F.weekday("instant"), second).alias("rush"))


@query(CALLS + """ SELECT pattern_id, CASE WHEN bool_or(tram) THEN 'tram' WHEN (max(metres) - min(metres)) / (count(*) - 1) >= 600 THEN 'district' ELSE 'city' END AS kind FROM calls GROUP BY pattern_id""")
def line_kinds(feed: DemoFeed) -> DataFrame:
    return timetable.line_kinds(calls(feed))


TICKS = "(greatest({m}, 0) * CASE WHEN {t} THEN 5 ELSE 6 END + 500 * ({b} - {a}) + 10000)"
DIRECT = CALLS + f""", direct AS (
  SELECT request_id, a.pattern_id, a.route_id, a.position AS board, b.position AS alight, b.metres - a.metres AS metres,
    {TICKS.format(m='b.metres - a.metres', t='a.tram', a='a.position', b='b.position')} / 2000::DOUBLE AS minutes
  FROM journey_requests JOIN calls a ON a.stop_id = origin AND a.pickup JOIN calls b ON b.pattern_id = a.pattern_id AND b.stop_id = destination AND b.position > a.position AND b.dropoff)"""


@query(DIRECT + " SELECT * FROM direct")
def direct_rides(feed: DemoFeed) -> DataFrame:
    return rides.direct_rides(feed.journey_requests(), calls(feed))


@query(DIRECT + """, best AS (SELECT * FROM direct QUALIFY row_number() OVER (PARTITION BY request_id, route_id ORDER BY minutes, pattern_id, board, alight) = 1)
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY minutes, pattern_id, board, alight) AS rank FROM best QUALIFY rank <= 3""")
def direct_journeys(feed: DemoFeed) -> DataFrame:
    """The three best lines of each request, each with its best ride."""
    return rides.best_distinct(rides.direct_rides(feed.journey_requests(), calls(feed)), "route_id", ["minutes", "pattern_id", "board", "alight"], 3)


@query(CALLS + """ SELECT request_id, a.pattern_id, a.position AS board, b.position AS alight, b.stop_id, b.metres - a.metres AS ride_metres, a.tram, a.days
FROM journey_requests JOIN calls a ON a.stop_id = origin AND a.pickup JOIN calls b ON b.pattern_id = a.pattern_id AND b.position > a.position AND b.dropoff""")
def forward_reach(feed: DemoFeed) -> DataFrame:
    return rides.forward_reach(feed.journey_requests(), calls(feed))


@query(CALLS + """ SELECT request_id, a.pattern_id, a.position AS board, b.position AS alight, a.stop_id, b.metres - a.metres AS ride_metres, a.tram, a.days
FROM journey_requests JOIN calls b ON b.stop_id = destination AND b.dropoff JOIN calls a ON b.pattern_id = a.pattern_id AND b.position > a.position AND a.pickup""")
def backward_reach(feed: DemoFeed) -> DataFrame:
    return rides.backward_reach(feed.journey_requests(), calls(feed))


@query(CALLS + EDGES + f""", ahead AS (
  SELECT request_id, a.pattern_id AS first_pattern, b.stop_id, a.days AS d1, min({TICKS.format(m='b.metres - a.metres', t='a.tram', a='a.position', b='b.position')}) AS m1
  FROM journey_requests JOIN calls a ON a.stop_id = origin AND a.pickup JOIN calls b ON b.pattern_id = a.pattern_id AND b.position > a.position AND b.dropoff GROUP BY ALL),
back AS (
  SELECT request_id, a.pattern_id AS second_pattern, a.stop_id AS to_stop, a.days AS d2, min({TICKS.format(m='b.metres - a.metres', t='a.tram', a='a.position', b='b.position')}) AS m2
  FROM journey_requests JOIN calls b ON b.stop_id = destination AND b.dropoff JOIN calls a ON b.pattern_id = a.pattern_id AND b.position > a.position AND a.pickup GROUP BY ALL),
steps AS (SELECT DISTINCT stop_id, stop_id AS to_stop, 0 AS walk FROM calls UNION ALL SELECT stop_id, to_stop, metres FROM edges)
SELECT request_id, first_pattern, second_pattern, min(m1 + m2 + walk * 25) / 2000::DOUBLE AS minutes
FROM ahead JOIN steps USING (stop_id) JOIN back USING (request_id, to_stop) WHERE first_pattern <> second_pattern AND d1 & d2 <> 0 GROUP BY ALL""")
def one_transfer(feed: DemoFeed) -> DataFrame:
    return rides.one_transfer(feed.journey_requests(), calls(feed), geo.walking_edges(feed.stops()))


ARRIVALS = CALLS + """, kinds AS (
  SELECT pattern_id, max(position) AS last, CASE WHEN bool_or(tram) THEN 'tram' WHEN (max(metres) - min(metres)) / (count(*) - 1) >= 600 THEN 'district' ELSE 'city' END AS kind FROM calls GROUP BY pattern_id),
asked AS (
  SELECT request_id, pattern_id, route_id, back, rush, (isodow(instant) - 1 - back + 7) % 7 AS weekday,
    hour(instant) * 3600 + minute(instant) * 60 + second(instant) + 86400 * back
      - metres * 36 // (10 * CASE kind WHEN 'tram' THEN 25 WHEN 'city' THEN CASE WHEN rush THEN 16 ELSE 23 END ELSE CASE WHEN rush THEN 25 ELSE 35 END END) AS low
  FROM arrival_requests JOIN calls USING (stop_id) JOIN kinds USING (pattern_id), (VALUES (0), (1)) t(back), (VALUES (false), (true)) u(rush) WHERE position < last AND pickup),
timed AS (SELECT *, departure % 86400 AS second_of_day FROM departures),
arrivals AS (
  SELECT DISTINCT request_id, pattern_id, route_id, back, departure, departure - low AS wait FROM asked JOIN timed USING (pattern_id)
  WHERE departure BETWEEN low AND low + 3600 AND days & (1 << weekday::INT) <> 0
    AND rush = ((weekday + departure // 86400) % 7 < 5 AND (second_of_day >= 25200 AND second_of_day < 34200 OR second_of_day >= 59400 AND second_of_day < 70200)))"""


@query(ARRIVALS + " SELECT * FROM arrivals")
def stop_arrivals(feed: DemoFeed) -> DataFrame:
    return timetable.arrivals(feed.arrival_requests(), calls(feed), feed.departures())


@query(ARRIVALS + """ SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY wait, route_id, pattern_id, back, departure) AS rank FROM arrivals QUALIFY rank <= 60""")
def arrival_board(feed: DemoFeed) -> DataFrame:
    """The next 60 arrivals of each request."""
    from pyspark.sql import Window

    found = timetable.arrivals(feed.arrival_requests(), calls(feed), feed.departures())
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("wait", "route_id", "pattern_id", "back", "departure"))
    return found.withColumn("rank", rank).where("rank <= 60")


@query(ARRIVALS + """ SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY minutes, route_id) AS rank, route_id, minutes
FROM (SELECT DISTINCT request_id, route_id, (wait + 59) // 60 AS minutes FROM arrivals) QUALIFY rank <= 3""")
def next_vehicles(feed: DemoFeed) -> DataFrame:
    return vehicles.next_vehicles(timetable.arrivals(feed.arrival_requests(), calls(feed), feed.departures()))


@query(ARRIVALS + " SELECT request_id, pattern_id, back, departure, min(wait) AS wait FROM arrivals GROUP BY ALL")
def vehicle_markers(feed: DemoFeed) -> DataFrame:
    return vehicles.markers(timetable.arrivals(feed.arrival_requests(), calls(feed), feed.departures()))


ACTIVE = CALLS + """, kinds AS (
  SELECT pattern_id, max(position) AS last, max(metres) AS total, CASE WHEN bool_or(tram) THEN 'tram' WHEN (max(metres) - min(metres)) / (count(*) - 1) >= 600 THEN 'district' ELSE 'city' END AS kind FROM calls GROUP BY pattern_id),
asked AS (
  SELECT DISTINCT request_id, pattern_id, kind, last, total, back, (isodow(instant) - 1 - back + 7) % 7 AS weekday,
    hour(instant) * 3600 + minute(instant) * 60 + second(instant) + 86400 * back AS high
  FROM arrival_requests JOIN calls USING (stop_id) JOIN kinds USING (pattern_id), (VALUES (0), (1)) t(back)),
met AS (
  SELECT DISTINCT request_id, pattern_id, kind, last, total, back, departure, high - departure AS elapsed, (weekday + departure // 86400) % 7 AS day, departure % 86400 AS s
  FROM asked JOIN departures USING (pattern_id) WHERE departure BETWEEN high - 40000 AND high AND days & (1 << weekday::INT) <> 0),
moved AS (
  SELECT *, elapsed * CASE kind WHEN 'tram' THEN 25 WHEN 'city' THEN CASE WHEN rush THEN 16 ELSE 23 END ELSE CASE WHEN rush THEN 25 ELSE 35 END END * 10 // 36 AS along
  FROM (SELECT *, day < 5 AND (s >= 25200 AND s < 34200 OR s >= 59400 AND s < 70200) AS rush FROM met)),
placed AS (
  SELECT m.request_id, m.pattern_id, back, departure, along, least(count(*) - 1, any_value(last) - 1) AS position
  FROM moved m JOIN calls c ON c.pattern_id = m.pattern_id AND c.metres <= m.along WHERE along <= total GROUP BY ALL)"""


@query(ACTIVE + """ SELECT request_id, p.pattern_id, back, departure, along, p.position, CASE WHEN b.metres > a.metres THEN (along - a.metres) * 1000 // (b.metres - a.metres) ELSE 0 END AS permille
FROM placed p JOIN calls a ON a.pattern_id = p.pattern_id AND a.position = p.position JOIN calls b ON b.pattern_id = p.pattern_id AND b.position = p.position + 1""")
def active_vehicles(feed: DemoFeed) -> DataFrame:
    return vehicles.active_vehicles(feed.arrival_requests(), calls(feed), feed.departures())


@query(CALLS + EDGES + """, pairs AS (SELECT DISTINCT origin, destination FROM journey_requests WHERE origin <> destination),
reach AS (SELECT stop_id, stop_id AS to_stop, 0 AS walk FROM (SELECT DISTINCT stop_id FROM calls) UNION ALL SELECT * FROM edges),
rides AS (
  SELECT origin, destination, a.route_id, a.pattern_id, a.position AS board, b.position AS alight, a.tram, o.walk + d.walk AS walk, greatest(b.metres - a.metres, 0) AS metres
  FROM pairs JOIN reach o ON o.stop_id = origin JOIN reach d ON d.stop_id = destination JOIN calls a ON a.stop_id = o.to_stop AND a.pickup
  JOIN calls b ON b.pattern_id = a.pattern_id AND b.stop_id = d.to_stop AND b.position > a.position AND b.dropoff),
costed AS (
  SELECT *, 200000 + 10000 * (alight - board) + metres * CASE WHEN tram THEN t ELSE 120 END + walk * w - CASE WHEN tram THEN bonus ELSE 0 END AS units
  FROM rides, (VALUES ('fastest', 100, 500, 0), ('fewest_transfers', 100, 500, 0), ('minimal_walking', 100, 2500, 0), ('prefer_tram', 55, 500, 320000)) m(mode, t, w, bonus)),
best AS (SELECT * FROM costed QUALIFY row_number() OVER (PARTITION BY origin, destination, mode, route_id ORDER BY units, walk, pattern_id, board, alight) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY origin, destination, mode ORDER BY units, walk, pattern_id, board, alight) AS rank FROM best QUALIFY rank <= 3)
SELECT request_id, mode, rank, route_id, pattern_id, board, alight, walk, units / 40000::DOUBLE AS cost FROM journey_requests JOIN top USING (origin, destination)""")
def ranked_journeys(feed: DemoFeed) -> DataFrame:
    return journeys.ranked_journeys(feed.journey_requests(), calls(feed), geo.walking_edges(feed.stops()))


TWO = CALLS + EDGES + f""", pairs AS (SELECT DISTINCT origin, destination FROM journey_requests),
steps AS (SELECT DISTINCT stop_id, stop_id AS to_stop, 0 AS walk FROM calls UNION ALL SELECT * FROM edges),
ride AS (
  SELECT a.pattern_id, a.stop_id, b.stop_id AS out_stop, a.days, min({TICKS.format(m='b.metres - a.metres', t='a.tram', a='a.position', b='b.position')}) AS m
  FROM calls a JOIN calls b ON b.pattern_id = a.pattern_id AND b.position > a.position AND a.pickup AND b.dropoff GROUP BY ALL),
ahead AS (SELECT origin, destination, pattern_id AS p1, days AS d1, s.to_stop AS spot, min(m + walk * 25) AS m1 FROM pairs JOIN ride r ON r.stop_id = origin JOIN steps s ON s.stop_id = r.out_stop GROUP BY ALL),
back AS (SELECT origin, destination, pattern_id AS p3, days AS d3, s.stop_id AS spot, min(m + walk * 25) AS m3 FROM pairs JOIN ride r ON r.out_stop = destination JOIN steps s ON s.to_stop = r.stop_id GROUP BY ALL),
middle AS (SELECT origin, destination, r.pattern_id AS p2, r.out_stop AS spot, d1 & days AS d2, min(m1 + m) AS m2 FROM ahead JOIN ride r ON r.stop_id = ahead.spot AND r.pattern_id <> p1 AND d1 & days <> 0 GROUP BY ALL),
twice AS (SELECT origin, destination, p2, min(m2 + m3) / 2000::DOUBLE AS minutes FROM middle JOIN back USING (origin, destination, spot) WHERE p2 <> p3 AND d2 & d3 <> 0 GROUP BY ALL)"""


@query(TWO + " SELECT request_id, p2 AS middle_pattern, minutes FROM journey_requests JOIN twice USING (origin, destination)")
def two_transfers(feed: DemoFeed) -> DataFrame:
    return journeys.two_transfers(feed.journey_requests(), calls(feed), geo.walking_edges(feed.stops()))


@query(TWO + """, once AS (SELECT DISTINCT request_id, p1, p3 FROM journey_requests JOIN (
    SELECT DISTINCT origin, destination, p1, r.pattern_id AS p3 FROM ahead JOIN ride r ON r.out_stop = destination AND r.stop_id = spot WHERE p1 <> r.pattern_id AND d1 & days <> 0) USING (origin, destination)),
direct AS (SELECT request_id FROM journey_requests JOIN calls a ON a.stop_id = origin AND a.pickup JOIN calls b ON b.pattern_id = a.pattern_id AND b.stop_id = destination AND b.position > a.position AND b.dropoff)
SELECT request_id, transfers, count(*) AS n FROM (SELECT request_id, 0 AS transfers FROM direct UNION ALL SELECT request_id, 1 FROM once
  UNION ALL SELECT request_id, 2 FROM journey_requests JOIN twice USING (origin, destination)) GROUP BY ALL""")
def journey_counts(feed: DemoFeed) -> DataFrame:
    asked, on, edges = feed.journey_requests(), calls(feed), geo.walking_edges(feed.stops())
    return journeys.journey_counts(rides.direct_rides(asked, on), rides.one_transfer(asked, on, edges), journeys.two_transfers(asked, on, edges))


@query(DIRECT + """, legs AS (SELECT DISTINCT pattern_id, board, alight FROM direct),
days AS (SELECT * FROM running),
own AS (SELECT l.*, any_value(c.route_id) AS route_id, bool_or(c.tram) AS tram, any_value(d.days) AS days, string_agg(c.stop_id::VARCHAR, '-' ORDER BY c.position) AS path, alight - board AS hops
  FROM legs l JOIN days d USING (pattern_id) JOIN calls c ON c.pattern_id = l.pattern_id AND c.position BETWEEN board AND alight GROUP BY l.pattern_id, board, alight),
cuts AS (SELECT a.pattern_id, a.route_id, a.tram, h.hops, a.position, string_agg(b.stop_id::VARCHAR, '-' ORDER BY b.position) AS path, count(*) AS n
  FROM calls a, (SELECT DISTINCT hops FROM own) h JOIN calls b ON b.pattern_id = a.pattern_id AND b.position BETWEEN a.position AND a.position + h.hops WHERE a.pickup
  GROUP BY ALL HAVING count(*) = h.hops + 1 AND arg_max(b.dropoff, b.position)),
same AS (SELECT own.pattern_id, board, alight, own.route_id, own.days, cuts.route_id AS line, bit_or(d.days) AS all_days
  FROM own JOIN cuts USING (path, tram) JOIN days d ON d.pattern_id = cuts.pattern_id GROUP BY ALL)
SELECT pattern_id, board, alight, string_agg(line::VARCHAR, ',' ORDER BY line <> route_id, line) AS lines FROM same WHERE all_days & days = days GROUP BY pattern_id, board, alight""")
def interchangeable_lines(feed: DemoFeed) -> DataFrame:
    days = feed.departures().groupBy("pattern_id").agg(F.bit_or("days").alias("days"))
    return journeys.interchangeable_lines(rides.direct_rides(feed.journey_requests(), calls(feed)), calls(feed), days)


@query(""" SELECT trip_id, regexp_matches(rtrim(coalesce(note, '')), '#[0-9A-Fa-f]{6}$') AS flagged,
  nullif(trim(regexp_replace(regexp_replace(rtrim(coalesce(note, '')), '#[0-9A-Fa-f]{6}$', ''), '[# ]+$', '')), '') AS note FROM notes""")
def trip_notes(feed: DemoFeed) -> DataFrame:
    return lines.cleaned_notes(feed.notes())


@query(PATTERNS + """, variants AS (SELECT min(pattern_id) AS variant_id, route_id, direction, stops, pickups, dropoffs, sum(n_plain) AS n_plain FROM patterns GROUP BY route_id, direction, stops, pickups, dropoffs),
refs AS (SELECT * FROM variants QUALIFY row_number() OVER (PARTITION BY route_id, direction, CASE WHEN direction IS NULL THEN variant_id END ORDER BY n_plain DESC, len(string_split(stops, '-')) DESC, variant_id) = 1),
met AS (SELECT v.*, r.variant_id AS reference_id, r.stops AS s, r.pickups AS p, r.dropoffs AS d, string_split(v.stops, '-')[-1]::BIGINT AS last, string_split(r.stops, '-')[-1]::BIGINT AS other
  FROM variants v JOIN refs r ON v.route_id = r.route_id AND (v.direction = r.direction OR v.direction IS NULL AND v.variant_id = r.variant_id))
SELECT variant_id, reference_id, CASE WHEN stops <> s AND starts_with(s, stops || '-') THEN 'only_to' WHEN stops <> s AND last <> other THEN 'last_stop' WHEN stops <> s THEN 'other_route'
  WHEN pickups <> p OR dropoffs <> d THEN 'other_permissions' END AS condition, CASE WHEN condition IN ('only_to', 'last_stop') THEN last::VARCHAR ELSE '' END AS detail FROM met""")
def variant_conditions(feed: DemoFeed) -> DataFrame:
    found = raw_patterns(feed)
    keys = ["route_id", "direction", "stops", "pickups", "dropoffs"]
    variants = found.groupBy(*keys).agg(F.min("pattern_id").alias("variant_id"), F.sum("n_plain").alias("n_plain"))
    references = lines.reference_variants(variants.withColumn("n_stops", F.size(F.split("stops", "-"))).drop("n_plain"), variants.select("variant_id", "n_plain"))
    return lines.variant_conditions(variants, references)


@query(PATTERNS + """, spots AS (SELECT pattern_id, pickups, dropoffs, unnest(range(0, length(pickups))) AS position FROM patterns)
SELECT pattern_id, position, concat_ws(', ', CASE WHEN substr(pickups, position + 1, 1) = '0' THEN 'no boarding' END, CASE WHEN substr(dropoffs, position + 1, 1) = '0' THEN 'no alighting' END) AS label
FROM spots WHERE label <> ''""")
def stop_restrictions(feed: DemoFeed) -> DataFrame:
    return lines.restrictions(raw_patterns(feed))


@query(f""", catalogue AS (SELECT route_id, short_name AS code, short_name || CASE WHEN route_type = 0 THEN ' tram' ELSE ' bus' END AS line_key, row_number() OVER (ORDER BY route_id) AS rank
  FROM routes WHERE route_id IN (SELECT route_id FROM trips)),
asked AS (SELECT DISTINCT query, {KEYS.format('query')} AS q FROM (SELECT p_size::VARCHAR AS query FROM part UNION ALL SELECT upper(substr(p_name, 1, 1)) FROM part) WHERE {KEYS.format('query')} <> '')
SELECT query, row_number() OVER (PARTITION BY query ORDER BY NOT starts_with(code, q), rank) AS place, route_id FROM asked JOIN catalogue ON contains(line_key, q) QUALIFY place <= 40""")
def line_search(feed: DemoFeed) -> DataFrame:
    part = feed.read("part")
    asked = part.select(F.col("p_size").cast("string").alias("query")).union(part.select(F.upper(F.substring("p_name", 1, 1)))).distinct()
    return lines.line_search(asked, lines.line_catalogue(feed.routes(), feed.trips()))


@query(""", folded AS (SELECT *, translate(message, 'ABCDEFGHIJKLMNOPQRSTUVWXYZİĞÜŞÖÇığüşöç', 'abcdefghijklmnopqrstuvwxyzigusocigusoc') AS f FROM messages),
spots AS (SELECT *, strpos(f, 'duragindan') AS a, strpos(substr(f, strpos(f, 'duragindan') + 10), 'duragina') AS b FROM folded),
named AS (SELECT request_id, a > 0 AND b > 0 AS good, trim(substr(message, 1, a - 1), ' .,;:') AS o, trim(substr(message, a + 10, b - 1), ' .,;:') AS d FROM spots)
SELECT request_id, CASE WHEN good AND o <> '' AND d <> '' THEN o END AS origin_name, CASE WHEN good AND o <> '' AND d <> '' THEN d END AS destination_name FROM named""")
def trip_requests(feed: DemoFeed) -> DataFrame:
    return names.trip_requests(feed.messages())


SHAPES = CALLS + """, shape_steps AS (
  SELECT shape_id, sequence, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY sequence, lat, lon)),
measured AS (
  SELECT shape_id, sequence, lat, lon, round(sum(CASE WHEN plat IS NULL THEN 0 ELSE %s END) OVER (PARTITION BY shape_id ORDER BY sequence, lat, lon), 3) AS metres FROM shape_steps)""" % HAVERSINE.format(a="p", b="")
PLACED = SHAPES + """, segments AS (
  SELECT shape_id, sequence AS seg, lat, lon, metres, lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon, lead(metres) OVER w AS to_metres FROM measured WINDOW w AS (PARTITION BY shape_id ORDER BY sequence, lat, lon)),
local AS (
  SELECT pattern_id, position, seg, metres, to_metres, (s.lat - t.lat) * 111195 AS ax, (s.lon - t.lon) * 111195 * cos(radians(t.lat)) AS ay, (to_lat - s.lat) * 111195 AS vx, (to_lon - s.lon) * 111195 * cos(radians(t.lat)) AS vy
  FROM (SELECT pattern_id, position, stop_id FROM calls) JOIN stops t USING (stop_id) JOIN segments s ON s.shape_id = pattern_id WHERE to_lat IS NOT NULL),
parts AS (SELECT *, greatest(0, least(1, -(ax * vx + ay * vy) / greatest(vx * vx + vy * vy, 1e-12))) AS t FROM local),
spots AS MATERIALIZED (SELECT pattern_id, position, seg, round(metres + t * (to_metres - metres), 3) AS along, round(pow(ax + t * vx, 2) + pow(ay + t * vy, 2), 6) AS off FROM parts),
walked AS (
  WITH RECURSIVE steps(pattern_id, position, best) AS (
    SELECT pattern_id, position, min({'off': off, 'along': along, 'seg': seg}) FROM spots WHERE position = 0 GROUP BY ALL
    UNION ALL SELECT s.pattern_id, s.position, min({'off': s.off, 'along': s.along, 'seg': s.seg}) FROM steps p JOIN spots s ON s.pattern_id = p.pattern_id AND s.position = p.position + 1 AND s.seg >= p.best.seg GROUP BY ALL)
  SELECT * FROM steps),
checked AS (SELECT w.pattern_id, best.off AS off, best.along - lag(best.along) OVER o AS hop, c.metres - lag(c.metres) OVER o AS chain FROM walked w JOIN calls c USING (pattern_id, position) WINDOW o AS (PARTITION BY w.pattern_id ORDER BY w.position)),
good AS (SELECT pattern_id FROM checked GROUP BY pattern_id HAVING max(off) <= 1000000 AND NOT bool_or(coalesce(hop < 0.8 * chain, false))),
placed AS (
  SELECT c.pattern_id, position, stop_id, CASE WHEN g.pattern_id IS NULL THEN c.metres ELSE round(best.along)::BIGINT END AS metres, g.pattern_id IS NOT NULL AS usable
  FROM calls c LEFT JOIN good g USING (pattern_id) LEFT JOIN walked w USING (pattern_id, position))"""


def shape_of(feed: DemoFeed) -> DataFrame:
    return feed.network().where("route_id % 2 = 0").select("pattern_id", F.col("pattern_id").alias("shape_id")).distinct()


def placed_stops(feed: DemoFeed) -> DataFrame:
    return shapes.stops_on_shapes(calls(feed), feed.stops(), shapes.shape_metres(feed.shapes()), shape_of(feed))


@query(SHAPES + " SELECT * FROM measured")
def shape_metres(feed: DemoFeed) -> DataFrame:
    return shapes.shape_metres(feed.shapes())


@query(PLACED + " SELECT * FROM placed")
def stops_on_shapes(feed: DemoFeed) -> DataFrame:
    return placed_stops(feed)


@query(PLACED + """, legs AS (SELECT DISTINCT a.pattern_id, a.position AS board, b.position AS alight FROM journey_requests JOIN calls a ON a.stop_id = origin AND a.pickup
  JOIN calls b ON b.pattern_id = a.pattern_id AND b.stop_id = destination AND b.position > a.position AND b.dropoff),
ends AS (SELECT l.*, a.metres AS low, b.metres AS high, a.usable FROM legs l JOIN placed a ON a.pattern_id = l.pattern_id AND a.position = board JOIN placed b ON b.pattern_id = l.pattern_id AND b.position = alight),
inside AS (SELECT e.pattern_id, board, alight, round(m.metres)::BIGINT AS k, sequence, lat, lon FROM ends e JOIN measured m ON e.usable AND m.shape_id = e.pattern_id AND round(m.metres) BETWEEN low AND high),
drawn AS (SELECT DISTINCT pattern_id, board, alight FROM inside),
points AS (
  SELECT *, 'shape' AS source FROM inside
  UNION ALL SELECT d.*, CASE WHEN position = board THEN -1 ELSE 1::BIGINT << 61 END, 0, lat, lon, 'shape' FROM drawn d JOIN calls c ON c.pattern_id = d.pattern_id AND position IN (board, alight) JOIN stops USING (stop_id)
  UNION ALL SELECT e.pattern_id, board, alight, position, 0, lat, lon, 'stops' FROM ends e ANTI JOIN drawn d ON d.pattern_id = e.pattern_id AND d.board = e.board AND d.alight = e.alight
    JOIN calls c ON c.pattern_id = e.pattern_id AND position BETWEEN board AND alight JOIN stops USING (stop_id))
SELECT pattern_id, board, alight, source, row_number() OVER (PARTITION BY pattern_id, board, alight ORDER BY k, sequence, lat, lon) AS place, lat, lon FROM points""")
def leg_geometry(feed: DemoFeed) -> DataFrame:
    on = calls(feed)
    measured = shapes.shape_metres(feed.shapes())
    placed = shapes.stops_on_shapes(on, feed.stops(), measured, shape_of(feed))
    return shapes.leg_geometry(rides.direct_rides(feed.journey_requests(), on), placed, feed.stops(), measured, shape_of(feed))


@query(PLACED + """, drawn AS (SELECT DISTINCT pattern_id FROM placed WHERE usable), points AS (
  SELECT pattern_id, 'shape' AS source, sequence::BIGINT AS k, lat, lon FROM drawn JOIN measured ON shape_id = pattern_id
  UNION ALL SELECT pattern_id, 'stops', position, lat, lon FROM calls ANTI JOIN drawn USING (pattern_id) JOIN stops USING (stop_id))
SELECT pattern_id, source, row_number() OVER (PARTITION BY pattern_id ORDER BY k, lat, lon) AS place, lat, lon FROM points""")
def pattern_geometry(feed: DemoFeed) -> DataFrame:
    return shapes.pattern_geometry(placed_stops(feed), feed.stops(), shapes.shape_metres(feed.shapes()), shape_of(feed))


@query(ACTIVE + """, steps AS (
  SELECT shape_id, sequence, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY sequence, lat, lon)),
paths AS (
  SELECT shape_id AS path_id, lat, lon, round(sum(CASE WHEN plat IS NULL THEN 0 ELSE %s END) OVER (PARTITION BY shape_id ORDER BY sequence, lat, lon), 3) AS metres FROM steps
  UNION ALL SELECT pattern_id, lat, lon, metres::DOUBLE FROM calls JOIN stops USING (stop_id) WHERE route_id %% 2 = 1),
cuts AS (SELECT *, lead(metres) OVER w AS to_metres, lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon FROM paths WINDOW w AS (PARTITION BY path_id ORDER BY metres, lat, lon)),
sought AS (SELECT DISTINCT pattern_id AS path_id, along FROM placed),
held AS (SELECT path_id, along, greatest(low, least(high, along::DOUBLE)) AS m, high FROM sought JOIN (SELECT path_id, min(metres) AS low, max(metres) AS high FROM paths GROUP BY path_id) USING (path_id)),
spots AS (
  SELECT path_id, along, round(coalesce(lat + (to_lat - lat) * coalesce((m - metres) / (to_metres - metres), 0), lat), 7) AS lat, round(coalesce(lon + (to_lon - lon) * coalesce((m - metres) / (to_metres - metres), 0), lon), 7) AS lon
  FROM held JOIN cuts USING (path_id) WHERE metres <= m AND (to_metres > m OR m = high AND metres = high) QUALIFY row_number() OVER (PARTITION BY path_id, along ORDER BY metres, lat, lon) = 1)
SELECT request_id, pattern_id, back, departure, placed.along, spots.lat, spots.lon FROM placed JOIN spots ON path_id = pattern_id AND spots.along = placed.along""" % HAVERSINE.format(a="p", b=""))
def vehicle_points(feed: DemoFeed) -> DataFrame:
    """Where on the map the active vehicles are."""
    on = calls(feed)
    moving = vehicles.active_vehicles(feed.arrival_requests(), on, feed.departures()).select("request_id", F.col("pattern_id").alias("path_id"), "back", "departure", "along")
    drawn = shapes.shape_metres(feed.shapes()).select(F.col("shape_id").alias("path_id"), "metres", "lat", "lon")
    plain = on.where("route_id % 2 = 1").join(feed.stops(), "stop_id").select(F.col("pattern_id").alias("path_id"), F.col("metres").cast("double"), "lat", "lon")
    return shapes.points_along(moving, drawn.union(plain)).withColumnRenamed("path_id", "pattern_id")


@query(ANCHORED + " SELECT * FROM anchors")
def rule_anchors(feed: DemoFeed) -> DataFrame:
    return boarding.anchors(feed.boarding_rules(), feed.network(), feed.stops())


@query(PERMITTED + " SELECT * FROM permitted")
def boarding_permissions(feed: DemoFeed) -> DataFrame:
    return boarding.permissions(feed.network(), boarding.anchors(feed.boarding_rules(), feed.network(), feed.stops()))


CONDITIONS = PATTERNS + """, variants AS (SELECT min(pattern_id) AS variant_id, route_id, direction, stops, pickups, dropoffs, sum(n_plain) AS n_plain FROM patterns GROUP BY route_id, direction, stops, pickups, dropoffs),
refs AS (SELECT * FROM variants QUALIFY row_number() OVER (PARTITION BY route_id, direction, CASE WHEN direction IS NULL THEN variant_id END ORDER BY n_plain DESC, len(string_split(stops, '-')) DESC, variant_id) = 1),
met AS (SELECT v.*, r.variant_id AS reference_id, r.stops AS s, r.pickups AS p, r.dropoffs AS d, string_split(v.stops, '-')[-1] AS last, string_split(r.stops, '-')[-1] AS other
  FROM variants v JOIN refs r ON v.route_id = r.route_id AND (v.direction = r.direction OR v.direction IS NULL AND v.variant_id = r.variant_id)),
differ AS (SELECT variant_id, reference_id, CASE WHEN stops <> s AND starts_with(s, stops || '-') THEN 'only to ' || last WHEN stops <> s AND last <> other THEN 'last stop ' || last WHEN stops <> s THEN 'other route'
  WHEN pickups <> p OR dropoffs <> d THEN 'other permissions' END AS path FROM met),
own AS (SELECT t.trip_id, variant_id, t.route_id, t.direction, service_id, departure, flagged, note FROM trips t JOIN calendars USING (service_id) JOIN paths USING (trip_id)
  JOIN variants v ON v.route_id = t.route_id AND v.direction IS NOT DISTINCT FROM t.direction AND v.stops = paths.stops AND v.pickups = paths.pickups AND v.dropoffs = paths.dropoffs
  JOIN clean USING (trip_id) WHERE days > 0),
told AS (SELECT *, count(*) FILTER (NOT flagged) OVER (PARTITION BY variant_id) AS plain FROM own WHERE variant_id IN (SELECT variant_id FROM refs)),
common AS (SELECT variant_id AS reference_id, coalesce(note, '') AS common FROM told WHERE plain = 0 OR NOT flagged GROUP BY variant_id, coalesce(note, '')
  QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY count(*) DESC, min(trip_id)) = 1),
labelled AS (SELECT own.*, concat_ws(' · ', CASE WHEN flagged OR coalesce(note, '') <> coalesce(common, '') THEN note END, path) AS label FROM own JOIN differ USING (variant_id) LEFT JOIN common USING (reference_id)),
used AS (SELECT route_id, coalesce(direction, '') AS side, label, min((departure, trip_id)) AS first FROM labelled WHERE label <> '' GROUP BY ALL),
ids AS (SELECT route_id, side, label, row_number() OVER (PARTITION BY route_id, side ORDER BY first) AS condition_id FROM used)"""


def labelled_trips(feed: DemoFeed) -> DataFrame:
    """The trips of running services with their variant, clean note and label. Paths are built once, and kept with the trips."""
    runs = stored(patterns.running_trips(feed.trips().join(lines.cleaned_notes(feed.notes()), "trip_id"), feed.calendars(), feed.stop_times()))
    keys = ["route_id", "direction", "stops", "pickups", "dropoffs"]
    variants = stored(patterns.patterns_of(runs).groupBy(*keys).agg(F.min("pattern_id").alias("variant_id"), F.sum("n_plain").alias("n_plain")))
    references = lines.reference_variants(variants.withColumn("n_stops", F.size(F.split("stops", "-"))).drop("n_plain"), variants.select("variant_id", "n_plain"))
    path = F.concat_ws("|", F.col("route_id").cast("string"), F.coalesce("direction", F.lit("")), "stops", "pickups", "dropoffs")
    hashed = F.substring(F.unhex(F.sha2(path, 256)), 1, 16).alias("path")  # 128 bits
    own = runs.select("trip_id", "route_id", "direction", "service_id", "departure", "flagged", "note", hashed).join(variants.select("variant_id", hashed), "path").drop("path")
    own = stored(own)
    return stored(conditions.trip_conditions(own, lines.variant_conditions(variants, references), conditions.common_notes(own, references)))


@query(CONDITIONS + " SELECT trip_id, variant_id, label FROM labelled")
def trip_conditions(feed: DemoFeed) -> DataFrame:
    return labelled_trips(feed).select("trip_id", "variant_id", "label")


@query(CONDITIONS + " SELECT * FROM ids")
def condition_ids(feed: DemoFeed) -> DataFrame:
    return conditions.condition_ids(labelled_trips(feed))


@query(CONDITIONS + """, once AS (SELECT route_id, coalesce(direction, '') AS side, service_id, departure, coalesce(condition_id, 0) AS condition_id, variant_id, max(trip_id) AS trip_id
  FROM labelled l LEFT JOIN ids i USING (route_id, label) WHERE i.side IS NULL OR i.side = coalesce(direction, '') GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY route_id, side, service_id ORDER BY departure, variant_id, condition_id) AS place FROM once""")
def direction_timetable(feed: DemoFeed) -> DataFrame:
    labelled = labelled_trips(feed)
    return conditions.direction_timetable(labelled, conditions.condition_ids(labelled))


@query(None)
def resolved_stops(feed: DemoFeed) -> DataFrame:
    return resolve.resolved_with_retry(feed.stop_queries(), feed.stops(), feed.network(), ["durak"])


@query(None)
def stop_suggestions(feed: DemoFeed) -> DataFrame:
    return resolve.suggestions(feed.stop_queries(), feed.stops(), feed.network())


from headway.jobs import feed_jobs, journey_jobs, line_jobs  # noqa: E402, F401  (register their queries)
