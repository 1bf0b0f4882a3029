"""Feed tables from texts, their violations, boards by name and similar rides, with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.functions import geo
from headway.functions.durable import durable, shared_folder
from headway.jobs.catalogue import ACTIVE, ARRIVALS, PATTERNS, calls, query, raw_patterns, shape_of
from headway.jobs.journey_jobs import fast
from headway.operators import feed as build
from headway.operators import grouped, lines, patterns, rides, shapes, similar, timetable, validate, vehicles
from headway.operators.feed import DAYS
from headway.sources import feed_files
from headway.sources.demo_feed import DemoFeed

_FLAGS = ", ".join(f"CASE WHEN (c_custkey * 5 + 3) & {1 << d} <> 0 THEN '1' ELSE CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE '' END END AS {n}" for d, n in enumerate(DAYS))
RAW = f""", raw_calendar AS (
  SELECT 'S' || c_custkey AS service_id, {_FLAGS}, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + (c_custkey % 200)::INT, '%Y%m%d') END AS start_date,
    CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '20240231' ELSE strftime(DATE '2024-01-01' + (200 + c_custkey % 300)::INT, '%Y%m%d') END AS end_date FROM customer),
raw_routes AS (
  SELECT CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_partkey::VARCHAR END AS route_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || ' ' END AS route_short_name, p_name AS route_long_name,
    ['0', '3', '700', '715', '903', '1', '', 'x'][(p_partkey % 8 + 1)::INT] AS route_type, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE '' END AS route_code FROM part),
raw_stops AS (
  SELECT s_suppkey::VARCHAR AS stop_id, s_name AS stop_name, CASE WHEN s_suppkey % 9 = 0 THEN '?' WHEN s_suppkey % 13 = 0 THEN '95.5' ELSE (40 + s_suppkey % 10)::VARCHAR END AS stop_lat, (20 + s_suppkey % 20)::VARCHAR AS stop_lon FROM supplier),
raw_stop_times AS (
  SELECT trip_id, stop_sequence, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN (k % 30) || ':5:7' WHEN 2 THEN '24:70:00' WHEN 3 THEN '8:00'
    ELSE lpad((k % 30)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') || ':' || lpad((k % 59)::VARCHAR, 2, '0') END AS departure_time FROM (SELECT *, trip_id * 7 + stop_sequence AS k FROM stop_times)),
services AS (
  SELECT service_id, {' + '.join(f"CASE WHEN {n} = '1' THEN {1 << d} ELSE 0 END" for d, n in enumerate(DAYS))} AS days, try_strptime(nullif(start_date, ''), '%Y%m%d')::DATE AS start_date, try_strptime(nullif(end_date, ''), '%Y%m%d')::DATE AS end_date FROM raw_calendar),
typed_routes AS (
  SELECT route_id, nullif(trim(route_short_name), '') AS short_name, nullif(trim(route_long_name), '') AS long_name, try_cast(nullif(route_type, '') AS INT) AS route_type, nullif(route_code, '') AS route_code FROM raw_routes WHERE trim(route_id) <> '')"""


@query(RAW + " SELECT service_id, days, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date FROM services")
def feed_calendars(feed: DemoFeed) -> DataFrame:
    return build.calendars(feed.raw_calendar()).withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query(RAW + """ SELECT route_id, short_name, long_name, route_type, coalesce(route_code, short_name) AS code, trim(coalesce(short_name, route_code, route_id)) AS public_code,
  CASE WHEN route_type = 0 OR route_type BETWEEN 900 AND 906 THEN 'tram' ELSE 'bus' END AS mode FROM typed_routes""")
def feed_routes(feed: DemoFeed) -> DataFrame:
    return build.routes(feed.raw_routes())


@query(RAW + " SELECT route_id, route_type FROM typed_routes WHERE route_type IS NULL OR route_type IN (0, 3) OR route_type BETWEEN 700 AND 716 OR route_type BETWEEN 900 AND 906")
def public_transport_routes(feed: DemoFeed) -> DataFrame:
    return build.public_transport(build.routes(feed.raw_routes())).select("route_id", "route_type")


@query(RAW + " SELECT row_number() OVER (ORDER BY stop_id) - 1 AS id, stop_id, stop_name AS name, try_cast(stop_lat AS DOUBLE) AS lat, try_cast(stop_lon AS DOUBLE) AS lon FROM raw_stops")
def feed_stops(feed: DemoFeed) -> DataFrame:
    return build.stops(feed.raw_stops())


@query(RAW + """, firsts AS (SELECT trip_id, departure_time AS t FROM raw_stop_times QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)
SELECT trip_id, CASE WHEN regexp_full_match(t, '[0-9]+:[0-9]+:[0-9]+') AND string_split(t, ':')[1]::INT <= 99 AND string_split(t, ':')[2]::INT < 60 AND string_split(t, ':')[3]::INT < 60
  THEN lpad(string_split(t, ':')[1], 2, '0') || ':' || lpad(string_split(t, ':')[2], 2, '0') || ':' || lpad(string_split(t, ':')[3], 2, '0') END AS departure FROM firsts""")
def first_departures(feed: DemoFeed) -> DataFrame:
    return build.first_departures(feed.raw_stop_times())


@query(RAW + """, asked AS (SELECT DISTINCT instant::DATE AS day FROM arrival_requests)
SELECT day::VARCHAR AS day, service_id FROM asked JOIN services ON days & (1 << (isodow(day) - 1)::INT) <> 0 AND (start_date IS NULL OR day >= start_date) AND (end_date IS NULL OR day <= end_date)""")
def services_on_dates(feed: DemoFeed) -> DataFrame:
    return build.services_on(feed.arrival_requests().select(F.to_date("instant").alias("day")), build.calendars(feed.raw_calendar())).select(F.col("day").cast("string").alias("day"), "service_id")


@query(RAW + """ SELECT 'required' AS rule, 'routes' AS table_name, route_id AS key, 'route_short_name' AS detail FROM raw_routes WHERE trim(route_short_name) = ''
UNION ALL SELECT 'unique', 'routes', route_id, 'route_id' FROM raw_routes GROUP BY route_id HAVING count(*) > 1
UNION ALL SELECT 'unique', 'stops', stop_id, 'stop_id' FROM raw_stops GROUP BY stop_id HAVING count(*) > 1
UNION ALL SELECT 'unique', 'calendar', service_id, 'service_id' FROM raw_calendar GROUP BY service_id HAVING count(*) > 1
UNION ALL SELECT 'integer', 'routes', route_id, 'route_type' FROM raw_routes WHERE route_type <> '' AND try_cast(route_type AS INT) IS NULL
UNION ALL SELECT 'date', 'calendar', service_id, 'end_date' FROM raw_calendar WHERE end_date <> '' AND try_strptime(end_date, '%Y%m%d') IS NULL
UNION ALL SELECT 'date', 'calendar', service_id, 'start_date' FROM raw_calendar WHERE start_date <> '' AND try_strptime(start_date, '%Y%m%d') IS NULL
UNION ALL SELECT 'coordinate', 'stops', stop_id, 'stop_lat' FROM raw_stops WHERE abs(try_cast(stop_lat AS DOUBLE)) > 90 OR abs(try_cast(stop_lon AS DOUBLE)) > 180
UNION ALL SELECT DISTINCT 'foreign', 'trips', t.route_id::VARCHAR, 'route_id' FROM trips t WHERE t.route_id::VARCHAR NOT IN (SELECT route_id FROM typed_routes)""")
def raw_violations(feed: DemoFeed) -> DataFrame:
    """What breaks the rules in the tables as texts."""
    lines, spots, services = feed.raw_routes(), feed.raw_stops(), feed.raw_calendar()
    found = validate.blank_values(lines, "routes", "route_short_name", "route_id").union(validate.repeated_keys(lines, "routes", "route_id"))
    found = found.union(validate.repeated_keys(spots, "stops", "stop_id")).union(validate.repeated_keys(services, "calendar", "service_id"))
    found = found.union(validate.bad_integers(lines, "routes", "route_type", "route_id")).union(validate.bad_dates(services, "calendar", "end_date", "service_id"))
    found = found.union(validate.bad_dates(services, "calendar", "start_date", "service_id")).union(validate.bad_coordinates(spots, "stops", "stop_id", "stop_lat", "stop_lon"))
    known = build.routes(lines).select("route_id")
    return found.union(validate.dangling(feed.trips().select(F.col("route_id").cast("string").alias("route_id")), "trips", "route_id", known, "route_id"))


@query(PATTERNS + " SELECT (SELECT count(*) FROM patterns) > 0 AS has_patterns, (SELECT count(*) FROM network JOIN stops USING (stop_id) WHERE trim(name) <> '') > 0 AS has_named_stops")
def usable_feed(feed: DemoFeed) -> DataFrame:
    return validate.usable(raw_patterns(feed), feed.network(), feed.stops())


@query(ARRIVALS.replace("arrival_requests JOIN calls USING (stop_id)", "(SELECT r.request_id, r.instant, p.stop_id FROM arrival_requests r JOIN stops s ON s.stop_id = r.stop_id JOIN stops p ON p.name = s.name) JOIN calls USING (stop_id)")
       .replace("SELECT request_id, pattern_id, route_id, back, rush,", "SELECT request_id, stop_id AS platform, position, metres, pattern_id, route_id, back, rush, CASE kind WHEN 'tram' THEN 25 WHEN 'city' THEN CASE WHEN rush THEN 16 ELSE 23 END ELSE CASE WHEN rush THEN 25 ELSE 35 END END AS speed, hour(instant) * 3600 + minute(instant) * 60 + second(instant) + 86400 * back AS high,")
       .replace("SELECT DISTINCT request_id, pattern_id, route_id, back, departure, departure - low AS wait", "SELECT DISTINCT request_id, platform, position, pattern_id, route_id, back, departure, speed, high - departure AS elapsed, departure - low AS wait") + """,
moved AS (SELECT *, elapsed * speed * 10 // 36 AS along, row_number() OVER () AS n FROM arrivals),
spots AS (SELECT n, least(count(c.position) - 1, (SELECT max(position) - 1 FROM calls x WHERE x.pattern_id = any_value(m.pattern_id))) AS passed FROM moved m LEFT JOIN calls c ON c.pattern_id = m.pattern_id AND c.metres <= m.along WHERE elapsed >= 0 GROUP BY n)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY wait, route_id, pattern_id, back, departure, platform, position) AS rank, platform, route_id, pattern_id, round_even(wait / 60, 0)::BIGINT AS minutes,
  position - passed AS remaining, CASE WHEN elapsed < 0 THEN -elapsed END AS departs_in, elapsed >= 0 AND round_even(wait / 60, 0) <= 10 AS near FROM moved LEFT JOIN spots USING (n) QUALIFY rank <= 60""")  # fmt: skip
def name_board(feed: DemoFeed) -> DataFrame:
    """The next 60 arrivals at all platforms of a name."""
    named = feed.arrival_requests().join(feed.stops().select("stop_id", "name"), "stop_id").select("request_id", "instant", "name")
    return timetable.name_board(named, feed.stops(), calls(feed), feed.departures())


@query(ARRIVALS + RAW + """, dated AS (
  SELECT DISTINCT route_id * 2 + direction::INT AS pattern_id, c.days, departure, s.start_date, s.end_date FROM trips JOIN calendars c USING (service_id) JOIN orders ON o_orderkey = trip_id JOIN services s ON s.service_id = 'S' || o_custkey
  WHERE direction IS NOT NULL AND c.days > 0),
met AS (
  SELECT DISTINCT request_id, a.pattern_id, route_id, back, departure, departure - low AS wait FROM asked a JOIN arrival_requests USING (request_id) JOIN dated d USING (pattern_id)
  WHERE departure BETWEEN low AND low + 3600 AND days & (1 << weekday::INT) <> 0 AND (start_date IS NULL OR instant::DATE - back >= start_date) AND (end_date IS NULL OR instant::DATE - back <= end_date)
    AND rush = ((weekday + departure // 86400) % 7 < 5 AND (departure % 86400 >= 25200 AND departure % 86400 < 34200 OR departure % 86400 >= 59400 AND departure % 86400 < 70200)))
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY wait, route_id, pattern_id, back, departure) AS rank FROM met QUALIFY rank <= 60""")
def dated_board(feed: DemoFeed) -> DataFrame:
    """The next 60 arrivals of each request, of departures that are valid on the day of service."""
    from pyspark.sql import Window

    found = timetable.arrivals(feed.arrival_requests(), calls(feed), feed.dated_departures())
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("wait", "route_id", "pattern_id", "back", "departure"))
    return found.withColumn("rank", rank).where("rank <= 60")


def drawn(feed: DemoFeed, on: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paths of the patterns on the map, and their stops where these can be used."""
    measured = shapes.shape_metres(feed.shapes())
    placed = shapes.stops_on_shapes(on, feed.stops(), measured, shape_of(feed)).where("usable").select("pattern_id", "position", "metres")
    return shape_of(feed).join(measured, "shape_id").select("pattern_id", "metres", "lat", "lon"), placed


@query(None)
def similar_rides(feed: DemoFeed) -> DataFrame:
    """Links between direct rides that are one ride to a traveller: to the first of their class, and between these."""
    on = calls(feed)
    return similar.similar_rides(durable(rides.direct_rides(feed.journey_requests(), on)), on, *drawn(feed, on))


@query(None)
def journey_groups(feed: DemoFeed) -> DataFrame:
    """The best journey of the request to which each of the fastest ones is the same."""
    on = calls(feed)
    found, legs = fast(feed, on)
    facts = durable(similar.ride_facts(legs.where("not walking"), on, *drawn(feed, on)))
    return similar.first_groups(legs, facts, 3, "request_id")


@query(None)
def grouped_journeys(feed: DemoFeed) -> DataFrame:
    """The three best groups of the fastest journeys of up to two rides, without round-about ones."""
    on = calls(feed)
    return grouped.grouped_journeys(feed.named_requests(), on, geo.walking_edges(feed.stops()), *drawn(feed, on), modes=("fastest",), rides=2, stops=feed.stops())


@query(ACTIVE + """, specs AS (SELECT request_id, pattern_id, min(position) AS board FROM arrival_requests JOIN calls USING (stop_id) GROUP BY ALL),
told AS (
  SELECT m.request_id, m.pattern_id, back, departure, along, c.metres AS a, CASE kind WHEN 'tram' THEN 25 WHEN 'city' THEN CASE WHEN rush THEN 16 ELSE 23 END ELSE CASE WHEN rush THEN 25 ELSE 35 END END AS speed
  FROM moved m JOIN specs s ON s.request_id = m.request_id AND s.pattern_id = m.pattern_id AND s.board < last JOIN calls c ON c.pattern_id = m.pattern_id AND c.position = board WHERE along <= total)
SELECT request_id, pattern_id, back, departure, along, CASE WHEN along < a THEN round_even((a - along) * 36 / (speed * 10) / 60, 0)::BIGINT END AS minutes_to_board, along >= a AS passed_board
FROM told WHERE along >= a OR (a - along) * 36 / (speed * 10) / 60 <= 30""")
def vehicles_for_rides(feed: DemoFeed) -> DataFrame:
    """Vehicles for the rides from the stop of each request to the ends of its lines."""
    on = calls(feed)
    ends = on.groupBy("pattern_id").agg(F.max("position").alias("alight"))
    first = feed.arrival_requests().join(on.select("pattern_id", "stop_id", "position"), "stop_id").groupBy("request_id", "instant", "pattern_id").agg(F.min("position").alias("board"))
    return vehicles.vehicles_for_rides(first.join(ends, "pattern_id").where("board < alight"), on, feed.departures())


@query(PATTERNS + " SELECT * FROM patterns")
def patterns_from_files(feed: DemoFeed) -> DataFrame:
    """Feed tables written as files, located, read and built into patterns, which are kept under the files' fingerprint."""
    spark, place = feed.spark, f"{shared_folder(feed.spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    bit = lambda c: F.when(F.col(c), "1").otherwise("0").alias(c)
    times = feed.stop_times()
    ordinal = {f.name: f.dataType.simpleString() for f in times.schema["ordinal"].dataType}
    flags = lines.cleaned_notes(feed.notes()).select("trip_id", bit("flagged"))
    on_file = {"trips": feed.trips().join(flags, "trip_id"), "calendar": feed.calendars(), "stop_times": times.select("trip_id", "stop_id", "stop_sequence", bit("pickup"), bit("dropoff"), "ordinal.*")}
    for name, table in on_file.items():
        feed_files.write_table(table, f"{place}/files", name)

    def build_all() -> dict[str, DataFrame]:
        files = feed_files.feed_files(spark, f"{place}/files")
        read = [feed_files.read_table(spark, feed_files.locate(files, name)) for name in on_file]
        return {"patterns": patterns.patterns(*build.pattern_tables(*read, ordinal))}

    return feed_files.built(spark, f"{place}/files", f"{place}/built", build_all)["patterns"]
