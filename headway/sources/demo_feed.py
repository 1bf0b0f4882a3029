"""A schedule feed derived from the test tables by integer arithmetic, so that its size grows with them.

The raw feed (trips from ``orders``, stop times from ``lineitem``) serves grouping and reports; the network feed (a line for
each LINE_STOPS stops and LEAST_LINES more, two directions each, starting all over the stops) serves journeys and timetables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.operators.feed import calendars

LEAST_LINES, LINE_STOPS = 40, 20
#: Days of each order priority as bits, Monday first.
SERVICE_DAYS = {"1-URGENT": 31, "2-HIGH": 32, "3-MEDIUM": 64, "4-NOT SPECIFIED": 127, "5-LOW": 0}


DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


class DemoFeed:
    """Tables of the feed as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.read = spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def sizes(self) -> DataFrame:
        """One row: n stops, r lines."""
        n = F.count("*")
        return F.broadcast(self.read("supplier").agg(n.alias("n"), (F.lit(LEAST_LINES) + F.floor(n / LINE_STOPS)).alias("r")))

    def stops(self) -> DataFrame:
        """stop_id, name, lat, lon, district."""
        named = self.read("part").select(F.col("p_partkey").alias("stop_id"), F.col("p_name").alias("name"))
        nations = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("district"))
        k = F.col("stop_id")
        stops = self.read("supplier").select(F.col("s_suppkey").alias("stop_id"), "s_nationkey").join(named, "stop_id").join(nations, "s_nationkey")
        return stops.select("stop_id", "name", (F.lit(40.70) + F.lit(0.003) * (k % 20)).alias("lat"), (F.lit(29.85) + F.lit(0.003) * F.floor(k / 20)).alias("lon"), "district")

    def routes(self) -> DataFrame:
        """route_id, route_type, short_name."""
        r = F.col("id").cast("int")
        each = self.sizes().select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)).alias("id"))
        return each.select(r.alias("route_id"), F.when(r % 10 == 0, 0).otherwise(3).alias("route_type"), F.col("id").cast("string").alias("short_name"))

    def calendars(self) -> DataFrame:
        """service_id, days."""
        return self.spark.createDataFrame(sorted(SERVICE_DAYS.items()), "service_id string, days int")

    def trips(self) -> DataFrame:
        """trip_id, route_id, service_id, direction, departure (seconds of the service day)."""
        status = F.col("o_orderstatus")
        return self.read("orders").crossJoin(self.sizes()).select(
            F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % F.col("r")).cast("int").alias("route_id"), F.col("o_orderpriority").alias("service_id"),
            F.when(status == "F", "0").when(status == "O", "1").alias("direction"), (F.col("o_orderkey") * 397 % 100000).alias("departure"),
        )

    def stop_times(self) -> DataFrame:
        """trip_id, stop_id, stop_sequence, ordinal (struct), pickup, dropoff."""
        ordinal = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"), ordinal.alias("ordinal"),
            (F.col("l_returnflag") != "N").alias("pickup"), (F.col("l_quantity") >= 5).alias("dropoff"),
        )

    def network(self) -> DataFrame:
        """pattern_id, route_id, direction, position, stop_id, pickup, dropoff of the network's lines."""
        r = F.col("route_id")
        size = (8 + r % 13).cast("int")
        lines = self.routes().select("route_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).crossJoin(self.sizes())
        at = lines.withColumn("position", F.explode(F.sequence(F.lit(0), size - 1)))
        j: Column = F.when(F.col("d") == 0, F.col("position")).otherwise(size - 1 - F.col("position"))
        start = F.expr("route_id * n div r")
        return at.select(
            (r * 2 + F.col("d")).alias("pattern_id"), "route_id", F.col("d").cast("string").alias("direction"), "position", ((start + (1 + r % 3) * j) % F.col("n")).cast("long").alias("stop_id"),
            ((r + 5 * F.col("position")) % 11 > 0).alias("pickup"), ((r + 3 * F.col("position")) % 13 > 0).alias("dropoff"),
        )

    def departures(self) -> DataFrame:
        """pattern_id, days, departure: distinct departures of the network's patterns on running services."""
        trips = self.trips().where("direction is not null").join(self.calendars(), "service_id").where("days > 0")
        return trips.select((F.col("route_id") * 2 + F.col("direction").cast("int")).alias("pattern_id"), "days", "departure").distinct()

    def dated_departures(self) -> DataFrame:
        """pattern_id, days, departure, start_date, end_date: departures, each valid on the dates of the service of its customer."""
        services = calendars(self.raw_calendar()).select("service_id", "start_date", "end_date")
        owner = self.read("orders").select(F.col("o_orderkey").alias("trip_id"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("service_id"))
        trips = self.trips().where("direction is not null").join(self.calendars(), "service_id").where("days > 0").drop("service_id").join(owner, "trip_id").join(services, "service_id")
        return trips.select((F.col("route_id") * 2 + F.col("direction").cast("int")).alias("pattern_id"), "days", "departure", "start_date", "end_date").distinct()

    def line_trips(self) -> DataFrame:
        """trip_id, route_id, direction, service_id (of the customer, with dates), departure, headsign (some missing), shape_id (none on odd
        lines), missed (last stops of the line that the trip doesn't reach): trips on the network's lines."""
        k, r = F.col("trip_id"), F.col("route_id")
        owner = self.read("orders").select(F.col("o_orderkey").alias("trip_id"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("service_id"))
        trips = self.trips().where("direction is not null").drop("service_id").join(owner, "trip_id")
        sign = F.when(k % 9 == 0, F.concat(F.lit("Express "), r.cast("string"))).when(k % 4 > 0, F.concat(F.lit("Line "), r.cast("string")))
        shape = F.when(r % 2 == 0, r * 4 + F.col("direction").cast("int") * 2 + F.when(k % 5 == 0, 1).otherwise(0)).cast("long")
        return trips.withColumns({"headsign": sign, "shape_id": shape, "missed": F.when(k % 11 == 0, 2).otherwise(0)})

    def line_stop_times(self) -> DataFrame:
        """trip_id, stop_id, stop_sequence, ordinal, pickup, dropoff of the line trips: the stops of their line, but for those missed."""
        size = F.count("*").over(Window.partitionBy("pattern_id"))
        on = self.network().withColumn("size", size).select("route_id", "direction", "position", "stop_id", "pickup", "dropoff", "size")
        met = self.line_trips().select("trip_id", "route_id", "direction", "missed").join(on, ["route_id", "direction"]).where("position < size - missed")
        return met.select("trip_id", "stop_id", F.col("position").alias("stop_sequence"), F.struct("position").alias("ordinal"), "pickup", "dropoff")

    def line_shapes(self) -> DataFrame:
        """shape_id, sequence, lat, lon: two shapes for each pattern of an even line, which differ beside the middles of hops."""
        two = F.explode(F.array(F.lit(0), F.lit(1))).alias("other")
        beside = F.when((F.col("other") == 1) & (F.col("sequence") % 2 == 1), 0.0003).otherwise(0.0)
        return self.shapes().select("*", two).select((F.col("shape_id") * 2 + F.col("other")).cast("long").alias("shape_id"), "sequence", "lat", (F.col("lon") + beside).alias("lon"))

    def journey_requests(self) -> DataFrame:
        """request_id, origin, destination."""
        k = F.col("c_custkey")
        return self.read("customer").crossJoin(self.sizes()).select(k.alias("request_id"), (k % F.col("n")).alias("origin"), ((k * 7 + 3) % F.col("n")).alias("destination"))

    def named_requests(self) -> DataFrame:
        """request_id, origins, destinations: the journey requests between all stops of the names of their ends."""
        named = self.stops().groupBy("name").agg(F.sort_array(F.collect_list("stop_id")).alias("all"))
        sets = self.stops().join(named, "name").select("stop_id", "all")
        asked = self.journey_requests().join(sets.withColumnsRenamed({"stop_id": "origin", "all": "origins"}), "origin")
        return asked.join(sets.withColumnsRenamed({"stop_id": "destination", "all": "destinations"}), "destination").select("request_id", "origins", "destinations")

    def arrival_requests(self) -> DataFrame:
        """request_id, instant, stop_id."""
        return self.read("events").crossJoin(self.sizes()).select(F.col("event_id").alias("request_id"), F.col("ts").alias("instant"), (F.col("user_id") % F.col("n")).alias("stop_id"))

    def notes(self) -> DataFrame:
        """trip_id, note: some end in a colour, some in a sign, some are null."""
        k = F.col("o_orderkey")
        colour = F.concat(F.lit(" #"), F.lower(F.lpad(F.hex(k * 7919 % 16777216), 6, "0")))
        end = F.when(k % 3 == 0, colour).when(k % 3 == 1, " # ").otherwise("")
        return self.read("orders").select(k.alias("trip_id"), F.when(k % 7 > 0, F.concat(F.lit("Depot "), F.col("o_custkey").cast("string"), end)).alias("note"))

    def messages(self) -> DataFrame:
        """request_id, message: requests for a trip in words, some of them incomplete."""
        named = self.stops().select("stop_id", "name")
        asked = self.journey_requests().join(named.withColumnsRenamed({"stop_id": "origin", "name": "a"}), "origin").join(named.withColumnsRenamed({"stop_id": "destination", "name": "b"}), "destination")
        k = F.col("request_id") % 5
        text = (
            F.when(k == 0, F.concat("a", F.lit(" durağından "), "b", F.lit(" durağına gitmek istiyorum.")))
            .when(k == 1, F.concat(F.upper("a"), F.lit(" DURAĞINDAN "), F.upper("b"), F.lit(" DURAĞINA")))
            .when(k == 2, F.concat("a", F.lit(", duragindan: "), "b", F.lit("; duragina?")))
            .when(k == 3, F.concat("a", F.lit(" durağından "), "b"))
        )
        return asked.select("request_id", text.alias("message"))

    def shapes(self) -> DataFrame:
        """shape_id (pattern), sequence, lat, lon for lines of even number: their stops, and a point beside the middle of each hop."""
        at = self.network().where("route_id % 2 = 0").join(self.stops().select("stop_id", "lat", "lon"), "stop_id")
        order = Window.partitionBy("pattern_id").orderBy("position")
        hops = at.select("pattern_id", "position", "lat", "lon", F.lead("lat").over(order).alias("x"), F.lead("lon").over(order).alias("y"))
        here = F.struct((F.col("position") * 2).alias("sequence"), "lat", "lon")
        beside = F.struct((F.col("position") * 2 + 1).alias("sequence"), ((F.col("lat") + F.col("x")) / 2).alias("lat"), ((F.col("lon") + F.col("y")) / 2 + 0.0002).alias("lon"))
        return hops.select(F.col("pattern_id").alias("shape_id"), F.inline(F.array(here, beside))).where("lat is not null")

    def boarding_rules(self) -> DataFrame:
        """rule_id, route_id, direction, landmark, side, span for every third line."""
        r, d = F.col("route_id"), F.col("d")
        lines = self.routes().where("route_id % 3 = 0").select("route_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).crossJoin(self.sizes())
        span = F.element_at(F.array(*map(F.lit, ("before", "through", "from", "after"))), (F.floor(r / 3) % 4 + 1).cast("int"))
        landmark = ((F.expr("route_id * n div r") + 5) % F.col("n")).cast("long").alias("landmark")
        return lines.select((r * 2 + d).alias("rule_id"), "route_id", d.cast("string").alias("direction"), landmark, F.when((r + d) % 2 == 0, "board").otherwise("alight").alias("side"), span.alias("span"))

    def raw_calendar(self) -> DataFrame:
        """A service for each customer, as texts: service_id, monday to sunday, start_date, end_date (some blank, some wrong)."""
        k = F.col("c_custkey")
        days = [F.when(F.expr(f"(c_custkey * 5 + 3 & {1 << d}) <> 0"), "1").otherwise(F.when(k % 3 == 0, "0").otherwise("")).alias(n) for d, n in enumerate(DAYS)]
        date = lambda add: F.date_format(F.expr(f"date_add(date'2024-01-01', cast({add} as int))"), "yyyyMMdd")
        start = F.when(k % 5 == 0, "").otherwise(date("c_custkey % 200")).alias("start_date")
        end = F.when(k % 7 == 0, "").when(k % 11 == 0, "20240231").otherwise(date("200 + c_custkey % 300")).alias("end_date")
        return self.read("customer").select(F.concat(F.lit("S"), k.cast("string")).alias("service_id"), *days, start, end)

    def raw_routes(self) -> DataFrame:
        """A route for each part, as texts: route_id, route_short_name, route_long_name, route_type, route_code."""
        k = F.col("p_partkey")
        kind = F.element_at(F.array(*map(F.lit, ("0", "3", "700", "715", "903", "1", "", "x"))), (k % 8 + 1).cast("int"))
        return self.read("part").select(
            F.when(k % 17 == 0, " ").otherwise(k.cast("string")).alias("route_id"), F.when(k % 3 == 0, "").otherwise(F.concat("p_brand", F.lit(" "))).alias("route_short_name"),
            F.col("p_name").alias("route_long_name"), kind.alias("route_type"), F.when(k % 5 == 0, F.col("p_type")).otherwise("").alias("route_code"),
        )

    def raw_stops(self) -> DataFrame:
        """stop_id, stop_name, stop_lat, stop_lon as texts; some coordinates can't be read, some are out of range."""
        k = F.col("s_suppkey")
        lat = F.when(k % 9 == 0, "?").when(k % 13 == 0, "95.5").otherwise((F.lit(40) + k % 10).cast("string"))
        return self.read("supplier").select(k.cast("string").alias("stop_id"), F.col("s_name").alias("stop_name"), lat.alias("stop_lat"), (F.lit(20) + k % 20).cast("string").alias("stop_lon"))

    def raw_stop_times(self) -> DataFrame:
        """trip_id, stop_sequence, ordinal, departure_time (text; some blank, unpadded or no clock)."""
        k = F.expr("l_orderkey * 7 + l_linenumber")
        part = lambda n: F.lpad((k % n).cast("string"), 2, "0")
        clock = F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(k % 30, F.lit(":5:7"))).when(k % 10 == 2, "24:70:00").when(k % 10 == 3, "8:00").otherwise(F.concat_ws(":", part(30), part(60), part(59)))
        ordinal = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.read("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").cast("string").alias("stop_sequence"), ordinal.alias("ordinal"), clock.alias("departure_time"))

    def stop_queries(self) -> DataFrame:
        """request_id, district, name: names of stops as people type them, some with a letter missing or a word more."""
        k, name = F.col("p_partkey"), F.col("p_name")
        typed = F.when(k % 7 == 3, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100), F.lit(", beside the large old market"))).when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100))).when(k % 4 == 2, F.concat_ws(" ", name, F.lit("durak"))).otherwise(F.col("p_type"))
        nations = self.read("nation").select(F.col("n_nationkey").alias("nation"), "n_name")
        return self.read("part").withColumn("nation", (k % 25).cast("int")).join(nations, "nation").select(k.alias("request_id"), F.when(k % 3 == 0, "").otherwise(F.col("n_name")).alias("district"), typed.alias("name"))


#: The same tables for DuckDB; a query's SQL goes on with ", name AS (...) SELECT ..." or " SELECT ...".
FEED_SQL = """
WITH n AS (SELECT count(*) AS n, 40 + count(*) // 20 AS r FROM supplier),
stops AS (
  SELECT s_suppkey AS stop_id, p_name AS name, 40.70::DOUBLE + 0.003::DOUBLE * (s_suppkey % 20) AS lat,
         29.85::DOUBLE + 0.003::DOUBLE * (s_suppkey // 20) AS lon, n_name AS district
  FROM supplier JOIN part ON p_partkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey),
routes AS (SELECT i AS route_id, CASE WHEN i % 10 = 0 THEN 0 ELSE 3 END AS route_type, i::VARCHAR AS short_name FROM (SELECT unnest(range(r))::INT AS i FROM n)),
calendars AS (SELECT * FROM (VALUES ('1-URGENT', 31), ('2-HIGH', 32), ('3-MEDIUM', 64), ('4-NOT SPECIFIED', 127), ('5-LOW', 0)) t(service_id, days)),
trips AS (
  SELECT o_orderkey AS trip_id, (o_custkey % r)::INT AS route_id, o_orderpriority AS service_id,
         CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' END AS direction, o_orderkey * 397 % 100000 AS departure
  FROM orders, n),
stop_times AS (
  SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_linenumber AS stop_sequence, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_returnflag <> 'N' AS pickup, l_quantity >= 5 AS dropoff
  FROM lineitem),
network AS (
  SELECT route_id * 2 + d AS pattern_id, route_id, d::VARCHAR AS direction, position,
         (route_id * n // r + (1 + route_id % 3) * CASE WHEN d = 0 THEN position ELSE 7 + route_id % 13 - position END) % n AS stop_id,
         (route_id + 5 * position) % 11 > 0 AS pickup, (route_id + 3 * position) % 13 > 0 AS dropoff
  FROM routes, (VALUES (0), (1)) t(d), range(21) u(position), n WHERE position < 8 + route_id % 13),
departures AS (
  SELECT DISTINCT route_id * 2 + direction::INT AS pattern_id, days, departure FROM trips JOIN calendars USING (service_id)
  WHERE direction IS NOT NULL AND days > 0),
journey_requests AS (SELECT c_custkey AS request_id, c_custkey % n AS origin, (c_custkey * 7 + 3) % n AS destination FROM customer, n),
name_sets AS (SELECT stop_id, list_sort(all_stops) AS all_stops FROM stops JOIN (SELECT name, list(stop_id) AS all_stops FROM stops GROUP BY name) USING (name)),
named_requests AS (SELECT request_id, o.all_stops AS origins, d.all_stops AS destinations FROM journey_requests JOIN name_sets o ON o.stop_id = origin JOIN name_sets d ON d.stop_id = destination),
arrival_requests AS (SELECT event_id AS request_id, ts AS instant, user_id % n AS stop_id FROM events, n),
notes AS (
  SELECT o_orderkey AS trip_id, CASE WHEN o_orderkey % 7 > 0 THEN 'Depot ' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN ' #' || lower(lpad(to_hex(o_orderkey * 7919 % 16777216), 6, '0')) WHEN 1 THEN ' # ' ELSE '' END END AS note
  FROM orders),
messages AS (
  SELECT request_id, CASE request_id % 5 WHEN 0 THEN a.name || ' durağından ' || b.name || ' durağına gitmek istiyorum.' WHEN 1 THEN upper(a.name) || ' DURAĞINDAN ' || upper(b.name) || ' DURAĞINA'
    WHEN 2 THEN a.name || ', duragindan: ' || b.name || '; duragina?' WHEN 3 THEN a.name || ' durağından ' || b.name END AS message
  FROM journey_requests JOIN stops a ON a.stop_id = origin JOIN stops b ON b.stop_id = destination),
shape_hops AS (
  SELECT pattern_id, position, lat, lon, lead(lat) OVER w AS x, lead(lon) OVER w AS y FROM network JOIN stops USING (stop_id) WHERE route_id % 2 = 0
  WINDOW w AS (PARTITION BY pattern_id ORDER BY position)),
shapes AS (
  SELECT pattern_id AS shape_id, position * 2 AS sequence, lat, lon FROM shape_hops
  UNION ALL SELECT pattern_id, position * 2 + 1, (lat + x) / 2, (lon + y) / 2 + 0.0002::DOUBLE FROM shape_hops WHERE x IS NOT NULL),
boarding_rules AS (
  SELECT route_id * 2 + d AS rule_id, route_id, d::VARCHAR AS direction, (route_id * n // r + 5) % n AS landmark, CASE WHEN (route_id + d) % 2 = 0 THEN 'board' ELSE 'alight' END AS side,
    ['before', 'through', 'from', 'after'][(route_id // 3 % 4 + 1)::INT] AS span
  FROM routes, (VALUES (0), (1)) t(d), n WHERE route_id % 3 = 0)
"""
