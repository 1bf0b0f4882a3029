"""Line catalogue, variants and timetables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import normalised
from headway.operators.name_index import containing


def named_catalogue(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """route_id, code, name, mode, rank of the routes (see ``feed.routes``) that have trips: numeric codes first, by number, then by
    code, name and id. The name is the long one, else the short one, else the id."""
    used = routes.join(trips.select("route_id").distinct(), "route_id", "left_semi")
    name = F.coalesce("long_name", "short_name", F.col("route_id").cast("string"))
    number = F.when(F.col("code").rlike(r"^\d+$"), F.col("code").try_cast("decimal(38,0)"))
    coded = used.select("route_id", F.col("public_code").alias("code"), name.alias("name"), "mode")
    return coded.withColumn("rank", F.row_number().over(Window.orderBy(number.isNull(), number, "code", "name", "route_id")))  # a row for each line


def line_catalogue(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """route_id, code, mode, rank of the routes that have trips: numeric codes first, by number, then by code."""
    used = routes.join(trips.select("route_id").distinct(), "route_id", "left_semi")
    tram = (F.col("route_type") == 0) | F.col("route_type").between(900, 906)
    coded = used.select("route_id", F.trim("short_name").alias("code"), F.when(tram, "tram").otherwise("bus").alias("mode"))
    number = F.when(F.col("code").rlike(r"^\d+$"), F.col("code").try_cast("int"))
    rank = F.row_number().over(Window.orderBy(number.isNull(), number, "code", "route_id"))  # a row for each line
    return coded.withColumn("rank", rank)


def variants(patterns: DataFrame) -> DataFrame:
    """variant_id (lowest pattern id), route_id, direction, stops, n_patterns, n_stops, origin, destination: patterns of one
    path and one set of permissions, whatever their days."""
    parts = F.split("stops", "-")
    grouped = patterns.groupBy("route_id", "direction", "stops", "pickups", "dropoffs").agg(F.min("pattern_id").alias("variant_id"), F.count("*").alias("n_patterns"))
    ends = [F.size(parts).alias("n_stops"), F.element_at(parts, 1).cast("long").alias("origin"), F.element_at(parts, -1).cast("long").alias("destination")]
    return grouped.select("variant_id", "route_id", "direction", "stops", "n_patterns", *ends)


VARIANT = ["route_id", "direction", "shape_id", "stops", "pickups", "dropoffs"]


def drawn_variants(patterns: DataFrame, stops: DataFrame) -> DataFrame:
    """variant_id (lowest pattern id), VARIANT, n_patterns, n_plain, n_stops, name, option: patterns (with shape_id and headsigns) of one
    path, shape and set of permissions, whatever their days. The name is that of the first pattern's headsigns, else of the last
    stop (stops: stop_id, name; null if unknown); option: its place among those of its route and direction, from 1."""
    first = F.min_by("headsigns", "pattern_id").alias("headsigns")
    grouped = patterns.groupBy(*VARIANT).agg(F.min("pattern_id").alias("variant_id"), F.count("*").alias("n_patterns"), F.sum("n_plain").alias("n_plain"), first)
    parts = F.split("stops", "-")
    last = stops.select(F.col("stop_id").alias("last"), F.col("name").alias("last_name"))
    told = grouped.withColumn("last", F.element_at(parts, -1).cast("long")).join(last, "last", "left")
    name = F.coalesce(F.nullif(F.array_join("headsigns", " / "), F.lit("")), "last_name")
    alone = F.when(F.col("direction").isNull(), F.col("variant_id"))
    option = F.row_number().over(Window.partitionBy("route_id", "direction", alone).orderBy("variant_id"))
    return told.select("variant_id", *VARIANT, "n_patterns", "n_plain", F.size(parts).alias("n_stops"), name.alias("name"), option.alias("option"))


def variant_trips(trips: DataFrame, paths: DataFrame, variants: DataFrame) -> DataFrame:
    """``trips`` (trip_id, route_id, direction, shape_id, ...) with variant_id; paths: of ``patterns.trip_paths``. Trips meet their
    variant by a hash of its path."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    key = F.sha2(F.concat_ws("|", *map(text, VARIANT)), 256).alias("path")
    runs = trips.join(paths, "trip_id").select(*trips.columns, key)
    return runs.join(variants.select("variant_id", key), "path").drop("path")


def variant_timetables(trips: DataFrame, services: DataFrame) -> DataFrame:
    """variant_id, service_id, days, start_date, end_date, n_trips, n_departures, departures (distinct, ascending, comma-joined seconds): the
    timetable of each variant and service. trips: variant_id, service_id, departure (null: counted as a trip alone); services:
    service_id, days, start_date, end_date (null: open). Trips of an unknown service have none."""
    grouped = trips.groupBy("variant_id", "service_id").agg(F.count("*").alias("n_trips"), F.array_sort(F.collect_set("departure")).alias("at"))
    told = F.array_join(F.transform("at", lambda t: t.cast("string")), ",").alias("departures")
    return grouped.join(services, "service_id").select("variant_id", "service_id", "days", "start_date", "end_date", "n_trips", F.size("at").alias("n_departures"), told)


def reference_variants(found: DataFrame, trips_of: DataFrame) -> DataFrame:
    """route_id, direction, variant_id, n_plain, n_stops: of each route and direction the variant with the most trips without a
    flag, then the most stops, then the lowest id; without a direction every variant is its own group."""
    group = F.when(F.col("direction").isNull(), F.col("variant_id"))
    order = Window.partitionBy("route_id", "direction", "grp").orderBy(F.desc("n_plain"), F.desc("n_stops"), "variant_id")
    ranked = found.join(trips_of, "variant_id").withColumn("grp", group).withColumn("at", F.row_number().over(order))
    return ranked.where("at = 1").select("route_id", "direction", "variant_id", "n_plain", "n_stops")


def timetable(departures: DataFrame) -> DataFrame:
    """pattern_id, days, n_departures, first, last: distinct departures of each pattern and set of days."""
    return departures.groupBy("pattern_id", "days").agg(F.countDistinct("departure").alias("n_departures"), F.min("departure").alias("first"), F.max("departure").alias("last"))


def day_categories(departures: DataFrame) -> DataFrame:
    """pattern_id, category, days_covered (bits), n_departures for weekdays, Saturday and Sunday."""
    masks = F.array(*(F.struct(F.lit(n).alias("category"), F.lit(m).alias("mask")) for n, m in (("weekday", 31), ("saturday", 32), ("sunday", 64))))
    each = departures.withColumn("c", F.explode(masks)).withColumn("covered", F.col("days").bitwiseAND(F.col("c.mask"))).where("covered <> 0")
    return each.groupBy("pattern_id", "c.category").agg(F.bit_or("covered").alias("days_covered"), F.countDistinct("departure").alias("n_departures"))


def cleaned_notes(notes: DataFrame) -> DataFrame:
    """trip_id, flagged, note: a note that ends in a colour (#rrggbb) flags its trip; colour, signs # and blanks at the end
    go. A null or empty note gives null."""
    text = F.rtrim(F.coalesce("note", F.lit("")))
    flagged = text.rlike("#[0-9A-Fa-f]{6}$")
    bare = F.regexp_replace(F.regexp_replace(text, "#[0-9A-Fa-f]{6}$", ""), "[# ]+$", "")
    return notes.select("trip_id", flagged.alias("flagged"), F.nullif(F.trim(bare), F.lit("")).alias("note"))


def variant_conditions(variants: DataFrame, references: DataFrame) -> DataFrame:
    """variant_id, reference_id, condition, detail (the last stop, or ''): how a variant differs from the reference of its route and direction:
    only_to (its path is a beginning of the reference's), last_stop, other_route, other_permissions, or null.

    variants: variant_id, route_id, direction, stops, pickups, dropoffs; references: the variant_id of the references. With ``drawn``
    (what tells its path on the map, null if it has none to use) and ``option`` a variant of the same stops by another path is
    other_line, or other_line_and_permissions, and the option is the detail of other routes and lines."""
    chosen = variants.join(references.select("variant_id"), "variant_id", "left_semi")
    names = {"variant_id": "reference_id", "route_id": "to_route", "direction": "to_direction", "stops": "to_stops", "pickups": "to_pickups", "dropoffs": "to_dropoffs"}
    some = "drawn" in variants.columns
    if some:
        names["drawn"] = "to_drawn"
    sides = chosen.select(*(F.col(a).alias(b) for a, b in names.items()))
    own = F.col("direction").isNull() & (F.col("variant_id") == F.col("reference_id"))
    met = variants.join(sides, (F.col("route_id") == F.col("to_route")) & F.col("direction").eqNullSafe(F.col("to_direction"))).where(F.col("direction").isNotNull() | own)
    last = lambda c: F.element_at(F.split(c, "-"), -1).cast("long")
    same = F.col("stops") == F.col("to_stops")
    condition = (
        F.when(~same & F.startswith("to_stops", F.concat("stops", F.lit("-"))), "only_to").when(~same & (last("stops") != last("to_stops")), "last_stop")
        .when(~same, "other_route").when((F.col("pickups") != F.col("to_pickups")) | (F.col("dropoffs") != F.col("to_dropoffs")), "other_permissions")
    )
    detail = F.when(condition.isin("only_to", "last_stop"), last("stops").cast("string"))
    if some:
        apart = same & (F.col("drawn") != F.col("to_drawn"))
        condition = F.when(apart & (condition == "other_permissions"), "other_line_and_permissions").when(apart, "other_line").otherwise(condition)
        detail = detail.when(condition.isin("other_route", "other_line", "other_line_and_permissions"), F.col("option").cast("string"))
    detail = detail.otherwise("")
    return met.select("variant_id", "reference_id", condition.alias("condition"), detail.alias("detail"))


def restrictions(patterns: DataFrame) -> DataFrame:
    """pattern_id, position, label: stops of a pattern where one can't board, can't alight, or neither."""
    at = patterns.select("pattern_id", "pickups", "dropoffs", F.explode(F.sequence(F.lit(0), F.length("pickups") - 1)).alias("position"))
    no = lambda column, label: F.when(F.expr(f"substring({column}, position + 1, 1)") == "0", label)
    return at.select("pattern_id", "position", F.concat_ws(", ", no("pickups", "no boarding"), no("dropoffs", "no alighting")).alias("label")).where("label <> ''")


def line_search(queries: DataFrame, lines: DataFrame, limit: int = 40) -> DataFrame:
    """query, place, route_id: lines (route_id, code, mode, rank) whose code and mode contain the query, or, where lines have a
    name, whose code and name do; codes that start with it first, then in the order of the catalogue."""
    told = "name" if "name" in lines.columns else "mode"
    asked = queries.select("query", normalised(F.col("query")).alias("q")).where("q <> ''")
    named = lines.select("route_id", "rank", normalised(F.col("code")).alias("code_key"), normalised(F.concat_ws(" ", "code", told)).alias("line_key"))
    found = containing(asked.select(F.col("q").alias("part")), named.select(F.col("line_key").alias("whole"))).select(F.col("part").alias("q"), F.col("whole").alias("line_key"))
    met = asked.join(found, "q").join(named, "line_key")
    order = Window.partitionBy("query").orderBy(~F.col("code_key").startswith(F.col("q")), "rank")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query", "place", "route_id")
