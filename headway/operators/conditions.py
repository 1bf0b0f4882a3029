"""What sets single trips of a line apart, and the timetable of a direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import normalised


def common_value(trips: DataFrame, references: DataFrame, column: str) -> DataFrame:
    """reference_id, value: of each reference variant's trips without a flag (of all, if each has one) the most frequent
    ``column``, normalised; a missing one counts as '', ties go to the one that the smallest trip has. trips: trip_id, variant_id,
    flagged, the column."""
    own = trips.join(references.select(F.col("variant_id")).distinct(), "variant_id", "left_semi").withColumn("value", normalised(F.coalesce(column, F.lit(""))))
    counted = own.groupBy("variant_id", "value").agg(F.sum(F.when(~F.col("flagged"), 1).otherwise(0)).alias("plain"), F.count("*").alias("n"),
                                                     F.min(F.when(~F.col("flagged"), F.col("trip_id"))).alias("first_plain"), F.min("trip_id").alias("first"))
    some = F.max("plain").over(Window.partitionBy("variant_id")) > 0
    ranked = counted.withColumn("some", some).where(~F.col("some") | (F.col("plain") > 0))
    order = F.struct((-F.when(F.col("some"), F.col("plain")).otherwise(F.col("n"))).alias("n"), F.when(F.col("some"), F.col("first_plain")).otherwise(F.col("first")).alias("first"))
    return ranked.groupBy(F.col("variant_id").alias("reference_id")).agg(F.min_by("value", order).alias("value"))


def common_notes(trips: DataFrame, references: DataFrame) -> DataFrame:
    """reference_id, common (the normalised note of most trips) and, if ``trips`` have headsigns, common_headsign."""
    found = common_value(trips, references, "note").withColumnRenamed("value", "common")
    if "headsign" in trips.columns:
        found = found.join(common_value(trips, references, "headsign").withColumnRenamed("value", "common_headsign"), "reference_id")
    return found


def trip_conditions(trips: DataFrame, differences: DataFrame, common: DataFrame) -> DataFrame:
    """``trips`` (trip_id, variant_id, flagged, note, ...) with ``label``: the trip's own note, if flagged or not the common
    one (compared normalised), then how its path differs from the reference's, then its headsign if there is one that is not the
    common one (only if ``trips`` have such a column); '' if nothing sets it apart. differences: variant_id, reference_id,
    condition, detail."""
    met = trips.join(differences, "variant_id").join(common, "reference_id", "left")
    own = F.when((F.col("note") != "") & (F.col("flagged") | (normalised(F.col("note")) != F.coalesce("common", F.lit("")))), F.col("note"))
    path = F.when(F.col("condition").isNotNull(), F.trim(F.concat_ws(" ", F.translate("condition", "_", " "), "detail")))
    sign = F.lit(None).cast("string")
    if "headsign" in trips.columns:
        sign = F.when((F.col("headsign") != "") & (normalised(F.col("headsign")) != F.coalesce("common_headsign", F.lit(""))), F.concat(F.lit("headsign "), "headsign"))
    return met.withColumn("label", F.concat_ws(" · ", own, path, sign)).select(*trips.columns, "label")


def condition_ids(labelled: DataFrame) -> DataFrame:
    """route_id, side, label, condition_id: labels of a route and direction (side: '' without one), numbered by first use. Labels
    that are equal when normalised are one, told as it is first used."""
    used = labelled.where("label <> ''").groupBy("route_id", F.coalesce("direction", F.lit("")).alias("side"), normalised(F.col("label")).alias("key"))
    first = used.agg(F.min(F.struct("departure", "trip_id", "label")).alias("first"))
    return first.select("route_id", "side", "first.label", F.row_number().over(Window.partitionBy("route_id", "side").orderBy("first")).alias("condition_id"))


def direction_timetable(labelled: DataFrame, ids: DataFrame) -> DataFrame:
    """route_id, side, service_id, place, departure, condition_id (0: none), variant_id, trip_id: trips of a direction on a
    service by time, variant and condition; of those equal in all three the last trip stays."""
    known = ids.select("route_id", "side", normalised(F.col("label")).alias("key"), "condition_id", F.lit(True).alias("set_apart"))
    sided = labelled.withColumn("side", F.coalesce("direction", F.lit(""))).withColumn("key", normalised(F.col("label"))).withColumn("set_apart", F.col("label") != "")
    sided = sided.join(known, ["route_id", "side", "key", "set_apart"], "left")
    sided = sided.withColumn("condition_id", F.coalesce("condition_id", F.lit(0)))
    once = sided.groupBy("route_id", "side", "service_id", "departure", "condition_id", "variant_id").agg(F.max("trip_id").alias("trip_id"))
    place = F.row_number().over(Window.partitionBy("route_id", "side", "service_id").orderBy("departure", "variant_id", "condition_id"))
    return once.withColumn("place", place)
