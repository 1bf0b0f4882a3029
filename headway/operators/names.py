"""Stop names: catalogue, search and requests in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import normalised
from headway.operators.name_index import containing


def stop_catalogue(stops: DataFrame, calls: DataFrame) -> DataFrame:
    """name_key, district_key, name, n_platforms of the stops in use; the text is that of the lowest stop."""
    active = stops.join(calls.select("stop_id").distinct(), "stop_id", "left_semi")
    keyed = active.withColumn("name_key", normalised(F.col("name"))).withColumn("district_key", normalised(F.col("district")))
    return keyed.groupBy("name_key", "district_key").agg(F.min_by("name", "stop_id").alias("name"), F.count("*").alias("n_platforms"))


def stop_name_index(stops: DataFrame, calls: DataFrame) -> DataFrame:
    """district_key, name_key, stop_ids (text): sorted stops in use of a name, by district and city-wide ('')."""
    active = stops.join(calls.select("stop_id").distinct(), "stop_id", "left_semi")
    keyed = active.select("stop_id", normalised(F.col("name")).alias("name_key"), normalised(F.col("district")).alias("district_key")).where("name_key <> ''")
    both = keyed.where("district_key <> ''").union(keyed.withColumn("district_key", F.lit("")))
    ids = F.transform(F.array_sort(F.collect_set("stop_id")), lambda x: x.cast("string"))
    return both.groupBy("district_key", "name_key").agg(F.array_join(ids, ",").alias("stop_ids"))


def search(queries: DataFrame, catalogue: DataFrame, limit: int = 12) -> DataFrame:
    """query, rank, name_key, district_key: names that contain the query, those that start with it first. A blank query
    finds all; one of signs only finds none. Queries meet names by a common gram (see ``name_index``)."""
    asked = queries.select("query", normalised(F.col("query")).alias("q"), (F.trim("query") == "").alias("all"))
    first = catalogue.orderBy("name_key", "district_key").limit(limit)  # what every blank query finds
    found = containing(asked.select(F.col("q").alias("part")), catalogue.select(F.col("name_key").alias("whole"))).select(F.col("part").alias("q"), F.col("whole").alias("name_key"))
    met = asked.where("not all").join(found, "q").join(catalogue, "name_key").select("query", "q", "name_key", "district_key")
    met = met.union(asked.where("all").crossJoin(F.broadcast(first)).select("query", "q", "name_key", "district_key"))
    order = Window.partitionBy("query").orderBy(~F.col("name_key").startswith(F.col("q")), "name_key", "district_key")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "name_key", "district_key")


#: The words behind the two names of a trip request, folded; what may stand around a name.
FROM_WORD, TO_WORD, AROUND = "duragindan", "duragina", " .,;:"
LETTERS, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZİĞÜŞÖÇığüşöç", "abcdefghijklmnopqrstuvwxyzigusocigusoc"


def trip_requests(messages: DataFrame) -> DataFrame:
    """request_id, origin_name, destination_name of messages "<stop> durağından <stop> durağına ..." in any case; both null
    unless both names are there. Folding keeps lengths, so places in the folded text are places in the message."""
    folded = F.translate("message", LETTERS, FOLDED)
    at = messages.withColumn("folded", folded).withColumn("a", F.locate(FROM_WORD, F.col("folded")))
    at = at.withColumn("b", F.expr(f"locate('{TO_WORD}', folded, a + {len(FROM_WORD)})"))
    around = F.lit(AROUND)
    origin = F.btrim(F.expr("substring(message, 1, a - 1)"), around)
    destination = F.btrim(F.expr(f"substring(message, a + {len(FROM_WORD)}, b - a - {len(FROM_WORD)})"), around)
    named = at.withColumn("o", F.when(F.col("a") > 0, origin)).withColumn("d", F.when(F.col("b") > 0, destination))
    good = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("o") != "") & (F.col("d") != "")
    return named.select("request_id", F.when(good, F.col("o")).alias("origin_name"), F.when(good, F.col("d")).alias("destination_name"))
