"""What the timetable of a direction keeps on disk."""

import os

from pyspark.sql import functions as F

from headway.functions import durable, text
from headway.jobs import catalogue
from headway.operators import patterns
from headway.sources.demo_feed import DemoFeed


def test_paths_are_built_once_and_kept_as_files(spark, monkeypatch):
    """Stop times are shuffled for one table, which patterns and trips share; what is kept is Parquet, no checkpoint."""
    built, kept, build = [], [], patterns.trip_paths
    monkeypatch.setattr(patterns, "trip_paths", lambda times: built.append(1) or build(times))
    for at in (catalogue, durable):
        monkeypatch.setattr(at, "durable", lambda df: kept.append(df) or df.checkpoint())
    labelled = catalogue.labelled_trips(DemoFeed(spark, "/root/testdata/sf0.001"))
    assert len(built) == 1 and not kept
    assert all("stored-" in f and os.path.exists(f.removeprefix("file://")) for f in labelled.inputFiles())
    assert labelled.count() == labelled.select("trip_id").distinct().count() == 1184


def test_stored_rows_are_the_same(spark):
    rows = [(1, "a", None, [1, 2]), (2, None, 0.5, []), (None, "ü · ·", -0.0, None)]
    frame = spark.createDataFrame(rows, "k long, t string, x double, l array<int>")
    assert sorted(map(str, durable.stored(frame).collect())) == sorted(map(str, frame.collect()))


def test_signs_of_several_letters_are_found_without_a_pattern(spark):
    signs = ["ﬁ", "Ǆ", "½", "㎏", "ﷺ", "𝟙", "ß", "a", "·", ""]
    got = spark.createDataFrame([(s, f"x · {s}y") for s in signs], "s string, t string").select("t", text.normalised(F.col("t")).alias("k"))
    assert got._jdf.queryExecution().analyzed().toString().count("RLIKE") == 1  # plain texts or others
    want = {f"x · {s}y": " ".join("".join(text.folded(c) for c in f"x · {s}y").split()) for s in signs}
    assert {r.t: r.k for r in got.collect()} == want
