"""MinHash near-duplicates by fast similarity sketches; see ``set_links``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.set_links import THREE_WORDS_85, Rule, labelled, similar_links, sketch_of
from headway.llm.shared import NULL_ID, hot_keys, scratch, spread_join, table, written


def text_groups(docs: DataFrame, rule: Rule = THREE_WORDS_85) -> DataFrame:
    """id (NULL_ID for null), digest, size and first for every row of ``docs`` (doc_id, text): ``first`` is the smallest doc_id of its
    component, null if no row of it has one; ``node`` is the component. Equal texts are one node, so rows that share a doc_id but not the text are judged apart,
    and repeated rows together. A text without words is linked with nothing, not even its copies: its node is null."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = written(base.select("id", "digest", sketch_of(rule)("text").alias("s")).select("id", "digest", "s.*"), "sketches")
    worded = rows.where("size > 0")
    alike = worded.groupBy("digest").agg(F.min("id").alias("id"), F.min(F.when(F.col("id") != NULL_ID, F.col("id"))).alias("least"), F.count("*").alias("n"))
    alike = written(alike.withColumn("node", F.monotonically_increasing_id()), "texts-of-rows")  # numbers stay as they are written
    nodes = worded.dropDuplicates(["digest", "id"]).join(alike.select("digest", "id", "node"), ["digest", "id"]).select("node", "size", "bands")
    nodes = written(nodes, "nodes")

    def texts(some: DataFrame) -> DataFrame:
        ends = written(some.join(alike.select("node", "id", "digest"), "node"), "ends")
        return base.join(ends, ["id", "digest"]).dropDuplicates(["node"]).select("node", "text")

    links = similar_links(nodes, texts, rule)
    named = labelled(alike.select("node", "digest", "least", "n"), links)
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    named = written(named.select("component", "digest", "n").join(least, "component"), "components")
    found = spread_join(rows.select("id", "digest", "size"), named.select("digest", F.col("component").alias("node"), "first"), "digest", hot_keys(named, "digest", rows.count()), "left")
    return found


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``.

    A null or empty text, or one of white space only, has no shingle and is its own component. Rows that share a doc_id are
    judged each by its text; repeated rows each have their row. A null doc_id counts as a link like any other, but names
    no component: its component_id is the smallest doc_id that its text reaches, null if there is none, then it is kept."""
    with scratch(spark):
        found = written(text_groups(table(spark, sf_dir, "documents").select("doc_id", "text")), "found", keep=True)
    doc_id = F.when(F.col("id") != NULL_ID, F.col("id"))
    found = found.select(doc_id.alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), doc_id).otherwise(F.col("first")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
