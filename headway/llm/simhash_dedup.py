"""SimHash near-duplicates: fingerprints in Arrow batches, links by the generalised pigeonhole principle."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from headway.llm import hamming_links
from headway.llm.set_links import FIVE_WORDS_80, labelled, normal_words, similar_links, sketch_of
from headway.llm.shared import NULL_ID, connected_components, flagged, hot_keys, scratch, spread_join, table, written

SEED = 42
#: The link rule of the query: differing bits, words of a shingle, groups of bits (fewer for very many fingerprints).
QUERY_TAU, QUERY_WORDS, QUERY_PARTS = 4, 4, 4
#: Bits and groups of the fingerprints of words, by which the pipeline's stage finds its first candidates.
WORD_TAU, WORD_PARTS = 8, 5


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; a shorter text is one shingle, one without words none."""
    w = normal_words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], dtype=np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=len(w) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).view(">i8")[0])


@F.pandas_udf(LongType())
def shingle_fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([majority(shingle_hashes(t, QUERY_WORDS)) for t in text], dtype="int64")


@F.pandas_udf(LongType())
def word_fingerprint(text: pd.Series) -> pd.Series:
    """Fingerprint of the distinct words: an edit of a word moves one feature, not five."""
    digest = xxhash.xxh64_intdigest
    return pd.Series([majority(np.array([digest(w, SEED) for w in set(normal_words(t))], dtype=np.uint64)) for t in text], dtype="int64")


def components_of(fingerprinted: DataFrame, tau: int, parts: int) -> DataFrame:
    """``fingerprinted`` (doc_id, fp, ...) with component_id: the smallest doc_id reachable over links of at most ``tau``
    bits. Copies of a fingerprint meet once, as the smallest doc_id that has it. A row with a null doc_id belongs to its
    fingerprint's component, and to none (null) if no row with an id has it."""
    reps = written(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "representatives")
    edges = hamming_links.links(reps.drop("n"), tau, parts)
    found = connected_components(edges)
    per_fp = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hot = written(hot_keys(reps, "fp", fingerprinted.count()), "hot")
    return spread_join(fingerprinted, per_fp, "fp", hot)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``documents``.

    Null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Repeated rows
    each have their row. Null doc_ids: see ``components_of``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", shingle_fingerprint("text").alias("fp"))
    found = components_of(written(docs, "fingerprints"), QUERY_TAU, QUERY_PARTS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` (doc_id, text), one row for each doc_id that has it: id (NULL_ID for null), digest, rows, component, and
    whether it ``stays``.

    Two texts link if they are equal, or if their sets of five-word shingles are at least 0.8 similar. Texts without words link to
    nothing but equal texts. Each text is judged by itself, also where several share a doc_id. Of a component the row with
    the smallest doc_id stays (ties: the smaller digest); one without a doc_id only if none has one.

    Fingerprints of the distinct words that differ in at most WORD_TAU bits are compared first; what lies beyond these bits, such as a
    copy with a new paragraph, is found by the bands of ``set_links``, and every link is verified on the full sets."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    prints = base.select("id", "digest", word_fingerprint("text").alias("fp"), sketch_of(FIVE_WORDS_80)("text").alias("s")).select("id", "digest", "fp", "s.*")
    prints = written(prints, "prints")
    rows = written(prints.groupBy("digest", "id").agg(F.count("*").alias("rows")), "rows")
    order = F.struct((F.col("id") == NULL_ID).alias("none"), "id")
    alike = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).select("digest", "first", F.col("first.id").alias("id"), "n")
    alike = written(alike.withColumn("node", F.monotonically_increasing_id()), "alike")  # numbers stay as they are written
    nodes = prints.where("size > 0").dropDuplicates(["digest", "id"]).join(alike.select("digest", "id", "node"), ["digest", "id"])
    nodes = written(nodes.select("node", "size", "bands", "fp"), "nodes")

    def texts(some: DataFrame) -> DataFrame:
        ends = written(some.join(alike.select("node", F.struct("id", "digest").alias("key")), "node"), "ends")
        there = flagged(base.select(F.struct("id", "digest").alias("key"), "text"), ends, "key").where("maybe").drop("maybe")
        return there.join(ends, "key").dropDuplicates(["node"]).select("node", "text")

    reps = written(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "representatives")
    same = spread_join(nodes.select("node", "fp"), reps.select("fp", F.col("node").alias("a")), "fp", hot_keys(reps, "fp", nodes.count()))
    close = hamming_links.links(reps.select("fp", "node"), WORD_TAU, WORD_PARTS)
    close = close.union(same.where("a < node").select("a", F.col("node").alias("b")))
    links = similar_links(nodes.drop("fp"), texts, FIVE_WORDS_80, close)

    named = labelled(alike.select("node", "digest", "first", "n"), links)
    first = F.struct("first", "digest")
    stays = named.groupBy("component").agg(F.min(first).alias("stays"))
    named = written(named.join(stays, "component").select("digest", "component", "stays", "n"), "components")
    found = spread_join(rows, named.drop("n"), "digest", hot_keys(named, "digest", rows.count()))
    return found.select("id", "digest", "rows", "component", ((F.col("stays.digest") == F.col("digest")) & (F.col("stays.first.id") == F.col("id"))).alias("stays"))


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest doc_id stays, see ``near_duplicates``;
    of rows that repeat it with its doc_id and text any one. Rows that can't be among what goes stay where they are; only the others are
    shuffled to meet it."""
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    with scratch(docs.sparkSession):
        marks = near_duplicates(docs.select("doc_id", "text")).where("not stays or rows > 1").select(F.struct("id", "digest").alias("key"), "stays")
        marks = written(marks, "marks", keep=True)
    there = flagged(docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), marks, "key")
    perhaps = there.where("maybe").drop("maybe")
    once = there.where("not maybe").drop("maybe").union(perhaps.join(marks.select("key"), "key", "left_anti"))
    again = marks.where("stays").select("key")
    if not again.isEmpty():  # else these rows aren't shuffled a second time
        once = once.union(perhaps.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return once.select("row.*")
