"""Helpers shared by the corpus operators: tables, durable intermediate results, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where rows must be ordered or joined: a null sorts before every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset (tests in
    local mode) a folder of our own is set; on a cluster that would be machine-local, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="headway-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


#: Folders of the tables that the innermost ``scratch`` deletes.
SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, survives lost executors.
    Within ``scratch`` it is deleted at the end, unless ``keep``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep and SCRATCH.get() is not None:
        SCRATCH.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that no later job reads."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        deleted(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` within are deleted at the end; whatever is read later must be written with ``keep``."""
    folders: list[str] = []
    token = SCRATCH.set(folders)
    try:
        yield
    finally:
        SCRATCH.reset(token)
        for folder in folders:
            deleted(spark, folder)


#: A key with more than this part of the rows is joined by broadcast: there are at most so many such keys.
HOT = 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """The keys of ``counts`` (key, n) that hold more than 1 / HOT of ``total`` rows: fewer than HOT rows, so small enough to be
    broadcast whatever the input."""
    return counts.where(F.col("n") * HOT > total).select(key)


def spread_join(rows: DataFrame, found: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``found`` (unique by ``key``). Rows with a key of ``hot`` (see ``hot_keys``) meet it where they are,
    so a key that a third of the rows share is no task's work; only the others are shuffled. how: inner or left."""
    often = F.broadcast(hot.join(found, key, how))
    rare = rows.join(F.broadcast(hot), key, "left_anti").join(found, key, how)
    return rows.join(often, key).unionByName(rare)


#: Words of a filter of ``flagged`` at most (16 MB); beyond 4 * WORDS keys more rows pass that aren't among them.
WORDS = 1 << 20


def flagged(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``maybe``: true for all whose ``key`` is in ``keys``, and for about one in a hundred others. Only these need be shuffled
    to meet ``keys``.

    A blocked Bloom filter is broadcast: a key sets three bits in one of the words of 64, of which there is one for about four keys."""
    words = min(WORDS, 1 << (keys.count() // 4).bit_length())
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(key_hash, {at}) & 63 as int))" for at in (40, 46, 52)))
    hashed = lambda df: df.withColumn("key_hash", F.xxhash64(key)).withColumn("word", F.col("key_hash").bitwiseAND(F.lit(words - 1).cast("long"))).withColumn("mask", mask)
    bits = hashed(keys.select(key)).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    found = hashed(rows).join(F.broadcast(bits), "word", "left")
    return found.select(*rows.columns, F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)).alias("maybe"))


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as ``row``: so these can't clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct("doc_id", *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))


def unboxed(found: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The ``columns`` of boxed rows with a new ``text``; n_chars is counted anew where the text has changed."""
    field = F.col("row").getField
    changed = {"text": F.col("new_text")}
    if "n_chars" in columns:
        counted = F.length("new_text").cast(found.schema["row"].dataType["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("new_text").eqNullSafe(F.col("text")), field("n_chars")).otherwise(counted)
    return found.withColumn("new_text", text).select(*(changed[c].alias(c) if c in changed else field(c).alias(c) for c in columns))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps the pointers twice and contracts the edges, so the
    number of roots at least halves; a round is a handful of shuffles of the edges that are left. The edges of a hub aren't
    gathered in one task, nor anything on the driver. Self-loops and nulls are ignored; an empty input gives an empty result."""
    left = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    left, labels = written(left.distinct(), "edges"), None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"), F.count("*").alias("n"))
        up = written(up.select("node", F.least("node", "up").alias("up"), "n"), "hooks")
        hubs = written(hot_keys(up, "node", left.count()), "hubs")
        up = up.drop("n")
        for _ in range(2):
            next_up = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            up = up.join(next_up, "up").select("node", F.col("over").alias("up"))
        up = written(up, "hooks")
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            moved = up.select(F.col("node").alias("component"), "up")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = written(labels, "labels")
        for end in ("a", "b"):
            left = spread_join(left, up.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")), end, hubs.withColumnRenamed("node", end))
        left = left.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).where("a <> b")
        left = written(left.distinct(), "edges")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return labels
