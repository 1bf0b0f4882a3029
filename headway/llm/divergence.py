"""Divergence between the sources of a language, and of each source from its language, by systolic rotation.

1. Terms are counted where the documents lie; only sums by (lang, source, term) are shuffled.
2. A group's vector is compressed: a base value for the terms it lacks, numbers and values of those it has. The terms of
   a language are dealt into slices, its groups into blocks, so what a task holds is bounded by the two sizes.
3. Blocks stay with their slice. In each round of a round-robin tournament every block is visited by one other: the
   vectors of the higher block travel to the lower one, where both directions are evaluated at once. Then all pairs
   have met, each once.
4. The terms of a group are ranked by heaps local to the tasks; only their heads are shuffled."""

from __future__ import annotations

import heapq
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.llm.shared import deleted, hot_keys, scratch, shared_folder, spread_join, table, written

LEAST_DOCUMENTS, UNIT, PRIOR, TOP = 10, 1_000_000_000, 2, 10
#: Terms of a slice and groups of a block, about: what a task holds at once is a few times their product.
SLICE, BLOCK = 32_768, 16
#: Entries that a task counts before it hands them on.
ENTRIES = 200_000
#: Bytes of terms as they are, A-Z as a-z, all other ASCII as a space: what then lies between spaces is a term.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(batches):
    """Batches of (lang, source, text) -> partial sums (lang, source, term, n, docs); a row with a null term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        out = [(lang, source, None, 0, 0) for lang, source in counts]
        for (lang, source), (n, docs) in counts.items():
            out += [(lang, source, term.decode("utf-8"), k, docs[term]) for term, k in n.items()]
        counts.clear()
        return pd.DataFrame(out, columns=["lang", "source", "term", "n", "docs"])

    held = 0
    for pdf in batches:
        for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            terms, had = text.encode("utf-8").translate(LETTERS).split(b" "), len(n)
            n.update(terms)
            docs.update(set(terms))
            n.pop(b"", None)
            docs.pop(b"", None)
            held += len(n) - had
            if held > ENTRIES:
                yield rows()
                held = 0
    if counts:
        yield rows()


def whole_share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept)), in whole numbers of any size; null without kept terms."""
    big = lambda x: x.cast("decimal(19,0)")
    top = big(n + PRIOR) * F.lit(UNIT).cast("decimal(10,0)")
    under = (total + PRIOR * kept).cast("decimal(38,0)")
    found = F.call_function("div", top.cast("decimal(38,0)"), under) + 1
    return F.when(kept > 0, found.cast("long"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most UNIT + 1, so the square fits into 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def opponents(blocks: int) -> list[list[tuple[int, int]]]:
    """The rounds of a round-robin tournament (circle method) of ``blocks`` blocks: pairs (low, high), each pair in one round."""
    n = blocks + blocks % 2
    seats, out = list(range(n)), []
    for _ in range(n - 1):
        meets = [(seats[k], seats[n - 1 - k]) for k in range(n // 2)]
        out.append([(min(m), max(m)) for m in meets if max(m) < blocks])
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return [meets for meets in out if meets]


def dense(rows: pd.DataFrame, terms: np.ndarray) -> np.ndarray:
    """[group, term]: the values of compressed vectors at ``terms`` (sorted numbers)."""
    out = np.repeat(rows["base"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    for k, (tids, values) in enumerate(zip(rows["tids"], rows["values"], strict=True)):
        out[k, np.searchsorted(terms, np.asarray(tids, dtype=np.int64))] = values
    return out


VALUES = "lang string, source string, item string, value long"


def meeting(home: pd.DataFrame, guest: pd.DataFrame, same: bool) -> pd.DataFrame:
    """Both directions of all pairs of a home and a guest group (``same``: the block meets itself), over one slice of terms."""
    out = []
    if len(home) and len(guest):
        terms = np.unique(np.concatenate([np.asarray(t, dtype=np.int64) for t in (*home["tids"], *guest["tids"])]))
        x, y = dense(home, terms), dense(guest, terms)
        x_base, y_base = home["base"].to_numpy(np.int64), guest["base"].to_numpy(np.int64)
        lacking = int(home["size"].iloc[0]) - len(terms)  # terms that no group here has
        lang, ours, theirs = home["lang"].iloc[0], home["source"].tolist(), guest["source"].tolist()
        for k, source in enumerate(ours):
            from_base = (x_base[k] - y_base) ** 2 // (x_base[k] + y_base)
            values = ((x[k] - y) ** 2 // (x[k] + y)).sum(1) + lacking * from_base
            for other, value in zip(theirs, values.tolist(), strict=True):
                if not same or source < other:
                    out += [(lang, source, other, value), (lang, other, source, value)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def rotation(vectors: DataFrame, blocks: int, where: str) -> DataFrame:
    """(lang, source, item, value) summed over slices, for all ordered pairs of groups of a language. ``vectors``: lang, slice,
    size (terms of the slice), block (under ``blocks``), source, base, tids (sorted), values. The results of the rounds are
    written to the folder ``where``."""
    spark = vectors.sparkSession
    place = ["lang", "slice", "block"]
    vectors.groupBy(place).applyInPandas(lambda pdf: meeting(pdf, pdf, True), VALUES).write.mode("append").parquet(where)
    for meets in opponents(blocks):
        seats = spark.createDataFrame([(high, low) for low, high in meets], "block int, host int")  # half as many as blocks
        guests = vectors.join(F.broadcast(seats), "block").drop("block").withColumnRenamed("host", "block")
        guests = guests.select(*(F.col(c).alias(c) for c in guests.columns))  # columns of their own, else the two sides are ambiguous
        met = vectors.groupBy(place).cogroup(guests.groupBy(place)).applyInPandas(lambda home, guest: meeting(home, guest, False), VALUES)
        met.write.mode("append").parquet(where)
    return spark.read.schema(VALUES).parquet(where).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def local_heads(top: int):
    """Batches of (lang, source, item, value) -> of each group the ``top`` best of this task."""

    def run(batches):
        heaps: dict[tuple[str, str], list] = {}
        for pdf in batches:
            for (lang, source), part in pdf.groupby(["lang", "source"]):
                rows = zip((-part["value"]).tolist(), [t.encode("utf-8") for t in part["item"]], strict=True)
                heaps[lang, source] = heapq.nsmallest(top, [*heaps.get((lang, source), []), *rows])
        out = [(lang, source, item.decode("utf-8"), -value) for (lang, source), heap in heaps.items() for value, item in heap]
        if out:
            yield pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    return run


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, slice_terms: int = SLICE, block_groups: int = BLOCK) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank for ``docs`` (lang, source, text), nulls read as ''.

    pair: the divergence of the group's term shares from each other source's of its language, all ranks. term: the terms
    that set a group off most from its language, ``top`` of them. Every row counts as a document, repeated ones too; a
    group without kept terms has pairs; a language of one source has none. Ties go to the item first in UTF-8."""
    spark = docs.sparkSession
    where = f"{shared_folder(spark).rstrip('/')}/meetings-{uuid.uuid4().hex}"
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with scratch(spark):
        sums = text.mapInPandas(count_terms, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counts = written(sums, "counts")
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        kept = written(kept.select("lang", "term", "in_lang", F.monotonically_increasing_id().alias("tid")), "kept")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
        there = written(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang", "tid"), "there")
        totals = there.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("group_n", "v", "lang_n")), number.alias("number"))
        groups = written(groups.withColumn("block", F.expr(f"int(number div {block_groups})")).withColumn("slices", F.greatest(F.ceil(F.col("v") / slice_terms), F.lit(1)).cast("int")), "groups")

        hot = written(hot_keys(there.groupBy("lang", "source").agg(F.count("*").alias("n")).select(F.struct("lang", "source").alias("group"), "n"), "group", there.count()), "hot")
        of_group = groups.select(F.struct("lang", "source").alias("group"), "group_n", "v", "lang_n", "block", "slices")
        shares = spread_join(there.withColumn("group", F.struct("lang", "source")), of_group, "group", hot)
        shares = shares.select("lang", "source", "block", "term", "tid", F.pmod(F.xxhash64("tid"), F.col("slices")).cast("int").alias("slice"),
                               whole_share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), whole_share(F.col("in_lang"), F.col("lang_n"), F.col("v")).alias("q"))
        shares = written(shares, "shares")

        sizes = shares.select("lang", "slice", "tid").distinct().groupBy("lang", "slice").agg(F.count("*").alias("size"))
        pairs = shares.groupBy("lang", "source", "slice").agg(F.array_sort(F.collect_list(F.struct("tid", "p"))).alias("has"))  # a slice of a group
        every = groups.select("lang", "source", "block", whole_share(F.lit(0), F.col("group_n"), F.col("v")).alias("base"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        vectors = every.join(sizes, ["lang", "slice"], "left").join(pairs, ["lang", "source", "slice"], "left")
        empty = F.expr("cast(array() as array<bigint>)")
        vectors = written(vectors.select("lang", "slice", F.coalesce("size", F.lit(0).cast("long")).alias("size"), "block", "source", F.coalesce("base", F.lit(1).cast("long")).alias("base"),
                                         F.coalesce("has.tid", empty).alias("tids"), F.coalesce("has.p", empty).alias("values")), "vectors")
        blocks = (groups.agg(F.max("block")).first()[0] or 0) + 1
        met = rotation(vectors, blocks, where)
        best = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).mapInPandas(local_heads(top), VALUES)
        found = met.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        found = found.withColumn("rank", rank).where(f"part = 'pair' or rank <= {top}").select("lang", "source", "part", "item", "value", "rank")
        found = written(found, "divergences", keep=True)
    deleted(spark, where)
    return found


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all of ``documents``; see ``divergences``."""
    return divergences(table(spark, sf_dir, "documents").select("lang", "source", "text"))
