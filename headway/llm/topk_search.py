"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.llm.shared import partitions, table, written

K = 10
SCALE = 1024
#: Rows of a block of candidates, about; and vectors of it held at once as queries.
CANDIDATES, TOGETHER = 32768, 1024
#: Entries read from each list before the first look at the bound; twice as many before each further one.
STEP = 64


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null if the vector is null or a component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.coalesce(bad, F.lit(True)), None).otherwise(whole)


class SortedLists:
    """The rows of a block, and for each dimension their order by that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]  # so that ties go to smaller ids by position
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.most = float(np.abs(self.rows.astype(np.float64)).max(initial=0))
        self.floats = self.rows.astype(np.float64)

    def products(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products as integers; in floating point where all sums are whole numbers below 2^53, so exact."""
        if self.most * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query)) < 2.0**53:
            return (self.floats[at] @ query.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ query

    def top(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows, best first, but for the row with id ``own``; of rows with less than
        ``least`` some or all may be left out.

        Each list is read from the end that the query favours. No row that is still unread can score more than the
        products at the places reached add up to; once that bound is less than the kth score, the rest can't matter
        (at an equal bound it can: a tie goes to the smaller id)."""
        n, dims = self.rows.shape
        seen = self.ids == own
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        used = np.flatnonzero(query)
        if not len(used):
            best = np.flatnonzero(~seen)[:k]
            return best, np.zeros(len(best), dtype=np.int64)
        up = query[used] > 0
        low, step = 0, STEP
        while low < n:
            at = np.arange(low, min(n, low + step))
            read = np.where(up, self.order[n - 1 - at][:, used], self.order[at][:, used])
            hit = np.zeros(n, dtype=bool)
            hit[read] = True
            new = np.flatnonzero(hit & ~seen)
            seen[new] = True
            best, scores = np.r_[best, new], np.r_[scores, self.products(new, query)]
            if len(best) > k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                best, scores = best[scores >= worst], scores[scores >= worst]
            keep = np.lexsort((best, -scores))[:k]
            best, scores = best[keep], scores[keep]
            bound = int((self.rows[read[-1], used] * query[used]).sum())
            if len(best) == k and bound < scores[-1] or least is not None and bound < least or seen.all():
                break
            low, step = low + step, 2 * step
        return best, scores


def block_tops(vectors: DataFrame, queries: DataFrame, k: int):
    """(query_id, vec_id, score): the ``k`` best of each block of ``vectors`` (dims, block, id, vec) for each of ``queries``
    (dims, block, id, vec, least: null, or a score that k rows are known to reach).

    A block's vectors come first and are sorted into lists once; then the queries stream by, so a task holds a block and a
    batch, however many queries there are."""
    columns = ["dims", "block", "asks", "id", "vec", "least"]
    there = vectors.select("dims", "block", F.lit(False).alias("asks"), "id", "vec", F.lit(None).cast("long").alias("least"))
    dealt = there.union(queries.select("dims", "block", F.lit(True).alias("asks"), "id", "vec", "least")).select(columns)

    def meet(batches):
        at, rows, lists = None, [], None
        for whole in batches:
            for low in range(0, len(whole), TOGETHER):
                for key, part in whole.iloc[low : low + TOGETHER].groupby(["dims", "block"]):
                    if key != at:
                        at, rows, lists = key, [], None
                    asks = part["asks"].to_numpy(bool)
                    if not asks.all():
                        own = part[~asks]
                        rows.append((own["id"].to_numpy(np.int64), np.stack(own["vec"].tolist()).astype(np.int64)))
                    if asks.any() and rows:
                        lists = lists or SortedLists(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
                        out = []
                        for own, query, least in part.loc[asks, ["id", "vec", "least"]].itertuples(index=False):
                            place, scores = lists.top(np.asarray(query, dtype=np.int64), own, k, None if pd.isna(least) else int(least))
                            out.append(pd.DataFrame({"query_id": own, "vec_id": lists.ids[place], "score": scores}))
                        yield pd.concat(out)

    n = partitions(vectors.sparkSession)
    sorted_blocks = dealt.repartition(n, "dims", "block").sortWithinPartitions("dims", "block", "asks")
    return sorted_blocks.mapInPandas(meet, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` its k best of ``vectors`` (both: id long, unique; vec:
    array of long), without the row of the same id; fewer if there aren't so many. Only vectors of one length meet.

    Candidates are dealt into blocks by a hash of the id, each held by one task; queries visit every block. They visit the
    first block alone, and take the score of the kth best there along to the others, where lists then end early; rows under it
    go no further. A block's k best of each query go on to the window."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda met: met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    blocks = -(-vectors.count() // CANDIDATES) or 1
    dealt = vectors.select(F.size("vec").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vec")
    asked = queries.select(F.size("vec").alias("dims"), "id", "vec")
    none = F.lit(None).cast("long").alias("least")
    first = block_tops(dealt.where("block = 0"), asked.select("dims", F.lit(0).alias("block"), "id", "vec", none), k)
    if blocks == 1:
        return best(first)
    first = written(first, "first-block")
    known = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    known = known.select("id", F.when(F.col("n") == k, F.col("low")).alias("least"))
    rest = asked.join(known, "id", "left").select("dims", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))).alias("block"), "id", "vec", "least")
    others = block_tops(dealt.where("block > 0"), rest, k).join(known.withColumnRenamed("id", "query_id"), "query_id", "left")
    return best(first.union(others.where("least is null or score >= least").select("query_id", "vec_id", "score")))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 best of ``embeddings`` for each vec_id divisible by 100.

    Rows with a null vec_id take no part; rows that share a vec_id count as one, the smallest vector; empty vectors meet
    only each other, with score 0. Scores are exact while they fit into 64 bits."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vec"))
    vectors = written(vectors.where("id is not null and vec is not null").groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    return top_k(vectors, vectors.where("id % 100 = 0"))
