"""Links between 64-bit fingerprints at a Hamming distance of at most tau, by the generalised pigeonhole principle.

The 64 bits are dealt into ``parts`` groups of correlated bits. A fingerprint x gets one threshold t_i >= -1 for each
group, with sum(t_i + 1) = tau + 1: whatever lies within tau of x is then within t_i of x in at least one group i. The
thresholds may differ from group to group and from x to x; a dynamic programme takes those with the fewest estimated
candidates, counted in histograms over all fingerprints. x probes the buckets of all values within t_i of its own, and
what it meets there is verified on all 64 bits, so the links are exact.

A bucket with very many entries is dealt into sub-buckets, each probed: no task holds more than about BLOCK entries.
From the links found in a task's slice only a spanning forest leaves it, never all pairs of a group of copies."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.shared import partitions

BITS = 64
#: Entries of a sub-bucket, about.
BLOCK = 8192
#: Candidate pairs compared at once.
SLICE = 2_000_000
#: Fingerprints on which bit groups are fitted; a bounded sample, the links don't depend on it.
FIT_SAMPLE = 20_000
#: Fingerprints from which one group of bits fewer is used: then a bucket of 64 / 4 bits would hold hundreds of them.
MANY = 1 << 24
#: Weight of a probe against a candidate, in the choice of thresholds.
PROBE_COST = 2.0


def correlated_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bit numbers of ``parts`` groups of nearly equal size: each is grown from the free bit with the greatest absolute
    correlation to all free bits, by the bit most correlated to the group."""
    bits = (sample.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    x = bits.astype(np.float64) - bits.mean(0) if len(sample) else np.zeros((1, BITS))
    scale = np.sqrt((x * x).sum(0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [free[int(np.argmax(corr[np.ix_(free, free)].sum(1)))]]
        free.remove(group[0])
        while len(group) < width:
            group.append(free[int(np.argmax(corr[np.ix_(free, group)].sum(1)))])
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def project(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group``, packed."""
    out = np.zeros(len(fp), dtype=np.int64)
    for at, bit in enumerate(group):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
    return out


def flips(width: int, distance: int) -> np.ndarray:
    """All values of ``width`` bits with exactly ``distance`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), distance)], dtype=np.int64)


def ball_counts(histogram: np.ndarray, width: int, most: int) -> np.ndarray:
    """[t, value]: entries within t of a value, for t from 0 to ``most``."""
    values, out = np.arange(1 << width), [histogram.astype(np.float64)]
    for t in range(1, most + 1):
        out.append(out[-1] + sum(histogram[values ^ f] for f in flips(width, t)))
    return np.array(out)


def thresholds(values: list[np.ndarray], balls: list[np.ndarray], widths: list[int], tau: int) -> np.ndarray:
    """[part, row]: the allocation with the least estimated cost, by dynamic programming over parts and budget."""
    n, budget, parts = len(values[0]), tau + 1, len(values)
    best, picks = np.full((budget + 1, n), np.inf), []
    best[0] = 0
    for v, ball, width in zip(values, balls, widths, strict=True):
        new, pick = best.copy(), np.zeros((budget + 1, n), dtype=np.int8)
        probes = 0
        for t in range(len(ball)):
            probes += len(flips(width, t))
            cost = ball[t][v] + PROBE_COST * probes
            for b in range(t + 1, budget + 1):
                c = best[b - t - 1] + cost
                better = c < new[b]
                new[b][better], pick[b][better] = c[better], t + 1
        best = new
        picks.append(pick)
    out, rest, rows = np.zeros((parts, n), dtype=np.int8), np.full(n, budget), np.arange(n)
    for k in reversed(range(parts)):
        taken = picks[k][rest, rows]
        out[k] = taken - 1
        rest = rest - taken
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b, as stars: every node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        up = np.arange(len(nodes))
        np.minimum.at(up, x, y)
        np.minimum.at(up, y, x)
        while (up[up] != up).any():
            up = up[up]
        root, x, y = up[root], up[x], up[y]
        x, y = x[x != y], y[x != y]
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def linked(bucket: np.ndarray, kind: np.ndarray, fp: np.ndarray, node: np.ndarray, tau: int):
    """Links of complete buckets (rows sorted by bucket, kind): forests (a, b), one for each slice of candidate pairs.
    kind: 0 entry that also probes, 1 entry, 2 probe."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    of = np.cumsum(np.r_[False, bucket[1:] != bucket[:-1]])
    entries = np.add.reduceat((kind < 2).astype(np.int64), starts)
    probes = np.flatnonzero((kind != 1) & (entries[of] > 0))
    counts = entries[of[probes]]
    ends = np.cumsum(counts)
    at = 0
    while at < len(probes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        p, c = probes[at:to], counts[at:to]
        left = np.repeat(p, c)
        right = np.repeat(starts[of[p]] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
        hit = (node[right] < node[left]) & (np.bitwise_count(fp[left] ^ fp[right]) <= tau)
        if hit.any():
            yield forest(node[right[hit]], node[left[hit]])
        at = to


def links(fingerprints: DataFrame, tau: int, parts: int) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs of ``fingerprints`` (node: long, unique; fp: long, unique)
    at a distance of at most ``tau`` do. Rows with a null are left out; an empty input gives no links. From MANY fingerprints
    on there is one group of bits less, and so are there fewer candidates in a bucket; the links don't depend on it."""
    spark = fingerprints.sparkSession
    fps = fingerprints.where("node is not null and fp is not null").select("node", "fp")
    parts = max(3, parts - 1) if fps.count() > MANY else parts
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(FIT_SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    groups = correlated_groups(sample, parts)
    widths = [len(g) for g in groups]

    def count(batches):
        totals = [np.zeros(1 << w, dtype=np.int64) for w in widths]
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k, g in enumerate(groups):
                totals[k] += np.bincount(project(fp, g), minlength=1 << widths[k])
        for k, total in enumerate(totals):
            v = np.flatnonzero(total)
            yield pd.DataFrame({"part": np.full(len(v), k, dtype=np.int32), "value": v, "n": total[v]})

    # at most parts * 2^width rows, whatever the input
    counted = fps.select("fp").mapInPandas(count, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    histograms = []
    for k, w in enumerate(widths):
        own = counted[counted["part"] == k]
        h = np.zeros(1 << w, dtype=np.int64)
        h[own["value"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        histograms.append(h)
    most = max(0, -(-(tau + 1) // parts) - 1) + 1  # a threshold beyond this is never cheaper than an even deal
    tables = spark.sparkContext.broadcast((histograms, [ball_counts(h, w, min(most, tau, w)).astype(np.float32) for h, w in zip(histograms, widths, strict=True)]))

    def emit(batches):
        histograms, balls = tables.value
        for whole in batches:
            for low in range(0, len(whole), 20_000):
                pdf = whole.iloc[low : low + 20_000]
                node, signed = pdf["node"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)
                fp = signed.view(np.uint64)
                values = [project(fp, g) for g in groups]
                allowed = thresholds(values, balls, widths, tau)
                salt = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
                for k, v in enumerate(values):
                    splits = 1 + histograms[k] // BLOCK
                    tagged = lambda value, sub, k=k: ((k << 24 | value) << 24) | sub
                    own = salt % splits[v]
                    yield pd.DataFrame({"bucket": tagged(v, own), "kind": np.where(allowed[k] >= 0, 0, 1).astype(np.int8), "fp": signed, "node": node})
                    for t in range(int(allowed[k].max(initial=-1)) + 1):
                        rows = np.flatnonzero(allowed[k] >= t)
                        for f in flips(widths[k], t):
                            to = v[rows] ^ f
                            there = rows[histograms[k][to] > 0]
                            to = to[histograms[k][to] > 0]
                            n = splits[to]
                            at = np.repeat(there, n)
                            sub = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else np.zeros(0, dtype=np.int64)
                            to = np.repeat(to, n)
                            other = (sub != own[at]) if t == 0 else np.ones(len(at), dtype=bool)
                            if other.any():
                                at = at[other]
                                yield pd.DataFrame({"bucket": tagged(to[other], sub[other]), "kind": np.full(len(at), 2, dtype=np.int8), "fp": signed[at], "node": node[at]})

    def meet(batches):
        open_rows = None
        for pdf in batches:
            rows = [pdf["bucket"].to_numpy(np.int64), pdf["kind"].to_numpy(np.int8), pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy(np.int64)]
            if open_rows is not None:
                rows = [np.concatenate(x) for x in zip(open_rows, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            done = len(rows[0]) if rows[1][-1] == 2 else last  # probes come last: then the bucket's entries are all here
            if done:
                for a, b in linked(*[x[:done] for x in rows], tau):
                    yield pd.DataFrame({"a": a, "b": b})
            open_rows = [x[last:] for x in rows]
            if done > last:
                entries = open_rows[1] < 2
                open_rows = [x[entries] for x in open_rows]
                open_rows[1] = np.ones(len(open_rows[1]), dtype=np.int8)  # they have probed
        if open_rows is not None and len(open_rows[0]):
            for a, b in linked(*open_rows, tau):
                yield pd.DataFrame({"a": a, "b": b})

    emitted = fps.mapInPandas(emit, "bucket long, kind byte, fp long, node long")
    dealt = emitted.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInPandas(meet, "a long, b long").distinct()
