"""Removal of byte strings that repeat: a suffix sort whose comparisons are by prefix hashes.

Every window of ``window`` bytes has one anchor: the leftmost of its ``GRAM``-byte grams with the smallest hash. Equal
windows have equal anchors at equal offsets, so whatever repeats meets at its anchor's hash, and only one position in
about 35 takes part. The windows of an anchor are a stretch of the document.

1. Anchors are found in Arrow batches. Of anchors of one task whose stretches are equal (two hashes of the stretch, one of
   them polynomial and one, XXH3, that has nothing in common with it; its window offsets) only the earliest goes on; the windows of the others repeat, and go on as removed stretches.
2. Anchors meet by hash. Equal stretches repeat as before. Where different stretches have one anchor, the earliest of
   each asks for its bytes.
3. These stretches are cut from the documents, meet by the anchor's hash and are sorted as suffixes, forwards and
   backwards from the anchor: a mergesort, in which prefix polynomial hashes and binary search give the common extension
   of two suffixes in a logarithmic number of steps. Neighbours are verified byte by byte. Two windows at offset a are
   equal if no common extension between them is shorter than a bytes backwards and ``window - a`` forwards.
4. Removed stretches meet their document."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from headway.llm.shared import NULL_ID, boxed, flagged, partitions, table, unboxed, written

WINDOW = 100
GRAM = 32
#: Bytes of text hashed at once.
BUFFER = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
POSITION = np.uint64((1 << 24) - 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads polynomial hashes over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from the running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Hasher:
    """Powers for texts of up to ``n`` bytes, kept between batches."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = max(len(data) + 1, 2 * len(self.up))
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher, window: int):
    """Of the texts data[starts:ends]: text number, first window, last window, anchor (all but the first as positions in
    data), hash of the anchor's gram and of the stretch from the first window's start to the last one's end."""
    prefix = hasher.prefixes(data)
    n = len(data)
    grams = np.arange(n - GRAM + 1)
    key = hasher.hashes(prefix, grams, grams + GRAM)
    ranked = (key & ~POSITION) | grams.astype(np.uint64)
    at = (sliding_min(ranked, window - GRAM + 1) & POSITION).astype(np.int64)
    first = np.arange(len(at))
    text = np.repeat(np.arange(len(starts)), ends - starts)
    inside = text[: len(at)] == text[window - 1 :]
    first, at, of = first[inside], at[inside], text[: len(inside)][inside]
    if not len(first):
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    new = np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])]
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], len(first)] - 1
    low, high, anchor = first[lo], first[hi], at[lo]
    return of[lo], low, high, anchor, key[anchor], hasher.hashes(prefix, low, high + window)


ANCHORS = "gram long, stretch long, check long, before int, after int, id long, version long, start int"
#: What equal stretches have in common.
SAME = ["gram", "stretch", "check", "before", "after"]


def find_anchors(window: int):
    """Batches of (id, version, body) -> rows of ANCHORS. before, after: offset of the anchor in the first and the last
    window. Rows with after = -1 are removed stretches instead: start, and in ``before`` their length; their gram is
    random, for an even spread."""

    def run(batches):
        hasher = Hasher()
        for pdf in batches:
            ids, versions, bodies = pdf["id"].to_numpy(np.int64), pdf["version"].to_numpy(np.int64), pdf["body"].tolist()
            at, parts = 0, []
            while at < len(bodies):
                to, size = at, 0
                while to < len(bodies) and (to == at or size + len(bodies[to]) <= BUFFER):
                    size += len(bodies[to])
                    to += 1
                parts.append(stretch_table(bodies[at:to], ids[at:to], versions[at:to], hasher, window))
                at = to
            found = pd.concat([p for p in parts if p is not None]) if any(p is not None for p in parts) else None
            if found is None or found.empty:
                continue
            order = np.lexsort([found[c] for c in ("start", "version", "id", *SAME[::-1])])
            found = found.iloc[order]
            same = np.logical_and.reduce([(v := found[c].to_numpy())[1:] == v[:-1] for c in SAME])
            again = np.r_[False, same]
            yield found[~again]
            gone = found[again]
            if len(gone):
                yield removed(gone, window)

    return run


def stretch_table(bodies, ids, versions, hasher, window) -> pd.DataFrame | None:
    """ANCHORS rows of some texts; a text longer than POSITION is cut into overlapping pieces, so that no window is lost."""
    step = int(POSITION) - 2 * window
    cuts = [(k, s, b[s : s + step + window]) for k, b in enumerate(bodies) for s in range(0, max(1, len(b) - window + 1), step + 1) if len(b) >= window]
    if not cuts:
        return None
    sizes = np.array([len(c[2]) for c in cuts])
    ends = np.cumsum(sizes)
    if ends[-1] > int(POSITION):
        return pd.concat([x for c in cuts if (x := stretch_part([c], ids, versions, hasher, window)) is not None])
    return stretch_part(cuts, ids, versions, hasher, window)


def stretch_part(cuts, ids, versions, hasher, window) -> pd.DataFrame:
    joined = b"".join(c[2] for c in cuts)
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(c[2]) for c in cuts])
    starts = np.r_[0, ends[:-1]]
    of, low, high, anchor, gram, stretch = anchors(data, starts, ends, hasher, window)
    digest, view = xxhash.xxh3_64_intdigest, memoryview(joined)
    check = np.fromiter((digest(view[s:e]) for s, e in zip(low.tolist(), (high + window).tolist(), strict=True)), dtype=np.uint64, count=len(low))
    text, shift = np.array([c[0] for c in cuts])[of], np.array([c[1] for c in cuts])[of] - starts[of]
    return pd.DataFrame(
        {"gram": gram.view(np.int64), "stretch": stretch.view(np.int64), "check": check.view(np.int64), "before": (anchor - low).astype(np.int32), "after": (anchor - high).astype(np.int32),
         "id": ids[text], "version": versions[text], "start": (low + shift).astype(np.int32)}
    )


def removed(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Removed stretches in the form of ANCHORS; those of a document that touch are joined."""
    rows = rows.sort_values(["id", "version", "start"])
    ids, versions, start = rows["id"].to_numpy(), rows["version"].to_numpy(), rows["start"].to_numpy().astype(np.int64)
    end = start + (rows["before"] - rows["after"]).to_numpy() + window
    new = np.r_[True, (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]) | (start[1:] > end[:-1])]
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], len(ids)] - 1
    gram = mixed(start[lo].astype(np.uint64) ^ ids[lo].view(np.uint64)).view(np.int64)
    return pd.DataFrame(
        {"gram": gram, "stretch": np.int64(0), "check": np.int64(0), "before": (end[hi] - start[lo]).astype(np.int32), "after": np.int32(-1), "id": ids[lo], "version": versions[lo], "start": start[lo].astype(np.int32)}
    )


def meet_anchors(window: int):
    """Sorted batches of ANCHORS -> removed stretches (after = -1), and requests: the earliest of each stretch whose gram
    different stretches share. A repeated row (equal id, version and start) is one."""

    def complete(rows: pd.DataFrame):
        gone = rows["after"].to_numpy() == -1
        if gone.any():
            yield rows[gone]
            rows = rows[~gone]
        if rows.empty:
            return
        columns = [rows[c].to_numpy() for c in (*SAME, "id", "version", "start")]
        order = np.lexsort(columns[::-1])
        *alike, ids, version, start = (c[order] for c in columns)
        gram = alike[0]
        rows = rows.iloc[order]
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in alike])]
        repeated = ~new & np.r_[False, (ids[1:] == ids[:-1]) & (version[1:] == version[:-1]) & (start[1:] == start[:-1])]
        if (~new & ~repeated).any():
            yield removed(rows[~new & ~repeated], window)
        group = np.cumsum(new_gram) - 1
        kinds = np.bincount(group[new])
        asks = new & (kinds[group] > 1)
        if asks.any():
            yield rows[asks]

    def run(batches):
        open_rows = None
        for pdf in batches:
            rows = pdf if open_rows is None else pd.concat([open_rows, pdf])
            if rows.empty:
                continue
            last = int(np.searchsorted(rows["gram"].to_numpy(), rows["gram"].iloc[-1]))
            yield from complete(rows.iloc[:last]) if last else ()
            open_rows = rows.iloc[last:]
        if open_rows is not None and len(open_rows):
            yield from complete(open_rows)

    return run


def common_extension(prefix: np.ndarray, down: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes x and y (rows of prefix hashes, from ``start`` on), by binary search."""
    low, high = np.zeros(len(x), dtype=np.int64), np.minimum(size[x], size[y])
    width = prefix.shape[1]
    flat = prefix.ravel()
    bx, by = x * width + start[x], y * width + start[y]
    hx, hy = flat[bx], flat[by]
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = (flat[bx + mid] - hx) * down[start[x]] == (flat[by + mid] - hy) * down[start[y]]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_sort(matrix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``matrix`` (bytes, the first ``size`` of each row count), and each row's common prefix with
    the row before it in that order.

    Bottom-up mergesort: the rank of a row in the neighbouring run is found by binary search, all rows of a pass at once;
    rows are compared by their common extension (prefix hashes, binary search) and the byte behind it. Neighbours in the
    result are compared byte by byte; should a hash collision have misled the sort, the rows are sorted by their bytes."""
    n, width = matrix.shape
    up = powers(BASE, width + 1)
    prefix = np.zeros((n, width + 1), dtype=np.uint64)
    np.cumsum((matrix.astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, out=prefix[:, 1:])
    down, zero = powers(INVERSE, 1), np.zeros(n, dtype=np.int64)
    padded = np.zeros((n, width + 1), dtype=np.int16)
    padded[:, :width] = np.where(np.arange(width) < size[:, None], matrix.astype(np.int16) + 1, 0)

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        k = common_extension(prefix, down, x, y, zero, size)
        a, b = padded[x, k], padded[y, k]
        return (a < b) | ((a == b) & or_equal)

    order, run = np.arange(n), 1
    place = np.arange(n)
    while run < n:
        base = place // (2 * run) * (2 * run)
        in_left = place - base < run
        other_lo = np.where(in_left, np.minimum(base + run, n), base)
        other_hi = np.where(in_left, np.minimum(base + 2 * run, n), np.minimum(base + run, n))
        low, high = other_lo.copy(), other_hi.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) >> 1
            goes_first = less(order[mid], order[active], ~in_left[active])
            low[active] = np.where(goes_first, mid + 1, low[active])
            high[active] = np.where(goes_first, high[active], mid)
            active = active[low[active] < high[active]]
        to = base + (place - np.where(in_left, base, base + run)) + (low - other_lo)
        merged = np.empty(n, dtype=np.int64)
        merged[to] = order
        order, run = merged, 2 * run
    shared, sorted_right = neighbours(padded, order, size)
    if not sorted_right:
        order = np.lexsort(padded.T[::-1])
        shared, _ = neighbours(padded, order, size)
    return order, shared


def neighbours(padded: np.ndarray, order: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, bool]:
    """Common prefix of each row with the row before it, from the bytes; whether the order is right."""
    shared = np.zeros(len(order), dtype=np.int64)
    right = True
    for low in range(1, len(order), 20_000):
        a, b = padded[order[low - 1 : min(len(order), low + 20_000) - 1]], padded[order[low : low + 20_000]]
        k = np.where((differ := a != b).any(1), differ.argmax(1), a.shape[1] - 1)
        rows = np.arange(len(k))
        right &= bool((a[rows, k] <= b[rows, k]).all())
        shared[low : low + 20_000] = np.minimum(k, np.minimum(size[order[low - 1 : low - 1 + len(k)]], size[order[low : low + len(k)]]))
    return shared, right


def compare_stretches(window: int):
    """Sorted batches of requests with their bytes -> removed stretches."""
    ahead, back = window, window - GRAM

    def complete(rows: pd.DataFrame):
        before, after = rows["before"].to_numpy(np.int64), rows["after"].to_numpy(np.int64)
        n = len(rows)
        forwards, backwards = np.zeros((n, ahead), dtype=np.uint8), np.zeros((n, back), dtype=np.uint8)
        fsize, bsize = np.minimum(ahead, window - after), before.copy()
        for k, (body, b) in enumerate(zip(rows["body"], before, strict=True)):
            x = np.frombuffer(body, dtype=np.uint8)
            f = x[b : b + ahead]
            forwards[k, : len(f)] = f
            backwards[k, :b] = x[:b][::-1]
        f_order, f_shared = suffix_sort(forwards, fsize)
        b_order, b_shared = suffix_sort(backwards, bsize)
        gram = rows["gram"].to_numpy(np.int64)
        rank = np.empty(n, dtype=np.int64)
        rank[np.lexsort((rows["start"], rows["version"], rows["id"]))] = np.arange(n)
        lows, highs, owners = [], [], []
        for a in range(int(after.min()), int(before.max()) + 1):
            has = np.flatnonzero((after <= a) & (a <= before))
            if len(has) < 2:
                continue
            f_class, b_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            f_class[f_order] = np.cumsum(f_shared < window - a)
            b_class[b_order] = np.cumsum(b_shared < a)
            order = has[np.lexsort((rank[has], b_class[has], f_class[has], gram[has]))]
            x, y = order[:-1], order[1:]
            again = order[1:][(f_class[x] == f_class[y]) & (b_class[x] == b_class[y]) & (gram[x] == gram[y])]
            owners.append(again)
            lows.append(before[again] - a)
        if not owners or not sum(map(len, owners)):
            return
        owner, low = np.concatenate(owners), np.concatenate(lows)
        order = np.lexsort((low, owner))
        owner, low = owner[order], low[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (low[1:] > low[:-1] + window)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(owner)] - 1
        who = owner[first]
        start = rows["start"].to_numpy(np.int64)[who] + low[first]
        yield pd.DataFrame({"id": rows["id"].to_numpy()[who], "version": rows["version"].to_numpy()[who], "start": start, "end": start + low[last] - low[first] + window})

    def run(batches):
        open_rows = None
        for pdf in batches:
            rows = pdf if open_rows is None else pd.concat([open_rows, pdf], ignore_index=True)
            if rows.empty:
                continue
            last = int(np.searchsorted(rows["gram"].to_numpy(), rows["gram"].iloc[-1]))
            if last:
                yield from complete(rows.iloc[:last])
            open_rows = rows.iloc[last:]
        if open_rows is not None and len(open_rows):
            yield from complete(open_rows)

    return run


def repeated_stretches(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, version, start, end) of stretches of ``docs`` (id, version: long, body: binary) that strings of ``window``
    bytes cover which start earlier too: at a smaller (id, version), or earlier in the same body. The stretches of a
    document may overlap."""
    spark = docs.sparkSession
    n = partitions(spark)
    found = docs.mapInPandas(find_anchors(window), ANCHORS)
    met = written(found.repartition(n, "gram").sortWithinPartitions("gram").mapInPandas(meet_anchors(window), ANCHORS), "anchors")
    gone = met.where("after = -1").select("id", "version", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("before")).cast("long").alias("end"))
    ask = F.struct("gram", "before", "after", "start")
    asked = met.where("after >= 0").groupBy("id", "version").agg(F.collect_list(ask).alias("asked"))
    cut = F.transform("asked", lambda r: F.struct(r.gram.alias("gram"), r.before.alias("before"), r.after.alias("after"), r.start.alias("start"),
                                                  F.substring(F.col("body"), r.start + 1, r.before - r.after + window).alias("body")))
    stretches = docs.dropDuplicates(["id", "version"]).join(asked, ["id", "version"]).select("id", "version", F.inline(cut))
    compared = stretches.repartition(n, "gram").sortWithinPartitions("gram").mapInPandas(compare_stretches(window), "id long, version long, start long, end long")
    return gone.union(compared)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with id (null: before all others), version (hash of the text: rows that share a doc_id) and body (UTF-8)."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("version", F.xxhash64("text")).withColumn("body", body)


def joined_spans(spans) -> list[tuple[int, int]]:
    """Spans (start, end), sorted and joined where they overlap or touch."""
    out: list[list[int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans) if spans is not None else ():
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def without(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    return b"".join(body[s:e] for s, e in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(body)], strict=True))


@F.pandas_udf(StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]))
def cut_digest(body: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for b, xs in zip(body, spans, strict=True):
        runs = joined_spans(xs)
        out.append((sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(b, runs)).hexdigest()))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])


@F.pandas_udf(StringType())
def cut_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text without the whole characters of the spans."""

    def cut(t, xs):
        b, runs = t.encode("utf-8"), []
        for s, e in joined_spans(xs):
            while s < e and b[s] & 0xC0 == 0x80:
                s += 1
            while e < len(b) and e > s and b[e] & 0xC0 == 0x80:
                e -= 1
            runs.append((s, e))
        return without(b, runs).decode("utf-8")

    return pd.Series([t if xs is None else cut(t, xs) for t, xs in zip(text, spans, strict=True)], dtype=object)


def spans_of(stretches: DataFrame) -> DataFrame:
    return stretches.groupBy("id", "version").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with text cut by the whole characters that repeat an earlier string of ``window`` bytes, and n_chars with
    it. Every row stays, one that repeats as a whole with an empty text; null texts stay null. Rows that can't have spans stay where
    they are; only the others are shuffled to meet theirs."""
    keys = keyed(boxed(docs))
    spans = written(spans_of(repeated_stretches(keys.select("id", "version", "body"), window)).select(F.struct("id", "version").alias("key"), "spans"), "spans")
    there = flagged(keys.select("doc_id", "text", "row", F.struct("id", "version").alias("key")), spans, "key")
    met = there.where("maybe").join(spans, "key", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut_text(F.coalesce("text", F.lit("")), "spans"))
    return unboxed(there.where("not maybe"), docs.columns, F.col("text")).union(unboxed(met, docs.columns, text))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``documents``.

    A null text is an empty one. A null doc_id comes before all others. Rows that share a doc_id but not the text come in
    the order of a hash of the text; a row repeated exactly is one document, and both rows get its result."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = spans_of(repeated_stretches(docs.select("id", "version", "body")))
    found = docs.select("doc_id", "id", "version", "body").join(spans, ["id", "version"], "left")
    found = found.select("doc_id", F.length("body").cast("long").alias("n_bytes"), cut_digest("body", "spans").alias("cut"))
    return found.select("doc_id", "n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")
